"""Faults of conversations and their cheapest repair, by block tables over normalised cost vectors.

A repaired conversation is empty or reads (system)? (user assistant)+. Four states tell how far it is: nothing yet, after the system row,
after a user, after an assistant. A row is one of nine symbols: it must go, or it has one of four role initials and ends well or cut off. The
cost of reaching each state, less the smallest cost, is one of a few vectors, and for each such vector and each block of BLOCK symbols a
table holds the vector behind the block and what was added. So a conversation is scanned block by block with one lookup each. Blocks are
then expanded from the last back to the first, only to mark the steps that lie on some cheapest path; a walk forward over marked steps that
takes the least letter each time gives the least audit of all cheapest ones.

Rows are sorted over the cluster by conversation and turn. Conversations that end within a task are finished there; those that go on in
another task, or are longer than PIECE_ROWS, are handed on as pieces with the costs between each two states, and the pieces' borders
are settled from these. No task holds more than a piece of texts.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from martloom.llm.common import slices, small_batches, stored

BLOCK = 4
PIECE_ROWS = 4096
PIECE_CHARS = 2_000_000
WHITE = " \t\n\x0b\x0c\r"
# Costs of the edits; a row that stays although it ends cut off costs one more.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
GONE, PAD, SYMBOLS = 8, 9, 10
FAR = 1 << 40
# From a state that is dearer than another by more than this no cheapest path goes on: two inserts and a deletion make up for any state.
REACH = 2 * INSERT + DELETE
# The next state and role of an inserted or renamed row, and what is still to be inserted at the end, by state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
TAIL = (0, 2 * INSERT, INSERT, 0)


def _kept(symbol: int, state: int) -> int | None:
    """The state after keeping a row, None where its role does not fit."""
    initial = symbol % 4
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def row_steps(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of one row, by letter."""
    if symbol == PAD:
        return [("", state, 0)]
    steps = [("D", state, DELETE)]
    if symbol != GONE:
        cut = CUT if symbol >= 4 else 0
        kept = _kept(symbol, state)
        if kept is not None:
            steps.append(("K", kept, cut))
        steps.append(("R", NEXT[state], RENAME + cut))
    return steps


def with_inserts(costs: tuple) -> tuple:
    out = list(costs)
    for _ in range(2):
        for state in range(4):
            out[NEXT[state]] = min(out[NEXT[state]], out[state] + INSERT)
    return tuple(out)


def after_row(closed: tuple, symbol: int) -> tuple:
    out = [FAR] * 4
    for state in range(4):
        for _, to, cost in row_steps(symbol, state):
            out[to] = min(out[to], closed[state] + cost)
    return tuple(out)


def normalised(costs: tuple) -> tuple[tuple, int]:
    least = min(costs)
    return tuple(c - least if c - least <= REACH else FAR for c in costs), least


class BlockTable:
    """Transitions of every normalised vector that occurs by every block of ``size`` symbols."""

    def __init__(self, size: int = BLOCK):
        self.size = size
        self.units = [tuple(0 if i == s else FAR for i in range(4)) for s in range(4)]
        self.vectors, steps = list(self.units), []
        self.ids = {v: i for i, v in enumerate(self.vectors)}
        for vector in self.vectors:  # grows while new vectors are met
            row = []
            for symbol in range(SYMBOLS):
                to, cost = self.one(vector, symbol)
                if to not in self.ids:
                    self.ids[to] = len(self.vectors)
                    self.vectors.append(to)
                row.append((self.ids[to], cost))
            steps.append(row)
        to, cost = np.array([[x[0] for x in r] for r in steps]), np.array([[x[1] for x in r] for r in steps])
        self.to, self.cost = to, cost
        for _ in range(size - 1):
            self.cost = (self.cost[:, :, None] + cost[self.to]).reshape(len(to), -1)
            self.to = to[self.to].reshape(len(to), -1)
        self.expand = lru_cache(maxsize=200_000)(self._expand)

    def one(self, vector: tuple, symbol: int) -> tuple[tuple, int]:
        return normalised(after_row(with_inserts(vector), symbol))

    def codes(self, symbols: bytes) -> list[int]:
        """Numbers of the blocks, the last filled up with the symbol that changes nothing."""
        padded = np.frombuffer(symbols + bytes([PAD]) * (-len(symbols) % self.size), np.uint8).reshape(-1, self.size)
        return (padded.astype(np.int64) @ (SYMBOLS ** np.arange(self.size - 1, -1, -1))).tolist()

    def digits(self, code: int) -> list[int]:
        return [code // SYMBOLS ** i % SYMBOLS for i in range(self.size - 1, -1, -1)]

    def block(self, vector: tuple, code: int) -> tuple[tuple, int]:
        at = self.ids.get(vector)
        if at is not None:
            return self.vectors[self.to[at, code]], int(self.cost[at, code])
        total = 0  # vectors put together from pieces may differ in states that no cheapest path uses
        for symbol in self.digits(code):
            vector, cost = self.one(vector, symbol)
            total += cost
        return vector, total

    def scan(self, vector: tuple, codes: list[int]) -> tuple[list[tuple], int]:
        """The vectors at all borders of the blocks, and the cost taken off the last one."""
        borders, total = [vector], 0
        for code in codes:
            vector, cost = self.block(vector, code)
            borders.append(vector)
            total += cost
        return borders, total

    def _expand(self, vector: tuple, code: int, alive: int) -> tuple[int, dict[int, tuple[str, int]]]:
        """Of one block: its first states on a cheapest path to an ``alive`` last one, and from each the least letters and the last state."""
        symbols, raw = self.digits(code), [vector]
        closed = []
        for symbol in symbols:
            closed.append(with_inserts(raw[-1]))
            raw.append(after_row(closed[-1], symbol))
        good = {s for s in range(4) if alive >> s & 1}
        moves: list[dict[int, list[tuple[str, int, bool]]]] = []
        for symbol, costs, before, after in zip(reversed(symbols), reversed(closed), reversed(raw[:-1]), reversed(raw[1:])):
            choice = {s: [(letter, to, True) for letter, to, cost in row_steps(symbol, s) if to in good and costs[s] + cost == after[to]]
                      for s in range(4) if costs[s] < FAR}
            for _ in range(3):
                for s in choice:
                    more = ("I", NEXT[s], False)
                    if more not in choice[s] and costs[s] + INSERT == costs[NEXT[s]] and choice.get(NEXT[s]):
                        choice[s].append(more)
            moves.append({s: sorted(m) for s, m in choice.items() if m})
            good = {s for s in moves[-1] if before[s] == costs[s]}
        paths = {}
        for first in good:
            state, letters = first, []
            for here in reversed(moves):
                consumed = False
                while not consumed:
                    letter, state, consumed = here[state][0]
                    letters.append(letter)
            paths[first] = "".join(letters), state
        return sum(1 << s for s in good), paths

    def trace(self, vector: tuple, codes: list[int], alive: int) -> dict[int, tuple[str, int]]:
        """From each first state on a cheapest path that ends in an ``alive`` state: the least letters and the last state."""
        borders, _ = self.scan(vector, codes)
        parts = []
        for before, code in zip(reversed(borders[:-1]), reversed(codes)):
            alive, paths = self.expand(before, code, alive)
            parts.append(paths)
        out = {}
        for first in range(4):
            if alive >> first & 1:
                state, letters = first, []
                for paths in reversed(parts):
                    some, state = paths[state]
                    letters.append(some)
                out[first] = "".join(letters), state
        return out


@lru_cache(maxsize=1)
def block_table() -> BlockTable:
    return BlockTable()


def apply_edits(letters: str, state: int, roles: list[str], rows: list[str]) -> list[str]:
    """The repaired rows as ``role:text``; ``state`` is the one before the first letter."""
    out, at = [], 0
    for letter in letters:
        if letter in "IR":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{rows[at] if letter == 'R' else ''}")
        elif letter == "K":
            state = _kept(INITIALS.index(roles[at][0]), state)
            out.append(f"{roles[at]}:{rows[at]}")
        at += letter != "I"
    return out


class Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.chars = conv_id, 0
        self.roles: list[str] = []
        self.rows: list[str] = []
        self.symbols = bytearray()
        self.turns: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, role: str, text: str, symbol: int, turn: int | None, repeated: bool, before: str | None) -> None:
        self.blank += symbol == GONE
        self.duplicate += symbol != GONE and repeated
        symbol = GONE if repeated else symbol
        self.truncated += 4 <= symbol < GONE
        if before is not None:
            self.illegal += before + role[:1] not in ("su", "ua", "au")
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            self.turns.append(turn)
        self.roles.append(role)
        self.rows.append(text)
        self.symbols.append(symbol)
        self.chars += len(role) + len(text)

    def numbers(self) -> dict:
        turns = self.turns
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(turns)}


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_FINAL = ("gaps", *_COUNTS, "cost")
_PIECE = {"place": pa.int64(), "first_turn": pa.int64(), "last_turn": pa.int64(), "turns": pa.int64(), "roles": pa.list_(pa.string()),
          "rows": pa.list_(pa.string()), "symbols": pa.binary(), "between": pa.list_(pa.int64())}
_TYPES = dict.fromkeys(_FINAL, pa.int64()) | {"audit": pa.string(), "repaired": pa.string()} | _PIECE
_FINAL_DDL = ", ".join(f"{n} bigint" for n in _FINAL) + ", audit string, repaired string"
_PIECE_DDL = ("place bigint, first_turn bigint, last_turn bigint, turns bigint, roles array<string>, rows array<string>, symbols binary, "
              "between array<bigint>")


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _whole(piece: Piece, digest: bool) -> dict:
    """The result row of a conversation that is one piece."""
    table, n = block_table(), piece.numbers()
    codes = table.codes(bytes(piece.symbols))
    borders, off = table.scan(table.units[START], codes)
    ends = [c + t for c, t in zip(borders[-1], TAIL)]
    alive = sum(1 << s for s in range(4) if ends[s] == min(ends))
    letters, state = table.trace(table.units[START], codes, alive)[START]
    letters += "I" * (TAIL[state] // INSERT)
    text = "\n".join(apply_edits(letters, START, piece.roles, piece.rows))
    return {k: n[k] for k in _COUNTS} | {
        "gaps": _gaps(n["first_turn"], n["last_turn"], n["turns"]), "cost": off + min(ends), "audit": letters,
        "repaired": hashlib.sha256(text.encode()).hexdigest() if digest else text}


def _part(piece: Piece, place: int) -> dict:
    """A piece that has to be joined with others: its rows and the costs between each two states."""
    table = block_table()
    codes, between = table.codes(bytes(piece.symbols)), []
    for unit in table.units:
        borders, off = table.scan(unit, codes)
        between += [min(FAR, c + off) for c in borders[-1]]
    return piece.numbers() | {"place": place, "roles": piece.roles, "rows": piece.rows, "symbols": bytes(piece.symbols), "between": between}


def _scan(batches: Iterator[pa.RecordBatch], kind: pa.DataType, digest: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, present, symbol, later) to finished conversations and pieces."""
    place = TaskContext.get().partitionId() << 32
    piece, split, before, seen, out = None, True, None, None, []

    def rows() -> pa.RecordBatch:
        columns = [pa.array([i for i, _ in out], kind), *(pa.array([r.get(n) for _, r in out], t) for n, t in _TYPES.items())]
        batch = pa.RecordBatch.from_arrays(columns, ["conv_id", *_TYPES])
        out.clear()
        return batch

    def close(last: bool) -> None:
        nonlocal place, split
        whole = not split and not last
        out.append((piece.conv_id, _whole(piece, digest) if whole else _part(piece, place)))
        place += 1

    size = 0
    for part in slices(batches):
        for conv_id, turn, role, text, present, symbol, later in zip(*(c.to_pylist() for c in part.columns)):
            if piece is None or conv_id != piece.conv_id:
                if piece is not None:
                    close(False)
                    split = False
                piece, before, seen = Piece(conv_id), None, None
            elif len(piece.rows) >= PIECE_ROWS or piece.chars >= PIECE_CHARS:
                split = True
                close(False)
                size += PIECE_CHARS
                piece = Piece(conv_id)
            if present:
                piece.add(role, text, symbol, turn, later or seen == (turn, role, text), before)
                before, seen = role[:1], (turn, role, text)
                size += len(text)
            if size >= PIECE_CHARS and out:
                yield rows()
                size = 0
    if piece is not None:
        close(True)
    if out:
        yield rows()


def settle_borders(pieces: pd.DataFrame) -> pd.DataFrame:
    """Of the pieces of one conversation: the costs before each and the last states of each that lie on a cheapest path."""
    pieces = pieces.sort_values("place")
    between = [np.array(x, np.int64).reshape(4, 4) for x in pieces["between"]]
    costs = [np.array([0, FAR, FAR, FAR], np.int64)]
    for m in between:
        costs.append(np.minimum((costs[-1][:, None] + m).min(0), FAR))
    rest, ends = np.array(TAIL, np.int64), []
    total = int((costs[-1] + rest).min())
    for m, after in zip(reversed(between), reversed(costs[1:])):
        ends.append(int(sum(1 << s for s in range(4) if after[s] + rest[s] == total)))
        rest = (m + rest).min(1)
    entry = [list(normalised(tuple(int(x) for x in c))[0]) for c in costs[:-1]]
    return pd.DataFrame({"place": pieces["place"].to_numpy(), "entry": entry, "ends": ends[::-1], "cost": total})


def _traced(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each piece with its letters and last state from every first state a cheapest path may come from."""
    table, path = block_table(), pa.list_(pa.struct([("first", pa.int64()), ("letters", pa.string()), ("last", pa.int64())]))
    for part in slices(batches, 16):
        symbols, entry, ends = (part.column(part.schema.get_field_index(n)).to_pylist() for n in ("symbols", "entry", "ends"))
        paths = [[{"first": f, "letters": letters, "last": last} for f, (letters, last) in table.trace(tuple(e), table.codes(s), a).items()]
                 for s, e, a in zip(symbols, entry, ends)]
        kept = [part.column(part.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(paths, path)], [*names, "paths"])


def _joined(batches: Iterator[pa.RecordBatch], kind: pa.DataType, digest: bool) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place to finished conversations; texts are hashed as they pass."""
    conv_id, row, letters, text = None, None, [], None
    fields = {n: t for n, t in _TYPES.items() if n not in _PIECE}

    def finish() -> pa.RecordBatch:
        row["audit"] = "".join([*letters, "I" * (TAIL[row["state"]] // INSERT)])
        for _ in range(TAIL[row["state"]] // INSERT):
            put(f"{ROLE[NEXT[row['state']]]}:")
            row["state"] = NEXT[row["state"]]
        row["gaps"] = _gaps(row["first_turn"], row["last_turn"], row["turns"])
        row["repaired"] = text.hexdigest() if digest else "".join(text)
        return pa.RecordBatch.from_arrays([pa.array([conv_id], kind), *(pa.array([row[n]], t) for n, t in fields.items())], ["conv_id", *fields])

    def put(line: str) -> None:
        piece = ("\n" if row["any"] else "") + line
        row["any"] = True
        text.update(piece.encode()) if digest else text.append(piece)

    for part in slices(batches, 16):
        for p in part.to_pylist():
            if row is None or p["conv_id"] != conv_id:
                if row is not None:
                    yield finish()
                conv_id, letters, text = p["conv_id"], [], hashlib.sha256() if digest else []
                row = dict.fromkeys((*_COUNTS, "turns"), 0) | {"state": START, "any": False, "first_turn": None, "last_turn": None, "before": None, "cost": p["cost"]}
            path = next(x for x in p["paths"] if x["first"] == row["state"])
            for line in apply_edits(path["letters"], row["state"], p["roles"], p["rows"]):
                put(line)
            letters.append(path["letters"])
            row["state"] = path["last"]
            for name in _COUNTS:
                row[name] += p[name]
            row["turns"] += p["turns"] - (p["turns"] > 0 and p["first_turn"] == row["last_turn"])
            if p["turns"]:
                row["first_turn"] = p["first_turn"] if row["first_turn"] is None else row["first_turn"]
                row["last_turn"] = p["last_turn"]
            if p["roles"]:
                start = p["roles"][0][:1]
                # Only pieces cut by another task's border begin without knowing the row before.
                if row["before"] is not None and p["open"]:
                    row["illegal"] += row["before"] + start not in ("su", "ua", "au")
                row["before"] = p["roles"][-1][:1]
    if row is not None:
        yield finish()


def repair(df: DataFrame, present: str | None = None, digest: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation of (conv_id, turn, role, text).

    Rows go by turn, null turns first, and within a turn by role and text. Null roles and texts are one space; rows of a null id are one
    conversation; repeated rows are duplicates; an empty role has no initial and fits nowhere. Rows whose column ``present`` is false are
    none, but their conversation has a result: zeros, an empty audit and an empty text. ``repaired`` is the ``role:text`` lines, or, with
    ``digest``, their SHA-256 in hexadecimal digits. No rows give no rows. Other columns are not read.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    here = F.col(f"`{present}`") if present else F.lit(True)
    clean = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    rows = small_batches(df).select("conv_id", "turn", clean("role"), clean("text"), here.alias("present"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.when(F.col("role") == "", 3).otherwise((F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) + 3) % 4)
    cut = F.when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 4).otherwise(0)
    symbol = F.when(bare == "", GONE).otherwise(initial + cut).cast("int")
    spot = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    same = [F.xxhash64(F.lit(n), F.col("conv_id").isNull(), "conv_id", "role", "text").alias(f"h{n}") for n in (1, 2)]
    rows = rows.select("*", symbol.alias("symbol"), *same)
    firsts = rows.where("present").groupBy("h1", "h2").agg(F.min(spot).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = F.coalesce(spot > F.col("_first"), F.lit(False))
    order = ["conv_id", "turn", "role", "text"]
    marked = rows.join(firsts, ["h1", "h2"], "left").select(*order, "present", "symbol", later.alias("later"))
    arrow = to_arrow_type(df.schema["conv_id"].dataType)
    made = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: _scan(batches, arrow, digest), f"conv_id {kind}, {_FINAL_DDL}, {_PIECE_DDL}")
    made = stored(made, "conversations")
    final = ["conv_id", *_FINAL, "audit", "repaired"]
    pieces = made.where("place IS NOT NULL").drop("gaps", "cost", "audit", "repaired")
    borders = stored(pieces.select("conv_id", "place", "between").groupBy("conv_id").applyInPandas(
        settle_borders, "place bigint, entry array<bigint>, ends bigint, cost bigint"), "borders")
    names = ["conv_id", "place", *_COUNTS, "first_turn", "last_turn", "turns", "roles", "rows", "cost"]
    both = pieces.join(borders, "place")
    traced = both.mapInArrow(lambda batches: _traced(batches, names), _schema_of(both, names) + ", paths array<struct<first: bigint, letters: string, last: bigint>>")
    # The first piece of a task doesn't know the row before it.
    traced = traced.withColumn("open", F.col("place").bitwiseAND((1 << 32) - 1) == 0)
    # One conversation's text is hashed in order, so its pieces pass through one task, one after the other.
    joined = traced.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(
        lambda batches: _joined(batches, arrow, digest), f"conv_id {kind}, {_FINAL_DDL}")
    return made.where("place IS NULL").select(*final).unionByName(joined.select(*final))


def _schema_of(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) with faults put in by the checksum of their id and turn.

    Of 20 remainders 0 drops the row (``present`` is false), 1 empties its text, 2 removes its sentence ends, 3 repeats it and 4 makes it
    the user's. Nulls are one space, also in the checksum.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    broken = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"),
                       (F.col("fate") != 0).alias("present"), copies.alias("copy")).drop("copy")
