import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from martloom.llm import conversation_repair as C, queries

LAYOUT = "conv_id bigint, turn bigint, role string, text string, symbol string, place string, key string"


def damage(rows):
    """(conv_id, turn, role, text) after damage and the ids of all conversations."""
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out, {r[0] for r in rows}


def brute(rows, convs):
    """One row for each conversation, by a plain table of the best (cost, audit, lines) over rows and states."""
    groups = {c: [] for c in convs}
    for r in rows:
        groups[r[0]].append(r[1:])
    out = Counter()
    for conv, items in groups.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, n = set(), [], Counter()
        for _, role, text in items:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            n[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        turns = {r[0] for r in items} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        best = {"": (0, "", ())}
        state_of = lambda s, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, x))

        def offer(table, state, found):
            if state is not None and (state not in table or found < table[state]):
                table[state] = found

        def inserted(table):
            for _ in range(3):
                for s, (cost, audit, lines) in list(table.items()):
                    for x, name in (("u", "user"), ("a", "assistant")):
                        offer(table, state_of(s, x), (cost + 2, audit + "I", lines + (f"{name}:",)))
            return table

        for (_, role, text), fault in zip(items, faults):
            table, cut = {}, fault == "truncated"
            for s, (cost, audit, lines) in inserted(best).items():
                offer(table, s, (cost + 3, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    offer(table, state_of(s, role[:1]), (cost + cut, audit + "K", lines + (f"{role}:{text}",)))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        offer(table, state_of(s, x), (cost + 2 + cut, audit + "R", lines + (f"{name}:{text}",)))
            best = table
        cost, audit, lines = min(best_ for s, best_ in inserted(best).items() if s in ("", "a"))
        out[(conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, "\n".join(lines))] += 1
    return out


def result(df, **options):
    return Counter(tuple(r) for r in C.repair(df, **options).collect())


def conversations(seed, count, longest):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "anyone"]
    lines = ["Yes.", "No!", "cut off", "", " \t", None, "Why?", "Yes. ", "ünï…", "long " * 200 + "."]
    rows = []
    for conv in range(count):
        usual = pick.random() < 0.5
        for turn in range(pick.randrange(longest)):
            role = ("user", "assistant")[turn % 2] if usual and pick.random() < 0.8 else pick.choice(roles)
            text = f"Line {turn}." if usual and pick.random() < 0.7 else pick.choice(lines)
            rows.append((conv or None, None if pick.random() < 0.05 else turn * pick.choice([1, 1, 2]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_damaged_conversations_against_brute_force(spark, seed):
    rows = conversations(seed, 120, 14)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], LAYOUT).repartition(5)
    assert result(C.damaged(df), present="present") == brute(*damage(rows))


def test_long_conversations_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_ROWS", 7)
    rows = conversations(3, 3, 8) + [(50, *r[1:]) for r in conversations(4, 40, 12)] + [(51, i, "user", f"Q{i}") for i in range(90)]
    rows += [(52, 1, "user", "Same.")] * 30 + [(53, 0, "system", "Begin.")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], LAYOUT)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = brute(clean, {r[0] for r in clean})
    assert result(df) == want
    digests = Counter((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in want)
    assert result(df, digest=True) == digests


def test_dropped_and_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hello.", "", "", "")], LAYOUT)
    assert result(C.damaged(df), present="present") == Counter([(dropped, 0, 0, 0, 0, 0, 0, "", "")])
    assert not result(df.limit(0))


def test_block_table_agrees_with_single_rows():
    table, pick = C.BlockTable(), random.Random(7)
    for _ in range(300):
        symbols = bytes(pick.randrange(9) for _ in range(pick.randrange(30)))
        costs = table.units[0]
        for s in symbols:
            costs = C.after_row(C.with_inserts(costs), s)
        costs = C.with_inserts(costs)
        borders, off = table.scan(table.units[0], table.codes(symbols))
        assert min(C.with_inserts(borders[-1])) + off == min(costs)
    assert len(table.vectors) < 500


def test_registered_query(spark, sf_dir):
    df = queries.op12_conversations(spark, sf_dir)
    assert df.dtypes == [("conv_id", "bigint"), *[(n, "bigint") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                         ("audit", "string"), ("repaired_sha256", "string")]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = Counter((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in brute(*damage(rows)))
    assert Counter(tuple(r) for r in df.collect()) == want
