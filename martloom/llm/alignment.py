"""Which tokens of two tokenizers stand for the same bytes, by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the token that overlaps it and ends farthest right; where the two end
together, the second tokenizer's token points to itself. Doubling the pointers of all tokens at once leads each to the terminal token of its
component, and equal terminals are a group. The links of a group are all its pairs of a first and a second token.

Texts are handled in packets of a bounded size. A packet counts its links once for each pair of ids; pairs are counted over the corpus from
those, and the counts go back to the packets that asked for them, so no task holds the links of more than a packet.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from martloom.llm.bpe import LONGEST_REMEMBERED, LibraryCodec, codec_of, vocabulary
from martloom.llm.common import slices, stored, texts

PACKET_CHARS = 1_000_000
REMEMBERED_WORDS = 600_000
# Groups of more links are linked by their distinct ids, which repeat in such groups.
SMALL_GROUP = 1024
_SPACED = re.compile(r"\x20+[^\x20]*")
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class PlainCodec(LibraryCodec):
    """Ids of a byte-level vocabulary; special tokens' strings are plain text."""

    def ids(self, some: list[str]) -> list[np.ndarray]:
        return [np.array(self.library.encode_ordinary(t), np.int64) for t in some]


class PieceCodec(dict):
    """Ids of a piece model that puts a space before the text.

    No piece goes on after a space, so stretches of spaces with what follows are encoded apart, new ones all at once, and remembered
    as little-endian unsigned 32-bit integers.
    """

    def __init__(self, model: bytes):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.labels = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        begins = b"".join(self.labels[i] for i in self.model.encode("a")) == b" a"
        self.apart = begins and not any("▁" in p.lstrip("▁") for p in pieces)
        # A space at the end has no text behind it.
        self.fixed = {" ": self.packed[self.model.piece_to_id("▁")]}
        self.update(self.fixed)

    def ids(self, some: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(x, np.int64) for x in self.model.encode(some, num_threads=1)]
        if len(self) > REMEMBERED_WORDS:
            self.clear()
            self.update(self.fixed)
        cut = [_SPACED.findall(" " + t) for t in some]
        new = list(set(chain.from_iterable(cut)).difference(self))
        packed = self.packed
        for stretch, ids in zip(new, self.model.encode([x[1:] for x in new], num_threads=1)):
            self[stretch] = b"".join([packed[i] for i in ids])
        out = [np.frombuffer(b"".join([self[x] for x in stretches]), "<u4").astype(np.int64) for stretches in cut]
        for stretch in new:
            if len(stretch) > LONGEST_REMEMBERED:
                del self[stretch]
        return out


def terminals(end_a: np.ndarray, end_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> np.ndarray:
    """For each token, those of a first, the number of its component's terminal token among those of b."""
    n = len(end_a)
    to_b = np.searchsorted(start_b, end_a) - 1
    to_a = np.searchsorted(start_a, end_b) - 1
    jump = np.concatenate([n + to_b, np.where(end_a[to_a] > end_b, to_a, n + np.arange(len(end_b)))])
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump - n
        jump = further


class Aligned:
    """The groups and links of some texts that both tokenizers cut without loss; ids are arrays for all texts together."""

    def __init__(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, docs: int):
        self.a, self.b, self.docs = a, b, docs
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        last = terminals(end_a, end_b, end_a - size_a[a], end_b - size_b[b])
        ends = np.flatnonzero(last[len(a):] == np.arange(len(b)))
        self.of_group = of_b[ends]
        number = np.zeros(len(b), np.int64)
        number[ends] = np.arange(len(ends))
        self.group_a, self.group_b = number[last[:len(a)]], number[last[len(a):]]
        self.count_a, self.count_b = np.bincount(self.group_a, minlength=len(ends)), np.bincount(self.group_b, minlength=len(ends))
        self.first_a, self.first_b = np.cumsum(self.count_a) - self.count_a, np.cumsum(self.count_b) - self.count_b
        self.numbers = [np.bincount(x, minlength=docs) for x in (of_a, of_b, self.of_group)]
        self.numbers.append(np.bincount(self.of_group, self.count_a * self.count_b, docs).astype(np.int64))

    def written(self, words: list[str], shift: int) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2``; ``words`` holds every id with the four signs that may follow it."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (self.group_a, self.group_b))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + self.first_b[self.group_a]] = self.a + shift * last_a
        codes[np.arange(len(self.b)) + (self.first_a + self.count_a)[self.group_b]] = self.b + 2 * shift + shift * last_b
        stops = np.cumsum(self.numbers[0] + self.numbers[1])
        return ["".join([words[c] for c in codes[i:j].tolist()])[:-1] for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): how often a text links a pair of ids; a pair is the first id in the high 32 bits, the second in the low ones."""
        size = self.count_a * self.count_b
        some = size <= SMALL_GROUP
        x = np.flatnonzero(some[self.group_a])
        g = self.group_a[x]
        n = self.count_b[g]
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first_b[g], n)
        parts = [(np.repeat(self.of_group[g], n), np.repeat(self.a[x], n) << 32 | self.b[y], np.ones(len(y)))]
        for g in np.flatnonzero(~some).tolist():
            ids_a, times_a = np.unique(self.a[self.first_a[g]:self.first_a[g] + self.count_a[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.first_b[g]:self.first_b[g] + self.count_b[g]], return_counts=True)
            pairs = (ids_a[:, None] << 32 | ids_b[None, :]).ravel()
            parts.append((np.full(len(pairs), self.of_group[g]), pairs, np.outer(times_a, times_b).ravel().astype(float)))
        doc, pair, times = (np.concatenate(p) for p in zip(*parts))
        keys, at = np.unique(pair, return_inverse=True)
        both, which = np.unique(doc * len(keys) + at, return_inverse=True)
        return both // max(1, len(keys)), keys[both % max(1, len(keys))], np.bincount(which, times).astype(np.int64)


class Aligner:
    """Both vocabularies in a Python worker."""

    def __init__(self, byte_level: str, model: bytes):
        self.first, self.second = codec_of(byte_level, PlainCodec), PieceCodec(model)
        self.sizes = [np.array([len(x) for x in c.labels], np.int64) for c in (self.first, self.second)]
        self.shift = max(map(len, self.sizes))
        self.words = [f"{i}{sign}" for sign in ",|,;" for i in range(self.shift)]

    def align(self, some: list[str]) -> tuple[Aligned, list[int]]:
        """The alignment of those texts that both tokenizers cut without loss, and which they are."""
        which = [i for i, text in enumerate(some) if text]
        spaced = [" " + some[i] for i in which]
        cuts = list(zip(self.first.ids(spaced), self.second.ids([some[i] for i in which])))
        whole = [all(b"".join([c.labels[t] for t in cut.tolist()]) == text.encode() for c, cut in zip((self.first, self.second), pair))
                 for text, pair in zip(spaced, cuts)]
        ids, which = [c for c, good in zip(cuts, whole) if good], [i for i, good in zip(which, whole) if good]
        empty = [np.zeros(0, np.int64)]
        joined = [np.concatenate([c[side] for c in ids] or empty) for side in (0, 1)]
        owner = [np.repeat(np.arange(len(ids)), np.array([len(c[side]) for c in ids], np.int64)) for side in (0, 1)]
        return Aligned(*joined, *owner, *self.sizes, len(ids)), which


_ALIGNERS: dict[str, Aligner] = {}


def aligner_of(byte_level: str, model: bytes) -> Aligner:
    """One aligner for each pair of vocabularies in a worker."""
    key = hashlib.sha256(byte_level.encode() + model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(byte_level, model)
    return _ALIGNERS[key]


def _packets(part: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a batch in pieces of about PACKET_CHARS characters."""
    start, size, all_texts = 0, 0, part.column(1).to_pylist()
    for i, text in enumerate(all_texts):
        size += len(text)
        if size >= PACKET_CHARS or i == len(all_texts) - 1:
            yield part.column(0).slice(start, i + 1 - start), all_texts[start:i + 1]
            start, size = i + 1, 0


def align_documents(df: DataFrame, byte_level_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                    digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row.

    ``groups`` lists the ids of both tokenizers by group, or, with ``digest``, is the SHA-256 of that list in hexadecimal digits. A pair of ids
    counts once for each row that links it; ``n_best`` are links whose count is the highest of their first id, ``count_sum`` sums the
    counts of all links. Rows of a repeated id count each. Null and empty texts, and those a tokenizer doesn't give back byte by byte,
    have zeros and empty ``groups``. No rows give no rows.
    """
    data = texts(df, id_col, text_col)
    kind = data.schema["doc_id"].dataType.simpleString()
    source = vocabulary(df, byte_level_path)
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    types = dict.fromkeys(_NUMBERS, pa.int64()) | {"packet": pa.int64(), "groups": pa.string(), "steps": pa.binary(), "times": pa.binary(),
                                                   "keys": pa.list_(pa.int64()), "docs": pa.list_(pa.int64())}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, packet = aligner_of(source.value, model.value), TaskContext.get().partitionId() << 32
        for part in slices(batches):
            for ids, some in _packets(part):
                found, which = aligner.align(some)
                doc, pair, times = found.links()
                keys, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
                lines = found.written(aligner.words, aligner.shift)
                rows = [dict.fromkeys(_NUMBERS, 0) | {"packet": packet, "groups": "", "steps": b"", "times": b""} for _ in some]
                stops = np.searchsorted(doc, np.arange(len(which) + 1))
                for n, i in enumerate(which):
                    rows[i].update(zip(_NUMBERS, (int(x[n]) for x in found.numbers)))
                    rows[i]["groups"] = hashlib.sha256(lines[n].encode()).hexdigest() if digest else lines[n]
                    mine = slice(stops[n], stops[n + 1])
                    rows[i]["steps"] = np.diff(at[mine], prepend=0).astype("<u4").tobytes()
                    rows[i]["times"] = times[mine].astype("<u4").tobytes()
                columns = [pa.array([r.get(name) for r in rows], kind_) for name, kind_ in types.items()]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *types])
                asked = {"packet": packet, "keys": keys, "docs": docs}
                yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), *(pa.array([asked.get(name)], kind_) for name, kind_ in types.items())],
                                                 ["doc_id", *types])
                packet += 1

    longs = ", ".join(f"{n} bigint" for n in _NUMBERS)
    made = data.mapInArrow(encode, f"doc_id {kind}, {longs}, packet bigint, groups string, steps binary, times binary, keys array<bigint>, docs array<bigint>")
    made = stored(made, "aligned")
    asked = made.where("keys IS NOT NULL")
    counted = asked.select(F.explode(F.arrays_zip("keys", "docs")).alias("k")).groupBy(F.col("k.keys").alias("key")).agg(F.sum("k.docs").alias("n"))
    # A first id has at most as many pairs as the second vocabulary has ids.
    most = F.max("n").over(Window.partitionBy(F.shiftright("key", 32)))
    counted = stored(counted.select("key", "n", (F.col("n") == most).alias("best")), "linked-pairs")
    answers = asked.select("packet", F.posexplode("keys").alias("at", "key")).join(counted, "key").select("packet", "at", "n", "best")
    documents = made.where("keys IS NULL").select("packet", "doc_id", *_NUMBERS, "groups", "steps", "times")

    def add_counts(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["at"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
        sums = []
        for steps, times in zip(left["steps"].to_pylist(), left["times"].to_pylist()):
            spots, m = np.cumsum(np.frombuffer(steps, "<u4").astype(np.int64)), np.frombuffer(times, "<u4").astype(np.int64)
            sums.append((int(best[spots] @ m), int(n[spots] @ m)))
        columns = list(zip(*sums)) or [(), ()]
        out = left.select(["doc_id", *_NUMBERS])
        for name, column in zip(("n_best", "count_sum"), columns):
            out = out.append_column(name, pa.array(column, pa.int64()))
        return out.append_column("groups", left["groups"])

    answers = answers.withColumnRenamed("packet", "_packet")
    pairs = documents.groupBy("packet").cogroup(answers.groupBy("_packet"))
    return pairs.applyInArrow(add_counts, f"doc_id {kind}, {longs}, n_best bigint, count_sum bigint, groups string")
