"""Near-duplicates by SimHash fingerprints, found through a table of distances to reference fingerprints.

A distance to a reference changes by at most the number of differing bits, so two fingerprints can be linked only if
no coordinate of their rows in the table differs by more than LINK_BITS. The references are a base pattern and the
base with one two-bit block turned over; a coordinate less the base coordinate depends on that block alone. Two fingerprints
that differ in two bits agree in at least two of the four quarters, hence in all sixteen such differences there. Each
choice of two quarters gives a grouping key from the table; within a key, pairs are discarded by their largest coordinate
difference and the rest verified bit by bit.

Keys shared by more than CROWD fingerprints (large groups of near copies) would give too many pairs. Their members
are linked through midpoints: two fingerprints differ in at most two bits exactly if some value is within one bit
of both, and all members around one value may be linked to the smallest of them. So no link is lost, and rows stay in
proportion to the fingerprints.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_digest

from martloom.llm.common import slices, stored, texts
from martloom.llm.components import components

SEED = 42
WORDS = 3
LINK_BITS = 2
CROWD = 100
BASE = 0x5A5A5A5A5A5A5A5A
BLOCK_BITS = 2
QUARTERS = 4
STEP = 1 << 16

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256)[None, :]


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of the text's three-word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        digests = [xxh64_digest(b" ".join(words), SEED)]
    else:
        spaced = [w + b" " for w in words]
        digests = [xxh64_digest(a + b + c, SEED) for a, b, c in zip(spaced, spaced[1:], words[2:])]
    counts = np.zeros(2048, np.int64)
    for start in range(0, len(digests), STEP):
        part = np.frombuffer(b"".join(digests[start:start + STEP]), np.uint8).reshape(-1, 8)
        counts += np.bincount((part + _OFFSETS).ravel(), minlength=2048)
    ones = np.einsum("bv,vk->bk", counts.reshape(8, 256), _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(digests)).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row. Null and empty texts, and texts of white space alone, have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fp"])

    data = texts(df, id_col, text_col)
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> list[int]:
    """The base pattern, then the base with each block turned over."""
    block = (1 << BLOCK_BITS) - 1
    return [BASE] + [BASE ^ (block << at) for at in range(0, 64, BLOCK_BITS)]


def _distance_table(fp: str) -> Column:
    return F.array(*[F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(r)))).cast("tinyint") for r in references()])


def _keys(table: Column) -> Column:
    """One key for each choice of two quarters: the block coordinates of both, relative to the base coordinate."""
    per = 64 // BLOCK_BITS // QUARTERS
    digits = [((table[i + 1] - table[0] + BLOCK_BITS) / 2).cast("bigint") for i in range(64 // BLOCK_BITS)]

    def key(number: int, chosen: tuple[int, ...]) -> Column:
        total = F.lit(number)
        for q in chosen:
            for d in digits[q * per:(q + 1) * per]:
                total = total * (BLOCK_BITS + 1) + d
        return total

    return F.array(*[key(n + 1, c) for n, c in enumerate(combinations(range(QUARTERS), QUARTERS - LINK_BITS))])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at most LINK_BITS apart, enough of them to connect all that are.

    Within crowded keys a fingerprint is linked to the smallest around each common midpoint, elsewhere to each partner.
    """
    table = fps.select("fp").distinct().withColumn("distances", _distance_table("fp"))
    keyed = stored(table.select("fp", "distances", F.explode(_keys(F.col("distances"))).alias("key")), "pivot-table")
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    shared = keyed.join(sizes, "key")
    few = shared.where(F.col("n") <= CROWD)
    a = few.select("key", F.col("fp").alias("a"), F.col("distances").alias("da"))
    b = few.select("key", F.col("fp").alias("b"), F.col("distances").alias("db"))
    spread = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS
    pairs = a.join(b, "key").where("a < b").where(spread <= LINK_BITS).where(near).select("a", "b")
    crowded = shared.where(F.col("n") > CROWD).select("fp").distinct()
    return pairs.unionByName(_midpoint_links(crowded)).distinct()


def _midpoint_links(fps: DataFrame) -> DataFrame:
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(64)])
    around = fps.select(F.col("fp").alias("b"), F.explode(flips).alias("flip")).select(
        "b", F.col("b").bitwiseXOR(F.col("flip")).alias("mid"))
    least = around.groupBy("mid").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a < z").select("mid", "a")
    return around.join(least, "mid").where("a < b").select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, fp, component_id (the smallest doc_id reachable through links).

    Equal fingerprints are one node, so groups of copies of any size cost nothing more. Documents without words share
    fingerprint zero and are linked like any other. An empty table gives no rows; null ids are kept and never the smallest.
    """
    docs = stored(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(firsts, "root").select("fp", "component_id"), "named")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")
