"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Lengths fall into reciprocal classes: class j holds the lengths of which exactly j fit into a sequence,
capacity // (j + 1) < length <= capacity // j, and its bins take j pieces each. As documents may be cut, a tail
that would fill its slot of capacity // j badly first gives a piece of exactly capacity // (j + 1). So every
bin is nearly full whatever the lengths, and a bin needs no look at other bins or classes.

Every task fills its own bins and passes on the bins that are still open at its end (fewer than j pieces for a class
and task). These are numbered through all tasks and fill common bins; what then is open, one bin for a class, is put
together on the driver, at most one row for each of the capacity's classes.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from martloom.llm.bpe import LibraryCodec, codec_of, vocabulary
from martloom.llm.common import slices, stored, texts

TASK_SHIFT = 1 << 32
POOL_BASE = 1 << 61


def cut_lengths(tokens: int, capacity: int, slack: int = 32) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then pieces that fill at least 1 - 1/slack of their slots."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        count = capacity // rest
        slot = capacity // count
        piece = rest if (slot - rest) * slack <= slot else capacity // (count + 1)
        out.append(piece)
        rest -= piece
    return out


def first_fit(fills: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """Class -> (bin, offset) for the open bins of the classes, largest first."""
    ends: list[int] = []
    places = {}
    for key, fill in sorted(fills.items(), key=lambda x: (-x[1], x[0])):
        at = next((i for i, end in enumerate(ends) if end + fill <= capacity), len(ends))
        if at == len(ends):
            ends.append(0)
        places[key] = (at, ends[at])
        ends[at] += fill
    return places


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    Null and empty texts give a piece that holds the end id alone; repeated rows are packed each; an empty table
    gives no rows. Pieces of one sequence follow each other without gaps from offset 0.
    """
    data = texts(df, id_col, text_col)
    kind = data.schema["doc_id"].dataType.simpleString()
    source = vocabulary(df, tokenizer_path)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "class", "task"]
    kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value, LibraryCodec)
        task = TaskContext.get().partitionId()
        open_bins: dict[int, list] = {}
        filled, id_type = 0, None

        def batch(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_type) for c, k in zip(columns, kinds)], names)

        for part in slices(batches):
            rows, id_type = [], part.schema.field(0).type
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = codec.encode(text) + end
                tokens, start = len(ids) // 4, 0
                for length in cut_lengths(tokens, capacity):
                    count = capacity // length
                    pieces = open_bins.setdefault(count, [])
                    pieces.append((doc, start, length, ids[4 * start:4 * (start + length)], tokens))
                    start += length
                    if len(pieces) == count:
                        offset = 0
                        for piece in open_bins.pop(count):
                            rows.append((*piece, task * TASK_SHIFT + filled, offset, count, task))
                            offset += piece[2]
                        filled += 1
            if rows:
                yield batch(rows)
        for count, pieces in open_bins.items():
            yield batch([(*piece, None, n, count, task) for n, piece in enumerate(pieces)])

    schema = (f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
              "offset bigint, class int, task bigint")
    pieces = stored(data.mapInArrow(run, schema), "pieces")
    done = pieces.where(F.col("sequence_id").isNotNull()).drop("class", "task")
    return done.unionByName(_pool(pieces.where(F.col("sequence_id").isNull()), capacity))


def _pool(left: DataFrame, capacity: int) -> DataFrame:
    """Bins from what the tasks left open; ``offset`` holds a piece's number in its task and class."""
    spark = left.sparkSession
    counts = left.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    numbered = left.join(counts.select("class", "task", F.coalesce(before, F.lit(0)).alias("before")), ["class", "task"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("offset")).withColumn("bin", F.floor(F.col("number") / F.col("class")))
    binned = stored(numbered.select("doc_id", "start", "length", "ids", "doc_tokens", "class", "number", "bin"), "open-pieces")
    per_class = {r["class"]: r["n"] for r in binned.groupBy("class").agg(F.count("*").alias("n")).collect()}
    base, next_id = {}, POOL_BASE
    for count, n in sorted(per_class.items()):
        base[count] = next_id
        next_id += n // count
    whole = {count: n // count for count, n in per_class.items()}
    sizes = spark.createDataFrame([(c, whole[c], base[c]) for c in base], "class int, whole bigint, base bigint")
    joined = binned.join(F.broadcast(sizes), "class")
    is_open = F.col("bin") == F.col("whole")
    fills = {r["class"]: r["fill"] for r in joined.where(is_open).groupBy("class").agg(F.sum("length").alias("fill")).collect()}
    places = first_fit(fills, capacity)
    shifts = spark.createDataFrame([(c, next_id + b, o) for c, (b, o) in places.items()], "class int, place bigint, shift bigint")
    in_bin = Window.partitionBy("class", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.join(F.broadcast(shifts), "class", "left").withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    return placed.select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        F.when(is_open, F.col("place")).otherwise(F.col("base") + F.col("bin")).alias("sequence_id"),
        F.when(is_open, F.col("offset") + F.col("shift")).otherwise(F.col("offset")).alias("offset"),
    )
