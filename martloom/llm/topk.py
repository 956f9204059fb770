"""Exact top-k by inner product: a Voronoi join of queries and data.

Pivots cut the space into cells. A summary of each cell (size, radius, largest norm) bounds every inner product with its rows:
q.x <= q.p + |q| r, and q.x <= |q| times the largest norm. Each query first meets its own cell, which gives a score that its k-th
result can't be below; then it is sent to just those cells whose bound reaches that score. Cells are cut into parts of bounded size,
queries into packets, and each pair is solved by one matrix product. The queries are the smaller side, so they are what is replicated.

Pivots are vectors with the smallest hashes, about as many as the square root of the rows, PIVOTS at least and MOST_PIVOTS at most; they
only steer the work.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from martloom.llm.common import slices, stored
from martloom.llm.vectors import best, matrix, packed, top_of, valid_vectors

PIVOTS = 128
MOST_PIVOTS = 4096
PART_ROWS = 4096
PACKET = 512
ROW = "rows array<struct<vec_id: bigint, v: array<double>>>"


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): whole numbers floor(scale * x) as doubles; inner products below 2**53 are exact."""
    rows = valid_vectors(df, id_col, vector_col)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their nearest pivot, the distance to it and their norm."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for part in slices(batches, 2048):
            x = np.array(part.column(1).to_pylist(), np.float64)
            squared = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
            cell = squared.argmin(1)
            away = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((x * x).sum(1)))],
                ["vec_id", "v", "cell", "away", "norm"])

    return rows.mapInArrow(run, "vec_id bigint, v array<double>, cell int, away double, norm double")


def _solve(parts: DataFrame, packets: DataFrame, k: int) -> DataFrame:
    """The k best of each part for each query of the packets sent to its cell."""
    pairs = parts.select("cell", "rows").join(packets.select("cell", F.col("rows").alias("queries")), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in slices(batches, 1):
            ids, x = matrix(pair.column(1)[0].as_py())
            query_ids, q = matrix(pair.column(2)[0].as_py())
            scores = q @ x.T
            scores[query_ids[:, None] == ids[None, :]] = -np.inf
            row, column = top_of(scores, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[row]), pa.array(ids[column]), pa.array(scores[row, column].astype(np.int64))], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    return best(found, k)


def _packets(sent: DataFrame) -> DataFrame:
    """Queries sent to a cell, PACKET or so at a time."""
    counts = sent.groupBy("cell").agg(F.ceil(F.count("*") / PACKET).alias("packets"))
    return packed(sent.join(F.broadcast(counts), "cell"), ["cell"], "packets", PACKET)


def top_k(df: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of quantized vectors, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id. Candidates are all rows of another vec_id. Rows that ``valid_vectors`` leaves out take no part;
    fewer than k candidates give fewer rows; an empty table gives none. Equal vectors are results of their own; where an id
    repeats, each of its rows is.
    """
    spark = df.sparkSession
    rows = quantized(df, id_col, vector_col, scale)
    wanted = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows.count())))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).select("v").toArrow().column(0).to_pylist()
    if not chosen:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = np.array(sorted(set(map(tuple, chosen))), np.float64)
    data = stored(_assigned(rows, pivots), "cells")
    cells = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()
    sizes = spark.createDataFrame([(r["cell"], -(-r["n"] // PART_ROWS)) for r in cells], "cell int, parts int")
    parts = stored(packed(data.join(F.broadcast(sizes), "cell"), ["cell"], "parts", PART_ROWS), "parts")
    queries = data.where(is_query(F.col("vec_id")))
    home = stored(_solve(parts, _packets(queries), k), "home")
    floor = home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    sent = spark.sparkContext.broadcast((pivots, [r["cell"] for r in cells], np.array([r["radius"] for r in cells]), np.array([r["norm"] for r in cells])))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, numbers, radius, norm = sent.value
        numbers, long = np.array(numbers), np.sqrt((p * p).sum(1))
        for part in slices(batches, 256):
            q = np.array(part.column(1).to_pylist(), np.float64)
            own, least = part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)
            size = np.sqrt((q * q).sum(1))[:, None]
            bound = np.minimum(q @ p[numbers].T + size * radius, size * norm)
            # What rounding may take from a bound, whatever its sign; equal scores are still asked for.
            slack = size * (long[numbers] + radius) * 1e-9 + 1e-6
            needed = ~(bound + slack < np.nan_to_num(least, nan=-np.inf)[:, None]) & (own[:, None] != numbers[None, :])
            row, cell = np.nonzero(needed)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(numbers[cell].astype(np.int32))], ["vec_id", "v", "cell"])

    asked = queries.select("vec_id", "v", "cell").join(floor, "vec_id", "left").select("vec_id", "v", "cell", F.col("floor").cast("double"))
    others = stored(asked.mapInArrow(replicate, "vec_id bigint, v array<double>, cell int"), "replicated")
    return best(home.drop("rank").unionByName(_solve(parts, _packets(others), k).drop("rank")), k)
