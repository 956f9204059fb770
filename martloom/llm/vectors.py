"""Embedding columns: which rows take part, packed blocks of them, and the best of partial results."""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of rows with an id whose vector is neither null nor empty nor holds a null or non-finite component.

    The dimension is that of most such rows (the smaller, where tied); vectors of another length take no part.
    """
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & whole).select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def packed(rows: DataFrame, keys: list[str], part_of: str, most: int) -> DataFrame:
    """One row per key and part: ids and vectors of about ``most`` rows as arrays; ``part_of`` holds the number of parts."""
    part = F.pmod(F.xxhash64("vec_id"), F.col(part_of)).cast("int")
    return rows.withColumn("part", part).groupBy(*keys, "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))


def matrix(rows: list[dict], dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Ids (rising) and vectors of a packed row."""
    rows = sorted(rows, key=lambda r: r["vec_id"])
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], dtype)


def best(partial: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query with their rank; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all entries that reach their row's k-th largest; -inf never counts."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        return np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)
