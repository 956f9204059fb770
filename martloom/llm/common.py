"""What the operators of this subpackage share: reading tables, Arrow batches, stored intermediates."""

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martloom.sources.storage import Folder, settle

SLICE_ROWS = 512
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of long texts small: both sides of a worker's pipe hold whole batches outside the Java heap."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in an Arrow batch of what runs meanwhile, for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, so other columns can neither clash nor be read; a null text is empty."""
    return small_batches(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and go on from the files; cuts lineage and survives lost executors."""
    return settle(df, label)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored frame that nothing will read again."""
    files = df.inputFiles()
    if files:
        Folder(df.sparkSession, files[0].rsplit("/", 1)[0]).remove()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so Python objects of one piece only are alive; a worker's free memory goes back at the end."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    del batches
    release()


def release() -> None:
    """Give this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of other systems may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(column: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by the keys without a fixed number of partitions."""
    return df.repartition(*[F.col(k) for k in keys])
