"""Raw datasets: ``{base}/{TABLE}/year=YYYY/month=MM/*.parquet``."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.functions.dates import partition_date
from martloom.sources import manifest as M
from martloom.sources.storage import Folder

PARTITION_COLUMNS = ("year", "month")
_LAYOUT = r"/year=(\d+|__HIVE_DEFAULT_PARTITION__)/month=(\d+|__HIVE_DEFAULT_PARTITION__)/[^/]+\.parquet$"


def partition_path(year: int, month: int) -> str:
    return f"year={year:04d}/month={month:02d}"


def scan(spark: SparkSession, root: str, merge_schema: bool = False) -> DataFrame:
    """The whole raw table; year and month become integer columns."""
    reader = spark.read.option("mergeSchema", merge_schema)
    parts = M.current(spark, root)
    if parts is None:
        return reader.parquet(root)
    based = reader.option("basePath", root)
    found = M.paths(root, parts)
    if found:
        return based.parquet(*found).drop(M.LOAD)
    return based.parquet(root).drop(M.LOAD).limit(0)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Every partition file as (file_path, year, month, length, modified) from the directory listing alone.

    Files of rows without a date have null year and month.
    """
    parts = M.current(spark, root)
    found = [root] if parts is None else M.paths(root, parts)
    if not found or not Folder(spark, root).exists():
        return spark.createDataFrame([], "file_path string, year int, month int, length bigint, modified timestamp")
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(found)
        .select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))
    )
    number = lambda group: F.regexp_extract("file_path", _LAYOUT, group).try_cast("int")
    return listed.where(F.col("file_path").rlike(_LAYOUT)).select(
        "file_path", number(1).alias("year"), number(2).alias("month"), "length", "modified")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).select("file_path", "year", "month")


def has_files(spark: SparkSession, root: str) -> bool:
    """Whether any partition holds a file, by looking at directories until one is found."""
    parts = M.current(spark, root)
    if parts is not None:
        return any(parts.values())
    folder = Folder(spark, root)
    for year, _ in folder.list():
        for month, _ in folder.list(year) if year.startswith("year=") else ():
            inside = folder.list(f"{year}/{month}") if month.startswith("month=") else ()
            if any(name.endswith(".parquet") for name, is_dir in inside if not is_dir):
                return True
    return False


def month_paths(spark: SparkSession, root: str, year: int, month: int) -> list[str]:
    """Directories that hold a month's files."""
    part = partition_path(year, month)
    parts = M.current(spark, root)
    if parts is not None:
        return M.paths(root, {part: parts.get(part, [])})
    inside = Folder(spark, root).list(part)
    return [f"{root.rstrip('/')}/{part}"] if any(name.endswith(".parquet") for name, is_dir in inside if not is_dir) else []


def month_has_files(spark: SparkSession, root: str, year: int, month: int) -> bool:
    return bool(month_paths(spark, root, year, month))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, root).select("file_path").orderBy("file_path")


def partition_files(spark: SparkSession, root: str, year: int, month: int) -> DataFrame:
    found = month_paths(spark, root, year, month)
    if not found:
        return spark.createDataFrame([], "file_path string")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(found)
        .select(F.col("path").alias("file_path"))
        .orderBy("file_path")
    )


def file_stats(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Rows per partition file: (file_path, partition_start, row_count, length, modified).

    Counting reads footers only; files without rows count 0. The files come from the listing and the counts from the scan,
    because a file that holds no rows does not show up in a count. Files that ``known`` has with the same path, length and
    time keep the count it gives; the scan then opens no file older than the oldest new one.
    """
    if not has_files(spark, root):
        return spark.createDataFrame([], "file_path string, partition_start date, row_count bigint, length bigint, modified timestamp")
    files, data = listing(spark, root), scan(spark, root)
    if known is None:
        files = files.withColumn("_known", F.lit(None).cast("bigint"))
    else:
        same = ["file_path", "length", "modified"]
        files = files.join(known.select(*same, F.col("row_count").alias("_known")), same, "left")
        oldest = files.where("_known IS NULL").select("modified").orderBy("modified").first()
        if oldest is not None:
            data = data.where(F.col("_metadata.file_modification_time") >= F.lit(oldest[0]))
    # The scan reports its paths percent-encoded.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    if known is None or oldest is not None:
        counted = data.groupBy(path.alias("_path")).agg(F.count(F.lit(1)).alias("_rows"))
        same_form = F.regexp_replace(F.col("file_path"), "^([a-z0-9]+):/+", "$1:/")
        counted_form = F.regexp_replace(F.col("_path"), "^([a-z0-9]+):/+", "$1:/")
        files = files.join(counted, same_form == counted_form, "left")
    else:
        files = files.withColumn("_rows", F.lit(0))
    return files.select("file_path", partition_date(F.col("year"), F.col("month")).alias("partition_start"),
                        F.coalesce("_known", "_rows", F.lit(0)).alias("row_count"), "length", "modified")


def partition_row_counts(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root).groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("row_count"))


def partition_row_count(spark: SparkSession, root: str, year: int, month: int) -> int:
    """Rows of one month; 0 when the month has no file. Only that month's footers are read."""
    found = month_paths(spark, root, year, month)
    return spark.read.parquet(*found).count() if found else 0
