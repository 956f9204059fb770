"""Mart metadata: file, source and dataset rows, validation, versioned promotion."""

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from martloom import schemas
from martloom.functions import text as X
from martloom.functions.dates import timestamp_literal
from martloom.sources import partitions as P
from martloom.sources.storage import Folder, observed

SOURCE_KEYS = ["dataset_name", "source_name"]
PART_TABLES = ("files", "sources")
TABLES = {"files": schemas.MART_FILES, "sources": schemas.MART_SOURCES, "datasets": schemas.MART_DATASETS}
# What a file's count was taken from is stored with it.
STORED_FILES = T.StructType([*schemas.MART_FILES, T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType())])
_PROMOTED = "_promoted"
# dataset -> source -> the part that holds its rows
Parts = dict[str, dict[str, str]]


def file_rows(spark: SparkSession, source_root: str, dataset: str, build_id: str, known: DataFrame | None = None) -> DataFrame:
    """Metadata rows of all months of a source, whatever part of it was just loaded; files in ``known`` aren't counted again."""
    stats = P.file_stats(spark, source_root, known).withColumns(
        {
            "dataset_name": F.lit(dataset),
            "source_name": F.lit(source_root.rstrip("/").rsplit("/", 1)[-1]),
            "last_build_id": F.lit(build_id),
        }
    )
    return schemas.conform(stats, STORED_FILES)


def source_rollup(files: DataFrame, refresh_mode: str, refreshed_at: dt.datetime, root: str | None = None) -> DataFrame:
    """One row per source of its file rows."""
    rolled = files.groupBy(*SOURCE_KEYS).agg(
        F.sum("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("file_count"),
        F.min("partition_start").alias("min_partition_start"),
        F.max("partition_start").alias("max_partition_start"),
        F.max("last_build_id").alias("last_build_id"),
    )
    return schemas.conform(
        rolled.withColumns(
            {
                "raw_table_name": X.raw_table_name(F.col("dataset_name"), F.col("source_name")),
                "source_root": F.lit(root) if root else F.col("source_name"),
                "refresh_mode": F.lit(refresh_mode),
                "last_refreshed_at": timestamp_literal(refreshed_at),
            }
        ),
        schemas.MART_SOURCES,
    )


def dataset_rollup(sources: DataFrame) -> DataFrame:
    return schemas.conform(
        sources.groupBy("dataset_name").agg(
            F.countDistinct("source_name").alias("source_count"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum("file_count"), F.lit(0)).alias("total_files"),
            F.min("min_partition_start").alias("min_partition_start"),
            F.max("max_partition_start").alias("max_partition_start"),
            F.max("last_refreshed_at").alias("last_refreshed_at"),
        ),
        schemas.MART_DATASETS,
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = SOURCE_KEYS) -> DataFrame:
    """Replace all rows of the keys found in ``new``; rows of other keys stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


# --- validation ------------------------------------------------------------------------

def _flag(check: str, wrong, expected, actual):
    return F.when(
        wrong,
        F.struct(
            F.lit("error").alias("severity"),
            F.lit(check).alias("check"),
            F.concat(
                F.lit(f"{check}: expected "),
                F.coalesce(expected.cast("string"), F.lit("null")),
                F.lit(", got "),
                F.coalesce(actual.cast("string"), F.lit("null")),
            ).alias("message"),
        ),
    )


def _compared(expected: DataFrame, actual: DataFrame, keys: list[str], pairs: list, missing_check: str | None = None) -> DataFrame:
    """Left-join expectation and fact, report per source.

    ``pairs`` are (check, expected column, actual column, wrong(e, a)). Without a
    ``missing_check`` an absent fact counts as 0.
    """
    facts = actual.withColumn("_present", F.lit(True))
    present = F.col("_present").isNotNull()
    flags = []
    if missing_check:
        flags.append(_flag(missing_check, ~present, F.lit("a row"), F.lit("none")))
    for check, want, got, wrong in pairs:
        e, a = F.col(want), F.col(got) if missing_check else F.coalesce(got, F.lit(0))
        flags.append(_flag(check, (present & wrong(e, a)) if missing_check else wrong(e, a), e, a))
    issues = F.explode(F.filter(F.array(*flags), lambda i: i.isNotNull()))
    return expected.join(facts, keys, "left").select(*SOURCE_KEYS, issues.alias("_i")).select(*SOURCE_KEYS, "_i.*")


def _differs(want, got):
    return ~want.eqNullSafe(got)


def validate_sources(expected: DataFrame, sources: DataFrame) -> DataFrame:
    """``expected`` holds row_count, file_count and build_id per source."""
    wanted = expected.select(*SOURCE_KEYS, F.col("row_count").alias("_rows"), F.col("file_count").alias("_files"),
                             F.col("build_id").alias("_build"))
    facts = sources.select(*SOURCE_KEYS, "row_count", "file_count", "last_build_id")
    return _compared(wanted, facts, SOURCE_KEYS, [
        ("source_row_count", "_rows", "row_count", _differs),
        ("source_file_count", "_files", "file_count", _differs),
        ("source_build_id", "_build", "last_build_id", _differs),
    ], "source_missing")


def validate_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """No file rows at all counts as sum 0 and count 0."""
    wanted = expected.select(*SOURCE_KEYS, F.col("row_count").alias("_rows"), F.col("file_count").alias("_files"))
    sums = files.groupBy(*SOURCE_KEYS).agg(F.sum("row_count").alias("_sum"), F.count(F.lit(1)).alias("_count"))
    return _compared(wanted, sums, SOURCE_KEYS, [
        ("file_row_count", "_rows", "_sum", _differs),
        ("file_count", "_files", "_count", _differs),
    ])


def validate_datasets(expected: DataFrame, datasets: DataFrame) -> DataFrame:
    """A dataset's totals may not be below any of its sources'."""
    wanted = expected.select(*SOURCE_KEYS, F.col("row_count").alias("_rows"), F.col("file_count").alias("_files"))
    facts = datasets.select("dataset_name", "total_rows", "total_files")
    return _compared(wanted, facts, ["dataset_name"], [
        ("dataset_total_rows", "_rows", "total_rows", lambda w, g: g < w),
        ("dataset_total_files", "_files", "total_files", lambda w, g: g < w),
    ], "dataset_missing")


def is_valid(issues: DataFrame) -> bool:
    """Warnings do not count."""
    return issues.where(F.col("severity") == "error").coalesce(1).isEmpty()


# --- versions --------------------------------------------------------------------------

@dataclass(frozen=True)
class RefreshResult:
    version: str | None
    promoted: bool
    issues: DataFrame | None


class PromotionConflict(RuntimeError):
    """Another version was promoted since this one was begun."""


class MartStore:
    """Versioned metadata. Each build of a source is a part of its own (its file rows and its source row) that never changes.

    A version names the part of every source, so a refresh writes the rows of its own source and nothing else. Dataset rows are
    rolled up from the source rows when they are read. Numbered promotion files name the versions; the highest number is what readers use.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.folder = Folder(spark, root)

    def promotions(self) -> int:
        """How often a version was promoted."""
        return max((int(name) for name, is_dir in self.folder.list(_PROMOTED) if not is_dir and name.isdigit()), default=0)

    def version_at(self, promotion: int) -> str | None:
        return self.folder.read_text(f"{_PROMOTED}/{promotion:012d}").strip() if promotion else None

    def current_version(self) -> str | None:
        return self.version_at(self.promotions())

    def parts(self, version: str | None) -> Parts:
        text = self.folder.read_text(f"versions/{version}.json") if version else None
        return json.loads(text) if text else {}

    def read(self, name: str, version: str | None = None, dataset: str | None = None) -> DataFrame:
        """A metadata table of the current (or a named) version, of all datasets or one; empty before the first promotion."""
        return self.table_of(name, version or self.current_version(), dataset)

    def table_of(self, name: str, version: str | None, dataset: str | None = None) -> DataFrame:
        parts = self.parts(version)
        chosen = [p for d, sources in parts.items() if dataset in (None, d) for p in sources.values()]
        return self.rows_of(name, chosen)

    def rows_of(self, name: str, parts: list[str]) -> DataFrame:
        if name == "datasets":
            # One row for each source, so one task is enough.
            return dataset_rollup(self.rows_of("sources", parts).coalesce(1))
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[self.folder.child(f"parts/{p}/{name}") for p in parts])

    def counted_files(self, part: str) -> DataFrame:
        """The file rows of a part with what their counts were taken from."""
        return self.spark.read.schema(STORED_FILES).parquet(self.folder.child(f"parts/{part}/files"))

    def write_part(self, part: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.folder.child(f"parts/{part}/{name}"))

    def write_version(self, version: str, parts: Parts) -> None:
        self.folder.make("versions")
        self.folder.write_text(f"versions/{version}.json", json.dumps(parts, sort_keys=True))

    def absent(self, version: str, dataset: str | None = None) -> list[str]:
        """Tables that the version's parts lack."""
        parts = [p for d, sources in self.parts(version).items() if dataset in (None, d) for p in sources.values()]
        found = [n for n in PART_TABLES if not parts or not all(self.folder.exists(f"parts/{p}/{n}/_SUCCESS") for p in parts)]
        return found

    def promote(self, version: str, after: int | None = None) -> None:
        """Readers move to ``version`` at once; ``after`` is the promotion it was built on.

        Raises ``PromotionConflict`` when another version came in between, so nothing it holds is lost.
        """
        absent = self.absent(version)
        if absent:
            raise FileNotFoundError(f"version {version} lacks {', '.join(absent)}")
        number = (self.promotions() if after is None else after) + 1
        if not self.folder.write_new(f"{_PROMOTED}/{number:012d}", version):
            raise PromotionConflict(version)

    def versions(self) -> list[str]:
        return [name[:-5] for name, is_dir in self.folder.list("versions") if not is_dir and name.endswith(".json")]


def literal_row(spark: SparkSession, **values: tuple[object, str]) -> DataFrame:
    """One row of (value, type) pairs that the planner knows as a literal, so joins with it need no job."""
    columns = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, (_, t) in values.items())
    names = ", ".join(values)
    marks = ", ".join(f":{n}" for n in values)
    return spark.sql(f"SELECT {columns} FROM VALUES ({marks}) AS t({names})", {n: v for n, (v, _) in values.items()})


def table_issues(store: MartStore, version: str, dataset: str | None = None) -> DataFrame:
    """Required metadata tables that a version lacks."""
    absent = F.array(*[F.lit(n) for n in store.absent(version, dataset)]).cast("array<string>")
    return store.spark.range(1).select(F.explode(absent).alias("name")).select(
        F.lit("error").alias("severity"),
        F.lit("metadata_table").alias("check"),
        F.concat(F.lit("metadata table is missing: "), "name").alias("message"),
    )


def raw_issues(spark: SparkSession, source_root: str, expected_rows: int, actual_rows: int | None = None) -> DataFrame:
    """The raw table must be readable and hold the expected rows, those without a date included.

    ``actual_rows`` spares the count where the caller has just read the footers.
    """
    exists = actual_rows is not None or P.has_files(spark, source_root)
    actual = actual_rows if actual_rows is not None else P.scan(spark, source_root).count() if exists else None
    return spark.range(1).select(
        F.lit("error").alias("severity"),
        F.lit("raw_row_count" if exists else "raw_table").alias("check"),
        F.lit(f"expected {expected_rows}, got {actual}" if exists else f"raw table is missing: {source_root}").alias("message"),
    ).where(F.lit(actual != expected_rows))


def validate_mart(store: MartStore, version: str, expected: DataFrame, source_root: str, expected_rows: int,
                  actual_rows: int | None = None, dataset: str | None = None, part: str | None = None) -> DataFrame:
    """All checks of a version; missing tables or a wrong raw table end the checks early.

    With ``dataset`` only its parts are read, with ``part`` only the file rows of that part.
    """
    columns = ["severity", "check", "message"]
    first = table_issues(store, version, dataset) if store.absent(version, dataset) else None
    if actual_rows is None or actual_rows != expected_rows:
        raw = raw_issues(store.spark, source_root, expected_rows, actual_rows)
        first = raw if first is None else first.unionByName(raw)
    if first is not None and not is_valid(first):
        return first
    # The rows of one part lie in one small file.
    files = store.rows_of("files", [part]).coalesce(1) if part else store.table_of("files", version, dataset)
    return (
        validate_sources(expected, store.table_of("sources", version, dataset)).select(*columns)
        .unionByName(validate_files(expected, files).select(*columns))
        .unionByName(validate_datasets(expected, store.table_of("datasets", version, dataset)).select(*columns))
    )


def refresh_mart(store: MartStore, dataset: str, source_root: str, build_id: str, kind: str = "full",
                 refreshed_at: dt.datetime | None = None, only_if: tuple[int, int] | None = None) -> RefreshResult:
    """Rebuild one source's metadata from its files, validate the new version, promote it.

    Only the part of this source is written; the others are carried over by name from the version that was current at the
    start. Where another refresh is promoted meanwhile, the version is named again on top of it. A ``full`` refresh counts all
    files; any other takes over the counts of files that have not changed. With ``only_if`` (year, month) the refresh is
    skipped when that partition has no file. Without ``refreshed_at`` the time is taken from the session's clock in UTC.
    """
    spark = store.spark
    if not dataset.strip() or not build_id.strip():
        raise ValueError("dataset and build_id must not be blank")
    if only_if and not P.month_has_files(spark, source_root, *only_if):
        return RefreshResult(None, False, None)
    if not P.has_files(spark, source_root):
        raise ValueError(f"no source files under {source_root}")
    after = store.promotions()
    parts = store.parts(store.version_at(after))
    name = source_root.rstrip("/").rsplit("/", 1)[-1]
    old = parts.get(dataset, {}).get(name)
    known = store.counted_files(old) if old and kind != "full" else None
    part, seen = uuid.uuid4().hex, Observation()
    counted = F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("file_count")
    # Few rows of a few columns: one file is enough.
    store.write_part(part, "files", file_rows(spark, source_root, dataset, build_id, known).observe(seen, *counted).coalesce(1))
    found = {n: observed(seen, n) for n in ("row_count", "file_count")}
    at = refreshed_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    mode = "full" if kind == "full" else "incremental"
    store.write_part(part, "sources", source_rollup(store.rows_of("files", [part]).coalesce(1), mode, at, source_root))
    expected = literal_row(spark, dataset_name=(dataset, "STRING"), source_name=(name, "STRING"), row_count=(found["row_count"], "BIGINT"),
                           file_count=(found["file_count"], "BIGINT"), build_id=(build_id, "STRING"))
    while True:
        version = f"{dataset}-{build_id}-{uuid.uuid4().hex[:8]}"
        store.write_version(version, parts | {dataset: parts.get(dataset, {}) | {name: part}})
        issues = validate_mart(store, version, expected, source_root, found["row_count"], found["row_count"], dataset, part)
        if not is_valid(issues):
            return RefreshResult(version, False, issues)
        try:
            store.promote(version, after)
        except PromotionConflict:
            store.folder.remove(f"versions/{version}.json")
            after = store.promotions()
            parts = store.parts(store.version_at(after))
            continue
        return RefreshResult(version, True, issues)
