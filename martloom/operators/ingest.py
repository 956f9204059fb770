"""Interval-driven ingest: extract, write aside, verify, publish.

Nothing published changes before the row counts agree. Each load is written once, to a folder of its own, and
becomes visible when the table's next manifest names it; a failed or repeated run leaves the published partitions as they were,
and loads that run at the same time keep each other's partitions.
"""

import datetime as dt
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from martloom import schemas
from martloom.functions.dates import month_start, next_month, timestamp_literal
from martloom.operators import intervals as I
from martloom.sources import manifest as M, partitions as P
from martloom.sources.storage import Folder, observed

EXECUTION_MONTH = "execution_month"
# Fixed value: what a plain column name may be.
_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_$#]*$")
_QUOTED = re.compile(r"'(?:[^']|'')*'")
_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
_BIND = re.compile(r"(?<!:):([A-Za-z_]\w*)")


class VerificationFailed(RuntimeError):
    """Row counts disagree; nothing was published."""


@dataclass(frozen=True)
class IngestSpec:
    """What to extract and how to store it.

    ``partition_by`` is ``execution_month`` (all rows go to the month of the execution
    date) or a date or timestamp column (each row goes to its own month).
    """

    name: str
    table: str
    strategy: str = "full"
    schedule: str = ""
    source_where_template: str | None = None
    source_bind_params: dict = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    incremental_key: str | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    partition_by: str = EXECUTION_MONTH
    codec: str = "snappy"
    max_records_per_file: int = 0
    allow_empty: bool = False

    def __post_init__(self):
        template = (self.source_where_template or "").strip()
        if self.strategy not in PUBLISHERS:
            raise ValueError(f"unsupported strategy: {self.strategy}")
        if self.source_bind_params and not template:
            raise ValueError("source_bind_params needs source_where_template")
        if self.strategy == "full" and not template:
            raise ValueError("the full strategy needs source_where_template")
        if self.strategy == "incremental" and not self.incremental_key:
            raise ValueError("the incremental strategy needs incremental_key")


@dataclass(frozen=True)
class IngestResult:
    table_root: str
    rows: int
    partitions: tuple[str, ...]


def interval_predicate(column: str) -> str:
    """Predicate text for a plain date column."""
    if not _IDENTIFIER.fullmatch(column.strip()):
        raise ValueError(f"not a column name: {column}")
    c = column.strip()
    return f"{c} >= :data_interval_start AND {c} < :data_interval_end"


def bind_names(template: str) -> set[str]:
    return set(_BIND.findall(_QUOTED.sub("''", template)))


def _as_argument(value) -> object:
    return timestamp_literal(value) if isinstance(value, dt.datetime) else value


def extract(source: DataFrame, spec: IngestSpec, execution_date: dt.date) -> DataFrame:
    """Column choice, predicate template and interval filter as one Spark SQL select."""
    predicates = []
    template = (spec.source_where_template or "").strip()
    if template:
        predicates.append(f"({template})")
    if spec.strategy == "incremental":
        key = spec.incremental_key
        predicates.append(f"{key} >= :data_interval_start AND {key} < :data_interval_end")
    where = " AND ".join(predicates)
    names = bind_names(where)
    params: dict = {}
    if any(n.startswith(I.INTERVAL_BIND_KEYS) for n in names - set(spec.source_bind_params)):
        params.update(I.interval_bind_params(*I.resolve_data_interval(source.sparkSession, execution_date, spec.schedule)))
    params.update(spec.source_bind_params)
    missing = sorted(names - set(params))
    if missing:
        raise ValueError(f"no value for bind variables: {', '.join(missing)}")
    columns = ", ".join(spec.columns) if spec.columns else "*"
    escaped = where.replace("{", "{{").replace("}", "}}")
    return source.sparkSession.sql(
        f"SELECT {columns} FROM {{source}} WHERE {escaped}",
        args={n: _as_argument(params[n]) for n in names},
        source=source,
    )


def with_partition(df: DataFrame, month: Column) -> DataFrame:
    clash = set(P.PARTITION_COLUMNS) & set(df.columns)
    if clash:
        raise ValueError(f"source columns clash with partition columns: {sorted(clash)}")
    return df.withColumns(
        {"year": F.lpad(F.year(month).cast("string"), 4, "0"), "month": F.lpad(F.month(month).cast("string"), 2, "0")}
    )


def write_partitions(df: DataFrame, path: str, spread: bool, codec: str = "snappy", max_records: int = 0,
                     mode: str = "errorifexists") -> None:
    """Partitioned Parquet write.

    ``spread`` is for rows of many months: they are gathered per month first, so a month is
    not cut into one file per task; a month too big for one task is split at run time.
    """
    out = df.hint("rebalance", *[F.col(c) for c in P.PARTITION_COLUMNS]) if spread else df
    writer = out.write.mode(mode).option("compression", codec).partitionBy(*P.PARTITION_COLUMNS)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)


def _stored_count(spark: SparkSession, df: DataFrame, path: str) -> int:
    return spark.read.schema(df.schema).parquet(path).count()


def _partition_dirs(folder: Folder, inside: str) -> list[str]:
    found = []
    for year, is_dir in folder.list(inside):
        if is_dir and year.startswith("year="):
            found += [f"{year}/{month}" for month, sub in folder.list(f"{inside}/{year}") if sub and month.startswith("month=")]
    return found


def replaced(parts: M.Parts, touched: list[str], run_id: str, load: str, filled: list[str]) -> M.Parts:
    """A full load: its partitions hold it alone, those without rows hold nothing."""
    return {p: v for p, v in parts.items() if p not in touched} | {p: [[run_id, load]] for p in filled}


def appended(parts: M.Parts, touched: list[str], run_id: str, load: str, filled: list[str]) -> M.Parts:
    """An incremental load beside the others; what a run of this id had added before goes."""
    kept = {p: [x for x in v if x[0] != run_id] for p, v in parts.items()}
    return {p: v for p, v in kept.items() if v} | {p: [*kept.get(p, []), [run_id, load]] for p in filled}


PUBLISHERS: dict[str, Callable] = {"full": replaced, "incremental": appended}


def _publish_rows(rows: DataFrame, extracted: Observation, spec: IngestSpec, base_path: str, run_id: str, spread: bool,
                  requested: list[str]) -> IngestResult:
    """Write a load and name it in the table's manifest.

    ``extracted`` counts the source rows while they are written, so the source is read once. ``requested`` are
    partitions that a full load answers for even where it has no rows.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id must be letters, digits, '_', '.', '-' and start with a letter or digit: {run_id}")
    spark = rows.sparkSession
    folder = Folder(spark, f"{base_path.rstrip('/')}/{spec.table}")
    load = f"{run_id}-{uuid.uuid4().hex[:12]}"
    place = f"{M.LOAD}={load}"
    undated = Observation()
    try:
        dated = rows.observe(undated, F.count_if(F.col("year").isNull() | F.col("month").isNull()).alias("rows"))
        write_partitions(dated, folder.child(place), spread, spec.codec, spec.max_records_per_file)
        stored, wanted = _stored_count(spark, rows, folder.child(place)), observed(extracted)
        if stored != wanted:
            raise VerificationFailed(f"{spec.table}: source has {wanted} rows, written {stored}")
        if missing := observed(undated):
            raise VerificationFailed(f"{spec.table}: {missing} rows have no date to choose a partition by")
        filled = _partition_dirs(folder, place)
        touched = list(dict.fromkeys([*filled, *requested])) if spec.strategy == "full" else filled
        if spec.strategy == "full" and len(filled) < max(1, len(touched)) and not spec.allow_empty:
            empty = ", ".join(p for p in touched if p not in filled) or "all"
            raise VerificationFailed(f"{spec.table}: nothing extracted for {empty} and allow_empty is off")
        M.commit(folder, lambda parts: PUBLISHERS[spec.strategy](parts, touched, run_id, load, filled))
        return IngestResult(folder.path, stored, tuple(sorted(touched)))
    except BaseException:
        folder.remove(place)
        raise


def _counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def run_ingest(source: DataFrame, spec: IngestSpec, execution_date: dt.date, base_path: str, run_id: str) -> IngestResult:
    """One run. Full replaces the partitions it has rows for, incremental adds to them."""
    extracted, seen = _counted(extract(source, spec, execution_date))
    rows = spec.transform(extracted) if spec.transform else extracted
    own = spec.partition_by == EXECUTION_MONTH
    month = F.lit(execution_date.replace(day=1)) if own else month_start(F.col(spec.partition_by))
    requested = [P.partition_path(execution_date.year, execution_date.month)] if own else []
    return _publish_rows(with_partition(rows, month), seen, spec, base_path, run_id, spread=not own, requested=requested)


def run_recorded(source: DataFrame, spec: IngestSpec, execution_date: dt.date, base_path: str, run_id: str, ledger_root: str,
                 clock: Callable[[], dt.datetime], trigger: str = "manual") -> IngestResult:
    """``run_ingest`` with its state rows appended to ``{ledger_root}/runs`` and ``/steps``: running, then success or failed.

    Each row carries ``recorded_at``; ``ledger.latest_state`` gives what holds now. A failure is recorded and raised again.
    """
    spark, started = source.sparkSession, clock()

    def record(status: str, at: dt.datetime, rows: int | None, message: str | None) -> None:
        ended = None if status == "running" else at
        run = (run_id, spec.name, execution_date, status, started, ended, trigger, started)
        step = (f"{run_id}/load", run_id, "load", status, started, ended, rows, message, 0, started)
        for name, schema, row in (("runs", schemas.RUNS, run), ("steps", schemas.STEPS, step)):
            frame = spark.createDataFrame([row], schema).withColumn("recorded_at", timestamp_literal(at))
            frame.coalesce(1).write.mode("append").parquet(f"{ledger_root.rstrip('/')}/{name}")

    record("running", started, None, None)
    try:
        result = run_ingest(source, spec, execution_date, base_path, run_id)
    except Exception as error:
        record("failed", clock(), None, str(error).strip().splitlines()[0])
        raise
    record("success", clock(), result.rows, None)
    return result


def _by_columns(template: str, own_values: dict) -> str:
    """The template with interval binds as columns of the row's month; a caller's own value of a name comes first."""
    def name(match: re.Match) -> str:
        known = match[1].startswith(I.INTERVAL_BIND_KEYS) and match[1] not in own_values
        return f"`_bind_{match[1]}`" if known else match[0]

    parts = re.split(f"({_QUOTED.pattern})", template)
    return "".join(p if i % 2 else _BIND.sub(name, p) for i, p in enumerate(parts))


def backfill_rows(source: DataFrame, spec: IngestSpec, start: dt.date, end: dt.date, key: str,
                  window: str = "calendar_month") -> DataFrame:
    """Rows of a month range with their partition, as one frame for all months.

    ``calendar_month`` takes each month's own rows. ``schedule`` gives each month the rows of the schedule's data
    interval on the month's first day, as separate runs would. The predicate template holds for each row with the binds of
    its month's interval.
    """
    I.check_range(start, end)
    spark = source.sparkSession
    if window == "calendar_month":
        last = end.replace(day=1)
        after = (last + dt.timedelta(days=32)).replace(day=1)
        at_midnight = [dt.datetime.combine(d, dt.time()) for d in (start.replace(day=1), after)]
        own = month_start(F.col(key))
        rows = I.interval_filter(source, key, *at_midnight).withColumns({
            "_month": own, "_bind_data_interval_start": own.cast("timestamp_ntz"),
            "_bind_data_interval_end": next_month(F.col(key)).cast("timestamp_ntz")})
    elif window == "schedule":
        months = I.months_between(spark, start, end).withColumn("schedule", F.lit(spec.schedule))
        intervals = I.with_data_interval(months)
        failed = intervals.where(F.col("interval_error").isNotNull()).select("execution_date", "interval_error").first()
        if failed:
            raise ValueError(f"{failed['interval_error']}: execution_date={failed['execution_date']}")
        dated = intervals.select(F.col("execution_date").alias("_month"), "data_interval_start", "data_interval_end")
        rows = I.assign_intervals(source, dated, key).withColumnsRenamed({
            "data_interval_start": "_bind_data_interval_start", "data_interval_end": "_bind_data_interval_end"})
    else:
        raise ValueError(f"unsupported window: {window}")
    where = _by_columns((spec.source_where_template or "").strip() or "true", spec.source_bind_params)
    names = bind_names(where)
    missing = sorted(names - set(spec.source_bind_params))
    if missing:
        raise ValueError(f"no value for bind variables: {', '.join(missing)}")
    instants = {k: F.col(f"_bind_{'data_interval_end' if k == 'data_interval_end' else 'data_interval_start'}") for k in I.INTERVAL_BIND_KEYS}
    binds = {f"_bind_{k}": c for k, c in instants.items()}
    binds |= {f"_bind_{k}_{part}": getattr(F, part)(c).cast("int") for k, c in instants.items() for part in I.PARTS}
    used = {k: c for k, c in binds.items() if f"`{k}`" in where and k not in rows.columns}
    escaped = where.replace("{", "{{").replace("}", "}}")
    chosen = spark.sql(f"SELECT * FROM {{rows}} WHERE {escaped}", args={n: _as_argument(spec.source_bind_params[n]) for n in names},
                       rows=rows.withColumns(used) if used else rows)
    return chosen.select(*(spec.columns or source.columns), "_month")


def run_backfill(source: DataFrame, spec: IngestSpec, start: dt.date, end: dt.date, key: str, base_path: str, run_id: str,
                 window: str = "calendar_month") -> IngestResult:
    """All months in one job instead of one run after another. A full backfill answers for every month of the range."""
    extracted, seen = _counted(backfill_rows(source, spec, start, end, key, window))
    if spec.transform:
        kept = spec.transform(extracted)
        if "_month" not in kept.columns:
            raise ValueError("a transform of a backfill has to keep the column _month")
        extracted = kept
    rows = with_partition(extracted, F.col("_month")).drop("_month")
    requested, month = [], start.replace(day=1)
    while month <= end:
        requested.append(P.partition_path(month.year, month.month))
        month = (month + dt.timedelta(days=32)).replace(day=1)
    return _publish_rows(rows, seen, spec, base_path, run_id, spread=True, requested=requested)


def _side_counts(**frames: DataFrame) -> DataFrame:
    """One row holding the row count of each named frame, from one union and one aggregate."""
    sides = [df.select(F.lit(name).alias("_side")) for name, df in frames.items()]
    stacked = sides[0]
    for side in sides[1:]:
        stacked = stacked.unionByName(side)
    return stacked.agg(*[F.count_if(F.col("_side") == name).alias(name) for name in frames])


def count_issues(source_rows: DataFrame, stored_rows: DataFrame) -> DataFrame:
    """Full check as a frame: source count against stored count, one row when they differ."""
    return _issues(_side_counts(expected=source_rows, actual=stored_rows), "row_count")


def growth_issues(extracted: DataFrame, loaded: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Incremental check: loaded equals extracted and the stored rows grew by exactly that."""
    counts = _side_counts(extracted=extracted, loaded=loaded, before=before, after=after)
    checks = F.array(
        F.struct(F.lit("loaded_rows").alias("check"), F.col("extracted").alias("expected"), F.col("loaded").alias("actual")),
        F.struct(
            F.lit("partition_growth").alias("check"),
            (F.col("before") + F.col("loaded")).alias("expected"),
            F.col("after").alias("actual"),
        ),
    )
    return _issues(counts.select(F.inline(checks)))


def _issues(counts: DataFrame, check: str | None = None) -> DataFrame:
    named = counts.withColumn("check", F.lit(check)) if check else counts
    return named.where(~F.col("expected").eqNullSafe(F.col("actual"))).select(
        F.lit("error").alias("severity"), "check", "expected", "actual"
    )
