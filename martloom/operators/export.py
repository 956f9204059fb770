"""Export writers and the export job ledger."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from martloom import schemas
from martloom.functions.dates import timestamp_literal
from martloom.operators import serving
from martloom.sources.jobs import read_jobs
from martloom.sources.storage import Folder, observed, settle

# Which action produces which format, the row cap of a spreadsheet, job life time.
ACTION_FORMATS = {"xlsx_export": "xlsx", "csv_zip_export": "csv.zip", "parquet_export": "parquet"}
SPREADSHEET_ROWS = 100_000
RETENTION_HOURS = 72
EXPIRES = "expires"


class RowLimitExceeded(ValueError):
    """The result has more rows than the format takes; nothing was written."""


def guard_rows(df: DataFrame, max_rows: int) -> None:
    """Raise when ``df`` has more than ``max_rows`` rows.

    Every task counts its own rows and the counts are summed, so a sort of ``df`` drops out of the plan and no row moves.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    if df.agg(F.count(F.lit(1))).first()[0] > max_rows:
        raise RowLimitExceeded(f"more than {max_rows} rows; use csv.zip or parquet")


def _write_parquet(df: DataFrame, path: str, codec: str | None) -> None:
    df.write.option("compression", codec or "snappy").parquet(path)


def _write_csv(df: DataFrame, path: str, codec: str | None) -> None:
    df.write.option("header", True).option("compression", codec or "gzip").csv(path)


def _write_spreadsheet(df: DataFrame, path: str, codec: str | None) -> None:
    # The row guard has run, so one part holds it all.
    df.coalesce(1).write.option("header", True).option("compression", codec or "none").csv(path)


WRITERS: dict[str, Callable[[DataFrame, str, str | None], None]] = {
    "parquet": _write_parquet,
    "csv.zip": _write_csv,
    "xlsx": _write_spreadsheet,
}


def export(df: DataFrame, path: str, fmt: str, max_rows: int | None = None, codec: str | None = None, seen: Observation | None = None) -> None:
    """Write ``df`` in a format; ``seen`` takes the number of written rows as ``rows``."""
    if fmt not in WRITERS:
        raise ValueError(f"unsupported export format: {fmt}")
    cap = max_rows if max_rows is not None else (SPREADSHEET_ROWS if fmt == "xlsx" else None)
    if cap is not None:
        guard_rows(df, cap)
    WRITERS[fmt](df.observe(seen, F.count(F.lit(1)).alias("rows")) if seen is not None else df, path, codec)


def export_plan(files: DataFrame, dataset: str, action_key: str, fmt: str, filters: dict | None = None) -> DataFrame:
    """The whole detail result in default order; the action must fit the format."""
    if action_key not in ACTION_FORMATS:
        raise ValueError(f"unsupported action: {action_key}")
    if ACTION_FORMATS[action_key] != fmt:
        raise ValueError(f"format {fmt} does not match action {action_key}")
    return serving.detail_sorted(files, serving.DetailRequest(dataset, filters=filters or {}))


def expiry_folder(expires: dt.datetime) -> str:
    """Artifacts and records of one hour of expiry lie together, so whole folders can be removed."""
    return f"{EXPIRES}={expires:%Y-%m-%dT%H}"


def run_export(rows: DataFrame, root: str, job_id: str, dataset: str, action_key: str, as_of: dt.datetime, max_rows: int | None = None) -> DataFrame:
    """Write an export and append its job record; the record as a row.

    Artifacts go to ``{root}/artifacts``, records to ``{root}/jobs``, both in a folder of their hour of expiry. Rows are counted while they
    are written. A failure leaves no artifact and is a record of its own, with its message. ``as_of`` is the time of the record.
    """
    if action_key not in ACTION_FORMATS:
        raise ValueError(f"no export action named {action_key!r}")
    spark, fmt = rows.sparkSession, ACTION_FORMATS[action_key]
    expires = as_of + dt.timedelta(hours=RETENTION_HOURS)
    name, hour = f"{job_id}.{fmt}", expiry_folder(expires)
    folder = Folder(spark, f"{root.rstrip('/')}/artifacts/{hour}")
    seen = Observation()
    try:
        export(rows, folder.child(name), fmt, max_rows, seen=seen)
        outcome = ("completed", folder.child(name), observed(seen), None)
    except Exception as error:  # noqa: BLE001
        folder.remove(name)
        outcome = ("failed", None, None, str(error).strip().splitlines()[0])
    status, path, count, message = outcome
    record = spark.createDataFrame([(job_id, dataset, action_key, status, fmt, as_of, as_of, expires, name, path, count, message)], schemas.EXPORT_JOBS)
    record.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/jobs/{hour}")
    return record


def _remove_hour(spark: SparkSession, root: str, hour: str, gone: Column) -> None:
    """Remove the chosen jobs of one hour of expiry, artifacts and records."""
    artifacts, records = Folder(spark, f"{root}/artifacts/{hour}"), Folder(spark, f"{root}/jobs/{hour}")
    jobs = read_jobs(spark, records.path, one_per_file=False)
    for job in jobs.where(gone).select("file_name").distinct().toLocalIterator():
        artifacts.remove(job["file_name"])
    kept = settle(jobs.where(~F.coalesce(gone, F.lit(False))), "kept-jobs")
    if kept.isEmpty():
        artifacts.remove()
        records.remove()
    else:
        kept.coalesce(1).write.mode("overwrite").json(records.path)


def remove_expired(spark: SparkSession, root: str, as_of: dt.datetime) -> None:
    """Remove all jobs whose time has passed: whole folders of past hours, and of the hour of ``as_of`` the jobs that are due."""
    root, now = root.rstrip("/"), expiry_folder(as_of)
    for side in ("artifacts", "jobs"):
        folder = Folder(spark, f"{root}/{side}")
        for hour, _ in folder.list():
            if hour.startswith(f"{EXPIRES}=") and hour < now:
                folder.remove(hour)
    if Folder(spark, f"{root}/jobs").exists(now):
        _remove_hour(spark, root, now, F.col("expires_at") <= timestamp_literal(as_of))


def remove_completed(spark: SparkSession, root: str) -> None:
    """Remove all completed jobs, artifacts and records, hour by hour."""
    root = root.rstrip("/")
    for hour, is_dir in Folder(spark, f"{root}/jobs").list():
        if is_dir and hour.startswith(f"{EXPIRES}="):
            _remove_hour(spark, root, hour, F.col("status") == "completed")


def list_jobs(jobs: DataFrame, dataset: str | None = None, limit: int = 50) -> DataFrame:
    chosen = jobs.where(F.col("dataset") == dataset) if dataset is not None else jobs
    return chosen.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "completed")])


def expired_jobs(jobs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Jobs past their life time and the artifacts to remove."""
    return jobs.where(F.col("expires_at") <= timestamp_literal(as_of)).select("job_id", "expires_at", "artifact_path")


def completed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "completed").select("job_id", "artifact_path", "row_count")


def with_expiry(jobs: DataFrame, hours: int = RETENTION_HOURS) -> DataFrame:
    return jobs.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(hours)))
