"""Exports read back and the export job ledger."""

import datetime as dt

from pyspark.sql import functions as F

from martloom.operators import export as E
from martloom.plans.base import AS_OF, MART_FILES, with_
from martloom.sources.jobs import read_jobs
from martloom.sources.storage import Folder, settle, shared_folder
from martloom.sources.tables import export_jobs as jobs
from martloom.sources.tables import mart_files

_DETAIL_SCHEMA = "source_name string, partition_month date, file_path string, row_count bigint, last_build_id string"


def export_parquet(spark, sf_dir):
    path = shared_folder(spark, "export")
    E.export(E.export_plan(mart_files(spark, sf_dir), "sales", "parquet_export", "parquet"), path, "parquet", codec="zstd")
    return spark.read.parquet(path)


def export_csv(spark, sf_dir):
    path = shared_folder(spark, "export")
    plan = E.export_plan(mart_files(spark, sf_dir), "sales", "csv_zip_export", "csv.zip", {"source": ["LINEITEM"]})
    E.export(plan, path, "csv.zip")
    return spark.read.schema(_DETAIL_SCHEMA).option("header", True).csv(path)


def export_spreadsheet(spark, sf_dir):
    """The row-capped format: checked first, then written as one file."""
    path = shared_folder(spark, "export")
    E.export(E.export_plan(mart_files(spark, sf_dir), "web", "xlsx_export", "xlsx"), path, "xlsx")
    return spark.read.schema(_DETAIL_SCHEMA).option("header", True).csv(path)


def export_jobs(spark, sf_dir):
    """Job records written as JSON and read with the record schema."""
    folder = shared_folder(spark, "jobs")
    jobs(spark, sf_dir).write.json(folder)
    return read_jobs(spark, folder, one_per_file=False)


def export_job_list(spark, sf_dir):
    return E.list_jobs(jobs(spark, sf_dir), "sales", 50)


def export_job_counts(spark, sf_dir):
    return E.job_counts(jobs(spark, sf_dir))


def expired_exports(spark, sf_dir):
    return E.expired_jobs(jobs(spark, sf_dir), AS_OF)


def completed_exports(spark, sf_dir):
    return E.completed_jobs(jobs(spark, sf_dir))


def export_run(spark, sf_dir):
    """An export of each kind of outcome, by its job record: a sound one and one over its row limit."""
    root, files = shared_folder(spark, "export-run"), mart_files(spark, sf_dir)
    plan = E.export_plan(files, "sales", "parquet_export", "parquet")
    E.run_export(plan, root, "job-1", "sales", "parquet_export", AS_OF)
    E.run_export(E.export_plan(files, "sales", "xlsx_export", "xlsx"), root, "job-2", "sales", "xlsx_export", AS_OF, max_rows=1)
    records = read_jobs(spark, f"{root}/jobs", one_per_file=False)
    return records.select("job_id", "action_key", "status", "format", "created_at", "expires_at", "file_name", "row_count",
                          F.col("artifact_path").isNotNull().alias("has_artifact"), F.col("error_message").isNotNull().alias("has_message"))


def exports_left(spark, sf_dir):
    """Jobs with an artifact, after the expired ones and then the completed ones were removed."""
    root, files, out = shared_folder(spark, "exports-left"), mart_files(spark, sf_dir), None
    plan, keep = E.export_plan(files, "web", "parquet_export", "parquet"), dt.timedelta(hours=E.RETENTION_HOURS)
    for name, age in (("old", keep + dt.timedelta(days=3)), ("due", keep + dt.timedelta(minutes=1)), ("soon", keep - dt.timedelta(minutes=1)), ("new", dt.timedelta())):
        E.run_export(plan, root, name, "web", "parquet_export", AS_OF - age)
    E.run_export(plan, root, "broken", "web", "xlsx_export", AS_OF, max_rows=1)
    for after, remove in (("nothing", lambda: None), ("expired", lambda: E.remove_expired(spark, root, AS_OF)), ("completed", lambda: E.remove_completed(spark, root))):
        remove()
        stored = settle(read_jobs(spark, f"{root}/jobs", one_per_file=False), "jobs-left")
        held = [j["job_id"] for j in stored.where("artifact_path IS NOT NULL").collect() if Folder(spark, j["artifact_path"]).exists()]
        part = stored.select(F.lit(after).alias("removed"), "job_id", "status", "row_count", F.col("job_id").isin(held).alias("has_artifact"))
        out = part if out is None else out.unionByName(part)
    return out


def export_row_guard(spark, sf_dir):
    """Which limits around the size of a result let it pass."""
    rows = E.export_plan(mart_files(spark, sf_dir), "sales", "xlsx_export", "xlsx")
    size, out = rows.count(), []
    for limit in (size - 1, size, size + 1):
        try:
            E.guard_rows(rows, limit)
            out.append((limit, True))
        except E.RowLimitExceeded:
            out.append((limit, False))
    return spark.createDataFrame(out, "max_rows bigint, passes boolean")


QUERIES = {
    f.__name__: f
    for f in (
        export_parquet, export_csv, export_spreadsheet, export_jobs, export_job_list, export_job_counts, expired_exports, completed_exports, export_run,
        export_row_guard, exports_left,
    )
}

_JOBS = """
jobs AS (
  SELECT 'job-' || o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'sales' ELSE 'web' END AS dataset,
         CASE o_orderkey % 3 WHEN 0 THEN 'xlsx_export' WHEN 1 THEN 'csv_zip_export' ELSE 'parquet_export' END AS action_key,
         CASE WHEN o_orderkey % 10 = 0 THEN 'queued' WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
         CASE o_orderkey % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'csv.zip' ELSE 'parquet' END AS format,
         o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 86400 AS INTEGER) AS created_at, o_custkey FROM orders
),
records AS (
  SELECT job_id, dataset, action_key, status, format, created_at, created_at AS updated_at, created_at + INTERVAL 72 HOUR AS expires_at,
         job_id || '.' || format AS file_name, 'artifacts/' || job_id || '.' || format AS artifact_path,
         CASE WHEN status = 'completed' THEN o_custkey END AS row_count, CASE WHEN status = 'failed' THEN 'export failed' END AS error_message
  FROM jobs
)"""

_DETAIL = "SELECT source_name, partition_start AS partition_month, file_path, row_count, last_build_id FROM mart_files WHERE dataset_name = "

ORACLE = {
    "export_parquet": with_(MART_FILES, _DETAIL + "'sales'"),
    "export_csv": with_(MART_FILES, _DETAIL + "'sales' AND source_name = 'LINEITEM'"),
    "export_spreadsheet": with_(MART_FILES, _DETAIL + "'web'"),
    "export_jobs": with_(_JOBS, "SELECT * FROM records"),
    "export_job_list": with_(_JOBS, "SELECT * FROM records WHERE dataset = 'sales' ORDER BY created_at DESC, job_id DESC LIMIT 50"),
    "export_job_counts": with_(_JOBS, """SELECT count(*) FILTER (WHERE status = 'queued') AS queued,
        count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'completed') AS completed FROM records"""),
    "expired_exports": with_(_JOBS, f"SELECT job_id, expires_at, artifact_path FROM records WHERE expires_at <= TIMESTAMP '{AS_OF}'"),
    "completed_exports": with_(_JOBS, "SELECT job_id, artifact_path, row_count FROM records WHERE status = 'completed'"),
    "export_run": with_(MART_FILES, f"""SELECT 'job-1' AS job_id, 'parquet_export' AS action_key, 'completed' AS status, 'parquet' AS format,
        TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' + INTERVAL 72 HOUR AS expires_at, 'job-1.parquet' AS file_name,
        (SELECT count(*) FROM mart_files WHERE dataset_name = 'sales') AS row_count, true AS has_artifact, false AS has_message
        UNION ALL SELECT 'job-2', 'xlsx_export', 'failed', 'xlsx', TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' + INTERVAL 72 HOUR, 'job-2.xlsx', NULL, false, true"""),
    "exports_left": with_(MART_FILES, """SELECT removed, job_id, CASE job_id WHEN 'broken' THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN job_id <> 'broken' THEN (SELECT count(*) FROM mart_files WHERE dataset_name = 'web') END AS row_count, job_id <> 'broken' AS has_artifact
        FROM (VALUES ('nothing', 'old'), ('nothing', 'due'), ('nothing', 'soon'), ('nothing', 'new'), ('nothing', 'broken'),
                     ('expired', 'soon'), ('expired', 'new'), ('expired', 'broken'), ('completed', 'broken')) v(removed, job_id)"""),
    "export_row_guard": with_(MART_FILES, """SELECT n + d AS max_rows, d >= 0 AS passes
        FROM (SELECT count(*) AS n FROM mart_files WHERE dataset_name = 'sales'), (VALUES (-1), (0), (1)) v(d)"""),
}
