"""Raw scans, file statistics, roll-ups, upserts and validation."""

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from martloom.functions.dates import month_start
from martloom.operators import ingest as I
from martloom.operators import mart as M
from martloom.operators.refresh import load_and_refresh
from martloom.plans.base import MART_DATASETS, MART_FILES, MART_SOURCES, REFRESHED_AT, with_
from martloom.sources import partitions as P
from martloom.sources.storage import settle, shared_folder
from martloom.sources.tables import mart_files, table


def stored_orders(spark, sf_dir, label):
    """The orders table as a month-partitioned raw dataset in a new folder."""
    root = f"{shared_folder(spark, label)}/ORDERS"
    orders = table(spark, sf_dir, "orders")
    I.write_partitions(I.with_partition(orders, month_start(F.col("o_orderdate"))), root, spread=True)
    return root


def mart_raw_scan(spark, sf_dir):
    return P.scan(spark, stored_orders(spark, sf_dir, "raw-scan")).select(
        "o_orderkey", "o_custkey", "o_totalprice", "year", "month"
    )


def mart_file_stats(spark, sf_dir):
    stats = P.file_stats(spark, stored_orders(spark, sf_dir, "file-stats"))
    return stats.groupBy("partition_start").agg(F.sum("row_count").alias("row_count"))


def partition_row_count(spark, sf_dir):
    return P.partition_row_counts(spark, stored_orders(spark, sf_dir, "row-count"))


def source_files_listing(spark, sf_dir):
    """Partitions the directory listing finds files in."""
    return P.list_files(spark, stored_orders(spark, sf_dir, "listing")).select("year", "month").distinct()


def partition_files(spark, sf_dir):
    """Months of one year that have files; three of them lie outside the data."""
    root = stored_orders(spark, sf_dir, "month-files")
    out = None
    for year, month in ((1994, 12), (1995, 1), (1996, 7), (2001, 8), (2001, 9), (2030, 1)):
        found = P.partition_files(spark, root, year, month).agg((F.count(F.lit(1)) > 0).alias("has_files"))
        part = found.select(F.lit(year).alias("year"), F.lit(month).alias("month"), "has_files")
        out = part if out is None else out.unionByName(part)
    return out


def mart_sources(spark, sf_dir):
    return M.source_rollup(mart_files(spark, sf_dir), "full", REFRESHED_AT)


def mart_datasets(spark, sf_dir):
    return M.dataset_rollup(mart_sources(spark, sf_dir))


def _rebuilt_lineitem(files):
    """A later build of one source: every file of it, half of them grown."""
    rows = F.col("row_count") + F.when(F.month("partition_start") > 6, 100).otherwise(0)
    return files.where(F.col("source_name") == "LINEITEM").withColumns(
        {"row_count": rows, "last_build_id": F.lit("build-009")}
    )


def mart_upsert_files(spark, sf_dir):
    files = mart_files(spark, sf_dir)
    return M.upsert(files, _rebuilt_lineitem(files))


def mart_keep_other_sources(spark, sf_dir):
    """What is left of the other sources after one source was rebuilt."""
    files = mart_files(spark, sf_dir)
    kept = M.upsert(files, _rebuilt_lineitem(files)).where(F.col("source_name") != "LINEITEM")
    return M.source_rollup(kept, "full", REFRESHED_AT)


def _expected(spark, sf_dir):
    """What a build of the files should have recorded, off for some sources."""
    line, events = F.col("source_name") == "LINEITEM", F.col("source_name") == "EVENTS"
    return mart_sources(spark, sf_dir).select(
        "dataset_name",
        "source_name",
        (F.col("row_count") + F.when(line, 7).otherwise(0)).alias("row_count"),
        (F.col("file_count") + F.when(events, 2).otherwise(0)).alias("file_count"),
        F.when(line, "build-777").otherwise(F.col("last_build_id")).alias("build_id"),
    )


def validate_sources(spark, sf_dir):
    recorded = mart_sources(spark, sf_dir).where(F.col("source_name") != "ORDERS")
    return M.validate_sources(_expected(spark, sf_dir), recorded)


def validate_files(spark, sf_dir):
    return M.validate_files(_expected(spark, sf_dir), mart_files(spark, sf_dir))


def validate_datasets(spark, sf_dir):
    totals = mart_datasets(spark, sf_dir).withColumn("total_files", F.lit(100).cast("long"))
    return M.validate_datasets(_expected(spark, sf_dir), totals)


def _refreshed(spark, sf_dir):
    """A mart with two sources of one dataset, one of them refreshed again after it grew."""
    base = shared_folder(spark, "mart")
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    store = M.MartStore(spark, f"{base}/mart")
    for name, df, key in (("ORDERS", orders, "o_orderdate"), ("EVENTS", events, "ts")):
        I.write_partitions(I.with_partition(df, month_start(F.col(key))), f"{base}/raw/{name}", spread=True)
        M.refresh_mart(store, "sales", f"{base}/raw/{name}", f"b-{name}", refreshed_at=REFRESHED_AT)
    more = I.with_partition(orders.where(F.col("o_orderstatus") == "F"), month_start(F.col("o_orderdate")))
    I.write_partitions(more, f"{base}/raw/ORDERS", spread=True, mode="append")
    M.refresh_mart(store, "sales", f"{base}/raw/ORDERS", "b-more", "incremental", REFRESHED_AT)
    return store


def mart_refresh(spark, sf_dir):
    return _refreshed(spark, sf_dir).read("sources").select(
        "dataset_name", "source_name", "raw_table_name", "row_count", "min_partition_start", "max_partition_start",
        "last_build_id", "refresh_mode", "last_refreshed_at",
    )


def mart_promote(spark, sf_dir):
    """Dataset totals readers see: of the version promoted last, and of the one before."""
    store = _refreshed(spark, sf_dir)
    before = next(v for v in store.versions() if "-b-EVENTS-" in v)
    totals = {"current": store.read("datasets"), "previous": store.read("datasets", before)}
    out = None
    for label, df in totals.items():
        part = df.select(F.lit(label).alias("version"), "dataset_name", "source_count", "total_rows")
        out = part if out is None else out.unionByName(part)
    return out


def validate_mart(spark, sf_dir):
    """What is found in a sound version and in others: wrong counts and builds, absent raw rows, absent tables."""
    store = _refreshed(spark, sf_dir)
    version = store.current_version()
    recorded = store.read("sources").where(F.col("source_name") == "EVENTS").withColumnRenamed("last_build_id", "build_id")
    root, rows = (recorded.select("source_root", "row_count").first())
    more, other = recorded.withColumn("file_count", F.col("file_count") + 5), recorded.withColumn("build_id", F.lit("b-other"))
    reports = {
        "sound": M.validate_mart(store, version, recorded, root, rows),
        "files": M.validate_mart(store, version, more.withColumn("row_count", F.col("row_count") + 1), root, rows),
        "build": M.validate_mart(store, version, other, root, rows),
        "rows": M.validate_mart(store, version, recorded, root, rows + 3),
        "raw": M.validate_mart(store, version, recorded, root + "_ABSENT", rows),
    }
    reports = {case: settle(found, "report") for case, found in reports.items()}
    store.folder.remove(f"parts/{store.parts(version)['sales']['EVENTS']}/sources")
    reports["tables"] = M.validate_mart(store, version, recorded, root, rows)
    out = None
    for case, found in reports.items():
        # Messages name files and folders of this run, so those of counts alone are shown.
        part = found.select(F.lit(case).alias("case"), "severity", "check", F.when(F.col("check") == "raw_row_count", F.col("message")).alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def load_refresh(spark, sf_dir):
    """Loads with the refresh of their mart: two that go through, a skipped one and one whose mart fails."""
    base, orders = shared_folder(spark, "load-refresh"), table(spark, sf_dir, "orders")
    store = M.MartStore(spark, f"{base}/mart")
    spec = I.IngestSpec("orders", "ORDERS", source_where_template="o_orderstatus = :status", source_bind_params={"status": "F"}, allow_empty=True)
    none = replace(spec, table="NOTHING", source_bind_params={"status": "?"})
    grown = replace(spec, partition_by="o_orderdate", source_bind_params={"status": "O"})
    out = []
    for run, one, day, dataset in (("first", spec, dt.date(2000, 1, 1), "sales"), ("skipped", none, dt.date(2000, 2, 1), "sales"),
                                   ("grown", grown, dt.date(2000, 3, 1), "sales"), ("failing", spec, dt.date(2000, 1, 1), " ")):
        done = load_and_refresh(orders, one, day, f"{base}/raw", run, store, dataset, refreshed_at=REFRESHED_AT)
        total = store.read("datasets").agg(F.sum("total_rows")).first()[0]
        out.append((run, done.load.rows, bool(done.refresh and done.refresh.promoted), done.error, total))
    return spark.createDataFrame(out, "run string, loaded_rows bigint, promoted boolean, error string, mart_rows bigint")


_REBUILT = MART_FILES + """,
upserted AS (
  SELECT * FROM mart_files WHERE source_name <> 'LINEITEM'
  UNION ALL
  SELECT dataset_name, source_name, partition_start, file_path,
         row_count + CASE WHEN month(partition_start) > 6 THEN 100 ELSE 0 END, 'build-009'
  FROM mart_files WHERE source_name = 'LINEITEM'
)"""

_EXPECTED = MART_DATASETS + """,
expected AS (
  SELECT dataset_name, source_name, row_count + CASE WHEN source_name = 'LINEITEM' THEN 7 ELSE 0 END AS row_count,
         file_count + CASE WHEN source_name = 'EVENTS' THEN 2 ELSE 0 END AS file_count,
         CASE WHEN source_name = 'LINEITEM' THEN 'build-777' ELSE last_build_id END AS build_id
  FROM mart_sources
)"""


def _issue(check, want, got, where, joined):
    return f"""SELECT e.dataset_name, e.source_name, 'error' AS severity, '{check}' AS check,
      '{check}: expected ' || {want} || ', got ' || {got} AS message FROM expected e {joined} WHERE {where}"""


_ON_SOURCE = "JOIN mart_sources a USING (dataset_name, source_name)"
_ON_FILES = """LEFT JOIN (SELECT dataset_name, source_name, CAST(sum(row_count) AS BIGINT) AS s, count(*) AS c
  FROM mart_files GROUP BY 1, 2) a USING (dataset_name, source_name)"""
_ON_DATASET = "JOIN mart_datasets a USING (dataset_name)"

QUERIES = {
    "mart_raw_scan": mart_raw_scan,
    "mart_file_stats": mart_file_stats,
    "partition_row_count": partition_row_count,
    "mart_sources": mart_sources,
    "mart_datasets": mart_datasets,
    "mart_upsert_files": mart_upsert_files,
    "mart_keep_other_sources": mart_keep_other_sources,
    "validate_sources": validate_sources,
    "validate_files": validate_files,
    "validate_datasets": validate_datasets,
    "source_files_listing": source_files_listing,
    "partition_files": partition_files,
    "mart_refresh": mart_refresh,
    "mart_promote": mart_promote,
    "validate_mart": validate_mart,
    "load_refresh": load_refresh,
}

ORACLE = {
    "validate_mart": """SELECT 'files' AS "case", 'error' AS severity, c AS "check", NULL AS message
        FROM (VALUES ('source_row_count'), ('source_file_count'), ('file_row_count'), ('file_count')) v(c)
        UNION ALL SELECT 'build', 'error', 'source_build_id', NULL
        UNION ALL SELECT 'rows', 'error', 'raw_row_count', 'expected ' || (count(*) + 3) || ', got ' || count(*) FROM events
        UNION ALL SELECT 'raw', 'error', 'raw_table', NULL
        UNION ALL SELECT 'tables', 'error', 'metadata_table', NULL""",
    "load_refresh": """WITH n AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
          count(*) FILTER (WHERE o_orderstatus = 'O' AND date_trunc('month', o_orderdate) = DATE '2000-01-01') AS same FROM orders)
        SELECT 'first' AS run, f AS loaded_rows, true AS promoted, NULL AS error, f AS mart_rows FROM n
        UNION ALL SELECT 'skipped', 0, false, NULL, f FROM n
        UNION ALL SELECT 'grown', o, true, NULL, o + CASE WHEN same > 0 THEN 0 ELSE f END FROM n
        UNION ALL SELECT 'failing', f, false, 'dataset and build_id must not be blank', o + CASE WHEN same > 0 THEN 0 ELSE f END FROM n""",
    "mart_raw_scan": """SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST(month(o_orderdate) AS INTEGER) AS month FROM orders""",
    "mart_file_stats": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS partition_start, count(*) AS row_count
        FROM orders GROUP BY 1""",
    "partition_row_count": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
        count(*) AS row_count FROM orders GROUP BY 1, 2""",
    "mart_sources": with_(MART_SOURCES, "SELECT * FROM mart_sources"),
    "mart_datasets": with_(MART_DATASETS, "SELECT * FROM mart_datasets"),
    "mart_upsert_files": with_(_REBUILT, "SELECT * FROM upserted"),
    "mart_keep_other_sources": with_(MART_SOURCES, "SELECT * FROM mart_sources WHERE source_name <> 'LINEITEM'"),
    "validate_sources": with_(_EXPECTED, f"""
        {_issue("source_missing", "'a row'", "'none'", "e.source_name = 'ORDERS'", "")}
        UNION ALL {_issue("source_row_count", "e.row_count", "a.row_count",
                          "e.source_name <> 'ORDERS' AND e.row_count <> a.row_count", _ON_SOURCE)}
        UNION ALL {_issue("source_file_count", "e.file_count", "a.file_count",
                          "e.source_name <> 'ORDERS' AND e.file_count <> a.file_count", _ON_SOURCE)}
        UNION ALL {_issue("source_build_id", "e.build_id", "a.last_build_id",
                          "e.source_name <> 'ORDERS' AND e.build_id <> a.last_build_id", _ON_SOURCE)}"""),
    "validate_files": with_(_EXPECTED, f"""
        {_issue("file_row_count", "e.row_count", "a.s", "e.row_count <> a.s", _ON_FILES)}
        UNION ALL {_issue("file_count", "e.file_count", "a.c", "e.file_count <> a.c", _ON_FILES)}"""),
    "validate_datasets": with_(_EXPECTED, f"""
        {_issue("dataset_total_rows", "e.row_count", "a.total_rows", "a.total_rows < e.row_count", _ON_DATASET)}
        UNION ALL {_issue("dataset_total_files", "e.file_count", "100", "100 < e.file_count", _ON_DATASET)}"""),
    "source_files_listing": """SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
        FROM orders""",
    "partition_files": """SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, EXISTS (SELECT 1 FROM orders
            WHERE year(o_orderdate) = y AND month(o_orderdate) = m) AS has_files
        FROM (VALUES (1994, 12), (1995, 1), (1996, 7), (2001, 8), (2001, 9), (2030, 1)) v(y, m)""",
    "mart_refresh": """SELECT 'sales' AS dataset_name, s AS source_name, 'raw__sales__' || lower(s) AS raw_table_name, n AS row_count,
        CAST(date_trunc('month', a) AS DATE) AS min_partition_start, CAST(date_trunc('month', b) AS DATE) AS max_partition_start,
        bid AS last_build_id, mode AS refresh_mode, TIMESTAMP '2026-04-06 09:00:00' AS last_refreshed_at
        FROM (SELECT 'ORDERS' AS s, count(*) + count(*) FILTER (WHERE o_orderstatus = 'F') AS n, min(o_orderdate) AS a,
                     max(o_orderdate) AS b, 'b-more' AS bid, 'incremental' AS mode FROM orders
              UNION ALL SELECT 'EVENTS', count(*), min(ts), max(ts), 'b-EVENTS', 'full' FROM events)""",
    "mart_promote": """SELECT 'previous' AS version, 'sales' AS dataset_name, 2 AS source_count,
        (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS total_rows
        UNION ALL SELECT 'current', 'sales', 2, (SELECT count(*) FROM orders) + (SELECT count(*) FROM events)
        + (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')""",
}
