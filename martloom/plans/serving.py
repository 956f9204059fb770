"""KPIs, charts, detail and filter options."""

import datetime as dt

from pyspark.sql import functions as F

from martloom.operators import mart as M
from martloom.operators import serving as S
from martloom.plans.base import MART_DATASETS, MART_FILES, MART_SOURCES, REFRESHED_AT, two_decimals, with_
from martloom.plans.mart import _refreshed as promoted_store
from martloom.sources.tables import mart_files

_WINDOW = (dt.date(1997, 3, 15), dt.date(1999, 10, 2))
_MONTHS = ["1996-03", "1996-7", "2000-12"]


def rows_by_month(spark, sf_dir):
    return S.chart(mart_files(spark, sf_dir), S.ChartRequest("sales", "rows_by_month", "month", 12))


def rows_by_month_filtered(spark, sf_dir):
    request = S.ChartRequest(
        "sales", "rows_by_month", "month", 366, start=_WINDOW[0], end=_WINDOW[1], filters={"source": ["LINEITEM"]}
    )
    return S.chart(mart_files(spark, sf_dir), request)


def files_by_source(spark, sf_dir):
    return S.chart(mart_files(spark, sf_dir), S.ChartRequest("sales", "files_by_source", limit=20))


def kpi_summary(spark, sf_dir):
    return S.kpi_summary(mart_files(spark, sf_dir), S.SummaryRequest("sales"))


def kpi_summary_empty(spark, sf_dir):
    return S.kpi_summary(mart_files(spark, sf_dir), S.SummaryRequest("sales", filters={"source": ["NO_SUCH_SOURCE"]}))


def kpi_cards(spark, sf_dir):
    return S.kpi_cards(kpi_summary(spark, sf_dir))


def filter_window(spark, sf_dir):
    return S.kpi_summary(mart_files(spark, sf_dir), S.SummaryRequest("sales", *_WINDOW))


def filter_source(spark, sf_dir):
    return S.select_files(mart_files(spark, sf_dir), "sales", {"source": ["LINEITEM"], "partition_month": []})


def filter_partition_month(spark, sf_dir):
    return S.select_files(mart_files(spark, sf_dir), "sales", {"partition_month": _MONTHS})


def detail_sorted(spark, sf_dir):
    request = S.DetailRequest("sales", sort=(("row_count", "desc"), ("source_name", "asc")))
    return S.detail_sorted(mart_files(spark, sf_dir), request)


def detail_page(spark, sf_dir):
    return S.detail_page(mart_files(spark, sf_dir), S.DetailRequest("sales", page=3, page_size=50))


def detail_page_user_sort(spark, sf_dir):
    request = S.DetailRequest("sales", page=2, page_size=25, sort=(("row_count", "desc"),))
    return S.detail_page(mart_files(spark, sf_dir), request)


def detail_total(spark, sf_dir):
    return S.detail_total(mart_files(spark, sf_dir), S.DetailRequest("sales"))


def _sources(spark, sf_dir):
    return M.source_rollup(mart_files(spark, sf_dir), "full", REFRESHED_AT)


def filter_sources(spark, sf_dir):
    return S.source_options(_sources(spark, sf_dir), "sales")


def filter_months(spark, sf_dir):
    return S.month_options(mart_files(spark, sf_dir), "sales")


def dashboard(spark, sf_dir):
    """All frames of the overview page in long form: (block, key, value)."""
    files, sources = mart_files(spark, sf_dir), _sources(spark, sf_dir)
    frames = S.dashboard(files, sources, M.dataset_rollup(sources), "sales")
    keyed = {
        "refreshed": ("dataset_name", F.date_format("last_refreshed_at", "yyyy-MM-dd HH:mm:ss")),
        "cards": ("key", F.col("value").cast("decimal(20,2)").cast("string")),
        "source_options": ("value", F.col("value")),
        "month_options": ("value", F.col("value")),
        "detail_preview": ("file_path", F.col("row_count").cast("string")),
        "rows_by_month": ("bucket", F.col("value").cast("string")),
        "files_by_source": ("bucket", F.col("value").cast("string")),
    }
    out = None
    for block, (key, value) in keyed.items():
        part = frames[block].select(F.lit(block).alias("block"), F.col(key).alias("key"), value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


_STORES: dict[tuple[str, str], M.MartStore] = {}


def _served(spark, sf_dir):
    """The promoted mart of an application; its raw tables are loaded and refreshed once, and then only read."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES:
        _STORES[key] = promoted_store(spark, sf_dir)
    return S.ServedMart.of_store(_STORES[key])


def served_summary(spark, sf_dir):
    """KPI numbers that do not depend on how many files a month was written to."""
    return _served(spark, sf_dir).summary(S.SummaryRequest("sales", *_WINDOW, filters={"source": ["ORDERS"]})).select(
        "total_rows", "source_tables", "min_partition_start", "max_partition_start", "covered_months")


def served_rows_by_month(spark, sf_dir):
    return _served(spark, sf_dir).chart(S.ChartRequest("sales", "rows_by_month", "month", 24))


def served_detail(spark, sf_dir):
    """All pages of the detail rows, a month's files taken together, and their total."""
    served, rows, number = _served(spark, sf_dir), None, 1
    total = served.detail(S.DetailRequest("sales"))[1].first()["total"]
    while (number - 1) * 500 < total:
        page, _ = served.detail(S.DetailRequest("sales", page=number, page_size=500))
        rows, number = page if rows is None else rows.unionByName(page), number + 1
    return rows.groupBy("source_name", "partition_month").agg(F.sum("row_count").alias("row_count"), F.max("last_build_id").alias("last_build_id"))


def served_options(spark, sf_dir):
    sources, months = _served(spark, sf_dir).filter_options("sales")
    return sources.select(F.lit("source").alias("filter"), "value").unionByName(months.select(F.lit("partition_month").alias("filter"), "value"))


def served_unknown_dataset(spark, sf_dir):
    """Which calls refuse a dataset that the mart does not hold, beside one that it does."""
    served, out = _served(spark, sf_dir), []
    calls = {
        "summary": lambda d: served.summary(S.SummaryRequest(d)),
        "chart": lambda d: served.chart(S.ChartRequest(d, "files_by_source")),
        "detail": lambda d: served.detail(S.DetailRequest(d)),
        "export_rows": lambda d: served.export_rows(S.DetailRequest(d)),
        "filter_options": served.filter_options,
        "dashboard": served.dashboard,
    }
    for name, call in calls.items():
        for dataset in ("sales", "nowhere"):
            try:
                call(dataset)
                out.append((name, dataset, False))
            except S.UnknownDataset:
                out.append((name, dataset, True))
    return spark.createDataFrame(out, "name string, dataset string, refused boolean")


_SUMMARY = f"""
SELECT *, CASE WHEN total_files > 0 THEN {two_decimals("total_rows / total_files")} ELSE 0.0::DOUBLE END AS avg_rows_per_file,
       CAST(coalesce((year(max_partition_start) - year(min_partition_start)) * 12
            + month(max_partition_start) - month(min_partition_start) + 1, 0) AS BIGINT) AS covered_months
FROM (SELECT CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows, count(*) AS total_files,
             count(DISTINCT source_name) AS source_tables, min(partition_start) AS min_partition_start,
             max(partition_start) AS max_partition_start
      FROM mart_files WHERE dataset_name = 'sales' {{0}})
"""

_MONTHLY = """
SELECT strftime(partition_start, '%Y-%m-01') AS bucket, value FROM (
  SELECT partition_start, CAST(sum(row_count) AS BIGINT) AS value FROM mart_files
  WHERE dataset_name = 'sales' {0} GROUP BY partition_start ORDER BY partition_start DESC LIMIT {1}) ORDER BY bucket
"""

_DETAIL = """SELECT source_name, partition_start AS partition_month, file_path, row_count, last_build_id
FROM mart_files WHERE dataset_name = 'sales'"""

_CARDS = f"""
SELECT unnest(['rows_loaded', 'source_files', 'source_tables', 'avg_rows_per_file', 'covered_months']) AS key,
       unnest([total_rows::DOUBLE, total_files::DOUBLE, source_tables::DOUBLE, avg_rows_per_file, covered_months::DOUBLE]) AS value,
       unnest(['integer', 'integer', 'integer', 'decimal', 'integer']) AS precision
FROM ({_SUMMARY.format("")})"""

_BY_SOURCE = """SELECT source_name AS bucket, count(*) AS value, source_name AS label FROM mart_files
WHERE dataset_name = 'sales' GROUP BY source_name ORDER BY value DESC, source_name LIMIT 20"""

_RAW = """WITH raw AS (
  SELECT 'ORDERS' AS source_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, 'b-more' AS b FROM orders
  UNION ALL SELECT 'ORDERS', CAST(date_trunc('month', o_orderdate) AS DATE), 'b-more' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'EVENTS', CAST(date_trunc('month', ts) AS DATE), 'b-EVENTS' FROM events
)
"""

QUERIES = {
    "served_summary": served_summary,
    "served_rows_by_month": served_rows_by_month,
    "served_detail": served_detail,
    "served_options": served_options,
    "served_unknown_dataset": served_unknown_dataset,
    "rows_by_month": rows_by_month,
    "rows_by_month_filtered": rows_by_month_filtered,
    "files_by_source": files_by_source,
    "kpi_summary": kpi_summary,
    "kpi_summary_empty": kpi_summary_empty,
    "kpi_cards": kpi_cards,
    "filter_window": filter_window,
    "filter_source": filter_source,
    "filter_partition_month": filter_partition_month,
    "detail_sorted": detail_sorted,
    "detail_page": detail_page,
    "detail_page_user_sort": detail_page_user_sort,
    "detail_total": detail_total,
    "filter_sources": filter_sources,
    "filter_months": filter_months,
    "dashboard": dashboard,
}

ORACLE = {
    "served_summary": _RAW + f"""SELECT total_rows, source_tables, a AS min_partition_start, z AS max_partition_start,
        CAST(coalesce((year(z) - year(a)) * 12 + month(z) - month(a) + 1, 0) AS BIGINT) AS covered_months
        FROM (SELECT count(*) AS total_rows, count(DISTINCT source_name) AS source_tables, min(m) AS a, max(m) AS z FROM raw
              WHERE source_name = 'ORDERS' AND m BETWEEN DATE '{_WINDOW[0].replace(day=1)}' AND DATE '{_WINDOW[1].replace(day=1)}')""",
    "served_rows_by_month": _RAW + """SELECT strftime(m, '%Y-%m-01') AS bucket, count(*) AS value FROM raw GROUP BY m ORDER BY m DESC LIMIT 24""",
    "served_detail": _RAW + """SELECT source_name, m AS partition_month, count(*) AS row_count, any_value(b) AS last_build_id FROM raw GROUP BY 1, 2""",
    "served_options": _RAW + """SELECT DISTINCT 'source' AS filter, source_name AS value FROM raw
        UNION ALL SELECT DISTINCT 'partition_month', strftime(m, '%Y-%m') FROM raw""",
    "served_unknown_dataset": """SELECT name, dataset, dataset = 'nowhere' AS refused
        FROM (VALUES ('summary'), ('chart'), ('detail'), ('export_rows'), ('filter_options'), ('dashboard')) c(name), (VALUES ('sales'), ('nowhere')) d(dataset)""",
    "rows_by_month": with_(MART_FILES, _MONTHLY.format("", 12)),
    "rows_by_month_filtered": with_(MART_FILES, _MONTHLY.format(
        "AND source_name = 'LINEITEM' AND partition_start BETWEEN DATE '1997-03-01' AND DATE '1999-10-01'", 366)),
    "files_by_source": with_(MART_FILES, _BY_SOURCE),
    "kpi_summary": with_(MART_FILES, _SUMMARY.format("")),
    "kpi_summary_empty": with_(MART_FILES, _SUMMARY.format("AND source_name = 'NO_SUCH_SOURCE'")),
    "kpi_cards": with_(MART_FILES, _CARDS),
    "filter_window": with_(MART_FILES, _SUMMARY.format(
        "AND partition_start BETWEEN DATE '1997-03-01' AND DATE '1999-10-01'")),
    "filter_source": with_(MART_FILES, "SELECT * FROM mart_files WHERE dataset_name = 'sales' AND source_name IN ('LINEITEM')"),
    "filter_partition_month": with_(MART_FILES, """SELECT * FROM mart_files WHERE dataset_name = 'sales'
        AND partition_start IN (DATE '1996-03-01', DATE '1996-07-01', DATE '2000-12-01')"""),
    "detail_sorted": with_(MART_FILES, _DETAIL + " ORDER BY row_count DESC, source_name, partition_month DESC, file_path"),
    "detail_page": with_(MART_FILES, _DETAIL + " ORDER BY partition_start DESC, source_name, file_path LIMIT 50 OFFSET 100"),
    "detail_page_user_sort": with_(
        MART_FILES, _DETAIL + " ORDER BY row_count DESC, partition_start DESC, source_name, file_path LIMIT 25 OFFSET 25"),
    "detail_total": with_(MART_FILES, f"SELECT count(*) AS total FROM ({_DETAIL})"),
    "filter_sources": with_(
        MART_SOURCES, "SELECT DISTINCT source_name AS value FROM mart_sources WHERE dataset_name = 'sales' ORDER BY 1"),
    "filter_months": with_(MART_FILES, """SELECT DISTINCT strftime(partition_start, '%Y-%m') AS value FROM mart_files
        WHERE dataset_name = 'sales' ORDER BY 1 DESC"""),
    "dashboard": with_(MART_DATASETS, f"""
        SELECT 'refreshed' AS block, dataset_name AS key, strftime(last_refreshed_at, '%Y-%m-%d %H:%M:%S') AS value
        FROM mart_datasets WHERE dataset_name = 'sales'
        UNION ALL SELECT 'cards', key, CAST(CAST(value AS DECIMAL(20,2)) AS VARCHAR) FROM ({_CARDS})
        UNION ALL SELECT DISTINCT 'source_options', source_name, source_name FROM mart_sources WHERE dataset_name = 'sales'
        UNION ALL SELECT DISTINCT 'month_options', strftime(partition_start, '%Y-%m'), strftime(partition_start, '%Y-%m')
        FROM mart_files WHERE dataset_name = 'sales'
        UNION ALL SELECT 'detail_preview', file_path, CAST(row_count AS VARCHAR)
        FROM ({_DETAIL} ORDER BY partition_start DESC, source_name, file_path LIMIT 20)
        UNION ALL SELECT 'rows_by_month', bucket, CAST(value AS VARCHAR) FROM ({_MONTHLY.format("", 12)})
        UNION ALL SELECT 'files_by_source', bucket, CAST(value AS VARCHAR) FROM ({_BY_SOURCE})"""),
}
