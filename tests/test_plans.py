"""Physical plans: what must hold for the queries to carry over to large tables."""

import contextlib
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from martloom.functions.dates import month_start
from martloom.operators import ingest as I
from martloom.operators import ledger as L
from martloom.plans import QUERIES
from martloom.sources import partitions as P


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}
# Both sides of its join hold nothing but literal keys, one row of them on the right.
LITERAL_KEYS = {"mart_upsert_files"}
# These run their jobs first and return a plain read of what was stored.
READ_BACK = {
    "mart_raw_scan", "partition_row_count", "source_files_listing", "partition_files", "mart_refresh", "mart_promote",
    "ingest_full", "ingest_execution_month", "ingest_incremental", "backfill_ingest", "backfill_ingest_schedule",
    "publish_after_verify", "export_parquet", "export_csv", "export_spreadsheet", "export_jobs",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LITERAL_KEYS - READ_BACK))
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    with settings(spark, **NO_BROADCAST):
        text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search("CartesianProduct|NestedLoopJoin|EvalPython|MapInPandas", text)


def test_interval_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["ingest_interval_filter"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-14T02:00)" in text and "LessThan(ts,2024-01-15T02:00)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text


def test_serving_reads_only_what_it_counts(spark, sf_dir):
    text = plan(QUERIES["rows_by_month"](spark, sf_dir))
    assert set(re.findall(r"ReadSchema: struct<(.*?)>", text)) == {"o_orderdate:timestamp_ntz", "l_linestatus:string,l_shipdate:timestamp_ntz"}
    assert "TakeOrderedAndProject" in text and "events" not in text


def test_pages_are_top_k(spark, sf_dir):
    for name in ("detail_page", "runs_page", "recent_activity", "export_job_list"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_newest_rows_are_limited_before_the_shuffle(spark, sf_dir):
    for name in ("latest_run", "latest_success", "active_any", "recent_runs"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("WindowGroupLimit") == 2 and text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_schedules_are_parsed_above_their_grouping(spark, sf_dir):
    for name in ("cron_windows", "fire_intervals", "interval_assignment", "job_overview"):
        for line in plan(QUERIES[name](spark, sf_dir)).splitlines():
            assert "FileScan" not in line or "regexp_extract" not in line


def test_month_filter_prunes_directories(spark, sf_dir, tmp_path):
    root = str(tmp_path / "ORDERS")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    I.write_partitions(I.with_partition(orders, month_start(F.col("o_orderdate"))), root, spread=True)
    text = plan(P.scan(spark, root).where("year = 1996 AND month = 3").select("o_orderkey"))
    assert "PartitionFilters: [isnotnull(year" in text and "ReadSchema: struct<o_orderkey:bigint>" in text
    assert "ReadSchema: struct<>" in plan(P.partition_row_counts(spark, root))


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A ledger where one run holds a third of all steps and one pipeline a third of all runs."""
    n, base = 60_000, str(tmp_path_factory.mktemp("hot"))
    at = F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz")
    runs = spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("pipeline_name"),
        F.lit(dt.date(2026, 1, 1)).alias("execution_date"), F.lit("failed").alias("status"), at.alias("started_at"),
        (at + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), F.lit("manual").alias("trigger_type"),
        (at + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("created_at"))
    run_id = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500).cast("string")
    steps = spark.range(n).select(
        F.col("id").cast("string").alias("id"), run_id.alias("pipeline_run_id"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("step_name"),
        F.when(F.col("id") % 2 == 0, "failed").otherwise("success").alias("status"),
        (at + F.make_dt_interval(secs=(F.col("id") % 3600).cast("decimal(18,6)"))).alias("started_at"),
        (at + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), F.lit(1).cast("long").alias("records_processed"),
        F.sha2(F.col("id").cast("string"), 256).alias("error_message"), F.lit(0).alias("retry_count"), at.alias("created_at"))
    runs.repartition(8).write.parquet(f"{base}/runs")
    steps.repartition(8).write.parquet(f"{base}/steps")
    return spark.read.parquet(f"{base}/runs"), spark.read.parquet(f"{base}/steps")


SKEWED = {
    **NO_BROADCAST,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "50KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "50KB",
    "spark__sql__shuffle__partitions": "16",
}


@pytest.mark.parametrize("call,rows", [
    (lambda r, s: L.run_with_steps(r, s), 61_000),
    (lambda r, s: L.step_bars(s, dt.datetime(2026, 1, 2)), 60_000),
    (lambda r, s: L.step_timeline(r, s), 60_000),
    (lambda r, s: L.steps_kept(s, r, "11"), None),
])
def test_a_hot_run_is_split(spark, hot, call, rows):
    with settings(spark, **SKEWED):
        df = call(*hot)
        got = df._jdf.queryExecution()
        got.executedPlan().execute().count()
        text = got.executedPlan().toString()
        assert "skew=true" in text
        if rows:
            assert df.count() == rows


def test_hot_run_results(spark, hot):
    runs, steps = hot
    plain = runs.select("id").join(steps.select(F.col("pipeline_run_id").alias("id"), "step_name"), "id", "left")
    assert L.run_with_steps(runs, steps).select("id", "step_name").exceptAll(plain).isEmpty() and plain.count() == 61_000
    totals = {r.id: r.records_processed for r in L.records_processed(runs, steps).collect()}
    assert totals["7"] == 20_000 + steps.where("id % 3 <> 0 AND id % 1500 = 7").count() and len(totals) == 2000
    assert L.recent_runs(runs, 25).where("pipeline_name = 'hot'").count() == 25
    assert L.first_failed_step(steps).where("id = '7'").first().step_name == "s0"


def test_a_hot_month_is_written_by_several_tasks(spark, tmp_path):
    month = F.when(F.col("id") % 3 == 0, F.lit("2026-02-01")).otherwise(F.concat(F.lit("2025-"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lit("-01")))
    df = I.with_partition(spark.range(0, 300_000, 1, 8).withColumn("text", F.sha2(F.col("id").cast("string"), 256)), month.cast("date"))
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="2MB", spark__sql__shuffle__partitions="16"):
        I.write_partitions(df, str(tmp_path / "T"), spread=True)
    files = {(r.year, r.month): r.n for r in P.list_files(spark, str(tmp_path / "T")).groupBy("year", "month").agg(F.count("*").alias("n")).collect()}
    # Eight tasks writing thirteen months each would leave 104 files.
    assert files[(2026, 2)] > 2 and sum(files.values()) < 80
    assert P.scan(spark, str(tmp_path / "T")).count() == 300_000
