"""Scalar functions over whole tables."""

from pyspark.sql import Window, functions as F

from martloom.functions import dates as D
from martloom.functions import text as X
from martloom.functions.numbers import rint_long, round2
from martloom.functions.status import tone as tone_of
from martloom.plans.base import AS_OF, RUNS, SPECS, clock, duration, seconds, tone, two_decimals, with_
from martloom.sources.tables import pipeline_specs, runs, table


def duration_text(spark, sf_dir):
    text = D.duration_text(F.col("started_at"), F.col("finished_at"), D.timestamp_literal(AS_OF))
    return runs(spark, sf_dir).select("id", text.alias("duration"))


def avg_duration_text(spark, sf_dir):
    took = D.seconds_between(F.col("started_at"), F.col("finished_at")).cast("decimal(24,6)")
    totals = runs(spark, sf_dir).groupBy("pipeline_name", "trigger_type").agg(
        F.sum(took).cast("double").alias("_s"), F.count("finished_at").alias("_n")
    )
    return totals.select("pipeline_name", "trigger_type", D.avg_duration_text(F.col("_s"), F.col("_n")).alias("avg_duration"))


def _monthly(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("pipeline_name", D.month_start(F.col("execution_date")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("ok")
    )


def percent_change_text(spark, sf_dir):
    """Runs of a month against the month before it that has runs."""
    before = F.lag("n", 1, 0).over(Window.partitionBy("pipeline_name").orderBy("month"))
    counted = _monthly(spark, sf_dir).withColumn("_before", before)
    return counted.select("pipeline_name", "month", X.percent_change_text(F.col("n"), F.col("_before")).alias("change"))


def success_rate_text(spark, sf_dir):
    return _monthly(spark, sf_dir).select(
        "pipeline_name", "month", X.success_rate_text(F.col("ok"), F.col("n")).alias("success_rate")
    )


def status_tone(spark, sf_dir):
    """Upper-case and absent statuses among the ordinary ones."""
    key = F.col("id").cast("long")
    status = F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, F.upper("status")).when(key % 5 == 0, "skipped").otherwise(F.col("status"))
    return runs(spark, sf_dir).select("id", tone_of(status).alias("tone"))


def slug_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    spoken = F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("!! "))
    only_marks = F.when(F.col("p_partkey") % 9 == 0, F.lit("--##--")).otherwise(F.col("p_brand"))
    return part.select(
        "p_partkey",
        X.slug(spoken).alias("size_slug"),
        X.slug(only_marks).alias("brand_slug"),
        X.raw_table_name(F.col("p_type"), F.col("p_name")).alias("raw_table_name"),
    )


def build_ids(spark, sf_dir):
    odd = F.when(F.col("id").cast("long") % 4 == 0, F.concat(F.lit("__"), "id", F.lit("::"), "pipeline_name", F.lit("!")))
    empty = F.when(F.col("id").cast("long") % 9 == 0, "///")
    return runs(spark, sf_dir).select("id", X.build_id(F.col("execution_date"), F.coalesce(empty, odd, F.col("id"))).alias("build_id"))


def refresh_modes(spark, sf_dir):
    specs = pipeline_specs(spark, sf_dir).select(F.col("name").alias("pipeline_name"), "strategy")
    kind = X.refresh_kind(F.col("trigger_type"), F.col("strategy"))
    return runs(spark, sf_dir).join(specs, "pipeline_name").select(
        "id", kind.alias("kind"), X.stored_refresh_mode(kind).alias("refresh_mode")
    )


def short_messages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shorten(F.col("text")).alias("message"))


def parse_timestamps(spark, sf_dir):
    """Event times written in five ways, one of them unreadable, and read again."""
    kind = F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(kind == 0, F.concat(iso, F.lit("Z")))
        .when(kind == 1, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+09:00")))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 3, F.concat(F.lit("on "), iso))
        .otherwise(iso)
    )
    return table(spark, sf_dir, "events").select("event_id", D.parse_iso(text).alias("parsed"))


def mask_params(spark, sf_dir):
    """Parameters of a log line as a map; values under secret keys are masked."""
    params = F.create_map(
        F.lit("user"), F.col("c_name"),
        F.concat(F.lit("Api_Key_"), "c_mktsegment"), F.col("c_name"),
        F.concat(F.col("c_mktsegment"), F.lit("_TOKEN")), F.col("c_mktsegment"),
        F.lit("segment"), F.col("c_mktsegment"),
    )
    masked = table(spark, sf_dir, "customer").select("c_custkey", F.explode(X.mask_secrets(params)).alias("param", "value"))
    return masked


def month_buckets(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        D.month_bucket(day).alias("bucket"),
        D.month_label(day).alias("label"),
        D.month_start(day).alias("month_start"),
        D.next_month(day).alias("next_month"),
        D.partition_date(F.year(day), F.month(day)).alias("partition_start"),
    )


def half_even_rounding(spark, sf_dir):
    """Means with many decimal ties: quantities of an order over fixed divisors."""
    totals = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")
    )
    return totals.select(
        "l_partkey",
        "l_suppkey",
        round2(F.col("q") / 8).alias("eighth"),
        round2(F.col("q") / 1000).alias("thousandth"),
        round2(F.col("q") / F.col("n")).alias("mean"),
        rint_long(F.col("q") / 2).alias("half"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        duration_text, avg_duration_text, percent_change_text, success_rate_text, status_tone, slug_names, build_ids,
        refresh_modes, short_messages, parse_timestamps, mask_params, month_buckets, half_even_rounding,
    )
}

_MONTHLY = RUNS + """,
monthly AS (SELECT pipeline_name, CAST(date_trunc('month', execution_date) AS DATE) AS month, count(*) AS n,
            count(*) FILTER (WHERE status = 'success') AS ok FROM runs GROUP BY 1, 2)"""


def _slug(x):
    cleaned = f"lower(trim(regexp_replace({x}, '[^0-9A-Za-z]+', '_', 'g'), '_'))"
    return f"""CASE WHEN {cleaned} = '' THEN 'dataset' WHEN regexp_matches({cleaned}, '^[0-9]') THEN 't_' || {cleaned} ELSE {cleaned} END"""


_SAFE_ID = """CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN '///' WHEN CAST(id AS BIGINT) % 4 = 0 THEN '__' || id || '::' || pipeline_name || '!' ELSE id END"""

ORACLE = {
    "duration_text": with_(RUNS, f"SELECT id, {duration('started_at', 'finished_at')} AS duration FROM runs"),
    "avg_duration_text": with_(RUNS, f"""SELECT pipeline_name, trigger_type, CASE WHEN n > 0 THEN {clock("m")} ELSE '-' END AS avg_duration
        FROM (SELECT pipeline_name, trigger_type, count(finished_at) AS n,
              CAST(round_even(sum({seconds("started_at", "finished_at")}) / count(finished_at), 0) AS BIGINT) AS m FROM runs GROUP BY 1, 2)"""),
    "percent_change_text": with_(_MONTHLY, """SELECT pipeline_name, month, CASE WHEN p <= 0 THEN CASE WHEN n <= 0 THEN '+0%' ELSE '+100%' END
        ELSE CASE WHEN n >= p THEN '+' ELSE '' END || CAST(CAST(round_even(((n - p) / p::DOUBLE) * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || '%' END AS change
        FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY pipeline_name ORDER BY month) AS p FROM monthly)"""),
    "success_rate_text": with_(_MONTHLY, """SELECT pipeline_name, month,
        CAST(CAST(round_even((ok / n::DOUBLE) * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS success_rate FROM monthly"""),
    "status_tone": with_(RUNS, f"""SELECT id, {tone("st")} AS tone FROM (SELECT id, CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN NULL
        WHEN CAST(id AS BIGINT) % 7 = 0 THEN upper(status) WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'skipped' ELSE status END AS st FROM runs)"""),
    "slug_names": f"""SELECT p_partkey, {_slug("'  ' || CAST(p_size AS VARCHAR) || ' ' || p_name || '!! '")} AS size_slug,
        {_slug("CASE WHEN p_partkey % 9 = 0 THEN '--##--' ELSE p_brand END")} AS brand_slug,
        'raw__' || {_slug("p_type")} || '__' || {_slug("p_name")} AS raw_table_name FROM part""",
    "build_ids": with_(RUNS, f"""SELECT id, strftime(execution_date, '%Y%m%d') || '-' || CASE WHEN safe = '' THEN 'run' ELSE safe END AS build_id
        FROM (SELECT id, execution_date, trim(regexp_replace({_SAFE_ID}, '[^0-9A-Za-z-]+', '-', 'g'), '-') AS safe FROM runs)"""),
    "refresh_modes": with_(RUNS + "," + SPECS, """SELECT id, kind, CASE WHEN kind = 'full' THEN 'full' ELSE 'incremental' END AS refresh_mode
        FROM (SELECT r.id, CASE WHEN r.trigger_type = 'backfill' THEN 'backfill' WHEN s.strategy = 'incremental' THEN 'incremental'
              ELSE 'full' END AS kind FROM runs r JOIN specs s ON s.name = r.pipeline_name)"""),
    "short_messages": """SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS message FROM documents""",
    "parse_timestamps": """SELECT event_id, CASE event_id % 5 WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
        WHEN 3 THEN NULL ELSE ts END AS parsed FROM events""",
    "mask_params": """SELECT c_custkey, 'user' AS param, c_name AS value FROM customer
        UNION ALL SELECT c_custkey, 'Api_Key_' || c_mktsegment, '***' FROM customer
        UNION ALL SELECT c_custkey, c_mktsegment || '_TOKEN', '***' FROM customer
        UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer""",
    "month_buckets": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-01') AS bucket, strftime(o_orderdate, '%Y-%m') AS label,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
        CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month,
        make_date(year(o_orderdate), month(o_orderdate), 1) AS partition_start FROM orders""",
    "half_even_rounding": f"""SELECT l_partkey, l_suppkey, {two_decimals("q / 8")} AS eighth, {two_decimals("q / 1000")} AS thousandth,
        {two_decimals("q / n")} AS mean, CAST(round_even(q / 2, 0) AS BIGINT) AS half
        FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
}
