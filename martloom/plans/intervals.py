"""Data intervals, schedule fires, month splits and assignment over the ledger's dates."""

from pyspark.sql import functions as F

from martloom.operators import intervals as I
from martloom.plans.base import RUNS, SPECS, with_
from martloom.sources.tables import pipeline_specs, runs, table


def _dates(spark, sf_dir):
    """Every (pipeline, execution date) of the ledger once."""
    return runs(spark, sf_dir).select("pipeline_name", "execution_date").distinct()


def interval_windows(spark, sf_dir):
    day = F.dayofmonth("execution_date") % 4
    text = F.when(day == 0, "interval:90").when(day == 1, "interval:15m").when(day == 2, "INTERVAL:6h").otherwise("interval:2d")
    return I.with_data_interval(_dates(spark, sf_dir).withColumn("schedule", text)).drop("interval_error")


def cron_windows(spark, sf_dir):
    specs = pipeline_specs(spark, sf_dir).select(F.col("name").alias("pipeline_name"), "schedule")
    return I.with_data_interval(_dates(spark, sf_dir).join(specs, "pipeline_name"))


def bind_params(spark, sf_dir):
    whole = cron_windows(spark, sf_dir).where(F.col("interval_error").isNull()).drop("interval_error", "schedule")
    return I.with_bind_params(whole)


def _ranges(spark, sf_dir):
    """First and last execution date of every pipeline."""
    return runs(spark, sf_dir).groupBy("pipeline_name").agg(
        F.min("execution_date").alias("start_date"), F.max("execution_date").alias("end_date")
    )


def fire_intervals(spark, sf_dir):
    """Cron and fixed schedules, and for every pipeline a copy whose schedule can't be read."""
    specs = pipeline_specs(spark, sf_dir).select(F.col("name").alias("pipeline_name"), "schedule")
    ranges = _ranges(spark, sf_dir).join(specs, "pipeline_name")
    broken = ranges.withColumn("schedule", F.concat(F.lit("at "), "schedule"))
    return I.fire_intervals(ranges.unionByName(broken)).select(
        "pipeline_name", "schedule", "data_interval_start", "data_interval_end", "interval_error"
    )


def interval_assignment(spark, sf_dir):
    """Each event with the data interval of every cron pipeline it falls into."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    first, last = events.agg(F.min("ts").cast("date"), F.date_add(F.max("ts").cast("date"), 31)).first()
    schedules = pipeline_specs(spark, sf_dir).select(
        F.col("name").alias("pipeline_name"), "schedule", F.lit(first).alias("start_date"), F.lit(last).alias("end_date")
    )
    fires = I.fire_intervals(schedules).select("pipeline_name", "data_interval_start", "data_interval_end")
    return I.assign_intervals(events, fires, "ts").select(
        "event_id", "pipeline_name", "data_interval_start", "data_interval_end"
    )


def interval_assignment_minutes(spark, sf_dir):
    """Each event with its minute, its hour and its three days, from schedules that fire over the whole time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    first, last = events.agg(F.min("ts").cast("date"), F.date_add(F.max("ts").cast("date"), 3)).first()
    schedules = spark.createDataFrame([(s, first, last) for s in ("* * * * *", "0 * * * *", "interval:3d")],
                                      "schedule string, start_date date, end_date date")
    return I.assign_intervals(events, I.fire_intervals(schedules), "ts").select(
        "event_id", "schedule", "data_interval_start", "data_interval_end")


def backfill_months(spark, sf_dir):
    return I.split_months(_ranges(spark, sf_dir)).select("pipeline_name", "execution_date")


def pending_dates(spark, sf_dir):
    return I.pending_dates(_dates(spark, sf_dir), runs(spark, sf_dir))


# All fires on a half-hour grid, each schedule spelled out as a plain condition.
FIRES = """
grid AS (
  SELECT CAST(g AS TIMESTAMP) AS t FROM (
    SELECT unnest(generate_series(TIMESTAMP '1993-10-01', TIMESTAMP '2004-12-31', INTERVAL 30 MINUTE)) AS g)
),
fires AS (
  SELECT digit, t, lag(t) OVER (PARTITION BY digit ORDER BY t) AS before FROM (
    SELECT '1' AS digit, t FROM grid WHERE hour(t) = 2 AND minute(t) = 0
    UNION ALL SELECT '2', t FROM grid WHERE day(t) = 1 AND hour(t) = 2 AND minute(t) = 0
    UNION ALL SELECT '3', t FROM grid WHERE hour(t) IN (0, 6, 12, 18) AND minute(t) = 0
    UNION ALL SELECT '4', t FROM grid WHERE isodow(t) <= 5 AND hour(t) = 1 AND minute(t) = 30)
)"""

_DATES = """
dates AS (SELECT DISTINCT pipeline_name, execution_date FROM runs)"""

_WINDOWS = RUNS + "," + SPECS + "," + _DATES + "," + FIRES + """,
firsts AS (SELECT digit, CAST(t AS DATE) AS d, min(t) AS t, min(before) AS before FROM fires GROUP BY 1, 2),
windows AS (
  SELECT d.pipeline_name, d.execution_date, s.schedule,
         CASE WHEN left(d.pipeline_name, 1) = '5' THEN CAST(d.execution_date AS TIMESTAMP) - INTERVAL 15 MINUTE
              ELSE f.before END AS data_interval_start,
         CASE WHEN left(d.pipeline_name, 1) = '5' THEN CAST(d.execution_date AS TIMESTAMP) ELSE f.t END AS data_interval_end
  FROM dates d JOIN specs s ON s.name = d.pipeline_name
  LEFT JOIN firsts f ON f.digit = left(d.pipeline_name, 1) AND f.d = d.execution_date
)"""

_PART_COLUMNS = ", ".join(
    f"CAST({part}({source}) AS INTEGER) AS {key}_{part}"
    for key, source in (("logical_date", "data_interval_start"), ("data_interval_start", "data_interval_start"),
                        ("data_interval_end", "data_interval_end"))
    for part in ("year", "month", "day", "hour", "minute", "second")
)

QUERIES = {
    "interval_windows": interval_windows,
    "cron_windows": cron_windows,
    "bind_params": bind_params,
    "fire_intervals": fire_intervals,
    "interval_assignment": interval_assignment,
    "interval_assignment_minutes": interval_assignment_minutes,
    "backfill_months": backfill_months,
    "pending_dates": pending_dates,
}

ORACLE = {
    "interval_windows": with_(RUNS + "," + _DATES, """
        SELECT pipeline_name, execution_date, schedule, CAST(execution_date AS TIMESTAMP) - INTERVAL 1 SECOND * secs AS data_interval_start,
               CAST(execution_date AS TIMESTAMP) AS data_interval_end
        FROM (SELECT *, CASE day(execution_date) % 4 WHEN 0 THEN 'interval:90' WHEN 1 THEN 'interval:15m'
                          WHEN 2 THEN 'INTERVAL:6h' ELSE 'interval:2d' END AS schedule,
                     CASE day(execution_date) % 4 WHEN 0 THEN 90 WHEN 1 THEN 900 WHEN 2 THEN 21600 ELSE 172800 END AS secs
              FROM dates)"""),
    "cron_windows": with_(_WINDOWS, """
        SELECT *, CASE WHEN data_interval_end IS NULL THEN 'no fire on the execution date' END AS interval_error FROM windows"""),
    "bind_params": with_(_WINDOWS, f"""
        SELECT pipeline_name, execution_date, data_interval_start, data_interval_end, data_interval_start AS logical_date,
               {_PART_COLUMNS} FROM windows WHERE data_interval_end IS NOT NULL"""),
    "fire_intervals": with_(RUNS + "," + SPECS + "," + FIRES, """
        , r AS (SELECT pipeline_name, s.schedule, min(execution_date) AS a, max(execution_date) AS b
                FROM runs JOIN specs s ON s.name = pipeline_name GROUP BY 1, 2)
        SELECT r.pipeline_name, r.schedule, f.before AS data_interval_start, f.t AS data_interval_end, NULL AS interval_error
        FROM r JOIN fires f ON f.digit = left(r.pipeline_name, 1) AND CAST(f.t AS DATE) BETWEEN r.a AND r.b
        UNION ALL
        SELECT pipeline_name, schedule, t - INTERVAL 15 MINUTE, t, NULL
        FROM (SELECT *, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1425 MINUTE, INTERVAL 15 MINUTE)) AS t
              FROM r WHERE left(pipeline_name, 1) = '5')
        UNION ALL
        SELECT pipeline_name, 'at ' || schedule, NULL, NULL, 'schedule is not supported' FROM r"""),
    "interval_assignment": with_(SPECS + """,
        grid AS (
          SELECT CAST(g AS TIMESTAMP) AS t FROM (
            SELECT unnest(generate_series(TIMESTAMP '2022-10-01', TIMESTAMP '2025-12-31', INTERVAL 30 MINUTE)) AS g)
        )""" + FIRES[FIRES.index(",\nfires"):], """
        SELECT e.event_id, s.name AS pipeline_name, f.before AS data_interval_start, f.t AS data_interval_end
        FROM events e JOIN fires f ON e.ts >= f.before AND e.ts < f.t JOIN specs s ON left(s.name, 1) = f.digit
        UNION ALL
        SELECT e.event_id, s.name, b, b + INTERVAL 15 MINUTE
        FROM (SELECT event_id, time_bucket(INTERVAL 15 MINUTE, CAST(ts AS TIMESTAMP)) AS b FROM events) e
        JOIN specs s ON left(s.name, 1) = '5'"""),
    "interval_assignment_minutes": """
        SELECT event_id, '* * * * *' AS schedule, date_trunc('minute', ts) AS data_interval_start,
               date_trunc('minute', ts) + INTERVAL 1 MINUTE AS data_interval_end FROM events
        UNION ALL
        SELECT event_id, '0 * * * *', date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 1 HOUR FROM events
        UNION ALL
        SELECT event_id, 'interval:3d', d + INTERVAL 3 DAY * n, d + INTERVAL 3 DAY * (n + 1)
        FROM (SELECT event_id, d, CAST(floor((epoch(ts) - epoch(d)) / 259200) AS INTEGER) AS n
              FROM events, (SELECT date_trunc('day', min(ts)) AS d FROM events))""",
    "backfill_months": with_(RUNS, """
        SELECT pipeline_name, CAST(unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP),
               CAST(date_trunc('month', b) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS execution_date
        FROM (SELECT pipeline_name, min(execution_date) AS a, max(execution_date) AS b FROM runs GROUP BY 1)"""),
    "pending_dates": with_(RUNS, """
        SELECT pipeline_name, execution_date FROM runs GROUP BY 1, 2
        HAVING count(*) FILTER (WHERE status IN ('success', 'queued', 'running')) = 0"""),
}
