"""Extracts, stored loads read back, backfills and count verification."""

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from martloom.operators import ingest as I, ledger as L
from martloom.plans.base import AS_OF
from martloom.sources import partitions as P
from martloom.sources.storage import shared_folder
from martloom.sources.tables import table

_ORDER_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderdate")
_DAILY, _MONTHLY = "0 2 * * *", "0 0 1 * *"


def ingest_source_scan(spark, sf_dir):
    spec = I.IngestSpec("orders", "ORDERS", source_where_template="o_orderstatus = :status AND o_totalprice > :least",
                        source_bind_params={"status": "F", "least": 1000})
    return I.extract(table(spark, sf_dir, "orders"), spec, dt.date(2000, 1, 1))


def ingest_projection(spark, sf_dir):
    spec = I.IngestSpec("orders", "ORDERS", source_where_template="1 = 1", columns=_ORDER_COLUMNS)
    return I.extract(table(spark, sf_dir, "orders"), spec, dt.date(2000, 1, 1))


def ingest_where_template(spark, sf_dir):
    """Interval instants, their date parts and a caller's own value in one predicate."""
    spec = I.IngestSpec(
        "orders", "ORDERS", schedule=_MONTHLY, columns=_ORDER_COLUMNS,
        source_where_template="o_orderdate < :data_interval_start AND month(o_orderdate) = :logical_date_month"
                              " OR o_orderpriority = :urgent AND o_orderdate >= :data_interval_end",
        source_bind_params={"urgent": "1-URGENT", "unused": 5},
    )
    return I.extract(table(spark, sf_dir, "orders"), spec, dt.date(2000, 1, 1))


def _events_spec(schedule=_DAILY, **more):
    return I.IngestSpec("events", "EVENTS", strategy="incremental", schedule=schedule, incremental_key="ts",
                        columns=("event_id", "ts", "event_type"), **more)


def ingest_interval_filter(spark, sf_dir):
    return I.extract(table(spark, sf_dir, "events"), _events_spec(), dt.date(2024, 1, 15))


def ingest_template_and_interval(spark, sf_dir):
    """The caller's predicate is kept together when the interval is added to it."""
    spec = _events_spec(source_where_template="event_type = 'click' OR event_type = :kind",
                        source_bind_params={"kind": "error"})
    return I.extract(table(spark, sf_dir, "events"), spec, dt.date(2024, 1, 15))


def ingest_column_predicate(spark, sf_dir):
    spec = I.IngestSpec("events", "EVENTS", schedule=_MONTHLY, source_where_template=I.interval_predicate("ts"),
                        columns=("event_id", "ts"))
    return I.extract(table(spark, sf_dir, "events"), spec, dt.date(2024, 2, 1))


def _orders_spec(where, **params):
    return I.IngestSpec("orders", "ORDERS", source_where_template=where, source_bind_params=params, columns=_ORDER_COLUMNS,
                        partition_by="o_orderdate")


def ingest_full(spark, sf_dir):
    """All orders by month, then a second run that replaces the months it has rows for."""
    base, orders = shared_folder(spark, "full"), table(spark, sf_dir, "orders")
    day = dt.date(2000, 1, 1)
    I.run_ingest(orders, _orders_spec("1 = 1"), day, base, "run-1")
    second = _orders_spec("o_orderstatus = :status AND year(o_orderdate) >= :year", status="F", year=1998)
    result = I.run_ingest(orders, second, day, base, "run-2")
    return P.scan(spark, result.table_root)


def ingest_execution_month(spark, sf_dir):
    """All rows of the interval go to the month of the execution date."""
    spec = I.IngestSpec("events", "EVENTS", schedule=_MONTHLY, source_where_template=I.interval_predicate("ts"),
                        columns=("event_id", "ts"))
    result = I.run_ingest(table(spark, sf_dir, "events"), spec, dt.date(2024, 2, 1), shared_folder(spark, "month"), "run-1")
    return P.scan(spark, result.table_root)


def ingest_incremental(spark, sf_dir):
    """A monthly interval, then a daily one added to another partition, then one more to the same."""
    base, events = shared_folder(spark, "incremental"), table(spark, sf_dir, "events")
    I.run_ingest(events, _events_spec(_MONTHLY), dt.date(2024, 2, 1), base, "run-1")
    I.run_ingest(events, _events_spec(), dt.date(2024, 1, 15), base, "run-2")
    result = I.run_ingest(events, _events_spec(), dt.date(2024, 1, 16), base, "run-3")
    return P.scan(spark, result.table_root)


def _backfill(spark, sf_dir, window, schedule, start, end, base, run_id, where, **params):
    spec = I.IngestSpec("orders", "ORDERS", schedule=schedule, source_where_template=where, source_bind_params=params,
                        columns=_ORDER_COLUMNS, allow_empty=True)
    result = I.run_backfill(table(spark, sf_dir, "orders"), spec, start, end, "o_orderdate", base, run_id, window)
    return P.scan(spark, result.table_root)


def backfill_ingest(spark, sf_dir):
    """Months of their own rows; the predicate names a value of the caller and parts of the month's interval."""
    return _backfill(spark, sf_dir, "calendar_month", "", dt.date(1995, 1, 15), dt.date(2001, 12, 10), shared_folder(spark, "backfill"), "run-1",
                     "o_orderstatus <> :skipped AND month(o_orderdate) = :logical_date_month AND o_orderdate < :data_interval_end"
                     " AND day(o_orderdate) > :data_interval_start_day", skipped="P")


def backfill_ingest_schedule(spark, sf_dir):
    """Each month holds the interval of the schedule on its first day: the month before."""
    return _backfill(spark, sf_dir, "schedule", "0 2 1 * *", dt.date(1995, 1, 1), dt.date(2002, 1, 1), shared_folder(spark, "backfill"), "run-1",
                     "o_orderpriority = :priority OR month(o_orderdate) <> :logical_date_month", priority="1-URGENT")


def backfill_rerun(spark, sf_dir):
    """A second backfill finds rows in some months only; the others end up empty."""
    base, span = shared_folder(spark, "backfill"), (dt.date(1995, 1, 1), dt.date(2001, 12, 1))
    _backfill(spark, sf_dir, "calendar_month", "", *span, base, "run-1", "1 = 1")
    return _backfill(spark, sf_dir, "calendar_month", "", *span, base, "run-2", "o_orderstatus = :status AND o_orderdate < :before",
                     status="F", before=dt.datetime(1997, 3, 1))


def load_ledger(spark, sf_dir):
    """State rows of a sound and of a failed load, and what holds of them."""
    root, orders = shared_folder(spark, "ledger"), table(spark, sf_dir, "orders")
    later = iter([AS_OF, AS_OF + dt.timedelta(minutes=5), AS_OF, AS_OF + dt.timedelta(minutes=1)])
    clock = lambda: next(later)
    I.run_recorded(orders, _orders_spec("o_orderstatus = :status", status="F"), dt.date(2000, 1, 1), root, "run-1", f"{root}/ledger", clock)
    try:
        I.run_recorded(orders, _orders_spec("1 = 0"), dt.date(2000, 1, 1), root, "run-2", f"{root}/ledger", clock)
    except I.VerificationFailed:
        pass
    runs = L.latest_state(spark.read.parquet(f"{root}/ledger/runs"))
    steps = L.latest_state(spark.read.parquet(f"{root}/ledger/steps")).select("pipeline_run_id", "step_name", "records_processed", F.col("error_message").isNotNull().alias("has_message"))
    return runs.join(steps, runs["id"] == steps["pipeline_run_id"]).drop("pipeline_run_id")


def verify_full(spark, sf_dir):
    """Source rows against stored rows, one kind of which is missing."""
    orders = table(spark, sf_dir, "orders")
    return I.count_issues(orders, orders.where(F.col("o_orderstatus") != "P"))


def verify_incremental(spark, sf_dir):
    """Loaded rows agree with extracted ones, the stored rows did not grow enough."""
    events = table(spark, sf_dir, "events")
    clicks = events.where(F.col("event_type") == "click")
    return I.growth_issues(clicks, clicks, events, events)


def verify_incremental_sound(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.where(F.col("event_type") == "click")
    return I.growth_issues(clicks, clicks, events.where(F.col("event_type") != "click"), events)


def publish_after_verify(spark, sf_dir):
    """A sound run, then one of each kind that loses rows on the way: readers keep the first."""
    base, orders, day = shared_folder(spark, "verify"), table(spark, sf_dir, "orders"), dt.date(2000, 1, 1)
    result = I.run_ingest(orders, _orders_spec("1 = 1"), day, base, "run-1")
    lossy = {"transform": lambda df: df.where("o_orderstatus <> 'P'")}
    full = replace(_orders_spec("1 = 1"), **lossy)
    added = replace(full, strategy="incremental", incremental_key="o_orderdate", schedule="interval:4000d")
    for run_id, spec in (("run-2", full), ("run-3", added)):
        try:
            I.run_ingest(orders, spec, day, base, run_id)
        except I.VerificationFailed:
            continue
        raise AssertionError(f"{run_id} was published")
    return P.scan(spark, result.table_root)


QUERIES = {
    f.__name__: f
    for f in (
        ingest_source_scan, ingest_projection, ingest_where_template, ingest_interval_filter, ingest_template_and_interval,
        ingest_column_predicate, ingest_full, ingest_execution_month, ingest_incremental, backfill_ingest,
        backfill_ingest_schedule, backfill_rerun, load_ledger, verify_full, verify_incremental, verify_incremental_sound, publish_after_verify,
    )
}

_YM = "CAST(year({0}) AS INTEGER) AS year, CAST(month({0}) AS INTEGER) AS month"
_DAY = "ts >= TIMESTAMP '2024-01-{0} 02:00:00' AND ts < TIMESTAMP '2024-01-{1} 02:00:00'"

ORACLE = {
    "ingest_source_scan": "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000",
    "ingest_projection": "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders",
    "ingest_where_template": """SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders
        WHERE (o_orderdate < TIMESTAMP '1999-12-01' AND month(o_orderdate) = 12)
           OR (o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01')""",
    "ingest_interval_filter": f"SELECT event_id, ts, event_type FROM events WHERE {_DAY.format(14, 15)}",
    "ingest_template_and_interval": f"""SELECT event_id, ts, event_type FROM events
        WHERE event_type IN ('click', 'error') AND {_DAY.format(14, 15)}""",
    "ingest_column_predicate": """SELECT event_id, ts FROM events
        WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""",
    "ingest_full": f"""SELECT o_orderkey, o_orderstatus, o_orderdate, {_YM.format('o_orderdate')} FROM orders o
        WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1998
           OR date_trunc('month', o_orderdate) NOT IN (SELECT date_trunc('month', o_orderdate) FROM orders
              WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1998)""",
    "ingest_execution_month": """SELECT event_id, ts, 2024 AS year, 2 AS month FROM events
        WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""",
    "ingest_incremental": f"""SELECT event_id, ts, event_type, 2024 AS year, 2 AS month FROM events
        WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'
        UNION ALL SELECT event_id, ts, event_type, 2024, 1 FROM events WHERE {_DAY.format(14, 15)}
        UNION ALL SELECT event_id, ts, event_type, 2024, 1 FROM events WHERE {_DAY.format(15, 16)}""",
    "backfill_ingest": f"""SELECT o_orderkey, o_orderstatus, o_orderdate, {_YM.format('o_orderdate')} FROM orders
        WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2002-01-01' AND o_orderstatus <> 'P' AND day(o_orderdate) > 1""",
    "backfill_ingest_schedule": f"""SELECT o_orderkey, o_orderstatus, o_orderdate, {_YM.format('m')}
        FROM (SELECT *, o_orderdate - INTERVAL 2 HOUR AS moved, date_trunc('month', o_orderdate - INTERVAL 2 HOUR) + INTERVAL 1 MONTH AS m FROM orders)
        WHERE m >= TIMESTAMP '1995-01-01' AND m <= TIMESTAMP '2002-01-01' AND (o_orderpriority = '1-URGENT' OR month(o_orderdate) <> month(moved))""",
    "backfill_rerun": f"""SELECT o_orderkey, o_orderstatus, o_orderdate, {_YM.format('o_orderdate')} FROM orders
        WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-03-01' AND o_orderstatus = 'F'""",
    "load_ledger": f"""SELECT 'run-1' AS id, 'orders' AS pipeline_name, DATE '2000-01-01' AS execution_date, 'success' AS status,
        TIMESTAMP '{AS_OF}' AS started_at, TIMESTAMP '{AS_OF}' + INTERVAL 5 MINUTE AS finished_at, 'manual' AS trigger_type, TIMESTAMP '{AS_OF}' AS created_at,
        'load' AS step_name, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS records_processed, false AS has_message
        UNION ALL SELECT 'run-2', 'orders', DATE '2000-01-01', 'failed', TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' + INTERVAL 1 MINUTE, 'manual', TIMESTAMP '{AS_OF}',
        'load', NULL, true""",
    "verify_full": """SELECT 'error' AS severity, 'row_count' AS check, (SELECT count(*) FROM orders) AS expected,
        (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS actual""",
    "verify_incremental": """SELECT 'error' AS severity, 'partition_growth' AS check,
        count(*) + count(*) FILTER (WHERE event_type = 'click') AS expected, count(*) AS actual FROM events""",
    "verify_incremental_sound": """SELECT 'error' AS severity, 'none' AS check, 0 AS expected, 0 AS actual WHERE false""",
    "publish_after_verify": f"SELECT o_orderkey, o_orderstatus, o_orderdate, {_YM.format('o_orderdate')} FROM orders",
}
