import datetime as dt

import pytest
from pyspark.sql import functions as F

from martloom.functions import schedules as S
from martloom.operators import intervals as I


@pytest.mark.parametrize(
    "day,schedule,start,end",
    [
        ("2026-03-15", "0 2 * * *", "2026-03-14 02:00:00", "2026-03-15 02:00:00"),
        ("2027-01-01", "0 2 1 * *", "2026-12-01 02:00:00", "2027-01-01 02:00:00"),
        ("2026-03-15", "0 */6 * * *", "2026-03-14 18:00:00", "2026-03-15 00:00:00"),
        ("2026-03-16", "30 1 * * mon-fri", "2026-03-13 01:30:00", "2026-03-16 01:30:00"),
        ("2026-03-16", "30 1 * * 0-4", "2026-03-13 01:30:00", "2026-03-16 01:30:00"),
        ("2026-03-31", "0 0 last * *", "2026-02-28 00:00:00", "2026-03-31 00:00:00"),
        ("2026-03-15", "* * * * *", "2026-03-14 23:59:00", "2026-03-15 00:00:00"),
        ("2026-06-01", "5/20 1,3-5 * mar,jun *", "2026-03-31 05:45:00", "2026-06-01 01:05:00"),
        ("2026-03-15", "interval:15m", "2026-03-14 23:45:00", "2026-03-15 00:00:00"),
        ("2026-03-15", " INTERVAL:2 ", "2026-03-14 23:59:58", "2026-03-15 00:00:00"),
        ("2026-03-15", "interval:1d", "2026-03-14 00:00:00", "2026-03-15 00:00:00"),
    ],
)
def test_intervals(spark, day, schedule, start, end):
    got = I.resolve_data_interval(spark, dt.date.fromisoformat(day), schedule)
    assert [str(x) for x in got] == [start, end]


@pytest.mark.parametrize(
    "day,schedule",
    [
        ("2026-03-15", "every day 2am"),
        ("2026-03-15", "60 * * * *"),
        ("2026-03-15", "0 0 5-2 * *"),
        ("2026-03-15", "0 0 * * fri/2"),
        ("2026-03-15", "0 0 * *"),
        ("2026-03-15", "interval:0s"),
        ("2026-03-15", "interval:5w"),
        ("2026-03-15", ""),
        ("2026-03-15", None),
        ("2026-03-15", "30 1 * * mon-fri"),
        ("2028-02-29", "0 0 29 2 *"),
    ],
)
def test_no_interval(spark, day, schedule):
    with pytest.raises(ValueError):
        I.resolve_data_interval(spark, dt.date.fromisoformat(day), schedule)


def test_table_form_keeps_rows_without_interval(spark):
    rows = [("2026-03-14", "30 1 * * mon-fri"), ("2026-03-13", "30 1 * * mon-fri"), ("2026-03-13", None), ("2026-03-13", "x")]
    df = spark.createDataFrame(rows, "d string, schedule string").select(F.to_date("d").alias("execution_date"), "schedule")
    got = {(str(r.execution_date), r.schedule): r.interval_error for r in I.with_data_interval(df).collect()}
    assert got == {
        ("2026-03-14", "30 1 * * mon-fri"): "no fire on the execution date",
        ("2026-03-13", "30 1 * * mon-fri"): None,
        ("2026-03-13", None): "schedule is blank",
        ("2026-03-13", "x"): "schedule is not supported",
    }


def test_fires_follow_each_other(spark):
    one = spark.createDataFrame([("15 6,18 * * *", dt.date(2026, 2, 27), dt.date(2026, 3, 2))],
                                "schedule string, start_date date, end_date date")
    rows = sorted((r.data_interval_start, r.data_interval_end) for r in I.fire_intervals(one).collect())
    assert len(rows) == 8 and rows[0][0] == dt.datetime(2026, 2, 26, 18, 15)
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_next_fire(spark):
    def at(schedule, as_of):
        df = I.with_schedule(spark.createDataFrame([(schedule,)], "schedule string"))
        return str(df.select(F.expr(S.next_fire("_cron", f"TIMESTAMP_NTZ '{as_of}'")).alias("n")).first()["n"])

    assert at("0 2 * * *", "2026-03-15 02:00:00") == "2026-03-15 02:00:00"
    assert at("0 2 * * *", "2026-03-15 02:00:00.000001") == "2026-03-16 02:00:00"
    assert at("0 2 1 1 *", "2026-03-15 02:00:01") == "2027-01-01 02:00:00"


def test_month_split(spark):
    def months(a, b):
        return [str(r[0]) for r in I.months_between(spark, dt.date.fromisoformat(a), dt.date.fromisoformat(b)).collect()]

    assert months("2026-01-15", "2026-04-10") == ["2026-01-01", "2026-02-01", "2026-03-01", "2026-04-01"]
    assert months("2025-11-01", "2026-02-28") == ["2025-11-01", "2025-12-01", "2026-01-01", "2026-02-01"]
    assert months("2026-01-31", "2026-01-31") == ["2026-01-01"]
    with pytest.raises(ValueError):
        months("2026-02-01", "2026-01-31")


def test_boundaries_of_assignment(spark):
    rows = spark.createDataFrame(
        [(1, dt.datetime(2026, 1, 1, 2)), (2, dt.datetime(2026, 1, 2, 2)), (3, dt.datetime(2026, 1, 1, 1, 59, 59)),
         (4, dt.datetime(2026, 1, 3))], "id int, t timestamp_ntz")
    spans = spark.createDataFrame(
        [("a", dt.datetime(2026, 1, 1, 2), dt.datetime(2026, 1, 2, 2)), ("b", dt.datetime(2026, 1, 2, 2), dt.datetime(2026, 1, 3))],
        "name string, data_interval_start timestamp_ntz, data_interval_end timestamp_ntz")
    assert sorted((r.id, r.name) for r in I.assign_intervals(rows, spans, "t").collect()) == [(1, "a"), (2, "b")]


def test_bind_values():
    params = I.interval_bind_params(dt.datetime(2026, 3, 14, 2, 1, 5), dt.datetime(2026, 3, 15, 2))
    assert len(params) == 21
    assert params["logical_date"] == params["data_interval_start"] == dt.datetime(2026, 3, 14, 2, 1, 5)
    assert (params["data_interval_end_day"], params["data_interval_start_second"]) == (15, 5)


def test_pending_dates(spark):
    day = dt.date(2026, 1, 1)
    wanted = spark.createDataFrame([(n, day) for n in "abcd"], "pipeline_name string, execution_date date")
    runs = spark.createDataFrame([("a", day, "success"), ("b", day, "running"), ("c", day, "failed")],
                                 "pipeline_name string, execution_date date, status string")
    assert sorted(r[0] for r in I.pending_dates(wanted, runs).collect()) == ["c", "d"]
    assert I.pending_dates(wanted, runs, force=True).count() == 4


def test_waits_of_years_and_steps_wider_than_their_field(spark):
    day = dt.datetime(2025, 3, 1)
    got = spark.createDataFrame([("0 0 29 2 *",), ("0 0 29 2 mon",), ("*/70 * * * *",), ("10-20/15 * * * *",), ("0 0 31 2 *",)], "schedule string").select(
        "schedule", F.expr(S.cron_struct("schedule")).alias("c")).select(
        "schedule", F.expr(S.next_fire("c", f"TIMESTAMP_NTZ '{day}'")).alias("next"), F.expr(S.is_cron("c")).alias("ok")).collect()
    found = {r.schedule: (r.ok, r.next) for r in got}
    assert found["0 0 29 2 *"] == (True, dt.datetime(2028, 2, 29)) and found["0 0 29 2 mon"] == (True, dt.datetime(2044, 2, 29))
    assert not found["*/70 * * * *"][0] and not found["10-20/15 * * * *"][0] and found["0 0 31 2 *"] == (True, None)
    leap = spark.createDataFrame([("0 0 29 2 *", dt.date(2020, 1, 1), dt.date(2028, 12, 31))], "schedule string, start_date date, end_date date")
    starts = sorted(r.data_interval_start for r in I.fire_intervals(leap).collect())
    assert starts == [dt.datetime(y, 2, 29) for y in (2016, 2020, 2024)]


def test_assignment_candidates_grow_with_rows_and_intervals(spark):
    """A minute schedule over a day beside longer ones: a cell of a length class holds a handful of intervals."""
    day = dt.date(2026, 3, 14)
    schedules = spark.createDataFrame([(s, day, day + dt.timedelta(days=1)) for s in ("* * * * *", "*/15 * * * *", "interval:6h", "0 0 1 * *")],
                                      "schedule string, start_date date, end_date date")
    fires = I.fire_intervals(schedules)
    rows = spark.range(2000).selectExpr("id", "TIMESTAMP_NTZ '2026-03-14' + make_dt_interval(0, 0, 0, id * 43) AS t")
    joined = I.assign_intervals(rows, fires, "t")
    got = {(r.id, r.schedule, r.data_interval_start) for r in joined.select("id", "schedule", "data_interval_start").collect()}
    spans = fires.select("schedule", "data_interval_start", "data_interval_end").collect()
    want = {(r.id, s.schedule, s.data_interval_start) for r in rows.collect() for s in spans if s.data_interval_start <= r.t < s.data_interval_end}
    assert got == want and len(got) > 5000
    assert I.interval_candidates(rows, fires, "t").count() <= 4 * len(got)


def test_fixed_schedules_and_broken_ones_fire_too(spark):
    a, b = dt.date(2026, 3, 1), dt.date(2026, 3, 3)
    rows = spark.createDataFrame([("interval:7h", a, b), ("interval:2d", a, b), ("every day", a, b), (None, a, b), ("0 5 * * *", b, a)],
                                 "schedule string, start_date date, end_date date")
    got = {}
    for r in I.fire_intervals(rows).collect():
        got.setdefault(r.schedule, []).append((r.data_interval_start, r.data_interval_end, r.interval_error))
    step = dt.timedelta(hours=7)
    first = dt.datetime(2026, 3, 1)
    assert sorted(got["interval:7h"]) == [(first + step * (k - 1), first + step * k, None) for k in range(11)]
    assert sorted(x[1] for x in got["interval:2d"]) == [first, dt.datetime(2026, 3, 3)]
    assert got["every day"] == [(None, None, "schedule is not supported")] and got[None] == [(None, None, "schedule is blank")]
    assert "0 5 * * *" not in got
