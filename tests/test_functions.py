import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from martloom.functions import dates as D
from martloom.functions import text as X
from martloom.functions.numbers import rint_long, round2
from martloom.functions.status import tone


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def values(spark, items, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_round2_agrees_with_python(spark):
    rng = random.Random(7)
    xs = [2.675, 0.125, 1.005, -2.675, 0.135, 2.665, 100.0, 0.0, -0.005, 1e9 + 0.005]
    xs += [rng.randint(-(10**7), 10**7) / rng.choice([3, 7, 8, 40, 125, 200, 1000]) for _ in range(20000)]
    xs += [rng.uniform(-1e6, 1e6) for _ in range(20000)]
    assert values(spark, xs, "double", round2) == [round(x, 2) for x in xs]


def test_rint_ties_to_even(spark):
    xs = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4]
    assert values(spark, xs, "double", rint_long) == [round(x) for x in xs]


def test_parse_iso(spark):
    cases = {
        "2026-01-01T02:03:04Z": dt.datetime(2026, 1, 1, 2, 3, 4),
        "2026-01-01T02:03:04.5": dt.datetime(2026, 1, 1, 2, 3, 4, 500000),
        "2026-01-01 02:03:04+09:00": dt.datetime(2026, 1, 1, 2, 3, 4),
        " 2026-01-01T02:03 ": dt.datetime(2026, 1, 1, 2, 3),
        "2026-01-01": dt.datetime(2026, 1, 1),
        "2026-13-01T00:00:00": None,
        "2026-02-30": None,
        "yesterday": None,
        "": None,
        None: None,
    }
    assert values(spark, list(cases), "string", D.parse_iso) == list(cases.values())


@pytest.mark.parametrize(
    "start,end,want",
    [
        ("2026-01-01 00:00:00", "2026-01-01 00:00:59.9", "59s"),
        ("2026-01-01 00:00:00", "2026-01-01 00:01:00", "1m 0s"),
        ("2026-01-01 00:00:00", "2026-01-01 02:05:59", "2h 5m"),
        ("2026-01-01 00:00:10", "2026-01-01 00:00:00", "0s"),
        ("2026-01-01 00:00:00", None, "12h 0m"),
        (None, "2026-01-01 00:00:00", "-"),
    ],
)
def test_duration_text(spark, start, end, want):
    s, e = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
    assert one(spark, D.duration_text(s, e, D.timestamp_literal("2026-01-01 12:00:00"))) == want


def test_average_duration_and_percentages(spark):
    avg = lambda s, n: one(spark, D.avg_duration_text(F.lit(s), F.lit(n)))
    assert [avg(0.0, 0), avg(5.0, 2), avg(7.0, 2), avg(7200.0, 1)] == ["-", "2s", "4s", "2h 0m"]
    change = lambda c, p: one(spark, X.percent_change_text(F.lit(c), F.lit(p)))
    assert [change(0, 0), change(3, 0), change(3, 2), change(1, 2), change(2, 2), change(999, 1000)] == [
        "+0%", "+100%", "+50%", "-50%", "+0%", "0%"]
    rate = lambda o, t: one(spark, X.success_rate_text(F.lit(o), F.lit(t)))
    assert [rate(0, 0), rate(1, 8), rate(3, 8), rate(5, 5)] == ["0%", "12%", "38%", "100%"]


def test_tone(spark):
    cases = {"SUCCESS": "ok", "completed": "ok", "Queued": "warn", "pending": "warn", "running": "warn",
             "failed": "bad", "skipped": "neutral", "": "neutral", None: "neutral"}
    assert values(spark, list(cases), "string", tone) == list(cases.values())


def test_slug(spark):
    cases = {"MES Ops": "mes_ops", "__a--b__": "a_b", "2nd": "t_2nd", "--": "dataset", "": "dataset", "한글": "dataset"}
    assert values(spark, list(cases), "string", X.slug) == list(cases.values())
    assert one(spark, X.raw_table_name(F.lit("mes_ops"), F.lit("OPS_TABLE"))) == "raw__mes_ops__ops_table"


def test_build_id(spark):
    day = F.lit(dt.date(2026, 4, 6))
    got = [one(spark, X.build_id(day, F.lit(v))) for v in ("run_1", "//", "-a-")]
    assert got == ["20260406-run-1", "20260406-run", "20260406-a"]


def test_covered_months_counts_gaps(spark):
    months = lambda a, b: one(spark, D.covered_months(F.lit(a).cast("date"), F.lit(b).cast("date")))
    assert [months("2026-03-01", "2026-03-01"), months("2025-11-01", "2026-02-01"), months(None, None)] == [1, 4, 0]


def test_shorten_and_mask(spark):
    assert one(spark, X.shorten(F.lit("a" * 120))) == "a" * 120
    assert one(spark, X.shorten(F.lit("a" * 121))) == "a" * 120 + "…"
    params = F.create_map(*[F.lit(x) for x in ("db_PASSWORD", "x", "user", "y", "api_key", "z")])
    assert one(spark, X.mask_secrets(params)) == {"db_PASSWORD": "***", "user": "y", "api_key": "***"}


def test_iso_forms_of_the_standard(spark):
    texts = ["20260315T103000", "2026-03-15T10", "2026-03-15T10:20:00,5", "2026-03-15T10:20:30.1234567Z", "20260315", "2026-03-15 10:20+09:00",
             "2026-0315", "2026-03-15T1020:30", "2026-13-01", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.parse_iso(F.col("t"))).collect()]
    day = dt.datetime(2026, 3, 15)
    assert got == [day.replace(hour=10, minute=30), day.replace(hour=10), day.replace(hour=10, minute=20, microsecond=500000),
                   day.replace(hour=10, minute=20, second=30, microsecond=123456), day, day.replace(hour=10, minute=20), None, None, None, None]


def test_week_dates_agree_with_the_standard_library(spark):
    texts = [f"{y}-W{w:02d}{d}" for y in (2009, 2015, 2020, 2021, 2026) for w in (0, 1, 11, 52, 53, 54) for d in ("", "-1", "-7", "-8", "-0")]
    texts += ["2026W117", "2026W11", "2026-W117", "2026W11-7", "2026-W11-7T10:20:30", "2026W117T102030.5Z", "2026-w11-7", "2026-W1-1"]

    def want(text):
        head, _, clock = text.partition("T")
        try:
            day = dt.datetime.fromisoformat(head)
        except ValueError:
            return None
        return day if not clock else day.replace(hour=10, minute=20, second=30, microsecond=500000 if "." in clock else 0)

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.parse_iso(F.col("t"))).collect()]
    assert dict(zip(texts, got)) == {t: want(t) for t in texts}
