import datetime as dt

import pytest

from martloom import schemas
from martloom.operators import export as E
from martloom.operators import mart as M
from martloom.operators import serving as S

MARCH, APRIL = dt.date(2026, 3, 1), dt.date(2026, 4, 1)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(
        [
            ("mes_ops", "OPS_TABLE", MARCH, "march.parquet", 10, "build-001"),
            ("mes_ops", "OPS_TABLE", APRIL, "april.parquet", 5, "build-001"),
            ("mes_ops", "EQUIPMENT_STATUS", APRIL, "equipment.parquet", 5, "build-002"),
        ],
        schemas.MART_FILES,
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_cards_of_one_month_and_source(files):
    request = S.SummaryRequest("mes_ops", start=dt.date(2026, 4, 20), end=dt.date(2026, 4, 2), filters={"source": ["OPS_TABLE"]})
    assert [r[1] for r in rows(S.kpi_cards(S.kpi_summary(files, request)))] == [5.0, 1.0, 1.0, 5.0, 1.0]


def test_summary_of_nothing(files):
    summary = S.kpi_summary(files, S.SummaryRequest("absent")).first()
    assert (summary.total_rows, summary.total_files, summary.avg_rows_per_file, summary.covered_months) == (0, 0, 0.0, 0)


def test_summary_without_window(files):
    got = S.kpi_summary(files, S.SummaryRequest("mes_ops", filters={"source": ["OPS_TABLE"]})).first()
    assert (got.total_rows, got.total_files, got.covered_months) == (15, 2, 2)


def test_rows_by_month(files):
    request = S.ChartRequest("mes_ops", "rows_by_month", "day")
    assert rows(S.chart(files, request)) == [("2026-03-01", 10), ("2026-04-01", 10)]
    assert S.chart_warnings(request) == [S.MONTH_ONLY_WARNING]
    assert rows(S.chart(files, S.ChartRequest("mes_ops", "rows_by_month", "month", 1))) == [("2026-04-01", 10)]


def test_files_by_source(files):
    got = rows(S.chart(files, S.ChartRequest("mes_ops", "files_by_source")))
    assert got == [("OPS_TABLE", 2, "OPS_TABLE"), ("EQUIPMENT_STATUS", 1, "EQUIPMENT_STATUS")]


def test_detail(files):
    assert S.detail_total(files, S.DetailRequest("mes_ops")).first()[0] == 3
    assert rows(S.detail_page(files, S.DetailRequest("mes_ops", page_size=1))) == [
        ("EQUIPMENT_STATUS", APRIL, "equipment.parquet", 5, "build-002")]
    user = S.DetailRequest("mes_ops", sort=(("row_count", "asc"),))
    assert [r[2] for r in rows(S.detail_sorted(files, user))] == ["equipment.parquet", "april.parquet", "march.parquet"]


def test_deep_pages_agree_with_a_whole_sort(spark):
    from martloom.operators.paging import Sort, page, rank_slice

    df = spark.range(20_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id % 50 END AS k", "CAST(id % 11 AS STRING) AS name",
        "CAST(id / 7 AS DOUBLE) AS x", "TIMESTAMP_NTZ '2026-01-01' + make_dt_interval(0, 0, 0, id % 977) AS at", "id")
    for order in ([Sort("k", True), Sort("id")], [Sort("name"), Sort("x", True)], [Sort("at", True), Sort("k"), Sort("id", True)]):
        want = rows(df.orderBy(*[t.column for t in order]))
        for number, size in ((1, 10), (17, 123), (41, 123), (150, 100), (200, 100), (201, 100)):
            got = rows(page(df, order, number, size))
            assert got == want[(number - 1) * size:number * size]
            assert rows(rank_slice(df, order, (number - 1) * size, size, sketch=60, pages_before=1)) == got


def test_pages_of_rows_the_order_cannot_tell_apart(spark):
    from martloom.operators.paging import Sort, page

    df = spark.range(5000).selectExpr("1 AS k", "id")
    assert page(df, [Sort("k")], 40, 100).count() == 100 and page(df, [Sort("k")], 51, 100).count() == 0


def test_deep_pages_read_their_range_only(spark, sf_dir):
    from martloom.operators.paging import Sort, rank_slice

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    text = rank_slice(orders, [Sort("o_orderkey")], 1000, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey" in text and "LessThanOrEqu" in text.split("PushedFilters")[1]
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_options(files):
    sources = M.source_rollup(files, "full", dt.datetime(2026, 4, 6, 9))
    assert rows(S.source_options(sources, "mes_ops")) == [("EQUIPMENT_STATUS",), ("OPS_TABLE",)]
    assert rows(S.month_options(files, "mes_ops")) == [("2026-04",), ("2026-03",)]


def test_rollups(files):
    sources = M.source_rollup(files, "full", dt.datetime(2026, 4, 6, 9))
    got = {r.source_name: (r.raw_table_name, r.row_count, r.file_count) for r in sources.collect()}
    assert got == {
        "OPS_TABLE": ("raw__mes_ops__ops_table", 15, 2),
        "EQUIPMENT_STATUS": ("raw__mes_ops__equipment_status", 5, 1),
    }
    assert rows(M.dataset_rollup(sources)) == [("mes_ops", 2, 20, 3, MARCH, APRIL, dt.datetime(2026, 4, 6, 9))]


def test_dashboard(files):
    sources = M.source_rollup(files, "full", dt.datetime(2026, 4, 6, 9))
    frames = S.dashboard(files, sources, M.dataset_rollup(sources), "mes_ops", {"partition_month": ["2026-04"]})
    assert frames["cards"].count() == 5
    assert rows(frames["rows_by_month"]) == [("2026-04-01", 10)]
    assert frames["detail_preview"].count() == 2
    with pytest.raises(S.UnknownDataset):
        S.dashboard(files, sources, M.dataset_rollup(sources), "absent")


@pytest.mark.parametrize(
    "call",
    [
        lambda f: S.select_files(f, "mes_ops", {"colour": ["red"]}),
        lambda f: S.select_files(f, "mes_ops", {"partition_month": ["2026"]}),
        lambda f: S.select_files(f, "mes_ops", {"partition_month": ["2026-13"]}),
        lambda f: S.chart(f, S.ChartRequest("mes_ops", "pie")),
        lambda f: S.ChartRequest("mes_ops", "rows_by_month", limit=0),
        lambda f: S.ChartRequest("mes_ops", "rows_by_month", "minute"),
        lambda f: S.DetailRequest("mes_ops", page=0),
        lambda f: S.DetailRequest("mes_ops", page_size=501),
        lambda f: S.detail(f, "mes_ops", detail_key="other"),
        lambda f: S.detail_sorted(f, S.DetailRequest("mes_ops", sort=(("dataset_name", "asc"),))),
        lambda f: S.detail_sorted(f, S.DetailRequest("mes_ops", sort=(("row_count", "up"),))),
        lambda f: E.export_plan(f, "mes_ops", "parquet_export", "csv.zip"),
        lambda f: E.export_plan(f, "mes_ops", "print", "pdf"),
    ],
)
def test_bad_arguments(files, call):
    with pytest.raises(ValueError):
        call(files)


def test_every_call_checks_the_dataset(spark):
    from martloom import schemas

    empty = [spark.createDataFrame([], x) for x in (schemas.MART_FILES, schemas.MART_SOURCES, schemas.MART_DATASETS)]
    mart = S.ServedMart(*empty)
    calls = [lambda: mart.summary(S.SummaryRequest("x")), lambda: mart.chart(S.ChartRequest("x", "rows_by_month")), lambda: mart.detail(S.DetailRequest("x")),
             lambda: mart.export_rows(S.DetailRequest("x")), lambda: mart.filter_options("x"), lambda: mart.dashboard("x")]
    for call in calls:
        with pytest.raises(S.UnknownDataset):
            call()


@pytest.mark.parametrize("bad", ["2026", "2026-00", "2026-13", "26-01", "2026-01-01", "0000-01", ""])
def test_months_are_year_and_month(bad):
    with pytest.raises(ValueError):
        S.parse_month(bad)
