import datetime as dt

import pytest
from pyspark.sql import functions as F

from martloom.operators import mart as M
from martloom.sources import partitions as P

NOW = dt.datetime(2026, 4, 6, 9)
MARCH, APRIL = dt.date(2026, 3, 1), dt.date(2026, 4, 1)


def write(spark, root, month, rows, name="part"):
    (spark.createDataFrame(rows, "id bigint, qty bigint").coalesce(1)
     .write.mode("append").parquet(f"{root}/year=2026/month={month:02d}"))


@pytest.fixture
def ops(spark, tmp_path):
    root = str(tmp_path / "raw data+1" / "OPS_TABLE")
    write(spark, root, 3, [(1, 10), (2, 20)])
    write(spark, root, 4, [(3, 30)])
    return root


@pytest.fixture
def store(spark, tmp_path):
    return M.MartStore(spark, str(tmp_path / "mart"))


def test_file_statistics(spark, ops):
    stats = P.file_stats(spark, ops).collect()
    assert sorted((r.partition_start, r.row_count) for r in stats) == [(MARCH, 2), (APRIL, 1)]
    assert P.scan(spark, ops).count() == 3
    assert P.source_files(spark, ops).count() == 2
    assert P.partition_files(spark, ops, 2026, 4).count() == 1
    assert P.partition_files(spark, ops, 2026, 5).count() == 0
    assert (P.partition_row_count(spark, ops, 2026, 3), P.partition_row_count(spark, ops, 2026, 5)) == (2, 0)
    assert P.file_stats(spark, ops + "_absent").count() == 0


def test_files_without_rows_are_listed(spark, ops):
    write(spark, ops, 5, [])
    stats = {r.partition_start: r.row_count for r in P.file_stats(spark, ops).collect()}
    assert stats == {MARCH: 2, APRIL: 1, dt.date(2026, 5, 1): 0}


def test_refresh_takes_all_months_and_promotes(spark, ops, store):
    result = M.refresh_mart(store, "mes_ops", ops, "20260406-run-1", refreshed_at=NOW, only_if=(2026, 4))
    assert result.promoted and store.current_version() == result.version
    assert store.read("datasets").first()[:4] == ("mes_ops", 1, 3, 2)
    source = store.read("sources").first()
    assert (source.source_name, source.raw_table_name, source.refresh_mode) == ("OPS_TABLE", "raw__mes_ops__ops_table", "full")
    assert source.last_refreshed_at == NOW and source.source_root == ops


def test_other_sources_are_carried_over(spark, ops, store, tmp_path):
    other = str(tmp_path / "EQUIPMENT")
    write(spark, other, 4, [(9, 9)])
    M.refresh_mart(store, "mes_ops", other, "b1", refreshed_at=NOW)
    first = store.current_version()
    M.refresh_mart(store, "mes_ops", ops, "b2", "backfill", refreshed_at=NOW + dt.timedelta(hours=1))
    write(spark, ops, 4, [(4, 40)])
    M.refresh_mart(store, "mes_ops", ops, "b3", "incremental", refreshed_at=NOW)
    got = {r.source_name: (r.row_count, r.last_build_id, r.refresh_mode) for r in store.read("sources").collect()}
    assert got == {"EQUIPMENT": (1, "b1", "full"), "OPS_TABLE": (4, "b3", "incremental")}
    assert store.read("files").count() == 4
    assert store.read("datasets").first()[:4] == ("mes_ops", 2, 5, 4)
    assert len(store.versions()) == 3 and store.read("files", first).count() == 1


def test_refresh_is_skipped_without_files_of_the_month(ops, store):
    assert M.refresh_mart(store, "mes_ops", ops, "b1", only_if=(2026, 9)).version is None
    assert store.current_version() is None and store.read("files").count() == 0
    with pytest.raises(ValueError):
        M.refresh_mart(store, "mes_ops", ops + "_absent", "b1")
    with pytest.raises(ValueError):
        M.refresh_mart(store, " ", ops, "b1")


def test_invalid_version_is_not_promoted(spark, ops, store, monkeypatch):
    good = M.refresh_mart(store, "mes_ops", ops, "b1", refreshed_at=NOW)
    rollup = M.source_rollup
    monkeypatch.setattr(M, "source_rollup", lambda *a: rollup(*a).withColumn("row_count", F.col("row_count") + 1))
    bad = M.refresh_mart(store, "mes_ops", ops, "b2", refreshed_at=NOW)
    assert not bad.promoted and store.current_version() == good.version
    assert {r.check for r in bad.issues.collect()} == {"source_row_count"}


def test_missing_tables_and_raw_rows_end_validation(spark, ops, store):
    version = M.refresh_mart(store, "mes_ops", ops, "b1", refreshed_at=NOW).version
    expected = store.read("sources").withColumnRenamed("last_build_id", "build_id")
    assert M.is_valid(M.validate_mart(store, version, expected, ops, 3))
    raw = M.validate_mart(store, version, expected, ops, 4)
    assert [r.check for r in raw.collect()] == ["raw_row_count"]
    assert [r.check for r in M.validate_mart(store, version, expected, ops + "_absent", 3).collect()] == ["raw_table"]
    store.folder.remove(f"parts/{store.parts(version)['mes_ops']['OPS_TABLE']}/files")
    assert [r.check for r in M.validate_mart(store, version, expected, ops, 3).collect()] == ["metadata_table"]
    with pytest.raises(FileNotFoundError):
        store.promote(version)


def test_warnings_are_allowed(spark):
    issues = spark.createDataFrame([("warning", "x", "y")], "severity string, check string, message string")
    assert M.is_valid(issues) and not M.is_valid(issues.withColumn("severity", F.lit("error")))


def test_refreshes_at_the_same_time_keep_each_other(spark, ops, store, tmp_path):
    """The second refresh is promoted while the first is about to be."""
    other = str(tmp_path / "OTHER")
    write(spark, other, 1, [(i, i) for i in range(4)])
    promote, inner = M.MartStore.promote, []

    def interleaved(self, version, after=None):
        if not inner:
            inner.append(version)
            M.refresh_mart(store, "mes_ops", other, "b2", refreshed_at=NOW)
        promote(self, version, after)

    M.MartStore.promote = interleaved
    try:
        result = M.refresh_mart(store, "mes_ops", ops, "b1", refreshed_at=NOW)
    finally:
        M.MartStore.promote = promote
    assert result.promoted and store.current_version() == result.version
    assert {r.source_name for r in store.read("sources").collect()} == {"OTHER", ops.rsplit("/", 1)[-1]}
    assert store.read("datasets").first().source_count == 2


def test_rows_without_a_month_are_listed_and_counted(spark, store, tmp_path):
    root = str(tmp_path / "UNDATED")
    write(spark, root, 1, [(i, i) for i in range(4)])
    undated = spark.createDataFrame([(i, i) for i in range(3)], "id bigint, qty bigint").coalesce(1)
    undated.write.parquet(f"{root}/year=__HIVE_DEFAULT_PARTITION__/month=__HIVE_DEFAULT_PARTITION__")
    assert M.refresh_mart(store, "d", root, "b1", refreshed_at=NOW).promoted
    assert {(r.partition_start, r.row_count) for r in store.read("files").collect()} == {(dt.date(2026, 1, 1), 4), (None, 3)}


def jobs_of(spark, label, run):
    """How many jobs an action starts."""
    spark.sparkContext.setJobGroup(label, label)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_refresh_writes_its_own_source_and_counts_new_files_only(spark, ops, store, tmp_path):
    other = str(tmp_path / "EQUIPMENT")
    write(spark, other, 4, [(9, 9)])
    M.refresh_mart(store, "mes_ops", other, "b1", refreshed_at=NOW)
    M.refresh_mart(store, "mes_ops", ops, "b2", refreshed_at=NOW)
    before = {name for name, _ in store.folder.list("parts")}
    write(spark, ops, 5, [(5, 50), (6, 60), (7, 70)])
    assert jobs_of(spark, "refresh", lambda: M.refresh_mart(store, "mes_ops", ops, "b3", "incremental", NOW)) <= 12
    assert len({name for name, _ in store.folder.list("parts")} - before) == 1
    assert store.parts(store.current_version())["mes_ops"]["EQUIPMENT"] in before
    known = P.file_stats(spark, ops).withColumn("row_count", F.lit(1000).cast("long"))
    write(spark, ops, 6, [(8, 80)])
    got = {(r.partition_start.month, r.row_count) for r in P.file_stats(spark, ops, known).collect()}
    assert got == {(3, 1000), (4, 1000), (5, 1000), (6, 1)}
    changed = known.withColumn("length", F.when(F.month("partition_start") == 3, 1).otherwise(F.col("length")))
    got = {(r.partition_start.month, r.row_count) for r in P.file_stats(spark, ops, changed).collect()}
    assert got == {(3, 2), (4, 1000), (5, 1000), (6, 1)}


def test_removed_files_leave_an_incremental_refresh(spark, ops, store):
    M.refresh_mart(store, "mes_ops", ops, "b1", refreshed_at=NOW)
    from martloom.sources.storage import Folder
    Folder(spark, ops).remove("year=2026/month=03")
    assert M.refresh_mart(store, "mes_ops", ops, "b2", "incremental", NOW).promoted
    assert [(r.partition_start, r.row_count, r.last_build_id) for r in store.read("files").collect()] == [(APRIL, 1, "b2")]
