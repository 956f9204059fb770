import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from martloom.operators import ingest as I
from martloom.sources import partitions as P
from martloom.sources.relational import JdbcTable, quantile_predicates
from martloom.sources.storage import Folder

DAY = dt.date(2026, 3, 15)


@pytest.fixture(scope="module")
def log(spark):
    """Production log: 50 rows in January, 30 in February, 20 in March 2026."""
    months = F.when(F.col("id") < 50, 1).when(F.col("id") < 80, 2).otherwise(3)
    return spark.range(100).select(
        F.col("id").alias("LOG_ID"),
        F.make_timestamp_ntz(F.lit(2026), months, (F.col("id") % 28 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("LOG_DATE"),
        (F.col("id") * 10).alias("QUANTITY"),
    )


def spec(**more):
    base = dict(name="log", table="LOG", source_where_template="QUANTITY >= :least", source_bind_params={"least": 0})
    return I.IngestSpec(**{**base, **more})


def stored(spark, base, table="LOG"):
    return P.scan(spark, f"{base}/{table}")


def left_over(base, table="LOG"):
    """Load folders and temporary files that no manifest has named."""
    import json

    root = f"{base}/{table}"
    named = set()
    for f in glob.glob(f"{root}/_manifests/*.json"):
        named |= {load for loads in json.load(open(f)).values() for _, load in loads}
    return [n for n in os.listdir(root) if n != "_manifests" and n.removeprefix("_load=") not in named and not n.endswith(".crc")]


def test_full_replaces_only_its_month(spark, log, tmp_path):
    base = str(tmp_path)
    first = I.run_ingest(log, spec(), DAY, base, "r1")
    assert (first.rows, first.partitions) == (100, ("year=2026/month=03",))
    I.run_ingest(log, spec(source_bind_params={"least": 900}), dt.date(2026, 4, 1), base, "r2")
    I.run_ingest(log, spec(source_bind_params={"least": 500}), DAY, base, "r3")
    counts = {(r.year, r.month): r.row_count for r in P.partition_row_counts(spark, f"{base}/LOG").collect()}
    assert counts == {(2026, 3): 50, (2026, 4): 10}
    assert left_over(base) == []


def test_rerun_gives_the_same(spark, log, tmp_path):
    for run in ("r1", "r2", "r2"):
        I.run_ingest(log, spec(partition_by="LOG_DATE"), DAY, str(tmp_path), run)
    assert stored(spark, tmp_path).count() == 100
    assert {r.month for r in stored(spark, tmp_path).select("month").distinct().collect()} == {1, 2, 3}


def test_incremental_appends_and_keeps_files(spark, log, tmp_path):
    inc = spec(strategy="incremental", incremental_key="LOG_DATE", schedule="0 0 1 * *")
    base = str(tmp_path)
    I.run_ingest(log, inc, dt.date(2026, 2, 1), base, "r1")
    files = lambda: {r.file_path for r in P.list_files(spark, f"{base}/LOG").collect()}
    before = files()
    I.run_ingest(log, inc, dt.date(2026, 2, 1), base, "r2")
    assert before < files()
    assert stored(spark, base).count() == 100
    # A repeated run id stands for a retry and adds nothing; an id beginning like it is another run.
    I.run_ingest(log, inc, dt.date(2026, 2, 1), base, "r2-1")
    I.run_ingest(log, inc, dt.date(2026, 2, 1), base, "r2")
    assert stored(spark, base).count() == 150
    for bad in ("_x", ".x", "a/b", ""):
        with pytest.raises(ValueError):
            I.run_ingest(log, inc, dt.date(2026, 2, 1), base, bad)


def test_nothing_is_published_when_counts_differ(spark, log, tmp_path):
    base = str(tmp_path)
    I.run_ingest(log, spec(), DAY, base, "r1")
    for strategy in ({}, {"strategy": "incremental", "incremental_key": "LOG_DATE", "schedule": "interval:400d"}):
        lossy = spec(transform=lambda df: df.where("LOG_ID > 3"), **strategy)
        with pytest.raises(I.VerificationFailed):
            I.run_ingest(log, lossy, DAY, base, "r2")
        assert stored(spark, base).count() == 100 and left_over(base) == []


def test_failing_source_keeps_the_old_month(spark, log, tmp_path):
    base = str(tmp_path)
    I.run_ingest(log, spec(), DAY, base, "r1")
    broken = spec(transform=lambda df: df.withColumn("x", F.raise_error(F.lit("source lost")).cast("string")))
    with pytest.raises(Exception, match="source lost"):
        I.run_ingest(log, broken, DAY, base, "r2")
    assert stored(spark, base).count() == 100 and left_over(base) == []


def test_failure_while_publishing_is_undone(spark, log, tmp_path, monkeypatch):
    base = str(tmp_path)
    I.run_ingest(log, spec(partition_by="LOG_DATE"), DAY, base, "r1")

    def failing(self, name, text):
        raise OSError("disk lost")

    for strategy in ({}, {"strategy": "incremental", "incremental_key": "LOG_DATE", "schedule": "interval:400d"}):
        with monkeypatch.context() as patch:
            patch.setattr(Folder, "write_new", failing)
            with pytest.raises(OSError):
                I.run_ingest(log, spec(partition_by="LOG_DATE", **strategy), DAY, base, "r2")
        assert stored(spark, base).agg(F.sum("QUANTITY")).first()[0] == 49500
        assert stored(spark, base).count() == 100 and left_over(base) == []


def test_loads_of_one_table_at_the_same_time_keep_each_other(spark, log, tmp_path):
    """Each of two loads commits while the other is about to."""
    base = str(tmp_path)
    I.run_ingest(log, spec(partition_by="LOG_DATE"), DAY, base, "r1")
    write_new, inner = Folder.write_new, []

    def interleaved(self, name, text):
        if not inner:
            inner.append(name)
            I.run_ingest(log.where("LOG_ID < 50"), spec(partition_by="LOG_DATE", source_bind_params={"least": 100}), DAY, base, "r3")
        return write_new(self, name, text)

    Folder.write_new = interleaved
    try:
        I.run_ingest(log.where("LOG_ID >= 50"), spec(partition_by="LOG_DATE", source_bind_params={"least": 600}), DAY, base, "r2")
    finally:
        Folder.write_new = write_new
    counts = {r.month: r.row_count for r in P.partition_row_counts(spark, f"{base}/LOG").collect()}
    assert counts == {1: 40, 2: 20, 3: 20}


def test_source_is_read_once(spark, log, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    source = log.mapInArrow(counted, log.schema)
    inc = spec(strategy="incremental", incremental_key="LOG_DATE", schedule="interval:400d")
    assert I.run_ingest(source, inc, dt.date(2026, 6, 1), str(tmp_path), "r1").rows == 100
    assert reads.value == 100


def test_rows_without_a_date_are_refused(spark, log, tmp_path):
    undated = log.withColumn("LOG_DATE", F.when(F.col("LOG_ID") > 9, F.col("LOG_DATE")))
    with pytest.raises(I.VerificationFailed, match="10 rows"):
        I.run_ingest(undated, spec(partition_by="LOG_DATE"), DAY, str(tmp_path), "r1")


def test_empty_extract(spark, log, tmp_path):
    base = str(tmp_path)
    I.run_ingest(log, spec(), DAY, base, "r1")
    none = {"source_bind_params": {"least": 10**6}}
    with pytest.raises(I.VerificationFailed):
        I.run_ingest(log, spec(**none), DAY, base, "r2")
    assert P.partition_row_count(spark, f"{base}/LOG", 2026, 3) == 100
    I.run_ingest(log, spec(allow_empty=True, **none), DAY, base, "r3")
    assert P.partition_row_count(spark, f"{base}/LOG", 2026, 3) == 0
    inc = spec(strategy="incremental", incremental_key="LOG_DATE", schedule="0 0 1 * *")
    assert I.run_ingest(log, inc, dt.date(2030, 1, 1), base, "r4").rows == 0


def test_backfill_months_in_one_go(spark, log, tmp_path):
    base = str(tmp_path)
    result = I.run_backfill(log, spec(), dt.date(2026, 1, 20), dt.date(2026, 2, 2), "LOG_DATE", base, "b1")
    assert result.partitions == ("year=2026/month=01", "year=2026/month=02")
    assert stored(spark, base).count() == 80
    monthly = spec(schedule="0 0 1 * *")
    I.run_backfill(log, monthly, dt.date(2026, 2, 1), dt.date(2026, 3, 31), "LOG_DATE", base, "b2", "schedule")
    counts = {r.month: r.row_count for r in P.partition_row_counts(spark, f"{base}/LOG").collect()}
    assert counts == {1: 50, 2: 50, 3: 30}
    with pytest.raises(ValueError):
        I.run_backfill(log, spec(schedule="0 0 2 * *"), DAY, DAY, "LOG_DATE", base, "b3", "schedule")
    with pytest.raises(ValueError):
        I.run_backfill(log, monthly, DAY, dt.date(2026, 1, 1), "LOG_DATE", base, "b4")


def test_backfill_keeps_the_template_and_clears_emptied_months(spark, log, tmp_path):
    base = str(tmp_path)
    run = lambda run_id, **more: I.run_backfill(log, spec(**more), dt.date(2026, 1, 1), dt.date(2026, 3, 31), "LOG_DATE", base, run_id)
    even = {"source_where_template": "LOG_ID % 2 = :rest AND LOG_DATE >= :data_interval_start AND month(LOG_DATE) = :logical_date_month", "source_bind_params": {"rest": 0}}
    assert run("b1", **even).rows == 50
    only_march = {"source_where_template": "LOG_ID >= :first", "source_bind_params": {"first": 80}}
    with pytest.raises(I.VerificationFailed, match="month=01"):
        run("b2", **only_march)
    assert stored(spark, base).count() == 50
    assert run("b3", allow_empty=True, **only_march).rows == 20
    assert {r.month for r in stored(spark, base).select("month").distinct().collect()} == {3}
    with pytest.raises(ValueError, match="absent"):
        run("b4", source_where_template="LOG_ID = :absent", source_bind_params={})


def test_extract_arguments(log):
    with pytest.raises(ValueError, match="least"):
        I.extract(log, spec(source_bind_params={}), DAY)
    literal = spec(source_where_template="date_format(LOG_DATE, 'HH:mm') = '00:00' AND QUANTITY < :most", source_bind_params={"most": 30})
    assert I.extract(log, literal, DAY).count() == 3
    braces = spec(source_where_template="concat('{', LOG_ID, '}') = :text", source_bind_params={"text": "{7}"})
    assert I.extract(log, braces, DAY).count() == 1
    alternatives = spec(strategy="incremental", incremental_key="LOG_DATE", schedule="0 0 1 * *",
                        source_where_template="LOG_ID = 1 OR LOG_ID = 90", source_bind_params={})
    assert [r.LOG_ID for r in I.extract(log, alternatives, dt.date(2026, 2, 1)).collect()] == [1]
    assert I.interval_predicate(" LOG_DATE ").startswith("LOG_DATE >= :data_interval_start")
    for bad in ("1x", "a b", "a;drop", ""):
        with pytest.raises(ValueError):
            I.interval_predicate(bad)


@pytest.mark.parametrize("bad", [
    {"strategy": "merge"}, {"source_where_template": None}, {"source_where_template": " ", "source_bind_params": {}},
    {"strategy": "incremental"},
])
def test_spec_checks(bad):
    with pytest.raises(ValueError):
        spec(**bad)


def test_partition_columns_may_not_clash(log, tmp_path):
    with pytest.raises(ValueError):
        I.run_ingest(log.withColumn("year", F.lit(1)), spec(), DAY, str(tmp_path), "r1")


def test_codec(spark, log, tmp_path):
    I.run_ingest(log, spec(codec="zstd"), DAY, str(tmp_path), "r1")
    assert all(r.file_path.endswith(".zstd.parquet") for r in P.source_files(spark, f"{tmp_path}/LOG").collect())


def test_jdbc_options():
    plain = JdbcTable("jdbc:x", "LOG", one_task=True).options()
    assert plain == {"url": "jdbc:x", "dbtable": "LOG", "fetchsize": "10000"}
    split = JdbcTable("jdbc:x", "LOG", partition_column="LOG_ID", lower_bound="0", upper_bound="9", num_partitions=3).options()
    assert split["numPartitions"] == "3" and split["partitionColumn"] == "LOG_ID"
    with pytest.raises(ValueError):
        JdbcTable("jdbc:x", "LOG", partition_column="LOG_ID").options()
    with pytest.raises(ValueError, match="one task"):
        JdbcTable("jdbc:x", "LOG").options()
    with pytest.raises(ValueError):
        JdbcTable("jdbc:x", "LOG", partition_column="LOG_ID", lower_bound="0", upper_bound="9", predicates=("A = 1",)).options()


def test_jdbc_bounds_and_predicates(spark):
    asked = JdbcTable("jdbc:x", "LOG", partition_column="LOG_ID")
    assert asked.bounds_query() == "SELECT MIN(LOG_ID) AS lo, MAX(LOG_ID) AS hi FROM LOG"
    bounded = asked.with_bounds(3, 90).options()
    assert (bounded["lowerBound"], bounded["upperBound"], bounded["numPartitions"]) == ("3", "90", "32")
    assert asked.with_bounds(None, None).options() == {"url": "jdbc:x", "dbtable": "LOG", "fetchsize": "10000"}
    rows = spark.createDataFrame([(i, f"n'{i}", DAY if i % 3 else None) for i in range(20)] + [(None, None, None)], "id int, name string, day date")
    for column, cuts in (("id", [3, 11, 11, 17]), ("name", ["n'11", "n'4"]), ("day", [DAY]), ("id", [])):
        counts = [rows.where(p).count() for p in quantile_predicates(column, cuts)]
        assert sum(counts) == 21 and len(counts) == len(set(cuts)) + 1
