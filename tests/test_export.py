import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from martloom.operators import export as E
from martloom.sources.jobs import read_jobs

NOW = dt.datetime(2026, 4, 6, 9)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3).select(F.concat(F.lit("SRC_"), "id").alias("source_name"), F.col("id").alias("row_count"))


def test_row_guard_leaves_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(E.RowLimitExceeded):
        E.export(rows, path, "xlsx", max_rows=2)
    assert not os.path.exists(path)
    E.export(rows, path, "xlsx", max_rows=3)
    assert spark.read.option("header", True).csv(path).count() == 3
    with pytest.raises(ValueError):
        E.guard_rows(rows, 0)
    with pytest.raises(ValueError):
        E.export(rows, path, "pdf")


def test_guard_applies_to_any_format(rows, tmp_path):
    with pytest.raises(E.RowLimitExceeded):
        E.export(rows, str(tmp_path / "p"), "parquet", max_rows=1)


@pytest.mark.parametrize("fmt,suffix", [("parquet", ".snappy.parquet"), ("csv.zip", ".csv.gz")])
def test_default_codecs(rows, tmp_path, fmt, suffix):
    E.export(rows, str(tmp_path / "o"), fmt)
    assert any(n.endswith(suffix) for n in os.listdir(tmp_path / "o"))


def job(id, dataset, status, age, row_count=None):
    created = NOW - dt.timedelta(hours=age)
    return {"job_id": id, "dataset": dataset, "action_key": "parquet_export", "status": status, "format": "parquet",
            "created_at": created.isoformat(), "updated_at": created.isoformat(),
            "expires_at": (created + dt.timedelta(hours=72)).isoformat(), "file_name": f"{id}.parquet",
            "artifact_path": f"/a/{id}.parquet", "row_count": row_count, "error_message": None}


@pytest.fixture
def jobs(spark, tmp_path):
    for j in (job("a", "x", "completed", 1, 5), job("b", "x", "queued", 1), job("c", "y", "running", 72), job("d", "x", "failed", 71.9)):
        (tmp_path / f"{j['job_id']}.json").write_text(json.dumps(j, indent=2))
    (tmp_path / "note.txt").write_text("not a job")
    return read_jobs(spark, str(tmp_path))


def test_jobs(jobs):
    assert jobs.count() == 4
    assert [r.job_id for r in E.list_jobs(jobs).collect()] == ["b", "a", "d", "c"]
    assert [r.job_id for r in E.list_jobs(jobs, "x", 2).collect()] == ["b", "a"]
    assert tuple(E.job_counts(jobs).first()) == (1, 1, 1)
    assert [r.job_id for r in E.expired_jobs(jobs, NOW).collect()] == ["c"]
    assert [tuple(r) for r in E.completed_jobs(jobs).collect()] == [("a", "/a/a.parquet", 5)]
    assert E.with_expiry(jobs.drop("expires_at")).where("job_id = 'c'").first().expires_at == NOW


def test_guard_sorts_nothing(spark, rows):
    seen = []
    agg = rows.orderBy("row_count").agg(F.count(F.lit(1)))
    seen.append(agg._jdf.queryExecution().executedPlan().toString())
    assert "Sort" not in seen[0] and "Limit" not in seen[0]


def test_written_rows_are_counted_for_capped_and_empty_exports(spark, rows, tmp_path):
    root = str(tmp_path / "x")
    assert E.run_export(rows, root, "j1", "d", "xlsx_export", NOW, max_rows=3).first()["row_count"] == 3
    assert E.run_export(rows.where("row_count > 99"), root, "j2", "d", "csv_zip_export", NOW).first()["row_count"] == 0
    assert E.run_export(rows, root, "j3", "d", "xlsx_export", NOW, max_rows=2).first()["status"] == "failed"
    assert sorted(r.job_id for r in read_jobs(spark, f"{root}/jobs", one_per_file=False).collect()) == ["j1", "j2", "j3"]


def test_cleanup_removes_artifacts_and_records(spark, rows, tmp_path):
    root = str(tmp_path / "x")
    for name, hours in (("a", 100), ("b", 72), ("c", 71.9), ("d", 1)):
        E.run_export(rows, root, name, "d", "parquet_export", NOW - dt.timedelta(hours=hours))
    left = lambda: sorted(r.job_id for r in read_jobs(spark, f"{root}/jobs", one_per_file=False).collect())
    files = lambda: sorted(n for _, names, _ in os.walk(f"{root}/artifacts") for n in names if n.endswith(".parquet"))
    E.remove_expired(spark, root, NOW)
    assert left() == ["c", "d"] and files() == ["c.parquet", "d.parquet"]
    E.remove_completed(spark, root)
    assert not os.listdir(f"{root}/jobs") or left() == []
    assert files() == []
