import datetime as dt

import pytest
from pyspark.sql import functions as F

from martloom import schemas
from martloom.operators import ledger as L

T0 = dt.datetime(2026, 3, 1, 10)
AS_OF = dt.datetime(2026, 3, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(id, pipeline="p", status="success", start=0, end=60, created=None, day=dt.date(2026, 3, 1)):
    s, e = (None if v is None else at(v) for v in (start, end))
    return (id, pipeline, day, status, s, e, "manual", at(created if created is not None else (start or 0)))


def step(run_id, name, status="success", start=0, end=30, n=1, error=None, created=None):
    s, e = (None if v is None else at(v) for v in (start, end))
    return (f"{run_id}/{name}", run_id, name, status, s, e, n, error, 0, at(created if created is not None else (start or 0)))


@pytest.fixture
def frames(spark):
    def make(runs, steps=()):
        return spark.createDataFrame(list(runs), schemas.RUNS), spark.createDataFrame(list(steps), schemas.STEPS)

    return make


def test_typed_ledger(spark):
    raw = spark.createDataFrame([("1", "p", "2026-03-01", "success", "2026-03-01T10:00:00Z", None, "manual", "bad")], ", ".join(
        f"{f.name} string" for f in schemas.RUNS))
    got = L.typed_runs(raw).first()
    assert (got.execution_date, got.started_at, got.finished_at, got.created_at) == (dt.date(2026, 3, 1), T0, None, None)


def test_latest_state_of_an_append_only_log(spark):
    log = spark.createDataFrame([("a", "queued", 1), ("a", "running", 2), ("b", "queued", 1)], "id string, status string, recorded_at int")
    assert sorted(tuple(r) for r in L.latest_state(log).collect()) == [("a", "running"), ("b", "queued")]


def test_newest_run_and_ties(frames):
    runs, _ = frames([run("1", created=5), run("2", created=5), run("3", created=1), run("4", "q", "failed")])
    assert {r.pipeline_name: r.id for r in L.latest_run(runs).collect()} == {"p": "2", "q": "4"}
    assert [r.id for r in L.latest_success(runs).collect()] == ["2"]
    assert [r.id for r in L.recent_runs(runs, 2).where("pipeline_name = 'p'").orderBy("id").collect()] == ["1", "2"]
    assert L.active_any_date(runs).count() == 0


def test_runs_without_steps_stay(frames):
    runs, steps = frames([run("1"), run("2")], [step("1", "a"), step("1", "b", "failed")])
    assert L.run_with_steps(runs, steps).count() == 3
    counts = {r.id: (r.ok, r.bad, r.running) for r in L.run_step_counts(runs, steps).collect()}
    assert counts == {"1": (1, 1, 0), "2": (0, 0, 0)}
    assert {r.id: r.records_processed for r in L.records_processed(runs, steps).collect()} == {"1": 2, "2": 0}
    assert L.run_summary(runs, steps.where("false")).first().task_count == 0


def test_first_failure(frames):
    _, steps = frames([], [
        step("1", "a"), step("1", "c", "failed", 20, error="late"), step("1", "b", "FAILED", 10, error="x" * 130),
        step("2", "a", "failed", error=None)])
    got = {r.id: (r.step_name, r.error_message) for r in L.first_failed_step(steps).collect()}
    assert got == {"1": ("b", "x" * 130), "2": ("a", None)}
    texts = {r.id: r.failure for r in L.failure_text(steps).collect()}
    assert texts == {"1": "[c] late"}


def test_recent_failures(frames):
    runs, steps = frames([run(str(i), status="failed", start=i) for i in range(8)] + [run("9", start=9)],
                         [step("7", "a", "failed", error="boom")])
    got = {r.id: r.step_name for r in L.recent_failures(runs, steps).collect()}
    assert got == {"7": "a", "6": None, "5": None, "4": None, "3": None}
    assert {r.id for r in L.recent_failures(runs, steps, recent=3).collect()} == {"7", "6"}


def test_grid_is_dense(frames):
    runs, steps = frames([run("1"), run("2", start=100)], [step("1", "a"), step("2", "b", "running", 100, None)])
    cells = {(r.id, r.step_name): (r.step_status, r.step_tone, r.step_duration) for r in L.run_grid(runs, steps, AS_OF).collect()}
    assert cells == {
        ("1", "a"): ("success", "ok", "30s"), ("1", "b"): ("", "neutral", "-"),
        ("2", "a"): ("", "neutral", "-"), ("2", "b"): ("running", "warn", "1h 58m")}


def test_step_order_is_first_seen_newest_run_first(frames):
    runs, steps = frames([run("1"), run("2", start=100)],
                         [step("1", "a"), step("1", "old", start=5), step("2", "b", start=101), step("2", "a", start=102)])
    assert [r.step_name for r in L.step_order(L.recent_steps(runs, steps)).orderBy("position").collect()] == ["b", "a", "old"]
    latest = {r.step_name: r.pipeline_run_id for r in L.latest_step_instance(L.recent_steps(runs, steps)).collect()}
    assert latest == {"a": "2", "b": "2", "old": "1"}


def test_timeline_clamps(frames):
    runs, steps = frames([run("1", start=0, end=100)],
                         [step("1", "whole", start=0, end=100), step("1", "point", start=50, end=50),
                          step("1", "tiny", start=0, end=0.1), step("1", "last", start=100, end=None),
                          step("1", "back", start=40, end=20), step("1", "none", start=None, end=None, created=0)])
    got = {r.step_name: (r.start_pct, r.width_pct) for r in L.step_timeline(runs, steps).collect()}
    assert got == {"whole": (0.0, 100.0), "point": (50.0, 0.5), "tiny": (0.0, 1.0), "last": (100.0, 0.5), "back": (40.0, 0.5),
                   "none": (None, None)}


def test_window_without_any_end_or_start(frames):
    runs, steps = frames([run("1", start=0, end=None), run("2", start=None, end=None)],
                         [step("1", "a", start=7, end=None)])
    got = {r.id: (r.window_start, r.window_end) for r in L.run_envelope(runs, steps).collect()}
    assert got == {"1": (at(0), at(7)), "2": (None, None)}
    bars = {r.id: r.start_pct for r in L.step_timeline(runs, frames([], [step("1", "a"), step("2", "b", start=None, end=None)])[1]).collect()}
    assert bars == {"1": 0.0, "2": None}


def test_task_rows_use_the_newest_runs_window(frames):
    runs, steps = frames([run("1", start=0, end=50), run("2", start=1000, end=1100)],
                         [step("1", "gone", "failed", 0, 50), step("1", "a", start=0, end=10), step("2", "a", start=1050, end=1100)])
    got = {r.name: r for r in L.task_rows(runs, steps, AS_OF).collect()}
    assert (got["a"].start_pct, got["a"].width_pct, got["a"].success_count) == (50.0, 50.0, 2)
    assert (got["gone"].start_pct, got["gone"].width_pct, got["gone"].failed_count, got["gone"].latest_tone) == (0.0, 50.0, 1, "bad")


def test_bars_of_the_run_page(frames):
    _, steps = frames([], [step("1", "a", start=0, end=10), step("1", "b", start=10, end=10), step("1", "c", start=None, end=None, created=3),
                           step("1", "d", start=9.9, end=None)])
    got = {r.step_name: (r.bar_left_pct, r.bar_width_pct) for r in L.step_bars(steps, AS_OF).collect()}
    assert got["a"] == (0.0, 100.0) and got["b"] == (98.0, 1.5) and got["c"] == (0.0, 100.0)
    assert got["d"][0] == 98.0 and got["d"][1] == 2.0


def test_events(frames):
    runs, steps = frames([run("1", status="running", start=0, end=None)],
                         [step("1", "a", start=0, end=30), step("1", "b", "failed", 30, 40, error="boom")])
    got = [(r.title, r.tone, r.detail) for r in L.run_events(runs, steps, AS_OF).collect()]
    assert got == [
        ("Run started", "warn", "Trigger: manual"), ("Task started: a", "warn", "State: success"),
        ("Task started: b", "warn", "State: failed"), ("Task finished: a", "ok", "Duration: 30s"),
        ("Task finished: b", "bad", "boom")]


def test_day_statistics(frames):
    day = 86400
    end = int((AS_OF - T0).total_seconds())
    runs, steps = frames(
        [run("edge", start=end - day - 10, end=end - day), run("now", "q", start=end, end=None, status="running"),
         run("before", start=end - day - 10, end=end - day - 1), run("old", start=end - 2 * day, end=end - 2 * day),
         run("older", start=end - 3 * day, end=end - 3 * day), run("later", start=end + 1, end=end + 1),
         run("odd", "q", "failed", start=end - 5, end=end - 9)],
        [step("odd", "a", "failed"), step("odd", "b", "failed"), step("before", "a", "failed")])
    got = L.stats_24h(runs, steps, AS_OF).first()
    assert tuple(got) == (3, 2, "+50%", "33%", 2, 1, "10s")
    assert tuple(L.stats_24h(runs.where("false"), steps, AS_OF).first()) == (0, 0, "+0%", "0%", 0, 0, "-")


def test_activity_falls_back_to_start_and_date(frames):
    runs, _ = frames([run("1", start=0, end=500), run("2", start=300, end=None), run("3", start=None, end=None, created=9)])
    assert [r.id for r in L.recent_activity(runs, 3).collect()] == ["1", "2", "3"]


def test_browse_and_states(spark):
    rows = spark.createDataFrame([("Alpha", "OK", "x", None), ("beta", "bad", "y", "alp")], "name string, status string, user string, note string")
    assert L.browse(rows, " ALP ", ("name", "note")).count() == 2
    assert L.browse(rows, "alp", ("name",), "ok").count() == 1
    assert L.browse(rows, "", (), "All", equal={"user": ""}).count() == 2
    assert L.browse(rows, equal={"user": "y"}, equal_ignoring_case={"status": "BAD"}).count() == 1
    overview = spark.createDataFrame([("a", "ok", True), ("b", "bad", False)], "name string, latest_tone string, is_paused boolean")
    assert [L.filter_state(overview, s).count() for s in ("ok", "paused", "unknown")] == [1, 1, 2]


def test_pause_override_wins(spark):
    specs = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "name string, paused boolean")
    over = spark.createDataFrame([("a", False)], "name string, paused boolean")
    assert {r.name: r.is_paused for r in L.pause_state(specs, over).collect()} == {"a": False, "b": False, "c": False}


def test_graph_of_a_newest_run_without_steps(frames):
    runs, steps = frames([run("1"), run("2", start=100), run("3", "q")], [step("1", "a"), step("1", "b", start=5), step("3", "c")])
    got = sorted((r.pipeline_name, r.position, r.name, r.status) for r in L.run_graph(runs, steps, AS_OF).collect())
    assert got == [("p", 1, "a", "unknown"), ("p", 2, "b", "unknown"), ("q", 1, "c", "success")]


def test_repeated_steps_of_a_run(frames, spark):
    runs, _ = frames([run("1")])
    rows = [("s1", "1", "a", "failed", at(0), at(1), 0, None, 0, at(0)), ("s2", "1", "a", "success", at(2), at(3), 0, None, 1, at(2)),
            ("s3", "1", "b", "success", at(1), at(2), 0, None, 0, at(1))]
    seen = L.recent_steps(runs, spark.createDataFrame(rows, schemas.STEPS))
    assert {(r.step_name, r.success_count, r.failed_count) for r in L.step_outcomes(seen).collect()} == {("a", 0, 1), ("b", 1, 0)}
    assert {r.step_name: r.position for r in L.step_order(seen).collect()} == {"a": 1, "b": 2}
    assert {r.step_name: r.status for r in L.latest_step_instance(seen).collect()}["a"] == "success"


def test_activity_covers_all_runs_unless_limited(frames):
    runs, _ = frames([run(str(i), start=i) for i in range(40)])
    assert L.recent_activity(runs, 40).count() == 40 and L.recent_activity(runs, 40, recent=25).count() == 25
