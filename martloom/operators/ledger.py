"""Run and step ledgers: lookups, joins, outcome counts, grids, timelines and statistics.

A pipeline or a run may own a large share of all rows. Newest-per-key and newest-N use a
ranked limit that Spark applies before its shuffle, everything else is pre-aggregated, and
nothing collects a run's steps into an array.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from martloom import schemas
from martloom.functions import schedules as S
from martloom.functions import text as X
from martloom.functions.dates import avg_duration_text, duration_text, parse_iso, seconds_between, timestamp_literal
from martloom.functions.numbers import round2
from martloom.functions.status import ACTIVE_STATUSES, STATUS_GROUPS, has_tone, tone
from martloom.operators.intervals import with_schedule
from martloom.operators.paging import Sort, page as take_page
from martloom.sources.storage import settle

RECENT_RUNS = 25
ACTIVITY_ROWS = 10
FAILURE_ROWS = 5


# --- ledger tables ---------------------------------------------------------------------

def typed_runs(raw: DataFrame) -> DataFrame:
    """Ledger text columns to dates and timestamps; unreadable text becomes null."""
    stamps = {c: parse_iso(F.col(c)) for c in ("started_at", "finished_at", "created_at")}
    dates = {"execution_date": F.col("execution_date").try_cast("date")}
    return schemas.conform(raw.withColumns({**stamps, **dates}), schemas.RUNS)


def typed_steps(raw: DataFrame) -> DataFrame:
    stamps = {c: parse_iso(F.col(c)) for c in ("started_at", "finished_at", "created_at")}
    return schemas.conform(raw.withColumns(stamps), schemas.STEPS)


def latest_state(events: DataFrame, key: str = "id", version: str = "recorded_at") -> DataFrame:
    """Current row per id of an append-only state log; of rows recorded at one time the one that differs last by its values."""
    others = [F.col(c).desc_nulls_last() for c in events.columns if c not in (key, version)]
    return newest(events, [key], [F.col(version).desc_nulls_last(), *others]).drop(version)


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def join_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows per key with one grouped row per key.

    The key's hash is a second join key. It adds nothing to the result, but it makes the
    grouped side pass through a shuffle of its own, and adaptive execution splits a hot key
    only where both sides come straight from a shuffle.
    """
    fence = F.hash(key)
    return rows.withColumn("_fence", fence).join(totals.withColumn("_fence", fence), [key, "_fence"]).drop("_fence")


# Newest first, ties by id.
NEWEST_FIRST = [Sort("created_at", descending=True), Sort("id", descending=True)]


def _newest_first() -> list[Column]:
    return [t.column for t in NEWEST_FIRST]


# --- lookups ---------------------------------------------------------------------------

def latest_run(runs: DataFrame, statuses: tuple[str, ...] | None = None,
               keys: tuple[str, ...] = ("pipeline_name", "execution_date")) -> DataFrame:
    """Newest run per key, optionally among some statuses only."""
    chosen = runs.where(F.col("status").isin(*statuses)) if statuses else runs
    return newest(chosen, list(keys), _newest_first())


def latest_success(runs: DataFrame) -> DataFrame:
    return latest_run(runs, ("success",))


def active_run(runs: DataFrame) -> DataFrame:
    return latest_run(runs, ACTIVE_STATUSES)


def active_any_date(runs: DataFrame) -> DataFrame:
    return latest_run(runs, ACTIVE_STATUSES, ("pipeline_name",))


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    return newest(runs, ["pipeline_name"], _newest_first(), limit)


def runs_page(runs: DataFrame, pipeline_name: str, number: int = 1, size: int = 50) -> DataFrame:
    return take_page(runs.where(F.col("pipeline_name") == pipeline_name), NEWEST_FIRST, number, size)


def runs_total(runs: DataFrame, pipeline_name: str) -> DataFrame:
    return runs.where(F.col("pipeline_name") == pipeline_name).agg(F.count(F.lit(1)).alias("total"))


# --- runs with steps -------------------------------------------------------------------

def run_with_steps(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Every run with its steps, one row per step; a run without steps keeps one row.

    Written as an inner join plus the runs that have no step, because a run holding very
    many steps can be split in an inner join but not on the optional side of an outer one.
    """
    s = steps.select(
        F.col("pipeline_run_id").alias("id"),
        "step_name",
        F.col("status").alias("step_status"),
        F.col("started_at").alias("step_started_at"),
        F.col("finished_at").alias("step_finished_at"),
        "records_processed",
        "error_message",
        "retry_count",
    )
    without = runs.join(steps.select(F.col("pipeline_run_id").alias("id")).distinct(), "id", "left_anti")
    return runs.join(s, "id").unionByName(without, allowMissingColumns=True)


def steps_of_pipeline(steps: DataFrame, runs: DataFrame, pipeline_name: str) -> DataFrame:
    """Steps whose run belongs to the pipeline: what a delete removes."""
    return steps.join(_run_ids(runs, pipeline_name), "pipeline_run_id", "left_semi").select(*steps.columns)


def steps_kept(steps: DataFrame, runs: DataFrame, pipeline_name: str) -> DataFrame:
    """Steps a delete of the pipeline's runs leaves behind."""
    return steps.join(_run_ids(runs, pipeline_name), "pipeline_run_id", "left_anti").select(*steps.columns)


def _run_ids(runs: DataFrame, pipeline_name: str) -> DataFrame:
    return runs.where(F.col("pipeline_name") == pipeline_name).select(F.col("id").alias("pipeline_run_id"))


def records_processed(runs: DataFrame, steps: DataFrame) -> DataFrame:
    loaded = steps.groupBy(F.col("pipeline_run_id").alias("id")).agg(F.sum("records_processed").alias("_records"))
    return runs.join(loaded, "id", "left").select(
        "id", "pipeline_name", F.coalesce("_records", F.lit(0)).alias("records_processed")
    )


def run_step_counts(runs: DataFrame, steps: DataFrame) -> DataFrame:
    counts = steps.groupBy(F.col("pipeline_run_id").alias("id")).agg(
        *[F.count_if(has_tone(F.col("status"), t)).alias(n) for t, n in (("ok", "ok"), ("bad", "bad"), ("warn", "running"))]
    )
    return runs.select("id").join(counts, "id", "left").na.fill(0, ["ok", "bad", "running"])


def first_failed_step(steps: DataFrame) -> DataFrame:
    """First failed step of each run that has one, in step order."""
    first = F.min_by(F.struct("step_name", "error_message"), F.struct("created_at", "id"))
    return (
        steps.where(has_tone(F.col("status"), "bad"))
        .groupBy(F.col("pipeline_run_id").alias("id"))
        .agg(first.alias("_first"))
        .select("id", "_first.step_name", "_first.error_message")
    )


def failure_text(steps: DataFrame, limit: int = 120) -> DataFrame:
    """``[step] message`` of the first failed step that has a message, long messages cut."""
    told = steps.where((F.col("status") == "failed") & (F.col("error_message") != ""))
    return first_failed_step(told).select(
        "id",
        F.concat(F.lit("["), F.coalesce("step_name", F.lit("")), F.lit("] "), X.shorten(F.col("error_message"), limit)).alias("failure"),
    )


# --- pipelines -------------------------------------------------------------------------

def pause_state(specs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Run-time state where one is set, else the configured one."""
    o = overrides.select("name", F.col("paused").alias("_override"))
    return specs.join(o, "name", "left").select(
        "name", F.coalesce("_override", "paused", F.lit(False)).alias("is_paused")
    )


def dataset_names(runs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each run's dataset: the mapped one, or the pipeline name."""
    return runs.join(mapping, "pipeline_name", "left").select(
        "id", "pipeline_name", F.coalesce("dataset_name", "pipeline_name").alias("dataset_name")
    )


def _planned(specs: DataFrame, overrides: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Configured pipelines with their pause state and next fire."""
    upcoming = S.next_fire("_cron", f"TIMESTAMP_NTZ '{as_of}'")
    planned = with_schedule(specs.join(pause_state(specs, overrides), "name"))
    return planned.withColumn("next_run", F.expr(f"CASE WHEN {S.is_cron('_cron')} THEN {upcoming} END")).select(
        "name", "table_name", "strategy", "schedule", "next_run", "is_paused", (~F.col("is_paused")).alias("is_active"))


_LATEST = {"latest_run_id": "id", "latest_execution_date": "execution_date", "latest_status": "status", "latest_started_at": "started_at",
           "latest_finished_at": "finished_at"}


def job_overview(specs: DataFrame, overrides: DataFrame, runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row per configured pipeline: pause state, next fire and newest run."""
    newest_run = latest_run(runs, keys=("pipeline_name",)).select(
        F.col("pipeline_name").alias("name"), *[F.col(c).alias(n) for n, c in _LATEST.items()])
    planned = _planned(specs, overrides, as_of)
    return planned.join(newest_run, "name", "left").select(*planned.columns, *_LATEST, tone(F.col("latest_status")).alias("latest_tone"))


def pipeline_overview(specs: DataFrame, overrides: DataFrame, runs: DataFrame, as_of: dt.datetime, limit: int = RECENT_RUNS) -> DataFrame:
    """The job overview with ``recent_runs``, an array of each pipeline's newest ``limit`` runs, newest first; empty without runs.

    Runs are limited for each pipeline before the shuffle, so an array never holds more than the limit.
    """
    run = F.struct("created_at", "id", "execution_date", "status", "trigger_type", "started_at", "finished_at")
    nested = recent_runs(runs, limit).groupBy(F.col("pipeline_name").alias("name")).agg(F.reverse(F.array_sort(F.collect_list(run))).alias("recent_runs"))
    planned = _planned(specs, overrides, as_of)
    joined = planned.join(nested, "name", "left")
    newest_of = lambda c: F.get("recent_runs", F.lit(0))[c]
    return joined.select(*planned.columns, *[newest_of(c).alias(n) for n, c in _LATEST.items()], tone(newest_of("status")).alias("latest_tone"),
                         F.coalesce("recent_runs", F.array().cast(nested.schema["recent_runs"].dataType)).alias("recent_runs"))


def overview_steps(overview: DataFrame, steps: DataFrame) -> DataFrame:
    """The recent runs of a pipeline overview with their steps, flat: a run without steps and a pipeline without runs keep a row.

    The few recent runs are stored first, so the step table is read for them alone.
    """
    runs = overview.select("name", F.posexplode_outer("recent_runs").alias("_at", "_run"))
    runs = settle(runs.select("name", (F.col("_at") + 1).alias("run_number"), "_run.id", "_run.status"), "recent-runs")
    with_run, without = runs.where("id IS NOT NULL"), runs.where("id IS NULL")
    return run_with_steps(with_run, steps).unionByName(without, allowMissingColumns=True).withColumnRenamed("id", "run_id")


def search(overview: DataFrame, query: str) -> DataFrame:
    return overview.where(X.contains_text(query, *[F.col(c) for c in ("name", "table_name", "strategy", "schedule")]))


def filter_state(overview: DataFrame, state: str) -> DataFrame:
    if state == "paused":
        return overview.where("is_paused")
    return overview.where(F.col("latest_tone") == state) if state in STATUS_GROUPS else overview


def browse(rows: DataFrame, query: str = "", search_columns: tuple[str, ...] = (), status: str = "",
           status_column: str = "status", equal: dict[str, str] | None = None,
           equal_ignoring_case: dict[str, str] | None = None) -> DataFrame:
    """List filter: text search over columns, status (blank or ``all`` keeps every row), equalities."""
    out = rows.where(X.any_column_contains(query, *[F.col(c) for c in search_columns]))
    wanted = status.strip().lower()
    if wanted not in ("", "all"):
        out = out.where(F.lower(status_column) == wanted)
    for column, value in (equal or {}).items():
        out = out.where(F.col(column) == value) if value else out
    for column, value in (equal_ignoring_case or {}).items():
        out = out.where(F.lower(column) == value.lower()) if value else out
    return out


def tone_counts(overview: DataFrame) -> DataFrame:
    return overview.agg(
        *[F.count_if(F.col("latest_tone") == t).alias(t) for t in STATUS_GROUPS], F.count_if("is_paused").alias("paused")
    )


def latest_finish(overview: DataFrame) -> DataFrame:
    return overview.agg(F.max("latest_finished_at").alias("latest_finish"))


def run_time() -> Column:
    return F.coalesce("finished_at", "started_at", F.col("execution_date").cast("timestamp_ntz"))


def recent_activity(runs: DataFrame, limit: int = ACTIVITY_ROWS, recent: int | None = None) -> DataFrame:
    """Newest runs over all pipelines, each giving all its runs or its newest ``recent``."""
    return (
        (recent_runs(runs, recent) if recent else runs)
        .withColumn("activity_at", run_time())
        .orderBy(F.col("activity_at").desc(), F.col("id").desc())
        .limit(limit)
        .select("id", "pipeline_name", "execution_date", "status", "trigger_type", "started_at", "finished_at", "activity_at")
    )


def recent_failures(runs: DataFrame, steps: DataFrame, limit: int = FAILURE_ROWS, recent: int | None = None) -> DataFrame:
    """Newest failed runs of each pipeline, among all or its ``recent`` newest runs, with their first failed step."""
    failed = newest(
        (recent_runs(runs, recent) if recent else runs).where(has_tone(F.col("status"), "bad")), ["pipeline_name"], _newest_first(), limit
    )
    failed = settle(failed.select("id", "pipeline_name", "execution_date", "status"), "failed-runs")
    theirs = steps.join(failed.select(F.col("id").alias("pipeline_run_id")), "pipeline_run_id", "left_semi")
    return failed.join(first_failed_step(theirs), "id", "left")


def run_summary(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Per pipeline: runs, outcomes and the number of distinct steps."""
    outcomes = runs.groupBy("pipeline_name").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(has_tone(F.col("status"), "ok")).alias("success_runs"),
        F.count_if(has_tone(F.col("status"), "warn")).alias("active_runs"),
        F.count_if(has_tone(F.col("status"), "bad")).alias("failed_runs"),
    )
    named = _steps_with_runs(steps.select("pipeline_run_id", "step_name"), runs.select("id", "pipeline_name"))
    names = named.groupBy("pipeline_name").agg(F.countDistinct("step_name").alias("task_count"))
    return outcomes.join(names, "pipeline_name", "left").na.fill(0, ["task_count"])


def _steps_with_runs(steps: DataFrame, runs: DataFrame) -> DataFrame:
    return steps.join(runs.withColumnRenamed("id", "pipeline_run_id"), "pipeline_run_id")


# --- steps over recent runs ------------------------------------------------------------

def recent_steps(recent: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps of some runs, with the run's pipeline and creation time."""
    return _steps_with_runs(steps, recent.select("id", "pipeline_name", F.col("created_at").alias("run_created_at")))


def step_order(rows: DataFrame) -> DataFrame:
    """Step names per pipeline in order of first appearance, newest run first.

    Takes ``recent_steps`` rows, as the functions below do.
    """
    recency = F.struct("run_created_at", "pipeline_run_id")
    in_run = rows.groupBy("pipeline_name", "step_name", "run_created_at", "pipeline_run_id").agg(F.min("created_at").alias("_first_at"))
    by_name = in_run.groupBy("pipeline_name", "step_name").agg(
        F.max(recency).alias("_run"), F.max_by("_first_at", recency).alias("_at")
    )
    rank = F.row_number().over(
        Window.partitionBy("pipeline_name").orderBy(
            F.col("_run.run_created_at").desc(), F.col("_run.pipeline_run_id").desc(), "_at", "step_name"
        )
    )
    return by_name.select("pipeline_name", "step_name", rank.alias("position"))


def latest_step_instance(rows: DataFrame) -> DataFrame:
    """The step row of each name taken from the newest run that has it."""
    newest_row = F.max_by(
        F.struct("pipeline_run_id", "status", "started_at", "finished_at", "error_message"),
        F.struct("run_created_at", "pipeline_run_id", "created_at", "id"),
    )
    grouped = rows.groupBy("pipeline_name", "step_name").agg(newest_row.alias("_row"))
    return grouped.select("pipeline_name", "step_name", "_row.*")


def step_outcomes(rows: DataFrame) -> DataFrame:
    """Success, running and failed counts per step name; a run counts once for a name, by its first such step."""
    first = F.min_by("status", F.struct("created_at", "id"))
    once = rows.groupBy("pipeline_name", "step_name", "pipeline_run_id").agg(first.alias("status"))
    return once.groupBy("pipeline_name", "step_name").agg(
        F.count_if(has_tone(F.col("status"), "ok")).alias("success_count"),
        F.count_if(has_tone(F.col("status"), "warn")).alias("running_count"),
        F.count_if(has_tone(F.col("status"), "bad")).alias("failed_count"),
    )


def run_grid(recent: DataFrame, steps: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Recent runs by the step names of their pipeline; an absent cell has status "" and tone neutral.

    ``recent`` must hold a limited number of runs per pipeline (``recent_runs``), so the
    grid is as large as that limit times the step names.
    """
    heads = settle(recent, "grid-runs")
    latest = F.max_by(F.struct("status", "started_at", "finished_at"), F.struct("created_at", F.col("id")))
    cells = settle(
        recent_steps(heads, steps)
        .groupBy("pipeline_name", F.col("pipeline_run_id").alias("id"), "step_name")
        .agg(latest.alias("_cell")),
        "grid-cells",
    )
    names = cells.select("pipeline_name", "step_name").distinct()
    cell = cells.select("id", "step_name", "_cell")
    return heads.select("id", "pipeline_name", "execution_date", "status").join(names, "pipeline_name").join(
        cell, ["id", "step_name"], "left"
    ).select(
        "id",
        "pipeline_name",
        "execution_date",
        "status",
        tone(F.col("status")).alias("tone"),
        "step_name",
        F.coalesce("_cell.status", F.lit("")).alias("step_status"),
        tone(F.col("_cell.status")).alias("step_tone"),
        duration_text(F.col("_cell.started_at"), F.col("_cell.finished_at"), timestamp_literal(as_of)).alias("step_duration"),
    )


def run_graph(runs: DataFrame, steps: DataFrame, as_of: dt.datetime, recent: int = RECENT_RUNS) -> DataFrame:
    """Steps of each pipeline's newest run as graph nodes in step order.

    A pipeline whose newest run has no steps shows the step names of its ``recent`` runs, with status unknown.
    """
    known_runs = settle(recent_runs(runs, recent), "graph-runs")
    known = settle(recent_steps(known_runs, steps), "graph-steps")
    head = latest_run(known_runs, keys=("pipeline_name",)).select(F.col("id").alias("pipeline_run_id"))
    rows = known.join(head, "pipeline_run_id", "left_semi")
    nodes = latest_step_instance(rows).join(step_order(rows), ["pipeline_name", "step_name"])
    without = step_order(known.join(rows.select("pipeline_name").distinct(), "pipeline_name", "left_anti"))
    shown = nodes.unionByName(without.withColumn("status", F.lit("unknown")), allowMissingColumns=True)
    return shown.select(
        "pipeline_name",
        "position",
        F.col("step_name").alias("name"),
        "status",
        tone(F.col("status")).alias("tone"),
        duration_text(F.col("started_at"), F.col("finished_at"), timestamp_literal(as_of)).alias("duration"),
    )


# --- timelines -------------------------------------------------------------------------

def run_envelope(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Earliest start and latest end over a run and its steps; both null for a run without any start."""
    bounds = steps.groupBy(F.col("pipeline_run_id").alias("id")).agg(
        F.min("started_at").alias("_first_start"),
        F.max("started_at").alias("_last_start"),
        F.max("finished_at").alias("_last_end"),
    )
    return (
        runs.select("id", "pipeline_name", "started_at", "finished_at")
        .join(bounds, "id", "left")
        .select(
            "id",
            "pipeline_name",
            F.least("started_at", "_first_start").alias("window_start"),
            F.coalesce(F.greatest("finished_at", "_last_end"), F.greatest("started_at", "_last_start")).alias("_end"),
        )
        .select("id", "pipeline_name", "window_start", F.when(F.col("window_start").isNotNull(), F.greatest("_end", "window_start")).alias("window_end"))
    )


def place_on_timeline(df: DataFrame) -> DataFrame:
    """Add ``start_pct`` and ``width_pct`` of a step inside ``window_start`` .. ``window_end``."""
    span = F.greatest(seconds_between(F.col("window_start"), F.col("window_end")), F.lit(1.0))
    offset = F.greatest(seconds_between(F.col("window_start"), F.col("started_at")), F.lit(0.0))
    length = F.greatest(
        seconds_between(F.col("started_at"), F.coalesce("finished_at", "started_at")), F.lit(0.0)
    )
    start = F.least(F.lit(100.0), (F.col("_offset") / F.col("_span")) * 100.0)
    floor = F.when(F.col("_length") == 0, 0.5).otherwise(1.0)
    width = F.least(
        F.greatest(floor, (F.col("_length") / F.col("_span")) * 100.0), F.greatest(F.lit(0.5), 100.0 - F.col("_start"))
    )
    placed = F.col("started_at").isNotNull() & F.col("window_start").isNotNull()
    return (
        df.withColumns({"_span": span, "_offset": offset, "_length": length})
        .withColumn("_start", F.when(placed, start))
        .withColumns({"start_pct": round2(F.col("_start")), "width_pct": round2(F.when(placed, width))})
        .drop("_span", "_offset", "_length", "_start")
    )


def step_timeline(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Every step as a bar inside its run; steps of a run without any start have null percentages."""
    s = steps.select(F.col("pipeline_run_id").alias("id"), "step_name", "started_at", "finished_at")
    return place_on_timeline(join_totals(s, run_envelope(runs, steps), "id")).select("id", "step_name", "start_pct", "width_pct")


def task_rows(recent: DataFrame, steps: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row per step name: latest state, outcome counts and its bar in the newest run's window."""
    heads = settle(recent, "task-runs")
    seen = settle(recent_steps(heads, steps), "task-steps")
    window = run_envelope(latest_run(heads, keys=("pipeline_name",)), seen).drop("id")
    keys = ["pipeline_name", "step_name"]
    rows = (
        latest_step_instance(seen)
        .join(step_outcomes(seen), keys)
        .join(step_order(seen), keys)
        .join(window, "pipeline_name", "left")
    )
    return place_on_timeline(rows).select(
        "pipeline_name",
        "position",
        F.col("step_name").alias("name"),
        F.coalesce("status", F.lit("")).alias("latest_status"),
        tone(F.col("status")).alias("latest_tone"),
        "success_count",
        "running_count",
        "failed_count",
        duration_text(F.col("started_at"), F.col("finished_at"), timestamp_literal(as_of)).alias("latest_duration"),
        "start_pct",
        "width_pct",
    )


def step_bars(steps: DataFrame, as_of: dt.datetime, max_left: float = 98.0, min_width: float = 1.5) -> DataFrame:
    """Bars of the run page: relative to the run's steps alone, an open step runs to ``as_of``."""
    now = timestamp_literal(as_of)
    bounds = steps.groupBy("pipeline_run_id").agg(
        F.coalesce(F.min("started_at"), now).alias("_from"), F.coalesce(F.max("finished_at"), now).alias("_to")
    )
    span = F.greatest(F.lit(1.0), seconds_between(F.col("_from"), F.col("_to")))
    length = F.greatest(F.lit(0.0), seconds_between(F.col("started_at"), F.coalesce("finished_at", now)))
    left = F.least(F.lit(max_left), seconds_between(F.col("_from"), F.col("started_at")) / F.col("_span") * 100)
    width = F.least(F.greatest(F.lit(min_width), F.col("_length") / F.col("_span") * 100), 100.0 - F.col("_left"))
    started = F.col("started_at").isNotNull()
    records = F.when(F.col("records_processed") != 0, F.col("records_processed").cast("string"))
    return (
        join_totals(steps, bounds, "pipeline_run_id")
        .withColumns({"_span": span, "_length": length})
        .withColumn("_left", left)
        .select(
            "pipeline_run_id",
            "step_name",
            "status",
            tone(F.col("status")).alias("tone"),
            duration_text(F.col("started_at"), F.col("finished_at"), now).alias("duration"),
            records.alias("records_display"),
            "retry_count",
            F.when(started, F.col("_left")).otherwise(F.lit(0.0)).alias("bar_left_pct"),
            F.when(started, width).otherwise(F.lit(100.0)).alias("bar_width_pct"),
        )
    )


def run_events(runs: DataFrame, steps: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Start and finish events of runs and steps, ordered by time within a run."""

    def event(at: Column, level: Column, title: Column, detail: Column, rank: int) -> Column:
        return F.struct(
            at.alias("timestamp"), level.alias("tone"), title.alias("title"), detail.alias("detail"), F.lit(rank).alias("_rank")
        )

    status = F.col("status")
    of_runs = runs.select(
        F.col("id").alias("run_id"),
        F.inline(F.array(
            event(F.col("started_at"), F.when(has_tone(status, "warn"), "warn").otherwise("neutral"), F.lit("Run started"),
                  F.concat(F.lit("Trigger: "), F.coalesce("trigger_type", F.lit("-"))), 0),
            event(F.col("finished_at"), tone(status), F.lit("Run finished"),
                  F.concat(F.lit("Final state: "), F.coalesce(status, F.lit("-"))), 3),
        )),
    )
    took = duration_text(F.col("started_at"), F.col("finished_at"), timestamp_literal(as_of))
    message = F.when(F.col("error_message") != "", F.col("error_message"))
    of_steps = steps.select(
        F.col("pipeline_run_id").alias("run_id"),
        F.inline(F.array(
            event(F.col("started_at"), F.lit("warn"), F.concat(F.lit("Task started: "), "step_name"),
                  F.concat(F.lit("State: "), status), 1),
            event(F.col("finished_at"), tone(status), F.concat(F.lit("Task finished: "), "step_name"),
                  F.coalesce(message, F.concat(F.lit("Duration: "), took)), 2),
        )),
    )
    return (
        of_runs.unionByName(of_steps)
        .where(F.col("timestamp").isNotNull())
        .orderBy("run_id", "timestamp", "_rank", "title")
        .drop("_rank")
    )


# --- statistics ------------------------------------------------------------------------

def stats_24h(runs: DataFrame, steps: DataFrame, as_of: dt.datetime, recent_limit: int | None = None) -> DataFrame:
    """Last 24 hours (both ends in) against the 24 hours before."""
    now = timestamp_literal(as_of)
    day_ago, two_days_ago = (timestamp_literal(as_of - dt.timedelta(hours=h)) for h in (24, 48))
    base = recent_runs(runs, recent_limit) if recent_limit else runs
    seen = settle(
        base.withColumn("_at", run_time())
        .where((F.col("_at") >= two_days_ago) & (F.col("_at") <= now))
        .withColumn("_current", F.col("_at") >= day_ago),
        "day-runs",
    )
    failures = (
        steps.where(has_tone(F.col("status"), "bad"))
        .join(seen.where("_current").select(F.col("id").alias("pipeline_run_id")), "pipeline_run_id", "left_semi")
        .groupBy(F.col("pipeline_run_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("_failed"))
    )
    current = F.col("_current")
    timed = current & (F.col("finished_at") >= F.col("started_at"))
    totals = seen.join(failures, "id", "left").agg(
        F.count_if(current).alias("total_runs_24h"),
        F.count_if(~current).alias("previous_runs_24h"),
        F.count_if(current & has_tone(F.col("status"), "ok")).alias("_ok"),
        F.coalesce(F.sum(F.when(current, F.col("_failed"))), F.lit(0)).alias("failed_tasks"),
        F.countDistinct(F.when(current & (F.col("_failed") > 0), F.col("pipeline_name"))).alias("failed_dags"),
        F.sum(F.when(timed, seconds_between(F.col("started_at"), F.col("finished_at")).cast("decimal(24,6)"))).alias("_seconds"),
        F.count_if(timed).alias("_timed"),
    )
    return totals.select(
        "total_runs_24h",
        "previous_runs_24h",
        X.percent_change_text(F.col("total_runs_24h"), F.col("previous_runs_24h")).alias("runs_change"),
        X.success_rate_text(F.col("_ok"), F.col("total_runs_24h")).alias("success_rate"),
        "failed_tasks",
        "failed_dags",
        avg_duration_text(F.col("_seconds").cast("double"), F.col("_timed")).alias("avg_duration"),
    )
