"""Run ledger lookups, joins, counts, grids, timelines and statistics."""

from pyspark.sql import functions as F

from martloom.operators import ledger as L
from martloom.operators.paging import rank_slice
from martloom.plans import intervals as PI
from martloom.plans.base import AS_OF, RUNS, SPECS, STEPS, clock, duration, seconds, tone, two_decimals, with_
from martloom.sources.tables import dataset_mapping as mapping
from martloom.sources.tables import pause_overrides, pipeline_specs, runs, steps

_PIPELINE = "2-HIGH"


def latest_run(spark, sf_dir):
    return L.latest_run(runs(spark, sf_dir))


def latest_success(spark, sf_dir):
    return L.latest_success(runs(spark, sf_dir))


def active_run(spark, sf_dir):
    return L.active_run(runs(spark, sf_dir))


def active_any(spark, sf_dir):
    return L.active_any_date(runs(spark, sf_dir))


def recent_runs(spark, sf_dir):
    return L.recent_runs(runs(spark, sf_dir), 10)


def runs_page(spark, sf_dir):
    return L.runs_page(runs(spark, sf_dir), _PIPELINE, 3, 50)


def runs_page_deep(spark, sf_dir):
    """A page far down the order of all runs, found by counting ranges."""
    return rank_slice(runs(spark, sf_dir), L.NEWEST_FIRST, 1000, 75)


def typed_runs(spark, sf_dir):
    """The ledger as text, the way it is recorded, with its columns typed again."""
    def iso(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")

    text = runs(spark, sf_dir).withColumns(
        {c: iso(F.col(c)) for c in ("started_at", "finished_at", "created_at")} | {"execution_date": F.col("execution_date").cast("string")}
    )
    return L.typed_runs(text)


def latest_state(spark, sf_dir):
    """Runs recorded as state changes: queued, started, finished; the newest state of each."""
    r = runs(spark, sf_dir)
    states = F.array(
        F.struct(F.lit("queued").alias("status"), F.lit(1).alias("recorded_at")),
        F.when(F.col("status") != "queued", F.struct(F.lit("running").alias("status"), F.lit(2).alias("recorded_at"))),
        F.when(F.col("status").isin("success", "failed"), F.struct(F.col("status"), F.lit(3).alias("recorded_at"))),
    )
    log = r.select("id", "pipeline_name", F.explode(F.filter(states, lambda s: s.isNotNull())).alias("_s"))
    return L.latest_state(log.select("id", "pipeline_name", "_s.*"))


def runs_total(spark, sf_dir):
    return L.runs_total(runs(spark, sf_dir), _PIPELINE)


def run_with_steps(spark, sf_dir):
    return L.run_with_steps(runs(spark, sf_dir), steps(spark, sf_dir))


def ledger_delete_semi(spark, sf_dir):
    return L.steps_of_pipeline(steps(spark, sf_dir), runs(spark, sf_dir), _PIPELINE)


def ledger_delete_anti(spark, sf_dir):
    return L.steps_kept(steps(spark, sf_dir), runs(spark, sf_dir), _PIPELINE)


def records_processed(spark, sf_dir):
    return L.records_processed(runs(spark, sf_dir), steps(spark, sf_dir))


def run_step_counts(spark, sf_dir):
    return L.run_step_counts(runs(spark, sf_dir), steps(spark, sf_dir))


def first_failed_step(spark, sf_dir):
    return L.first_failed_step(steps(spark, sf_dir))


def failure_text(spark, sf_dir):
    return L.failure_text(steps(spark, sf_dir), 9)


def pause_state(spark, sf_dir):
    return L.pause_state(pipeline_specs(spark, sf_dir), pause_overrides(spark, sf_dir))


def dataset_names(spark, sf_dir):
    return L.dataset_names(runs(spark, sf_dir), mapping(spark, sf_dir))


def job_overview(spark, sf_dir):
    return L.job_overview(pipeline_specs(spark, sf_dir), pause_overrides(spark, sf_dir), runs(spark, sf_dir), AS_OF)


def pipeline_overview(spark, sf_dir):
    """The newest three runs of each pipeline with their steps, in flat form; one pipeline has never run."""
    specs = pipeline_specs(spark, sf_dir)
    idle = specs.orderBy("name").limit(1).withColumn("name", F.lit("0-IDLE"))
    nested = L.pipeline_overview(specs.unionByName(idle), pause_overrides(spark, sf_dir), runs(spark, sf_dir), AS_OF, 3)
    flat = L.overview_steps(nested, steps(spark, sf_dir))
    return nested.select("name", "next_run", "is_paused", "latest_run_id", "latest_tone", F.size("recent_runs").alias("shown")).join(
        flat.select("name", "run_number", "run_id", "status", "step_name", "step_status", "records_processed", "error_message"), "name")


def ledger_search(spark, sf_dir):
    return L.search(job_overview(spark, sf_dir), " Incremental 0 ")


def ledger_filter_state(spark, sf_dir):
    """The three tone filters, the paused filter and no filter, stacked."""
    overview = job_overview(spark, sf_dir)
    out = None
    for state in ("ok", "warn", "bad", "paused", "all"):
        part = L.filter_state(overview, state).select(F.lit(state).alias("state"), "name")
        out = part if out is None else out.unionByName(part)
    return out


def ledger_browse(spark, sf_dir):
    """List filter over all runs: text in any of two columns, status, exact and caseless equality."""
    return L.browse(runs(spark, sf_dir), " 7", ("id", "execution_date"), " FAILED ",
                    equal={"pipeline_name": _PIPELINE}, equal_ignoring_case={"trigger_type": "Manual"})


def tone_counts(spark, sf_dir):
    return L.tone_counts(job_overview(spark, sf_dir))


def latest_finish(spark, sf_dir):
    return L.latest_finish(job_overview(spark, sf_dir))


def recent_activity(spark, sf_dir):
    return L.recent_activity(runs(spark, sf_dir), 20)


def recent_failures(spark, sf_dir):
    return L.recent_failures(runs(spark, sf_dir), steps(spark, sf_dir))


def run_summary(spark, sf_dir):
    return L.run_summary(runs(spark, sf_dir), steps(spark, sf_dir))


def run_summary_recent(spark, sf_dir):
    return L.run_summary(L.recent_runs(runs(spark, sf_dir)), steps(spark, sf_dir))


def _recent(spark, sf_dir):
    return L.recent_runs(runs(spark, sf_dir)), steps(spark, sf_dir)


def step_order(spark, sf_dir):
    return L.step_order(L.recent_steps(*_recent(spark, sf_dir)))


def latest_step_instance(spark, sf_dir):
    return L.latest_step_instance(L.recent_steps(*_recent(spark, sf_dir)))


def step_outcomes(spark, sf_dir):
    return L.step_outcomes(L.recent_steps(runs(spark, sf_dir), steps(spark, sf_dir)))


def ledger_grid(spark, sf_dir):
    return L.run_grid(*_recent(spark, sf_dir), AS_OF)


def run_graph(spark, sf_dir):
    return L.run_graph(runs(spark, sf_dir), steps(spark, sf_dir), AS_OF)


def step_timeline(spark, sf_dir):
    return L.step_timeline(runs(spark, sf_dir), steps(spark, sf_dir))


def task_rows(spark, sf_dir):
    return L.task_rows(*_recent(spark, sf_dir), AS_OF)


def step_bars(spark, sf_dir):
    return L.step_bars(steps(spark, sf_dir), AS_OF)


def run_events(spark, sf_dir):
    return L.run_events(runs(spark, sf_dir), steps(spark, sf_dir), AS_OF)


def stats_24h(spark, sf_dir):
    return L.stats_24h(runs(spark, sf_dir), steps(spark, sf_dir), AS_OF)


def stats_24h_recent(spark, sf_dir):
    """The same over each pipeline's newest runs, as of the newest start."""
    return L.stats_24h(runs(spark, sf_dir), steps(spark, sf_dir), AS_OF, recent_limit=400)


QUERIES = {
    f.__name__: f
    for f in (
        latest_run, latest_success, active_run, active_any, recent_runs, runs_page, runs_page_deep, typed_runs, latest_state, runs_total, run_with_steps,
        ledger_delete_semi, ledger_delete_anti, records_processed, run_step_counts, first_failed_step, failure_text,
        pause_state, dataset_names, job_overview, pipeline_overview, ledger_search, ledger_filter_state, ledger_browse, tone_counts,
        latest_finish, recent_activity, recent_failures, run_summary, run_summary_recent, step_order, latest_step_instance,
        step_outcomes, ledger_grid, run_graph, step_timeline, task_rows, step_bars, run_events, stats_24h, stats_24h_recent,
    )
}


def _top(keys, where="true", n=1, source="runs"):
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY created_at DESC, id DESC) AS rn
      FROM {source} WHERE {where}) WHERE rn <= {n}"""


_ACTIVE = "status IN ('queued', 'running')"
_RECENT = f""",
recent AS ({_top("pipeline_name", n=25)})"""

_RECENT_STEPS = STEPS + _RECENT + """,
rs AS (SELECT r.pipeline_name, r.created_at AS run_created_at, s.* FROM steps s JOIN recent r ON r.id = s.pipeline_run_id),
firsts AS (
  SELECT pipeline_name, step_name, row_number() OVER (PARTITION BY pipeline_name
         ORDER BY run_created_at DESC, pipeline_run_id DESC, created_at, step_name) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_name, step_name
               ORDER BY run_created_at DESC, pipeline_run_id DESC, created_at) AS rn FROM rs) WHERE rn = 1),
instances AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_name, step_name
         ORDER BY run_created_at DESC, pipeline_run_id DESC, created_at DESC) AS rn FROM rs) WHERE rn = 1)"""

_OVERVIEW = RUNS + "," + SPECS + "," + PI.FIRES + f""",
upcoming AS (SELECT digit, min(t) AS t FROM fires WHERE t >= TIMESTAMP '{AS_OF}' GROUP BY digit),
heads AS ({_top("pipeline_name")}),
overview AS (
  SELECT s.name, s.table_name, s.strategy, s.schedule, u.t AS next_run,
         CASE left(s.name, 1) WHEN '2' THEN true WHEN '4' THEN false ELSE s.paused END AS is_paused,
         NOT CASE left(s.name, 1) WHEN '2' THEN true WHEN '4' THEN false ELSE s.paused END AS is_active,
         h.id AS latest_run_id, h.execution_date AS latest_execution_date, h.status AS latest_status,
         h.started_at AS latest_started_at, h.finished_at AS latest_finished_at, {tone("h.status")} AS latest_tone
  FROM specs s LEFT JOIN heads h ON h.pipeline_name = s.name LEFT JOIN upcoming u ON u.digit = left(s.name, 1)
)"""

_FIRST_FAILED = """SELECT pipeline_run_id AS id, step_name, error_message FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_run_id ORDER BY created_at, id) AS rn FROM steps WHERE status = 'failed')
  WHERE rn = 1"""

_SUMMARY = f"""SELECT r.pipeline_name, count(*) AS total_runs, count(*) FILTER (WHERE {tone("status")} = 'ok') AS success_runs,
  count(*) FILTER (WHERE {tone("status")} = 'warn') AS active_runs, count(*) FILTER (WHERE {tone("status")} = 'bad') AS failed_runs,
  any_value(n) AS task_count
FROM {{0}} r JOIN (SELECT pipeline_name, count(DISTINCT step_name) AS n FROM steps s JOIN {{0}} x ON x.id = s.pipeline_run_id
  GROUP BY 1) c ON c.pipeline_name = r.pipeline_name GROUP BY r.pipeline_name"""

_ENVELOPE = """
envelope AS (
  SELECT r.id, r.pipeline_name, least(r.started_at, min(s.started_at)) AS ws,
         greatest(coalesce(greatest(r.finished_at, max(s.finished_at)), r.started_at, max(s.started_at)),
                  least(r.started_at, min(s.started_at))) AS we
  FROM {0} r LEFT JOIN steps s ON s.pipeline_run_id = r.id GROUP BY r.id, r.pipeline_name, r.started_at, r.finished_at
)"""


def _placed(columns, source):
    offset = f"greatest({seconds('ws', 'started_at')}, 0.0::DOUBLE)"
    length = f"greatest({seconds('started_at', 'coalesce(finished_at, started_at)')}, 0.0::DOUBLE)"
    return f"""SELECT {columns}, {two_decimals("start_raw")} AS start_pct,
      {two_decimals('''least(greatest(CASE WHEN length_s = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, (length_s / span_s) * 100.0::DOUBLE),
                    greatest(0.5::DOUBLE, 100.0::DOUBLE - start_raw))''')} AS width_pct
    FROM (SELECT *, least(100.0::DOUBLE, (offset_s / span_s) * 100.0::DOUBLE) AS start_raw FROM (
      SELECT *, greatest({seconds('ws', 'we')}, 1.0::DOUBLE) AS span_s, {offset} AS offset_s, {length} AS length_s FROM {source}))"""


_AS_OF = f"TIMESTAMP '{AS_OF}'"
_PCT = "round_even(({0} - {1}) / {1}::DOUBLE * 100.0::DOUBLE, 0)"


def _stats(source):
    mean = "CAST(round_even(secs / timed, 0) AS BIGINT)"
    return f"""
    SELECT total AS total_runs_24h, prev AS previous_runs_24h,
           CASE WHEN prev <= 0 THEN CASE WHEN total <= 0 THEN '+0%' ELSE '+100%' END
                ELSE CASE WHEN total >= prev THEN '+' ELSE '' END || CAST(CAST({_PCT.format("total", "prev")} AS BIGINT) AS VARCHAR) || '%' END AS runs_change,
           CASE WHEN total > 0 THEN CAST(CAST(round_even(ok / total * 100, 0) AS BIGINT) AS VARCHAR) || '%' ELSE '0%' END AS success_rate,
           failed_tasks, failed_dags, CASE WHEN timed > 0 THEN {clock(mean)} ELSE '-' END AS avg_duration
    FROM (
      SELECT count(*) FILTER (WHERE cur) AS total, count(*) FILTER (WHERE NOT cur) AS prev,
             count(*) FILTER (WHERE cur AND status = 'success') AS ok,
             CAST(coalesce(sum(f) FILTER (WHERE cur), 0) AS BIGINT) AS failed_tasks,
             count(DISTINCT CASE WHEN cur AND f > 0 THEN pipeline_name END) AS failed_dags,
             sum({seconds("started_at", "finished_at")}) FILTER (WHERE cur AND finished_at >= started_at) AS secs,
             count(*) FILTER (WHERE cur AND finished_at >= started_at) AS timed
      FROM (SELECT r.*, run_at >= {_AS_OF} - INTERVAL 24 HOUR AS cur, coalesce(b.f, 0) AS f
            FROM (SELECT *, coalesce(finished_at, started_at, CAST(execution_date AS TIMESTAMP)) AS run_at FROM ({source})) r
            LEFT JOIN (SELECT pipeline_run_id, count(*) AS f FROM steps WHERE status = 'failed' GROUP BY 1) b ON b.pipeline_run_id = r.id
            WHERE run_at BETWEEN {_AS_OF} - INTERVAL 48 HOUR AND {_AS_OF}))"""


ORACLE = {
    "latest_run": with_(RUNS, _top("pipeline_name, execution_date")),
    "latest_success": with_(RUNS, _top("pipeline_name, execution_date", "status = 'success'")),
    "active_run": with_(RUNS, _top("pipeline_name, execution_date", _ACTIVE)),
    "active_any": with_(RUNS, _top("pipeline_name", _ACTIVE)),
    "recent_runs": with_(RUNS, _top("pipeline_name", n=10)),
    "runs_page": with_(RUNS, f"""SELECT * FROM runs WHERE pipeline_name = '{_PIPELINE}'
        ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100"""),
    "runs_page_deep": with_(RUNS, "SELECT * FROM runs ORDER BY created_at DESC, id DESC LIMIT 75 OFFSET 1000"),
    "typed_runs": with_(RUNS, "SELECT * FROM runs"),
    "latest_state": with_(RUNS, "SELECT id, pipeline_name, status FROM runs"),
    "runs_total": with_(RUNS, f"SELECT count(*) AS total FROM runs WHERE pipeline_name = '{_PIPELINE}'"),
    "run_with_steps": with_(STEPS, """SELECT r.*, s.step_name, s.status AS step_status, s.started_at AS step_started_at,
        s.finished_at AS step_finished_at, s.records_processed, s.error_message, s.retry_count
        FROM runs r LEFT JOIN steps s ON s.pipeline_run_id = r.id"""),
    "ledger_delete_semi": with_(STEPS, f"""SELECT * FROM steps
        WHERE pipeline_run_id IN (SELECT id FROM runs WHERE pipeline_name = '{_PIPELINE}')"""),
    "ledger_delete_anti": with_(STEPS, f"""SELECT * FROM steps
        WHERE pipeline_run_id NOT IN (SELECT id FROM runs WHERE pipeline_name = '{_PIPELINE}')"""),
    "records_processed": with_(STEPS, """SELECT r.id, r.pipeline_name, CAST(coalesce(sum(s.records_processed), 0) AS BIGINT) AS records_processed
        FROM runs r LEFT JOIN steps s ON s.pipeline_run_id = r.id GROUP BY 1, 2"""),
    "run_step_counts": with_(STEPS, f"""SELECT r.id, count(s.id) FILTER (WHERE {tone("s.status")} = 'ok') AS ok,
        count(s.id) FILTER (WHERE {tone("s.status")} = 'bad') AS bad, count(s.id) FILTER (WHERE {tone("s.status")} = 'warn') AS running
        FROM runs r LEFT JOIN steps s ON s.pipeline_run_id = r.id GROUP BY r.id"""),
    "first_failed_step": with_(STEPS, _FIRST_FAILED),
    "failure_text": with_(STEPS, f"""SELECT id, '[' || step_name || '] ' || CASE WHEN length(error_message) > 9
        THEN left(error_message, 9) || '…' ELSE error_message END AS failure FROM ({_FIRST_FAILED})"""),
    "pause_state": with_(SPECS, """SELECT name, CASE left(name, 1) WHEN '2' THEN true WHEN '4' THEN false ELSE paused END AS is_paused
        FROM specs"""),
    "dataset_names": with_(RUNS, """SELECT id, pipeline_name, CASE left(pipeline_name, 1) WHEN '1' THEN 'dataset_1'
        WHEN '3' THEN 'dataset_3' ELSE pipeline_name END AS dataset_name FROM runs"""),
    "job_overview": with_(_OVERVIEW, "SELECT * FROM overview"),
    "pipeline_overview": with_(STEPS + _OVERVIEW[len(RUNS):] + """,
        shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_name ORDER BY created_at DESC, id DESC) AS k FROM runs) WHERE k <= 3)
        """, """SELECT o.name, o.next_run, o.is_paused, o.latest_run_id, o.latest_tone,
               CAST((SELECT count(*) FROM shown x WHERE x.pipeline_name = o.name) AS INTEGER) AS shown,
               CAST(r.k AS INTEGER) AS run_number, r.id AS run_id, r.status, s.step_name, s.status AS step_status, s.records_processed, s.error_message
        FROM overview o LEFT JOIN shown r ON r.pipeline_name = o.name LEFT JOIN steps s ON s.pipeline_run_id = r.id
        UNION ALL
        SELECT '0-IDLE', next_run, false, NULL, 'neutral', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM overview WHERE name = (SELECT min(name) FROM overview)"""),
    "ledger_search": with_(_OVERVIEW, """SELECT * FROM overview
        WHERE contains(lower(name || ' ' || table_name || ' ' || strategy || ' ' || schedule), 'incremental 0')"""),
    "ledger_filter_state": with_(_OVERVIEW, """SELECT latest_tone AS state, name FROM overview WHERE latest_tone IN ('ok', 'warn', 'bad')
        UNION ALL SELECT 'paused', name FROM overview WHERE is_paused UNION ALL SELECT 'all', name FROM overview"""),
    "ledger_browse": with_(RUNS, f"""SELECT * FROM runs WHERE (contains(id, '7') OR contains(CAST(execution_date AS VARCHAR), '7'))
        AND status = 'failed' AND pipeline_name = '{_PIPELINE}' AND trigger_type = 'manual'"""),
    "tone_counts": with_(_OVERVIEW, """SELECT count(*) FILTER (WHERE latest_tone = 'ok') AS ok,
        count(*) FILTER (WHERE latest_tone = 'warn') AS warn, count(*) FILTER (WHERE latest_tone = 'bad') AS bad,
        count(*) FILTER (WHERE is_paused) AS paused FROM overview"""),
    "latest_finish": with_(_OVERVIEW, "SELECT max(latest_finished_at) AS latest_finish FROM overview"),
    "recent_activity": with_(RUNS, """SELECT id, pipeline_name, execution_date, status, trigger_type, started_at, finished_at,
        coalesce(finished_at, started_at, CAST(execution_date AS TIMESTAMP)) AS activity_at
        FROM runs ORDER BY activity_at DESC, id DESC LIMIT 20"""),
    "recent_failures": with_(STEPS + _RECENT + f", failed AS ({_top('pipeline_name', chr(34) + 'status' + chr(34) + ' = ' + chr(39) + 'failed' + chr(39), 5, 'runs')})",
        f"""SELECT f.id, f.pipeline_name, f.execution_date, f.status, x.step_name, x.error_message
        FROM failed f LEFT JOIN ({_FIRST_FAILED}) x ON x.id = f.id"""),
    "run_summary": with_(STEPS, _SUMMARY.format("runs")),
    "run_summary_recent": with_(STEPS + _RECENT, _SUMMARY.format("recent")),
    "step_order": with_(_RECENT_STEPS, "SELECT * FROM firsts"),
    "latest_step_instance": with_(_RECENT_STEPS, """SELECT pipeline_name, step_name, pipeline_run_id, status, started_at,
        finished_at, error_message FROM instances"""),
    "step_outcomes": with_(STEPS, """SELECT r.pipeline_name, s.step_name, count(*) FILTER (WHERE s.status = 'success') AS success_count,
        count(*) FILTER (WHERE s.status IN ('running', 'pending', 'queued')) AS running_count,
        count(*) FILTER (WHERE s.status = 'failed') AS failed_count
        FROM steps s JOIN runs r ON r.id = s.pipeline_run_id GROUP BY 1, 2"""),
    "ledger_grid": with_(_RECENT_STEPS, f"""SELECT r.id, r.pipeline_name, r.execution_date, r.status, {tone("r.status")} AS tone, n.step_name,
        coalesce(s.status, '') AS step_status, {tone("s.status")} AS step_tone, {duration("s.started_at", "s.finished_at")} AS step_duration
        FROM recent r JOIN (SELECT DISTINCT pipeline_name, step_name FROM rs) n ON n.pipeline_name = r.pipeline_name
        LEFT JOIN rs s ON s.pipeline_run_id = r.id AND s.step_name = n.step_name"""),
    "run_graph": with_(STEPS + f", heads AS ({_top('pipeline_name')})", f"""SELECT h.pipeline_name,
        row_number() OVER (PARTITION BY h.pipeline_name ORDER BY s.created_at, s.step_name) AS position, s.step_name AS name, s.status,
        {tone("s.status")} AS tone, {duration("s.started_at", "s.finished_at")} AS duration
        FROM steps s JOIN heads h ON h.id = s.pipeline_run_id"""),
    "step_timeline": with_(STEPS + "," + _ENVELOPE.format("runs"), _placed(
        "id, step_name", "(SELECT s.pipeline_run_id AS id, s.step_name, s.started_at, s.finished_at, e.ws, e.we FROM steps s JOIN envelope e ON e.id = s.pipeline_run_id)")),
    "task_rows": with_(_RECENT_STEPS + f", heads AS ({_top('pipeline_name')})," + _ENVELOPE.format("heads"), f"""
        SELECT p.pipeline_name, f.position, p.step_name AS name, p.status AS latest_status, {tone("p.status")} AS latest_tone,
               c.success_count, c.running_count, c.failed_count, {duration("p.started_at", "p.finished_at")} AS latest_duration,
               p.start_pct, p.width_pct
        FROM ({_placed("pipeline_name, step_name, status, started_at, finished_at",
                       "(SELECT i.pipeline_name, i.step_name, i.status, i.started_at, i.finished_at, e.ws, e.we FROM instances i LEFT JOIN envelope e ON e.pipeline_name = i.pipeline_name)")}) p
        JOIN firsts f USING (pipeline_name, step_name)
        JOIN (SELECT pipeline_name, step_name, count(*) FILTER (WHERE status = 'success') AS success_count,
                     count(*) FILTER (WHERE status IN ('running', 'pending', 'queued')) AS running_count,
                     count(*) FILTER (WHERE status = 'failed') AS failed_count FROM rs GROUP BY 1, 2) c USING (pipeline_name, step_name)"""),
    "step_bars": with_(STEPS, f"""
        SELECT pipeline_run_id, step_name, status, {tone("status")} AS tone, {duration("started_at", "finished_at")} AS duration,
               CASE WHEN records_processed <> 0 THEN CAST(records_processed AS VARCHAR) END AS records_display, retry_count,
               bar_left AS bar_left_pct, least(greatest(1.5::DOUBLE, len_s / span_s * 100), 100.0::DOUBLE - bar_left) AS bar_width_pct
        FROM (SELECT *, least(98.0::DOUBLE, {seconds("a", "started_at")} / span_s * 100) AS bar_left FROM (
          SELECT s.*, a, greatest(1.0::DOUBLE, {seconds("a", "b")}) AS span_s, greatest(0.0::DOUBLE, {seconds("s.started_at", "s.finished_at")}) AS len_s
          FROM steps s JOIN (SELECT pipeline_run_id, min(started_at) AS a, max(finished_at) AS b FROM steps GROUP BY 1) t USING (pipeline_run_id)))"""),
    "run_events": with_(STEPS, f"""
        SELECT id AS run_id, started_at AS timestamp, CASE WHEN {tone("status")} = 'warn' THEN 'warn' ELSE 'neutral' END AS tone,
               'Run started' AS title, 'Trigger: ' || trigger_type AS detail FROM runs
        UNION ALL SELECT id, finished_at, {tone("status")}, 'Run finished', 'Final state: ' || status FROM runs WHERE finished_at IS NOT NULL
        UNION ALL SELECT pipeline_run_id, started_at, 'warn', 'Task started: ' || step_name, 'State: ' || status FROM steps
        UNION ALL SELECT pipeline_run_id, finished_at, {tone("status")}, 'Task finished: ' || step_name,
               coalesce(error_message, 'Duration: ' || {duration("started_at", "finished_at")}) FROM steps"""),
    "stats_24h": with_(STEPS, _stats("SELECT * FROM runs")),
    "stats_24h_recent": with_(STEPS, _stats(_top("pipeline_name", n=400))),
}
