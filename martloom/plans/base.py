"""SQL for the derived tables, shared by the checking queries."""

import datetime as dt

AS_OF = dt.datetime(2000, 6, 15, 12, 0, 0)
REFRESHED_AT = dt.datetime(2026, 4, 6, 9, 0, 0)

MART_FILES = """
mart_files AS (
  SELECT 'sales' AS dataset_name, 'ORDERS' AS source_name, d AS partition_start,
         'ORDERS/year=' || CAST(year(d) AS VARCHAR) || '/month=' || lpad(CAST(month(d) AS VARCHAR), 2, '0') || '/part0' AS file_path,
         count(*) AS row_count, 'build-001' AS last_build_id
  FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders) GROUP BY d
  UNION ALL
  SELECT 'sales', 'LINEITEM', d,
         'LINEITEM/year=' || CAST(year(d) AS VARCHAR) || '/month=' || lpad(CAST(month(d) AS VARCHAR), 2, '0') || '/part' || p,
         count(*), 'build-002'
  FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_linestatus AS p FROM lineitem) GROUP BY d, p
  UNION ALL
  SELECT 'web', 'EVENTS', d,
         'EVENTS/year=' || CAST(year(d) AS VARCHAR) || '/month=' || lpad(CAST(month(d) AS VARCHAR), 2, '0') || '/part' || p,
         count(*), 'build-003'
  FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS d, event_type AS p FROM events) GROUP BY d, p
)"""

MART_SOURCES = MART_FILES + """,
mart_sources AS (
  SELECT dataset_name, source_name, 'raw__' || dataset_name || '__' || lower(source_name) AS raw_table_name,
         source_name AS source_root, CAST(sum(row_count) AS BIGINT) AS row_count, count(*) AS file_count,
         min(partition_start) AS min_partition_start, max(partition_start) AS max_partition_start,
         max(last_build_id) AS last_build_id, 'full' AS refresh_mode, TIMESTAMP '2026-04-06 09:00:00' AS last_refreshed_at
  FROM mart_files GROUP BY dataset_name, source_name
)"""

MART_DATASETS = MART_SOURCES + """,
mart_datasets AS (
  SELECT dataset_name, count(DISTINCT source_name) AS source_count, CAST(sum(row_count) AS BIGINT) AS total_rows,
         CAST(sum(file_count) AS BIGINT) AS total_files, min(min_partition_start) AS min_partition_start,
         max(max_partition_start) AS max_partition_start, max(last_refreshed_at) AS last_refreshed_at
  FROM mart_sources GROUP BY dataset_name
)"""

RUNS = """
runs AS (
  SELECT id, pipeline_name, execution_date, status, started_at,
         CASE WHEN status IN ('success', 'failed') THEN started_at + INTERVAL 1 SECOND * dur END AS finished_at,
         trigger_type, started_at AS created_at
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS pipeline_name, CAST(o_orderdate AS DATE) AS execution_date,
               CASE WHEN o_orderkey % 10 = 0 THEN 'queued' WHEN o_orderstatus = 'F' THEN 'success'
                    WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
               o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 86400 AS INTEGER) AS started_at,
               CAST(o_orderkey % 7200 AS INTEGER) AS dur,
               CASE o_orderkey % 3 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'manual' ELSE 'backfill' END AS trigger_type
        FROM orders)
)"""

STEPS = RUNS + """,
steps AS (
  SELECT r.id || '/step_' || CAST(s.n AS VARCHAR) AS id, r.id AS pipeline_run_id, 'step_' || CAST(s.n AS VARCHAR) AS step_name,
         s.status AS status,
         r.started_at + INTERVAL 1 SECOND * CAST((s.n - 1) * 60 AS INTEGER) AS started_at,
         r.started_at + INTERVAL 1 SECOND * CAST((s.n - 1) * 60 + s.recs AS INTEGER) AS finished_at,
         s.recs AS records_processed,
         CASE WHEN s.status = 'failed' THEN 'step ' || CAST(s.n AS VARCHAR) || ' failed' END AS error_message,
         s.retry_count AS retry_count,
         r.started_at + INTERVAL 1 SECOND * CAST((s.n - 1) * 60 AS INTEGER) AS created_at
  FROM (SELECT l_orderkey, l_linenumber AS n, CASE WHEN max(l_returnflag) = 'R' THEN 'failed' ELSE 'success' END AS status,
               CAST(sum(l_quantity) AS BIGINT) AS recs, CAST(count(*) - 1 AS INTEGER) AS retry_count
        FROM lineitem GROUP BY l_orderkey, l_linenumber) s
  JOIN runs r ON r.id = CAST(s.l_orderkey AS VARCHAR)
)"""

SPECS = """
specs AS (
  SELECT p AS name, 'ORDERS_' || left(p, 1) AS table_name,
         CASE WHEN left(p, 1) IN ('1', '3', '5') THEN 'incremental' ELSE 'full' END AS strategy,
         CASE left(p, 1) WHEN '1' THEN '0 2 * * *' WHEN '2' THEN '0 2 1 * *' WHEN '3' THEN '0 */6 * * *'
              WHEN '4' THEN '30 1 * * mon-fri' ELSE 'interval:15m' END AS schedule,
         left(p, 1) = '4' AS paused
  FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)
)"""

TONE = """CASE WHEN lower(coalesce({0}, '')) IN ('success', 'completed') THEN 'ok'
  WHEN lower(coalesce({0}, '')) IN ('running', 'pending', 'queued') THEN 'warn'
  WHEN lower(coalesce({0}, '')) = 'failed' THEN 'bad' ELSE 'neutral' END"""


def tone(column: str) -> str:
    return TONE.format(column)


def clock(seconds: str) -> str:
    """Seconds to text; ``seconds`` must be a whole number."""
    return (
        f"CASE WHEN {seconds} < 60 THEN CAST({seconds} AS VARCHAR) || 's' "
        f"WHEN {seconds} < 3600 THEN CAST({seconds} // 60 AS VARCHAR) || 'm ' || CAST({seconds} % 60 AS VARCHAR) || 's' "
        f"ELSE CAST({seconds} // 3600 AS VARCHAR) || 'h ' || CAST(({seconds} % 3600) // 60 AS VARCHAR) || 'm' END"
    )


def seconds(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 1000000.0::DOUBLE)"


def duration(start: str, end: str) -> str:
    as_of = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
    whole = f"greatest(0, (epoch_us(coalesce({end}, {as_of})) - epoch_us({start})) // 1000000)"
    return f"CASE WHEN {start} IS NULL THEN '-' ELSE {clock(whole)} END"


def two_decimals(x: str) -> str:
    """Correctly rounded from the binary value, by way of text."""
    return f"CAST(printf('%.2f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def with_(ctes: str, query: str) -> str:
    return f"WITH {ctes.strip()}\n{query.strip()}"
