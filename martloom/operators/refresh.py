"""A load and the refresh of its mart in one call."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from martloom.operators import ingest, mart


@dataclass(frozen=True)
class Outcome:
    """The load, and what became of the mart: refreshed, skipped (no version, no error) or failed with a message."""

    load: ingest.IngestResult
    refresh: mart.RefreshResult | None
    error: str | None


def load_and_refresh(source: DataFrame, spec: ingest.IngestSpec, execution_date: dt.date, base_path: str, run_id: str, store: mart.MartStore,
                     dataset: str, kind: str | None = None, refreshed_at: dt.datetime | None = None) -> Outcome:
    """Run a load, then refresh the metadata of its table.

    A load that fails raises and leaves the mart alone. A mart that fails leaves the load as it is: the error is part of the outcome. The
    refresh is skipped when the execution month has no file. ``kind`` is the load's strategy unless it is given (``backfill``).
    """
    load = ingest.run_ingest(source, spec, execution_date, base_path, run_id)
    own = spec.partition_by == ingest.EXECUTION_MONTH
    try:
        done = mart.refresh_mart(store, dataset, load.table_root, f"{execution_date:%Y%m%d}-{run_id}", kind or spec.strategy, refreshed_at,
                                 (execution_date.year, execution_date.month) if own else None)
    except Exception as error:  # noqa: BLE001
        return Outcome(load, None, str(error).strip().splitlines()[0])
    if done.version and not done.promoted:
        messages = sorted(r["message"] for r in done.issues.where(F.col("severity") == "error").limit(20).collect())
        return Outcome(load, done, "mart is not valid: " + "; ".join(messages))
    return Outcome(load, done, None)
