"""Run and step status families."""

from pyspark.sql import Column, functions as F

# Which statuses belong to which tone.
STATUS_GROUPS = {
    "ok": ("success", "completed"),
    "warn": ("running", "pending", "queued"),
    "bad": ("failed",),
}
ACTIVE_STATUSES = ("queued", "running")


def tone(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    out = None
    for name, members in STATUS_GROUPS.items():
        out = F.when(s.isin(*members), name) if out is None else out.when(s.isin(*members), name)
    return out.otherwise("neutral")


def has_tone(status: Column, name: str) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*STATUS_GROUPS[name])
