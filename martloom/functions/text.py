"""Names, labels, messages and masking."""

from pyspark.sql import Column, functions as F

# A key holding one of these words is a secret.
SENSITIVE_WORDS = ["password", "token", "secret", "api_key", "credential"]


def slug(value: Column) -> Column:
    s = F.lower(F.btrim(F.regexp_replace(value, "[^0-9A-Za-z]+", "_"), F.lit("_")))
    return F.when(s == "", F.lit("dataset")).when(s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).otherwise(s)


def raw_table_name(dataset: Column, source: Column) -> Column:
    return F.concat_ws("__", F.lit("raw"), slug(dataset), slug(source))


def build_id(execution_date: Column, run_id: Column) -> Column:
    safe = F.btrim(F.regexp_replace(run_id, "[^0-9A-Za-z-]+", "-"), F.lit("-"))
    safe = F.when(safe == "", F.lit("run")).otherwise(safe)
    return F.concat_ws("-", F.date_format(execution_date, "yyyyMMdd"), safe)


def refresh_kind(trigger_type: Column, strategy: Column) -> Column:
    """backfill runs first, then the strategy decides between incremental and full."""
    return (
        F.when(trigger_type == "backfill", F.lit("backfill"))
        .when(F.lower(strategy) == "incremental", F.lit("incremental"))
        .otherwise(F.lit("full"))
    )


def stored_refresh_mode(kind: Column) -> Column:
    return F.when(kind == "full", F.lit("full")).otherwise(F.lit("incremental"))


def shorten(value: Column, limit: int = 120) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("…"))).otherwise(value)


def percent_change_text(current: Column, previous: Column) -> Column:
    pct = F.rint(((current - previous) / F.when(previous > 0, previous)) * 100.0)
    # The sign follows the exact change, so a tiny fall that rounds to zero shows "0%".
    sign = F.when(current >= previous, F.lit("+")).otherwise(F.lit(""))
    return (
        F.when((previous <= 0) & (current <= 0), F.lit("+0%"))
        .when(previous <= 0, F.lit("+100%"))
        .otherwise(F.concat(sign, pct.cast("long").cast("string"), F.lit("%")))
    )


def success_rate_text(ok: Column, total: Column) -> Column:
    rate = F.rint((ok / F.when(total > 0, total)) * 100)
    return F.when(total > 0, F.concat(rate.cast("long").cast("string"), F.lit("%"))).otherwise(F.lit("0%"))


def mask_secrets(params: Column) -> Column:
    """Mask the values of a string map whose key holds a sensitive word."""
    pattern = "|".join(SENSITIVE_WORDS)
    return F.transform_values(params, lambda k, v: F.when(F.lower(k).rlike(pattern), F.lit("***")).otherwise(v))


def contains_text(query: str, *columns: Column) -> Column:
    """Case-insensitive substring over columns joined with spaces; a blank query keeps all rows."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    haystack = F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.lower(haystack).contains(needle)


def any_column_contains(query: str, *columns: Column) -> Column:
    """Case-insensitive substring in at least one column, each looked at alone."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c.cast("string")).contains(needle), F.lit(False))
    return hit
