"""Data intervals, schedule fires, month splits and row-to-interval assignment."""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martloom.functions import schedules as S
from martloom.functions.dates import month_start, timestamp_literal

INTERVAL_BIND_KEYS = ("logical_date", "data_interval_start", "data_interval_end")
PARTS = ("year", "month", "day", "hour", "minute", "second")


def _parsed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"_seconds": F.expr(S.interval_seconds(text)), "_cron": F.expr(S.cron_struct(text))})


def with_schedule(df: DataFrame, schedule_col: str = "schedule") -> DataFrame:
    """Add the parsed schedule as ``_seconds`` and ``_cron``; each distinct text is parsed once.

    The parsed text depends on the group's row count. That is no more than a fence: a
    filter on the parsed fields cannot be pushed below the grouping, where it would parse
    the text of every row of the input again.
    """
    texts = df.groupBy(schedule_col).agg(F.count(F.lit(1)).alias("_uses"))
    parsed = _parsed(texts, f"(CASE WHEN _uses > 0 THEN trim(`{schedule_col}`) END)").drop("_uses")
    return df.join(parsed, schedule_col, "left")


def with_data_interval(df: DataFrame, date_col: str = "execution_date", schedule_col: str = "schedule") -> DataFrame:
    """Add ``data_interval_start``, ``data_interval_end`` and ``interval_error`` to each row.

    Fixed intervals end at midnight of the date. Cron intervals end at the first fire of
    the date and start at the fire before it. Rows that have no interval keep nulls and say
    why in ``interval_error``.
    """
    return _intervals(with_schedule(df, schedule_col), df.columns, date_col, schedule_col)


def _intervals(base: DataFrame, columns: list[str], date_col: str, schedule_col: str) -> DataFrame:
    day, schedule = F.col(date_col), F.trim(F.col(schedule_col))
    midnight = day.cast("timestamp_ntz")
    fixed = F.col("_seconds").isNotNull()
    parsed = base.select(
        "*",
        F.when(fixed, midnight).otherwise(F.expr(S.first_fire("_cron", f"`{date_col}`"))).alias("_end"),
        F.when(
            fixed,
            midnight - F.make_dt_interval(secs=F.col("_seconds").cast("decimal(18,6)")),
        ).otherwise(F.expr(S.previous_days_last_fire("_cron", f"`{date_col}`"))).alias("_start"),
    )
    usable = F.col("_end").isNotNull() & F.col("_start").isNotNull()
    reason = (
        F.when(schedule.isNull() | (schedule == ""), "schedule is blank")
        .when(~fixed & ~F.coalesce(F.expr(S.is_cron("_cron")), F.lit(False)), "schedule is not supported")
        .when(F.col("_end").isNull(), "no fire on the execution date")
        .when(F.col("_start").isNull(), "no previous fire found")
    )
    return parsed.select(
        *columns,
        F.when(usable, F.col("_start")).alias("data_interval_start"),
        F.when(usable, F.col("_end")).alias("data_interval_end"),
        reason.alias("interval_error"),
    )


def resolve_data_interval(spark: SparkSession, execution_date: dt.date, schedule: str | None):
    """The ``(start, end)`` of one execution date; raises ``ValueError`` when there is none."""
    one = spark.range(1).select(
        F.lit(execution_date).cast("date").alias("execution_date"), F.lit(schedule).cast("string").alias("schedule")
    )
    row = _intervals(_parsed(one, "trim(schedule)"), one.columns, "execution_date", "schedule").first()
    if row["interval_error"]:
        raise ValueError(f"{row['interval_error']}: execution_date={execution_date} schedule={schedule}")
    return row["data_interval_start"], row["data_interval_end"]


def interval_bind_params(start: dt.datetime, end: dt.datetime) -> dict:
    """The values a source predicate can name: three instants and their date parts."""
    params = {}
    for key, value in zip(INTERVAL_BIND_KEYS, (start, start, end)):
        params[key] = value
        for part in PARTS:
            params[f"{key}_{part}"] = getattr(value, part)
    return params


def with_bind_params(df: DataFrame) -> DataFrame:
    """The same values as columns, for a table of intervals."""
    sources = dict(zip(INTERVAL_BIND_KEYS, ("data_interval_start", "data_interval_start", "data_interval_end")))
    extra = []
    for key, col in sources.items():
        if key not in df.columns:
            extra.append(F.col(col).alias(key))
        for part in PARTS:
            extra.append(getattr(F, part)(F.col(col)).cast("int").alias(f"{key}_{part}"))
    return df.select("*", *extra)


def fire_intervals(schedules: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """All fires of each schedule between two dates, each with the fire before it.

    Cron days are generated and filtered first; the fires of one day are one array, so the fire before is the previous
    array element, or the last fire of the firing day before. No window over a schedule's whole history is needed.
    Fixed intervals step from midnight of the first date. A schedule that can't be read gives one row without an
    interval that says why in ``interval_error``; a range that ends before it starts gives none.
    """
    base = with_schedule(schedules.where(F.col(end) >= F.col(start)))
    dated = base.withColumn("fire_date", F.explode(F.sequence(F.col(start), F.col(end))))
    fixed = F.col("_seconds").isNotNull()
    days = (
        dated.where(~fixed & F.expr(S.is_cron("_cron")))
        .where(S.day_matches("_cron", "fire_date"))
        .withColumn("_minutes", F.expr(S.fire_minutes("_cron")))
        .withColumn("_before", F.expr(S.previous_days_last_fire("_cron", "fire_date", within_lookback=False)))
    )
    fires = days.select("*", F.posexplode("_minutes").alias("_pos", "_minute"))
    earlier = f"CASE WHEN _pos > 0 THEN {S.at_minute('fire_date', 'get(_minutes, _pos - 1)')} ELSE _before END"
    none = F.lit(None).cast("string").alias("interval_error")
    cron = fires.select(
        *schedules.columns,
        F.expr(earlier).alias("data_interval_start"),
        F.expr(S.at_minute("fire_date", "_minute")).alias("data_interval_end"),
        none,
    )
    # The first step of a day is what the steps before it leave over.
    passed = F.date_diff("fire_date", F.col(start)).cast("long") * 86400
    steps = dated.where(fixed).withColumn("_first", F.pmod(-passed, F.col("_seconds"))).where("_first < 86400")
    steps = steps.withColumn("_second", F.explode(F.sequence(F.col("_first"), F.lit(86399).cast("long"), F.col("_seconds"))))
    lasting = lambda c: F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)"))
    until = F.col("fire_date").cast("timestamp_ntz") + lasting("_second")
    stepped = steps.select(*schedules.columns, (until - lasting("_seconds")).alias("data_interval_start"), until.alias("data_interval_end"), none)
    blank = F.coalesce(F.trim("schedule"), F.lit("")) == ""
    nowhere = F.lit(None).cast("timestamp_ntz")
    unread = base.where(~fixed & ~F.coalesce(F.expr(S.is_cron("_cron")), F.lit(False))).select(
        *schedules.columns, nowhere.alias("data_interval_start"), nowhere.alias("data_interval_end"),
        F.when(blank, "schedule is blank").otherwise("schedule is not supported").alias("interval_error"))
    return cron.unionByName(stepped).unionByName(unread)


def _micros(column: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", timestamp_literal("1970-01-01 00:00:00"), column.cast("timestamp_ntz"))


def interval_candidates(rows: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Rows beside the intervals near them, by equality on (_class, _cell) alone.

    Intervals are sorted into length classes, each four times as long as the one before, and every class cuts time into
    cells of its own length. An interval touches two cells of its class at most, and a row lies in one cell of each class
    that occurs, so a range condition becomes this equality with a check behind it. Of one schedule a
    cell holds a handful of intervals, whether it fires by the minute or by the year, so candidates grow with the
    result and not with the square of a day. The join is left to the planner: it broadcasts the interval side while its
    size allows, else a cell with many rows is split at run time.
    """
    start, end = F.col("data_interval_start"), F.col("data_interval_end")
    length = _micros(end) - _micros(start)
    wide = intervals.where(end > start).withColumn("_class", F.ceil(F.log(4.0, length.cast("double"))).cast("int"))
    classes = sorted(r["_class"] for r in wide.select("_class").distinct().collect())  # 32 at most
    width, at = F.pow(F.lit(4.0), F.col("_class")).cast("long"), lambda t: F.call_function("div", _micros(t) - F.pmod(_micros(t), width), width)
    last = end - F.expr("INTERVAL '0.000001' SECOND")
    touched = wide.withColumn("_cell", F.explode(F.sequence(at(start), at(last))))
    placed = rows.withColumn("_class", F.explode(F.array(*map(F.lit, classes)).cast("array<int>")))
    placed = placed.withColumn("_cell", at(F.col(key)))
    return placed.join(touched, ["_class", "_cell"])


def assign_intervals(rows: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Give each row the intervals with ``start <= key < end``; rows in none and intervals that end where they start give nothing."""
    inside = (F.col(key) >= F.col("data_interval_start")) & (F.col(key) < F.col("data_interval_end"))
    return interval_candidates(rows, intervals, key).where(inside).drop("_class", "_cell")


def check_range(start: dt.date, end: dt.date) -> None:
    if end < start:
        raise ValueError("end date must not be before start date")


def months_between(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """First day of every month from ``start``'s to ``end``'s."""
    check_range(start, end)
    ranges = spark.range(1).select(F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"))
    return split_months(ranges).select("execution_date")


def split_months(ranges: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    months = F.sequence(month_start(F.col(start)), month_start(F.col(end)), F.expr("INTERVAL 1 MONTH"))
    return ranges.where(F.col(end) >= F.col(start)).withColumn("execution_date", F.explode(months))


def pending_dates(requested: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Requested (pipeline, date) pairs that no successful, queued or running run covers."""
    if force:
        return requested
    keys = ["pipeline_name", "execution_date"]
    covering = runs.where(F.col("status").isin("success", "queued", "running")).select(*keys)
    return requested.join(covering, keys, "left_anti")


def interval_filter(df: DataFrame, key: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Half-open ``start <= key < end``; the literals reach the scan."""
    return df.where((F.col(key) >= timestamp_literal(start)) & (F.col(key) < timestamp_literal(end)))
