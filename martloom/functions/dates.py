"""Month arithmetic, ISO text parsing and elapsed time."""

import datetime as dt

from pyspark.sql import Column, functions as F

# The form nearly all values have.
_USUAL = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$"
# An ISO date, extended or basic, by month or by week; a time of hours, minutes and seconds, extended or basic; a fraction; a zone.
_ISO = (
    r"^(\d{4})(?:(-?)(\d{2})\2(\d{2})|(-?)W(\d{2})(?:\5(\d))?)"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\9(\d{2})(?:[.,](\d+))?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?$"
)
# Year, month, day, week, weekday, hour, minute, second and fraction, divided by a character no text holds.
_FIELDS = "$1\x01$3\x01$4\x01$6\x01$7\x01$8\x01$10\x01$11\x01$12"


def timestamp_literal(value: dt.datetime | str) -> Column:
    """A zone-less timestamp literal, independent of the session time zone."""
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(value, dt.datetime) else value
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def month_start(d: Column) -> Column:
    return F.trunc(d.cast("date"), "month")


def next_month(d: Column) -> Column:
    return F.add_months(month_start(d), 1)


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_bucket(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-01")


def partition_date(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def covered_months(first: Column, last: Column) -> Column:
    """Inclusive calendar span in months; months without data inside the span count too."""
    span = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    return F.coalesce(span, F.lit(0)).cast("long")


def _week_date(year: Column, week: Column, day: Column) -> Column:
    """The date of an ISO week and weekday, null where the year has no such week or the week no such day."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
    good = week.between(1, 53) & day.between(1, 7) & (F.weekofyear(monday) == week)
    return F.when(good, F.date_add(monday, day - 1))


def parse_iso(text: Column) -> Column:
    """ISO text to a zone-less timestamp: a zone suffix is dropped, bad text gives null.

    Dates may be of a month or of a week. Dates and times may be written with or without their separators, times may end at the
    hour or minute, and fractions beyond microseconds are cut. The usual form is cast as it is; of the rest the pattern
    is matched once for each value.
    """
    t = F.trim(text)

    def from_fields(f: Column) -> Column:
        or_zero = lambda i: F.when(f[i] == "", "00").otherwise(f[i])
        day = F.when(f[3] == "", F.concat_ws("-", f[0], f[1], f[2])).otherwise(
            _week_date(f[0].try_cast("int"), f[3].try_cast("int"), F.when(f[4] == "", "1").otherwise(f[4]).try_cast("int")).cast("string"))
        time = F.concat_ws(":", or_zero(5), or_zero(6), or_zero(7))
        whole = F.concat(day, F.lit(" "), time, F.lit("."), F.substring(F.rpad(f[8], 6, "0"), 1, 6))
        return F.when(F.size(f) == 9, whole.try_cast("timestamp_ntz"))

    # As the one element of an array the fields are split once, not for each use.
    fields = F.when(~F.contains(t, F.lit("\x01")), F.split(F.regexp_replace(t, _ISO, _FIELDS), "\x01"))
    rest = F.get(F.transform(F.array(fields), from_fields), F.lit(0))
    return F.when(t.rlike(_USUAL), t.try_cast("timestamp_ntz")).otherwise(rest)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as a double, microseconds kept."""
    gap = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return gap.cast("decimal(20,6)").cast("double")


def _clock_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    minutes = F.floor(s / 60)
    hours = F.floor(s / 3600)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", minutes, s % 60))
        .otherwise(F.format_string("%dh %dm", hours, minutes % 60))
    )


def duration_text(start: Column, end: Column, as_of: Column) -> Column:
    """``Ns`` / ``Mm Ss`` / ``Hh Mm``; an open end runs to ``as_of``, no start gives ``-``."""
    seconds = F.greatest(F.lit(0.0), seconds_between(start, F.coalesce(end, as_of)))
    return F.when(start.isNull(), F.lit("-")).otherwise(_clock_text(F.floor(seconds)))


def avg_duration_text(total_seconds: Column, samples: Column) -> Column:
    mean = F.when(samples > 0, total_seconds / samples)
    seconds = F.greatest(F.lit(0.0), F.rint(mean))
    return F.when(samples > 0, _clock_text(seconds)).otherwise(F.lit("-"))
