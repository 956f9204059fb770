"""Schedule text as Spark SQL expressions.

A schedule is either ``interval:<n>[smhd]`` or five cron fields. Everything here is
evaluated row by row inside the JVM, so a table of (schedule, date) pairs needs no
calendar table. Weekdays count from Monday = 0; day of month and weekday must both match.

The functions take and return SQL text, because the expressions are large and one parsed
text is built much faster than hundreds of nested Column calls.
"""

# Names usable in the month and weekday fields.
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
# How many days back a previous fire is looked for.
LOOKBACK_CALENDAR, LOOKBACK_CLOCK, LOOKBACK_EVERY_MINUTE = 400, 3, 1
# A leap day that has to be a given weekday comes back within 40 years; no other schedule waits longer.
LONGEST_WAIT = 366 * 41

_INTERVAL = "(?i)^interval:([0-9]+)([smhd]?)$"
_TOKEN = "^([*]|[0-9]+|[a-z]+)(?:-([0-9]+|[a-z]+))?(?:/([0-9]+))?$"
CRON_FIELDS = ("minutes", "hours", "days", "months", "weekdays")


def interval_seconds(schedule: str) -> str:
    """Length of an ``interval:`` schedule in seconds, null for anything else or for zero."""
    n = f"try_cast(regexp_extract({schedule}, '{_INTERVAL}', 1) AS BIGINT)"
    unit = f"lower(regexp_extract({schedule}, '{_INTERVAL}', 2))"
    size = f"CASE {unit} WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END"
    return f"nullif({n} * {size}, 0)"


def _number(token: str, low: int, names: list[str]) -> str:
    if not names:
        return f"try_cast({token} AS INT)"
    known = ", ".join(f"'{n}'" for n in names)
    by_name = f"nullif(CAST(array_position(array({known}), {token}) AS INT), 0) - 1 + {low}"
    return f"coalesce(try_cast({token} AS INT), {by_name})"


def _field_values(field: str, low: int, high: int, names: list[str]) -> str:
    """Sorted numbers a cron field stands for; null when the text is not understood."""
    groups = ", ".join(f"'{n}', regexp_extract(x, '{_TOKEN}', {i})" for i, n in enumerate(("a", "b", "s"), 1))
    tokens = f"transform(split({field}, ','), x -> named_struct({groups}))"
    name_a, name_b = "t.a RLIKE '^[a-z]'", "t.b RLIKE '^[a-z]'"
    clash = (
        f"(t.a = '*' AND t.b <> '') OR (t.s <> '' AND ({name_a} OR {name_b}))"
        f" OR (t.b <> '' AND ({name_a}) <> ({name_b}))"
    )
    start = f"CASE WHEN {clash} THEN NULL WHEN t.a = '*' THEN {low} ELSE {_number('t.a', low, names)} END"
    stop = (
        f"CASE WHEN t.b <> '' THEN {_number('t.b', low, names)} WHEN t.a = '*' OR t.s <> '' THEN {high}"
        f" ELSE {_number('t.a', low, names)} END"
    )
    every = "CASE WHEN t.s = '' THEN 1 ELSE try_cast(t.s AS INT) END"
    bounds = f"transform({tokens}, t -> named_struct('start', {start}, 'stop', {stop}, 'every', {every}, 'stepped', t.s <> ''))"
    good = (
        f"t.start >= {low} AND t.stop <= {high} AND t.start <= t.stop AND t.every > 0"
        " AND (NOT t.stepped OR t.every <= t.stop - t.start)"
    )
    spread = f"CASE WHEN {good} THEN sequence(t.start, greatest(t.start, t.stop), greatest(1, t.every)) END"
    return f"array_sort(array_distinct(flatten(transform({bounds}, t -> {spread}))))"


def cron_struct(schedule: str) -> str:
    """Parsed cron fields as a struct, null without five fields; a field not understood is null.

    Parse distinct schedule texts and join them back: a filter on anything derived from
    the struct would otherwise be pushed below it and parse the text for every day tried.
    """
    words = f"split(lower(trim({schedule})), '[ \t]+')"
    minute, hour, day, month, weekday = (f"get({words}, {i})" for i in range(5))
    numbered = f"array_remove(split({day}, ','), 'last')"
    days = (
        f"CASE WHEN size({numbered}) = 0 THEN CAST(array() AS ARRAY<INT>)"
        f" ELSE {_field_values(f'array_join({numbered}, \',\')', 1, 31, [])} END"
    )
    lookback = (
        f"CASE WHEN {day} <> '*' OR {month} <> '*' OR {weekday} <> '*' THEN {LOOKBACK_CALENDAR}"
        f" WHEN {minute} <> '*' OR {hour} <> '*' THEN {LOOKBACK_CLOCK} ELSE {LOOKBACK_EVERY_MINUTE} END"
    )
    values = {
        "minutes": _field_values(minute, 0, 59, []),
        "hours": _field_values(hour, 0, 23, []),
        "days": days,
        "last_day": f"array_contains(split({day}, ','), 'last')",
        "months": _field_values(month, 1, 12, MONTH_NAMES),
        "weekdays": _field_values(weekday, 0, 6, WEEKDAY_NAMES),
        "lookback": lookback,
    }
    fields = ", ".join(f"'{name}', {value}" for name, value in values.items())
    return f"CASE WHEN size({words}) = 5 THEN named_struct({fields}) END"


def is_cron(cron: str) -> str:
    """Whether every field of a parsed cron text was understood."""
    return "(" + " AND ".join(f"{cron}.{name} IS NOT NULL" for name in CRON_FIELDS) + ")"


def day_matches(cron: str, day: str) -> str:
    return (
        f"(array_contains({cron}.months, month({day})) AND array_contains({cron}.weekdays, weekday({day}))"
        f" AND (array_contains({cron}.days, day({day})) OR ({cron}.last_day AND last_day({day}) = {day})))"
    )


def at_minute(day: str, minute: str) -> str:
    """The instant ``minute`` minutes after midnight of ``day``."""
    return f"(CAST({day} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, {minute}))"


def first_fire(cron: str, day: str) -> str:
    """First fire on ``day``, null when the schedule does not fire that day."""
    first = at_minute(day, f"array_min({cron}.hours) * 60 + array_min({cron}.minutes)")
    return f"CASE WHEN {day_matches(cron, day)} THEN {first} END"


def _search(pick: str, window: str, cron: str, longest: int) -> str:
    """Nearest firing day: a week and a month are tried before the long ways."""
    spans = [n for n in (7, 31, LOOKBACK_CALENDAR, LONGEST_WAIT) if n <= longest]
    tries = (f"{pick}(filter({window.format(n=n)}, d -> {day_matches(cron, 'd')}))" for n in spans)
    return f"coalesce({', '.join(tries)})"


def previous_days_last_fire(cron: str, day: str, within_lookback: bool = True) -> str:
    """Last fire of the newest firing day before ``day``; a data interval's start is looked for within the lookback only."""
    reach = f"least({{n}}, {cron}.lookback)" if within_lookback else "{n}"
    window = f"sequence(date_sub({day}, {reach}), date_sub({day}, 1))"
    found = _search("array_max", window, cron, LOOKBACK_CALENDAR if within_lookback else LONGEST_WAIT)
    return at_minute(found, f"array_max({cron}.hours) * 60 + array_max({cron}.minutes)")


def fire_minutes(cron: str) -> str:
    """All fires of a firing day, as sorted minutes after midnight."""
    return f"array_sort(flatten(transform({cron}.hours, h -> transform({cron}.minutes, m -> h * 60 + m))))"


def next_fire(cron: str, as_of: str) -> str:
    """First fire at or after ``as_of``, null when the schedule never fires."""
    today = f"CAST({as_of} AS DATE)"
    begun = f"CASE WHEN second({as_of}) > 0 OR date_trunc('second', {as_of}) < {as_of} THEN 1 ELSE 0 END"
    passed = f"(hour({as_of}) * 60 + minute({as_of}) + {begun})"
    later = f"array_min(filter({fire_minutes(cron)}, m -> m >= {passed}))"
    window = f"sequence(date_add({today}, 1), date_add({today}, {{n}}))"
    next_day = _search("array_min", window, cron, LONGEST_WAIT)
    return (
        f"CASE WHEN {day_matches(cron, today)} AND {later} IS NOT NULL THEN {at_minute(today, later)}"
        f" ELSE {at_minute(next_day, f'array_min({cron}.hours) * 60 + array_min({cron}.minutes)')} END"
    )
