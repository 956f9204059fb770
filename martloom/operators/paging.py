"""Numbered pages over a total order."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Keys drawn for one sketch of the order; they go to the driver.
SKETCH = 4096
# So many pages may lie before the page in the range that is read last.
PAGES_BEFORE = 8


@dataclass(frozen=True)
class Sort:
    """One term of an order; nulls come last."""

    name: str
    descending: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_last()

    def before(self, value: Column | None) -> Column:
        """Whether a row comes before a key by this term alone; a key of None is a null."""
        c = F.col(self.name)
        if value is None:
            return c.isNotNull()
        return F.coalesce(c > value if self.descending else c < value, F.lit(False))


def _before(df: DataFrame, order: list[Sort], key: tuple) -> Column:
    """Whether a row comes before a key, given as text."""
    out, same = F.lit(False), F.lit(True)
    for term, text in zip(order, key):
        value = F.lit(text).cast(df.schema[term.name].dataType)
        out = out | (same & term.before(None if text is None else value))
        same = same & F.col(term.name).eqNullSafe(value)
    return out


def _between(df: DataFrame, order: list[Sort], low: tuple | None, high: tuple | None) -> DataFrame:
    """Rows from ``low`` on and before ``high``; the bounds of the first term stand alone too, so they reach the scan."""
    first = order[0]
    value = lambda key: F.lit(key[0]).cast(df.schema[first.name].dataType)
    if low is not None:
        if low[0] is None:
            df = df.where(F.col(first.name).isNull())
        else:
            reached = F.col(first.name) <= value(low) if first.descending else F.col(first.name) >= value(low)
            df = df.where(reached | F.col(first.name).isNull())
        df = df.where(~_before(df, order, low))
    if high is not None:
        if high[0] is not None:
            df = df.where(F.col(first.name) >= value(high) if first.descending else F.col(first.name) <= value(high))
        df = df.where(_before(df, order, high))
    return df


def page(df: DataFrame, order: list[Sort], number: int, size: int) -> DataFrame:
    """Page ``number`` of ``size`` rows; the order has to be total for pages not to overlap."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return rank_slice(df, order, (number - 1) * size, size)


def rank_slice(df: DataFrame, order: list[Sort], skip: int, size: int, sketch: int = SKETCH, pages_before: int = PAGES_BEFORE) -> DataFrame:
    """Rows ``skip`` to ``skip + size`` of the sorted frame, without sorting or storing it.

    A sketch of keys drawn at random brackets the slice; two counts over the rows say exactly how many lie before the bracket and
    in it, and the next sketch is drawn inside. Each round leaves a few hundredths of the rows, until few pages lie before the slice in its bracket.
    Only rows of that bracket take part in the top-k. A bracket that turns out to miss the slice is given up on that side, and rows
    that the order can't tell apart end the search.
    """
    low = high = inside = None
    before = 0
    while skip - before > pages_before * size:
        rows = _between(df, order, low, high).select(*[t.name for t in order])
        if inside is None:
            inside = rows.count()
        if inside <= skip - before:
            return df.limit(0)
        drawn = rows.orderBy(F.rand()).limit(sketch).orderBy(*[t.column for t in order])
        keys = [tuple(r) for r in drawn.select(*[F.col(t.name).cast("string") for t in order]).collect()]
        margin = 0 if len(keys) == inside else 2 / math.sqrt(len(keys))
        first = math.floor(((skip - before) / inside - margin) * len(keys))
        last = math.ceil(((skip + size - before) / inside + margin) * len(keys))
        new_low, new_high = keys[first] if first > 0 else low, keys[last] if last < len(keys) else high
        passed = [F.count_if(_before(df, order, k) if k is not None else F.lit(False)) for k in (new_low if first > 0 else None, new_high if last < len(keys) else None)]
        lower, upper = rows.select(passed[0].alias("a"), passed[1].alias("b")).first()
        if before + lower > skip:
            new_low, lower = low, 0
        if last >= len(keys) or before + upper < skip + size:
            new_high, upper = high, inside
        if upper - lower == inside:
            break
        low, high, before, inside = new_low, new_high, before + lower, upper - lower
    return _between(df, order, low, high).orderBy(*[t.column for t in order]).offset(skip - before).limit(size)
