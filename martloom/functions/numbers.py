"""Rounding that agrees with round-half-even on the exact binary value of a double."""

from pyspark.sql import Column, functions as F

# Veltkamp constant: splits a double into two halves whose products are exact.
_SPLIT = float(2**27 + 1)


def rint_long(x: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.rint(x).cast("long")


def round2(x: Column) -> Column:
    """Two decimals, ties to even, judged on the exact binary value.

    ``bround`` looks at the shortest decimal text of a double, so 2.675 (stored slightly
    below the tie) would go up. The scaled value is therefore taken as a hi + lo pair
    whose sum is exact, and lo decides what hi alone would call a tie.
    """
    x = x.cast("double")
    scaled = x * 100.0
    c = x * _SPLIT
    hi = c - (c - x)
    lo = x - hi
    error = (hi * 100.0 - scaled) + lo * 100.0
    floor = F.floor(scaled).cast("double")
    over = (scaled - floor) - 0.5
    side = over + error
    rounded = (
        F.when(side > 0, floor + 1.0)
        .when(side < 0, floor)
        .otherwise(F.when(F.pmod(floor, F.lit(2.0)) == 0, floor).otherwise(floor + 1.0))
    )
    return rounded / 100.0
