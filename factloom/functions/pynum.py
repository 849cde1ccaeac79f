"""Arithmetic with Python's meaning: floor division and remainder take the divisor's sign; division by zero is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_mod(a: Column, b: Column) -> Column:
    """a % b with the sign of b."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floor_div(a: Column, b: Column) -> Column:
    """a // b, rounded down, for whole numbers; exact beyond doubles."""
    return F.try_divide((a - floor_mod(a, b)).cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("long")


def true_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def power(a: Column, b: Column) -> Column:
    """a ** b as a double; 0 to a negative power is null."""
    return F.when((a == 0) & (b < 0), None).otherwise(F.pow(a, b))


def truthy(value: Column, kind: str) -> Column:
    """Python's truth of a typed value; null is false."""
    if kind == "string":
        return F.coalesce(F.length(value) > 0, F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value.cast("double") != 0, F.lit(False)) if kind != "boolean" else F.coalesce(value, F.lit(False))


def normalise_index(i: Column, n: Column) -> Column:
    """The place from 0 of a Python index, null if it is out of range."""
    at = F.when(i < 0, i + n).otherwise(i)
    return F.when((at >= 0) & (at < n), at)


def clip_slice(start: Column, stop: Column, n: Column) -> list[Column]:
    """The bounds of a Python slice of step 1 over n items."""
    side = lambda c, d: F.least(n, F.greatest(F.lit(0), F.when(F.coalesce(c, d) < 0, F.coalesce(c, d) + n).otherwise(F.coalesce(c, d))))
    return [side(start, F.lit(0)).alias("start"), side(stop, n).alias("stop")]
