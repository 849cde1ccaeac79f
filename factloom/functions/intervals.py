"""Intervals as pairs of columns; an interval whose low end is above its high end is empty (bottom)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]
_INF = float("inf")


def top() -> Pair:
    return F.lit(-_INF), F.lit(_INF)


def bottom() -> Pair:
    return F.lit(1.0), F.lit(0.0)


def is_bottom(a: Pair) -> Column:
    return a[0] > a[1]


def _or_bottom(cond: Column, x: Pair) -> Pair:
    b = bottom()
    return F.when(cond, b[0]).otherwise(x[0]), F.when(cond, b[1]).otherwise(x[1])


def add(a: Pair, b: Pair) -> Pair:
    return _or_bottom(is_bottom(a) | is_bottom(b), (a[0] + b[0], a[1] + b[1]))


def subtract(a: Pair, b: Pair) -> Pair:
    return _or_bottom(is_bottom(a) | is_bottom(b), (a[0] - b[1], a[1] - b[0]))


def negate(a: Pair) -> Pair:
    return _or_bottom(is_bottom(a), (-a[1], -a[0]))


def multiply(a: Pair, b: Pair) -> Pair:
    """Range of the four products; products that are not numbers (0 times infinity) are left out."""
    ps = F.array_compact(F.array(*(F.when(~F.isnan(p), p) for p in (a[0] * b[0], a[0] * b[1], a[1] * b[0], a[1] * b[1]))))
    t = top()
    return _or_bottom(is_bottom(a) | is_bottom(b), (F.coalesce(F.array_min(ps), t[0]), F.coalesce(F.array_max(ps), t[1])))


def divide(a: Pair, b: Pair, compat: bool = False) -> Pair:
    """Anything if the divisor may be 0, nothing if it is 0, else the range of the four quotients.

    With compat, only two of them, which hold all results for dividends that are not negative.
    """
    zero = (b[0] == 0) & (b[1] == 0)
    around = (b[0] <= 0) & (b[1] >= 0)
    t = top()
    q = lambda x, y: F.try_divide(x, y)
    if compat:
        low, high = F.when(b[0] > 0, q(a[0], b[1])).otherwise(q(a[1], b[1])), F.when(b[0] > 0, q(a[1], b[0])).otherwise(q(a[0], b[0]))
    else:
        ps = F.array_compact(F.array(*(F.when(~F.isnan(p), p) for p in (q(a[0], b[0]), q(a[0], b[1]), q(a[1], b[0]), q(a[1], b[1])))))
        low, high = F.coalesce(F.array_min(ps), t[0]), F.coalesce(F.array_max(ps), t[1])
    return _or_bottom(is_bottom(a) | is_bottom(b) | zero, (F.when(around, t[0]).otherwise(low), F.when(around, t[1]).otherwise(high)))


def join(a: Pair, b: Pair) -> Pair:
    """Hull; an empty side adds nothing."""
    return (
        F.when(is_bottom(a), b[0]).when(is_bottom(b), a[0]).otherwise(F.least(a[0], b[0])),
        F.when(is_bottom(a), b[1]).when(is_bottom(b), a[1]).otherwise(F.greatest(a[1], b[1])),
    )


def meet(a: Pair, b: Pair) -> Pair:
    """Intersection."""
    low, high = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return _or_bottom(is_bottom(a) | is_bottom(b) | (low > high), (low, high))


def widen(old: Pair, new: Pair) -> Pair:
    """Ends that moved outwards go to infinity."""
    t = top()
    return F.when(new[0] < old[0], t[0]).otherwise(old[0]), F.when(new[1] > old[1], t[1]).otherwise(old[1])


def contains_zero(a: Pair) -> Column:
    return (a[0] <= 0) & (a[1] >= 0)


def within(a: Pair, b: Pair) -> Column:
    """a lies in b."""
    return is_bottom(a) | ((b[0] <= a[0]) & (a[1] <= b[1]))


def overlap(a: Pair, b: Pair) -> Column:
    return ~is_bottom(a) & ~is_bottom(b) & (a[0] <= b[1]) & (b[0] <= a[1])
