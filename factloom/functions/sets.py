"""The lattice of sets, over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def meet(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def below(a: Column, b: Column) -> Column:
    """a is a subset of b."""
    return F.size(F.array_except(a, b)) == 0
