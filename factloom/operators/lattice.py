"""Fixpoints over lattices: a lattice is given as aggregates, and one loop drives them all.

Joins are aggregates that Spark merges, so values of one key are joined before they are shuffled.  A round moves only what has changed:
steps are made of the rows that grew in the round before, and what they give is joined with what was known.  Since values only grow, the
join of all that was ever found for a key is its value, so no round rewrites the rows that stay; those replaced since go when tables are made one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import STEPS, Seen, steps
from factloom.storage import cut_count

#: aggregate(column, those): the join of a column over the rows where `those` holds.
Aggregate = Callable[[str, Column], Column]


@dataclass(frozen=True)
class Lattice:
    """The aggregate that joins each column of a value.  Without columns a value is the presence of its key: a set of keys under union."""

    joins: tuple[tuple[str, Aggregate], ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.joins]

    def joined(self, rows: DataFrame, *keys: str) -> DataFrame:
        """The join of the values of each key."""
        if not self.joins:
            return rows.select(*keys).distinct()
        rows = rows.withColumnsRenamed({c: f"own_{c}" for c in self.columns})
        return rows.groupBy(*keys).agg(*(f(f"own_{c}", F.lit(True)).alias(c) for c, f in self.joins))


def only(f: Callable[[Column], Column]) -> Aggregate:
    """An aggregate that leaves nulls out, over chosen rows."""
    return lambda c, those: f(F.when(those, F.col(c)))


def unless_unknown(f: Callable[[Column], Column]) -> Aggregate:
    """An aggregate under which one null makes the join null: an unknown side stays unknown."""
    return lambda c, those: F.when(F.count_if(those & F.col(c).isNull()) == 0, f(F.when(those, F.col(c))))


#: Sets of keys under union.
ROWS = Lattice()
#: Sets of up to 64 members a row, as bits, under union and under intersection.
SOME = Lattice((("bits", only(F.bit_or)),))
EVERY = Lattice((("bits", only(F.bit_and)),))
#: Intervals; a null side is unbounded.
INTERVAL = Lattice((("lo", unless_unknown(F.min)), ("hi", unless_unknown(F.max))))
Step = Callable[[DataFrame], DataFrame]
#: widen(turn): for columns now and before (named was_<column>) of a row that grew, the values to take instead.
Widen = Callable[[int], dict[str, Column]]


#: Steps whose results are not joined between them make at most so many rows of one.
MULTIPLE = 100


def fanout(edges: DataFrame, *src: str) -> int:
    """The most rows that edges have for one source."""
    return edges.groupBy(*(src or ("src",))).count().agg(F.max("count")).head()[0] or 0


def fixpoint(start: DataFrame, step: Step, lattice: Lattice, *keys: str, widen: Widen | None = None, most: int | None = None) -> DataFrame:
    """(keys, value): the least values above start and all that step makes of them.

    step gives rows of keys and values for rows that grew; it must be monotone.  Where chains of growing values do not end, widen must cut them.
    Small frontiers take several steps a round.  most is the number of rows that a step makes of one at most: where it is small, steps follow
    each other without a shuffle.
    """
    cols = lattice.columns
    frontier, rows = cut_count(lattice.joined(start.select(*keys, *cols), *keys))
    seen, turn, found = Seen(frontier, merge=lambda df: lattice.joined(df, *keys) if cols else df), 0, rows
    apart = most is not None and most**STEPS <= MULTIPLE
    while rows:
        ahead, made = frontier, []
        for _ in range(steps(rows, found)):
            ahead = step(ahead).select(*keys, *cols)
            ahead = ahead if apart else lattice.joined(ahead, *keys)
            made.append(ahead)
        came = reduce(DataFrame.union, made)
        if not cols:
            frontier, rows = cut_count(came.distinct().join(seen.all(), list(keys), "left_anti"))
        else:
            frontier, rows = cut_count(_grown(came, seen.all(), lattice, keys, widen and widen(turn)))
        found += rows
        if rows:
            seen.add(frontier)
        turn += 1
    return lattice.joined(seen.all(), *keys)


def _grown(came: DataFrame, known: DataFrame, lattice: Lattice, keys: tuple[str, ...], widened: dict[str, Column] | None) -> DataFrame:
    """The keys whose value grows by what came, with the new value."""
    both = came.withColumn("came", F.lit(True)).union(known.withColumn("came", F.lit(False)))
    old = ~F.col("came")
    both = both.withColumns({f"own_{c}": F.col(c) for c in lattice.columns})  # a name that no aggregate takes
    joins = [x for c, f in lattice.joins for x in (f(f"own_{c}", F.lit(True)).alias(c), f(f"own_{c}", old).alias(f"was_{c}"))]
    groups = both.groupBy(*keys).agg(*joins, F.bool_or("came").alias("came"), F.bool_or(old).alias("had"))
    grew = reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in lattice.columns))
    fresh = groups.where(F.col("came") & (~F.col("had") | grew))
    value = lambda c: F.when(F.col("had"), widened[c]).otherwise(F.col(c)).alias(c) if widened and c in widened else F.col(c)
    return fresh.select(*keys, *(value(c) for c in lattice.columns))
