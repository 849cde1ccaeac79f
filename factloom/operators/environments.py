"""Abstract values of variables, statement by statement: ranges of numbers, and whether a value is none.

A function's statements are an ordered fold over an environment.  So that a long function is no single task, they are cut into
segments: each segment is first reduced, by itself, to what it does to an environment; these effects are composed in order, which gives the
environment that each segment starts with; then every segment is run, again by itself.

The ends of a range are sums of other ends with factors that are not negative: the low end of a - b is that of a plus the negated high end
of b.  Effects are such sums over the variables at a segment's start, so composing them gives what running the statements gives.  Only a product
of two variables is none; it ends an effect, and is applied to ranges.
"""

from __future__ import annotations

import json
from math import inf, isnan

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statements of a segment.
SEGMENT = 10_000
#: A variable that nothing is known of.
UNKNOWN = (-inf, inf, "maybe")
_VALUES = "func long, pos long, kind string, lo double, hi double, none string, verdict string"

Value = tuple[float, float, str]


def product(a: Value, b: Value) -> Value:
    """The range of a product; zero times an open end is left out."""
    ends = [x * y for x in a[:2] for y in b[:2]]
    known = [x for x in ends if not isnan(x)]
    return (min(known), max(known), "no") if known else (-inf, inf, "no")


class Sum:
    """A value as sums of ends of other values: `plus` counts each with its own ends, `minus` with the other ones negated."""

    __slots__ = ("plus", "minus", "lo", "hi", "none")

    def __init__(self, plus: dict[str, float], minus: dict[str, float], lo: float, hi: float, none: str):
        self.plus, self.minus, self.lo, self.hi, self.none = plus, minus, lo, hi, none

    @classmethod
    def of(cls, var: str) -> Sum:
        """A variable itself; `=` before a name says that it is none where that variable is."""
        return cls({var: 1.0}, {}, 0.0, 0.0, f"={var}")

    def added(self, other: Sum, negated: bool) -> Sum:
        plus, minus = (other.minus, other.plus) if negated else (other.plus, other.minus)
        join = lambda a, b: {k: a.get(k, 0.0) + b.get(k, 0.0) for k in a.keys() | b.keys()}
        lo, hi = (-other.hi, -other.lo) if negated else (other.lo, other.hi)
        return Sum(join(self.plus, plus), join(self.minus, minus), self.lo + lo, self.hi + hi, "no")

    def scaled(self, by: float) -> Sum:
        if by == 0:
            return Sum({}, {}, 0.0, 0.0, "no")
        plus, minus = (self.plus, self.minus) if by > 0 else (self.minus, self.plus)
        times = lambda d: {k: v * abs(by) for k, v in d.items()}
        return Sum(times(plus), times(minus), *sorted((self.lo * by, self.hi * by)), "no")

    def at(self, env: dict[str, Value]) -> Value:
        """The value in an environment."""
        lo, hi = self.lo, self.hi
        for k, v in self.plus.items():
            a, b, _ = env.get(k, UNKNOWN)
            lo, hi = lo + v * a, hi + v * b
        for k, v in self.minus.items():
            a, b, _ = env.get(k, UNKNOWN)
            lo, hi = lo - v * b, hi - v * a
        return lo, hi, env.get(self.none[1:], UNKNOWN)[2] if self.none[:1] == "=" else self.none


def effect_of(s: dict, get) -> Sum | None:
    """What a statement without a product makes, by the sums of the variables; None for a check."""
    kind, const = s["kind"], lambda: Sum({}, {}, s["lo"], s["hi"], s["none"] or "no")
    if kind == "const":
        return const()
    if kind == "copy":
        return get(s["left"])
    if kind in ("add", "subtract"):
        return get(s["left"]).added(get(s["right"]) if s["right"] is not None else const(), kind == "subtract")
    if kind == "scale":
        return get(s["left"]).scaled(s["lo"])
    return None


def effects_of(statements: list[dict]) -> list:
    """The effect of a segment: dictionaries of sums, with a product (target, left, right) before each but the first."""
    out: list = []
    now: dict[str, Sum] = {}
    for s in statements:
        if s["kind"] == "multiply":
            out += [now, (s["target"], s["left"], s["right"])]
            now = {}
        elif (made := effect_of(s, lambda v: now.get(v) or Sum.of(v))) is not None:
            now[s["target"]] = made
    return [*out, now]


def applied(effects: list, env: dict[str, Value]) -> dict[str, Value]:
    """The environment behind a segment."""
    for e in effects:
        if isinstance(e, dict):
            env = env | {k: v.at(env) for k, v in e.items()}
        else:
            env = env | {e[0]: product(env.get(e[1], UNKNOWN), env.get(e[2], UNKNOWN))}
    return env


def verdict(kind: str, value: Value, size: float | None) -> str:
    """SAFE, UNSAFE where it must fail, else UNKNOWN."""
    lo, hi, none = value
    if kind == "check_null":
        return {"no": "SAFE", "yes": "UNSAFE"}.get(none, "UNKNOWN")
    if kind == "check_division":
        return "SAFE" if lo > 0 or hi < 0 else "UNSAFE" if lo == hi == 0 else "UNKNOWN"
    return "SAFE" if lo >= 0 and hi <= size - 1 else "UNSAFE" if hi < 0 or lo > size - 1 else "UNKNOWN"


def run_segment(statements: list[dict], env: dict[str, Value]) -> list[tuple]:
    """(pos, kind, value, verdict) of each statement: of what it makes, or of what it checks."""
    env, out = dict(env), []
    for s in statements:
        kind = s["kind"]
        if kind.startswith("check_"):
            value = env.get(s["left"], UNKNOWN)
            out.append((s["pos"], kind, value, verdict(kind, value, s["lo"])))
            continue
        value = product(env.get(s["left"], UNKNOWN), env.get(s["right"], UNKNOWN)) if kind == "multiply" else effect_of(s, Sum.of).at(env)
        env[s["target"]] = value
        out.append((s["pos"], kind, value, None))
    return out


def _packed(effects: list) -> str:
    return json.dumps([{k: [v.plus, v.minus, v.lo, v.hi, v.none] for k, v in e.items()} if isinstance(e, dict) else list(e) for e in effects])


def _unpacked(text: str) -> list:
    return [{k: Sum(*v) for k, v in e.items()} if isinstance(e, dict) else tuple(e) for e in json.loads(text)]


def _ordered(table: pa.Table) -> list[dict]:
    return table.sort_by("pos").to_pylist()


def tracked(statements: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(func, pos, kind, lo, hi, none, verdict): the value that each statement makes or checks; a null end is open.

    statements(func, pos, kind, target, left, right, lo, hi, none), pos from 0.  Kinds: `const` (also the result of a call, as its contract has it),
    `copy`, `add` and `subtract` (of the variable right, or of the range lo to hi where it is null), `scale` (by lo; by 0 it is 0), `multiply`;
    `check_division`, `check_null`, `check_index` (of left, the last against the size lo).  Arithmetic is never none.  A
    variable that was not set is unknown.
    """
    rows = statements.withColumn("segment", F.floor(F.col("pos") / segment))

    def reduced(key, table):
        return pa.table({"func": [key[0].as_py()], "segment": [key[1].as_py()], "effect": [_packed(effects_of(_ordered(table)))]})

    def composed(key, table):
        env: dict[str, Value] = {}
        out = []
        for x in table.sort_by("segment").to_pylist():
            env = applied(_unpacked(x["effect"]), env)
            out.append((x["func"], x["segment"] + 1, json.dumps(env)))
        func, at, start = zip(*out, strict=True)
        return pa.table({"func": pa.array(func, pa.int64()), "segment": pa.array(at, pa.int64()), "env": pa.array(start, pa.string())})

    def run(key, table, start):
        env = {k: tuple(v) for k, v in json.loads(start["env"][0].as_py()).items()} if start.num_rows else {}
        done = run_segment(_ordered(table), env) if table.num_rows else []
        cols = list(zip(*((key[0].as_py(), pos, kind, *value, told) for pos, kind, value, told in done), strict=True)) or [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _VALUES.split(", ")])

    long = rows.where(F.col("segment") > 0).select("func").distinct()
    effects = rows.join(long, "func", "left_semi").groupBy("func", "segment").applyInArrow(reduced, "func long, segment long, effect string")
    starts = effects.groupBy("func").applyInArrow(composed, "func long, segment long, env string")
    values = rows.groupBy("func", "segment").cogroup(starts.groupBy("func", "segment")).applyInArrow(run, _VALUES)
    ends = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).when(F.abs(c) != inf, F.col(c)).alias(c)  # noqa: E731  zero has no sign
    return values.select("func", "pos", "kind", ends("lo"), ends("hi"), "none", "verdict")
