"""Dataflow fixpoints over control-flow facts: guards on all paths, reaching definitions, bounds, types."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import Seen, reachable, spread
from factloom.operators.lattice import EVERY, INTERVAL, ROWS, Lattice, fanout, fixpoint
from factloom.storage import cut, cut_count


def must_guards(blocks: DataFrame, succ: DataFrame, gen: DataFrame, compat: bool = False) -> DataFrame:
    """(block, guard) that hold on entry of a block on every path from the entry; unreachable blocks have none.

    The greatest fixpoint, by its complement: of the guards that some path brings to a block, those that some path lacks are
    found from the entries on, so only guards of the block's own function are ever looked at.  With compat, the least
    fixpoint from empty OUT sets, which loses guards at loop heads.  blocks(block, is_entry), succ(src, dst), gen(block, guard).
    Where blocks name their function (func), the guards of a block are bits instead, and one loop finds them.
    """
    if "func" in blocks.columns and not compat:
        return _named(blocks, *must_bits(blocks, succ, gen.withColumnRenamed("guard", "member"))).withColumnRenamed("member", "guard")
    entry = cut(blocks.where("is_entry").select("block").distinct())
    live = reachable(succ, entry.select(F.col("block").alias("node"))).withColumnRenamed("node", "block")
    edges = cut(succ.select("src", "dst").distinct().join(live.withColumnRenamed("block", "src"), "src", "left_semi"))
    own = cut(gen.select("block", "guard").distinct())
    if compat:
        return _guards_from_below(live.join(entry, "block", "left_anti"), edges, own)
    ahead = lambda f: f.join(edges, F.col("block") == F.col("src")).select(F.col("dst").alias("block"), "guard")
    brought = cut(spread(ahead(own), ahead).join(entry, "block", "left_anti"))
    by = brought.join(edges.select(F.col("src").alias("pred"), F.col("dst").alias("block")), "block")
    silent = cut(by.join(own.toDF("pred", "guard"), ["pred", "guard"], "left_anti").select("block", "guard", "pred"))
    first = silent.join(brought.toDF("pred", "guard"), ["pred", "guard"], "left_anti").select("block", "guard")
    on = silent.select(F.col("block").alias("to"), "guard", F.col("pred").alias("block"))
    lacking = spread(first, lambda f: f.join(on, ["block", "guard"]).select(F.col("to").alias("block"), "guard"))
    return brought.join(lacking, ["block", "guard"], "left_anti")


def must_bits(blocks: DataFrame, succ: DataFrame, gen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, members): what every path from the entry brings to a block, as bits of the members of its function.

    held(block, word, bits) has a row for each 64 members of the function, and members(func, member, word, place, bit) names the bits.  It is the greatest
    fixpoint under intersection: blocks that no path has reached yet hold everything, and so have no row.
    blocks(func, block, is_entry), gen(block, member).
    """
    of = blocks.select("func", "block").distinct()
    own = cut(gen.select("block", "member").join(of, "block").distinct())
    place = F.row_number().over(Window.partitionBy("func").orderBy("member")) - 1
    numbered = own.select("func", "member").distinct().withColumn("at", place)
    members = cut(numbered.select("func", "member", F.shiftright("at", 6).alias("word"), F.expr("at & 63").alias("place"), F.expr("shiftleft(1L, at & 63)").alias("bit")))
    made = cut(own.join(members, ["func", "member"]).groupBy("block", "word").agg(F.bit_or("bit").alias("made")))
    edges = cut(succ.select("src", "dst").distinct())
    start = blocks.where("is_entry").select("func", "block").distinct().join(members.select("func", "word").distinct(), "func")

    def step(f: DataFrame) -> DataFrame:
        out = f.join(made, ["block", "word"], "left").select("block", "word", F.col("bits").bitwiseOR(F.coalesce("made", F.lit(0))).alias("bits"))
        return out.join(edges, F.col("block") == F.col("src")).select(F.col("dst").alias("block"), "word", "bits")

    return fixpoint(start.select("block", "word", F.lit(0).cast("long").alias("bits")), step, EVERY, "block", "word", most=fanout(edges)), members


def _named(blocks: DataFrame, held: DataFrame, members: DataFrame) -> DataFrame:
    """(block, member) of must_bits, for blocks that are no entries."""
    of = blocks.where("not is_entry").select("func", "block").distinct()
    return held.where("bits <> 0").join(of, "block").join(members, ["func", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("block", "member")


class Dominators:
    """The blocks that every path from the entry to a block passes, itself included.

    blocks(func, block, is_entry), succ(src, dst).  Each block is a member that it makes itself, so the sets are bits of must_bits: a function
    of n blocks takes n * n / 64 numbers.  Blocks that no path reaches have none.
    """

    def __init__(self, blocks: DataFrame, succ: DataFrame):
        self.blocks = cut(blocks.select("func", "block", "is_entry").distinct())
        self.edges = cut(succ.select("src", "dst").distinct())
        held, members = must_bits(self.blocks, self.edges, self.blocks.select("block", F.col("block").alias("member")))
        self.members = members.withColumnRenamed("member", "block")
        own = self.members.select("block", "word", "bit")
        self.bits = cut(held.join(own, ["block", "word"], "left").select("block", "word", F.col("bits").bitwiseOR(F.coalesce("bit", F.lit(0))).alias("bits")))

    def depths(self) -> DataFrame:
        """(block, depth): how many blocks dominate it."""
        return self.bits.groupBy("block").agg(F.sum(F.bit_count("bits")).alias("depth"))

    def immediate(self) -> DataFrame:
        """(block, idom, depth): the last block before it on all paths; null for entries.  Dominators of a block are a chain, so it is the deepest other one."""
        depths = cut(self.depths())
        place = F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1 = 1)"))
        each = self.bits.join(self.blocks.select("func", "block"), "block").select("func", "block", "word", place.alias("place"))
        chain = each.join(self.members.select("func", "word", "place", F.col("block").alias("dom")), ["func", "word", "place"]).where("dom <> block").join(depths.toDF("dom", "deep"), "dom")
        found = chain.groupBy("block").agg(F.max_by("dom", "deep").alias("idom"))
        return depths.join(found, "block", "left").select("block", "idom", "depth")

    def back_edges(self) -> DataFrame:
        """(src, header): edges to a block that dominates their source."""
        to = self.edges.join(self.members.select(F.col("block").alias("dst"), "word", "bit"), "dst")
        return to.join(self.bits.withColumnRenamed("block", "src"), ["src", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("src", F.col("dst").alias("header"))


def changed_in_loops(dominators: Dominators, changes: DataFrame) -> DataFrame:
    """(block, var): headers of loops and the variables that a block of the loop changes.  changes(block, var)."""
    body = natural_loops(dominators.edges, dominators.back_edges())
    return body.join(changes.select("block", "var").distinct(), "block").select(F.col("header").alias("block"), "var").distinct()


def loops(dominators: Dominators, stores: DataFrame, compares: DataFrame) -> DataFrame:
    """(header, back_edges, blocks, modified, compared): every natural loop, loops of one header as one.

    modified are the variables that the sources of its back edges store, or where they store none those of its whole body;
    compared are those that its header compares.  stores(block, var), compares(block, var).
    """
    back = cut(dominators.back_edges())
    body = cut(natural_loops(dominators.edges, back))
    kept = lambda df: df.select("block", "var").distinct()
    names = lambda c: F.array_sort(F.collect_set(c)).alias(c)  # noqa: E731  the variables of one loop
    counters = back.withColumnRenamed("src", "block").join(kept(stores), "block").select("header", "var").distinct()
    wider = body.join(counters.select("header").distinct(), "header", "left_anti").join(kept(stores), "block").select("header", "var").distinct()
    modified = counters.union(wider).groupBy("header").agg(names("var")).withColumnRenamed("var", "modified")
    compared = kept(compares).withColumnRenamed("block", "header").groupBy("header").agg(names("var")).withColumnRenamed("var", "compared")
    sizes = body.groupBy("header").agg(F.count("*").alias("blocks"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    found = back.groupBy("header").agg(F.count("*").alias("back_edges")).join(sizes, "header").join(modified, "header", "left").join(compared, "header", "left")
    return found.select("header", "back_edges", "blocks", none("modified"), none("compared"))


def _guards_from_below(inner: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    inner = cut(inner)
    preds = edges.groupBy(F.col("dst").alias("block")).agg(F.count("*").alias("preds"))
    held, size = own.limit(0), 0
    while True:
        out = held.union(own).distinct()
        given = edges.join(out, F.col("src") == F.col("block")).groupBy(F.col("dst").alias("block"), "guard").agg(F.count("*").alias("n"))
        held, now = cut_count(given.join(preds, "block").where("n = preds").select("block", "guard").join(inner, "block", "left_semi"))
        if now == size:
            return held
        size = now


def reaching_definitions(blocks: DataFrame, succ: DataFrame, defs: DataFrame) -> DataFrame:
    """(block, var, def_block, offset) that may reach a block's entry.  defs(var, block, offset); a block kills what it defines."""
    last = defs.groupBy("block", "var").agg(F.max("offset").alias("offset"))
    kills = cut(defs.select("block", "var").distinct())
    edges = cut(succ.select("src", "dst").distinct())
    ahead = lambda f: f.join(edges, F.col("block") == F.col("src")).select(F.col("dst").alias("block"), "var", "def_block", "offset")
    return spread(ahead(last.select("block", "var", F.col("block").alias("def_block"), "offset")), lambda f: ahead(f.join(kills, ["block", "var"], "left_anti")))


def bounds_hull(states: DataFrame, *keys: str) -> DataFrame:
    """Hull of bounds(lo, hi) by keys: an unknown side stays unknown."""
    side = lambda f, c: F.when(F.count(c) == F.count("*"), f(c)).alias(c)
    return states.groupBy(*keys).agg(side(F.min, "lo"), side(F.max, "hi"))


def bounds(
    blocks: DataFrame, succ: DataFrame, init: DataFrame, add: DataFrame, widen_after: int = 8, tests: DataFrame | None = None,
    headers: DataFrame | None = None, thresholds: tuple[int, ...] = (), narrow: int = 0,
) -> DataFrame:
    """(block, var, lo, hi) on entry: hulls of what predecessors give; a null side is unbounded.

    init(block, var, lo, hi) sets a variable in a block, add(block, var, delta) shifts it, tests(src, dst, var, lo, hi) is what an edge
    asks of it, one row an edge and variable; what cannot hold is not handed on.  After some rounds a side that still grows is set to the next
    threshold, or is lost.  That happens at headers(block, var), where given, for the variables that the loop of a header changes (`changed_in_loops`), and
    everywhere from four times as many rounds on, since loops that have two entries may have no header.  Each of at most `narrow` descending passes then takes the headers' values from what their predecessors give,
    and finds the other blocks anew from these.
    """
    edges = cut(succ.select("src", "dst").distinct())
    heads = None if headers is None else cut(headers.select("block", "var").distinct().withColumn("to_head", F.lit(True)))
    sets, shifts = cut(init.select("block", "var", "lo", "hi")), cut(add.select("block", "var", "delta"))
    asked = None if tests is None else cut(tests.select("src", "dst", "var", F.col("lo").alias("least"), F.col("hi").alias("most")))

    def onward(inside: DataFrame) -> DataFrame:
        plus = lambda c: (F.col(c) + F.coalesce("delta", F.lit(0))).cast("long").alias(c)
        out = inside.select("block", "var", "lo", "hi").join(shifts, ["block", "var"], "left").select(F.col("block").alias("src"), "var", plus("lo"), plus("hi"))
        moved = out.join(edges, "src")
        if asked is not None:
            moved = moved.join(asked, ["src", "dst", "var"], "left").withColumns({"lo": F.greatest("lo", "least"), "hi": F.least("hi", "most")})  # nulls are left out
            moved = moved.where(F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") <= F.col("hi")))
        moved = moved.select(F.col("dst").alias("block"), "var", "lo", "hi")
        moved = moved.withColumn("to_head", F.lit(True)) if heads is None else moved.join(heads, ["block", "var"], "left")
        return moved.select("block", "var", F.coalesce("to_head", F.lit(False)).alias("head"), "lo", "hi")

    def step(f: DataFrame) -> DataFrame:
        return onward(f.join(sets.select("block", "var"), ["block", "var"], "left_anti"))

    def next_threshold(side: str, up: bool) -> Column:
        known = F.array(*map(F.lit, sorted(thresholds, reverse=not up))) if thresholds else F.array().cast("array<bigint>")
        return F.get(F.filter(known, lambda t: t >= F.col(side) if up else t <= F.col(side)), F.lit(0)).cast("long")

    def widen(turn: int) -> dict[str, Column]:
        here = (F.col("head") & F.lit(turn >= widen_after)) | F.lit(turn >= 4 * widen_after)
        grows = lambda c: ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
        return {c: F.when(here & grows(c), next_threshold(c, c == "hi")).otherwise(F.col(c)) for c in ("lo", "hi")}

    keys = ("block", "var", "head")
    start, most = cut(onward(sets)), fanout(edges)
    found = cut(fixpoint(start, step, INTERVAL, *keys, widen=widen, most=most))
    for _ in range(narrow if headers is not None else 0):
        given = INTERVAL.joined(start.union(step(found)).where("head"), *keys)
        old = found.where("head").toDF(*keys, "was_lo", "was_hi")
        at_heads, fell = cut_count(given.join(old, list(keys)).where("not (lo <=> was_lo and hi <=> was_hi)").select(*keys, "lo", "hi"))
        if not fell:
            break
        fixed = cut(found.where("head").join(at_heads, list(keys), "left_anti").union(at_heads))
        rest = fixpoint(start.where("not head").union(step(fixed).where("not head")), lambda f: step(f).where("not head"), INTERVAL, *keys, widen=widen, most=most)
        found = cut(fixed.union(rest))
    return found.select("block", "var", "lo", "hi")


def merge_types(states: DataFrame, *keys: str) -> DataFrame:
    """Join of type states(possible_types, is_none, initialized): union, unknown where they differ, all initialised."""
    none = F.when((F.count("is_none") == F.count("*")) & (F.min("is_none") == F.max("is_none")), F.max("is_none"))
    return states.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("possible_types")))).alias("possible_types"), none.alias("is_none"), F.every("initialized").alias("initialized"))


def refined(kind: Column, name: Column, holds: Column, type_: Column, none: Column) -> tuple[Column, Column, Column]:
    """(feasible, type, none) of a value of a type, of which is known or not (null) whether it is none, behind a test.

    Kinds of tests: `none` (is None), `type` (isinstance of name), `truth`.  A test that is null changes nothing.
    """
    is_none, is_type, is_true = kind == "none", kind == "type", kind == "truth"
    excludes_none = (is_none & ~holds) | (is_type & holds) | (is_true & holds)
    only_none = (is_none & holds) | (is_type & ~holds & (type_ == name))
    possible = F.coalesce(
        F.when(excludes_none, ~F.coalesce(none, F.lit(False))).when(only_none, F.coalesce(none, F.lit(True))), F.lit(True)
    ) & F.coalesce(F.when(is_type & holds, type_.isNull() | (type_ == name)), F.lit(True))
    new_type = F.when(is_type & holds, name).otherwise(type_)
    new_none = F.when(excludes_none, F.lit(False)).when(only_none, F.lit(True)).otherwise(none)
    return possible, new_type, new_none


def type_states(blocks: DataFrame, succ: DataFrame, stores: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(block, var, possible_types, is_none, initialized) on a block's entry.

    stores(block, var, offset, type, is_none): the last store of a block gives its type to all blocks it reaches without
    another store, where states merge as in merge_types.  What an entry hands on has no type, may be none or not, and counts as
    initialised; blocks(block, is_entry).  tests(src, dst, var, test, name, holds) refines what an edge hands on, as `refined` says; one row an
    edge and variable.  A variable that no path can bring has no row.
    """
    last = stores.groupBy("block", "var").agg(F.max_by(F.struct("type", "is_none"), "offset").alias("s"))
    kills = cut(last.select("block", "var", "s.type", "s.is_none"))
    edges = cut(succ.select("src", "dst").distinct())
    # a row a block of what it stores, the blocks behind it and what the edges ask, so that a step is one join; as long as the block has stores and edges
    each = edges.withColumn("asked", F.lit(None))
    if tests is not None:
        each = edges.join(tests.groupBy("src", "dst").agg(F.collect_list(F.struct("var", "test", "name", "holds")).alias("asked")), ["src", "dst"], "left")
    out = each.groupBy(F.col("src").alias("block")).agg(F.collect_list(F.struct("dst", "asked")).alias("out"))
    around = cut(out.join(kills.groupBy("block").agg(F.collect_set("var").alias("kills")), "block", "left"))

    def onward(rows: DataFrame, passed: bool) -> DataFrame:
        moved = rows.join(around, "block")
        if passed:
            moved = moved.where(~F.coalesce(F.array_contains("kills", F.col("var")), F.lit(False)))
        moved = moved.select("var", "type", "is_none", F.explode("out").alias("o"))
        if tests is not None:
            moved = moved.withColumn("q", F.get(F.filter("o.asked", lambda q: q["var"] == F.col("var")), F.lit(0)))
            possible, type_, none = refined(*map(F.col, ("q.test", "q.name", "q.holds", "type", "is_none")))
            moved = moved.where(possible).withColumns({"type": type_, "is_none": none})
        return moved.select(F.col("o.dst").alias("block"), "var", "type", "is_none")

    keys = ("block", "var", "type", "is_none")
    unset = reachable_variables(blocks.where("is_entry").select("block"), edges, kills.select("block", "var"))
    unknown = unset.select("block", "var", F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("is_none"))
    atoms = _null_safe(unknown.union(onward(kills, False)), lambda f: onward(f, True), keys, fanout(edges))
    types = F.when(F.col("type").isNull(), F.array().cast("array<string>")).otherwise(F.array("type"))
    return merge_types(atoms.select("block", "var", types.alias("possible_types"), "is_none", F.lit(True).alias("initialized")), "block", "var")


def _null_safe(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], most: int) -> DataFrame:
    """A fixpoint of sets of rows whose last two columns may be null: they travel as one structure, which joins take as a whole."""
    whole = lambda df: df.select(*keys[:2], F.struct(*keys[2:]).alias("value"))
    apart = lambda df: df.select(*keys[:2], "value.*")
    return apart(fixpoint(whole(start), lambda f: whole(step(apart(f))), ROWS, *keys[:2], "value", most=most))


def reachable_variables(entries: DataFrame, edges: DataFrame, kills: DataFrame) -> DataFrame:
    """(block, var): the variables that some block behind an entry stores, at that entry."""
    reach = spread(entries.select(F.col("block").alias("entry"), "block"), lambda f: f.join(edges, F.col("block") == F.col("src")).select("entry", F.col("dst").alias("block")))
    return reach.join(kills, "block").select(F.col("entry").alias("block"), "var").distinct()


def guarded_paths(paths: DataFrame) -> DataFrame:
    """(block, on_all, on_any) of paths(block, guarded)."""
    return paths.groupBy("block").agg(F.every("guarded").alias("on_all"), F.some("guarded").alias("on_any"))


def houdini(candidates: DataFrame, implied_by: DataFrame, violated: DataFrame) -> DataFrame:
    """(pred): greatest set of candidates that holds: what is violated goes, and what rests on something gone goes too.

    implied_by(pred, needs); violated(pred).
    """
    gone = violated.select("pred").union(implied_by.join(candidates.select(F.col("pred").alias("needs")), "needs", "left_anti").select("pred"))
    needs = cut(implied_by.select("pred", "needs").distinct())
    lost = spread(gone, lambda f: needs.join(f.select(F.col("pred").alias("needs")), "needs").select("pred"))
    return candidates.select("pred").distinct().join(lost, "pred", "left_anti")


def ice_conjunction(predicates: DataFrame, implications: DataFrame | None = None) -> DataFrame:
    """(pred, consistent): the largest conjunction true on all positive samples, and whether it rejects every negative one.

    predicates(pred, sample, kind, holds) with kind positive, negative or state; implications(pre, post) between samples: where all
    of the conjunction holds on pre, it must hold on post.  A kept predicate that fails on such a post goes, which can only make
    more pres hold, so the rounds end in the largest set.  consistent is false if a negative sample passes the conjunction; where
    nothing is kept, that verdict stands in a row without a predicate.
    """
    failed = cut(predicates.where("not holds").select("pred", "sample", "kind"))  # what holds is never looked up, so it is not written
    bad = F.coalesce(F.bool_or((F.col("kind") == "positive") & ~F.col("holds")), F.lit(False))
    kept, size = cut_count(predicates.groupBy("pred").agg(bad.alias("bad")).where("not bad").select("pred"))
    while implications is not None and size:
        fails = failed.join(kept, "pred", "left_semi").select("sample", "pred")
        live = implications.join(fails.select(F.col("sample").alias("pre")), "pre", "left_anti")
        lost = fails.join(live.select(F.col("post").alias("sample")), "sample", "left_semi").select("pred").distinct()
        kept, now = cut_count(kept.join(lost, "pred", "left_anti"))
        if now == size:
            break
        size = now
    negative = predicates.where("kind = 'negative'").select("sample").distinct()
    rejected = failed.where("kind = 'negative'").join(kept, "pred", "left_semi").select("sample").distinct()
    consistent = negative.join(rejected, "sample", "left_anti").isEmpty()
    if not size:
        return kept.sparkSession.createDataFrame([(consistent,)], "consistent boolean").select(F.lit(None).cast(kept.schema["pred"].dataType).alias("pred"), "consistent")
    return kept.select("pred", F.lit(consistent).alias("consistent"))


def natural_loops(succ: DataFrame, back_edges: DataFrame) -> DataFrame:
    """(header, block): bodies of loops: the header and what reaches a back edge's source without passing it.

    back_edges(src, header).  Loops with one header are one loop.
    """
    edges = cut(succ.select("src", "dst").distinct())
    start = back_edges.select("header", F.col("src").alias("block")).union(back_edges.select("header", F.col("header").alias("block")))
    return spread(start, lambda f: f.where("block <> header").join(edges, F.col("block") == F.col("dst")).select("header", F.col("src").alias("block")))


def path_states(blocks: DataFrame, succ: DataFrame, gen: DataFrame, rounds: int | None = 50) -> DataFrame:
    """(block, guards, truncated): the sets of guards that some path from the entry has gathered on a block's entry.

    States, not paths, are followed, so loops end when they bring no new set; truncated tells that the rounds ran out first.
    With rounds None all states are found: they are finite in number.
    """
    own = cut(gen.groupBy("block").agg(F.array_sort(F.collect_set("guard")).alias("g")))
    edges = cut(succ.select("src", "dst").distinct())
    frontier = cut(blocks.where("is_entry").select("block", F.array().cast("array<string>").alias("guards")))
    seen = Seen(frontier)
    for _ in count() if rounds is None else range(rounds):
        out = frontier.join(own, "block", "left").select("block", F.array_sort(F.array_union("guards", F.coalesce("g", F.array().cast("array<string>")))).alias("guards"))
        moved = out.join(edges, F.col("block") == F.col("src")).select(F.col("dst").alias("block"), "guards").distinct()
        frontier, rows = cut_count(moved.join(seen.all(), ["block", "guards"], "left_anti"))
        if not rows:
            return seen.all().withColumn("truncated", F.lit(False))
        seen.add(frontier)
    return seen.all().withColumn("truncated", F.lit(True))


def _minimal(sets: Column) -> Column:
    """Of sets of names those that hold no other."""
    own = F.array_sort(F.array_distinct(sets))
    holds = lambda s, t: (t != s) & (F.size(F.array_except(t, s)) == 0)
    return F.filter(own, lambda s: ~F.exists(own, lambda t: holds(s, t)))


#: Families of sets of which none holds another, under union: what every path has, in as few sets as that takes.
LEAST_SETS = Lattice((("sets", lambda c, those: F.coalesce(_minimal(F.flatten(F.collect_set(F.when(those, F.col(c))))), F.array().cast("array<array<string>>"))),))


def least_path_sets(blocks: DataFrame, succ: DataFrame, gen: DataFrame) -> DataFrame:
    """(block, sets): of the sets of guards that paths from the entry gather on a block's entry, those that hold no other.

    A path with more guards than another can only be guarded better, so it is left aside: a block has a chain of incomparable sets instead
    of all sets of guards.  blocks(block, is_entry), gen(block, guard).
    """
    own = cut(gen.groupBy("block").agg(F.array_sort(F.collect_set("guard")).alias("own")))
    edges = cut(succ.select("src", "dst").distinct())

    def step(f: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        out = f.join(own, "block", "left").select("block", _minimal(F.transform("sets", lambda s: F.array_sort(F.array_union(s, F.coalesce("own", none))))).alias("sets"))
        return out.join(edges, F.col("block") == F.col("src")).select(F.col("dst").alias("block"), "sets")

    start = blocks.where("is_entry").select("block", F.array(F.array().cast("array<string>")).alias("sets"))
    return fixpoint(start, step, LEAST_SETS, "block", most=fanout(edges))


def guarded_by_any(blocks: DataFrame, succ: DataFrame, gen: DataFrame, asked: DataFrame) -> DataFrame:
    """(block, ask, on_all, on_any): whether every path to a block, and whether some path, has one of the guards asked for.

    asked(ask, guards), a fixed number of questions; blocks that no path reaches have no row.
    """
    least = least_path_sets(blocks, succ, gen)
    edges = cut(succ.select("src", "dst").distinct())
    ahead = lambda f: f.join(edges, F.col("block") == F.col("src")).select(F.col("dst").alias("block"), "guard")
    live = least.select("block")
    met = fixpoint(ahead(gen.select("block", "guard").distinct().join(live, "block", "left_semi")), ahead, ROWS, "block", "guard", most=fanout(edges))
    asks = F.broadcast(asked.select("ask", "guards"))
    some = met.join(asks, F.array_contains("guards", F.col("guard"))).select("block", "ask").distinct().withColumn("any", F.lit(True))
    every = least.join(asks).select("block", "ask", F.forall("sets", lambda s: F.arrays_overlap(s, F.col("guards"))).alias("on_all"))
    return every.join(some, ["block", "ask"], "left").select("block", "ask", "on_all", F.coalesce("any", F.lit(False)).alias("on_any"))


def guarded_on_paths(states: DataFrame, guard: str) -> DataFrame:
    """(block, on_all, on_any): whether every or some path to a block holds a guard.  Truncated states raise: they would answer wrongly."""
    held = F.when(F.col("truncated"), F.raise_error(F.lit("path states are truncated"))).otherwise(F.array_contains("guards", guard))
    return guarded_paths(states.select("block", held.alias("guarded")))
