"""Findings of two tools, or of two sides of a fix, matched exactly and within a tolerance of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import parts

KEY = ["file", "line", "bug_type"]
#: Types of the right tool and the type of the left tool that they may stand for.
RELATED = {"LOG_INJECTION": "CLEARTEXT_LOGGING"}


def exact_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Findings of both."""
    return left.select(*KEY).intersect(right.select(*KEY))


def loose_match(left: DataFrame, right: DataFrame, margin: int = 3, related: dict[str, str] = RELATED) -> DataFrame:
    """Of findings without an exact match, each left one with the smallest right one near it.

    Lines are bucketed by the margin, so the join is on equal keys: a line meets its own bucket and both neighbours.
    """
    n = parts(left, right)
    side = lambda df, more: df.select(*KEY, F.lit(more).alias("more"))
    alone = side(left, 1).union(side(right, -1)).repartition(n, *KEY).groupBy(*KEY).agg(F.sum("more").alias("more"))
    only_l, only_r = alone.where("more > 0").select(*KEY), alone.where("more < 0").select(*KEY)
    width = 2 * margin + 1
    kind = F.col("bug_type")
    stands_for = F.array_compact(F.array(kind, *(F.when(kind == ours, F.lit(theirs)) for ours, theirs in related.items())))
    bucket = F.floor(F.col("line") / width)
    r = only_r.select("file", F.col("line").alias("right_line"), kind.alias("right_type"), F.explode(F.array_distinct(stands_for)).alias("bug_type"), bucket.alias("b"))
    r = r.select("file", "right_line", "right_type", "bug_type", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bucket"))
    place = ["file", "bug_type", "bucket"]
    near = only_l.withColumn("bucket", bucket).repartition(n, *place).join(r.repartition(n, *place), place).where(F.abs(F.col("line") - F.col("right_line")) <= margin)
    return near.groupBy(*KEY, "bucket").agg(F.min(F.struct("right_line", "right_type")).alias("m")).select(*KEY, "m.right_line", "m.right_type")


def near_lines(findings: DataFrame, changed: DataFrame, margin: int = 3) -> DataFrame:
    """Findings within a margin of a changed line of their file; files without changed lines have none.

    Each changed line stands for the lines around it, so the semi-join is on equal keys.
    """
    around = changed.select("file", F.explode(F.sequence(F.col("line") - margin, F.col("line") + margin)).alias("line")).distinct()
    return findings.join(around, ["file", "line"], "left_semi")


def classify_near(buggy: DataFrame, fixed: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, classification) from types found near the change on either side; errors count if any scan failed.

    cases(case_id, any_error, all_error); buggy and fixed(case_id, bug_type).
    """
    types = lambda df, name: df.groupBy("case_id").agg(F.collect_set("bug_type").alias(name))
    rows = cases.join(types(buggy, "b"), "case_id", "left").join(types(fixed, "f"), "case_id", "left")
    none = F.array().cast("array<string>")
    b, f = F.coalesce("b", none), F.coalesce("f", none)
    gone = F.size(F.array_except(b, f)) > 0
    kind = (
        F.when(F.col("any_error"), "ERROR").when(gone, "TRUE_POSITIVE").when((F.size(F.array_except(f, b)) > 0) & (F.size(b) == 0), "FALSE_POSITIVE")
        .when(F.size(F.array_intersect(b, f)) > 0, "BOTH_BUG").otherwise("FALSE_NEGATIVE")
    )
    return rows.select("case_id", kind.alias("classification"), gone.alias("detected"))


def classify_signatures(scans: DataFrame, error_policy: str = "all") -> DataFrame:
    """(case_id, classification) from scans(case_id, side, verdict, bug_type, line), one row a finding or a scan without.

    error_policy "all": a side failed if all its scans did, and the case if both sides did; "any": one failed scan is enough.
    """
    side = lambda s: F.col("side") == s
    sig = F.when(F.col("bug_type").isNotNull(), F.struct("bug_type", "line"))
    per = scans.groupBy("case_id").agg(
        *(F.coalesce(F.max(F.when(side(s), (F.col("verdict") == "BUG").cast("int"))), F.lit(0)).alias(f"{s}_bug") for s in ("buggy", "fixed")),
        *(F.coalesce(F.min(F.when(side(s), (F.col("verdict") == "ERROR").cast("int"))), F.lit(1)).alias(f"{s}_error") for s in ("buggy", "fixed")),
        F.max((F.col("verdict") == "ERROR").cast("int")).alias("any_error"),
        *(F.collect_set(F.when(side(s), sig)).alias(f"{s}_sigs") for s in ("buggy", "fixed")),
    )
    failed = (F.col("any_error") == 1) if error_policy == "any" else (F.col("buggy_error") == 1) & (F.col("fixed_error") == 1)
    b, f = F.col("buggy_bug") == 1, F.col("fixed_bug") == 1
    kind = (
        F.when(failed, "ERROR").when(b & ~f, "TRUE_POSITIVE").when(~b & ~f, "FALSE_NEGATIVE").when(~b & f, "FALSE_POSITIVE")
        .when(F.size(F.array_except("buggy_sigs", "fixed_sigs")) > 0, "TRUE_POSITIVE").otherwise("BOTH_BUG")
    )
    return per.select("case_id", kind.alias("classification"))


def resolve_calls(external: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, name, target): exact qualified name, else dotted suffix (the smallest), else a unique simple name.

    All stages are joins on equal keys.  A function has a row for each of its dotted suffixes, and those of one suffix are reduced to the
    smallest before they are shuffled, so a name that very many functions and calls share is no product of the two.
    """
    simple = lambda c: F.element_at(F.split(c, r"\."), -1)
    f = functions.select("qname", simple(F.col("qname")).alias("simple"))
    names = external.select("name").distinct().withColumn("simple", simple(F.col("name")))
    exact = names.join(f.select(F.col("qname").alias("exact")).distinct(), F.col("name") == F.col("exact"), "left")
    parts = F.split("qname", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    dotted = f.where(F.size(parts) > 2).select("qname", F.explode(ends).alias("name")).groupBy("name").agg(F.min("qname").alias("suffix"))
    unique = f.groupBy("simple").agg(F.count("*").alias("n"), F.min("qname").alias("only")).where("n = 1")
    known = exact.join(dotted, "name", "left").join(unique, "simple", "left")
    target = F.coalesce("exact", "suffix", F.when(~F.col("name").contains("."), F.col("only")))
    return external.join(known.select("name", target.alias("target")), "name", "left")


def resolve_self_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, name, target): self.m resolves to the method m of the caller's class."""
    owner = F.regexp_extract("src", r"^(.*)\.[^.]+$", 1)
    wanted = calls.where(F.col("name").startswith("self.")).withColumn("wanted", F.concat(owner, F.lit("."), F.substring("name", 6, 1 << 20)))
    return wanted.join(functions.select(F.col("qname").alias("target")).distinct(), F.col("wanted") == F.col("target"), "left").select("src", "name", "target")


def callers_of(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(name, src): functions that call something of a simple name.  calls(src, name), names(name)."""
    simple = calls.select("src", F.element_at(F.split("name", r"\."), -1).alias("name")).distinct()
    return simple.join(names.select("name").distinct(), "name").select("name", "src")


def definitions_of(functions: DataFrame, names: DataFrame) -> DataFrame:
    """(name, qname): all definitions of a simple name."""
    simple = functions.select("qname", F.element_at(F.split("qname", r"\."), -1).alias("name")).distinct()
    return simple.join(names.select("name").distinct(), "name").select("name", "qname")


def locate(names: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, line): where a qualified function is.

    Its own fact in functions(qname, file, line), else line 1 of the file with the longest of its dotted prefixes in
    files(file), else line 1 of its parent module's path, whether or not there is such a file.
    """
    asked = names.select("name").distinct().withColumn("parts", F.split("name", r"\."))
    path = lambda n: F.concat(F.array_join(F.slice("parts", 1, n), "/"), F.lit(".py"))
    own = functions.groupBy(F.col("qname").alias("name")).agg(F.min(F.struct("file", "line")).alias("own"))
    tried = asked.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(n.alias("depth"), path(n).alias("file")))).alias("t")).select("name", "t.*")
    there = tried.join(files.select("file").distinct(), "file", "left_semi").groupBy("name").agg(F.max_by("file", "depth").alias("module"))
    parent = path(F.greatest(F.size("parts") - 1, F.lit(1)))
    found = asked.join(own, "name", "left").join(there, "name", "left")
    return found.select("name", F.coalesce("own.file", "module", parent).alias("file"), F.coalesce("own.line", F.lit(1)).cast("int").alias("line"))


def against_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: confusion counts of results(file, found) against truth(file, is_bug); files of one side alone are left out."""
    both = results.join(truth, "file")
    f, b = F.col("found"), F.col("is_bug")
    return both.agg(F.count_if(f & b).alias("tp"), F.count_if(f & ~b).alias("fp"), F.count_if(~f & b).alias("fn"), F.count_if(~f & ~b).alias("tn"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(was, now, n): how the classes of old(bug_id, cls) changed in new; a bug that new lacks is MISSING, bugs of new alone are left out."""
    both = old.select("bug_id", F.col("cls").alias("was")).join(new.select("bug_id", F.col("cls").alias("now")), "bug_id", "left")
    return both.groupBy("was", F.coalesce("now", F.lit("MISSING")).alias("now")).agg(F.count("*").alias("n"))


def by_place(findings: DataFrame) -> DataFrame:
    """(file, line, bug_types): the distinct types at each place, in order."""
    return findings.groupBy("file", "line").agg(F.array_sort(F.collect_set("bug_type")).alias("bug_types"))
