"""Scans of repositories: tiers, counts by verdict, paths of clones, the scope of a fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("BUG", "SAFE", "UNKNOWN", "ERROR")


def of_tier(repos: DataFrame, tier: int) -> DataFrame:
    """repos(repo, tier) of one tier; other tiers than 1 to 3 do not exist."""
    if tier not in (1, 2, 3):
        raise ValueError(f"no tier {tier}")
    return repos.where(F.col("tier") == tier)


def by_repo(files: DataFrame, most: int | None = None) -> DataFrame:
    """files(repo, path, verdict) -> (repo, files, one column a verdict): what the scan of each repository found.

    With `most`, only the first paths of a repository count, as in a scan that is told to stop there.
    """
    if most is not None:
        place = F.row_number().over(Window.partitionBy("repo").orderBy("path"))  # a limit that Spark applies before it shuffles
        first = files.select("repo", "path").distinct().withColumn("n", place).where(F.col("n") <= most).select("repo", "path")
        files = files.join(first, ["repo", "path"], "left_semi")
    return files.groupBy("repo").agg(F.count("*").alias("files"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def save(found: DataFrame, path: str) -> None:
    """One folder of JSON lines a repository."""
    found.write.mode("overwrite").partitionBy("repo").json(path)


def bugs_of_project(findings: DataFrame, skipped: tuple[str, ...] = ("migrations", "test", "__pycache__"), parts: tuple[str, ...] = ()) -> DataFrame:
    """findings(path, bug_type) -> (bug_type, n): paths that hold none of `skipped`, and one of `parts` if any are given."""
    holds = lambda some: F.exists(F.array(*map(F.lit, some)), lambda x: F.contains(F.col("path"), x)) if some else F.lit(False)
    kept = findings.where(~holds(skipped))
    return (kept.where(holds(parts)) if parts else kept).groupBy("bug_type").agg(F.count("*").alias("n"))


def clone_paths(repos: DataFrame, clones: DataFrame, workdir: str) -> DataFrame:
    """(repo, path): where each repository lies; null if it is nowhere.

    clones(path) lists the clones.  In order: the name is itself the absolute path of a clone; the folder owner__name
    below workdir; a folder of that name in other letters, the least such path.
    """
    known = clones.select("path").distinct()
    asked = repos.select("repo").distinct().withColumn("slug", F.concat(F.lit(workdir.rstrip("/") + "/"), F.replace("repo", F.lit("/"), F.lit("__"))))
    any_case = known.groupBy(F.lower("path").alias("low")).agg(F.min("path").alias("other"))
    found = asked.join(known.select(F.col("path").alias("own")), F.col("repo").startswith("/") & (F.col("repo") == F.col("own")), "left")
    found = found.join(known.select(F.col("path").alias("exact")), F.col("slug") == F.col("exact"), "left")
    found = found.join(any_case, F.lower("slug") == F.col("low"), "left")
    return found.select("repo", F.coalesce("own", "exact", "other").alias("path"))


# What the lines of a fix hold, and the exceptions a new handler may name with the type each stands for.
NONE_CHECKS = (r"if\s+\w+\s+is\s+not\s+none", r"if\s+\w+\s+is\s+none", r"if\s+not\s+\w+", r"if\s+\w+\s*!=\s*none", r"if\s+\w+\s*==\s*none")
HANDLED = {
    "attributeerror": "NULL_PTR", "typeerror": "TYPE_CONFUSION", "keyerror": "BOUNDS", "indexerror": "BOUNDS", "valueerror": "ASSERT_FAIL",
    "runtimeerror": "ASSERT_FAIL", "filenotfounderror": "ASSERT_FAIL", "oserror": "ASSERT_FAIL", "ioerror": "ASSERT_FAIL", "exception": "ASSERT_FAIL",
}
NONE_WORDS = ("attributeerror", ".next", ".prev", "nonetype", "has no attribute", "cannot ", "none ")
RAISES = ("raise ansibleerror", "raise valueerror", "raise typeerror", "raise runtimeerror", "raise assertionerror")
FORMATTING = ("format(", 'f"', "f'", ".strip", ".replace", "%s", ".join")
CRASH_WORDS = ("error", "exception", "raise", "assert", "crash", "fail", "none", "null", "not found", "missing", "invalid")


def _any(text: Column, *parts: str) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(text, x))


def scope(patches: DataFrame) -> DataFrame:
    """patches(patch, text) of fixes -> (patch, in_scope, category, bug_type, confidence) by the first rule that holds.

    The rules look at the code lines that a patch adds and removes (comments and blank lines do not count), at its whole text in
    small letters, and at the Python files it changes.  A null text counts as an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    split = F.split(text, r"\r?\n")
    bare = lambda sign: F.filter(
        F.transform(F.filter(split, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.trim(F.substr(x, F.lit(2)))), lambda x: (x != "") & ~x.startswith("#")
    )
    named = F.filter(F.transform(F.filter(split, lambda x: x.startswith("diff --git")), lambda x: F.regexp_replace(F.get(F.split(F.trim(x), r"\s+"), F.lit(3)), "^[b/]+", "")), lambda x: x.endswith(".py"))
    rows = patches.select("patch", text.alias("text"), F.lower(text).alias("low"), bare("+").alias("plus"), bare("-").alias("minus"), F.array_distinct(named).alias("files"))
    rows = rows.withColumn("added", F.lower(F.array_join("plus", "\n"))).withColumn("removed", F.lower(F.array_join("minus", "\n")))
    rows = rows.withColumn("code", F.concat_ws("\n", "added", "removed"))
    c = F.col
    low, added, removed, code = c("low"), c("added"), c("removed"), c("code")
    new = lambda part: F.contains(added, F.lit(part)) & ~F.contains(removed, F.lit(part))
    checks = F.lit(False)
    for p in NONE_CHECKS:
        checks = checks | added.rlike(p)
    guards = F.regexp_extract_all("text", F.lit(r"(?m)^\+\s*if\s+(\w+)"), F.lit(1))
    reads = lambda after: F.exists(guards, lambda v: F.regexp_like("text", F.concat(F.lit("(?m)^-.*"), v, F.lit(after))))
    formats = (F.size("plus") > 0) & F.forall(F.slice("plus", 1, 3), lambda x: _any(x, *FORMATTING))
    moves = lambda lines: F.forall(lines, lambda x: x.startswith("import ") | x.startswith("from "))
    words = F.size(F.filter(F.array(*map(F.lit, CRASH_WORDS)), lambda x: F.contains(low, x)))
    # the first handled exception in order of the table
    handled = F.get(F.filter(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("kind")) for k, v in HANDLED.items())), lambda h: F.contains(added, h["name"])), F.lit(0))
    out, rules = False, []

    def rule(holds: Column, category: str | Column, kind: str | Column, confidence: float, inside: bool = True) -> None:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        rules.append(F.when(holds, F.struct(F.lit(inside).alias("in_scope"), as_column(category).alias("category"), as_column(kind).alias("bug_type"), F.lit(confidence).alias("confidence"))))

    # The order of the rules, their words, categories, types and confidences; the first that holds counts.
    rule(F.trim(F.translate("text", "\n\r\t", "   ")) == "", "no-patch", "", 1.0, out)
    rule(F.forall("files", lambda f: F.contains(F.lower(f), F.lit("test"))), "test-only", "", 0.9, out)
    rule(checks | (F.contains(added, F.lit(".get(")) & _any(code, *NONE_WORDS)), "null-deref", "NULL_PTR", 0.85)
    rule(_any(low, "attributeerror", "has no attribute"), "attribute-error", "NULL_PTR", 0.80)
    rule(_any(low, "typeerror"), "type-error", "TYPE_CONFUSION", 0.80)
    rule(new("isinstance"), "type-check", "TYPE_CONFUSION", 0.70)
    rule(_any(low, "keyerror"), "key-error", "BOUNDS", 0.75)
    rule(_any(added, ".get(") & _any(removed, "["), "key-error", "BOUNDS", 0.65)
    rule(_any(low, "indexerror"), "index-error", "BOUNDS", 0.80)
    rule(added.rlike(r"if\s+\w+\s*<\s*len\("), "bounds-check", "BOUNDS", 0.70)
    rule(_any(low, "valueerror") & _any(added, "raise valueerror"), "value-error", "ASSERT_FAIL", 0.70)
    rule(_any(low, "valueerror"), "value-error", "ASSERT_FAIL", 0.65)
    rule(_any(low, "zerodivision", "zero division", "divide by zero"), "div-zero", "DIV_ZERO", 0.90)
    rule(added.rlike(r"if\s+\w+\s*[!=]=\s*0") & _any(code, "/", "divmod", "%"), "div-zero", "DIV_ZERO", 0.70)
    rule(new("except ") & handled.isNotNull(), F.concat(F.lit("unhandled-"), handled["name"]), handled["kind"], 0.70)
    rule(new("except "), "unhandled-exception", "ASSERT_FAIL", 0.55)
    rule(new("raise ") & _any(added, *RAISES), "missing-validation", "ASSERT_FAIL", 0.65)
    rule(_any(low, "sql", "inject"), "injection", "SQL_INJECTION", 0.75)
    rule(_any(low, "subprocess") & _any(low, "shell=true", "shell = true"), "command-injection", "COMMAND_INJECTION", 0.75)
    rule(_any(code, "eval(", "exec("), "code-injection", "CODE_INJECTION", 0.65)
    rule(_any(low, "stopiteration"), "iterator", "ITERATOR_INVALID", 0.70)
    rule(_any(added, ".close()", "__exit__", "finally:") & _any(code, "file", "open(", "socket", "connect"), "resource-leak", "MEMORY_LEAK", 0.60)
    rule(_any(low, "recursionerror", "maximum recursion"), "recursion", "STACK_OVERFLOW", 0.80)
    rule(_any(low, "assertionerror") | _any(added, "assert "), "assertion", "ASSERT_FAIL", 0.60)
    rule(reads(r"\.\w+"), "missing-guard", "NULL_PTR", 0.55)
    rule(reads(r"\["), "missing-guard", "BOUNDS", 0.55)
    rule((F.size("plus") <= 3) & (F.size("minus") <= 3) & _any(removed, "return ", "yield ") & _any(added, "return ", "yield "), "logic-return", "", 0.65, out)
    rule(formats, "string-format", "", 0.60, out)
    rule(moves("plus") & moves("minus"), "import-reorg", "", 0.80, out)
    rule(words >= 3, "possible-crash", "ASSERT_FAIL", 0.40)
    rule(words >= 1, "uncertain", "", 0.35, out)
    rule(F.lit(True), "logic", "", 0.50, out)
    return rows.select("patch", F.coalesce(*rules).alias("r")).select("patch", "r.*")
