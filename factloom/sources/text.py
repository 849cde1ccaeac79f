"""Text sources: lines, grep, windows around a line, key-value files, git logs, patches, tool output, CSV of alerts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """A regular expression for a shell pattern, to match a whole path."""
    out = ""
    for ch in pattern:
        out += {"*": ".*", "?": "."}.get(ch, ch if ch in "[]" or ch.isalnum() or ch in "/_-" else "\\" + ch)
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """A path that holds a plain pattern, or matches one with wildcards."""
    out = F.lit(False)
    for p in patterns:
        out = out | (path.rlike(glob_to_regex(p)) if set(p) & set("*?[") else path.contains(p))
    return out


def files(spark: SparkSession, root: str, glob: str = "*.py", exclude: list[str] | None = None) -> DataFrame:
    """(path, text) of files below a folder, read by Spark from any store; bytes that are not UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return raw.where(~excluded(F.col("path"), exclude or [])).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def discover(spark: SparkSession, root: str, most: int | None = None, tests: bool = True) -> DataFrame:
    """The first paths in order, without tests if so asked."""
    from factloom.functions.scoring import is_test_file

    found = files(spark, root).select("path")
    found = found if tests else found.where(~is_test_file(F.col("path")))
    return found.orderBy("path").limit(most) if most is not None else found


def lines(texts: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, value) with lines from 1."""
    return texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "value")).select(key, (F.col("p") + 1).alias("line"), "value")


def grep(texts: DataFrame, pattern: str, most: int | None = None, key: str = "path") -> DataFrame:
    """Matching lines in order of path and line; the pattern is held against each line by itself, so ^ and $ are its ends."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    numbered = F.transform(split, lambda v, i: F.struct((i + 1).alias("line"), v.alias("value")))
    found = texts.select(key, F.explode(F.filter(numbered, lambda x: x["value"].rlike(pattern))).alias("f")).select(key, "f.line", "f.value")
    return found.orderBy(key, "line").limit(most) if most is not None else found


def read_lines(texts: DataFrame, first: int, last: int, key: str = "path") -> DataFrame:
    """Lines first to last of each text."""
    return lines(texts, key).where(F.col("line").between(first, last))


def snippets(texts: DataFrame, spots: DataFrame, around: int = 3, key: str = "path") -> DataFrame:
    """(key, line, first, last, snippet): the lines around each spot(key, line), cut at the text's ends.

    Each text is split once and sliced for its spots; no lines are joined.
    """
    cut = texts.select(key, F.split(F.coalesce("text", F.lit("")), "\n").alias("v"))
    rows = spots.select(key, "line").distinct().join(cut, key).where((F.col("line") >= 1) & (F.col("line") <= F.size("v")))
    first, last = F.greatest(F.lit(1), F.col("line") - around), F.least(F.size("v"), F.col("line") + around)
    return rows.select(key, "line", first.cast("int").alias("first"), last.cast("int").alias("last"), F.array_join(F.slice("v", first, last - first + 1), "\n").alias("snippet"))


def folders(paths: DataFrame) -> DataFrame:
    """(folder, entry): the listing of every folder."""
    parts = paths.select(F.split("path", "/").alias("p"))
    each = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", 1, i - 1), "/").alias("folder"), F.element_at("p", i).alias("entry")))).alias("e"))
    return each.select("e.folder", "e.entry").distinct()


def key_values(texts: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, value) of lines name="value"."""
    split = lines(texts, key).where(F.col("value").contains("=")).select(key, F.trim(F.substring_index("value", "=", 1)).alias("name"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("v"))
    return split.select(key, "name", F.regexp_replace(F.trim("v"), '^"+|"+$', "").alias("value"))


def git_log(log: DataFrame) -> DataFrame:
    """(idx, sha, short, date, msg, author) from lines sha|short|date|subject|author; the author takes further bars."""
    rows = log.select("idx", F.split("value", r"\|", 5).alias("p")).where(F.size("p") == 5)
    at = lambda i: F.element_at("p", i)
    return rows.select("idx", at(1).alias("sha"), at(2).alias("short"), at(3).alias("date"), F.substring(at(4), 1, 72).alias("msg"), at(5).alias("author"))


# Bug types that a line of tool output may name without further words.
BARE_TYPES = (
    "SQL_INJECTION", "SSRF", "DIVIDE_BY_ZERO", "NULL_DEREF", "BUFFER_OVERFLOW", "PATH_TRAVERSAL", "COMMAND_INJECTION", "XSS",
    "RACE_CONDITION", "USE_AFTER_FREE", "FORMAT_STRING", "UNSAFE", "INDEX_OUT_OF_RANGE", "TYPE_ERROR", "ATTRIBUTE_ERROR",
    "KEY_ERROR", "UNHANDLED_EXCEPTION", "VALUE_ERROR", "ASSERTION_ERROR", "RECURSION", "INFINITE_LOOP", "DEADLOCK",
)
# The forms of a finding, tried in order; groups are the type, the line and, in the first, the confidence.
FINDING_PATTERNS = (
    r"(?i)\[BUG\]\s+([A-Z_]+)\s+\(line\s+(\d+)(?:,\s*confidence\s+([\d.]+))?",
    r"(?i)bug:\s*([A-Z_]+).*?(?:line|at line)\s+(\d+)()",
    r"(?i)found bug:\s*([A-Z_]+).*?on line\s+(\d+)()",
    r"^\s+([A-Z][A-Z_]{2,}):\s+line\s+(\d+)()",
    rf"(?i)({'|'.join(BARE_TYPES)}).*?line\s+(\d+)()",
)


def parse_findings(output: DataFrame, key: str = "path") -> DataFrame:
    """(key, bug_type, line, confidence) from output lines, by the first form that fits; no confidence is 0."""
    value = F.col("value")

    def finding(form: str) -> Column:
        part = lambda i: F.regexp_extract(value, form, i)
        confidence = F.coalesce(part(3).try_cast("double"), F.lit(0.0))
        return F.when(value.rlike(form), F.struct(F.upper(part(1)).alias("bug_type"), part(2).cast("int").alias("line"), confidence.alias("confidence")))

    found = F.coalesce(*map(finding, FINDING_PATTERNS))
    return lines(output, key).withColumn("f", found).where("f is not null").select(key, "f.*")


#: Names of alerts and the bug type each stands for.
ALERT_TYPES = {
    "Code injection": "CODE_INJECTION", "SQL query built from user-controlled sources": "SQL_INJECTION", "Uncontrolled command line": "COMMAND_INJECTION",
    "Deserialization of user-controlled data": "UNSAFE_DESERIALIZATION", "Uncontrolled data used in path expression": "PATH_INJECTION",
    "Full server-side request forgery": "SSRF", "Clear-text logging of sensitive information": "CLEARTEXT_LOGGING",
    "Clear-text storage of sensitive information": "CLEARTEXT_STORAGE", "Failure to use secure cookies": "INSECURE_COOKIE",
    "Construction of a cookie using user-supplied input": "COOKIE_INJECTION",
    "Use of a broken or weak cryptographic hashing algorithm on sensitive data": "WEAK_CRYPTO", "Flask app is run in debug mode": "DEBUG_MODE",
    "XML external entity expansion": "XXE", "XML internal entity expansion": "XXE",
}


def alert_type(name: Column) -> Column:
    """The bug type of an alert's name; an unknown one in capitals with underscores."""
    table = F.create_map(*(F.lit(x) for kv in ALERT_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, name), F.upper(F.translate(name, " ", "_")))


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, bug_type, severity) of a CSV without a header; rows of fewer than six columns are skipped."""
    raw = spark.read.schema("name string, description string, severity string, message string, file string, line string").csv(path, escape='"', multiLine=True)
    line = F.when(F.col("line").rlike(r"^\d+$"), F.col("line").cast("int")).otherwise(0)
    return raw.where("line is not null").select(F.regexp_replace("file", "^/", "").alias("file"), line.alias("line"), alert_type(F.col("name")).alias("bug_type"), "severity")


HUNK = "patch string, file string, buggy string, fixed string, buggy_lines array<int>, fixed_lines array<int>"

#: Fixed value: the comment that stands between two hunks of a file, by which the repair of pieces finds them.
HUNK_MARK = "# @@ hunk @@"


def hunks_of(text: str, marks: bool = False) -> Iterator[tuple[str, list[str], list[str], list[int], list[int]]]:
    """(file, old lines, new lines, numbers of removed lines, numbers of added lines) of each file of a unified diff.

    A hunk's header tells how many old and new lines follow, so that what a line of it looks like does not matter; headers of files
    count only outside of hunks.  A hunk that ends early is taken as far as it goes.  With marks, each hunk begins with one.
    """
    found = None
    old = new = old_left = new_left = 0
    for line in text.removesuffix("\n").split("\n"):
        if old_left > 0 or new_left > 0:
            kind, value = line[:1], line[1:]
            if kind == "\\":
                continue
            if kind == "-" and old_left:
                found[1].append(value)
                found[3].append(old)
                old, old_left = old + 1, old_left - 1
                continue
            if kind == "+" and new_left:
                found[2].append(value)
                found[4].append(new)
                new, new_left = new + 1, new_left - 1
                continue
            if kind in (" ", "") and old_left and new_left:  # an empty line may have lost its space
                found[1].append(value)
                found[2].append(value)
                old, new, old_left, new_left = old + 1, new + 1, old_left - 1, new_left - 1
                continue
            old_left = new_left = 0
        if line.startswith("+++ "):
            if found is not None:
                yield found
            found = (re.sub(r"^b/", "", line[4:].split("\t")[0].strip()), [], [], [], [])
        elif found is not None and (m := _HUNK_HEAD.match(line)):
            old, new = int(m[1]), int(m[3])
            old_left, new_left = int(m[2] or 1), int(m[4] or 1)
            if marks:
                found[1].append(HUNK_MARK)
                found[2].append(HUNK_MARK)
    if found is not None:
        yield found


_HUNK_HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


#: Characters of diffs whose files are gathered before they are given on.
PATCH_BYTES = 4 << 20


def parse_patches(patches: DataFrame, only_source: bool = False, marks: bool = False) -> DataFrame:
    """patches(patch, text) of unified diffs -> the old and new text of each file's hunks, and the changed line numbers.

    only_source leaves Python files that are no tests; with marks the texts can be given to python_source.facts(repair=True).  A text gives as many rows as it names files; rows are
    given on when the texts they are of have PATCH_BYTES characters, and at the end of a batch.
    """

    def run(batches):
        types = [pa.string()] * 4 + [pa.list_(pa.int32())] * 2
        names = [x.split()[0] for x in HUNK.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            rows, size = [], 0
            for patch, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(patch, file, "\n".join(buggy), "\n".join(fixed), *numbers) for file, buggy, fixed, *numbers in hunks_of(text or "", marks)]
                size += len(text or "")
                if rows and size >= PATCH_BYTES:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    found = patches.select("patch", "text").mapInArrow(run, HUNK)
    if not only_source:
        return found
    from factloom.functions.intent import is_test_path

    return found.where(F.col("file").endswith(".py") & ~is_test_path(F.col("file")))
