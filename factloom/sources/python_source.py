"""Python source text to fact tables, by the standard library's parser, one pass over (path, text) rows.

A text that does not parse, or is nested too deep for the parser, gives one row of kind error; the rest of the scan goes on.  With
repair, code that was cut out of its place is parsed after dedenting it, giving open blocks a body, or wrapping it in a function.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.storage import cut

FACTS = "path string, kind string, qname string, name string, line int, col int, n_args int, is_method boolean, detail string"
_NAMES = [x.split()[0] for x in FACTS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]


def module_of(path: str) -> str:
    """Dotted module name of a relative path."""
    parts = path.removesuffix(".py").strip("/").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def _dotted(node: ast.AST) -> str | None:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


#: The function that repaired code is put into.
SNIPPET = "_snippet_"


def _with_bodies(text: str) -> str:
    """text with `pass` after every line that opens a block and has no deeper line behind it."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        out.append(line)
        if line.rstrip().endswith(":") and not line.lstrip().startswith("#"):
            depth = len(line) - len(line.lstrip())
            following = next((x for x in lines[i + 1 :] if x.strip()), "")
            if len(following) - len(following.lstrip()) <= depth:
                out.append(" " * (depth + 4) + "pass")
    return "\n".join(out)


def _forms(text: str) -> Iterator[str]:
    """The ways to read partial code, the plainest first; the pieces of a diff become a function each."""
    plain = textwrap.dedent(text)
    wrap = lambda x, k=0: f"def {SNIPPET}{k}():\n" + textwrap.indent(_with_bodies(x), "    ") + "\n    pass\n"
    yield plain
    yield _with_bodies(plain)
    yield wrap(plain)
    pieces = [p for p in re.split(r"(?m)^# @@ hunk @@\s*$", re.sub(r"(?m)^(index [0-9a-f]+\.\.[0-9a-f]+|(old|new) mode \d+).*$", "", text)) if p.strip()]
    if pieces and pieces != [text]:
        dedented = [textwrap.dedent(p.strip("\r\n")) for p in pieces]
        yield "\n".join(wrap(p, k) for k, p in enumerate(dedented))
        read = [wrap(x, k) for k, x in enumerate(_readable_groups(pieces, lambda x: _parses(wrap(x))))]
        if read:
            yield "\n".join(read)


#: Most adjacent pieces that are tried as one.
PIECES_TOGETHER = 4


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _readable_groups(pieces: list[str], parses: Callable[[str], bool]) -> list[str]:
    """Adjacent pieces put together so that as many as possible parse, in as many groups as possible; the rest is left out.

    Groups of at most PIECES_TOGETHER pieces, each tried once: the work grows with the number of pieces.
    """
    n = len(pieces)
    joined = lambda i, j: textwrap.dedent("\n".join(p.strip("\r\n") for p in pieces[i:j]))
    best: list[tuple[int, int, list[str]]] = [(0, 0, [])] * (n + 1)  # pieces read, groups, texts, from each piece on
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        for j in range(i + 1, min(n, i + PIECES_TOGETHER) + 1):
            read, groups, texts = best[j]
            if (read + j - i, groups + 1) > best[i][:2] and parses(x := joined(i, j)):
                best[i] = (read + j - i, groups + 1, [x, *texts])
    return best[0][2]


def parse(text: str, repair: bool) -> ast.Module:
    """The tree of a text; the error of the text as it stands if no reading of it parses."""
    try:
        return ast.parse(text)
    except SyntaxError:
        for form in _forms(text) if repair else ():
            try:
                return ast.parse(form)
            except SyntaxError:
                continue
        raise


def facts_of(path: str, text: str, repair: bool = False) -> list[tuple]:
    """Rows of FACTS: functions and their spans, calls, imports and the statements that make them, entry points, guards; or one row of kind error."""
    try:
        return _facts_of(path, parse(text, repair))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, "error", None, type(e).__name__, getattr(e, "lineno", None), None, None, None, str(e))]


def _facts_of(path: str, tree: ast.Module) -> list[tuple]:
    module, rows = module_of(path), []

    def walk(node: ast.AST, scope: str, cls: str | None, func: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, inner_cls, inner_func = scope, cls, func
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = inner_func = f"{scope}.{child.name}"
                a = child.args
                params = [*(x.arg for x in (*a.posonlyargs, *a.args)), *(f"*{x.arg}" for x in (a.vararg,) if x), *(x.arg for x in a.kwonlyargs), *(f"**{x.arg}" for x in (a.kwarg,) if x)]
                rows.append((path, "function", inner, child.name, child.lineno, child.col_offset, len(params), cls is not None, ",".join(params)))
                rows.append((path, "span", inner, child.name, child.lineno, None, None, None, str(child.end_lineno)))
                for d in child.decorator_list:
                    if name := _dotted(d.func if isinstance(d, ast.Call) else d):
                        rows.append((path, "decorator", inner, name, child.lineno, None, None, None, None))
            elif isinstance(child, ast.ClassDef):
                inner = inner_cls = f"{scope}.{child.name}"
                rows.append((path, "class", inner, child.name, child.lineno, child.col_offset, None, None, None))
            elif isinstance(child, ast.Call) and (name := _dotted(child.func)):
                rows.append((path, "call", func or module, name, child.lineno, child.col_offset, len(child.args) + len(child.keywords), isinstance(child.func, ast.Attribute), None))
            elif isinstance(child, ast.Import):
                rows.extend((path, "import", module, a.name, child.lineno, None, None, None, a.asname) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.extend((path, "import", module, f"{'.' * child.level}{child.module or ''}.{a.name}", child.lineno, None, None, None, a.asname) for a in child.names)
            elif isinstance(child, (ast.If, ast.While, ast.Assert)):
                rows.append((path, "guard", func or module, ast.unparse(child.test), child.lineno, child.col_offset, None, None, type(child).__name__))
                if isinstance(child, ast.If) and ast.unparse(child.test).replace('"', "'") == "__name__ == '__main__'":
                    rows.append((path, "entry", module, "__main__", child.lineno, None, None, None, None))
            walk(child, inner, inner_cls, inner_func)

    walk(tree, module, None, None)
    for node in tree.body:
        if isinstance(node, ast.Import):
            rows.extend((path, "statement", module, a.name, node.lineno, None, None, None, f"import {ast.unparse(a)}") for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            rows.append((path, "statement", module, node.module, node.lineno, None, None, None, ast.unparse(node)))
    top = next((x for x in tree.body if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)) and not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))), None)
    if top is not None:
        rows.append((path, "toplevel", module, "<module>", top.lineno, None, None, None, None))
    return rows


#: Characters of source whose facts are gathered before they are given on.
FACTS_BYTES = 4 << 20


def facts(texts: DataFrame, repair: bool = False) -> DataFrame:
    """All facts of texts(path, text)."""

    def table(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):  # one text at a time, so that only the facts of about FACTS_BYTES are held
                path, text = b.column(0)[i].as_py() or "", b.column(1)[i].as_py() or ""
                rows += facts_of(path, text, repair)
                size += len(text)
                if size >= FACTS_BYTES:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)

    return texts.select("path", "text").mapInArrow(run, FACTS)


def functions(found: DataFrame) -> DataFrame:
    """(qname, file, line, params)."""
    return found.where("kind = 'function'").select("qname", F.col("path").alias("file"), "line", F.when(F.col("detail") != "", F.split("detail", ",")).otherwise(F.array().cast("array<string>")).alias("params"))


def imports(found: DataFrame) -> DataFrame:
    """(path, line, statement): the imports at the top level of each file, a row for each name of `import` and for each `from`."""
    return found.where("kind = 'statement'").select("path", "line", F.col("detail").alias("statement"))


def spans(found: DataFrame) -> DataFrame:
    """(path, qname, name, first, last): the lines of each function, decorators left out."""
    return found.where("kind = 'span'").select("path", "qname", "name", F.col("line").alias("first"), F.col("detail").cast("int").alias("last"))


def _cut(first: str = "first", last: str = "last") -> Column:
    return F.slice(F.split("text", "\r\n|\r|\n"), F.col(first), F.col(last) - F.col(first) + 1)


#: Functions that a lookup gives for one name.
MATCHES = 3


def function_sources(texts: DataFrame, found: DataFrame, wanted: DataFrame, most: int = MATCHES) -> DataFrame:
    """(name, in_file, path, qname, first, last, source): the functions that wanted(name, in_file) names, with numbered lines.

    The last part of a dotted name counts; in_file is a part of the path, null or empty for any.  The first `most` by path and line are given;
    names that no function has give no row, nor do null names.  Paths are spelled out in pieces of the lengths that are asked, so that a piece finds
    its paths by equality; Spark keeps the first of each task before it shuffles, so common names and pieces are cheap.
    """
    asked = wanted.select("name", "in_file").distinct().withColumn("last_part", F.substring_index("name", ".", -1)).withColumn("piece", F.coalesce("in_file", F.lit("")))
    lengths = asked.agg(F.collect_set(F.length("piece")).alias("lengths"))  # one row of short numbers, so that names that all files have are not brought together
    path, size = F.col("path"), F.length("path")
    cuts = lambda n: F.transform(F.sequence(F.lit(1), F.when(n == 0, 1).otherwise(size - n + 1)), lambda i: F.substr(path, i, n))
    pieces = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= size), cuts)))
    spelled = spans(found).withColumnRenamed("name", "last_part").crossJoin(F.broadcast(lengths)).select("last_part", "path", "qname", "first", "last", F.explode(pieces).alias("piece"))
    order = Window.partitionBy("last_part", "piece").orderBy("path", "first", "qname")
    firsts = spelled.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    picked = asked.join(firsts, ["last_part", "piece"])
    numbered = F.transform(_cut(), lambda x, i: F.format_string("%4d | %s", F.col("first") + i, x))
    return picked.join(texts.select("path", "text"), "path").select("name", "in_file", "path", "qname", "first", "last", F.array_join(numbered, "\n").alias("source"))


def bodies(texts: DataFrame, found: DataFrame, findings: DataFrame) -> DataFrame:
    """findings(path, function, line, ...) with code, the text of their file, and body, the text of their function.

    Of functions of one name the least nested counts, then the first.  Where the file has none of that name, body is the lines from 40 before to 10
    behind the finding; without a function, a text that does not parse or no line, it is null, as are code and body of unknown paths.
    """
    deep = F.size(F.split("qname", r"\."))
    known = spans(found).groupBy("path", "name").agg(F.min_by(F.struct("first", "last"), F.struct(deep, "first")).alias("at"))
    read = texts.select("path", "text").join(found.where("kind = 'error'").select("path", F.lit(True).alias("broken")).distinct(), "path", "left")
    rows = findings.withColumn("name", F.substring_index("function", ".", -1)).join(known, ["path", "name"], "left").join(read, "path", "left")
    rows = rows.withColumn("first", F.coalesce("at.first", F.greatest(F.lit(1), F.col("line") - 39))).withColumn("last", F.coalesce("at.last", F.col("line") + 10))
    whole = F.col("broken").isNotNull() | (F.coalesce("function", F.lit("")) == "")
    body = F.when(~whole, F.array_join(_cut(), "\n"))
    return rows.select(*findings.columns, F.col("text").alias("code"), body.alias("body"))


def call_sites(found: DataFrame) -> DataFrame:
    """(file, line, col, caller, callee, num_args, is_method)."""
    return found.where("kind = 'call'").select(F.col("path").alias("file"), "line", "col", F.col("qname").alias("caller"), F.col("name").alias("callee"), F.col("n_args").alias("num_args"), "is_method")


def entry_points(found: DataFrame) -> DataFrame:
    """(node, reason): main blocks, functions named main or tests, decorated routes or commands, and modules with code of their own or with any of these."""
    found = cut(found.where("kind in ('function', 'entry', 'decorator', 'toplevel')").select("path", "kind", "qname", "name"), "starts")  # texts are parsed once, not for each use below
    named = found.where("kind = 'function' and (name = 'main' or name like 'test\\_%')").select(F.col("qname").alias("node"), F.lit("name").alias("reason"))
    main = found.where("kind = 'entry'").select(F.col("qname").alias("node"), F.lit("main").alias("reason"))
    routes = found.where("kind = 'decorator'").where(F.col("name").rlike(r"(^|\.)(route|get|post|put|delete|command|task)$")).select(F.col("qname").alias("node"), F.lit("decorator").alias("reason"))
    inside = found.where("kind in ('function', 'entry', 'toplevel')").select("path", F.col("qname").alias("node"), "kind")
    starts = named.union(main).union(routes).distinct()
    holders = inside.join(starts.select("node"), "node", "left_semi").select("path").union(inside.where("kind = 'toplevel'").select("path")).distinct()
    module = F.regexp_replace(F.translate(F.regexp_replace("path", r"^/+|\.py$", ""), "/", "."), r"\.__init__$", "")
    return starts.union(holders.select(module.alias("node"), F.lit("module").alias("reason"))).distinct()


def call_graph(found: DataFrame) -> DataFrame:
    """(src, dst): calls resolved over the whole project."""
    from factloom.operators.matching import resolve_calls, resolve_self_calls

    calls = call_sites(found).select(F.col("caller").alias("src"), F.col("callee").alias("name")).distinct()
    known = functions(found).select("qname")
    own = resolve_self_calls(calls, known)
    other = resolve_calls(calls.where(~F.col("name").startswith("self.")), known)
    return own.union(other.select("src", "name", "target")).where("target is not null").select("src", F.col("target").alias("dst")).distinct()
