"""Signals that a finding may be intended or a false positive, from paths, names, sources and code; all are columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.scoring import context_multiplier, unintentional

# Patterns of paths (looked for in the whole path, except those of names), and the confidence of each signal.
TEST_NAMES = (
    r"test_.*\.py$",
    r".*_test\.py$",
    r".*_tests\.py$",
    r"conftest\.py$",
)
TEST_FOLDER = (r".*/tests?/.*\.py$",)
EXAMPLES = (
    r".*/examples?/.*\.py$",
    r".*/samples?/.*\.py$",
    r".*/demo/.*\.py$",
    r"example_.*\.py$",
)
CONFIGS = (
    r".*config.*\.py$",
    r".*settings.*\.py$",
    r".*conf\.py$",
)
MIGRATIONS = (r".*/migrations?/.*\.py$",)
GUARDS = (
    r"\bor\s+\d+",
    r"\bor\s+\[\]",
    r"\bor\s+\{\}",
    r'\bor\s+""',
    r"\bor\s+None\b",
    r"if\s+\w+\s+else\s+",
    r"if\s+\w+\s+is\s+not\s+None",
    r"if\s+\w+\s+is\s+None.*return",
    r"if\s+not\s+\w+.*return",
)
RAISED = (
    r"raise\s+ValueError",
    r"raise\s+TypeError",
    r"raise\s+KeyError",
    r"raise\s+AttributeError",
    r"raise\s+RuntimeError",
    r"raise\s+NotImplementedError",
)
# Bug types of which guards in the code say nothing, and those that code raises on purpose; names of request objects and of
# functions that are given one; names that tell of a user's file; a default that is not zero; and the confidence of each signal of the code.
NOT_BY_GUARDS = ("BOUNDS", "STALE_VALUE")
BY_RAISING = ("VALUE_ERROR", "TYPE_ERROR", "RUNTIME_ERROR")
REQUESTS = ("request", "req", "http_request")
VIEWS = ("view", "handler", "endpoint", "route", "api")
USER_FILES = ("path", "file", "input")
NONZERO_DEFAULT = r"def\s+\w+\([^)]*=\s*[1-9][^,)]*\)"
CODE_CONFIDENCE = {"request": 0.95, "view": 0.8, "guard": 0.7, "raised": 0.9, "optional": 0.95, "default": 0.6, "handler": 0.7, "import": 0.5, "outside": 0.3}
CONFIDENCE = {"test": 0.95, "example": 0.7, "config": 0.6, "migration": 0.8, "self": 0.99, "method": 0.9}
CLI_SOURCES = ("sys.argv", "argparse", "ArgumentParser", "parse_args", "click.option", "click.argument", "click.command", "typer.Option", "typer.Argument")
ENV_SOURCES = ("os.environ", "os.getenv", "environ.get", "environ[")
# The kinds of sources that a description in small letters names, tried in order after the two above.
OTHER_SOURCES = {
    "HTTP": ("request.", "http_", "flask.request", "django.request", ".get(", ".post(", "query_params", "form_data"),
    "FILE": ("file_content", "open("),
    "USER_INPUT": ("input(", "stdin"),
}
SAFE_LOADERS = ("yaml.safe_load", "yaml.safe_load_all", "yaml.SafeLoader", "strictyaml.load", "strictyaml.as_document")
MITIGATIONS = (
    "sanitize",
    "validate",
    "filter",
    "escape",
    "quote",
    "clean",
    "normalize",
    "safe_",
    "secure_",
    "verify",
    "check_",
    "is_valid",
    "is_safe",
    "allowlist",
    "whitelist",
    "parse_field",
)
TEST_FOLDERS = ("tests", "test", "testing", "spec", "specs")


def either(patterns: tuple[str, ...]) -> str:
    """One expression for any of the patterns, in any case."""
    return "(?i)" + "|".join(patterns)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_path(path: Column) -> Column:
    """A test's file name, or a test folder anywhere in the path."""
    name = F.lower(base_name(path))
    named = name.startswith("test_") | name.endswith("_test.py") | name.startswith("tests_") | name.endswith("_tests.py") | (name == "conftest.py")
    return named | F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def _named(kind: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(CONFIDENCE[kind]).alias("confidence")))


def signals(path: Column, bug_type: Column, variable: Column, function: Column) -> Column:
    """Array of (kind, confidence): at most one of each kind."""
    base = F.substring_index(F.substring_index(variable, ".", 1), "[", 1)
    none = bug_type == "NULL_PTR"
    return F.array_compact(
        F.array(
            _named("test", base_name(path).rlike(either(TEST_NAMES)) | path.rlike(either(TEST_FOLDER))),
            _named("example", path.rlike(either(EXAMPLES))),
            _named("config", path.rlike(either(CONFIGS))),
            _named("migration", path.rlike(either(MIGRATIONS))),
            _named("self", none & base.isin("self", "cls") & ~variable.contains(".")),
            _named("method", none & (variable == "param_0") & (function.startswith("__") | function.contains("."))),
        )
    )


def is_guarded_text(code: Column) -> Column:
    """Code with a default, a conditional value, or a check for None."""
    return code.rlike("|".join(GUARDS))


def raises_on_purpose(code: Column) -> Column:
    return code.rlike("|".join(RAISED))


def contexts(path: Column, sources: Column, chain: Column, sink: Column) -> Column:
    """Names of the false-positive contexts of a finding; see scoring.CONTEXT_FACTORS for their factors."""
    holds = lambda c, ps: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: _any(x, ps))
    safe = _any(F.coalesce(sink, F.lit("")), SAFE_LOADERS)
    return F.array_compact(
        F.array(
            F.when(is_test_path(F.coalesce(path, F.lit(""))), "TEST_FILE"),
            F.when(holds(sources, CLI_SOURCES), "CLI_TOOL"),
            F.when(holds(sources, ENV_SOURCES), "ENV_VAR_CONFIG"),
            F.when(safe, "SAFE_LOADER"),
            F.when(holds(chain, MITIGATIONS), "DEFENSE_IN_DEPTH"),
        )
    )


def _any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def suppressed(path: Column, sources: Column, chain: Column, sink: Column, threshold: float = 0.40) -> Column:
    """A finding that its context makes likely to be false: full confidence times the context's factor is below the threshold."""
    return context_multiplier(contexts(path, sources, chain, sink)) < threshold


#: Lines before a finding, its own included, in which a handler of exceptions counts.
HANDLER_LINES = 10


def code_signals(bug_type: Column, variable: Column, function: Column, code: Column, line: Column, body: Column) -> Column:
    """Array of (kind, confidence) from names and from code: the text of the whole file, and body, that of the function (null: the whole file).

    A signal whose test needs something that is null is absent; a line outside of the code has no handler.
    """
    rows = F.split(code, "\n")
    first = F.greatest(F.lit(1), line - (HANDLER_LINES - 1))
    near = F.array_join(F.slice(rows, first, F.greatest(F.lit(0), line - first + 1)), "\n")
    none, unread = bug_type == "NULL_PTR", bug_type == "IMPORT_ERROR"
    base = F.lower(F.substring_index(F.substring_index(variable, ".", 1), "[", 1))
    tests = {
        "request": none & base.isin(*REQUESTS),
        "view": none & (variable == "param_0") & _any(F.lower(function), VIEWS),
        "guard": ~bug_type.isin(*NOT_BY_GUARDS) & is_guarded_text(F.coalesce(body, code)),
        "raised": bug_type.isin(*BY_RAISING) & raises_on_purpose(code),
        "optional": unread & code.contains("try:") & code.contains("import") & _any(code, ("except ImportError", "except ModuleNotFoundError")),
        "default": (bug_type == "DIV_ZERO") & code.rlike(NONZERO_DEFAULT),
        "handler": line.between(1, F.size(rows)) & near.contains("except") & near.contains("try"),
        "import": unread,
        "outside": (bug_type == "FILE_NOT_FOUND") & ~F.coalesce(_any(F.lower(variable), USER_FILES), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(CODE_CONFIDENCE[kind]).alias("confidence"))) for kind, holds in tests.items())))


def judged(path: Column, bug_type: Column, variable: Column, function: Column, confidence: Column, least: float, code: Column | None = None, line: Column | None = None, body: Column | None = None) -> Column:
    """struct(keep, adjusted, kinds): a finding's confidence times the chance that no signal of intent holds, and whether that is enough.

    With code, line and body (see `python_source.bodies`) what the code says counts too.
    """
    text, at = F.lit(None).cast("string"), F.lit(None).cast("int")
    found = F.concat(signals(path, bug_type, variable, function), code_signals(bug_type, variable, function, text if code is None else code, at if line is None else line, text if body is None else body))
    adjusted = confidence * unintentional(F.transform(found, lambda s: s["confidence"]))
    return F.struct((adjusted >= least).alias("keep"), adjusted.alias("adjusted"), F.transform(found, lambda s: s["kind"]).alias("kinds"))


def source_type(description: Column) -> Column:
    """The kind of source that a description names: CLI, ENV, HTTP, FILE, USER_INPUT or null."""
    kinds = {"CLI": CLI_SOURCES, "ENV": ENV_SOURCES, **OTHER_SOURCES}
    return F.coalesce(*(F.when(_any(F.lower(description), [p.lower() for p in parts]), kind) for kind, parts in kinds.items()))
