"""Taint labels as bit masks: tau (untrusted sources), kappa (sinks sanitised for), sigma (sensitive sources)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.storage import parted

# The numbers of sources, sinks and sanitizers, and the sinks that a sanitizer makes safe.
SOURCES = (
    "HTTP_PARAM",
    "USER_INPUT",
    "ENVIRONMENT",
    "FILE_CONTENT",
    "NETWORK_RECV",
    "ARGV",
    "DATABASE_RESULT",
    "COOKIE",
    "HEADER",
    "PASSWORD",
    "API_KEY",
    "CREDENTIALS",
    "PII",
    "CRYPTO_KEY",
    "SESSION_TOKEN",
    "PRIVATE_DATA",
)
SINKS = (
    "SQL_EXECUTE",
    "COMMAND_SHELL",
    "CODE_EVAL",
    "FILE_PATH",
    "LDAP_QUERY",
    "XPATH_QUERY",
    "NOSQL_QUERY",
    "REGEX_PATTERN",
    "HTTP_REQUEST",
    "XML_PARSE",
    "DESERIALIZE",
    "HEADER_SET",
    "HTML_OUTPUT",
    "REDIRECT_URL",
    "COOKIE_VALUE",
    "TEMPLATE_RENDER",
    "LOG_FORGING",
    "EMAIL_HEADER",
    "LOG_OUTPUT",
    "FILE_WRITE",
    "NETWORK_SEND",
    "EXCEPTION_MSG",
    "HTTP_RESPONSE",
    "DEBUG_OUTPUT",
    "CRYPTO_WEAK",
    "CRYPTO_KEY_USE",
    "RANDOM_SEED",
    "HASH_PASSWORD",
    "NETWORK_BIND",
    "FILE_CHMOD",
    "RESOURCE_ALLOC",
    "PROCESS_CREATE",
)
SANITIZER_SINKS = {
    "PARAMETERIZED_QUERY": ("SQL_EXECUTE",),
    "ORM_ESCAPE": ("SQL_EXECUTE",),
    "SQL_ESCAPE": ("SQL_EXECUTE",),
    "SHELL_QUOTE": ("COMMAND_SHELL",),
    "ARRAY_COMMAND": ("COMMAND_SHELL", "PROCESS_CREATE",),
    "BASENAME": ("FILE_PATH",),
    "REALPATH_CHECK": ("FILE_PATH",),
    "SECURE_FILENAME": ("FILE_PATH",),
    "CANONICALIZE": ("FILE_PATH",),
    "HTML_ESCAPE": ("HTML_OUTPUT", "TEMPLATE_RENDER",),
    "TEMPLATE_AUTOESCAPE": ("HTML_OUTPUT", "TEMPLATE_RENDER",),
    "DOM_PURIFY": ("HTML_OUTPUT",),
    "URL_VALIDATE": ("REDIRECT_URL", "HTTP_REQUEST",),
    "RELATIVE_URL": ("REDIRECT_URL",),
    "URL_PARSE_VALIDATE": ("HTTP_REQUEST", "REDIRECT_URL",),
    "RE_ESCAPE": ("REGEX_PATTERN",),
    "SAFE_LOADER": ("DESERIALIZE",),
    "JSON_PARSE": ("DESERIALIZE",),
    "LDAP_ESCAPE": ("LDAP_QUERY",),
    "XPATH_ESCAPE": ("XPATH_QUERY",),
    "DISABLE_ENTITIES": ("XML_PARSE",),
    "DEFUSED_XML": ("XML_PARSE",),
    "HEADER_SANITIZE": ("HEADER_SET", "EMAIL_HEADER",),
    "TYPE_CONVERSION": ("SQL_EXECUTE", "FILE_PATH", "COMMAND_SHELL",),
    "ALLOWLIST_CHECK": ("SQL_EXECUTE", "FILE_PATH", "COMMAND_SHELL", "HTTP_REQUEST", "REDIRECT_URL",),
    "ENCRYPTION": ("LOG_OUTPUT", "FILE_WRITE", "NETWORK_SEND", "HTTP_RESPONSE", "DEBUG_OUTPUT",),
    "HASHING": ("LOG_OUTPUT", "FILE_WRITE", "HASH_PASSWORD",),
    "REDACTION": ("LOG_OUTPUT", "EXCEPTION_MSG", "DEBUG_OUTPUT",),
    "TOKENIZATION": ("HTTP_RESPONSE", "FILE_WRITE",),
    "REGEX_ALPHANUMERIC": ("SQL_EXECUTE", "FILE_PATH", "COMMAND_SHELL", "LDAP_QUERY", "NOSQL_QUERY",),
    "REGEX_DIGITS": ("SQL_EXECUTE", "FILE_PATH", "COMMAND_SHELL", "LDAP_QUERY", "NOSQL_QUERY",),
    "REGEX_HOSTNAME": ("HTTP_REQUEST", "REDIRECT_URL", "SQL_EXECUTE", "FILE_PATH", "NETWORK_BIND",),
    "REGEX_EMAIL": ("SQL_EXECUTE", "EMAIL_HEADER", "LDAP_QUERY",),
    "REGEX_UUID": ("SQL_EXECUTE", "FILE_PATH", "HTTP_REQUEST",),
    "REGEX_FILEPATH": ("FILE_PATH", "SQL_EXECUTE",),
    "REGEX_URL_PATH": ("HTTP_REQUEST", "REDIRECT_URL",),
    "REGEX_SLUG": ("SQL_EXECUTE", "FILE_PATH", "HTTP_REQUEST", "REDIRECT_URL",),
    "REGEX_HEX": ("SQL_EXECUTE", "FILE_PATH", "COMMAND_SHELL",),
    "REGEX_BASE64": ("SQL_EXECUTE", "FILE_PATH",),
}
# The operands of an instruction whose labels its result joins; the index of a store, the callee and imports give none.
TRANSFERS = (
    ("binary", "left"), ("binary", "right"), ("compare", "left"), ("compare", "right"), ("unary", "operand"), ("subscript", "container"), ("subscript", "index"),
    ("store_subscript", "container"), ("store_subscript", "value"), ("attribute", "object"), ("store_attribute", "object"), ("store_attribute", "value"), ("call", "argument"), ("call", "summary"),
    ("contains", "container"), ("contains", "item"), ("format", "value"), ("format", "spec"), ("build_string", "part"), ("build_collection", "element"), ("build_map", "key"), ("build_map", "value"),
    ("unpack", "sequence"), ("extend", "target"), ("extend", "source"),
)
DESERIALIZE, LAST_INJECTION_SINK = 10, 17
KAPPA_ALL = (1 << 32) - 1


def mask(sanitizer: str) -> int:
    """Bits of the sinks that a sanitizer makes safe; an unknown one none."""
    return sum(1 << SINKS.index(s) for s in SANITIZER_SINKS.get(sanitizer, ()))


def join_labels(labels: DataFrame, *keys: str, provenance: str | None = None) -> DataFrame:
    """Lattice join of the labels of each key: sources unite, sanitised sinks intersect.  No labels is clean."""
    aggs = [F.bit_or("tau").alias("tau"), F.bit_and("kappa").alias("kappa"), F.bit_or("sigma").alias("sigma")]
    if provenance:
        aggs.append(F.array_sort(F.collect_set(provenance)).alias("provenance"))
    return labels.groupBy(*keys).agg(*aggs)


def join2(a: str, b: str) -> list[Column]:
    """Join of two labels held in columns with these prefixes."""
    c = F.col
    return [c(f"{a}tau").bitwiseOR(c(f"{b}tau")).alias("tau"), c(f"{a}kappa").bitwiseAND(c(f"{b}kappa")).alias("kappa"), c(f"{a}sigma").bitwiseOR(c(f"{b}sigma")).alias("sigma")]


def sanitize(kappa: Column, sanitizer: Column) -> Column:
    """kappa with the sinks of a named sanitizer."""
    table = F.create_map(*(F.lit(x) for s in SANITIZER_SINKS for x in (s, mask(s))))
    return kappa.bitwiseOR(F.coalesce(F.element_at(table, sanitizer), F.lit(0)).cast("long"))


def sanitised_for(kappa: Column, sink: Column) -> Column:
    return F.getbit(kappa, sink) == 1


def is_safe(tau: Column, kappa: Column, sigma: Column, sink: Column) -> Column:
    """Safe if sanitised for the sink, or without the taint the sink minds: both kinds for deserialisation, untrusted for
    the injection sinks (up to 17), sensitive for the rest."""
    clean = F.when(sink == DESERIALIZE, (tau == 0) & (sigma == 0)).when(sink <= LAST_INJECTION_SINK, tau == 0).otherwise(sigma == 0)
    return clean | sanitised_for(kappa, sink)


def under_control(tau: Column, kappa: Column, sigma: Column, pc_tau: Column, pc_sigma: Column) -> list[Column]:
    """A label assigned under a tainted condition: it takes the condition's taint, and loses sanitisation if that is untrusted."""
    return [tau.bitwiseOR(pc_tau).alias("tau"), F.when(pc_tau == 0, kappa).otherwise(F.lit(0).cast("long")).alias("kappa"), sigma.bitwiseOR(pc_sigma).alias("sigma")]


def violations(calls: DataFrame) -> DataFrame:
    """calls(id, tau, kappa, sigma, sink) that are not safe, with the kind of taint."""
    c = F.col
    kind = F.when(c("sink") == DESERIALIZE, "both").when(c("sink") <= LAST_INJECTION_SINK, "untrusted").otherwise("sensitive")
    return calls.where(~is_safe(c("tau"), c("kappa"), c("sigma"), c("sink"))).withColumn("kind", kind)


def apply_summary(args: DataFrame, flows: DataFrame) -> DataFrame:
    """(call, tau, kappa, sigma): result label of calls from their arguments' labels and the callee's flowing parameters.

    args(call, func, pos, tau, kappa, sigma), flows(func, pos).  Calls without a flowing argument are clean.
    """
    marked = args.join(flows.select("func", "pos").distinct().withColumn("moves", F.lit(True)), ["func", "pos"], "left")
    moving = lambda c: F.when(F.col("moves") & F.col("call").isNotNull(), F.col(c)).alias(c)
    joined = join_labels(parted(marked.select("call", moving("tau"), moving("kappa"), moving("sigma")), "call"), "call")
    zero = lambda name, v: F.coalesce(F.col(name), F.lit(v).cast("long")).alias(name)
    return joined.select("call", zero("tau", 0), zero("kappa", KAPPA_ALL), zero("sigma", 0))


def results_of_calls(args: DataFrame, summaries: DataFrame) -> DataFrame:
    """(call, tau, kappa, sigma): result labels of calls by the whole summary of what they call.

    args(call, func, pos, tau, kappa, sigma): a call without arguments has one row whose pos is null.  summaries(func, n_params,
    to_return array of positions, sensitive array of positions, sanitizes mask of sinks or null, clears, introduces source type
    or null).  Arguments beyond n_params share the place after the last parameter.  The flowing ones join; a parameter known to be
    sensitive adds the bit of passwords; a sanitizer adds its sinks and may clear sigma.  A summary's own taint counts for calls
    without arguments alone, which are clean otherwise.  Calls of functions without a summary are clean.
    """
    c = F.col
    rows = args.join(summaries, "func", "left").withColumn("place", F.least("pos", "n_params"))
    flows = c("pos").isNotNull() & F.coalesce(F.array_contains("to_return", c("place")), F.lit(False))
    password = F.when(F.coalesce(F.array_contains("sensitive", c("place")), F.lit(False)), F.lit(1 << SOURCES.index("PASSWORD"))).otherwise(0).cast("long")
    only = lambda x: F.when(flows, x)
    clean = lambda x, value: F.coalesce(x, F.lit(value).cast("long"))
    joined = rows.groupBy("call").agg(
        clean(F.bit_or(only(c("tau"))), 0).alias("tau"), clean(F.bit_and(only(c("kappa"))), KAPPA_ALL).alias("kappa"), clean(F.bit_or(only(c("sigma").bitwiseOR(password))), 0).alias("sigma"),
        F.max("sanitizes").alias("sanitizes"), F.coalesce(F.some("clears"), F.lit(False)).alias("clears"), F.max("introduces").alias("introduces"), (F.count("pos") == 0).alias("bare"),
    )
    source, cleaned = c("bare") & c("introduces").isNotNull(), ~c("bare") & c("sanitizes").isNotNull()
    zero = F.lit(0).cast("long")
    return joined.select(
        "call",
        F.when(source, F.expr("shiftleft(1L, introduces)")).otherwise(c("tau")).alias("tau"),
        F.when(source, zero).when(cleaned, c("kappa").bitwiseOR(c("sanitizes"))).otherwise(c("kappa")).alias("kappa"),
        F.when(cleaned & c("clears"), zero).otherwise(c("sigma")).alias("sigma"),
    )


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """Join of the two-flag model: flags or, labels unite, sanitizers intersect.  states(untrusted, sensitive, labels, sanitizers).

    Labels and sanitizers are counted one by one, so no list of a group's rows is made; keys are not null.
    """
    flags = states.groupBy(*keys).agg(F.some("untrusted").alias("untrusted"), F.some("sensitive").alias("sensitive"), F.count("*").alias("rows"))
    each = lambda c: states.select(*keys, F.explode(F.array_distinct(c)).alias("x")).groupBy(*keys, "x").agg(F.count("*").alias("n"))
    listed = lambda df, c: df.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias(c))  # noqa: E731  different ones of a group
    of_all = each("sanitizers").join(flags.select(*keys, "rows"), list(keys)).where("n = rows")
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    out = flags.join(listed(each("labels"), "labels"), list(keys), "left").join(listed(of_all, "sanitizers"), list(keys), "left")
    return out.select(*keys, "untrusted", "sensitive", none("labels"), none("sanitizers"))
