"""Security contracts as dimension tables: which functions are sources, sinks and sanitizers, and joins that apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.taint import SINKS, SOURCES, is_safe, sanitize

# Kind of source and function, the sensitive kinds last.
SOURCE_FUNCTIONS = (
    ("HTTP_PARAM", "request.GET.__getitem__"),
    ("HTTP_PARAM", "request.GET.get"),
    ("HTTP_PARAM", "request.POST.__getitem__"),
    ("HTTP_PARAM", "request.POST.get"),
    ("HTTP_PARAM", "request.body"),
    ("HTTP_PARAM", "request.args.get"),
    ("HTTP_PARAM", "request.args.__getitem__"),
    ("HTTP_PARAM", "request.form.get"),
    ("HTTP_PARAM", "request.form.__getitem__"),
    ("HTTP_PARAM", "request.get_json"),
    ("HTTP_PARAM", "request.data"),
    ("HTTP_PARAM", "request.cookies.get"),
    ("USER_INPUT", "builtins.input"),
    ("USER_INPUT", "sys.stdin.read"),
    ("USER_INPUT", "sys.stdin.readline"),
    ("ENVIRONMENT", "os.environ.__getitem__"),
    ("ENVIRONMENT", "os.environ.get"),
    ("ENVIRONMENT", "os.getenv"),
    ("ARGV", "sys.argv.__getitem__"),
    ("FILE_CONTENT", "file.read"),
    ("FILE_CONTENT", "file.readline"),
    ("FILE_CONTENT", "file.readlines"),
    ("FILE_CONTENT", "pathlib.Path.read_text"),
    ("FILE_CONTENT", "pathlib.Path.read_bytes"),
    ("NETWORK_RECV", "socket.recv"),
    ("NETWORK_RECV", "socket.recvfrom"),
    ("NETWORK_RECV", "urllib.request.urlopen"),
    ("NETWORK_RECV", "requests.get"),
    ("NETWORK_RECV", "requests.post"),
    ("DATABASE_RESULT", "cursor.fetchone"),
    ("DATABASE_RESULT", "cursor.fetchall"),
    ("DATABASE_RESULT", "cursor.fetchmany"),
    ("PASSWORD", "getpass.getpass"),
    ("CREDENTIALS", "keyring.get_password"),
)
# Kind of sink, function, and the arguments that matter.
SINK_FUNCTIONS = (
    ("SQL_EXECUTE", "cursor.execute", (0,)),
    ("SQL_EXECUTE", "cursor.executemany", (0,)),
    ("SQL_EXECUTE", "connection.execute", (0,)),
    ("SQL_EXECUTE", "engine.execute", (0,)),
    ("SQL_EXECUTE", "Model.objects.raw", (0,)),
    ("COMMAND_SHELL", "os.system", (0,)),
    ("COMMAND_SHELL", "os.popen", (0,)),
    ("COMMAND_SHELL", "subprocess.call", (0,)),
    ("COMMAND_SHELL", "subprocess.run", (0,)),
    ("COMMAND_SHELL", "subprocess.Popen", (0,)),
    ("CODE_EVAL", "builtins.eval", (0,)),
    ("CODE_EVAL", "builtins.exec", (0,)),
    ("CODE_EVAL", "builtins.compile", (0,)),
    ("CODE_EVAL", "builtins.__import__", (0,)),
    ("FILE_PATH", "builtins.open", (0,)),
    ("FILE_PATH", "os.remove", (0,)),
    ("FILE_PATH", "os.unlink", (0,)),
    ("FILE_PATH", "shutil.copy", (0, 1)),
    ("FILE_PATH", "shutil.move", (0, 1)),
    ("FILE_PATH", "pathlib.Path.open", ()),
    ("FILE_PATH", "flask.send_file", (0,)),
    ("FILE_PATH", "tarfile.extractall", (0,)),
    ("FILE_PATH", "tarfile.extract", (0, 1)),
    ("HTML_OUTPUT", "django.http.HttpResponse", (0,)),
    ("HTML_OUTPUT", "flask.render_template_string", (0,)),
    ("HTML_OUTPUT", "flask.Markup", (0,)),
    ("HTTP_REQUEST", "requests.get", (0,)),
    ("HTTP_REQUEST", "requests.post", (0,)),
    ("HTTP_REQUEST", "urllib.request.urlopen", (0,)),
    ("HTTP_REQUEST", "httpx.get", (0,)),
    ("DESERIALIZE", "pickle.loads", (0,)),
    ("DESERIALIZE", "pickle.load", (0,)),
    ("DESERIALIZE", "yaml.load", (0,)),
    ("DESERIALIZE", "yaml.unsafe_load", (0,)),
    ("DESERIALIZE", "marshal.loads", (0,)),
    ("XML_PARSE", "xml.etree.ElementTree.parse", (0,)),
    ("XML_PARSE", "xml.etree.ElementTree.fromstring", (0,)),
    ("XML_PARSE", "lxml.etree.parse", (0,)),
    ("XML_PARSE", "lxml.etree.fromstring", (0,)),
    ("LDAP_QUERY", "ldap.search_s", (0, 2)),
    ("LDAP_QUERY", "ldap3.Connection.search", (0, 1)),
    ("XPATH_QUERY", "lxml.etree.XPath", (0,)),
    ("XPATH_QUERY", "tree.xpath", (0,)),
    ("XPATH_QUERY", "tree.find", (0,)),
    ("NOSQL_QUERY", "collection.find", (0,)),
    ("NOSQL_QUERY", "collection.find_one", (0,)),
    ("NOSQL_QUERY", "db.command", (0,)),
    ("REGEX_PATTERN", "re.compile", (0,)),
    ("REGEX_PATTERN", "re.match", (0,)),
    ("REGEX_PATTERN", "re.search", (0,)),
    ("REGEX_PATTERN", "re.sub", (0,)),
    ("REDIRECT_URL", "flask.redirect", (0,)),
    ("REDIRECT_URL", "django.shortcuts.redirect", (0,)),
    ("REDIRECT_URL", "django.http.HttpResponseRedirect", (0,)),
    ("HEADER_SET", "response.__setitem__", (1,)),
    ("LOG_OUTPUT", "logging.info", (0,)),
    ("LOG_OUTPUT", "logging.debug", (0,)),
    ("LOG_OUTPUT", "logging.warning", (0,)),
    ("LOG_OUTPUT", "logging.error", (0,)),
    ("LOG_OUTPUT", "builtins.print", (0,)),
    ("FILE_WRITE", "file.write", (0,)),
    ("FILE_WRITE", "io.TextIOWrapper.write", (0,)),
    ("FILE_WRITE", "io.BufferedWriter.write", (0,)),
    ("CRYPTO_WEAK", "hashlib.md5", (0,)),
    ("CRYPTO_WEAK", "hashlib.sha1", (0,)),
)
# Sinks that are safe where they are told to use no shell.
SHELL_CHECKED = ("subprocess.call", "subprocess.run", "subprocess.Popen")
# Kind of sanitizer and function.
SANITIZER_FUNCTIONS = (
    ("SHELL_QUOTE", "shlex.quote"),
    ("BASENAME", "os.path.basename"),
    ("SECURE_FILENAME", "werkzeug.utils.secure_filename"),
    ("HTML_ESCAPE", "html.escape"),
    ("HTML_ESCAPE", "markupsafe.escape"),
    ("HTML_ESCAPE", "django.utils.html.escape"),
    ("RE_ESCAPE", "re.escape"),
    ("SAFE_LOADER", "yaml.safe_load"),
    ("SAFE_LOADER", "json.loads"),
    ("TYPE_CONVERSION", "builtins.int"),
)
# Methods known by name alone, and the contracts each may stand for, in order.
METHOD_ALIASES = (
    ("extractall", "tarfile.TarFile.extractall"),
    ("extractall", "zipfile.ZipFile.extractall"),
    ("extract", "tarfile.TarFile.extract"),
    ("extract", "zipfile.ZipFile.extract"),
    ("execute", "cursor.execute"),
    ("execute", "sqlite3.Cursor.execute"),
    ("executemany", "cursor.executemany"),
    ("executemany", "sqlite3.Cursor.executemany"),
    ("write", "file.write"),
    ("write", "io.TextIOWrapper.write"),
)


def sources(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """(key, ordinal, source_type, is_sensitive); later rows of a key replace earlier ones."""
    rows = [(f, SOURCES.index(t), SOURCES.index(t) >= 9) for t, f in SOURCE_FUNCTIONS] + list(more)
    last = {r[0]: r for r in rows}
    return spark.createDataFrame([(k, i, *r[1:]) for i, (k, r) in enumerate(last.items())], "key string, ordinal int, source_type int, is_sensitive boolean")


def sinks(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """(key, ordinal, sink_type, args, shell_check)."""
    rows = [(name, SINKS.index(kind), list(args), name in SHELL_CHECKED) for kind, name, args in SINK_FUNCTIONS]
    last = {r[0]: r for r in [*rows, *more]}
    return spark.createDataFrame([(k, i, *r[1:]) for i, (k, r) in enumerate(last.items())], "key string, ordinal int, sink_type int, args array<int>, shell_check boolean")


def sanitizers(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """(key, ordinal, sanitizer, clears_untrusted, clears_sensitive)."""
    rows = [(f, t, False, False) for t, f in SANITIZER_FUNCTIONS] + list(more)
    last = {r[0]: r for r in rows}
    return spark.createDataFrame([(k, i, *r[1:]) for i, (k, r) in enumerate(last.items())], "key string, ordinal int, sanitizer string, clears_untrusted boolean, clears_sensitive boolean")


def match(names: DataFrame, contracts: DataFrame) -> DataFrame:
    """(name, key): the contract of a call's name: itself, else for dotted names the first contract that it ends with,
    else by its method alone for a few known ones.  Contracts are a small table; names join it on equal keys."""
    n = names.select("name").distinct()
    simple = lambda c: F.element_at(F.split(c, r"\."), -1)
    exact = n.join(F.broadcast(contracts.select(F.col("key").alias("exact"))), F.col("name") == F.col("exact"), "left").withColumn("last", simple(F.col("name")))
    dotted = contracts.where(F.col("key").contains(".")).select("key", "ordinal", simple(F.col("key")).alias("last"))
    ends = exact.where(F.col("name").contains(".")).join(F.broadcast(dotted), "last").where(F.col("name").endswith(F.concat(F.lit("."), F.col("key"))))
    suffix = ends.groupBy("name").agg(F.min_by("key", "ordinal").alias("suffix"))
    alias_rows = [(m, i, k) for i, (m, k) in enumerate(METHOD_ALIASES)]
    alias = names.sparkSession.createDataFrame(alias_rows, "last string, i int, key string").join(contracts.select("key"), "key").groupBy("last").agg(F.min_by("key", "i").alias("alias"))
    found = exact.join(suffix, "name", "left").join(F.broadcast(alias), "last", "left")
    return found.select("name", F.coalesce("exact", "suffix", F.when(F.col("name").contains("."), F.col("alias"))).alias("key"))


def apply_sources(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """calls(name, tau, kappa, sigma, ...) with the taint of sources merged in; a sensitive source marks sigma, others tau."""
    bit = F.expr("shiftleft(1L, source_type)")
    known = calls.join(F.broadcast(contracts.select(F.col("key").alias("name"), "source_type", "is_sensitive")), "name", "left")
    hit = F.col("source_type").isNotNull()
    return known.withColumns(
        {
            "tau": F.when(hit & ~F.col("is_sensitive"), F.col("tau").bitwiseOR(bit)).otherwise(F.col("tau")),
            "sigma": F.when(hit & F.col("is_sensitive"), F.col("sigma").bitwiseOR(bit)).otherwise(F.col("sigma")),
            "kappa": F.when(hit, F.lit(0).cast("long")).otherwise(F.col("kappa")),
        }
    ).drop("source_type", "is_sensitive")


def apply_sanitizers(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """calls(name, tau, kappa, sigma, ...) after a sanitizer: its sinks are safe, and it may clear a kind of taint."""
    known = calls.join(F.broadcast(contracts.select(F.col("key").alias("name"), "sanitizer", "clears_untrusted", "clears_sensitive")), "name", "left")
    clear = lambda c, flag: F.when(F.coalesce(flag, F.lit(False)), F.lit(0).cast("long")).otherwise(F.col(c))
    return known.withColumns({"kappa": sanitize(F.col("kappa"), F.col("sanitizer")), "tau": clear("tau", F.col("clears_untrusted")), "sigma": clear("sigma", F.col("clears_sensitive"))}).drop("sanitizer", "clears_untrusted", "clears_sensitive")


def violations(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """(call, name, sink_type, arg): the first unsafe argument of each call of a sink.

    calls(call, name, arg, tau, kappa, sigma, shell): one row an argument; shell is null where it is not given, and a
    shell-checked sink with shell false is safe.
    """
    c = F.col
    known = calls.join(F.broadcast(contracts.select(c("key").alias("name"), "sink_type", "args", "shell_check")), "name")
    risky = known.where(F.array_contains("args", c("arg")) & ~(c("shell_check") & F.coalesce(~c("shell"), F.lit(False))))
    unsafe = risky.where(~is_safe(c("tau"), c("kappa"), c("sigma"), c("sink_type")))
    return unsafe.groupBy("call", "name", "sink_type").agg(F.min("arg").alias("arg"))


def contract_or_havoc(names: DataFrame, contracts: DataFrame) -> DataFrame:
    """(name, key): the exact contract, else a wildcard *.method, else the default that assumes nothing."""
    method = F.concat(F.lit("*."), F.element_at(F.split("name", r"\."), -1))
    exact = names.select("name").distinct().withColumn("wild", method).join(F.broadcast(contracts.select(F.col("key").alias("e"))), F.col("name") == F.col("e"), "left")
    return exact.join(F.broadcast(contracts.select(F.col("key").alias("w"))), F.col("wild") == F.col("w"), "left").select("name", F.coalesce("e", "w", F.lit("<havoc>")).alias("key"))




def by_cases(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """calls(call, name, value) with the result of their function's ordered cases: (call, name, value, ordinal, result).

    cases(name, ordinal, low, high, add, times): the first case whose bounds hold the value gives value * times + add; an
    open side is null.  Every summary needs a fallback, a case without bounds; a call whose name has no case, or
    that none of its cases takes, has no result.
    """
    value = F.col("value")
    inside = lambda c: (c["low"].isNull() | (value >= c["low"])) & (c["high"].isNull() | (value <= c["high"]))
    of_name = cases.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "low", "high", "add", "times"))).alias("cases"))  # as long as the summary
    rows = calls.select("call", "name", "value").join(F.broadcast(of_name), "name", "left")
    taken = rows.withColumn("c", F.when(value.isNotNull(), F.get(F.filter("cases", inside), F.lit(0))))
    return taken.select("call", "name", "value", F.col("c.ordinal").alias("ordinal"), (value * F.col("c.times") + F.col("c.add")).alias("result"))


def register_cases(known: DataFrame, more: DataFrame) -> DataFrame:
    """Cases with those of `more`, which replace all cases of the names they give; names without a fallback raise when they are read."""
    kept = known.join(more.select("name").distinct(), "name", "left_anti").unionByName(more)
    open_ = F.col("low").isNull() & F.col("high").isNull()
    whole = kept.groupBy("name").agg(F.some(open_).alias("ok"))
    checked = F.when(F.col("ok"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no fallback case: "), F.col("name"))))
    return kept.join(whole, "name").withColumn("name", checked).drop("ok")
