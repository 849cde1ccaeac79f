"""Confidence and risk scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.taint import SOURCES, is_safe

# Weights and levels of the scores.
SECURITY_WEIGHTS = {"source": 0.30, "sink": 0.25, "sanitization": 0.20, "semantic": 0.15, "chain": 0.10}
ERROR_WEIGHTS = {"source": 0.40, "semantic": 0.40, "chain": 0.20}
HIGH_RISK = ("HTTP_PARAM", "USER_INPUT", "NETWORK_RECV", "COOKIE")
MEDIUM_RISK = ("FILE_CONTENT", "ENVIRONMENT", "ARGV", "HEADER")
CERTAINTY = {"DEFINITE": 0.95, "LIKELY": 0.80, "POSSIBLE": 0.60, "UNKNOWN": 0.40}
RISKS = {
    "NOT_NONE": 0.05, "POSITIVE": 0.2, "NON_NEGATIVE": 0.15, "IN_BOUNDS": 0.25, "VALID_TYPE": 0.2, "NOT_EMPTY": 0.2, "FINITE": 0.02,
    "VALID_RANGE": 0.25, "SANITIZED": 0.3, "TRUSTED": 0.35,
}
CONTEXT_FACTORS = {
    "NONE": 1.0, "CLI_TOOL": 0.25, "ENV_VAR_CONFIG": 0.30, "TEST_FILE": 0.15, "SAFE_LOADER": 0.0, "SELF_DATA_FLOW": 0.30, "DEFENSE_IN_DEPTH": 0.40,
    "DEBUG_CODE": 0.20, "INTERNAL_API": 0.50,
}
SAFE_PRIOR = 0.60
DEFAULT_SUPPORT = 9


def _bits(names) -> int:
    return sum(1 << SOURCES.index(n) for n in names)


def _steps(c: Column, *pairs: tuple[int, float], rest: float) -> Column:
    out = None
    for most, v in pairs:
        out = F.when(c <= most, v) if out is None else out.when(c <= most, v)
    return out.otherwise(rest)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def source_score(tau: Column, sigma: Column, n_ids: Column) -> Column:
    """By the number of high and medium risk sources, sensitive sources, and a bonus for known ones."""
    count = lambda c, m: F.bit_count(c.bitwiseAND(F.lit(m).cast("long")))
    high, medium = count(tau, _bits(HIGH_RISK)), count(tau, _bits(MEDIUM_RISK))
    untrusted = F.when(tau == 0, 0.0).when(high >= 2, 0.95).when(high == 1, 0.85).when(medium >= 1, 0.70).otherwise(0.50)
    sensitive = F.when(sigma == 0, 0.0).when(F.bit_count(sigma) >= 2, 0.90).otherwise(0.85)
    score = F.greatest(untrusted, sensitive)
    return F.when((tau == 0) & (sigma == 0), 0.0).when(n_ids > 0, F.least(F.lit(1.0), score + 0.05)).otherwise(score)


def sink_score(chain: Column) -> Column:
    return _steps(chain, (1, 0.95), (2, 0.85), (4, 0.70), rest=0.50)


def sanitization_score(tau: Column, kappa: Column, sigma: Column, sink: Column) -> Column:
    return F.when(is_safe(tau, kappa, sigma, sink), 0.0).otherwise(_steps(F.bit_count(kappa), (0, 0.95), (3, 0.85), rest=0.70))


def semantic_score(guarded: Column, handler: Column, framework: Column) -> Column:
    less = lambda c, v: F.when(c, v).otherwise(0.0)
    return clamp(F.lit(0.80) - less(guarded, 0.40) - less(handler, 0.20) + less(framework, 0.10))


def chain_score(chain: Column) -> Column:
    return _steps(chain, (1, 1.0), (2, 0.90), (4, 0.75), (8, 0.60), rest=0.40)


def security_score(rows: DataFrame) -> DataFrame:
    """rows(tau, kappa, sigma, sink, guarded, handler, framework, chain, n_ids) with score: 0 without sources or if safe."""
    c = F.col
    src = source_score(c("tau"), c("sigma"), c("n_ids"))
    san = sanitization_score(c("tau"), c("kappa"), c("sigma"), c("sink"))
    w = SECURITY_WEIGHTS
    total = src * w["source"] + sink_score(c("chain")) * w["sink"] + san * w["sanitization"] + semantic_score(c("guarded"), c("handler"), c("framework")) * w["semantic"] + chain_score(c("chain")) * w["chain"]
    return rows.withColumn("score", F.round(F.when((src == 0) | (san == 0), 0.0).otherwise(total), 6))


def error_score(rows: DataFrame) -> DataFrame:
    """rows(certainty, guarded, handler, chain, n_params) with score."""
    c = F.col
    table = F.create_map(*(F.lit(x) for kv in CERTAINTY.items() for x in kv))
    sure = F.coalesce(F.element_at(table, c("certainty")), F.lit(0.50))
    sure = F.when(c("n_params") > 0, F.least(F.lit(1.0), sure + 0.05)).otherwise(sure)
    w = ERROR_WEIGHTS
    return rows.withColumn("score", F.round(sure * w["source"] + semantic_score(c("guarded"), c("handler"), F.lit(False)) * w["semantic"] + chain_score(c("chain")) * w["chain"], 6))


def derived_confidence(risk_upper: Column, legacy: Column) -> Column:
    """The risk's upper bound if there is one, else the older score, from 0 to 1."""
    return clamp(F.coalesce(risk_upper, legacy))


def risk_upper(precond: Column, upper: Column, may_be_negative: Column) -> Column:
    """Upper bound of the chance that a precondition fails; null for unknown ones.

    Not zero: one value of a uniform support, 0 to the bound, or both ways where it may be negative or nothing is known.
    """
    ub = F.greatest(F.lit(0), F.coalesce(upper, F.lit(DEFAULT_SUPPORT)))
    support = F.when(F.coalesce(may_be_negative, F.lit(True)), 2 * ub + 1).otherwise(ub + 1)
    table = F.create_map(*(F.lit(x) for kv in RISKS.items() for x in kv))
    return F.when(precond == "NOT_ZERO", F.least(F.lit(1.0), 1.0 / F.greatest(F.lit(1), support))).otherwise(F.try_element_at(table, precond))


def context_multiplier(contexts: Column) -> Column:
    """The least factor of the matched contexts, 1 without any."""
    table = F.create_map(*(F.lit(x) for kv in CONTEXT_FACTORS.items() for x in kv))
    return F.coalesce(F.array_min(F.transform(contexts, lambda x: F.try_element_at(table, x))), F.lit(1.0))


def unintentional(signals: Column) -> Column:
    """Product of one less each signal's confidence."""
    return F.aggregate(F.coalesce(signals, F.array().cast("array<double>")), F.lit(1.0).cast("double"), lambda a, x: a * (1 - x))


def posterior_safe(signals: DataFrame, key: str, prior: float = SAFE_PRIOR) -> DataFrame:
    """(key, posterior) from signals(key, strength, inverse): log odds add up, ratios that are not positive numbers are left out."""
    lr = F.try_divide("strength", "inverse")
    odds = F.lit(prior / (1 - prior))
    total = F.log(odds) + F.coalesce(F.sum(F.when((lr > 0) & (lr < float("inf")), F.log(lr))), F.lit(0.0))
    return signals.groupBy(key).agg(F.round(1 / (1 + F.exp(-total)), 6).alias("posterior"))


def is_test_file(path: Column) -> Column:
    """A test's file name, or a test folder anywhere in the path."""
    from factloom.functions.intent import is_test_path

    return is_test_path(path)
