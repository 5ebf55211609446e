"""Overall confidence of findings: six factors, a null-aware weighted mean, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Weights of the factors.
WEIGHTS = {"pattern": 0.30, "context": 0.25, "entropy": 0.20, "technology": 0.15, "environment": 0.05, "validation": 0.05}
# Scores of technologies, and names and values that tell, are usual, or are doubtful.
TECHNOLOGY_SCORES = {"aws": 0.9, "gcp": 0.9, "azure": 0.9, "github": 0.85, "stripe": 0.85, "slack": 0.8, "generic": 0.6}
TELLING_NAME = "(?i)api[_-]?key|secret[_-]?key|private[_-]?key|access[_-]?token|auth[_-]?token|bearer[_-]?token|aws[_-]?access[_-]?key|github[_-]?token|slack[_-]?token|stripe[_-]?key|twilio[_-]?auth"
TELLING_VALUE = "^[A-Za-z0-9+/]{40,}={0,2}$|^[0-9a-f]{32,}$|^[A-Za-z0-9_-]{20,}$"
USUAL_NAME = "(?i)passwd|password|secret|token|key|config|settings|env|credential"
DOUBTFUL = "(?i)test|example|sample|demo|mock|fake|dummy|^(true|false|yes|no|null|undefined)$|^(localhost|127\\.0\\.0\\.1)$|^(user|admin|root)$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def pattern_factor(variable: Column, value: Column, pattern_name: Column) -> Column:
    v, x = F.lower(_text(variable)), _text(value)
    score = F.when(v.rlike(TELLING_NAME) | x.rlike(TELLING_NAME) | x.rlike(TELLING_VALUE) | v.rlike(TELLING_VALUE), 0.9).when(v.rlike(USUAL_NAME), 0.7).otherwise(0.5)
    score = F.when(v.rlike(DOUBTFUL) | x.rlike(DOUBTFUL), F.least(score, F.lit(0.3))).otherwise(score)
    named = (_text(pattern_name) != "") & ~F.lower(_text(pattern_name)).contains("generic")
    return F.least(F.lit(1.0), F.round(score + F.when(named, 0.1).otherwise(0.0), 6))


def context_factor(modifier: Column, risk: Column) -> Column:
    score = F.when(modifier >= 1.5, 0.9).when(modifier >= 1.2, 0.8).when(modifier >= 1.0, 0.7).when(modifier >= 0.8, 0.5).otherwise(0.3)
    score = score + F.when(risk == "high", 0.1).when(risk == "low", -0.1).otherwise(0.0)
    return F.when(modifier.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))))


def entropy_factor(bits: Column, encoding: Column, variety: Column) -> Column:
    score = F.when(bits >= 5.0, 0.9).when(bits >= 4.0, 0.8).when(bits >= 3.5, 0.7).when(bits >= 3.0, 0.6).otherwise(0.4)
    score = score + F.when(encoding == "base64", 0.1).when(encoding == "hex", 0.05).when(encoding == "jwt", 0.15).when(encoding == "uuid", 0.1).otherwise(0.0)
    score = score + F.when(variety >= 0.8, 0.1).when(variety <= 0.3, -0.1).otherwise(0.0)
    return F.when(bits.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))))


def technology_factor(technology: Column, confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TECHNOLOGY_SCORES.items() for x in kv])
    return F.when(technology.isNotNull(), F.coalesce(F.element_at(table, technology), confidence, F.lit(0.7)))


def environment_factor(path: Column, variable: Column) -> Column:
    p, v = F.lower(_text(path)), F.lower(_text(variable))
    both = F.concat_ws("\n", p, v)
    score = F.when(both.rlike("prod|live|release"), 0.8).when(both.rlike("test|dev|staging|demo|example"), 0.6).otherwise(0.5)
    return F.round(score + F.when(X.contains_any(p, [".env", "config", "settings", ".yaml", ".json"]), 0.1).otherwise(0.0), 6)


def validation_factor(value: Column) -> Column:
    v, n = _text(value), F.length(_text(value))
    score = F.when(n < 8, 0.2).when(n > 256, 0.3).when(n.between(16, 128), 0.8).otherwise(0.5)
    score = F.when(v.rlike("(?i)^(true|false|yes|no|null|undefined|none)$|^\\d{1,4}$|^[a-zA-Z]\\w*$|^https?://"), F.least(score, F.lit(0.2))).otherwise(score)
    return F.when(v.rlike("^[A-Za-z0-9+/]{20,}={0,2}$") | v.rlike("^[0-9a-f]{32,}$"), F.greatest(score, F.lit(0.7))).when(v.rlike("^[A-Za-z0-9_-]{20,}$"), F.greatest(score, F.lit(0.6))).otherwise(score)


def overall(factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the factors that aren't null, between .1 and 1, to three places."""
    w = WEIGHTS | (weights or {})
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, c in factors.items():
        top, bottom = top + F.coalesce(c * w[name], F.lit(0.0)), bottom + F.when(c.isNotNull(), w[name]).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.round(F.round(F.round(top, 9) / F.round(bottom, 9), 9), 3)))


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.6, "MEDIUM-HIGH").when(confidence >= 0.4, "MEDIUM").otherwise("LOW")


def with_factors(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """confidence_factors (largest share first) and confidence_level in place of the factor_scores that they follow from."""
    w, f = WEIGHTS | (weights or {}), F.col("factor_scores")
    rows = F.array(*[F.when(f[n].isNotNull(), F.struct(F.round(-f[n] * w[n], 9).alias("order"), F.lit(n).alias("factor"), F.lit(w[n]).alias("weight"), f[n].alias("score"))) for n in WEIGHTS])
    parts = F.transform(F.sort_array(F.array_compact(rows)), lambda r: F.struct(r["factor"], r["weight"], r["score"], F.round(-r["order"], 6).alias("share")))
    told = {"confidence_factors": parts, "confidence_level": level(F.col("overall_confidence"))}
    at = findings.columns.index("factor_scores")
    return X.computed(findings, told).select(*findings.columns[:at], *told, *findings.columns[at + 1 :])


def scored(findings: DataFrame, weights: dict[str, float] | None = None, use_entropy: bool = True, listed: bool = True) -> DataFrame:
    """Findings (with context columns, if they have them) plus overall_confidence, confidence_level, confidence_factors (largest share first).

    listed off: plus overall_confidence and factor_scores, of which with_factors makes the others.
    """
    col = lambda n: F.col(n) if n in findings.columns else F.lit(None).cast("string" if n in ("risk_level", "encoding_type") else "double")
    # Of a finding's technology: its own column, or the category of what the technology detector found.
    technology = F.col("technology") if "technology" in findings.columns else F.when(F.col("type") == "technology_match", F.lower("pattern_category")) if {"type", "pattern_category"} <= {*findings.columns} else F.lit(None).cast("string")
    factors = {
        "pattern": pattern_factor(F.col("variable"), F.col("value"), F.col("pattern")),
        "context": context_factor(col("context_modifier"), col("risk_level")),
        "entropy": entropy_factor(col("entropy"), col("encoding_type"), col("diversity")) if use_entropy else F.lit(None).cast("double"),
        "technology": technology_factor(technology, F.col("confidence") if "confidence" in findings.columns else F.lit(None).cast("double")),
        "environment": environment_factor(F.col("path"), F.col("variable")),
        "validation": validation_factor(F.col("value")),
    }
    judged = lambda f: F.struct(overall({n: f[n] for n in factors}, weights).alias("overall_confidence"), f.alias("factor_scores"))
    # Factors are long expressions and are named often, by filters, too; computed once, the generated code stays small.
    x = X.computed(findings, {"__judged": X.let(F.struct(*[c.cast("double").alias(n) for n, c in factors.items()]), judged)})
    x = x.select("*", "__judged.*").drop("__judged")
    return with_factors(x, weights) if listed else x


def top_factors(factors: Column, n: int = 3) -> Column:
    return F.slice(factors, 1, n)


def confident(findings: DataFrame, least_context: float = 0.1, least_overall: float = 0.3) -> DataFrame:
    """Findings above both floors; an overall confidence of 0 or null isn't judged."""
    x = findings.where(F.coalesce("confidence", F.lit(1.0)) >= least_context)
    if "overall_confidence" in x.columns:
        oc = F.coalesce("overall_confidence", F.lit(0.0))
        x = x.where(~((oc > 0) & (oc < least_overall)))
    return x
