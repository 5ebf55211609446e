"""Enrichment from supplied tables: key pairs of a file, verdicts on tokens, known leaks. No network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C


def aws_pairs(findings: DataFrame) -> DataFrame:
    """path, line, access_key, secret: each access key id with its file's secret; a named one first, else the first that has the form."""
    v, rule = F.col("value"), F.lower(F.coalesce("rule_name", F.lit("")))
    named = rule.contains("secret")
    secrets = findings.groupBy("path").agg(
        F.max(F.when(named, F.struct("line", "value"))).alias("n"), F.min(F.when(~named & v.rlike("^[A-Za-z0-9/+]{40}$"), F.struct("line", "value"))).alias("s")
    ).select("path", F.coalesce("n.value", "s.value").alias("secret"))
    keys = findings.where(v.rlike("^(AKIA|ASIA).{16}$")).select("path", "line", v.alias("access_key"))
    return keys.join(secrets, "path", "left").withColumn("aws_validation", F.when(F.col("secret").isNull(), "SKIPPED: no secret key in the same file"))


#: Shares that the findings of one value, or of none, are dealt into.
SHARES = 32


def looked_up(x: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """x with what told (one row a key) says to its keys, null where it says nothing.

    Few values may have most findings, and those without a key are alike, too: each key's rows are dealt into shares. Only answers that x asks for are
    repeated for these, so that told may be large.
    """
    asked = x.select(*keys).where(F.col(keys[0]).isNotNull()).distinct()
    mine = told.join(asked, keys, "left_semi").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("__share"))
    at = [c for c in ("path", "line", "variable", "value") if c in x.columns]
    return x.withColumn("__share", F.pmod(F.xxhash64(*at), F.lit(SHARES))).join(mine, [*keys, "__share"], "left").drop("__share")


def with_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verification and severity by a table (value_sha256, valid boolean, detail) of earlier answers of providers."""
    x = findings.withColumn("__token", C.token_in(F.col("value"))).withColumn("provider", C.provider(F.col("__token"))).withColumn("value_sha256", F.sha2("__token", 256))
    once = verdicts.groupBy("value_sha256").agg(F.max_by(F.struct("valid", "detail"), F.struct("valid", "detail")).alias("v"))
    x = looked_up(x, once, ["value_sha256"])
    detail = F.coalesce("v.detail", "provider")
    said = F.when(F.col("provider").isNull(), None).when(F.col("v.valid"), F.concat(F.lit("ACTIVE: "), detail)).when(~F.col("v.valid"), F.concat(F.lit("INVALID: "), detail)).otherwise("UNVERIFIED: no answer")
    return x.withColumns({"verification": said, "severity": F.when(said.startswith("ACTIVE"), "critical").otherwise(F.col("severity"))}).drop("__token", "value_sha256", "v")


def verify_with(findings: DataFrame, ask, schema: str = "value string, valid boolean, detail string") -> DataFrame:
    """Verdicts from an injected callable on batches: ask(list of tokens) -> list of (valid, detail). Opt-in; values are asked once each."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            answers = ask(pdf["value"].tolist())
            yield pd.DataFrame({"value": pdf["value"], "valid": [a[0] for a in answers], "detail": [a[1] for a in answers]})

    return findings.select(C.token_in(F.col("value")).alias("value")).where("value is not null").distinct().mapInPandas(run, schema)


def with_breaches(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """breach_exposure and severity by a table (prefix, suffix, count) of leaked values' SHA-1."""
    prefix, suffix = C.breach_key(F.col("value"))
    asked = C.breach_relevant(F.col("rule_name"), F.col("type"), F.col("variable"), F.col("pattern_category")) & (F.coalesce(F.length("value"), F.lit(0)) > 0)
    once = ranges.groupBy("prefix", "suffix").agg(F.max("count").alias("__count"))
    x = findings.withColumns({"prefix": F.when(asked, prefix), "suffix": F.when(asked, suffix)})
    x = looked_up(x, once, ["prefix", "suffix"])
    seen = F.coalesce("__count", F.lit(0))
    said = F.when(F.col("prefix").isNull(), None).when(seen > 0, F.concat(F.lit("EXPOSED: seen in "), seen.cast("string"), F.lit(" known breaches"))).otherwise("not in known breaches")
    raised = said.startswith("EXPOSED") & (F.col("severity").isNull() | F.col("severity").isin("info", "low", "medium"))
    return x.withColumns({"breach_exposure": said, "severity": F.when(raised, "high").otherwise(F.col("severity"))}).drop("prefix", "suffix", "__count")


def verification_stats(findings: DataFrame) -> DataFrame:
    """One row: verifiable, live, live_rate, breached."""
    v, b = F.col("verification"), F.col("breach_exposure")
    n = findings.agg(F.count_if(v.startswith("ACTIVE") | v.startswith("INVALID")).alias("verifiable"), F.count_if(v.startswith("ACTIVE")).alias("live"), F.count_if(b.startswith("EXPOSED")).alias("breached"))
    return n.select("verifiable", "live", F.coalesce(F.round(F.try_divide("live", "verifiable"), 6), F.lit(0.0)).alias("live_rate"), "breached")
