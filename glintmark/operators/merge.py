"""Duplicates of findings: highest confidence, groups of near lines, test values, summary, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..plans import dims


def rank_of(severity: Column) -> Column:
    """0 for info to 4 for critical; 1 for anything else."""
    out = F.when(severity == dims.SEVERITIES[0], 0)
    for k, s in enumerate(dims.SEVERITIES[1:], 1):
        out = out.when(severity == s, k)
    return out.otherwise(1)


def highest_confidence(findings: DataFrame, keys: list[str], tie: list[str] | None = None) -> DataFrame:
    """One row a key: that of the highest confidence (missing ones count .5), then the smallest tie columns.

    An aggregate of structs, so duplicates meet inside tasks before the shuffle.
    """
    rest = [c for c in findings.columns if c not in keys]
    order = F.struct((-F.coalesce("confidence", F.lit(0.5))).alias("__order"), *[F.col(c) for c in (tie or []) if c in rest], *[F.col(c).alias(f"_{c}") for c in rest])
    return findings.groupBy(*keys).agg(F.min(order).alias("x")).select(*keys, *[F.col(f"x._{c}").alias(c) for c in rest])


def group_key(value: Column, path: Column, line: Column) -> Column:
    """Equal values of a file within the same five lines."""
    plain = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[\"\\s=:]", "")
    bucket = (F.floor(F.coalesce(line, F.lit(0)) / 5) * 5).cast("string")
    return F.substring(F.md5(F.concat_ws(":", plain, F.coalesce(path, F.lit("")), bucket).cast("binary")), 1, 16)


def consensus(mean: Column) -> Column:
    return F.when(mean >= 3.5, "critical").when(mean >= 2.5, "high").when(mean >= 1.5, "medium").when(mean >= 0.5, "low").otherwise("info")


def merged(findings: DataFrame) -> DataFrame:
    """One row a group: the most confident finding, with count, rules, methods and consensus severity.

    Findings of a group are summed up by rule, pattern and severity first, so what is gathered is bounded by the rules, not by the
    findings. detection_methods has one entry for each, with its count and highest confidence, the surest first.
    """
    columns = findings.columns
    sure = F.coalesce(*[F.col(c) for c in ("overall_confidence", "confidence") if c in columns], F.lit(0.0))
    plain = [c for c in columns if findings.schema[c].dataType.typeName() not in ("map",)]
    # A method's keys aren't carried twice while its findings are sorted and shuffled; among methods the order goes over all columns again.
    keys = {"rule_name": "rule", "pattern": "pattern", "severity": "severity"}
    base = F.struct((-sure).alias("__o"), *[F.col(c).alias(f"_{c}") for c in plain if c not in keys])
    keyed = findings.select(group_key(F.col("value"), F.col("path"), F.col("line")).alias("group_key"), F.col("rule_name").alias("rule"), "pattern", "severity", "confidence", base.alias("x"))
    by_method = keyed.groupBy("group_key", "rule", "pattern", "severity").agg(F.min("x").alias("x"), F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    by_method = by_method.withColumn("x", F.struct("x.__o", *[F.col(keys.get(c, f"x._{c}")).alias(f"_{c}") for c in plain]))
    method = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("order"), "rule", "pattern", "severity", "n", "confidence")
    x = by_method.groupBy("group_key").agg(
        F.min("x").alias("x"), F.sum("n").alias("detection_count"), F.array_sort(F.collect_set(F.coalesce("rule", F.lit("Unknown")))).alias("rule_names"),
        F.sort_array(F.collect_list(method)).alias("methods"), F.round(F.sum(rank_of(F.col("severity")) * F.col("n")) / F.sum("n"), 6).alias("mean"),
    )
    many = F.col("detection_count") > 1
    severity = F.when(many, consensus(F.col("mean"))).otherwise(F.col("x._severity"))
    out = [severity.alias(c) if c == "severity" else F.col(f"x._{c}").alias(c) for c in plain]
    methods = F.transform("methods", lambda m: F.struct(m["rule"].alias("rule"), m["pattern"].alias("pattern"), m["severity"].alias("severity"), m["n"].alias("n"), m["confidence"].alias("confidence")))
    return x.select("group_key", *out, "detection_count", "rule_names", methods.alias("detection_methods"), many.alias("is_duplicate_group"))


def top_methods(methods: Column, n: int = 3) -> Column:
    return F.slice(methods, 1, n)


def with_test_flag(findings: DataFrame, more_than: float = 0.3) -> DataFrame:
    """is_test_credential, test_indicators, test_confidence; test values get a lower severity."""
    x = findings.withColumn("__e", C.test_evidence(F.col("value"), F.col("variable"), F.col("path"), F.col("description")))
    x = x.withColumns({"test_confidence": C.test_points(F.col("__e")), "test_indicators": F.transform("__e", lambda e: e["sign"])}).withColumn("is_test_credential", F.col("test_confidence") > more_than)
    return x.withColumn("severity", F.when(F.col("is_test_credential"), C.test_severity(F.col("severity"))).otherwise(F.col("severity"))).drop("__e")


def summary(findings: DataFrame, prefix: int | None = None) -> DataFrame:
    """One row: totals, distinct values (quotes, spaces, = and : taken out; their first prefix characters, if given), groups of duplicates, tests and others, counts by severity."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in findings.columns else F.lit(False)
    test, value = flag("is_test_credential"), F.regexp_replace(F.coalesce("value", F.lit("")), "[\"\\s=:]+", "")
    return findings.agg(
        F.count("*").alias("total"), F.countDistinct(F.substring(value, 1, prefix) if prefix else value).alias("distinct_values"), F.count_if(flag("is_duplicate_group")).alias("duplicate_groups"),
        F.count_if(test).alias("tests"), F.count_if(~test).alias("real"), *[F.count_if(F.coalesce("severity", F.lit("medium")) == s).alias(s) for s in dims.SEVERITIES],
    )


def ordered(findings: DataFrame, by: str = "severity") -> DataFrame:
    """severity: most severe first, then most confident, then by place. line: by file and line. time: latest commit first. confidence: surest first."""
    sure = F.coalesce(*[F.col(c) for c in ("overall_confidence", "confidence") if c in findings.columns], F.lit(0.0))
    first = {"severity": [rank_of(F.col("severity")).desc(), sure.desc()], "line": [], "time": [F.col("commit_timestamp").desc_nulls_last()] if by == "time" else [], "confidence": [sure.desc()]}
    return findings.orderBy(*first[by], "path", "line", "value")


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of places (path, line)."""
    a, b = found.select("path", "line").distinct(), truth.select("path", "line").distinct()
    both = a.withColumn("f", F.lit(1)).join(b.withColumn("t", F.lit(1)), ["path", "line"], "full")
    n = both.agg(F.count_if(F.expr("f = 1 and t = 1")).alias("tp"), F.count_if(F.expr("f = 1 and t is null")).alias("fp"), F.count_if(F.expr("f is null and t = 1")).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return n.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))
