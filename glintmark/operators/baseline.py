"""Baselines: findings that were reviewed before are excluded, by place and value, by value pattern or by path pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of a baseline that are joined into one regular expression; more are a mistake in the file.
MOST_PATTERNS = 10_000


def _first_pattern(col: str, patterns: list[tuple[str, str, str]]) -> F.Column:
    """(id, reason) of the first matching pattern, as a chain of tests behind one test of all."""
    kind = "struct<id: string, reason: string>"
    out = F.lit(None).cast(kind)
    for i, rx, reason in reversed(patterns):
        out = F.when(F.col(col).rlike(rx), F.struct(F.lit(i).alias("id"), F.lit(reason).alias("reason")).cast(kind)).otherwise(out)
    return F.when(F.col(col).rlike("|".join(f"(?:{rx})" for _, rx, _ in patterns)), out) if patterns else out


def with_exclusions(findings: DataFrame, exact: DataFrame | None = None, patterns: list[tuple[str, str, str]] | None = None, paths: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """excluded, exclusion_id, exclusion_reason. exact: (id, path, line, value_hash, reason), joined on its keys.

    patterns and paths: reviewed lists of (id, regular expression, reason), short by nature and checked against MOST_PATTERNS.
    """
    if len(patterns or []) + len(paths or []) > MOST_PATTERNS:
        raise ValueError("too many patterns in the baseline")
    x = findings
    if exact is not None:
        once = exact.groupBy("path", "line", "value_hash").agg(F.min(F.struct("id", "reason")).alias("__exact"))
        x = x.withColumn("value_hash", F.sha2(F.coalesce("value", F.lit("")), 256)).join(once, ["path", "line", "value_hash"], "left").drop("value_hash")
    else:
        x = x.withColumn("__exact", F.lit(None).cast("struct<id: string, reason: string>"))
    x = x.withColumn("__hit", F.coalesce("__exact", _first_pattern("value", patterns or []), _first_pattern("path", paths or [])))
    return x.withColumns({"excluded": F.col("__hit").isNotNull(), "exclusion_id": F.col("__hit.id"), "exclusion_reason": F.col("__hit.reason")}).drop("__hit", "__exact")


def reported(findings: DataFrame, **baseline) -> DataFrame:
    return with_exclusions(findings, **baseline).where("not excluded").drop("excluded", "exclusion_id", "exclusion_reason")


def baseline_of(findings: DataFrame, reason: str = "accepted") -> DataFrame:
    """Exact exclusions for all findings given; ids follow from the content, so writing twice gives the same."""
    x = findings.select("rule_id", "path", "line", F.sha2(F.coalesce("value", F.lit("")), 256).alias("value_hash")).distinct()
    ident = F.substring(F.sha2(F.concat_ws("|", "rule_id", "path", F.col("line").cast("string"), "value_hash"), 256), 1, 16)
    return x.select(ident.alias("id"), "rule_id", "path", "line", "value_hash", F.lit(reason).alias("reason"))


def from_tables(tables: dict[str, DataFrame]) -> dict:
    """Arguments of with_exclusions from the tables of a baseline file (files.load_baseline). Patterns are a reviewed list, collected up to MOST_PATTERNS."""
    listed = lambda name, col: [(r.id, r[col], r.reason) for r in tables[name].select("id", col, "reason").limit(MOST_PATTERNS + 1).collect()]
    return {"exact": tables["findings"].select("id", "path", "line", "value_hash", "reason"), "patterns": listed("patterns", "pattern"), "paths": listed("paths", "path_pattern")}
