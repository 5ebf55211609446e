"""Reports: compliance rows, code-scanning document, masked tables, counts, and the writers for them."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..plans import dims


def visible(findings: DataFrame, show_tests: bool = False) -> DataFrame:
    return findings if show_tests or "is_test_credential" not in findings.columns else findings.where(~F.coalesce("is_test_credential", F.lit(False)))


def _kind() -> F.Column:
    return C.remediation_key(F.col("pattern_category"), F.col("category"), F.col("rule_name"), F.col("type"))


def with_remediation(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """action, revoke and root_cause by the finding's kind; the dimension has one row a kind."""
    return findings.withColumn("remediation_key", _kind()).join(F.broadcast(dims.remediation(spark)), "remediation_key", "left")


def remediation_text() -> F.Column:
    revoke = F.when(F.col("revoke") != "", F.concat(F.lit(" | Revoke: "), "revoke")).otherwise("")
    return F.concat(F.lit("Action: "), "action", revoke, F.lit(" | Fix: "), "root_cause")


def compliance(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """One row for each finding and control that it touches."""
    x = findings.withColumn("__k", _kind())
    x = x.withColumn("cwe", C.cwe(F.col("__k"), F.col("rule_name"), F.col("type"), F.col("description")))
    x = x.select("path", "line", "rule_id", "rule_name", "severity", X.mask(F.col("value")).alias("masked"), F.explode(C.control_ids(F.col("__k"), F.col("cwe"))).alias("control"))
    return x.join(F.broadcast(dims.controls(spark)), "control")


def masked(findings: DataFrame) -> DataFrame:
    """The columns of table exports, values masked."""
    verdict = F.col("verification") if "verification" in findings.columns else F.lit(None).cast("string")
    return findings.select("severity", "rule_name", "path", "line", F.coalesce("variable", F.lit("")).alias("variable"), X.mask(F.col("value")).alias("value"), F.coalesce("description", F.lit("")).alias("description"), C.verification_status(verdict).alias("verification"))


def public(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """What may leave the cluster about a finding: no value, but its mask and what to do."""
    has = lambda *names: F.coalesce(*[F.col(n) for n in names if n in findings.columns], F.lit(""))
    sure = F.coalesce(*[F.col(n) for n in ("overall_confidence", "confidence") if n in findings.columns], F.lit(0.0))
    return with_remediation(spark, findings).select(
        F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("rule_name", F.lit("Credential")).alias("type"), has("pattern_category", "category").alias("category"), F.col("path").alias("file"), "line",
        X.mask(F.col("value")).alias("masked"), F.round(sure, 3).alias("confidence"), F.col("rule_id").alias("detector"), F.coalesce(F.nullif(has("verification", "aws_validation"), F.lit("")), F.lit("not run")).alias("validation"),
        has("breach_exposure").alias("breach_exposure"), F.col("action").alias("remediation"), F.col("root_cause").alias("remediation_fix"),
    )


def by_file(findings: DataFrame) -> DataFrame:
    """Counts by severity and file, with the first and last line."""
    return findings.groupBy("severity", "path").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("severity", F.lit("medium")).alias("severity")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def rule_catalogue(findings: DataFrame) -> DataFrame:
    """One row a rule: its first finding by path and line."""
    first = F.min(F.struct("path", "line", "rule_name", "severity", "description")).alias("x")
    return findings.groupBy("rule_id").agg(first, F.count("*").alias("n")).select("rule_id", F.col("x.rule_name").alias("rule_name"), C.report_level(F.col("x.severity")).alias("level"), C.report_number(F.col("x.severity")).alias("security_severity"), "n")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON object a finding in the form of a code-scanning result; values only as fingerprints."""
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    mark = F.struct(X.fingerprint(F.col("rule_id"), F.col("path"), F.col("value")).alias("valueShape/v1"))
    weak = C.report_cwe(F.col("rule_name"), F.col("pattern_category"), F.col("type"), F.col("description"))
    message = F.struct(F.concat(F.coalesce("rule_name", F.lit("Credential")), F.lit(": "), X.mask(F.col("value"))).alias("text"))
    row = F.struct(F.col("rule_id").alias("ruleId"), C.report_level(F.col("severity")).alias("level"), message.alias("message"), place.alias("locations"), mark.alias("partialFingerprints"), F.struct(weak.alias("cwe")).alias("properties"))
    return findings.select("rule_id", "path", "line", F.to_json(row).alias("result"))


def write_sarif(findings: DataFrame, at: str) -> None:
    """A folder: results as JSON lines, rules as JSON. At scale one document would pass through one task; `sarif_document` gives it for small scans."""
    sarif_results(findings).select("result").write.mode("overwrite").text(f"{at}/results")
    rule_catalogue(findings).write.mode("overwrite").json(f"{at}/rules")


def sarif_document(findings: DataFrame, tool: str = "glintmark", most: int = 25_000) -> str:
    """One SARIF 2.1.0 document, of at most `most` results (the usual upload limit); more raise."""
    import json

    rows = sarif_results(findings).orderBy("path", "line", "rule_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} results; write them with write_sarif")
    rules = [{"id": r.rule_id, "name": r.rule_name, "defaultConfiguration": {"level": r.level}, "properties": {"security-severity": str(r.security_severity)}} for r in rule_catalogue(findings).orderBy("rule_id").collect()]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": [json.loads(r.result) for r in rows]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})


def write_csv(findings: DataFrame, at: str) -> None:
    masked(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(at)


def write_json(findings: DataFrame, at: str, hide: bool = True) -> None:
    (findings.withColumn("value", X.mask(F.col("value"))) if hide else findings).write.mode("overwrite").json(at)


def write_compliance(spark: SparkSession, findings: DataFrame, at: str) -> None:
    compliance(spark, findings).write.mode("overwrite").option("header", True).csv(at)


def write_baseline(exclusions: DataFrame, at: str) -> None:
    exclusions.write.mode("overwrite").json(at)


def html_page(findings: DataFrame, most: int = 1000) -> str:
    """A page with counts of all findings and a table of the `most` severe ones (it says how many of how many), escaped and masked."""
    from .merge import ordered

    counts = {r.severity: r.n for r in severity_counts(findings).collect()}
    rows = masked(ordered(findings).limit(most)).collect()
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    body = "".join("<tr>" + "".join(cell(r[c]) for c in ("severity", "rule_name", "path", "line", "variable", "value")) + "</tr>" for r in rows)
    total = ", ".join(f"{s} {counts[s]}" for s in reversed(dims.SEVERITIES) if s in counts)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Findings</title></head><body><p>{html.escape(total)}</p><p>{len(rows)} of {sum(counts.values())} findings</p><table>{body}</table></body></html>"
