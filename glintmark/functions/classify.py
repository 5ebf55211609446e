"""What a finding is: a reference, a test value, a kind for remediation and controls; labels for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Well-known stand-ins.
KNOWN_TEST_VALUES = "dummy example sample placeholder changeme default password admin".split()
REFERENCE = "(?i)\\$\\{[^}]+\\}|\\$[A-Z_][A-Z0-9_]*$|os\\.environ|os\\.getenv|process\\.env\\.|System\\.getenv|ENV\\[|config\\.get\\(|secrets\\.|vars\\."
PROVIDER = "(?i)^(AKIA|ASIA|hf_|sk-|sk_|rk_|ghp_|gho_|ghu_|ghs_|ghr_|xox[baprs]-|AIza|glpat-|eyJ)"
PLACEHOLDER = "(?i)replace[_\\s-]?with|your[_-](api|secret|access|key|token|password)|change[_-]?me|placeholder|<[^>]+>"
TEST_PATTERN = f"{PLACEHOLDER}|(?i)test|dummy|example|sample|fake|mock|os\\.environ|(?-i)123+$|^(admin|root|user)123*$"


def is_reference(value: Column) -> Column:
    """Whether a value (or the right side of an assignment) refers to a secret instead of being one."""
    v = F.coalesce(value, F.lit(""))
    right = F.coalesce(F.nullif(F.trim(F.regexp_extract(v, "[:=]\\s*(.+)$", 1)), F.lit("")), v)
    right = F.trim(F.regexp_replace(right, "\\s+#.*$", ""))
    bare = F.regexp_replace(right, "[,)]+$", "")
    return (
        F.when(v == "", False).when(right.rlike(REFERENCE), True).when(bare.rlike(PROVIDER), False).when(right.rlike("^[\"']"), False)
        .when(bare.rlike("^[A-Za-z_][A-Za-z0-9_]*\\s*[(\\[]") | bare.rlike("^[A-Za-z_][A-Za-z0-9_]*\\.[A-Za-z_][A-Za-z0-9_]*\\s*\\("), True)
        .otherwise(bare.rlike("^[A-Za-z_]+$"))
    )


def is_monotonous(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    low, n = F.lower(v), F.length(v)
    few = F.size(F.filter(F.array_distinct(F.split(low, "")), lambda c: c != "")) < n * 0.4
    return (n < 8) | few | v.rlike("(.)\\1{3,}") | v.rlike("12|23|34|45|56|67|78|89|90|01") | low.rlike("abc|def|test|example")


def test_evidence(value: Column, variable: Column, path: Column, description: Column) -> Column:
    """Array of (sign, points) that a finding is a test value."""
    text = lambda c: F.coalesce(c, F.lit(""))
    clean = F.regexp_replace(text(value), "[\"\\s=:]+", "")
    signs = [
        ("secret_reference", is_reference(value), 0.9),
        ("known_test_value", clean.isin(*KNOWN_TEST_VALUES), 0.9),
        ("placeholder_value", text(value).rlike(PLACEHOLDER), 0.9),
        ("test_pattern_in_value", text(value).rlike(TEST_PATTERN), 0.3),
        ("test_pattern_in_variable", text(variable).rlike(TEST_PATTERN), 0.2),
        ("test_path", F.lower(text(path)).rlike("test|example|sample|mock"), 0.3),
        ("test_description", F.lower(text(description)).rlike("example|test|sample|demo"), 0.2),
        ("monotonous_value", is_monotonous(value), 0.1),
    ]
    return F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("sign"), F.lit(p).alias("points"))) for n, test, p in signs]))


def test_points(evidence: Column) -> Column:
    return F.least(F.lit(1.0), F.round(F.aggregate(evidence, F.lit(0.0), lambda a, e: a + e["points"]), 6))


def test_severity(severity: Column) -> Column:
    return F.when(severity == "critical", "high").when(severity == "high", "medium").when(severity == "medium", "low").otherwise("info")


ALIASES = {
    "aws": "aws", "gcp": "gcp", "azure": "generic", "github": "github", "github___gitlab___bitbucket": "github", "slack": "slack", "messaging___chat": "slack", "stripe": "stripe",
    "payments___banking": "stripe", "private_keys": "private_keys", "ssh___ssl___certs": "private_keys", "database": "database", "database_credentials": "database", "jwt": "jwt",
}
HINTS = [("aws", "aws"), ("gcp", "gcp"), ("google", "gcp"), ("github", "github"), ("slack", "slack"), ("stripe", "stripe"), ("jwt", "jwt"), ("postgres|mysql|mongo|database", "database")]


def _joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def remediation_key(pattern_category: Column, category: Column, rule_name: Column, kind: Column) -> Column:
    hay, cat = _joined(pattern_category, category, rule_name, kind), F.lower(F.coalesce(pattern_category, F.lit("")))
    out = F.when(hay.rlike("private key|rsa|pem"), "private_keys")
    for name, key in ALIASES.items():
        out = out.when(cat == name, key)
    for rx, key in HINTS:
        out = out.when(hay.rlike(rx), key)
    return out.otherwise("generic")


def cwe(key: Column, rule_name: Column, kind: Column, description: Column) -> Column:
    """Weakness of a finding by its remediation key and words about passwords."""
    password = _joined(rule_name, kind, description).contains("password")
    return F.when(key == "private_keys", "CWE-321").when(key == "database", "CWE-259").when(password, "CWE-259").otherwise("CWE-798")


def report_cwe(rule_name: Column, pattern_category: Column, kind: Column, description: Column) -> Column:
    """Weakness as reports for code scanning give it: by words alone."""
    hay = _joined(rule_name, pattern_category, kind, description)
    return F.when(hay.rlike("private key|private_key|rsa|pem|crypto|certificate"), "CWE-321").when(hay.rlike("passwd|password"), "CWE-259").otherwise("CWE-798")


def control_ids(key: Column, weakness: Column) -> Column:
    """Ordered array of the controls that a finding touches."""
    provider = F.when(key.isin("aws", "gcp", "github", "slack", "stripe"), "PCI-DSS 6.3.1")
    crypto = F.when(weakness == "CWE-321", "ISO 27001 A.8.24")
    return F.array_distinct(F.array_compact(F.array(weakness, F.lit("NIST 800-53 IA-5(7)"), F.lit("PCI-DSS 8.6.2"), F.lit("OWASP ASVS V2.10"), provider, F.lit("SOC 2 CC6.1"), crypto)))


def report_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def report_number(severity: Column) -> Column:
    return F.when(severity == "critical", 9.5).when(severity == "high", 8.0).when(severity == "medium", 5.0).otherwise(3.0)


def verification_status(verdict: Column) -> Column:
    return (
        F.when(F.coalesce(verdict, F.lit("")) == "", "not verified").when(verdict.startswith("ACTIVE"), "VERIFIED LIVE").when(verdict.startswith("INVALID"), "verified inactive")
        .when(verdict.startswith("SKIPPED"), "not verified").otherwise("verification inconclusive")
    )


# Forms and beginnings of tokens that a provider can be asked about.
TOKEN = "(gh[pousr]_[A-Za-z0-9]{30,40}|xox[baprs]-[A-Za-z0-9-]{10,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|ya29\\.[A-Za-z0-9_-]+|sk-ant-[A-Za-z0-9_-]{20,}|sk-proj-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{36})"
PROVIDERS = [("github", "^gh[pousr]_"), ("slack", "^xox[bpar]-"), ("stripe", "^[sr]k_(live|test)_"), ("gcp", "^ya29\\."), ("anthropic", "^sk-ant-"), ("openai", "^sk-"), ("npm", "^npm_")]


def token_in(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), TOKEN, 1), F.lit(""))


def provider(token: Column) -> Column:
    return reduce(lambda out, p: out.when(token.rlike(p[1]), p[0]), PROVIDERS[1:], F.when(token.rlike(PROVIDERS[0][1]), PROVIDERS[0][0]))


PASSWORD_WORDS, STRUCTURED_WORDS, SECRET_WORDS = (
    "password|passwd|passphrase", "aws|gcp|azure|github|gitlab|slack|stripe|google|private key|rsa|openssh|pem|certificate|access key id|api key|jwt|oauth", "secret|credential",
)


def breach_relevant(rule_name: Column, kind: Column, variable: Column, pattern_category: Column) -> Column:
    """Whether a corpus of leaked passwords can know the value."""
    hay = _joined(rule_name, kind, variable, pattern_category)
    return F.when(hay.rlike(PASSWORD_WORDS), True).when(hay.rlike(STRUCTURED_WORDS), False).otherwise(hay.rlike(SECRET_WORDS))


def breach_key(value: Column) -> tuple[Column, Column]:
    """First five and the other 35 characters of the upper-case SHA-1."""
    digest = F.upper(F.sha1(value.cast("binary")))
    return F.substring(digest, 1, 5), F.substring(digest, 6, 35)
