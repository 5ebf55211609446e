"""Anchors and rules as rows: the same rows as the plain forms, and plans that don't grow."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glintmark.operators import anchors, detect
from glintmark.plans import dims
from glintmark.sources import files as S
from glintmark.sources import parsers


def test_anchors_of_patterns():
    assert anchors.anchors("(?i)api[._-]?key\\s*=") in ({"api"}, {"key"}) and anchors.anchors("ghp_[a-z]{36}") == {"ghp_"}
    assert anchors.anchors("[a-z]+") == anchors.anchors("(a|bcd)") == anchors.anchors("(abc)?") == {""} and anchors.anchors("(?:xyz)*q") == {""}
    assert anchors.anchors("(foo|bar)+") == {"foo", "bar"} and anchors.anchors("(?=secret)x") == {""}
    for words in (["a", "ab", "abc", "b"], ["token", "tok", "to"], ["x"], ["a.b", "a*"]):
        rx = re.compile(anchors.trie(words))
        for w in words:
            assert rx.match(w)[0] == w


def plain_extended(rows, patterns):
    """Every pattern on every line."""
    best = {}
    for path, line, text in rows:
        if not re.search("[=:'\"@$.-]", text):
            continue
        for ix, (category, name, rx, severity, confidence, part) in enumerate(patterns):
            if m := re.search(rx, text):
                value = (part and m[part]) or m[0]
                if value and ((path, category, value) not in best or (line, ix) < best[(path, category, value)][:2]):
                    best[(path, category, value)] = (line, ix, name, severity, confidence)
    return Counter((p, v[0], k, v[2], x, v[3], v[4]) for (p, k, x), v in best.items())


def lines_of(seed, n=1500):
    rnd = random.Random(seed)
    words = ["password", "Secret", "token", "api_key", "client_secret", "ghp_" + "a1" * 18, "AKIA" + "Q" * 16, "=", ":", " ", "'", '"', "sk_live_" + "0a" * 12, "redis://u:pass@host:1", "Bearer", "abcdefgh1234" * 3, "facebook", "0123456789abcdef" * 2, "-----BEGIN CERTIFICATE-----", "github_token", "gcp_key", "é"]
    return [(f"f{k % 7}.py", k // 7 + 1, "".join(rnd.choice(words) + rnd.choice(["", " ", "='", "'", ': "', '"']) for _ in range(rnd.randrange(9)))) for k in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_extended_library_as_the_plain_form(spark, seed):
    rows = lines_of(seed)
    found = detect.extended_findings(spark.createDataFrame(rows, "path string, line int, text string")).collect()
    got = Counter((r.path, r.line, r.pattern_category, r.pattern, r.value, r.severity, r.confidence) for r in found)
    want = plain_extended(rows, dims.EXTENDED)
    assert got == want and len(want) > 100, (list((got - want).items())[:3], list((want - got).items())[:3])


def rules_of(n):
    out = []
    for k in range(n):
        names = f"(?i)svc{k}[_-]?(token|key)" if k % 3 else None
        values = [("form", f"^pre{k % 50}-[a-z0-9]{{6,}}$"), ("part", f"(?:zz{k}|yy{k})")] if k % 2 else []
        out.append({"id": f"r{k}", "name": f"Rule {k}", "severity": "high", "min_length": 6, "names": names, "not_names": "(?i)format" if k % 5 == 0 else None, "values": values, "not_values": "(?i)example" if k % 4 else None})
    return out


def items_of(spark, n):
    rows = [(f"f{k % 9}", f"svc{k % 97}_token" if k % 2 else f"svc{k}KeyFormat", [f"pre{k % 60}-abcdef{k}", f"zz{k % 80}yy{k % 70}", "short", "an example pre1-abcdef", None][k % 5], k % 11 or None) for k in range(n)]
    return spark.createDataFrame(rows + rows[:50], "path string, key string, value string, line int").withColumn("type", F.lit("x"))


def test_rules_as_rows(spark):
    items, rules = items_of(spark, 600), [*dims.RULES, *rules_of(60)]
    plain = Counter(map(tuple, detect.rule_findings(items, rules).collect()))
    assert len(rules) <= detect.INLINE_RULES and Counter(map(tuple, detect.many_rule_findings(items, rules).collect())) == plain and len(plain) > 50


def test_plans_do_not_grow(spark):
    size = lambda n: len(detect.rule_findings(items_of(spark, 5), rules_of(n))._jdf.queryExecution().analyzed().treeString().replace("zz", ""))
    plan = lambda n: Counter(re.findall(r"\b[A-Z]\w+(?= )", re.sub(r"'[^']*'|\(\?=.*", "", detect.rule_findings(items_of(spark, 5), rules_of(n))._jdf.queryExecution().sparkPlan().treeString())))
    assert size(100) > 0 and sum(plan(100).values()) >= sum(plan(2000).values()) - 5
    began = time.time()
    assert detect.rule_findings(items_of(spark, 600), rules_of(5000)).count() > 50
    assert time.time() - began < 120


def test_many_hits_in_one_file(spark):
    text = "".join(f"ENV A{k}_TOKEN=value{k:06}\n" for k in range(100_000))
    began = time.time()
    x = parsers.entries(spark.createDataFrame([("Dockerfile", text), ("a/Dockerfile", "FROM x\nENV\tB_TOKEN=abcdefg\n\nARG C_SECRET qwertyu")], "path string, content string"))
    got = x.agg(F.count("*").alias("n"), F.sum(F.when((F.col("path") == "Dockerfile") & (F.concat(F.lit("A"), (F.col("line") - 1).cast("string"), F.lit("_TOKEN")) == F.col("variable")), 1)).alias("right")).first()
    assert got.n == 100_002 and got.right == 100_000 and time.time() - began < 60
    assert sorted((r.line, r.value) for r in x.where("path like 'a/%'").collect()) == [(2, "abcdefg"), (3, "qwertyu")]  # the blank line belongs to the match
    assert S.route(F.lit("x")) is not None
