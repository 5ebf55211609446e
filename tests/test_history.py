"""History by distinct object: any bytes, any name, rules and baseline; each content is scanned once."""

import subprocess

import pytest
from pyspark.sql import functions as F

from glintmark.operators import history
from glintmark.plans import engine
from glintmark.sources import files as S
from glintmark.sources import repository as R

GHP = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0hJ3lM6"
AKIA = "AKIA" + "ZQ3TR7XK9PL2MN5B"
ODD = 'tab\there "q" \\ü.py'


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")

    def commit(message, **_):
        git("add", "-A")
        git("commit", "-qm", message, "--allow-empty")

    (at / "latin.py").write_bytes("# caf\xe9 \xff\n".encode("latin-1") + f"github_token = '{GHP}'\n".encode())
    (at / "schön.py").write_text(f"x = 1\naws = '{AKIA}'\n")
    (at / ODD).write_text("a = 1\n")
    (at / "a b.py").write_text("a = 1\n")
    (at / "data.json").write_text('{"db": {"password": "hunter2hunter2"}}')
    (at / "b.bin").write_bytes(b"\0" + GHP.encode())
    commit("one | \x1f odd")
    for k in range(40):
        (at / "counter.txt").write_text(f"{k}\n")
        commit(f"count {k}")
    (at / "schön.py").write_text("x = 1\n")
    (at / ODD).write_text(f"a = 1\n\n\ntoken = '{GHP}'\n")
    (at / "a b.py").write_text(f"a = 1\nkey = '{AKIA}'\n")
    commit("away")
    (at / "schön.py").write_text(f"x = 1\naws = '{AKIA}'\n")
    commit("back again: the same object as at first, changed against another")
    return str(at)


def test_tables(spark, repo):
    log = R.git_commits(spark, repo).orderBy("log_ix").collect()
    assert [r.log_ix for r in log] == list(range(43)) and log[-1].commit_message.startswith("one") and log[0].commit_timestamp > 0
    assert R.git_commits(spark, repo, most=3).count() == 3
    changes = R.changed_objects(spark, repo, R.git_commits(spark, repo))
    names = {r.file for r in changes.collect()}
    assert {"latin.py", "schön.py", ODD, "a b.py", "b.bin", "counter.txt", "data.json"} == names
    assert changes.where("file = 'counter.txt'").count() == 40 and changes.where("file = 'schön.py'").count() == 3 and changes.where("file = 'schön.py'").select("new_blob").distinct().count() == 2
    held = R.contents(spark, repo, changes.select(F.col("new_blob").alias("blob"))).collect()
    assert len(held) == changes.where("file <> 'b.bin'").select("new_blob").distinct().count() == len({r.blob for r in held})
    runs = R.added_ranges(spark, repo, changes.where(F.col("file") == ODD)).collect()
    assert [(r["first"], r["last"]) for r in runs] == [(2, 4)]
    with pytest.raises(Exception, match="object"):
        R.contents(spark, repo, spark.createDataFrame([("0" * 39 + "1",)], "blob string")).collect()


def test_diffs_of_any_bytes_and_names(spark, repo):
    commits = R.git_commits(spark, repo)
    added = S.added_lines(S.git_diffs(spark, repo, commits)).collect()
    got = {(r.file, r.line): r.text for r in added}
    assert got[("latin.py", 2)] == f"github_token = '{GHP}'" and got[("latin.py", 1)].startswith("# caf�")
    assert got[(ODD, 4)] == f"token = '{GHP}'" and got[("schön.py", 2)] == f"aws = '{AKIA}'" and got[("a b.py", 2)] == f"key = '{AKIA}'"
    quoted = 'diff --git "a/sch\\303\\266n.py" "b/sch\\303\\266n.py"\n--- /dev/null\n+++ "b/sch\\303\\266n\\\\ \\"x\\".py"\n@@ -0,0 +1 @@\n+++ b/not a header\n'
    assert [(r.file, r.line, r.text) for r in S.added_lines(spark.createDataFrame([("c", quoted)], "commit_hash string, diff string")).collect()] == [('schön\\ "x".py', 1, "++ b/not a header")]


def test_scan(spark, repo):
    found, exposed = history.scan_repository(spark, repo, engine.ScanConfig(min_overall=0.0, min_context=0.0))
    rows = found.select("commit_hash", "path", "line", "value").collect()
    log = {r.commit_hash: r.log_ix for r in R.git_commits(spark, repo).collect()}
    got = {(log[r.commit_hash], r.path, r.line, r.value) for r in rows if r.value in (GHP, AKIA, "hunter2hunter2")}
    assert got == {(42, "latin.py", 2, GHP), (42, "schön.py", 2, AKIA), (42, "data.json", 1, "hunter2hunter2"), (1, ODD, 4, GHP), (1, "a b.py", 2, AKIA), (0, "schön.py", 2, AKIA)}
    counts = {(r.original_file, r.value): r.exposure_commit_count for r in exposed.where(F.col("rule_id").contains("structural") | F.lit(True)).groupBy("original_file", "value").agg(F.max("exposure_commit_count").alias("exposure_commit_count")).collect()}
    assert counts[("schön.py", AKIA)] >= 2 and counts[("latin.py", GHP)] >= 1
    known, _ = history.scan_repository(spark, repo, engine.ScanConfig(min_overall=0.0, min_context=0.0, use_context=False, technology=False, entropy=False, items=False, entries=False), {"paths": [("p", "^sch", "known")], "patterns": [("v", "^ghp_", "known")]})
    assert {(r.path) for r in known.where(F.col("value").isin(GHP, AKIA)).select("path").collect()} == {"a b.py"}
    engine.release(spark)


def test_each_content_is_read_and_compared_once(spark, repo, tmp_path):
    changes = R.changed_objects(spark, repo, R.git_commits(spark, repo)).where("file = 'latin.py'")
    many = changes.crossJoin(spark.range(1000)).select(F.concat("commit_hash", F.col("id").cast("string")).alias("commit_hash"), "file", "old_blob", "new_blob")
    assert R.contents(spark, repo, many.select(F.col("new_blob").alias("blob"))).count() == 1
    found = many.select(F.col("new_blob").alias("blob"), "file").distinct().withColumns({"line": F.lit(2), "value": F.lit("v")})
    assert R.in_added_lines(many, R.added_ranges(spark, repo, many), found).count() == 1000
