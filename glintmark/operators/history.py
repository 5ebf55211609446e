"""Exposure of credentials over commits."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def credential_key(rule_id: Column, file: Column, variable: Column, value: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("None")) for c in (rule_id, file, variable, value)]).cast("binary"))


def window_text(first: Column, last: Column, commits: Column) -> Column:
    """How long and in how many commits, in words. first and last are epoch seconds."""
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    days = F.greatest(F.lit(0), F.floor((last - first) / 86400)).cast("long")
    months = F.concat(F.lit("~"), F.floor(days / 30).cast("string"), F.lit(" months"))
    span = F.when(days >= 60, months).when(days >= 1, plural(days, "day")).otherwise("a single day")
    unknown = (F.coalesce(first, F.lit(0)) == 0) | (F.coalesce(last, F.lit(0)) == 0)
    return F.when(unknown, F.concat(F.lit("seen in "), plural(commits, "commit"))).otherwise(F.concat(F.lit("exposed "), span, F.lit(" across "), plural(commits, "commit")))


def exposure(findings: DataFrame) -> DataFrame:
    """One row a credential from (log_ix, commit_hash, commit_timestamp, original_file, rule_id, variable, value):
    first and last commit by time, number of findings, window in words. Partial sums first, so a key in every commit is no load."""
    x = findings.withColumn("credential_key", credential_key(F.col("rule_id"), F.col("original_file"), F.col("variable"), F.col("value")))
    when = F.struct("commit_timestamp", (-F.col("log_ix")).alias("o"), "commit_hash")
    out = x.groupBy("credential_key", "rule_id", "original_file", "variable", "value").agg(F.min(when).alias("a"), F.max(when).alias("b"), F.count("*").alias("exposure_commit_count"))
    out = out.select(
        "credential_key", "rule_id", "original_file", "variable", "value", F.col("a.commit_hash").alias("first_seen_commit"), F.col("a.commit_timestamp").alias("first_seen_timestamp"),
        F.col("b.commit_hash").alias("last_seen_commit"), F.col("b.commit_timestamp").alias("last_seen_timestamp"), "exposure_commit_count",
    )
    return out.withColumn("exposure_window", window_text(F.col("first_seen_timestamp"), F.col("last_seen_timestamp"), F.col("exposure_commit_count")))


def scan_history(spark, repo: str, detect, root: bool = True, **commits) -> tuple[DataFrame, DataFrame]:
    """Findings of all commits, and the exposure of what was found.

    detect: lines (path, line, text) -> findings. Tasks make the diffs (files.git_diffs); an added file's diff is the whole file, so
    its lines are all there; binary files have none. commits: arguments of files.git_commits (since, until, branch, path, most).
    """
    from ..sources import files as S

    log = S.git_commits(spark, repo, **commits)
    added = S.added_lines(S.git_diffs(spark, repo, log.select("commit_hash"), root))
    # A commit's file is a file of its own to the detectors.
    found = detect(added.select(F.concat_ws("\0", "commit_hash", "file").alias("path"), "line", "text"))
    parts = F.split("path", "\0")
    x = found.withColumns({"commit_hash": parts[0], "original_file": parts[1]}).withColumn("path", F.col("original_file")).join(log, "commit_hash")
    return x, exposure(x)


def with_lines(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found (blob, line, value, ...) where findings in trees, which have no line, get the first one that their value is on."""
    known, open_ones = found.where("line > 0"), found.where("line is null or line < 1")
    at = F.expr("instr(content, value)")
    line = F.when((F.col("value") != "") & (at > 0), F.size(F.split(F.expr("substring(content, 1, instr(content, value))"), "\n"))).otherwise(F.col("line")).cast("int")
    return known.unionByName(open_ones.join(texts, "blob").withColumn("line", line).select(*found.columns))


def scan_repository(spark, repo: str, config=None, exclusions: dict | None = None, root: bool = True, **commits) -> tuple[DataFrame, DataFrame]:
    """Findings of all commits with all detectors, rules and the baseline, and the exposure of what was found.

    Each distinct file content is scanned once under each name it has had, as a whole, so items, contexts and scores see what they would in
    the file; a finding then belongs to the commits that added its line. config: of engine.scan (equal findings aren't merged, as each may have been added by a commit
    of its own). exclusions: as in engine.scan, with the repository's paths. commits: arguments of repository.git_commits.
    """
    from dataclasses import replace

    from ..plans import engine
    from ..sources import files as S
    from ..sources import repository as R
    from . import baseline

    log = R.git_commits(spark, repo, **commits).persist(StorageLevel.MEMORY_AND_DISK)
    changes = R.changed_objects(spark, repo, log, root).persist(StorageLevel.MEMORY_AND_DISK)
    named = changes.select(F.col("new_blob").alias("blob"), "file").distinct()
    texts = R.contents(spark, repo, named.select("blob")).join(named, "blob").persist(StorageLevel.MEMORY_AND_DISK)
    # The name goes on behind the object's id, so that equal names with other contents are other files.
    path = F.concat_ws("/", "blob", "file")
    found = engine.scan(spark, S.texts(texts.select(path.alias("path"), "content")), replace(config or engine.ScanConfig(), deduplicate=False))
    found = found.persist(StorageLevel.MEMORY_AND_DISK)  # few against the texts; the joins below read them several times
    x = found.withColumns({"blob": F.substring_index("path", "/", 1), "file": F.expr("substring(path, instr(path, '/') + 1)")}).drop("path")
    x = with_lines(x, S.texts(texts.select(path.alias("path"), "content")).select(F.substring_index("path", "/", 1).alias("blob"), "content").dropDuplicates(["blob"]))
    x = R.in_added_lines(changes, R.added_ranges(spark, repo, changes), x).withColumnRenamed("file", "path")
    x = baseline.reported(x, **exclusions) if exclusions else x
    x = x.withColumn("original_file", F.col("path")).join(log, "commit_hash")
    return x, exposure(x)
