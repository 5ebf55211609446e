"""Scans of a folder that read only what has changed since the last one.

State lies below one folder of shared storage, one numbered folder a run:
`looked/run=N` what run N read, with digests; `findings/run=N` what it found in the files whose content was new; `manifest/run=N` one row a
file: path, length, modified, digest, run (whose findings are the file's), listed, key. A manifest is written last, and only complete ones count, so a
run that is lost on its way changes nothing and is done again under the same number. Older findings are never rewritten until `compact`.

A file is read if its length or time differs from the manifest's, or if it was changed so shortly before the last listing (margin) that a later change may
bear the same time. It is scanned if its SHA-256 differs, too. Files that are gone lose their findings. Findings depend on a file's name as well (route,
technology, context), so a moved file is scanned again. Findings of another key (the settings and a text of the caller's) aren't reused; code of
parsers and analyzers counts by name only, so a change of it needs another text.

Files are listed and read by tasks (see sources.tree). One run at a time.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import engine
from ..sources import files as S
from ..sources import tree

MANIFEST = "path string, length long, modified timestamp, digest string, run long, listed timestamp, key string"
INSIDE = "(?i)^(.*?\\.(?:zip|jar|war|ear|apk|ipa|tar|tgz|tbz2|txz|gz|bz2|xz|sqlite3?|db))!"


def compared(listed: DataFrame, manifest: DataFrame, margin: str = "2 seconds") -> DataFrame:
    """path, length, modified, digest, run, state: added, same, doubtful (to be read) or deleted. digest and run are the manifest's."""
    old = manifest.select("path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), "digest", "run", F.col("listed").alias("old_listed"))
    same = (F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified"))
    settled = F.col("old_listed").isNull() | (F.col("modified") < F.col("old_listed") - F.expr(f"interval {margin}"))
    state = F.when(F.col("length").isNull(), "deleted").when(F.col("old_length").isNull(), "added").when(same & settled, "same").otherwise("doubtful")
    return listed.select("path", "length", "modified").join(old, "path", "full").select("path", "length", "modified", "digest", "run", state.alias("state"))


def settled(compared: DataFrame, digests: DataFrame) -> DataFrame:
    """compared with the digests (path, new_digest) of what was read: doubtful files are touched (equal content) or changed; those not read any more are deleted."""
    x = compared.join(digests.select("path", "new_digest"), "path", "left")
    read = F.when(F.col("new_digest").isNull(), "deleted").when(F.col("state") == "added", "added").when(F.col("new_digest") == F.col("digest"), "touched").otherwise("changed")
    state = F.when(F.col("state").isin("added", "doubtful"), read).otherwise(F.col("state"))
    return x.select("path", "length", "modified", F.coalesce("new_digest", "digest").alias("digest"), "run", state.alias("state"))


def runs(state: str) -> list[int]:
    """Numbers of complete runs."""
    fs, at, _ = tree.place(state)
    found = fs.get_file_info(pafs.FileSelector(f"{at}/manifest", allow_not_found=True))
    done = [x for x in found if x.base_name.startswith("run=") and fs.get_file_info(f"{x.path}/_SUCCESS").type == pafs.FileType.File]
    return sorted(int(x.base_name[4:]) for x in done)


def manifest(spark: SparkSession, state: str) -> DataFrame:
    """The last complete one; empty before the first run."""
    done = runs(state)
    return spark.read.schema(MANIFEST).parquet(f"{state}/manifest/run={done[-1]}") if done else spark.createDataFrame([], MANIFEST)


def key_of(config: engine.ScanConfig, more: str = "") -> str:
    named = lambda given: {k: v if isinstance(v, str) else "" for k, v in given.items()}
    plain = {k: named(v) if k in ("parsers", "analyzers") else v for k, v in asdict(config).items()}
    return hashlib.sha256(json.dumps([plain, more], sort_keys=True, default=str).encode()).hexdigest()


def findings(spark: SparkSession, state: str) -> DataFrame | None:
    """Findings of all files of the last complete manifest (column file: where path is inside an archive, the archive); None if no run has found files to scan."""
    now = manifest(spark, state)
    fs, at, _ = tree.place(state)
    used = sorted(r.run for r in now.select("run").distinct().collect())  # at most one row a run
    folders = [f"{state}/findings/run={n}" for n in used if fs.get_file_info(f"{at}/findings/run={n}").type == pafs.FileType.Directory]
    if not folders:
        return None
    found = spark.read.option("basePath", f"{state}/findings").parquet(*folders)
    return found.join(now.select(F.col("path").alias("file"), "run"), ["file", "run"], "left_semi").drop("run")


def update(spark: SparkSession, at: str | list[str], state: str, config: engine.ScanConfig | None = None, exclusions: dict | None = None, more_key: str = "", margin: str = "2 seconds") -> dict[str, int]:
    """One run; returns how many files are added, same, touched, changed, deleted. `findings` gives the result.

    exclusions are applied where files are scanned: name another more_key when they change, else earlier findings stay as they are.
    """
    config = config or engine.ScanConfig()
    key, done = key_of(config, more_key), runs(state)
    number = done[-1] + 1 if done else 1
    began = dt.datetime.now(dt.timezone.utc)
    old = manifest(spark, state)
    listed = tree.listing(spark, at, config.exclude).where(S.admitted(F.col("path"), config.include, config.exclude))
    states = compared(listed, old.where(F.col("key") == key), margin)

    # Files are listed once: what has to be read is written before it is read.
    states.write.mode("overwrite").parquet(f"{state}/states/run={number}")
    states = spark.read.parquet(f"{state}/states/run={number}")
    look = states.where(F.col("state").isin("added", "doubtful"))
    size = tree.total(look)
    digests = tree.contents(look.select("path"), size).select("path", F.sha2("content", 256).alias("new_digest"))
    settled(states, digests).write.mode("overwrite").parquet(f"{state}/looked/run={number}")
    told = spark.read.parquet(f"{state}/looked/run={number}")

    fresh = told.where(F.col("state").isin("added", "changed"))
    packed = F.coalesce(S.route(F.col("path")) == "binary", F.lit(False))
    parts = []
    for kind, test in (("plain", ~packed), ("packed", packed)):
        n, size = fresh.where(test).agg(F.count("*"), F.sum("length")).first()
        if n:
            got = tree.contents(fresh.where(test).select("path"), size)
            parts.append(engine.scan(spark, S.texts(got), config, exclusions) if kind == "plain" else engine.scan_binary(spark, got, config, exclusions))
    if parts:
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        own = fresh.select("path", F.lit(True).alias("__own"))
        file = F.when(F.col("__own"), F.col("path")).otherwise(F.regexp_extract("path", INSIDE, 1))
        found.join(own, "path", "left").withColumn("file", file).drop("__own").write.mode("overwrite").parquet(f"{state}/findings/run={number}")
        engine.release(spark)

    run = F.when(F.col("state").isin("added", "changed"), F.lit(number)).otherwise(F.col("run")).cast("long")
    left = told.where("state <> 'deleted'").select("path", "length", "modified", "digest", run.alias("run"), F.lit(began).alias("listed"), F.lit(key).alias("key"))
    left.write.mode("overwrite").parquet(f"{state}/manifest/run={number}")
    counted = {r.state: r.n for r in told.groupBy("state").agg(F.count("*").alias("n")).collect()}
    return {k: counted.get(k, 0) for k in ("added", "same", "touched", "changed", "deleted")}


def compact(spark: SparkSession, state: str) -> None:
    """Writes the current findings as one run's and removes the state of earlier runs."""
    done, now, found = runs(state), manifest(spark, state), findings(spark, state)
    if not done:
        return
    number = done[-1] + 1
    if found is not None:
        found.write.mode("overwrite").parquet(f"{state}/findings/run={number}")
    now.withColumn("run", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state}/manifest/run={number}")
    fs, at, _ = tree.place(state)
    for part in ("states", "looked", "findings", "manifest"):
        for x in fs.get_file_info(pafs.FileSelector(f"{at}/{part}", allow_not_found=True)):
            if x.type == pafs.FileType.Directory and x.base_name.startswith("run=") and int(x.base_name[4:]) < number:
                fs.delete_dir(x.path)
