"""Streams: new files are scanned as they come, exposure is kept up to date, clients' rates are counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..sources import files as S
from ..sources.workers import reach


def new_files(spark: SparkSession, folder: str, glob: str | None = None, per_batch: int = 1000) -> DataFrame:
    """path, content of files as they appear below folder."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    if glob:
        read = read.option("pathGlobFilter", glob)
    return S.texts(read.load(folder))


def scan_stream(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], at: str, checkpoint: str, once: bool = True):
    """Runs scan on every batch of (path, content) and writes its findings as Parquet below at, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so no finding is there twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{at}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rates(events: DataFrame, who: str, when: str, length: str = "60 seconds", most: int = 20, late: str = "10 minutes") -> DataFrame:
    """Clients with more than `most` events in a window; late events count until the watermark passes."""
    x = events.withWatermark(when, late) if events.isStreaming else events
    counted = x.groupBy(F.window(when, length).alias("w"), F.col(who).alias("client")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "client", "n")


EXPOSED = "credential_key string, first_seen timestamp, last_seen timestamp, n long"


class Exposure(StatefulProcessor):
    """First and last time and count of a key. A key that hasn't come for `keep` of event time is forgotten, so state doesn't grow for ever."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_us long, last_us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.seen.get() if self.seen.exists() else (None, None, 0)
        for x in rows:
            us = lambda c: x[c].astype("datetime64[us]").astype("int64")
            low, high = int(us("first_seen").min()), int(us("last_seen").max())
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + int(x["n"].sum())
        self.seen.update((first, last, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.keep_ms)
        stamp = lambda t: pd.Series([t], dtype="datetime64[us]")
        yield pd.DataFrame({"credential_key": [key[0]], "first_seen": stamp(first), "last_seen": stamp(last), "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())


def partial_exposure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a task's rows by key, so that a key with a third of all rows is few rows where keys meet."""
    for x in batches:
        yield x.groupby("credential_key", as_index=False, dropna=False).agg(first_seen=("at", "min"), last_seen=("at", "max"), n=("at", "size"))


def exposure_stream(findings: DataFrame, when: str = "ts", late: str = "1 day", keep: str = "30 days") -> DataFrame:
    """credential_key, first_seen, last_seen, n: of all rows, or, of a stream, in update mode for the keys of a batch.

    A stream's state is kept in RocksDB (set here) and survives restarts from the checkpoint; a key is forgotten when the watermark (late
    behind the newest event) has passed its last event by keep, and counts from one if it comes again. Rows without a time are left out.
    """
    if not findings.isStreaming:
        return findings.groupBy("credential_key").agg(F.min(when).alias("first_seen"), F.max(when).alias("last_seen"), F.count("*").alias("n"))
    spark = reach(findings.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    parts = findings.where(F.col(when).isNotNull()).select("credential_key", F.col(when).cast("timestamp").alias("at")).mapInPandas(partial_exposure, EXPOSED)
    keyed = parts.withWatermark("last_seen", late).groupBy("credential_key")
    return keyed.transformWithStateInPandas(Exposure(keep_ms), EXPOSED, "Update", "EventTime")


def first_seen(findings: DataFrame, when: str = "ts", late: str = "7 days") -> DataFrame:
    """Each credential once within the watermark."""
    return findings.withWatermark(when, late).dropDuplicatesWithinWatermark(["credential_key"]) if findings.isStreaming else findings.dropDuplicates(["credential_key"])


def masked_stream(findings: DataFrame) -> DataFrame:
    return findings.withColumn("value", X.mask(F.col("value")))
