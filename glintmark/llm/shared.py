"""Helpers that several training-data operators use: shared folders, file access, task buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workers import reach

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and Spark is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="glintmark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's place below the shared one; it goes when the session's JVM ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def publish(uri: str, write) -> None:
    """write(stream) to a temporary name, then rename to uri: a lost or repeated task leaves no partial file there."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        write(out)
    fs.move(temporary, path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, whatever the optimizer does with projections."""
    return F.transform(F.array(value), body)[0]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without making Python strings."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def views(column: pa.Array) -> Iterator[memoryview]:
    """UTF-8 of each text where it lies in memory, without a copy; null texts are empty."""
    for x in column:
        yield memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


def with_columns(df: DataFrame, text_col: str, more: str, found, size: int, drop: list[str] | tuple[str, ...] = (), where: Column | None = None, also: tuple[Column, ...] = ()) -> DataFrame:
    """df without drop and with the columns of the schema more, which found gives as arrays for a batch's texts.

    The new columns take the place of columns of the same names, whatever the letters' case, as withColumns does. With
    where (a condition on the new columns) df's own columns come back instead, in the rows where it holds. found gets the
    columns of also behind the texts.
    """
    names = [x.split()[0] for x in more.split(", ")]
    gone = {x.lower() for x in (*(names if where is None else ()), *drop)}
    kept = [c for c in df.columns if c.lower() not in gone]
    columns = [f"c{k}" for k in range(len(kept))]
    own = [F.col(f"`{c}`").alias(k) for c, k in zip(kept, columns)]
    at, extra = kept.index(text_col) if text_col in kept else len(kept), len(also)
    plain = df.select(*own, *([] if at < len(kept) else [F.col(f"`{text_col}`").alias("text")]), *(x.alias(f"a{k}") for k, x in enumerate(also)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, size):
            if b.num_rows:
                yield pa.record_batch([*b.columns[: len(columns)], *found(b.column(at), *b.columns[b.num_columns - extra :])], names=[*columns, *names])

    schema = ", ".join([*(f"{c} {plain.schema[c].dataType.simpleString()}" for c in columns), more])
    out = plain.mapInArrow(run, schema)
    return out.toDF(*kept, *names) if where is None else out.where(where).select(*columns).toDF(*kept)


def cut(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about size bytes at most (one row at least), so that a task's lists stay small."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, int(rows * size / max(1, batch.nbytes))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
