"""Files below folders: every one, whatever its name, listed and read by tasks.

Spark's own file sources leave out names that begin with `.` or `_` (`.env`, `.github/`), in which credentials are kept, and read a file's bytes
before a filter on its name. Here folders are listed by tasks (the driver lists only the uppermost, until there are enough to deal out), names are
filtered, and what is left is read by path, file by file, so a task's memory depends on its largest file.

Links to folders aren't followed. Empty files are rows. A folder or file that can't be read fails the job; one that has gone meanwhile gives no row.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workers import reach

#: Bytes of files for one task, and of contents in one batch; folders that the driver wants before it deals them out.
SHARE, BATCH, ENOUGH = 128 << 20, 16 << 20, 256
NAME = re.compile(r"([A-Za-z][\w+.-]*):(//[^/]*)?(/.*)?", re.S)


def full_name(spark: SparkSession, at: str) -> str:
    """With its scheme; a plain path is one of the session's default file system."""
    if NAME.fullmatch(at):
        return at.rstrip("/")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return "file:" + os.path.abspath(at) if default.startswith("file:") else default.rstrip("/") + "/" + at.strip("/")


def place(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system of a name, the name in it, and what goes before that to give the name again. Names aren't escaped."""
    m = NAME.fullmatch(path)
    if not m or m[1] == "file":
        return pafs.LocalFileSystem(), (m[3] or "/") if m else path, "file:" if m else ""
    fs, base = pafs.FileSystem.from_uri(f"{'s3' if m[1] in ('s3a', 's3n') else m[1]}:{m[2] or '//'}/")
    base = base.rstrip("/")
    return fs, base + (m[3] or "/"), f"{m[1]}:{(m[2] or '//')[: None if not base else 2]}"


def one_folder(folder: str, exclude: list[str]) -> tuple[list[tuple], list[str]]:
    """Files (path, length, modified) and folders of a folder; of a file, itself."""
    fs, name, front = place(folder)
    files, folders = [], []
    found = fs.get_file_info(name)
    listed = fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)) if found.type == pafs.FileType.Directory else [found]
    for x in listed:
        path = front + x.path
        if any(e in path for e in exclude):
            continue
        if x.type == pafs.FileType.File:
            files.append((path, x.size, x.mtime))
        elif x.type == pafs.FileType.Directory and not (front == "file:" and os.path.islink(x.path)):
            folders.append(path)
    return files, folders


def listing(spark: SparkSession, at: str | list[str], exclude: list[str] | None = None) -> DataFrame:
    """path, length, modified of all files below at; folders whose path holds a string of exclude aren't entered."""
    exclude = exclude or []
    level = [full_name(spark, x) for x in ([at] if isinstance(at, str) else at)]
    for root in level:
        fs, name, _ = place(root)
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            raise FileNotFoundError(root)
    # Uppermost folders are named to tasks one by one (deep: False), those below them whole.
    dealt: list[tuple[str, bool]] = []
    while level and len(dealt) + len(level) < ENOUGH:
        dealt += [(x, False) for x in level]
        level = [sub for x in level for sub in one_folder(x, exclude)[1]]
    dealt += [(x, True) for x in level]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for top, deep in zip(pdf["folder"], pdf["deep"]):
                todo = [top]
                while todo:
                    files, folders = one_folder(todo.pop(), exclude)
                    if deep:
                        todo += folders
                    for k in range(0, len(files), 10_000):
                        part = pd.DataFrame(files[k : k + 10_000], columns=["path", "length", "modified"])
                        yield part.assign(modified=pd.to_datetime(part["modified"], utc=True).astype("datetime64[us, UTC]"))

    reach(spark)
    folders = spark.createDataFrame(list(dict.fromkeys(dealt)), "folder string, deep boolean").repartition(min(len(dealt), ENOUGH))
    return folders.mapInPandas(run, "path string, length long, modified timestamp")


def contents(names: DataFrame, size: int) -> DataFrame:
    """names (with path) and the files' content (bytes), read by tasks of about SHARE of the size given."""
    kept = [c for c in names.columns if c != "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, read, room = [], [], BATCH
            for k, path in enumerate(pdf["path"]):
                fs, name, _ = place(path)
                try:
                    with fs.open_input_stream(name, compression=None) as f:
                        read.append(f.read())
                except FileNotFoundError:
                    continue
                rows.append(k)
                room -= len(read[-1])
                if room < 0:
                    yield pdf[kept].iloc[rows].assign(content=read)
                    rows, read, room = [], [], BATCH
            if rows:
                yield pdf[kept].iloc[rows].assign(content=read)

    reach(names.sparkSession)
    schema = names.select(*kept).schema.add("content", "binary")
    return names.select(*kept).repartition(max(1, math.ceil(size / SHARE)), "path").mapInPandas(run, schema)


def total(names: DataFrame) -> int:
    return names.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
