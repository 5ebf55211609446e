"""SQLite files as a source of items, split by ranges of rows.

`read` lists the telling tables of each database and cuts tables with row numbers into ranges of them, no more than the file has shares of `SHARE` bytes; a task opens
the file where it is and reads one range through the table's tree. Ranges are equally wide, so far-off row numbers make
them uneven; a task streams its rows. Tables without row numbers are one range. Files that tasks don't see as local (or mounted)
paths can't be opened by SQLite: such a one is copied to a file of the task's own and read by one task, on disk, not in memory.

What a range doesn't give is a row of type `failed` with the reason as value, after what came before the damage; other ranges and tables come.
Files are opened as unchanging: a database that is written meanwhile should be copied before. Its write-ahead log isn't read.
"""

from __future__ import annotations

import math
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing, contextmanager
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree
from .parsers import NAMES

SHARE = 64 << 20
RANGES = "path string, table string, low long, high long, problem string"
ROWS = "path string, key string, value string, row long, type string"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    fs, name, _ = tree.place(path)
    with tempfile.NamedTemporaryFile(suffix=".db") as copy:  # a task's own, gone with it
        if not isinstance(fs, pafs.LocalFileSystem):
            with fs.open_input_stream(name, compression=None) as source:
                shutil.copyfileobj(source, copy, 1 << 20)
            copy.flush()
            name = copy.name
        with closing(sqlite3.connect(f"file:{quote(name)}?mode=ro&immutable=1", uri=True)) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            yield db


def numbered(db: sqlite3.Connection, table: str) -> bool:
    """Whether rowid is the table's row number: there is one, and no column of that name."""
    kind = {x[1]: x[4] for x in db.execute("pragma table_list") if x[0] == "main"}
    return not kind.get(table) and all(x[1].lower() != "rowid" for x in db.execute(f"pragma table_info({quoted(table)})"))


def range_rows(path: str, size: int, share: int) -> Iterator[tuple]:
    """Ranges (low <= row number < high; both null: all, no table: all of them) of a database; a problem where there are none."""
    fs, _, _ = tree.place(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        yield path, None, None, None, None
        return
    try:
        with opened(path) as db:
            for table in telling(db):
                try:
                    # Each by itself is a walk down the tree; both in one aggregate would be a scan.
                    ends = f"select (select min(rowid) from {quoted(table)}), (select max(rowid) from {quoted(table)})"
                    low, high = db.execute(ends).fetchone() if numbered(db, table) else (None, None)
                except sqlite3.Error:
                    low = high = None  # the scan itself tells what is damaged
                if low is None:
                    yield path, table, None, None, None
                    continue
                n = max(1, min(math.ceil(size / share), high - low + 1))
                edges = [low + (high - low + 1) * k // n for k in range(n)]
                # The outermost ranges are open, so the greatest row number needs no successor.
                yield from ((path, table, None if k == 0 else e, edges[k + 1] if k + 1 < n else None, None) for k, e in enumerate(edges))
    except sqlite3.Error as e:
        yield path, None, None, None, str(e)


def telling(db: sqlite3.Connection) -> list[str]:
    return [t for (t,) in db.execute("select name from sqlite_master where type = 'table' order by name").fetchall() if NAMES.search(t)]


def item_rows(db: sqlite3.Connection, path: str, table: str, low: str | None, high: str | None) -> Iterator[tuple]:
    try:
        known = numbered(db, table)
        tests = [f"rowid {op} {int(x)}" for op, x in ((">=", low), ("<", high)) if x is not None]
        cursor = db.execute(f"select {'rowid' if known else 'null'}, * from {quoted(table)}{' where ' if tests else ''}{' and '.join(tests)}")
        columns = [c[0] for c in cursor.description[1:]]
        for n, (row, *values) in enumerate(cursor, 1):
            yield from ((path, f"{table}.{c}", v, row if known else n, "sqlite") for c, v in zip(columns, values) if isinstance(v, str) and len(v) > 8 and NAMES.search(c))
    except sqlite3.Error as e:
        yield path, table, str(e), None if low is None else int(low), "failed"


def ranges(names: DataFrame, share: int = SHARE) -> DataFrame:
    """RANGES rows of the databases named (path, length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size in zip(pdf["path"], pdf["length"]):
                yield pd.DataFrame(range_rows(path, size, share), columns=["path", "table", "low", "high", "problem"]).astype({"low": "Int64", "high": "Int64"})

    return names.select("path", "length").mapInPandas(run, RANGES)


def items(ranges: DataFrame) -> DataFrame:
    """Strings of over 8 characters in telling columns of ranges: path, key (table.column), value, row (its number, or its place where tables have none), type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "key", "value", "row", "type"]).astype({"row": "Int64"})
        for pdf in batches:
            for path, table, low, high, problem in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in pdf.columns)):
                rows = []
                try:
                    if problem:
                        raise sqlite3.DatabaseError(problem)
                    with opened(path) as db:
                        for name in [table] if table else telling(db):
                            for row in item_rows(db, path, name, low, high):
                                rows.append(row)
                                if len(rows) >= 10_000:
                                    yield frame(rows)
                                    rows = []
                except sqlite3.Error as e:
                    rows.append((path, table, str(e), None, "failed"))
                yield frame(rows)

    # Row numbers go to pandas as text: with nulls they would become floating point numbers, which cut long ones.
    exact = ranges.select("path", "table", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "problem")
    dealt = exact.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 8, "path", "table", "low")
    return dealt.mapInPandas(run, ROWS)


def read(spark: SparkSession, at: str | list[str], exclude: list[str] | None = None, share: int = SHARE) -> DataFrame:
    """Items of the SQLite files (.sqlite, .sqlite3, .db) below at."""
    names = tree.listing(spark, at, exclude).where(F.col("path").rlike("(?i)\\.(sqlite3?|db)$"))
    return items(ranges(names, share))
