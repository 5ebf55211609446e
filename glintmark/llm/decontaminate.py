"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of consecutive words; an item of fewer words is one window. The alphabet is
words: a block is BLOCK consecutive words, a shift table says how far a block's position can be skipped, patterns with
a shift of zero are found through the hash of their last block (suffix) and of their first (prefix), then compared word by
word. Patterns of different lengths have a table each, so short items don't shorten the skips of the long ones.

The windows are a stated set that runs against all rows. They are written to the shared folder in files of at most
CHUNK windows, and tasks load one file at a time, so neither the driver nor a task ever holds an unbounded set. A task keeps
CACHED files loaded; where there are more, each is loaded once for HELD bytes of texts, which takes less time than their search.

Null texts have no words. Empty benchmarks hit nothing. Repeated items (equal ids) count once, repeated windows of one
item once; ids are compared as strings. Windows of items with a null id hit like any other, but add no id to `items`, as
nothing could name them: in the query and in `clean` always, in `scan` where `unnamed` is set. Rows that repeat are kept
as rows. Further columns are kept by `scan` and by `clean`; scan's `found` takes the place of a column of that name.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW = 10
#: Words of a block.
BLOCK = 2
#: Most windows that a task holds at once.
CHUNK = 200_000
#: Files of windows that a task's process keeps; bytes of texts that wait while the files pass by.
CACHED, HELD = 2, 32 << 20
#: A-Z to a-z; what can't be in a word to a space; digits, a-z and every byte of a non-ASCII character as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class WuManber:
    """Search for word sequences that all have the same length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                at = words[end - self.block : end]
                self.shift[at] = min(self.shift.get(at, self.far), length - end)
            self.buckets.setdefault(words[length - self.block :], {}).setdefault(words[: self.block], []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word's place, items) of every occurrence."""
        get, far, block, length, n = self.shift.get, self.far, self.block, self.length, len(words)
        end = length
        if block == 2:
            while end <= n:
                step = get((words[end - 2], words[end - 1]), far)
                if step:
                    end += step
                    continue
                yield from self._confirm(words, end)
                end += 1
        else:
            while end <= n:
                step = get(tuple(words[end - block : end]), far)
                if step:
                    end += step
                    continue
                yield from self._confirm(words, end)
                end += 1

    def _confirm(self, words: list[bytes], end: int) -> Iterator[tuple[int, list[str]]]:
        seen = tuple(words[end - self.length : end])
        for pattern, items in self.buckets[seen[self.length - self.block :]].get(seen[: self.block], ()):
            if pattern == seen:
                yield end - self.length, items


def windows_of(words: list[bytes], window: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))}


def write_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, at: str, chunk: int, unnamed: bool = False) -> DataFrame:
    """Tables of patterns as files below at; returns their places. unnamed: items with a null id have windows, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, ...], set[str]] = {}
        files = []

        def flush() -> None:
            if held:
                by_length: dict[int, dict] = {}
                for words, items in held.items():
                    by_length.setdefault(len(words), {})[words] = sorted(items)
                body = pickle.dumps([WuManber(p, n) for n, p in sorted(by_length.items())])
                uri = f"{at}/{hashlib.sha256(body).hexdigest()[:32]}.tables"
                shared.publish(uri, lambda out: out.write(body))
                files.append(uri)
                held.clear()

        for b in shared.cut(batches):
            for item, text in zip(b.column(0).to_pylist(), shared.as_bytes(b.column(1))):
                for w in windows_of(words_of(text), window):
                    held.setdefault(w, set()).update(() if item is None else (item,))
                    if len(held) >= chunk:
                        flush()
        flush()
        yield pa.record_batch([pa.array(files, pa.string())], names=["file"])

    items = (benchmark if unnamed else benchmark.where(F.col(id_col).isNotNull())).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(run, "file string")


@lru_cache(maxsize=CACHED)
def load_tables(uri: str) -> list[WuManber]:
    fs, path = shared.filesystem(uri)
    with fs.open_input_stream(path) as f:
        return pickle.loads(f.read())


def examine(texts: list[bytes | None], files: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: words, the covered runs of words as [first, end), item ids sorted as strings."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    sizes = [0] * len(texts)
    for uri in files or [None]:
        tables = load_tables(uri) if uri else []
        for k, text in enumerate(texts):
            words = words_of(text)  # again for each file: no batch's words are held
            sizes[k] = len(words)
            for t in tables:
                for at, found in t.search(words):
                    spans[k].append((at, at + t.length))
                    items[k].update(found)
    out = []
    for n, runs, ids in zip(sizes, spans, items):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out.append((n, merged, sorted(ids)))
    return out


FOUND = "found struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:int,end:int>>>"
KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text: str = "text", window: int = WINDOW, chunk: int = CHUNK, unnamed: bool = False, clean: bool = False) -> DataFrame:
    """docs with one more column `found`: n_words, n_hit, items (sorted as strings), spans of covered words.

    clean: docs as they are, without the rows that are hit, instead.
    """
    spark = docs.sparkSession
    files = [x.file for x in write_windows(benchmark, id_col, item_text, window, shared.scratch(spark, "decontaminate"), chunk, unnamed).collect()]
    files = sorted(set(files))  # names only: one for each CHUNK windows of the stated set

    def found(texts: pa.Array) -> list[pa.Array]:
        rows = [
            {"n_words": n, "n_hit": sum(e - a for a, e in runs), "items": ids, "spans": [{"first": a, "end": e} for a, e in runs]}
            for n, runs, ids in examine(shared.as_bytes(texts), files)
        ]
        return [pa.array(rows, KIND)]

    return shared.with_columns(docs, text_col, FOUND, found, HELD, where=F.col("found.n_hit") == 0 if clean else None)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Pipeline form: docs without the rows in which a benchmark window occurs."""
    return scan(docs, benchmark, **{"unnamed": True, "clean": True, **options})


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, shared.table(spark, sf_dir, "benchmark"), unnamed=True).select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS t FROM (
  SELECT item, w[k : k + {WINDOW - 1}] AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS k FROM b WHERE len(w) > 0))),
dw AS (SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS t FROM (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, k, n, item FROM dw JOIN bw USING (n, t)),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)
"""
