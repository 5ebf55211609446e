"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors.

Terms of a text are its four-byte runs (letters folded), hashed to DIMENSIONS places: words, parts of words and what is
between them; four-character runs of character kinds (letter case, digits, spaces, single symbols), hashed to as many; and a
few terms for repeated and distinct words. Square roots of the terms' shares times inverse document frequency are projected
on the leading RANK singular directions of the labelled sample, and normalised.

Labelled rows: of each label the PER_LABEL rows (a documented bound) with the smallest hash of their id, out of those
that `learn` admits; labels of rows that repeat an id count as their largest, of its texts the smallest is taken. Their vectors
are broadcast (at most 2 * PER_LABEL * RANK floats). Every document's cosines with all of them are computed in blocks, the
NEAREST vote with weight cosine ** SHARPNESS, and each label's votes are scaled to its share of all admitted rows. Cosines are
compared in steps of 2 ** -20, and of equal ones the vector whose terms come first counts as nearer.

The text alone decides a score. Null texts count as empty. A text without terms gets label 1's share among admitted
rows, as does every text where no labelled rows are admitted (one half where there are no labels at all).
Rows that repeat, or whose doc_id is null, are scored like others. Further columns are kept by `score`, a column named score
is replaced.
"""

from __future__ import annotations

import math
import operator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DIMENSIONS, RANK = 1024, 48
PER_LABEL = 2048
NEAREST, SHARPNESS = 25, 8
THRESHOLD = 0.3
#: Documents whose cosines are computed at once.
ROWS = 512

#: Kinds of bytes: 0 is left out (continuation bytes), 1 lower case and non-ASCII letters, 2 upper case, 3 digits, 4 space,
#: 5 line feed, then single symbols.
KINDS = np.full(256, 15, np.uint8)
KINDS[0x80:0xC0] = 0
KINDS[0xC0:] = 1
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[[32, 9, 13]], KINDS[10] = 1, 2, 3, 4, 5
for _k, _c in enumerate((b".,;:", b"!?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>")):
    KINDS[list(_c)] = 6 + _k
EXTRA = 10
TERMS = 2 * DIMENSIONS + EXTRA
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _hashed(runs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed runs."""
    places = (runs * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(DIMENSIONS)))
    return np.sqrt(np.bincount(places, minlength=DIMENSIONS) / len(runs))


def terms(text: bytes | None) -> np.ndarray:
    """Square roots of the terms' shares; zero for a text without words."""
    out = np.zeros(TERMS, np.float32)
    words = (text or b"").split()
    if not words:
        return out
    raw = np.frombuffer(text if len(text) >= 4 else text.ljust(4), np.uint8)
    low = LOWER[raw].astype(np.uint32)
    out[:DIMENSIONS] = _hashed(low[:-3] << 24 | low[1:-2] << 16 | low[2:-1] << 8 | low[3:])
    kinds = KINDS[raw]
    kinds = kinds[kinds > 0].astype(np.uint32)
    if len(kinds) < 4:
        kinds = np.concatenate([kinds, np.full(4 - len(kinds), 4, np.uint32)])
    out[DIMENSIONS : 2 * DIMENSIONS] = _hashed(kinds[:-3] << 12 | kinds[1:-2] << 8 | kinds[2:-1] << 4 | kinds[3:])
    # Words equal to the one before them; distinct words against what a text of this length has, in steps.
    repeated = sum(map(operator.eq, words, islice(words, 1, None))) / len(words)
    out[2 * DIMENSIONS] = math.sqrt(repeated)
    variety = math.log(len(set(words)) + 1) / math.log(len(words) + 1)
    out[2 * DIMENSIONS + 1 + min(8, int(variety * 9))] = 0.5
    return out


def directions(rows: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The leading right singular directions of rows, as columns, by subspace iteration from a fixed beginning."""
    q = np.random.default_rng(7).standard_normal((rows.shape[1], min(rank + 16, *rows.shape)))
    rows = rows.astype(np.float64)
    for _ in range(rounds):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, turn = np.linalg.svd(rows @ q, full_matrices=False)
    return (q @ turn.T)[:, :rank]


class Model:
    """Projection, labelled vectors and label weights; `score` takes a list of texts."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, totals: tuple[int, int]) -> None:
        self.prior = totals[1] / sum(totals) if sum(totals) else 0.5
        self.labels = labels
        if not len(rows):
            return
        present = (rows > 0).sum(0)
        self.idf = np.log((1 + len(rows)) / (1 + present)).astype(np.float32) + 0.1
        weighted = rows * self.idf
        self.directions = np.ascontiguousarray(directions(weighted, RANK) * self.idf[:, None])
        self.vectors = self._project(rows)
        seen = np.bincount(labels, minlength=2)
        self.weights = np.array([totals[y] / max(1, seen[y]) for y in (0, 1)], np.float32)[labels]

    def _project(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64) @ self.directions  # sums don't depend on the other rows by as much as a step
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norms > 0, norms, 1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the NEAREST vectors of each row, and their cosines; the same ones whatever rows are beside it."""
        steps = np.rint(self._project(rows) @ self.vectors.T * 2**20).astype(np.int64)
        n, k = len(self.labels), min(NEAREST, len(self.labels))
        order = steps * n + np.arange(n - 1, -1, -1)
        near = np.argpartition(order, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), steps.shape)
        near = np.sort(near, axis=1)
        return near, np.take_along_axis(steps, near, 1) / 2**20

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), ROWS):
            rows = np.stack([terms(t) for t in texts[at : at + ROWS]])
            near, cosines = self.nearest(rows)
            votes = np.clip(cosines, 0, 1) ** SHARPNESS * self.weights[near]
            total = votes.sum(1)
            good = (votes * self.labels[near]).sum(1)
            known = rows.any(1) & (total > 0)
            out[at : at + ROWS][known] = good[known] / total[known]
        return np.clip(out, 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    admitted = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r.y: r.n for r in admitted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = [admitted.where(F.col("y") == y).orderBy(order, id_col).limit(per_label) for y in (0, 1)]
    # At most 2 * per_label ids: a bound that doesn't grow with the tables.
    named = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), id_col)
    sample = named.groupBy(id_col, "y").agg(F.min("text").alias("text")).select("y", "text")
    found = lambda texts: [pa.array([terms(t).tobytes() for t in shared.as_bytes(texts)], pa.binary())]
    rows = sorted((bytes(r.terms), r.y) for r in shared.with_columns(sample, "text", "terms binary", found, 16 << 20, drop=["text"]).collect())
    x = np.array([np.frombuffer(t, np.float32) for t, _ in rows], np.float32).reshape(len(rows), TERMS)
    return Model(x, np.array([y for _, y in rows], np.int64), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with one more column, score; with least, docs as they are, without the rows whose score is below it."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    found = lambda texts: [pa.array(shipped.value.score(shared.as_bytes(texts)), pa.float64())]
    return shared.with_columns(docs, text_col, "score double", found, 16 << 20, where=None if least is None else F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pipeline form: docs whose score reaches the threshold."""
    return score(docs, fit(docs, labels, id_col, text_col), text_col, threshold)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, shared.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
