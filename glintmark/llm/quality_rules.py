"""Quality rules: base statistics, then a length-normalised log-likelihood ratio of hashed n-grams.

Features are words and pairs of neighbouring words, hashed to BUCKETS places each. Two multinomials over the
places are estimated: the trusted target's from every row whose id is labelled good, and the raw corpus' from every row. Each place's log ratio is rounded to thousandths
and summed over a document's n-grams as whole numbers, so the verdict is the same on every run and engine:
kept if the mean reaches THRESHOLD thousandths and no base rule fails.

All of it is DataFrame expressions: no Python runs on the executors. Word windows found twice are found by sorting
(hash, place) pairs inside the row, so a long document costs n log n and nothing is exploded or shuffled for it. The
place counts are summed in each task before the shuffle, one row a place. Labels grow with the corpus, so they join the rows by a
shuffle; rows without an id take no part in it under one key, and a hot id is split by the adaptive skew join.

Null texts have no words. Documents under 50 words fail the base rule, so empty ones are never kept. Without labelled
good rows every ratio is zero and only the base rules decide. Rows that repeat, or have a null id, are judged like others
(a repeated labelled id counts each of its rows). Further columns are kept by `judge` and by `keep_good`; those of `judge` take
the place of columns with their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 8192
#: Pseudo-counts of every place in both multinomials.
SMOOTH = 5
#: Thousandths of the natural logarithm, a mean over a document's n-grams.
THRESHOLD = -70
MIN_WORDS, REPEATED_SHARE, WINDOW = 50, 50, 3
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def places(w: Column) -> Column:
    """Places of all words, then of all pairs, of an array of words."""
    low = F.lit(BUCKETS - 1).cast("long")  # BUCKETS is a power of two
    one = lambda h: F.transform(h, lambda x: x.bitwiseAND(low).cast("int"))
    n = lambda h: F.greatest(F.size(h) - 1, F.lit(0))
    two = lambda h: F.zip_with(F.slice(h, 1, n(h)), F.slice(h, 2, n(h)), lambda x, y: ((x * 31 + y).bitwiseAND(low) + BUCKETS).cast("int"))
    return shared.let(F.transform(w, lambda x: F.hash(x).cast("long")), lambda h: F.concat(one(h), two(h)))


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that are found more than once."""
    keyed = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]).alias("h"), i.alias("i")),
    )
    twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])))
    at = shared.let(F.sort_array(keyed), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    covered = shared.let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)


def statistics(text: Column, w: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return [
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        shared.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    ]


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[int]:
    """Thousandths of the log ratio of every place; 2 * BUCKETS numbers."""
    named = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(label_col).alias("y"))
    good = named.groupBy("id").agg(F.max("y").alias("y")).where("y = 1").select("id", F.lit(1).cast("long").alias("target"))
    alone = F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), alone).alias("id"), F.col(text_col).alias("text"))
    flagged = rows.join(good.hint("merge"), "id", "left").select(F.coalesce("target", F.lit(0).cast("long")).alias("target"), F.explode(shared.let(words(F.col("text")), places)).alias("place"))
    counts = flagged.groupBy("place").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    return ratios({r.place: (r.target, r.raw) for r in counts.collect()})  # 2 * BUCKETS rows at most


def ratios(counts: dict[int, tuple[int, int]]) -> list[int]:
    out = []
    for start in (0, BUCKETS):
        own = [counts.get(k, (0, 0)) for k in range(start, start + BUCKETS)]
        target, raw = (sum(x[k] for x in own) for k in (0, 1))
        if not target:
            out += [0] * BUCKETS
            continue
        log = lambda n, total: math.log(n + SMOOTH) - math.log(total + SMOOTH * BUCKETS)
        out += [math.floor(1000 * (log(t, target) - log(r, raw)) + 0.5) for t, r in own]
    return out


JUDGED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]


def judge(docs: DataFrame, weights: list[int], text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with JUDGED: base statistics, llr (sum, thousandths), base_failed, kept."""
    # A constant: Catalyst folds it into one literal.
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    llr = lambda w: F.aggregate(places(w), F.lit(0).cast("long"), lambda a, p: a + F.get(table, p))
    text = F.col(f"`{text_col}`")
    found = shared.let(words(text), lambda w: F.struct(*statistics(text, w), llr(w).alias("llr")))
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in JUDGED]).alias("row"), found.alias("x")).select("row.*", "x.*") if any(c.lower() not in JUDGED for c in docs.columns) else docs.select(found.alias("x")).select("x.*")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return x.select("*", base.alias("base_failed"), (~base & (F.col("llr") >= threshold * grams)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pipeline form: the rows of docs that are kept."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return judge(plain, log_ratios(docs, labels, id_col, text_col)).where("kept").select("row.*")


def op9_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, log_ratios(docs, shared.table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _mixed(h: str, k: str) -> str:
    """One round of 32-bit Murmur3 in SQL, on unsigned 64-bit numbers."""
    turned = lambda x, n: f"(((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295)"
    part = f"{turned(f'({k} * 3432918353 & 4294967295)', 15)} * 461845907 & 4294967295"
    return f"({turned(f'xor({h}, {part})', 13)} * 5 + 3864292196) & 4294967295"


# The hash that Spark's hash() gives for a string: four bytes at a time, then single signed bytes, seed 42.
HASH_SQL = f"""u AS (SELECT DISTINCT unnest(w) AS t FROM w),
ub AS (SELECT t, strlen(t) AS n, list_transform(range(0, strlen(t)), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT) AS b FROM u),
uk AS (SELECT t, n, list_concat([42::UBIGINT], list_transform(range(0, n // 4), lambda i: (b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216)::UBIGINT),
             list_transform(range(n // 4 * 4, n), lambda i: (CASE WHEN b[i + 1] > 127 THEN b[i + 1] + 4294967040 ELSE b[i + 1] END)::UBIGINT)) AS k FROM ub),
u1 AS (SELECT t, xor(list_reduce(k, lambda h, x: {_mixed('h', 'x')}), n::UBIGINT) AS h FROM uk),
u2 AS (SELECT t, xor(h, h >> 16) * 2246822507 & 4294967295 AS h FROM u1),
u3 AS (SELECT t, xor(h, h >> 13) * 3266489909 & 4294967295 AS h FROM u2),
u4 AS (SELECT t, xor(h, h >> 16)::BIGINT AS h FROM u3),
hashed AS (SELECT t, CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END AS h FROM u4)"""


OP9_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             row_number() OVER () AS rid FROM documents),
{HASH_SQL},
hs AS (SELECT rid, list(h ORDER BY k) AS h FROM (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS k FROM w) JOIN hashed USING (t) GROUP BY rid),
h AS (SELECT rid, doc_id, text, w, coalesce(h, []) AS h FROM w LEFT JOIN hs USING (rid)),
g AS (SELECT *, list_concat(list_transform(h, lambda x: x & {BUCKETS - 1}),
             list_transform(range(1, greatest(len(h), 1)), lambda i: (h[i] * 31 + h[i + 1] & {BUCKETS - 1}) + {BUCKETS})) AS g FROM h),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING max(quality) = 1),
e AS (SELECT rid, doc_id, unnest(g) AS p FROM g),
c AS (SELECT p, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (FROM good)) AS target FROM e GROUP BY p),
s AS (SELECT p >= {BUCKETS} AS pair, sum(raw) AS raws, sum(target) AS targets FROM c GROUP BY 1),
r AS (SELECT p, CASE WHEN targets = 0 THEN 0 ELSE floor(1000 * ((ln(target + {SMOOTH}) - ln(targets + {SMOOTH} * {BUCKETS})) - (ln(raw + {SMOOTH}) - ln(raws + {SMOOTH} * {BUCKETS}))) + 0.5) END AS x
      FROM c JOIN s ON s.pair = (c.p >= {BUCKETS})),
l AS (SELECT rid, sum(x)::BIGINT AS llr FROM e JOIN r USING (p) GROUP BY rid),
t AS (SELECT rid, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS t FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS k FROM w)),
d AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, t) AS n FROM t) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT k + o) AS n FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
b AS (SELECT w.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines,
             coalesce(cover.n, 0) AS n_repeat_words, coalesce(llr, 0) AS llr
      FROM w LEFT JOIN ln USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_SHARE} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND llr >= {THRESHOLD} * greatest(2 * n_words - 1, 1) AS kept FROM f
"""
