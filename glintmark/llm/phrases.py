"""Phrase collocation mining by contiguous pattern growth.

Patterns grow to the right from frequent prefixes, over projected occurrences. An occurrence's pointer is a place in a piece of a
text; what it points to, the words from there on, is written out, up to `most` words, behind a sort key of 64 bits that nests: first bits of the first pair's hash, then some of each
further word's. Sorted, the pointers of any prefix lie in one run, those of its extensions in runs inside that run; runs of colliding hashes are one. A task gets a range of the sorted
pointers and, in blocks of bounded size, extends frequent prefixes word by word: it deals all pointers of a prefix out by their next word and goes on with those that are
frequent. A prefix with more pointers than a task's share is cut by the ranges like any other:
phrases whose run touches a block's edge are passed on with the sum so far, whatever it is, and the sums meet by phrase. So no group of a prefix has to fit into a task, and a collision
only passes on a phrase too many.

Only pointers whose first two words may be a frequent pair are projected, and only up to the first pair that can't be one, as every part of a
frequent phrase is frequent. Words and pairs are first counted by 64-bit hashes, which may only be too many, and pass through a bit map of bounded
size: false positives cost rows, never results. A task sums hashes up before they leave it, packed by their first bits. Those that pass are counted exactly, as text, like all phrases.
Texts are read twice: for hashes, then for words and pointers.

Everything is per lang (null: `und`). n counts word occurrences, f(phrase) the contiguous occurrences within pieces. A candidate has 2 to `most`
words and f of at least `least`; of its cuts into two parts the one with the lowest score floor(1000 * a * n / (l * r)) counts, of ties the
first. A candidate inside a longer one that has at least `absorb` percent of its occurrences is dropped; as f never grows with a phrase, looking at phrases one word longer is
enough. Arithmetic is in whole decimals. First `top` by score, a, phrase (UTF-8 bytes): ranked within salted shares first, so no lang is ranked in one task whole.

Null texts count as empty; texts without words add nothing, and a lang without candidates has no rows. Repeated rows count each. Very long texts are read in
parts, whole words at a time. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Words of texts that a task holds at once; bytes of texts that are read at once; hashes that a task holds at once.
WORDS, PART, HELD = 1 << 20, 1 << 20, 1 << 22
#: First bits of a hash by which hashes are packed; those of a pair's that a pointer's sort key begins with.
SLOT_BITS, PAIR_BITS = 14, 28
#: Bits of the map of frequent words and pairs: 16 each, between these bounds (32 MB at most).
FEWEST_BITS, MOST_BITS = 20, 28
#: Shares in which a lang's phrases are ranked before they meet.
SHARES = 64
BREAKS = b".,;:!?\n\x0b\x0c\r"
PIECES = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
#: For hashes of words: of a byte, of its place in a word of up to LONG bytes.
LONG, ODD = 256, np.uint64(0x9E3779B97F4A7C15)
OF_BYTE = np.array([xxhash.xxh64_intdigest(bytes([x])) for x in range(256)], np.uint64)
POWERS = np.cumprod(np.full(LONG, 0xD6E8FEB86659FD95, np.uint64))
BETWEEN = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")

Block = tuple[pa.Array, np.ndarray, np.ndarray, int]


def parts(text: memoryview) -> Iterator[bytes]:
    """The text in parts of about PART bytes that end where a word ends."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            m = BETWEEN.search(text, end)
            end = m.start() if m else len(text)
        yield bytes(text[at:end])
        at = end


def chunks(texts: Iterator[memoryview]) -> Iterator[tuple[bytes, bool]]:
    """Texts of about PART bytes together with a break between two, longer ones in parts; and whether a chunk goes on with the last one's text."""
    held: list[memoryview] = []
    size = 0
    for text in texts:
        if held and size + len(text) > PART:
            yield b"\n".join(held), False
            held, size = [], 0
        if len(text) > PART:
            yield from ((part, k > 0) for k, part in enumerate(parts(text)))
        else:
            held.append(text)
            size += len(text)
    if held:
        yield b"\n".join(held), False


def cut_words(text: bytes) -> tuple[pa.Array, np.ndarray, int]:
    """The words in lower case, the number of breaks before each, that of all breaks."""
    low = np.frombuffer(text.lower().translate(PIECES), np.uint8)
    breaks = low == 10
    inside = np.zeros(len(low) + 2, bool)
    np.logical_not(breaks | (low == 32), out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    at = np.flatnonzero(breaks)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside[1:-1]])])
    before = np.searchsorted(starts, at)
    return words, np.repeat(np.arange(len(at) + 1), np.diff(before, prepend=0, append=len(starts))), len(at)


def blocks(texts: Iterator[memoryview], reach: int) -> Iterator[Block]:
    """Words of texts as (dictionary, codes, pieces, starts): starts first places are begun here, up to reach words follow them.

    The last words of a block, up to reach of them of one piece, begin the next block, so each place is begun in one block and has its
    right context there.
    """
    words: list[pa.Array] = []
    pieces: list[np.ndarray] = []
    size = broken = 0

    def made(starts: int) -> Block:
        coded = pa.concat_arrays(words).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.concatenate(pieces), starts

    for chunk, goes_on in chunks(texts):
        found, before, breaks = cut_words(chunk)
        broken += not goes_on
        if len(found):
            words.append(found)
            pieces.append(before + broken)
            size += len(found)
        broken += breaks
        if size >= WORDS:
            last = np.concatenate(pieces)[-reach:] if reach else np.empty(0, np.int64)
            again = int((last == pieces[-1][-1]).sum())
            yield made(size - again)
            tail = pa.concat_arrays(words)[size - again :]
            words, pieces, size = [tail], [last[len(last) - again :]], again
    if size:
        yield made(size)


def by_lang(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[tuple[str, Block]]:
    for b in shared.cut(batches, 16 << 20):
        langs = b.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            for block in blocks(shared.views(b.column(1).filter(pc.equal(langs.indices, code))), reach):
                yield lang, block


def polynomial(words: pa.Array) -> np.ndarray:
    """Over the bytes of each word, of LONG at most; no word is empty."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
    return np.add.reduceat(OF_BYTE[data] * POWERS[np.arange(len(data), dtype=np.int32) - np.repeat(starts, sizes)], starts)


def hashes(lang: str, dictionary: pa.Array) -> np.ndarray:
    """64 bits for each word of the lang. Equal ones of different words cost rows, never results."""
    x, sizes = np.empty(len(dictionary), np.uint64), pc.binary_length(dictionary).to_numpy()
    for k in np.flatnonzero(sizes > LONG).tolist():
        x[k] = xxhash.xxh64_intdigest(memoryview(dictionary[k].as_buffer()))
    short = np.flatnonzero(sizes <= LONG)
    for at in range(0, len(short), 1 << 16):
        own = short[at : at + (1 << 16)]
        x[own] = polynomial(dictionary.take(pa.array(own)))
    x = (x ^ (x >> np.uint64(32)) ^ np.uint64(xxhash.xxh64_intdigest(lang))) * ODD
    return (x ^ (x >> np.uint64(29))) * ODD


def pair_hashes(h: np.ndarray, codes: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place but the last: the hash of its word and the next, and whether one piece holds both."""
    first, second = h[codes[:-1]], h[codes[1:]]
    x = (first * ODD ^ (first >> np.uint64(29))) + second
    return (x ^ (x >> np.uint64(32))) * ODD, pieces[:-1] == pieces[1:]


def packed(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row (slot, h, n) for all sorted hashes of equal first bits: 8 bytes each, their numbers 4 bytes each."""
    slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    edges = np.append(starts, len(h)).astype(np.int32)
    rows = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges * np.int32(x.itemsize)), pa.py_buffer(x)])
    return pa.record_batch([pa.array(slot[starts]), rows(h), rows(n.astype(np.uint32))], names=["slot", "h", "n"])


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(shared.views(column)), kind)


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)]
    return h[at], np.add.reduceat(n[order], at) if len(at) else n


def count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0
    for lang, (dictionary, codes, pieces, starts) in by_lang(batches, 1):
        h = hashes(lang, dictionary)
        pair, whole = pair_hashes(h, codes, pieces)
        held += [h[codes[:starts]], pair[:starts][whole[:starts]]]
        size += starts + len(held[-1])
        if size >= HELD:
            yield packed(*np.unique(np.concatenate(held), return_counts=True))
            held, size = [], 0
    if size:
        yield packed(*np.unique(np.concatenate(held), return_counts=True))


def frequent_hashes(least: int) -> Callable:
    """From packed hashes, slot by slot: those that occur least times. What is held is a batch and a slot's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            h, n = summed(np.append(h, unpacked(b.column(1), np.uint64)), np.append(n, unpacked(b.column(2), np.uint32).astype(np.int64)))
            over = h >> np.uint64(64 - SLOT_BITS) < np.uint64(b.column(0)[-1].as_py())
            yield pa.record_batch([pa.array(h[over & (n >= least)].view(np.int64))], names=["h"])
            h, n = h[~over], n[~over]
        yield pa.record_batch([pa.array(h[n >= least].view(np.int64))], names=["h"])

    return run


class PairMap:
    """Bit map of hashes; may hold more than was put in, never less."""

    def __init__(self, frequent: DataFrame) -> None:
        n = frequent.count()
        self.bits = min(MOST_BITS, max(FEWEST_BITS, (16 * n).bit_length()))
        slot = F.shiftrightunsigned("h", 64 - self.bits)
        words = frequent.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)  # at most 1 << MOST_BITS bits reach the driver
        self.words[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def next_bits(most: int) -> int:
    """Bits that a word behind the first pair has in a pointer's sort key."""
    return (64 - PAIR_BITS) // max(1, most - 2)


def projected(shared_map, most: int) -> Callable:
    """Rows (lang, words, n, place): pointers whose first pair may be frequent, with their words, space-joined, and sort key; words that may be frequent, without one; all words' number, without words."""
    bits = next_bits(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: PairMap = shared_map.value
        for lang, (dictionary, codes, pieces, starts) in by_lang(batches, most - 1):
            h = hashes(lang, dictionary)
            counted, own = np.bincount(codes[:starts], minlength=len(dictionary)), np.flatnonzero(frequent.holds(h))
            said = pa.concat_arrays([dictionary.take(pa.array(own)), pa.nulls(1, pa.binary())])
            yield rows(lang, said, np.append(counted[own], starts), pa.nulls(len(said), pa.int64()))
            pair, whole = pair_hashes(h, codes, pieces)
            good = np.append(whole & frequent.holds(pair), False)
            at = np.flatnonzero(good[:starts])
            if not len(at):
                continue
            place = pair[at] >> np.uint64(64 - PAIR_BITS) << np.uint64(64 - PAIR_BITS)
            columns, on = [codes[at], codes[at + 1]], np.arange(len(at))
            for k in range(1, most - 1):
                on = on[good[at[on] + k]]
                columns.append(np.full(len(at), -1))
                columns[-1][on] = codes[at[on] + k + 1]
                place[on] |= h[columns[-1][on]] >> np.uint64(64 - bits) << np.uint64(64 - PAIR_BITS - bits * k)
            first, n = distinct(columns, place)
            texts = [dictionary.take(pa.array(c[first], mask=c[first] < 0)) for c in columns]
            yield rows(lang, pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary()), null_handling="skip"), n, pa.array(place[first].view(np.int64)))

    return run


def rows(lang: str, words: pa.Array, n: np.ndarray, place: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(n)), words, pa.array(n, pa.int64()), place], names=["lang", "words", "n", "place"])


def distinct(columns: list[np.ndarray], by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where distinct rows of columns stand, and their numbers. Rows that differ but have one hash `by` may keep equal ones apart."""
    order = np.argsort(by)
    first = np.zeros(len(order), bool)
    first[:1] = True
    for c in columns:
        c = c[order]
        first[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(first)
    return order[at], np.diff(np.append(at, len(order)))


def grown(least: int, most: int) -> Callable:
    """From pointers (lang, words, n, place) sorted by place: phrases (lang, phrase, n), n whole or, at a block's edge, what the block has."""
    bits = next_bits(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, place = b.column(2).to_numpy(), b.column(3).to_numpy()
            split = pc.split_pattern(b.column(1), b" ")
            coded, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
            codes, starts = coded.indices.to_numpy(), offsets[:-1] - offsets[0]
            sizes = np.diff(offsets)
            prefix = b.column(0).dictionary_encode().indices.to_numpy().astype(np.int64)
            on = np.arange(b.num_rows)
            for depth in range(most):
                on = on[sizes[on] > depth]
                if not len(on):
                    break
                deal = prefix[on] << 32 | codes[starts[on] + depth]
                order = np.argsort(deal)
                on, deal = on[order], deal[order]
                new = np.append(True, deal[1:] != deal[:-1])
                at = np.flatnonzero(new)
                prefix[on] = np.cumsum(new)
                if not depth:
                    continue
                run_of = place >> (64 - PAIR_BITS - bits * (depth - 1))
                total, own = np.add.reduceat(n[on], at), run_of[on[at]]
                kept = (total >= least) | (own == run_of[0]) | (own == run_of[-1])
                said = on[at[kept]]
                if len(said):
                    texts = [coded.dictionary.take(pa.array(codes[starts[said] + k])) for k in range(depth + 1)]
                    phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary()))
                    yield pa.record_batch([b.column(0).take(pa.array(said)), phrase.cast(pa.string()), pa.array(total[kept])], names=["lang", "phrase", "n"])
                on = on[np.repeat(kept, np.diff(np.append(at, len(on))))]

    return run


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to most words with f >= least, and (lang, n)."""
    spark = docs.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    dealt = texts.mapInArrow(count_hashes, "slot int, h binary, n binary").repartition(2 * shares, "slot").sortWithinPartitions("slot")
    held = spark.sparkContext.broadcast(PairMap(shared.stored(dealt.mapInArrow(frequent_hashes(least), "h long"), "phrases-hashes")))  # MOST_BITS at most
    found = shared.stored(texts.mapInArrow(projected(held, most), "lang string, words binary, n long, place long"), "phrases-pointers")
    words = shared.stored(found.where("place is null").groupBy("lang", "words").agg(F.sum("n").alias("n")), "phrases-words")
    pointers = found.where("place is not null").repartitionByRange(shares, "place").sortWithinPartitions("place")
    longer = pointers.mapInArrow(grown(least, most), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    single = words.where((F.col("n") >= least) & F.col("words").isNotNull()).select("lang", F.col("words").cast("string").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("f"))
    every = single.union(longer.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f"))
    return shared.stored(every, "phrases-frequent"), words.where("words is null").select("lang", "n")


def score() -> Column:
    """floor(1000 * a * n / (l * r)) of whole numbers up to 10 ** 16 (a) and 10 ** 18."""
    return F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, most: int = 5, absorb: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each lang."""
    known, totals = frequent_phrases(docs, lang_col, text_col, least, most)
    candidates = known.where("k > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    joined = lambda x, at, n: F.array_join(F.slice(x, at, n), " ")
    size = F.size("w")
    parts_of = candidates.where(size > 2).select("lang", "a", F.explode(F.array(joined("w", F.lit(1), size - 1), joined("w", F.lit(2), size - 1))).alias("phrase"))
    around = parts_of.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < absorb * F.col("a"), F.lit(True))).drop("around")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("j"))
    cuts = cuts.select("lang", "phrase", "a", "j", joined("w", F.lit(1), F.col("j")).alias("left"), joined("w", F.col("j") + 1, size - F.col("j")).alias("right"))
    f = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    priced = cuts.join(f("left", "l"), ["lang", "left"]).join(f("right", "r"), ["lang", "right"]).join(totals, "lang")
    lowest = priced.withColumn("score", score()).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "j", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("lang", "phrase"), F.lit(SHARES))
    first = lowest.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, k WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
      FROM (SELECT *, unnest(range(1, c.k)) AS j FROM c) c JOIN n USING (lang)
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
d AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN d USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o
QUALIFY rank <= 2000
"""
