"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Fingerprints: majority bit of XXH64 (seed 42) over word shingles. Candidate search: for a radius r the
2**(r+1) - 1 structured masks of a covering code; two fingerprints that differ in r bits or fewer agree on
at least one masked value, so no near pair is missed. Work is on distinct fingerprints, so exact copies
cost one row. Inside a bucket of masked values up to SMALL fingerprints are compared; in a larger bucket every
fingerprint instead names the values one bit flip away on the free bits, and fingerprints that name the same value
are linked through it, which is exact for radius 2 or less and linear in the bucket.
Classes: connected components by alternating large-star and small-star rounds, each written to the shared folder.

Null text counts as empty. Rows with no words have fingerprint zero and link like any other. Rows with a null
doc_id keep a fingerprint and get the class of their fingerprint; the class id is the smallest non-null doc_id,
null if there is none. Repeated rows and repeated doc_ids are kept as rows. Further columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Distinct fingerprints of one bucket that are compared with each other; larger buckets use the flip form.
SMALL = 24


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z only, and space with \x09-\x0D only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(x), seed) for x in zip(*(words[k:] for k in range(shingle)))]
    ones = np.zeros(64, np.int64)
    packed = np.array(hashes, ">u8")
    for at in range(0, len(packed), 1 << 16):
        ones += np.unpackbits(packed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, mark: Column | None = None) -> DataFrame:
    """(doc_id, fp long) for every row, and its mark if given; fp is the unsigned fingerprint's bits as a signed long."""
    more = [] if mark is None else ["mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.cut(batches):
            fps = [fingerprint(x, shingle, seed) for x in shared.as_bytes(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *more])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([] if mark is None else [mark.alias("mark")]))
    return own.mapInArrow(run, ", ".join([f"doc_id {kind}, fp long", *(f"{c} string" for c in more)]))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks such that any radius positions are all cleared by at least one of them.

    Position i carries a nonzero vector of radius + 1 bits, dealt evenly; mask v keeps the positions whose vector
    has an odd product with v. Any radius vectors leave a nonzero v orthogonal to all, and that mask clears them.
    """
    top = (1 << (radius + 1)) - 1
    vectors = [1 + i % top for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """(a, b) with a > b, enough links between fingerprints to join every pair within radius; none farther apart.

    distinct: one column fp. Radius 1 or 2: beyond, one flip doesn't reach half the distance.
    """
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    masks = covering_masks(radius)
    bucketed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("v", "key")
    )
    # Only small groups are ever gathered: the first aggregate counts, the second sees counted groups.
    sizes = bucketed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared_buckets = shared.stored(bucketed.join(sizes, ["v", "key"]), "simhash-buckets")
    few = shared_buckets.where(F.col("n") <= small).groupBy("v", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.filter(
        F.transform("fps", lambda x: F.struct(x.alias("b"), F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= radius)).alias("near"))),
        lambda s: F.size(s.near) > 0,
    )
    pairs = few.select(F.explode(near).alias("s")).select(F.explode("s.near").alias("a"), F.col("s.b").alias("b"))
    many = shared_buckets.where(F.col("n") > small)
    flips = F.element_at(
        F.array(*[F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]).cast("array<bigint>") for m in masks]),
        F.col("v") + 1,
    )
    hubs = many.select("v", "fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("hub"))
    # A hub value contains its bucket's key, as flips are on the cleared bits. A flip's two ends are within 2.
    if radius == 2:
        low = hubs.groupBy("v", "hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        rest = hubs.join(low, ["v", "hub"]).where("fp > b").select(F.col("fp").alias("a"), "b")
    else:
        both = many.select("v", F.col("fp").alias("hub")).distinct()
        rest = hubs.join(both, ["v", "hub"]).where("fp > hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.union(rest).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same connections as the task's links, as one link from each node to its smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def out() -> pa.RecordBatch:
        a = [x for x in parent if root(x) != x]
        return pa.record_batch([pa.array(a, pa.int64()), pa.array([root(x) for x in a], pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(x), root(y)
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:  # a task's memory stays bounded; what it has found goes on as links
            yield out()
            parent.clear()
    yield out()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of edges (a, b) with the smallest node it is connected to.

    Links are first shrunk inside each task; then large-star and small-star rounds run on DataFrames until nothing
    changes. Every round is written to the shared folder, so no lineage grows and lost executors cost one round.
    """
    spark = edges.sparkSession
    now = shared.stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long"), "components")
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = shared.stored(small.where("a <> b").distinct(), "components")
        # Finished when the links are stars: no node is both an end and a centre, and each has one centre.
        ends = after.groupBy("a").agg(F.count("*").alias("n"))
        loose = ends.where("n > 1").select("a").union(after.select(F.col("b").alias("a")).distinct().join(ends, "a", "left_semi"))
        now = after
        if loose.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root): every fingerprint of prints with its smallest doc_id and its class."""
    classes = shared.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = components(links(classes.select("fp"), radius))
    return classes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    prints = shared.stored(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-prints")
    # The class's smallest doc_id by an aggregate over distinct fingerprints.
    linked = _classes(prints, radius)
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = linked.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """Pipeline form: of each class one row stays, the first by doc_id (null last), fingerprint, then hashes of text and row.

    Ids needn't be unique or given, as rows are told apart by id and hashes. The choice is made on these small keys, which
    tasks sum up first. Rows that agree in them are equal; the join and their removal share one shuffle.
    """
    own = lambda c: F.to_json(F.struct(c)) if re.search("map<|variant", docs.schema[c].dataType.simpleString()) else F.col(f"`{c}`")  # noqa: E731  no hash of maps
    others = [own(c) for c in docs.columns if c not in (id_col, text_col)]
    mark = F.concat(F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")), F.lit(" "), F.hex(F.xxhash64(*others)) if others else F.lit(""))
    prints = shared.stored(fingerprints(docs, id_col, text_col, mark=mark), "simhash-prints")
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "fp", "mark")).alias("x")
    found = prints.join(_classes(prints, radius).select("fp", "root"), "fp").groupBy("root").agg(first)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    keys = ["__id", "__mark"]
    stay = found.select(name("x.doc_id").alias("__id"), F.col("x.mark").alias("__mark"))
    return docs.withColumns({"__id": name(id_col), "__mark": mark}).join(stay, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
