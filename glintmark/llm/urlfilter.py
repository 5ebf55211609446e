"""URL filters: rules for hosts and paths applied by a sorted sweep over canonical keys.

A host's labels in reverse order, each with a dot behind it, make a key by which a rule for a host and all its subdomains is
an interval of keys: those that begin with the rule's. The same holds for paths below one host. Such intervals are nested or apart.
The sweep deals keys and the intervals' two ends out by ranges of the sorted order, adds the intervals that are open where a
range begins (as many as the nesting is deep, a range), and goes through each range in order: a running sum of ends is the height of the
stack of open rules, and the last rule opened at each height up to it is the stack.

The first sweep is over hosts: a row's stack names the rule hosts that its host is, or is below. The second is over rule host and path
together, for the rows that have such a host: the top of that stack is the longest path rule. Of a row's rules the longest
(host and path in code points) wins, of equally long ones the one with the longer host; of equal rules with two verdicts, block.

Only DataFrame operations. Ranges are cut by key and a hash of the row, so rows of one host, or even of one URL, fall into as many ranges
as they fill; nothing is broadcast, and neither rules nor rows have a bound. What reaches the driver is the greatest height.

Null URLs and those without `://` have an empty host and path, which no rule fits, and get the default verdict. Hosts are compared
as they are written (A-Z lower-cased; ports and user names belong to them). Rules with a null host, or a path that isn't empty and has no leading
slash, fit nothing; a null path counts as empty. Repeated rows are rows of their own. Further columns are kept; host, path, rule and verdict take the place of columns of these names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Ranges of the sorted order for each shuffle partition.
RANGES = 4
#: The rules of op12_url_filter.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ADDED = ["host", "path", "rule", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot behind it; no label holds a dot, so a key begins with a rule's only at whole labels."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """points (key, row) with stack: the labels of the rules (prefix, label) whose prefix begins the key, shortest first.

    No prefix may repeat. key and prefix are strings, compared as UTF-8; 0xFF, which no such key holds, ends an interval.
    """
    spark = points.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind, row = rules.schema["label"].dataType, points.schema["row"].dataType
    key = F.col("prefix").cast("binary")
    end = lambda at, step: rules.select(at.alias("key"), F.lit(0).alias("point"), F.lit(0).cast("long").alias("salt"), F.lit(step).alias("step"), "prefix", "label", F.lit(None).cast(row).alias("row"))
    own = points.select(F.col("key").cast("binary").alias("key"), F.lit(1).alias("point"), F.xxhash64("row").alias("salt"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast(kind).alias("label"), "row")
    all_of = own.union(end(key, 1)).union(end(F.expr("concat(cast(prefix as binary), X'FF')"), -1))
    placed = shared.stored(all_of.repartitionByRange(n, "key", "point", "salt").withColumn("range", F.spark_partition_id()), "sweep")
    ends = placed.where("point = 0")
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("range")))
    spans = ends.groupBy("prefix").agg(at(1).alias("first"), at(-1).alias("last"), F.max("label").alias("label")).where("first < last")
    open_ones = spans.select(key.alias("key"), F.lit(0).alias("point"), F.lit(0).cast("long").alias("salt"), F.lit(1).alias("step"), "prefix", "label", F.lit(None).cast(row).alias("row"), F.explode(F.sequence(F.col("first") + 1, "last")).alias("range"))
    # Open ones come first in their range, the outermost before all; an interval's beginning comes before a point at the same key.
    w = Window.partitionBy("range").orderBy("early", "key", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = lambda df: df.withColumn("early", F.lit(1)).union(open_ones.withColumn("early", F.lit(0))).withColumn("height", F.sum("step").over(w))
    deepest = merged(ends).agg(F.max("height")).first()[0] or 0
    levels = [F.when(F.col("height") >= d, F.last(F.when((F.col("step") == 1) & (F.col("height") == d), F.col("label")), ignorenulls=True).over(w)) for d in range(1, deepest + 1)]
    stack = F.filter(F.array(*levels), lambda x: x.isNotNull()) if levels else F.array().cast(f"array<{kind.simpleString()}>")
    return merged(placed).select("key", "point", "row", stack.alias("stack")).where("point = 1").select("key", "row", "stack")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (as host and path) and verdict. rules: host, path, verdict (allow or block)."""
    rules = rules.select(lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    kept = [c for c in urls.columns if c.lower() not in ADDED]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = urls.select(F.struct(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]).alias("own"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("id")).alias("row"))
    node = host_key(F.col("host"))
    hosts = sweep(rows.select(host_key(F.col("row.host")).alias("key"), "row"), rules.select(node.alias("prefix"), node.alias("label")).distinct())
    hosts = shared.stored(hosts.select("row", "stack"), "url-hosts")
    below = F.lit("/")  # no host holds one
    points = hosts.where(F.size("stack") > 0).select("row", F.explode("stack").alias("node")).select(F.concat("node", below, "row.path").alias("key"), "row")
    label = F.struct((F.char_length("host") + F.char_length("path")).alias("chars"), F.char_length("host").alias("host_chars"), F.concat("host", "path").alias("rule"), "verdict")
    paths = sweep(points, rules.select(F.concat(node, below, "path").alias("prefix"), label.alias("label")))
    best = F.max(F.try_element_at("stack", F.lit(-1))).alias("best")
    found = paths.groupBy("row.id").agg(F.first("row").alias("row"), best).select("row", "best")
    none = hosts.where(F.size("stack") == 0).select("row", F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    out = found.union(none).select(*[F.col(f"row.own.c{k}").alias(c) for k, c in enumerate(kept)], "row.host", "row.path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return out.toDF(*kept, *ADDED)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    given = F.array(*[F.struct(*[F.lit(x).alias(name) for name, x in zip(("host", "path", "verdict"), r)]) for r in RULES])
    return judge(pages, spark.range(1).select(F.inline(given))).select("page_id", *ADDED)


OP12_SQL = r"""
WITH r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, v)),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM x LEFT JOIN m USING (rid)
"""
