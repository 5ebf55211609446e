"""The registered queries of the detection engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators import baseline, context, detect, enrich, history, merge, report, rescan, score
from ..plans import dims, engine
from ..sources import archives, images, parsers, repository
from ..sources import files as S
from ..sources.workers import reach
from ..streaming import incremental
from .derived import CODE, FINDINGS, TECH, duck, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FIND, CODES, TECHS = (f"({duck(x)})" for x in (FINDINGS, CODE, TECH))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table dealt out in shares: a small file of one split grows into much work, which one task would do alone."""
    return S.dealt(table(spark, sf_dir, name).select(*columns))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents_as_files(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, FINDINGS)


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


PATH = "coalesce(source, '') || '/' || coalesce(doc_id::VARCHAR, 'none-' || md5(coalesce(text, ''))) || '.' || coalesce(lang, '')"
LINES = f"(SELECT {PATH} AS path, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


# Sources, paths


@query(f"SELECT path, line, length(text) AS n_chars FROM {LINES}")
def scan_lines(spark, sf_dir):
    return S.lines(doc_files(spark, sf_dir)).select("path", "line", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT path FROM (SELECT {PATH} AS path FROM documents) WHERE (contains(path, 'src1') OR contains(path, 'src2')) AND NOT contains(path, '.de')")
def path_filter(spark, sf_dir):
    return doc_files(spark, sf_dir).where(S.admitted(F.col("path"), ["src1", "src2"], [".de"])).select("path")


ROUTE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(path, {quote(rx)}) THEN '{n}'" for n, rx in S.ROUTES.items()) + " END"


@query(f"SELECT path, {ROUTE_SQL} AS parser FROM (SELECT DISTINCT path FROM {FIND} UNION SELECT path FROM {TECHS})")
def file_routes(spark, sf_dir):
    paths = findings(spark, sf_dir).select("path").union(frame(spark, sf_dir, TECH).select("path")).distinct()
    return paths.select("path", S.route(F.col("path")).alias("parser"))


@query(f"SELECT path, length(content) AS n FROM (SELECT {PATH} AS path, text AS content, doc_id FROM documents) WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = regexp_extract(path, '/(\\d+)\\.', 1)::BIGINT)")
def changed_files_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed = S.documents_as_files(docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"))
    return S.changed_only(S.documents_as_files(docs), changed).select("path", F.length("content").cast("long").alias("n"))


@query("SELECT DISTINCT 'http://host/' || p || w AS url FROM (SELECT lower(c_mktsegment) AS w FROM customer UNION ALL SELECT lower(r_name) FROM region), (SELECT unnest(['', 'config/', 'conf/', '.config/', 'private/', 'backup/', 'old/']) AS p)")
def wordlist_urls(spark, sf_dir):
    words = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("word")).union(table(spark, sf_dir, "region").select(F.lower("r_name")))
    return S.wordlist_urls(words, "http://host/")


LINKS_SQL = "SELECT 'http://h' || c_nationkey % 3 || '/p' || c_custkey AS source, 'http://h' || c_nationkey % 3 || '/p' || (c_custkey * 7 + 3) % 1000 AS target FROM customer UNION ALL SELECT 'http://h' || c_nationkey % 3 || '/p' || c_custkey, 'http://h' || (c_nationkey + 1) % 3 || '/p' || c_custkey % 50 FROM customer"


@query(f"""WITH RECURSIVE l AS ({LINKS_SQL}), r(url, depth) AS (SELECT DISTINCT source, 0 FROM l WHERE source LIKE '%/p1_' UNION SELECT target, depth + 1 FROM r JOIN l ON url = source AND split_part(source, '/', 3) = split_part(target, '/', 3) WHERE depth < 2)
SELECT url, min(depth)::INT AS depth FROM r GROUP BY url""")
def crawl_frontier(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    url = lambda host, page: F.concat(F.lit("http://h"), (host % 3).cast("string"), F.lit("/p"), page.cast("string"))
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    links = c.select(url(n, k).alias("source"), url(n, (k * 7 + 3) % 1000).alias("target")).union(c.select(url(n, k), url(n + 1, k % 50)))
    return S.crawl(links, links.where("source like '%/p1_'").select(F.col("source").alias("url")), 2)


PLAIN_URL = "(SELECT regexp_replace(url, '#.*$', '') AS url FROM pages)"


def _url_sets(spark, sf_dir):
    """Addresses as they are, and without what is behind #."""
    p = table(spark, sf_dir, "pages")
    return p.select("url"), p.select(F.regexp_replace("url", "#.*$", "").alias("url"))


@query(f"SELECT url FROM pages UNION SELECT url FROM {PLAIN_URL}")
def url_union(spark, sf_dir):
    a, b = _url_sets(spark, sf_dir)
    return a.union(b).distinct()


@query(f"SELECT url FROM pages INTERSECT SELECT url FROM {PLAIN_URL}")
def url_intersect(spark, sf_dir):
    a, b = _url_sets(spark, sf_dir)
    return a.intersect(b)


@query(f"SELECT url FROM pages EXCEPT SELECT url FROM {PLAIN_URL}")
def url_except(spark, sf_dir):
    a, b = _url_sets(spark, sf_dir)
    return a.subtract(b)


HOSTS = [("10.1.2.3", 1), ("127.0.0.1", 1), ("8.8.8.8", 0), ("172.16.0.9", 1), ("172.40.0.9", 0), ("192.168.4.4", 1), ("169.254.169.254", 1), ("localhost", 1), ("example.org", 0), ("224.0.0.5", 1), ("metadata.google.internal", 1), ("100.64.1.1", 1)]


@query("SELECT c_custkey AS id, [" + ", ".join("true" if b else "false" for _, b in HOSTS) + f"][(c_custkey % {len(HOSTS)} + 1)::INT] OR c_custkey % 13 = 0 AS blocked FROM customer")
def blocked_destinations(spark, sf_dir):
    k = F.col("c_custkey")
    host = F.element_at(F.array(*[F.lit(h) for h, _ in HOSTS]), (k % len(HOSTS) + 1).cast("int"))
    url = F.concat(F.when(k % 13 == 0, "ftp").otherwise("https"), F.lit("://"), host, F.lit("/x"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), S.blocked_destination(url).alias("blocked"))


@query("SELECT event_id, k AS key, v AS value FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || k) AS v) WHERE v IS NOT NULL")
def json_items(spark, sf_dir):
    x = parsers.json_column_items(table(spark, sf_dir, "events").select("event_id", "props"), F.col("event_id").cast("string"), "props")
    return x.select(F.col("path").cast("long").alias("event_id"), "key", "value")


@query("SELECT 'e' || event_id || '.json' AS path, k AS key, v AS value FROM events, LATERAL (SELECT 'a[1].p.' || unnest(json_keys(props)) AS k, unnest(json_keys(props)) AS raw), LATERAL (SELECT json_extract_string(props, '$.' || raw) AS v) UNION ALL SELECT 'e' || event_id || '.json', 'a[0]', 'True' FROM events")
def json_tree_items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    files = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.concat(F.lit('{"a": [true, {"p": '), "props", F.lit('}], "n": null}')).alias("content"))
    return parsers.json_items(files).select("path", "key", "value")


# Files of customers: what was there before a day, and what is there now (customers whose last order is open have gone).
VERSIONS = """SELECT concat('c', CAST(o_custkey AS STRING)) AS path, CAST(o_orderkey % 3 AS BIGINT) AS length, CAST(o_orderdate AS TIMESTAMP) AS modified, md5(o_orderpriority) AS digest, o_orderstatus AS status,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM {orders}"""
BEFORE = VERSIONS + " WHERE o_orderdate < DATE '1998-01-01'"


@query(f"""WITH old AS (SELECT * FROM ({duck(BEFORE)}) WHERE n = 1), now AS (SELECT * FROM ({duck(VERSIONS)}) WHERE n = 1 AND status <> 'P')
SELECT coalesce(now.path, old.path) AS path, CASE WHEN now.path IS NULL THEN 'deleted' WHEN old.path IS NULL THEN 'added' WHEN now.length = old.length AND now.modified = old.modified THEN 'same'
WHEN now.digest = old.digest THEN 'touched' ELSE 'changed' END AS state, coalesce(now.digest, old.digest) AS digest FROM old FULL JOIN now ON old.path = now.path""")
def manifest_changes(spark, sf_dir):
    """What an incremental scan finds changed between two states of all files."""
    now = frame(spark, sf_dir, VERSIONS).where("n = 1 AND status <> 'P'")
    old = frame(spark, sf_dir, BEFORE).where("n = 1").select("path", "length", "modified", "digest", F.lit(1).alias("run"), F.lit(None).cast("timestamp").alias("listed"))
    seen = rescan.compared(now, old)
    read = seen.where("state in ('added', 'doubtful')").select("path").join(now, "path").select("path", F.col("digest").alias("new_digest"))
    return rescan.settled(seen, read).select("path", "state", "digest")


# Layers of images: a file, folder, whiteout or opaque mark each.
EVENTS = """SELECT concat('i', CAST(l_orderkey AS STRING)) AS image, CAST(l_linenumber AS INT) AS position, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' ELSE 'a/b/f' END AS at,
CASE CAST(l_suppkey % 6 AS INT) WHEN 0 THEN 'folder' WHEN 1 THEN 'whiteout' WHEN 2 THEN 'opaque' ELSE 'file' END AS kind, md5(CAST(l_partkey AS STRING)) AS value FROM {lineitem}"""


@query(f"""WITH e AS ({duck(EVENTS)}) SELECT v.image, v.position, v.at, v.value, (SELECT min(e.position) FROM e WHERE e.image = v.image AND e.position > v.position AND (e.kind IN ('file', 'whiteout') AND (v.at = e.at
OR starts_with(v.at, e.at || '/')) OR e.kind = 'folder' AND e.at = v.at OR e.kind = 'opaque' AND starts_with(v.at, e.at || '/'))) AS removed_in FROM e v WHERE v.kind = 'file'""")
def image_layers_hidden(spark, sf_dir):
    """Values baked into layers, with the later layer that hides their file."""
    seen = frame(spark, sf_dir, EVENTS)
    return images.resolved(seen.unionByName(seen.where("kind = 'file'").withColumn("kind", F.lit("value")))).select("image", "position", "at", "value", "removed_in")


CODE_KINDS = [("%hunter2%", "'password'", "hunter2hunter2", "variable"), ("api_key%", "'api_key'", "abcdef0123456789", "variable"), ("const%", "'MAX'", "3", "variable"), ("except%", "'except'", "print", "variable"), ('"name"%', "NULL", "name", "string")]


@query(" UNION ALL ".join(f"SELECT path, line, {key} AS key, '{value}' AS value, '{kind}' AS type FROM {CODES} WHERE text LIKE '{like}'" for like, key, value, kind in CODE_KINDS))
def code_items(spark, sf_dir):
    files = frame(spark, sf_dir, CODE).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return parsers.code_items(files).select("path", "line", "key", "value", "type")


@query("""SELECT 'infra/' || p_partkey || '.tf' AS path, 2 AS line, 'Terraform Hardcoded Access Key' AS rule_name, upper(substr(md5(p_name), 1, 20)) AS value FROM part
UNION ALL SELECT 'infra/' || p_partkey || '.tf', 3, 'Terraform Hardcoded Token', md5(p_name) FROM part UNION ALL SELECT 'ci/.github/workflows/' || p_partkey || '.yml', 3, 'CI/CD Secret Printed to Log', 'DEPLOY_TOKEN' FROM part
UNION ALL SELECT 'img/' || p_partkey || '/Dockerfile', 2, 'Dockerfile Hardcoded Credential', substr(md5(p_name), 1, 12) FROM part""")
def infrastructure_entries(spark, sf_dir):
    p, digest, key = dealt(spark, sf_dir, "part", "p_partkey", "p_name"), F.md5(F.col("p_name").cast("binary")), F.col("p_partkey").cast("string")
    tf = F.struct(F.concat(F.lit("infra/"), key, F.lit(".tf")).alias("path"), F.concat(F.lit('provider "x" {\n  access_key = "'), F.upper(F.substring(digest, 1, 20)), F.lit('"\n  token = "'), digest, F.lit('"\n  secret = "${var.s}"\n}')).alias("content"))
    ci = F.struct(F.concat(F.lit("ci/.github/workflows/"), key, F.lit(".yml")).alias("path"), F.lit("on: push\njobs:\n  - run: echo $DEPLOY_TOKEN\n    env:\n      API_KEY: ${{ secrets.K }}").alias("content"))
    img = F.struct(F.concat(F.lit("img/"), key, F.lit("/Dockerfile")).alias("path"), F.concat(F.lit("FROM x\nENV API_TOKEN="), F.substring(digest, 1, 12), F.lit("\nENV DB_PASSWORD=${X}")).alias("content"))
    return parsers.entries(p.select(F.inline(F.array(tf, ci, img)))).select("path", "line", "rule_name", "value")


CHANGES = """SELECT concat('c', CAST(o_orderkey AS STRING)) AS commit_hash, concat('f', CAST(o_custkey % 3 AS STRING)) AS file, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('o', CAST(o_custkey % 7 AS STRING)) END AS old_blob,
concat('n', CAST(o_custkey % 40 AS STRING)) AS new_blob FROM {orders}"""
RUNS = """SELECT DISTINCT concat('o', CAST(o_custkey % 7 AS STRING)) AS old_blob, concat('n', CAST(o_custkey % 40 AS STRING)) AS new_blob, CAST(o_custkey % 5 * 6 + 1 AS INT) AS first, CAST(o_custkey % 5 * 6 + 4 AS INT) AS last FROM {orders}"""
IN_BLOBS = """SELECT concat('n', CAST(p_partkey % 50 AS STRING)) AS blob, concat('f', CAST(p_size % 3 AS STRING)) AS file, CAST(p_size AS INT) AS line, md5(p_name) AS value FROM {part}"""


@query(f"""WITH c AS ({duck(CHANGES)}), r AS ({duck(RUNS)}), f AS ({duck(IN_BLOBS)})
SELECT commit_hash, c.file, line, value FROM c JOIN f ON c.file = f.file AND c.new_blob = f.blob
WHERE c.old_blob IS NULL OR EXISTS (SELECT 1 FROM r WHERE r.old_blob = c.old_blob AND r.new_blob = c.new_blob AND f.line BETWEEN r.first AND r.last)""")
def history_by_object(spark, sf_dir):
    """Findings of distinct file contents given to the commits that added their lines."""
    return repository.in_added_lines(*(frame(spark, sf_dir, x) for x in (CHANGES, RUNS, IN_BLOBS))).select("commit_hash", "file", "line", "value")


@query("""SELECT 'd' || doc_id || '.zip' AS archive_path, 'd' || doc_id || '.zip!' || m AS path, CASE m WHEN 'in.tar.xz!copy.txt' THEN md5('copy ' || text) ELSE md5(text) END AS digest, 'ok' AS status FROM documents, (SELECT unnest(['text.txt', 'in.tar.xz!copy.txt']) AS m) WHERE text IS NOT NULL
UNION ALL SELECT 'd' || doc_id || '.zip', 'd' || doc_id || '.zip!in.tar.xz!../x', NULL, 'skipped' FROM documents WHERE text IS NOT NULL""")
def archive_members(spark, sf_dir):
    """Every document in a zip file, and again in a compressed tar file inside that."""
    docs = dealt(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), "text")
    found = archives.rows(docs.mapInPandas(packed, "path string, content binary"))
    return found.select("archive_path", "path", F.md5(F.col("content").cast("binary")).alias("digest"), "status")


def packed(batches):
    """Archives of the texts of a batch (path, text)."""
    import io
    import tarfile
    import zipfile

    import pandas as pd

    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["text"]):
            inner, outer = io.BytesIO(), io.BytesIO()
            with tarfile.open(fileobj=inner, mode="w:xz", preset=0) as t:
                for name, body in (("copy.txt", f"copy {text}".encode()), ("../x", b"x")):
                    info = tarfile.TarInfo(name)
                    info.size = len(body)
                    t.addfile(info, io.BytesIO(body))
            with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("text.txt", text)
                z.writestr("in.tar.xz", inner.getvalue())
            rows.append((path, outer.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query("SELECT 'c' || o_orderkey AS commit_hash, 'src/f' || o_custkey % 7 || '.py' AS file, (o_orderkey % 50 + 1 + k)::INT AS line, 'key = ' || o_orderkey || k AS text FROM orders, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT 'c' || o_orderkey, 'src/f' || o_custkey % 7 || '.py', (o_orderkey % 50 + 100)::INT, '++x' FROM orders")
def added_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, start = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 50 + 1).cast("string")
    name = F.concat(F.lit("src/f"), (F.col("o_custkey") % 7).cast("string"), F.lit(".py"))
    diff = F.concat(
        F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nindex 1..2 100644\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -3,1 +"), start, F.lit(",2 @@ def f\n-old\n+key = "), k, F.lit("0\n+key = "), k,
        F.lit("1\n@@ -90 +"), (F.col("o_orderkey") % 50 + 100).cast("string"), F.lit(" @@\n+++x\n"),
    )
    return S.added_lines(o.select(F.concat(F.lit("c"), k).alias("commit_hash"), diff.alias("diff")))


# Detectors

KEYWORD_VALUES = ", ".join(f"({c}, {quote(n)}, {k}, {quote(w)}, {str(w in dims.GENERIC_WORDS).lower()}, '{dims.severity_of_keyword(w)}')" for c, (n, ws) in enumerate(dims.keyword_lists().items()) for k, w in enumerate(dict.fromkeys(ws)))


@query(f"""WITH kw(cix, category, kix, keyword, generic, severity) AS (VALUES {KEYWORD_VALUES}),
c AS (SELECT path, line, unnest(regexp_extract_all(text, '\\b(\\w+)\\s*[:=]\\s*([''"]?[A-Za-z0-9_./+=-]{{6,}}[''"]?)', 1)) AS w,
        unnest(regexp_extract_all(text, '\\b(\\w+)\\s*[:=]\\s*([''"]?[A-Za-z0-9_./+=-]{{6,}}[''"]?)', 2)) AS v FROM {LINES} UNION ALL SELECT path, line, unnest(regexp_extract_all(text, '\\b(\\w+\\.\\w+)\\s*[:=]\\s*([''"]?[A-Za-z0-9_./+=-]{{6,}}[''"]?)', 1)) AS w,
        unnest(regexp_extract_all(text, '\\b(\\w+\\.\\w+)\\s*[:=]\\s*([''"]?[A-Za-z0-9_./+=-]{{6,}}[''"]?)', 2)) AS v FROM {LINES}),
h AS (SELECT path, line, cix, kix, category, keyword, severity, regexp_replace(v, '[''"]', '', 'g') AS value,
        regexp_matches(v, '^[''"].*[''"]$') AS quoted, regexp_matches(v, '^[''"]') AS opened, generic FROM c JOIN kw ON lower(w) = keyword)
SELECT path, line::INT AS line, keyword AS variable, value, category AS pattern_category, severity FROM h
WHERE NOT generic OR (quoted AND length(value) >= 8) OR (NOT opened AND length(value) >= 12)
QUALIFY row_number() OVER (PARTITION BY path, category, value ORDER BY line, cix, kix) = 1""")
def keyword_findings(spark, sf_dir):
    x = detect.keyword_findings(S.lines(doc_files(spark, sf_dir)), dims.keywords(spark))
    return x.select("path", "line", "variable", "value", "pattern_category", "severity")


VALUE_LINES = f"(SELECT path, line, variable || ' = \"' || value || '\"' AS text FROM {FIND})"


def value_lines(spark, sf_dir):
    return findings(spark, sf_dir).select("path", "line", F.concat("variable", F.lit(' = "'), "value", F.lit('"')).alias("text"))


STRUCTURAL_SQL = " UNION ALL ".join(
    f"SELECT {quote(n)} AS pattern, (SELECT count(*) FROM (SELECT DISTINCT path, v FROM (SELECT path, regexp_extract(text, {quote(rx)}, 0) AS v FROM {VALUE_LINES} UNION ALL SELECT path, regexp_extract(text, {quote(rx)}, 0) FROM {LINES}) WHERE v <> '')) AS n" for n, rx, _, _ in dims.STRUCTURAL
)


@query(f"SELECT pattern, n FROM ({STRUCTURAL_SQL})")
def structural_counts(spark, sf_dir):
    lines = value_lines(spark, sf_dir).union(S.lines(doc_files(spark, sf_dir)))
    found = detect.candidates(lines, detect.structural_hits(F.col("text"))).select("path", F.col("word").alias("pattern"), "value").distinct()
    names = spark.createDataFrame([(p[0],) for p in dims.STRUCTURAL], "pattern string")
    return names.join(found.groupBy("pattern").count(), "pattern", "left").select("pattern", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


FORMS_SQL = " UNION ALL ".join(f"SELECT {i} AS ix, {quote(n)} AS pattern, path, line, regexp_extract(text, {quote(rx)}, 0) AS value FROM {VALUE_LINES}" for i, (n, rx, _, _) in enumerate(dims.STRUCTURAL))


def extended_value(rx: str, part: int) -> str:
    return f"coalesce(nullif(regexp_extract(text, {quote(rx)}, {part}), ''), regexp_extract(text, {quote(rx)}, 0))"


EXTENDED_SQL = " UNION ALL ".join(f"SELECT {i} AS ix, {quote(c)} AS pattern_category, {quote(n)} AS pattern, path, line, {extended_value(rx, g)} AS value FROM likely" for i, (c, n, rx, _, _, g) in enumerate(dims.EXTENDED))


@query(f"""WITH likely AS (SELECT * FROM {VALUE_LINES} WHERE regexp_matches(text, '[=:''"@$.-]'))
SELECT path, line::INT AS line, pattern_category, pattern, value FROM ({EXTENDED_SQL}) WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY path, pattern_category, value ORDER BY line, ix) = 1""")
def extended_rows(spark, sf_dir):
    """The second library's findings; the SQL tries every pattern on every line."""
    return detect.extended_findings(value_lines(spark, sf_dir)).select("path", "line", "pattern_category", "pattern", "value")


@query(f"SELECT path, line::INT AS line, pattern, value FROM ({FORMS_SQL}) WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY path, value ORDER BY line, ix) = 1")
def structural_findings(spark, sf_dir):
    return detect.structural_findings(value_lines(spark, sf_dir)).select("path", "line", "pattern", "value")


EXTENDED_SQL = " UNION ALL ".join(
    f"SELECT {i} AS ix, '{c}' AS pattern_category, path, line, CASE WHEN {g} = 1 AND regexp_extract(text, {quote(rx)}, {g}) <> '' THEN regexp_extract(text, {quote(rx)}, {g}) ELSE regexp_extract(text, {quote(rx)}, 0) END AS value FROM {VALUE_LINES}" for i, (c, _, rx, _, _, g) in enumerate(dims.EXTENDED)
)


@query(f"SELECT pattern_category, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT DISTINCT pattern_category, path, value FROM ({EXTENDED_SQL}) WHERE value <> '') GROUP BY 1")
def extended_counts(spark, sf_dir):
    found = detect.extended_findings(value_lines(spark, sf_dir))
    return found.groupBy("pattern_category").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


R1, R2, R3 = dims.RULES
RULE2 = "CASE " + " ".join(f"WHEN regexp_matches(value, {quote(rx)}) THEN {quote(n)}" for n, rx in R2["values"]) + " END"
RULE3 = "CASE " + " ".join(f"WHEN regexp_matches(value, {quote(rx)}) THEN {quote(n)}" for n, rx in R3["values"]) + " END"


@query(f"""SELECT path, line, variable, value, rule_id, type, pattern FROM (
SELECT path, line, variable, value, '{R1['id']}' AS rule_id, 'variable_name_match' AS type, NULL::VARCHAR AS pattern FROM {FIND}
WHERE regexp_matches(variable, {quote(R1['names'])}) AND NOT regexp_matches(variable, {quote(R1['not_names'])}) AND length(value) >= 6 AND NOT regexp_matches(value, {quote(R1['not_values'])})
UNION ALL SELECT path, line, variable, value, '{R2['id']}', 'value_pattern_match', {RULE2} FROM {FIND} WHERE length(value) >= 16 AND {RULE2} IS NOT NULL AND NOT regexp_matches(value, {quote(R2['not_values'])})
UNION ALL SELECT path, line, variable, value, '{R3['id']}', 'value_pattern_match', {RULE3} FROM {FIND} WHERE length(value) >= 8 AND {RULE3} IS NOT NULL AND NOT regexp_matches(value, {quote(R3['not_values'])}))""")
def rule_findings(spark, sf_dir):
    items = findings(spark, sf_dir).select("path", "line", F.col("variable").alias("key"), "value")
    return detect.rule_findings(items).select("path", "line", "variable", "value", "rule_id", "type", "pattern")


def entropy_sql(v: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -((length({v}) - length(replace({v}, c, '')))::DOUBLE / length({v})) * log2((length({v}) - length(replace({v}, c, '')))::DOUBLE / length({v})))), 0)"


ENCODING = f"""CASE WHEN regexp_matches(trim(value), '^[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*$') THEN 'jwt' WHEN regexp_matches(trim(value), '^{X.UUID}$') THEN 'uuid'
WHEN length(trim(value)) >= 16 AND regexp_matches(trim(value), '^[A-Za-z0-9+/]*={{0,2}}$') AND length(trim(value)) % 4 = 0 THEN 'base64' WHEN length(trim(value)) >= 16 AND regexp_matches(trim(value), '^[0-9a-fA-F]+$') THEN 'hex'
WHEN regexp_matches(trim(value), '^[A-Za-z0-9]+$') THEN 'api_key' ELSE 'generic' END"""


@query(f"SELECT value, round({entropy_sql('value')}, 6) AS entropy, round(coalesce({entropy_sql('printable')}, 0), 6) AS printable_entropy, round(len(list_distinct(string_split(value, '')))::DOUBLE / length(value), 6) AS diversity, {ENCODING} AS encoding FROM (SELECT DISTINCT value, regexp_replace(value, '[^\\x21-\\x7E]', '', 'g') AS printable FROM {FIND})")
def entropy_scores(spark, sf_dir):
    v = F.col("value")
    return findings(spark, sf_dir).select("value").distinct().select(v, F.round(X.entropy(v), 6).alias("entropy"), F.round(X.printable_entropy(v), 6).alias("printable_entropy"), F.round(X.diversity(v), 6).alias("diversity"), X.encoding_type(v).alias("encoding"))


NAME_CONTEXT = "CASE WHEN variable = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(lower(variable), '{'|'.join(ws)}') THEN '{k}'" for k, ws in X.NAME_CONTEXTS.items()) + " WHEN regexp_matches(lower(path), 'docker|k8s|kubernetes') THEN 'container' WHEN regexp_matches(lower(path), '\\.env|config|settings') THEN 'config' ELSE 'generic' END"


@query(f"SELECT path, variable, {NAME_CONTEXT} AS context FROM (SELECT DISTINCT path, variable FROM {FIND})")
def name_contexts(spark, sf_dir):
    x = findings(spark, sf_dir).select("path", "variable").distinct()
    return x.select("path", "variable", X.name_context(F.col("variable"), F.col("path")).alias("context"))


ASSIGN_SQL = " UNION ALL ".join(f"SELECT path, line, unnest(regexp_extract_all(text, {quote(rx)}, 1)) AS variable, unnest(regexp_extract_all(text, {quote(rx)}, 2)) AS value FROM t" for rx in detect.ASSIGNMENTS)


@query(f"""WITH t AS (SELECT path, line::INT AS line, trim(text) AS text FROM (SELECT * FROM {CODES} UNION ALL SELECT * FROM {LINES}) WHERE NOT regexp_matches(trim(text), '^(#|//|/\\*|$)'))
SELECT * FROM ({ASSIGN_SQL}) WHERE length(value) >= 8 UNION ALL SELECT path, line, '', unnest(regexp_extract_all(text, {quote(detect.STANDALONE)}, 1)) FROM t""")
def entropy_candidates(spark, sf_dir):
    return detect.entropy_candidates(frame(spark, sf_dir, CODE).union(S.lines(doc_files(spark, sf_dir))))


def table_sql(values: dict[str, float]) -> str:
    return "CASE encoding " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {values['generic']} END"


HARMLESS = f"""(regexp_matches(value, '^{X.UUID}$') OR regexp_matches(value, '(?i)^(sha(1|224|256|384|512)|md5)[-:]') OR regexp_matches(value, '^([0-9a-fA-F]{{32}}|[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}})$')
OR lower(value) IN ('password', 'username', 'token', 'secret', 'key', 'localhost', 'example', 'test', 'demo') OR regexp_matches(lower(value), '\\.(jpg|png|gif|pdf|doc|zip|tar|gz)$')
OR (regexp_matches(value, '^https?://') AND NOT contains(value, '@')) OR regexp_matches(value, '^\\$\\{{?\\w+\\}}?$') OR regexp_matches(lower(value), '^(xxx+|###|...|todo|fixme|changeme)$')
OR (len(list_distinct(string_split(value, ''))) <= 3 AND length(value) > 8) OR regexp_matches(value, '^[0-9]+$') OR regexp_matches(value, '^\\pL+$'))"""


@query(f"""WITH a AS (SELECT path, line, variable, value, {ENCODING} AS encoding, {NAME_CONTEXT} AS context, {entropy_sql('value')} AS bits, len(list_distinct(string_split(value, '')))::DOUBLE / length(value) AS variety FROM {FIND} WHERE NOT {HARMLESS}),
b AS (SELECT *, least(1.0, round(CASE WHEN bits >= {table_sql(X.ENTROPY_AT)} THEN 0.4 ELSE 0 END + CASE WHEN variety >= 0.7 THEN 0.2 ELSE 0 END + CASE WHEN length(value) >= {table_sql(X.LENGTH_AT)} AND length(value) <= 200 THEN 0.1 ELSE 0 END
  + CASE WHEN encoding IN ('base64', 'jwt', 'hex') THEN 0.2 ELSE 0 END + CASE WHEN context IN ('api_key', 'secret', 'auth') THEN 0.1 ELSE 0 END, 6)::DOUBLE)::DOUBLE AS confidence FROM a)
SELECT path, line, variable, value, encoding AS encoding_type, context AS context_type, confidence, round(bits, 2) AS entropy, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS severity
FROM b WHERE bits >= {table_sql(X.ENTROPY_AT)} AND length(value) >= {table_sql(X.LENGTH_AT)} AND confidence >= 0.5""")
def entropy_findings(spark, sf_dir):
    x = detect.entropy_findings(findings(spark, sf_dir).select("path", "line", "variable", "value"))
    return x.select("path", "line", "variable", "value", "encoding_type", "context_type", "confidence", "entropy", "severity")


@query(f"""WITH i AS (SELECT path, line, variable, value, {entropy_sql('value')} AS h FROM {FIND} WHERE length(value) BETWEEN 8 AND 120 AND lower(value) NOT IN ('true', 'false', 'null', 'none', 'undefined')),
f AS (SELECT DISTINCT path, value FROM {FIND} WHERE severity = 'high')
SELECT path, value, min(line)::INT AS line, round(any_value(h), 2) AS entropy FROM i ANTI JOIN f USING (path, value) WHERE h >= 4.0 + CASE WHEN length(value) < 12 THEN 0.5 ELSE 0 END GROUP BY path, value""")
def legacy_entropy(spark, sf_dir):
    x = findings(spark, sf_dir)
    items = x.select("path", "line", F.col("variable").alias("key"), "value")
    return detect.legacy_entropy_findings(items, x.where("severity = 'high'")).select("path", "value", "line", "entropy")


TECH_VALUES = ", ".join(f"({quote(t)}, {quote(w)}, '{s}')" for t, w, s in sorted({(t, w, s) for t, (_, s, words) in dims.TECHNOLOGIES.items() for w in words.split()}))
TECH_OF = "CASE WHEN path LIKE '%Dockerfile' THEN ['Docker/Containers'] WHEN path LIKE 'k8s%' THEN ['Kubernetes'] WHEN path LIKE 'ci%' THEN ['CI/CD Platforms'] WHEN path LIKE '%.tf' THEN ['Infrastructure as Code'] WHEN path LIKE '%.npmrc' THEN ['Package Managers'] ELSE [] END"


@query(f"""WITH kw(technology, keyword, severity) AS (VALUES {TECH_VALUES}),
c AS (SELECT path, line, lower(word) AS w, value, {TECH_OF} AS own FROM {TECHS} WHERE length(value) >= 8 AND NOT contains(value, 'test'))
SELECT DISTINCT path, line, keyword AS variable, value, technology AS category, CASE WHEN regexp_matches(keyword, 'private_key|secret_key|password|token') THEN 'critical' ELSE severity END AS severity,
round(least(1.0, 0.8 + CASE WHEN length(value) >= 32 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(keyword, 'api_key|secret_key|private_key|token') THEN 0.1 ELSE 0 END)::DOUBLE, 6)::DOUBLE AS confidence
FROM c JOIN kw ON (w = keyword OR w LIKE '%\\_' || keyword ESCAPE '\\') AND list_contains(own, technology)""")
def technology_findings(spark, sf_dir):
    lines = frame(spark, sf_dir, TECH).select("path", "line", F.concat(F.lit("  export "), "word", F.lit("='"), "value", F.lit("'")).alias("text"))
    return detect.technology_findings(lines, dims.technology_keywords(spark)).select("path", "line", "variable", "value", "category", "severity", "confidence")


WEB_RX = f"(?i)\\b({'|'.join(dims.GENERAL)})\\b\\s*[:=]\\s*[\"'']?([A-Za-z0-9_./+=-]{{8,}})[\"'']?"


@query(f"""WITH p AS (SELECT url, replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS plain FROM pages),
l AS (SELECT url AS path, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS text FROM (SELECT url, string_split(plain, chr(10)) AS l FROM p))
SELECT DISTINCT path, line, lower(unnest(regexp_extract_all(text, '{WEB_RX}', 1))) AS variable, unnest(regexp_extract_all(text, '{WEB_RX}', 2)) AS value FROM l WHERE NOT regexp_matches(text, {quote(detect.WEB_HARMLESS)})""")
def web_findings(spark, sf_dir):
    return detect.web_findings(table(spark, sf_dir, "pages")).select("path", "line", "variable", "value")


# Context


def context_sql(group: str) -> str:
    return "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(text, {quote('(?im)' + rx)}) THEN ['{n}'] ELSE [] END" for g, n, _, rx in dims.CONTEXTS if g == group) + ")"


def windows_sql(rows: str) -> str:
    """Contexts of every line of rows (path, line, text), from the joined text of its window."""
    frames = {"code": (5, 5), "config": (9, 5), "api": (10, 10)}
    texts = ", ".join(f"string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS {g}_text" for g, (a, b) in frames.items())
    named = {g: f"array_to_string(list_sort({context_sql(g).replace('regexp_matches(text', f'regexp_matches({g}_text')}), ',')" for g in frames}
    return f"SELECT path, line::INT AS line, {named['code']} AS code, CASE WHEN regexp_matches(path, {quote(context.CONFIG_FILE)}) THEN {named['config']} ELSE '' END AS config, {named['api']} AS api FROM (SELECT path, line, {texts} FROM {rows})"


@query(windows_sql(CODES))
def context_windows(spark, sf_dir):
    lines = frame(spark, sf_dir, CODE)
    x = context.line_contexts(lines, lines)
    return x.select("path", "line", *[F.array_join(F.array_sort(g), ",").alias(g) for g in ("code", "config", "api")])


# Lines whose contexts go over line ends.
SPLIT_CODE = """
SELECT concat(CASE WHEN o_custkey % 2 = 0 THEN 'config/s' ELSE 'src/s' END, CAST(o_custkey AS STRING), '.yml') AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS line,
  CASE CAST(o_orderkey % 17 AS INT) WHEN 0 THEN 'try' WHEN 1 THEN '  {' WHEN 2 THEN 'const' WHEN 3 THEN 'LIMIT' WHEN 4 THEN '' WHEN 5 THEN 'redis' WHEN 6 THEN '  : 1' WHEN 7 THEN 'signature' WHEN 8 THEN 'verification' WHEN 9 THEN 'query'
       WHEN 10 THEN 'lambda' WHEN 11 THEN ', x' WHEN 12 THEN 'bearer' WHEN 13 THEN 'token' WHEN 14 THEN 'api.a' WHEN 15 THEN 'b.com' ELSE 'y' END AS text
FROM {orders}
"""


@query(windows_sql(f"({duck(SPLIT_CODE)})"))
def contexts_over_lines(spark, sf_dir):
    lines = frame(spark, sf_dir, SPLIT_CODE)
    x = context.line_contexts(lines, lines)
    return x.select("path", "line", *[F.array_join(F.array_sort(g), ",").alias(g) for g in ("code", "config", "api")])


@query(f"""WITH s AS (SELECT path, line, coalesce(nullif(regexp_extract(text, '^\\s*([a-zA-Z_][a-zA-Z0-9_]*):', 1), ''), nullif(regexp_extract(text, '^\\s*\\[([^\\]]+)\\]', 1), ''), nullif(regexp_extract(text, '^\\s*"([^"]+)"\\s*:', 1), '')) AS own FROM {CODES})
SELECT path, line, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 'root') AS section FROM s""")
def config_sections(spark, sf_dir):
    return context.config_section(frame(spark, sf_dir, CODE))


FILE_CONTEXT = "list_concat(" + ", ".join([f"CASE WHEN regexp_matches(lower(path), '{rx}') THEN ['{n}'] ELSE [] END" for g, n, _, rx in dims.CONTEXTS if g == "file"] + [f"CASE WHEN contains(regexp_extract(lower(path), '[^/]*$', 0), '{k}') THEN ['{n}'] ELSE [] END" for k, (n, _) in dims.SPECIAL_FILES.items()]) + ")"
MODIFIERS = {n: m for g, n, m, _ in dims.CONTEXTS if g == "file"} | {n: m for n, m in dims.SPECIAL_FILES.values()}
MOD_CASE = "CASE c " + " ".join(f"WHEN '{n}' THEN {m}::DOUBLE" for n, m in MODIFIERS.items()) + " END"
MODIFIER_SQL = "CASE WHEN len(m) = 0 THEN 1.0 ELSE greatest(0.1, least(2.0, round(CASE WHEN len(m) = 1 THEN m[1] ELSE m[1] * 0.5 + m[2] * 0.3 + CASE WHEN len(m) > 2 THEN list_sum(m[3:]) * 0.2 / (len(m) - 2) ELSE 0 END END, 9))) END::DOUBLE"
RISK_SQL = "CASE WHEN list_contains(c, 'production_indicators') THEN 'high' WHEN list_contains(c, 'staging_indicators') THEN 'medium' WHEN list_contains(c, 'test_indicators') OR list_contains(c, 'development_indicators') THEN 'low' WHEN modifier >= 1.5 THEN 'high' WHEN modifier >= 1.0 THEN 'medium' ELSE 'low' END"
FILE_RISK = f"(SELECT *, {RISK_SQL} AS risk FROM (SELECT *, {MODIFIER_SQL} AS modifier FROM (SELECT *, list_reverse_sort(list_transform(c, lambda c: {MOD_CASE})) AS m FROM (SELECT path, {FILE_CONTEXT} AS c FROM (SELECT DISTINCT path FROM {FIND})))))"


@query(f"SELECT path, array_to_string(c, ',') AS contexts, round(modifier, 6) AS modifier, risk FROM {FILE_RISK}")
def file_risk(spark, sf_dir):
    x = findings(spark, sf_dir).select("path").distinct().withColumn("c", context.file_contexts(F.col("path")))
    x = x.withColumn("m", context.combined_modifier(context.modifiers(F.col("c"), "file")))
    return x.select("path", F.array_join("c", ",").alias("contexts"), F.round("m", 6).alias("modifier"), context.risk_level(F.col("c"), F.col("m")).alias("risk"))


@query(f"""SELECT ord, CASE WHEN p = 0 THEN severity WHEN risk = 'high' AND confidence > 0.8 THEN s[least(p + 1, 5)] WHEN risk = 'low' OR confidence < 0.3 THEN s[CASE WHEN p > 2 THEN p - 1 ELSE p END] ELSE severity END AS severity
FROM (SELECT ord, severity, confidence, risk, ['info', 'low', 'medium', 'high', 'critical'] AS s, coalesce(list_position(['info', 'low', 'medium', 'high', 'critical'], severity), 0)::INT AS p FROM {FIND} JOIN {FILE_RISK} USING (path))""")
def severity_adjusted(spark, sf_dir):
    x = findings(spark, sf_dir).withColumn("c", context.file_contexts(F.col("path")))
    x = x.withColumn("m", context.combined_modifier(context.modifiers(F.col("c"), "file")))
    return x.select("ord", context.adjusted_severity(F.col("severity"), context.risk_level(F.col("c"), F.col("m")), F.col("confidence")).alias("severity"))


# Scores


def factor_sql() -> str:
    v, x = "lower(variable)", "value"
    doubtful = quote(score.DOUBTFUL)
    pattern = f"least(CASE WHEN regexp_matches({v}, {quote(score.TELLING_NAME)}) OR regexp_matches({x}, {quote(score.TELLING_NAME)}) OR regexp_matches({x}, {quote(score.TELLING_VALUE)}) OR regexp_matches({v}, {quote(score.TELLING_VALUE)}) THEN 0.9 WHEN regexp_matches({v}, {quote(score.USUAL_NAME)}) THEN 0.7 ELSE 0.5 END, CASE WHEN regexp_matches({v}, {doubtful}) OR regexp_matches({x}, {doubtful}) THEN 0.3 ELSE 1.0 END) + CASE WHEN contains(lower(pattern), 'generic') THEN 0.0 ELSE 0.1 END"
    env = "CASE WHEN regexp_matches(lower(path) || chr(10) || lower(variable), 'prod|live|release') THEN 0.8 WHEN regexp_matches(lower(path) || chr(10) || lower(variable), 'test|dev|staging|demo|example') THEN 0.6 ELSE 0.5 END + CASE WHEN regexp_matches(lower(path), '\\.env|config|settings|\\.yaml|\\.json') THEN 0.1 ELSE 0.0 END"
    val = "CASE WHEN length(value) < 8 THEN 0.2 WHEN length(value) > 256 THEN 0.3 WHEN length(value) BETWEEN 16 AND 128 THEN 0.8 ELSE 0.5 END"
    val = f"CASE WHEN regexp_matches(value, '(?i)^(true|false|yes|no|null|undefined|none)$|^\\d{{1,4}}$|^[a-zA-Z]\\w*$|^https?://') THEN least(0.2, {val}) ELSE {val} END"
    val = f"CASE WHEN regexp_matches(value, '^[A-Za-z0-9+/]{{20,}}={{0,2}}$') OR regexp_matches(value, '^[0-9a-f]{{32,}}$') THEN greatest(0.7, {val}) WHEN regexp_matches(value, '^[A-Za-z0-9_-]{{20,}}$') THEN greatest(0.6, {val}) ELSE {val} END"
    return f"least(1.0, {pattern})::DOUBLE AS pattern_factor, ({env})::DOUBLE AS environment_factor, ({val})::DOUBLE AS validation_factor"


SCORES = f"(SELECT *, round(round(round(pattern_factor * 0.3 + environment_factor * 0.05 + validation_factor * 0.05, 9) / 0.4, 9), 3)::DOUBLE AS oc FROM (SELECT ord, {factor_sql()} FROM {FIND}))"
LEVEL = "CASE WHEN oc >= 0.8 THEN 'HIGH' WHEN oc >= 0.6 THEN 'MEDIUM-HIGH' WHEN oc >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


def _scores(spark, sf_dir):
    return score.scored(findings(spark, sf_dir), use_entropy=False)


@query(f"SELECT ord, greatest(0.1, least(1.0, oc))::DOUBLE AS overall_confidence, {LEVEL} AS confidence_level FROM {SCORES}")
def overall_confidence(spark, sf_dir):
    return _scores(spark, sf_dir).select("ord", "overall_confidence", "confidence_level")


@query(f"SELECT {LEVEL} AS confidence_level, count(*) AS n FROM {SCORES} JOIN {FIND} USING (ord) WHERE confidence >= 0.2 AND NOT (oc > 0 AND oc < 0.6) GROUP BY 1")
def confidence_filter(spark, sf_dir):
    return score.confident(_scores(spark, sf_dir), 0.2, 0.6).groupBy("confidence_level").agg(F.count("*").alias("n"))


@query(f"SELECT ord, list_reverse_sort([{{'s': round(pattern_factor * 0.3, 9), 'f': 'pattern'}}, {{'s': round(environment_factor * 0.05, 9), 'f': 'environment'}}, {{'s': round(validation_factor * 0.05, 9), 'f': 'validation'}}])[1].f AS strongest FROM {SCORES}")
def strongest_factor(spark, sf_dir):
    return _scores(spark, sf_dir).select("ord", F.get(score.top_factors(F.col("confidence_factors")), F.lit(0))["factor"].alias("strongest"))


ENTROPY_FACTOR = f"greatest(0.0, least(1.0, round(CASE WHEN h >= 5 THEN 0.9 WHEN h >= 4 THEN 0.8 WHEN h >= 3.5 THEN 0.7 WHEN h >= 3 THEN 0.6 ELSE 0.4 END + CASE encoding WHEN 'base64' THEN 0.1 WHEN 'hex' THEN 0.05 WHEN 'jwt' THEN 0.15 WHEN 'uuid' THEN 0.1 ELSE 0 END + CASE WHEN d >= 0.8 THEN 0.1 WHEN d <= 0.3 THEN -0.1 ELSE 0 END, 6)))::DOUBLE"


@query(f"SELECT value, {ENTROPY_FACTOR} AS factor FROM (SELECT value, round({entropy_sql('value')}, 6) AS h, {ENCODING} AS encoding, round(len(list_distinct(string_split(value, '')))::DOUBLE / length(value), 6) AS d FROM (SELECT DISTINCT value FROM {FIND}))")
def entropy_factors(spark, sf_dir):
    v = F.col("value")
    x = findings(spark, sf_dir).select("value").distinct()
    return x.select("value", score.entropy_factor(F.round(X.entropy(v), 6), X.encoding_type(v), F.round(X.diversity(v), 6)).alias("factor"))


CONTEXT_FACTOR = "greatest(0.0, least(1.0, round(CASE WHEN modifier >= 1.5 THEN 0.9 WHEN modifier >= 1.2 THEN 0.8 WHEN modifier >= 1.0 THEN 0.7 WHEN modifier >= 0.8 THEN 0.5 ELSE 0.3 END + CASE risk WHEN 'high' THEN 0.1 WHEN 'low' THEN -0.1 ELSE 0 END, 6)))::DOUBLE"
TECHNOLOGY_FACTOR = "CASE pattern_category WHEN 'aws' THEN 0.9::DOUBLE WHEN 'email' THEN confidence END"


def _all_factors_sql() -> str:
    mixed = "round(round(round(pattern_factor * 0.3 + cf * 0.25 + ef * 0.2 + coalesce(tf * 0.15, 0) + environment_factor * 0.05 + validation_factor * 0.05, 9) / CASE WHEN tf IS NULL THEN 0.85 ELSE 1.0 END, 9), 3)"
    values = f"(SELECT value, {ENTROPY_FACTOR} AS ef FROM (SELECT value, round({entropy_sql('value')}, 6) AS h, {ENCODING} AS encoding, round(len(list_distinct(string_split(value, '')))::DOUBLE / length(value), 6) AS d FROM (SELECT DISTINCT value FROM {FIND})))"
    return f"SELECT ord, oc AS overall_confidence, {LEVEL} AS confidence_level FROM (SELECT ord, greatest(0.1, least(1.0, {mixed}))::DOUBLE AS oc FROM (SELECT ord, {CONTEXT_FACTOR} AS cf, {TECHNOLOGY_FACTOR} AS tf, ef, {factor_sql()} FROM {FIND} JOIN {FILE_RISK} USING (path) JOIN {values} USING (value)))"


@query(_all_factors_sql())
def overall_confidence_all_factors(spark, sf_dir):
    c, v = F.col, F.col("value")
    x = findings(spark, sf_dir).withColumn("contexts", context.file_contexts(c("path")))
    x = x.withColumn("context_modifier", context.combined_modifier(context.modifiers(c("contexts"), "file"))).withColumn("risk_level", context.risk_level(c("contexts"), c("context_modifier")))
    x = x.withColumns({"entropy": F.round(X.entropy(v), 6), "encoding_type": X.encoding_type(v), "diversity": F.round(X.diversity(v), 6), "technology": F.when(c("pattern_category") == "aws", "aws").when(c("pattern_category") == "email", "mail")})
    return score.scored(x).select("ord", "overall_confidence", "confidence_level")


# Groups, tests, summaries


@query(f"SELECT path, line, variable, value, ord, confidence, severity FROM {FIND} QUALIFY row_number() OVER (PARTITION BY path, line, variable, value ORDER BY confidence DESC, ord) = 1")
def dedup_highest_confidence(spark, sf_dir):
    x = findings(spark, sf_dir).select("path", "line", "variable", "value", "ord", "confidence", "severity")
    return merge.highest_confidence(x, ["path", "line", "variable", "value"], ["ord"])


@query(f"SELECT path, pattern_category, value, min(line)::INT AS line FROM {FIND} GROUP BY ALL")
def first_in_file(spark, sf_dir):
    x = findings(spark, sf_dir).select("path", "pattern_category", "value", "line", "ord")
    return detect.first_in_file(x, ["line", "ord"]).drop("ord")


RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 1 END"
GROUP_KEY = "substr(md5(regexp_replace(lower(value), '[\"\\s=:]', '', 'g') || ':' || path || ':' || (line // 5 * 5)), 1, 16)"
CONSENSUS = "CASE WHEN m >= 3.5 THEN 'critical' WHEN m >= 2.5 THEN 'high' WHEN m >= 1.5 THEN 'medium' WHEN m >= 0.5 THEN 'low' ELSE 'info' END"
GROUPS = f"(SELECT {GROUP_KEY} AS group_key, count(*) AS detection_count, max(confidence) AS confidence, round(avg({RANK}), 6) AS m, array_to_string(list_sort(list_distinct(list(rule_name))), ',') AS rule_names, any_value(severity) AS one FROM {FIND} GROUP BY 1)"


@query(f"SELECT group_key, detection_count, confidence, rule_names, CASE WHEN detection_count > 1 THEN {CONSENSUS} ELSE one END AS severity FROM {GROUPS}")
def group_merge(spark, sf_dir):
    return merge.merged(findings(spark, sf_dir)).select("group_key", "detection_count", "confidence", F.array_join("rule_names", ",").alias("rule_names"), "severity")


REPEATS = "|".join(f"{c}{{4}}" for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
REFERENCE_SQL = f"""CASE WHEN value = '' THEN false WHEN regexp_matches(rhs, {quote(C.REFERENCE)}) THEN true WHEN regexp_matches(bare, {quote(C.PROVIDER)}) THEN false WHEN regexp_matches(rhs, '^["'']') THEN false
WHEN regexp_matches(bare, '^[A-Za-z_][A-Za-z0-9_]*\\s*[(\\[]') OR regexp_matches(bare, '^[A-Za-z_][A-Za-z0-9_]*\\.[A-Za-z_][A-Za-z0-9_]*\\s*\\(') THEN true ELSE regexp_matches(bare, '^[A-Za-z_]+$') END"""
RHS = f"(SELECT *, regexp_replace(rhs, '[,)]+$', '') AS bare FROM (SELECT *, trim(regexp_replace(coalesce(nullif(trim(regexp_extract(value, '[:=]\\s*(.+)$', 1)), ''), value), '\\s+#.*$', '')) AS rhs FROM {FIND}))"
POINTS = f"""(SELECT ord, severity, least(1.0, round(CASE WHEN {REFERENCE_SQL} THEN 0.9 ELSE 0 END + CASE WHEN regexp_replace(value, '["\\s=:]+', '', 'g') IN ('dummy', 'example', 'sample', 'placeholder', 'changeme', 'default', 'password', 'admin') THEN 0.9 ELSE 0 END
+ CASE WHEN regexp_matches(value, {quote(C.PLACEHOLDER)}) THEN 0.9 ELSE 0 END + CASE WHEN regexp_matches(value, {quote(C.TEST_PATTERN)}) THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(variable, {quote(C.TEST_PATTERN)}) THEN 0.2 ELSE 0 END
+ CASE WHEN regexp_matches(lower(path), 'test|example|sample|mock') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(lower(description), 'example|test|sample|demo') THEN 0.2 ELSE 0 END
+ CASE WHEN length(value) < 8 OR len(list_distinct(string_split(lower(value), ''))) < length(value) * 0.4 OR regexp_matches(value, '{REPEATS}') OR regexp_matches(value, '12|23|34|45|56|67|78|89|90|01') OR regexp_matches(lower(value), 'abc|def|test|example') THEN 0.1 ELSE 0 END, 6))::DOUBLE AS p FROM {RHS})"""


@query(f"SELECT ord, {REFERENCE_SQL} AS is_reference FROM {RHS}")
def secret_references(spark, sf_dir):
    return findings(spark, sf_dir).select("ord", C.is_reference(F.col("value")).alias("is_reference"))


@query(f"SELECT ord, p AS test_confidence, p > 0.3 AS is_test_credential, CASE WHEN p > 0.3 THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END ELSE severity END AS severity FROM {POINTS}")
def test_credentials(spark, sf_dir):
    return merge.with_test_flag(findings(spark, sf_dir)).select("ord", "test_confidence", "is_test_credential", "severity")


@query(f"SELECT count(*) AS total, count(DISTINCT regexp_replace(value, '[\"\\s=:]+', '', 'g')) AS distinct_values, 0::BIGINT AS duplicate_groups, count_if(p > 0.3)::BIGINT AS tests, count_if(p <= 0.3)::BIGINT AS real, " + ", ".join(f"count_if(CASE WHEN p > 0.3 THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END ELSE severity END = '{s}')::BIGINT AS {s}" for s in dims.SEVERITIES) + f" FROM (SELECT ord, p, severity FROM {POINTS}) JOIN (SELECT ord, value FROM {FIND}) USING (ord)")
def finding_summary(spark, sf_dir):
    return merge.summary(merge.with_test_flag(findings(spark, sf_dir)))


@query(f"SELECT severity, count(*) AS n, count(DISTINCT path) AS n_files FROM {FIND} GROUP BY 1")
def severity_counts(spark, sf_dir):
    return report.severity_counts(findings(spark, sf_dir))


@query(f"SELECT ord, severity, confidence, path, line FROM {FIND} ORDER BY {RANK} DESC, confidence DESC, path, line, value, ord LIMIT 50")
def top_findings(spark, sf_dir):
    x = findings(spark, sf_dir)
    return x.orderBy(merge.rank_of(F.col("severity")).desc(), F.col("confidence").desc(), "path", "line", "value", "ord").select("ord", "severity", "confidence", "path", "line").limit(50)


PR = f"(SELECT DISTINCT path, line FROM {FIND} WHERE severity IN ('high', 'critical'))", f"(SELECT DISTINCT path, line FROM {FIND} WHERE confidence >= 0.5)"


@query(f"""SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM (
SELECT (SELECT count(*) FROM {PR[0]} SEMI JOIN {PR[1]} t USING (path, line)) AS tp, (SELECT count(*) FROM {PR[0]} ANTI JOIN {PR[1]} t USING (path, line)) AS fp, (SELECT count(*) FROM {PR[1]} ANTI JOIN {PR[0]} t USING (path, line)) AS fn)""")
def detection_quality(spark, sf_dir):
    x = findings(spark, sf_dir)
    return merge.quality(x.where("severity in ('high', 'critical')"), x.where("confidence >= 0.5"))


# Baseline

EXACT = f"(SELECT path, line, value, min('x' || ord) AS id FROM {FIND} WHERE ord % 17 = 0 GROUP BY ALL)"
EXCLUSION = f"(SELECT f.*, coalesce(e.id, CASE WHEN regexp_matches(f.value, '^pass\\d') THEN 'p1' WHEN regexp_matches(f.value, '^changeme$') THEN 'p2' END, CASE WHEN regexp_matches(f.path, 'lib/test/') THEN 'd1' END) AS exclusion_id FROM {FIND} f LEFT JOIN {EXACT} e USING (path, line, value))"


def _baseline(spark, sf_dir):
    x = findings(spark, sf_dir)
    known = x.where("ord % 17 = 0").select(F.concat(F.lit("x"), F.col("ord").cast("string")).alias("id"), "path", "line", F.sha2("value", 256).alias("value_hash"), F.lit("seen").alias("reason"))
    return x, {"exact": known, "patterns": [("p1", "^pass\\d", "generated"), ("p2", "^changeme$", "stand-in")], "paths": [("d1", "lib/test/", "tests")]}


@query(f"SELECT ord, exclusion_id FROM {EXCLUSION} WHERE exclusion_id IS NOT NULL")
def baseline_matched(spark, sf_dir):
    x, known = _baseline(spark, sf_dir)
    return baseline.with_exclusions(x, **known).where("excluded").select("ord", "exclusion_id")


@query(f"SELECT ord FROM {EXCLUSION} WHERE exclusion_id IS NULL")
def baseline_reported(spark, sf_dir):
    x, known = _baseline(spark, sf_dir)
    return baseline.reported(x, **known).select("ord")


@query(f"SELECT DISTINCT substr(sha256(rule_id || '|' || path || '|' || line || '|' || sha256(value)), 1, 16) AS id, path, line, sha256(value) AS value_hash FROM {FIND}")
def baseline_written(spark, sf_dir):
    return baseline.baseline_of(findings(spark, sf_dir)).select("id", "path", "line", "value_hash")


# Reports


@query(f"SELECT ord, CASE WHEN length(value) <= 8 THEN '****' ELSE substr(value, 1, 4) || '...' || right(value, 4) END AS masked, substr(sha256(rule_id || '|' || path || '|' || CASE WHEN length(value) <= 8 THEN '****' ELSE substr(value, 1, 4) || '...' || right(value, 4) END), 1, 32) AS fingerprint FROM {FIND}")
def masks_and_fingerprints(spark, sf_dir):
    return findings(spark, sf_dir).select("ord", X.mask(F.col("value")).alias("masked"), X.fingerprint(F.col("rule_id"), F.col("path"), F.col("value")).alias("fingerprint"))


HAY = "lower(pattern_category || ' ' || category || ' ' || rule_name || ' ' || type)"
KIND = f"CASE WHEN regexp_matches({HAY}, 'private key|rsa|pem') THEN 'private_keys' " + " ".join(f"WHEN pattern_category = '{a}' THEN '{k}'" for a, k in C.ALIASES.items()) + " " + " ".join(f"WHEN regexp_matches({HAY}, '{rx}') THEN '{k}'" for rx, k in C.HINTS) + " ELSE 'generic' END"
CWE = "CASE WHEN k = 'private_keys' THEN 'CWE-321' WHEN k = 'database' OR contains(lower(rule_name || ' ' || type || ' ' || description), 'password') THEN 'CWE-259' ELSE 'CWE-798' END"
KINDS = f"(SELECT *, {CWE} AS cwe FROM (SELECT *, {KIND} AS k FROM {FIND}))"
CONTROL_VALUES = ", ".join(f"({quote(c)}, {quote(f)}, {quote(r)})" for c, (f, r) in dims.CONTROLS.items())


@query(f"""WITH c(control, framework, requirement) AS (VALUES {CONTROL_VALUES}) SELECT path, line, rule_id, severity, control, framework, requirement FROM (
SELECT path, line, rule_id, severity, unnest(list_concat([cwe, 'NIST 800-53 IA-5(7)', 'PCI-DSS 8.6.2', 'OWASP ASVS V2.10', 'SOC 2 CC6.1'], CASE WHEN k IN ('aws', 'gcp', 'github', 'slack', 'stripe') THEN ['PCI-DSS 6.3.1'] ELSE [] END, CASE WHEN cwe = 'CWE-321' THEN ['ISO 27001 A.8.24'] ELSE [] END)) AS control FROM {KINDS}) JOIN c USING (control)""")
def compliance_rows(spark, sf_dir):
    return report.compliance(spark, findings(spark, sf_dir)).select("path", "line", "rule_id", "severity", "control", "framework", "requirement")


@query(f"SELECT severity, path, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM {FIND} GROUP BY ALL")
def findings_by_file(spark, sf_dir):
    return report.by_file(findings(spark, sf_dir))


REMEDIES = ", ".join(f"({quote(k)}, {quote(a)}, {quote(r)}, {quote(c)})" for k, (a, r, c) in dims.REMEDIATION.items())


@query(f"WITH r(k, action, revoke, cure) AS (VALUES {REMEDIES}) SELECT ord, k AS remediation_key, 'Action: ' || action || CASE WHEN revoke <> '' THEN ' | Revoke: ' || revoke ELSE '' END || ' | Fix: ' || cure AS remediation FROM {KINDS} JOIN r USING (k)")
def remediation_join(spark, sf_dir):
    return report.with_remediation(spark, findings(spark, sf_dir)).select("ord", "remediation_key", report.remediation_text().alias("remediation"))


@query(f"""WITH r(k, action, revoke, cure) AS (VALUES {REMEDIES}) SELECT severity, rule_name AS type, pattern_category AS category, path AS file, line, CASE WHEN length(value) <= 8 THEN '****' ELSE substr(value, 1, 4) || '...' || right(value, 4) END AS masked,
round(confidence, 3) AS confidence, rule_id AS detector, 'not run' AS validation, '' AS breach_exposure, action AS remediation, cure AS remediation_fix FROM {KINDS} JOIN r USING (k)""")
def public_findings(spark, sf_dir):
    return report.public(spark, findings(spark, sf_dir))


@query(f"SELECT ord, cwe, CASE WHEN regexp_matches(h, 'private key|private_key|rsa|pem|crypto|certificate') THEN 'CWE-321' WHEN regexp_matches(h, 'passwd|password') THEN 'CWE-259' ELSE 'CWE-798' END AS report_cwe FROM (SELECT *, lower(rule_name || ' ' || pattern_category || ' ' || type || ' ' || description) AS h FROM {KINDS})")
def cwe_mapping(spark, sf_dir):
    c = F.col
    key = C.remediation_key(c("pattern_category"), c("category"), c("rule_name"), c("type"))
    return findings(spark, sf_dir).select("ord", C.cwe(key, c("rule_name"), c("type"), c("description")).alias("cwe"), C.report_cwe(c("rule_name"), c("pattern_category"), c("type"), c("description")).alias("report_cwe"))


@query(f"SELECT rule_id, arg_min(rule_name, k) AS rule_name, CASE arg_min(severity, k) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, CASE arg_min(severity, k) WHEN 'critical' THEN 9.5 WHEN 'high' THEN 8.0 WHEN 'medium' THEN 5.0 ELSE 3.0 END::DOUBLE AS security_severity, count(*) AS n FROM (SELECT *, {{'a': path, 'b': line, 'c': rule_name, 'd': severity, 'e': description}} AS k FROM {FIND}) GROUP BY 1")
def sarif_rules(spark, sf_dir):
    return report.rule_catalogue(findings(spark, sf_dir))


@query()
def sarif_results(spark, sf_dir):
    return report.sarif_results(findings(spark, sf_dir))


@query(f"SELECT path, line, severity, variable, CASE WHEN length(value) <= 8 THEN '****' ELSE substr(value, 1, 4) || '...' || right(value, 4) END AS value, 'not verified' AS verification FROM {FIND}")
def masked_export(spark, sf_dir):
    return report.masked(findings(spark, sf_dir)).select("path", "line", "severity", "variable", "value", "verification")


# History, enrichment, streams


@query(f"""WITH h AS (SELECT md5(rule_id || '|' || path || '|' || variable || '|' || value) AS credential_key, 'c' || ord AS commit_hash, epoch(seen)::BIGINT AS ts, ord FROM {FIND}),
g AS (SELECT credential_key, min(ts) AS a, max(ts) AS b, count(*) AS n, arg_min(commit_hash, {{'t': ts, 'o': -ord}}) AS first_seen_commit, arg_max(commit_hash, {{'t': ts, 'o': -ord}}) AS last_seen_commit FROM h GROUP BY 1)
SELECT credential_key, first_seen_commit, last_seen_commit, n AS exposure_commit_count, 'exposed ' || CASE WHEN (b - a) // 86400 >= 60 THEN '~' || ((b - a) // 86400) // 30 || ' months' WHEN (b - a) // 86400 >= 1 THEN (b - a) // 86400 || ' day' || CASE WHEN (b - a) // 86400 = 1 THEN '' ELSE 's' END ELSE 'a single day' END
 || ' across ' || n || ' commit' || CASE WHEN n = 1 THEN '' ELSE 's' END AS exposure_window FROM g""")
def history_exposure(spark, sf_dir):
    x = findings(spark, sf_dir).select(F.col("ord").alias("log_ix"), F.concat(F.lit("c"), F.col("ord").cast("string")).alias("commit_hash"), F.unix_timestamp(F.col("seen").cast("timestamp")).alias("commit_timestamp"), F.col("path").alias("original_file"), "rule_id", "variable", "value")
    return history.exposure(x).select("credential_key", "first_seen_commit", "last_seen_commit", "exposure_commit_count", "exposure_window")


@query(f"""WITH n AS (SELECT path, arg_max(value, {{'l': line, 'v': value}}) AS s FROM {FIND} WHERE contains(lower(rule_name), 'secret') GROUP BY 1),
s AS (SELECT path, arg_min(value, {{'l': line, 'v': value}}) AS s FROM {FIND} WHERE NOT contains(lower(rule_name), 'secret') AND regexp_matches(value, '^[A-Za-z0-9/+]{{40}}$') GROUP BY 1)
SELECT path, line, value AS access_key, coalesce(n.s, s.s) AS secret FROM {FIND} f LEFT JOIN n USING (path) LEFT JOIN s USING (path) WHERE regexp_matches(value, '^(AKIA|ASIA).{{16}}$')""")
def aws_pairs(spark, sf_dir):
    return enrich.aws_pairs(findings(spark, sf_dir)).select("path", "line", "access_key", "secret")


@query(f"""SELECT ord, CASE WHEN regexp_matches(t, '^gh[pousr]_') THEN 'github' WHEN regexp_matches(t, '^xox[bpar]-') THEN 'slack' WHEN regexp_matches(t, '^[sr]k_(live|test)_') THEN 'stripe' WHEN regexp_matches(t, '^ya29\\.') THEN 'gcp' WHEN regexp_matches(t, '^sk-ant-') THEN 'anthropic' WHEN regexp_matches(t, '^sk-') THEN 'openai' WHEN regexp_matches(t, '^npm_') THEN 'npm' END AS provider
FROM (SELECT ord, nullif(regexp_extract(value, {quote(C.TOKEN)}, 1), '') AS t FROM {FIND})""")
def token_providers(spark, sf_dir):
    return findings(spark, sf_dir).select("ord", C.provider(C.token_in(F.col("value"))).alias("provider"))


TOKENS = f"(SELECT *, nullif(regexp_extract(value, {quote(C.TOKEN)}, 1), '') AS t FROM {FIND})"
VERDICT = f"(SELECT *, CASE WHEN t IS NULL THEN NULL WHEN ascii(substr(sha256(t), 1, 1)) % 3 = 0 THEN 'ACTIVE: acct' WHEN ascii(substr(sha256(t), 1, 1)) % 3 = 1 THEN 'INVALID: gone' ELSE 'UNVERIFIED: no answer' END AS verification FROM {TOKENS})"
BREACH_ASKED = f"CASE WHEN regexp_matches(bh, '{C.PASSWORD_WORDS}') THEN true WHEN regexp_matches(bh, '{C.STRUCTURED_WORDS}') THEN false ELSE regexp_matches(bh, '{C.SECRET_WORDS}') END"
BREACH = f"(SELECT *, CASE WHEN NOT ({BREACH_ASKED}) THEN NULL WHEN substr(value, 1, 4) = 'pass' AND right(value, 1) < '5' THEN 'EXPOSED: seen in ' || (length(value) + 10) || ' known breaches' ELSE 'not in known breaches' END AS breach_exposure FROM (SELECT *, lower(rule_name || ' ' || type || ' ' || variable || ' ' || pattern_category) AS bh FROM {VERDICT}))"


def _verdicts(x):
    token = C.token_in(F.col("value"))
    first = F.ascii(F.substring(F.sha2("t", 256), 1, 1)) % 3
    said = x.select(token.alias("t")).where("t is not null").distinct().where(first < 2)
    return said.select(F.sha2("t", 256).alias("value_sha256"), (first == 0).alias("valid"), F.when(first == 0, "acct").otherwise("gone").alias("detail"))


def _breaches(x):
    prefix, suffix = C.breach_key(F.col("value"))
    return x.where("substr(value, 1, 4) = 'pass' and right(value, 1) < '5'").select(prefix.alias("prefix"), suffix.alias("suffix"), (F.length("value") + 10).cast("long").alias("count")).distinct()


@query(f"SELECT ord, verification, CASE WHEN verification LIKE 'ACTIVE%' THEN 'critical' ELSE severity END AS severity FROM {VERDICT}")
def token_verdicts(spark, sf_dir):
    x = findings(spark, sf_dir)
    return enrich.with_verdicts(x, _verdicts(x)).select("ord", "verification", "severity")


@query(f"SELECT ord, breach_exposure, CASE WHEN breach_exposure LIKE 'EXPOSED%' AND severity IN ('info', 'low', 'medium') THEN 'high' ELSE severity END AS severity FROM {BREACH}")
def breach_correlation(spark, sf_dir):
    x = findings(spark, sf_dir)
    return enrich.with_breaches(x, _breaches(x)).select("ord", "breach_exposure", "severity")


@query(f"SELECT count_if(verification LIKE 'ACTIVE%' OR verification LIKE 'INVALID%')::BIGINT AS verifiable, count_if(verification LIKE 'ACTIVE%')::BIGINT AS live, coalesce(round(count_if(verification LIKE 'ACTIVE%') / nullif(count_if(verification LIKE 'ACTIVE%' OR verification LIKE 'INVALID%'), 0), 6), 0)::DOUBLE AS live_rate, count_if(breach_exposure LIKE 'EXPOSED%')::BIGINT AS breached FROM {BREACH}")
def verification_stats(spark, sf_dir):
    x = findings(spark, sf_dir)
    return enrich.verification_stats(enrich.with_breaches(enrich.with_verdicts(x, _verdicts(x)), _breaches(x)))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, user_id AS client, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_limit_windows(spark, sf_dir):
    x = incremental.rates(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", 2)
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "client", "n")


@query("SELECT md5(event_type || '|' || user_id) AS credential_key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def exposure_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).cast("binary")).alias("credential_key"), "ts")
    x = incremental.exposure_stream(e)
    return x.select("credential_key", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], "n")


PIPELINES = [(".github/workflows/a.yml", "x", "github_actions"), (".gitlab-ci.yml", "x", "gitlab_ci"), ("r/.circleci/config.yml", "x", "circleci"), ("Jenkinsfile", "x", "jenkins"), ("jenkinsfile.groovy", "x", "jenkins"), ("ci/build.yml", "on: push\njobs:\n  a:\n    runs-on: x", "github_actions"), ("ci/other.yml", "jobs:\n  a: 1", "unknown")]


@query("SELECT c_custkey AS id, [" + ", ".join(f"'{x[2]}'" for x in PIPELINES) + f"][(c_custkey % {len(PIPELINES)} + 1)::INT] AS platform FROM customer")
def pipeline_platforms(spark, sf_dir):
    k = F.col("c_custkey")
    of = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in PIPELINES]), (k % len(PIPELINES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), parsers.pipeline_platform(of(0), of(1)).alias("platform"))


# Whole scans

PLANTED = """SELECT 'src/p' || p_partkey || '/app.py' AS path, md5(p_name) AS value FROM part UNION ALL SELECT 'infra/p' || p_partkey || '/main.tf', upper(substr(md5(p_name), 1, 20)) FROM part
UNION ALL SELECT 'conf/p' || p_partkey || '/app.json', substr(md5(p_name), 1, 16) FROM part UNION ALL SELECT '.github/workflows/p' || p_partkey || '.yml', substr(md5(p_name), 1, 20) FROM part"""


@query(f"SELECT DISTINCT path, value FROM ({PLANTED})")
def scan_planted(spark, sf_dir):
    """The whole chain over source, infrastructure, settings and pipeline files, each with one secret."""
    p, d = dealt(spark, sf_dir, "part", "p_partkey", "p_name"), F.md5(F.col("p_name").cast("binary"))
    files = lambda at, end, *parts: F.struct(F.concat(F.lit(at), F.col("p_partkey").cast("string"), F.lit(end)).alias("path"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("content"))
    code = files("src/p", "/app.py", '# build settings\nname = "x"\napi_token = "', d, '"\n')
    infra = files("infra/p", "/main.tf", 'provider "x" {\n  access_key = "', F.upper(F.substring(d, 1, 20)), '"\n}\n')
    conf = files("conf/p", "/app.json", '{"db": {"password": "', F.substring(d, 1, 16), '"}}')
    build = files(".github/workflows/p", ".yml", "jobs:\n  env:\n    API_TOKEN: ", F.substring(d, 1, 20), "\n")
    return engine.scan(spark, p.select(F.inline(F.array(code, infra, conf, build)))).select("path", "value").distinct()


@query("SELECT 'ci/' || p_partkey || '.tf' AS path, 4 AS line, 'Terraform Hardcoded Secret Key' AS rule_name, md5(p_name) AS value FROM part UNION ALL SELECT 'ci/' || p_partkey || '.tf', 5, 'Terraform Variable Default Secret', substr(md5(p_name), 3, 12) FROM part UNION ALL SELECT 'stack-' || p_partkey || '.yaml', 2, 'CloudFormation Hardcoded Secret', substr(md5(p_name), 1, 10) FROM part UNION ALL SELECT 'g' || p_partkey || '/.gitlab-ci.yml', 1, 'CI/CD Hardcoded Secret in docker run', substr(md5(p_name), 1, 14) FROM part UNION ALL SELECT 'g' || p_partkey || '/.gitlab-ci.yml', 2, 'CI/CD Hardcoded Bearer Token in curl', md5(p_name) FROM part UNION ALL SELECT 'ci/' || p_partkey || '.tf', 6, 'Terraform AWS Account ID', substr(md5(p_name), 3, 12) FROM part WHERE regexp_matches(substr(md5(p_name), 3, 12), '^[0-9]{12}$')")
def infrastructure_entries_more(spark, sf_dir):
    p, d, k = dealt(spark, sf_dir, "part", "p_partkey", "p_name"), F.md5(F.col("p_name").cast("binary")), F.col("p_partkey").cast("string")
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    tf = F.struct(join("ci/", k, ".tf").alias("path"), join("# \n# \nprovider {\n  secret_key = \"", d, "\"\nvariable \"db_secret\" {\n  default = \"", F.substring(d, 3, 12), '"\n}').alias("content"))
    cf = F.struct(join("stack-", k, ".yaml").alias("path"), join("Resources:\n  MasterPassword: ", F.substring(d, 1, 10), "\n").alias("content"))
    ci = F.struct(join("g", k, "/.gitlab-ci.yml").alias("path"), join("docker run -e MY_TOKEN=", F.substring(d, 1, 14), " x\ncurl -H 'Authorization: Bearer ", d, "' u\n").alias("content"))
    return parsers.entries(p.select(F.inline(F.array(tf, cf, ci)))).select("path", "line", "rule_name", "value")


@query("SELECT 'f' || p_partkey || '.json' AS path, 'a.token' AS key, md5(p_name) AS value FROM part UNION ALL SELECT 'f' || p_partkey || '.yml', 'a.b[0]', p_brand FROM part UNION ALL SELECT 'f' || p_partkey || '.py', 'k', p_brand FROM part UNION ALL SELECT 'f' || p_partkey || '.txt', 'content', p_brand FROM part")
def parsed_items(spark, sf_dir):
    """All parsers in one pass; the unknown kind of file gives nothing."""
    p, k = dealt(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand"), F.col("p_partkey").cast("string")
    kinds = [(".json", '{"a": {"token": "', F.md5(F.col("p_name").cast("binary")), '"}}'), (".yml", 'a:\n  b:\n    - "', F.col("p_brand"), '"\n'), (".py", 'k = "', F.col("p_brand"), '"  # note = "x"\n'), (".txt", "", F.col("p_brand"), ""), (".unknown", "k = ", F.col("p_brand"), "")]
    parts = [F.struct(F.concat(F.lit("f"), k, F.lit(end)).alias("path"), F.concat(F.lit(a), v, F.lit(b)).alias("content")) for end, a, v, b in kinds]
    return parsers.items(p.select(F.inline(F.array(*parts)))).select("path", "key", "value")


@query()
def scan_documents(spark, sf_dir):
    return engine.scan(spark, doc_files(spark, sf_dir)).drop("detection_methods", "confidence_factors")


@query()
def scan_documents_strict(spark, sf_dir):
    return engine.scan(spark, doc_files(spark, sf_dir), engine.ScanConfig.preset("strict")).select("path", "line", "rule_id", X.mask(F.col("value")).alias("value"), "severity", "overall_confidence")
