"""Sources: files as (path, content), their lines, changed files, commits, pages, address lists and link tables."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import dims
from . import tree
from .repository import git_commits  # noqa: F401  part of this module's interface
from .workers import reach


def admitted(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """No excluded substring, and an included one if any are given."""
    test = F.lit(True)
    if exclude:
        test = test & ~X.contains_any(path, exclude)
    if include:
        test = test & X.contains_any(path, include)
    return test


def dealt(rows: DataFrame) -> DataFrame:
    """rows in equal shares, four for each of the cluster's cores, however few splits their files have."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 4)


def fewer(rows: DataFrame) -> DataFrame:
    """rows that are few against what they were found in, in at most as many partitions as `dealt` makes, without a shuffle."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism * 4)


def files(spark: SparkSession, at: str | list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, length, modified, content (bytes) of all files below at, or of a list of files.

    The filter on the path is applied before any content is read; names that begin with `.` or `_` are files like others (see sources.tree).
    """
    names = tree.listing(spark, at, exclude).where(admitted(F.col("path"), include, exclude))
    return tree.contents(names, tree.total(names)).select("path", "length", "modified", "content")


def texts(binary: DataFrame, skip_nul: bool = False) -> DataFrame:
    """path, content as text; bytes that aren't UTF-8 become U+FFFD. skip_nul leaves files with a NUL in their first 8 KB out."""
    kept = binary.where(F.instr(F.substring("content", 1, 8192).cast("string"), "\0") == 0) if skip_nul else binary
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1, or from the column first_line of files that come in parts), text as it is."""
    first = F.coalesce(F.col("first_line").cast("int"), F.lit(1)) if "first_line" in files.columns else F.lit(1)
    at = F.posexplode(F.split("content", "\n"))
    return files.select("path", first.alias("first"), at.alias("pos", "text")).select("path", (F.col("pos") + F.col("first")).alias("line"), "text")


def documents_as_files(documents: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none-"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), name, F.lit("."), F.coalesce("lang", F.lit("")))
    return documents.select(path.alias("path"), F.col("text").alias("content"))


ROUTES = {
    "binary": "(?i)\\.(zip|jar|war|ear|apk|ipa|tar|tgz|tbz2|txz|gz|bz2|xz|7z|sqlite3?|db|p12|pfx|jks|keystore)$",
    "docker": "(?i)(^|/)dockerfile(\\.[^/]*)?$|\\.dockerfile$",
    "iac": "(?i)\\.(tf|tfvars|hcl)$|(template|stack|cloudformation|cfn|cf-|cf_)[^/]*\\.(ya?ml|json)$",
    "cicd": "(?i)\\.github/workflows/[^/]*\\.ya?ml$|(^|/)\\.gitlab-ci\\.yml$|\\.circleci/config\\.yml$|(^|/)jenkinsfile(\\.groovy)?$",
    "json": "(?i)\\.json$",
    "yaml": "(?i)\\.ya?ml$",
    "text": "(?i)\\.txt$",
    "code": "(?i)\\.(py|pyw|rb|js|jsx|mjs|ts|tsx|java|kt|kts|scala|groovy|go|rs|c|h|cc|cpp|hpp|cs|php|swift|m|pl|pm|lua|r|sh|bash|zsh|ps1|bat|sql|vb|dart|ex|exs|erl|hs|clj|vue|html?|xml|css|properties|ini|conf|cfg|toml|env|gradle|md)$|(^|/)\\.env[^/]*$",
}


def route(path: Column) -> Column:
    """The parser for a file: the first that admits it, null if none does."""
    out = F.when(path.rlike(ROUTES["binary"]), "binary")
    for name, rx in list(ROUTES.items())[1:]:
        out = out.when(path.rlike(rx), name)
    return out


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files named in a table of changed paths."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def _git(repo: str, *args: str) -> str:
    """What git prints; bytes that aren't UTF-8 become U+FFFD, names aren't quoted for letters beyond ASCII."""
    return subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], capture_output=True, check=True, timeout=600).stdout.decode("utf-8", "replace")


def git_changed(spark: SparkSession, repo: str, ref: str | None = None) -> DataFrame:
    """Paths added, copied, modified or renamed against ref, or staged."""
    out = _git(repo, "diff", "--name-only", "-z", "--diff-filter=ACMR", *([ref] if ref else ["--cached"]))
    return spark.createDataFrame([(f"{repo.rstrip('/')}/{p}",) for p in out.split("\0") if p], "path string")


def git_diffs(spark: SparkSession, repo: str, commits: list[str] | DataFrame, root: bool = True) -> DataFrame:
    """commit_hash, diff (unified, no context) of each commit; the first commit counts unless root is off.

    commits: hashes, or a table with commit_hash. Tasks run git, so repo is a clone in a folder that all of them see.
    """
    reach(spark)
    if not isinstance(commits, DataFrame):
        commits = spark.createDataFrame([(c,) for c in commits], "commit_hash string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["commit_hash"]:
                diff = _git(repo, "diff-tree", "-p", "--unified=0", "--no-color", "--diff-filter=ACMR", *(["--root"] if root else []), c)
                yield pd.DataFrame([(c, diff)], columns=["commit_hash", "diff"])

    dealt = commits.select("commit_hash").repartition(spark.sparkContext.defaultParallelism * 4, "commit_hash")
    return dealt.mapInPandas(run, "commit_hash string, diff string")


def plain_name(name: Column) -> Column:
    """A name as git prints it behind `+++ `: a tab may follow it, and odd ones are quoted, with bytes in octal."""
    parts = F.split(F.regexp_extract(name, '(?s)^"(.*)"\t?$', 1), "(?=(?<!\\\\)\\\\[0-7]{3})")
    octal = lambda p: F.concat(F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"), F.hex(F.substring(p, 5, 1 << 30).cast("binary")))
    bytes_of = F.unhex(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\\\[0-7]{3}"), octal(p)).otherwise(F.hex(p.cast("binary")))), ""))
    plain = F.make_valid_utf8(bytes_of.cast("string"))
    for mark, real in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        plain = F.replace(plain, F.lit(mark), F.lit(real))
    return F.when(name.startswith('"'), plain).otherwise(F.regexp_replace(name, "\t$", ""))


def added_lines(diffs: DataFrame) -> DataFrame:
    """commit_hash, file, line, text of every added line, from diffs without context.

    A hunk's header gives its first new line; a line's number follows from its place in the hunk. All in expressions:
    a diff is cut at file headers, these at hunk headers, these into lines. What stands before the first hunk is the header, so an
    added line that looks like one is none.
    """
    one = diffs.select("commit_hash", F.explode(F.split("diff", "(?m)^diff --git ")).alias("part"))
    cut = F.split("part", "(?m)^@@ ")
    name = plain_name(F.regexp_extract(F.get(cut, F.lit(0)), '(?m)^\\+\\+\\+ ("?b/.*)$', 1))
    one = one.select("commit_hash", F.regexp_replace(name, "^b/", "").alias("file"), F.explode(F.slice(cut, 2, 1 << 30)).alias("hunk")).where("file <> ''")
    start = F.regexp_extract("hunk", "^-\\S+ \\+(\\d+)", 1).cast("int")
    plus = F.filter(F.slice(F.split("hunk", "\n"), 2, 1 << 30), lambda x: x.startswith("+"))
    return one.select("commit_hash", "file", start.alias("start"), F.posexplode(plus).alias("k", "raw")).select("commit_hash", "file", (F.col("start") + F.col("k")).alias("line"), F.substring("raw", 2, 1 << 30).alias("text"))


PREFIXES = ["", "config/", "conf/", ".config/", "private/", "backup/", "old/"]


def wordlist_urls(words: DataFrame, base: str, prefixes: list[str] | None = None) -> DataFrame:
    """Addresses to try: every prefix with every word of a list, distinct."""
    every = F.explode(F.array(*[F.lit(p) for p in prefixes or PREFIXES]))
    clean = F.regexp_replace(F.trim("word"), "^/+", "")
    return words.where(~F.coalesce(F.trim("word"), F.lit("")).rlike("^(#|$)")).select(clean.alias("word"), every.alias("prefix")).select(F.concat(F.lit(base.rstrip("/") + "/"), "prefix", "word").alias("url")).distinct()


def page_links(pages: DataFrame) -> DataFrame:
    """source, target of links in fetched pages, relative ones completed."""
    tags = F.regexp_extract_all("html", F.lit("(?is)<(?:a|link|script|img|iframe)\\b[^>]*?\\b(?:href|src)\\s*=\\s*[\"']([^\"'#]+)"), 1)
    return pages.select(F.col("url").alias("source"), F.explode(tags).alias("raw")).select("source", X.normal_url(F.col("raw"), F.col("source")).alias("target")).where("target is not null").distinct()


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2, same_host: bool = True) -> DataFrame:
    """url, depth: pages reached from seeds (url) over links within depth steps, each at its smallest depth."""
    frontier = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    if same_host:
        links = links.where(F.try_parse_url("source", F.lit("HOST")) == F.try_parse_url("target", F.lit("HOST")))
    for k in range(1, depth + 1):  # depth is a small parameter; each step is a join and an anti-join
        step = frontier.join(links, frontier.url == links.source).select(F.col("target").alias("url")).distinct()
        # Kept, so that no step computes the ones before it again.
        frontier = step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(k)).persist(StorageLevel.MEMORY_AND_DISK)
        seen = seen.union(frontier)
    return seen


BLOCKED_HOSTS = "^(localhost|.*\\.localhost|.*\\.local|.*\\.internal|metadata(\\..*)?)$"


def blocked_destination(url: Column) -> Column:
    """Whether a fetch would go to a private, loopback, link-local, reserved, multicast or metadata address."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    ip = host.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$")
    octet = lambda k: F.try_element_at(F.split(host, "\\."), F.lit(k)).try_cast("int")
    a, b = octet(1), octet(2)
    bad = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    return (host == "") | ~F.lower(url).rlike("^https?://") | host.rlike(BLOCKED_HOSTS) | host.rlike("^\\[(::1?|f[cd].*|fe[89ab].*|ff.*|::ffff:.*)\\]$") | (ip & F.coalesce(bad, F.lit(True)))


def load_baseline(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three exclusion tables of a baseline file: findings, patterns, paths."""
    kinds = {
        "findings": "id string, rule_id string, path string, line int, value_hash string, reason string, added_at string",
        "patterns": "id string, pattern string, reason string, added_at string",
        "paths": "id string, path_pattern string, reason string, added_at string",
    }
    whole = spark.read.schema("exclusions struct<" + ", ".join(f"{k}: array<struct<{v.replace(' string', ': string').replace(' int', ': int')}>>" for k, v in kinds.items()) + ">").json(path, multiLine=True)
    return {k: whole.select(F.explode(f"exclusions.{k}").alias("x")).select("x.*") for k in kinds}


def rules_from_file(path: str) -> list[dict]:
    """Custom item rules from JSON or YAML: a list of objects as in dims.RULES, value patterns as [name, pattern] or {name, pattern}."""
    found = dims.read_tree(path)
    out = []
    for r in found["rules"] if isinstance(found, dict) else found:
        values = [(v["name"], v["pattern"]) if isinstance(v, dict) else tuple(v) for v in r.get("values", r.get("value_patterns", []))]
        names = r.get("names") or "|".join(r.get("variable_patterns", [])) or None
        not_values = r.get("not_values") or "|".join(r.get("value_exclusion_patterns", [])) or None
        out.append({"id": r["id"], "name": r.get("name", r["id"]), "severity": r.get("severity", "medium"), "min_length": r.get("min_length", 6), "names": names, "not_names": r.get("not_names", r.get("variable_exclusion_pattern")), "values": values, "not_values": not_values})
    return out
