"""Items out of files: pairs of JSON and YAML trees, assignments of code, entries of infrastructure, pipelines and images, archives, SQLite.

Trees of unknown shape and line-by-line states need small Python steps inside mapInArrow-style tasks; patterns over
whole texts are expressions. Everything is dealt by file; one file is read by one task.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import sqlite3
import tarfile
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import archives

ITEM = "path string, key string, value string, line int, type string"


#: Rows of one batch that a task gives back at once.
ROWS = 20_000


def _items(files: DataFrame, one) -> DataFrame:
    """one(path, content, route) of every file; rows (key, value, line, type) come back in batches of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "key", "value", "line", "type"]).astype({"line": "Int32"})
        for pdf in batches:
            rows = []
            for path, content, route in zip(pdf["path"], pdf["content"], pdf["route"]):
                for r in one(path, content or "", route):
                    rows.append((path, *r))
                    if len(rows) >= ROWS:
                        yield frame(rows)
                        rows = []
            yield frame(rows)

    route = F.col("route") if "route" in files.columns else F.lit(None).cast("string").alias("route")
    return files.select("path", "content", route).mapInPandas(run, ITEM)


def flatten(tree, at: str = "") -> Iterator[tuple[str, str, str]]:
    """(dotted key, value, type) of every scalar that isn't null; list places in brackets."""
    stack = [(tree, at, "property")]
    while stack:
        x, key, kind = stack.pop()
        if isinstance(x, dict):
            stack += [(v, f"{key}.{k}" if key else str(k), "property") for k, v in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(v, f"{key}[{i}]", "list_item") for i, v in reversed(list(enumerate(x)))]
        elif x is not None:
            yield key, str(x), kind


def json_rows(path: str, content: str):
    """Scalars of a JSON file; one that isn't JSON gives none."""
    try:
        yield from ((k, v, None, t) for k, v, t in flatten(json.loads(content)))
    except (ValueError, RecursionError):
        return


def json_items(files: DataFrame) -> DataFrame:
    return _items(files, lambda path, content, _: json_rows(path, content))


def json_column_items(rows: DataFrame, path: Column, column: str) -> DataFrame:
    """Top-level pairs of a JSON object column, without Python."""
    x = rows.select(path.alias("path"), F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return x.where("value is not null").select("path", "key", "value", F.lit(None).cast("int").alias("line"), F.lit("property").alias("type"))


def yaml_rows(path: str, content: str):
    """Scalars of a YAML file, by PyYAML where it is installed, else by indentation (maps and lists of scalars)."""

    def simple(content: str):
        stack: list[tuple[int, str]] = []
        counts: dict[str, int] = {}
        for number, raw in enumerate(content.split("\n"), 1):
            m = re.match(r"^(\s*)(- )?(?:([^\s:#][^:#]*):(?:\s+|$))?(.*)$", raw)
            if not raw.strip() or raw.lstrip().startswith("#") or not m:
                continue
            depth = len(m[1]) + (2 if m[2] and m[3] else 0)
            while stack and stack[-1][0] >= depth + (0 if m[3] else 1):
                stack.pop()
            parent = ".".join(k for _, k in stack)
            value = re.sub(r"\s+#.*$", "", m[4]).strip().strip("\"'")
            if m[3]:
                key = m[3].strip().strip("\"'")
                if value:
                    yield (f"{parent}.{key}" if parent else key), value, number, "property"
                else:
                    stack.append((depth, key))
            elif m[2] and value:
                k = counts[parent] = counts.get(parent, -1) + 1
                yield f"{parent}[{k}]", value, number, "list_item"

    try:
        import yaml
    except ImportError:
        yield from simple(content)
        return
    try:
        yield from ((k, v, None, t) for doc in yaml.safe_load_all(content) for k, v, t in flatten(doc))
    except (yaml.YAMLError, ValueError, RecursionError):
        return


def yaml_items(files: DataFrame) -> DataFrame:
    return _items(files, lambda path, content, _: yaml_rows(path, content))


#: Marks of comments by file name ending; a language is a parameter, not a table of hundreds.
HASH_COMMENTS = re.compile(r"(?i)\.(py|pyw|rb|sh|bash|zsh|pl|pm|r|ya?ml|toml|ini|conf|cfg|env|properties|tf|ps1|ex|exs)$|(^|/)\.env|(^|/)(docker|make|jenkins)file")
DASH_COMMENTS = re.compile(r"(?i)\.(sql|lua|hs|elm)$")
ASSIGN = re.compile(r"""([A-Za-z_][\w.-]*)\s*(?::=|=|:)\s*(?:(["'`])((?:\\.|(?!\2).)*)\2|([^\s,;"'`(){}\[\]]+))""")
LITERAL = re.compile(r"""(["'`])((?:\\.|(?!\1).)*)\1""")


def code_lines(path: str, content: str) -> Iterator[tuple[int, str]]:
    """(line number, code without comments)."""
    if HASH_COMMENTS.search(path):
        single, blocks = "#", (('"""', '"""'), ("'''", "'''")) if path.lower().endswith((".py", ".pyw")) else ()
    elif DASH_COMMENTS.search(path):
        single, blocks = "--", (("/*", "*/"),)
    else:
        single, blocks = "//", (("/*", "*/"), ("<!--", "-->"))
    inside = None
    for number, line in enumerate(content.split("\n"), 1):
        rest, out = line, ""
        while rest:
            if inside:
                at = rest.find(inside)
                if at < 0:
                    break
                rest, inside = rest[at + len(inside) :], None
                continue
            starts = [(rest.find(a), a, b) for a, b in blocks if rest.find(a) >= 0 and (a not in ('"""', "'''") or not rest[: rest.find(a)].strip())]
            first = min(starts, default=None)
            if first is None:
                out, rest = out + rest, ""
            else:
                at, a, b = first
                out, rest, inside = out + rest[:at], rest[at + len(a) :], b
        quotes, k = None, 0
        while k < len(out):  # the comment mark counts only outside of strings
            c = out[k]
            if quotes:
                k += c == "\\"
                quotes = None if c == quotes else quotes
            elif c in "\"'`":
                quotes = c
            elif out.startswith(single, k) and not (single == "//" and out[k - 1 : k] == ":"):
                out = out[:k]
                break
            k += 1
        if out.strip():
            yield number, out


def code_rows(path: str, content: str):
    """Assignments (type variable) and string literals (type string) of source code, comments left out."""
    for number, code in code_lines(path, content):
        spans = []
        for m in ASSIGN.finditer(code):
            value = m[3] if m[2] else m[4]
            if value:
                yield m[1], value, number, "variable"
                spans.append(m.span())
        for m in LITERAL.finditer(code):
            if m[2] and not any(a <= m.start() < b for a, b in spans):
                yield None, m[2], number, "string"


def code_items(files: DataFrame) -> DataFrame:
    return _items(files, lambda path, content, _: code_rows(path, content))


#: Parsers by route: function(path, content) -> rows of (key, value, line, type). Give `items` a changed copy to add others.
PARSERS = {"json": json_rows, "yaml": yaml_rows, "code": code_rows, "text": lambda path, content: [("content", content, 1, "text")]}


def items(files: DataFrame, parsers: dict | None = None, route: Column | None = None) -> DataFrame:
    """Items of all files that a parser takes, in one pass. route names the parser (by default files.route of the path)."""
    from . import files as S

    parsers = PARSERS if parsers is None else parsers
    own = files.withColumn("route", S.route(F.col("path")) if route is None else route).where(F.col("route").isin(*parsers))
    return _items(own, lambda path, content, name: parsers[name](path, content))


def text_items(files: DataFrame) -> DataFrame:
    """A whole text as one item."""
    return files.select("path", F.lit("content").alias("key"), F.col("content").alias("value"), F.lit(1).alias("line"), F.lit("text").alias("type"))


# Patterns of hard-coded secrets. group, name, severity, regular expression, group of the key (0: the name), group of the value
ENTRIES = [
    ("terraform", "Terraform Hardcoded Access Key", "critical", '(?i)(?:access_key|aws_access_key_id)\\s*=\\s*"([^"${}]{16,})"', 0, 1),
    ("terraform", "Terraform Hardcoded Secret Key", "critical", '(?i)(?:secret_key|aws_secret_access_key)\\s*=\\s*"([^"${}]{20,})"', 0, 1),
    ("terraform", "Terraform Hardcoded Token", "high", '(?i)(?:token|api_key|api_token|password|passwd|secret)\\s*=\\s*"([^"${}]{8,})"', 0, 1),
    ("terraform", "Terraform Variable Default Secret", "high", '(?is)variable\\s+"[^"]*(?:secret|key|token|password|passwd)[^"]*"\\s*\\{[^}]*default\\s*=\\s*"([^"${}]{8,})"', 0, 1),
    ("terraform", "Terraform AWS Account ID", "medium", "\\b(\\d{12})\\b", 0, 1),
    ("cloudformation", "CloudFormation Hardcoded Secret", "critical", "(?i)(?:password|passwd|secret|api_?key|access_?key|token)\\s*:\\s*[\"']?([^\"'${}\\n]{8,})[\"']?", 0, 1),
    ("cloudformation", "CloudFormation NoEcho Missing", "medium", "(?i)((?:Password|Secret|Key|Token)\\s*:\\s*\\n\\s*Type\\s*:\\s*String)(?![\\s\\S]{0,200}NoEcho\\s*:\\s*true)", 0, 1),
    ("cicd", "CI/CD Hardcoded Secret in env block", "critical", "(?im)(?:^|\\s)([A-Z_]*(?:TOKEN|SECRET|KEY|PASSWORD|PASSWD)[A-Z_]*)\\s*:\\s*([^\\s${\\n][^\\n]{7,})", 1, 2),
    ("cicd", "CI/CD Secret Printed to Log", "high", "(?i)(?:echo|print|printf|console\\.log)\\s+[\"']?\\$\\{?([A-Z_]*(?:TOKEN|SECRET|KEY|PASSWORD)[A-Z_]*)\\}?", 1, 1),
    ("cicd", "CI/CD Hardcoded Secret in docker run", "critical", "(?i)docker\\s+run[^\\n]*(?:-e|--env)\\s+([A-Z_]+(?:TOKEN|SECRET|KEY|PASSWORD)[A-Z_]*)=([^\\s$\"']{8,})", 1, 2),
    ("cicd", "CI/CD Hardcoded Bearer Token in curl", "critical", "(?i)curl[^\\n]*(?:-H|--header)\\s+[\"']?Authorization:\\s*Bearer\\s+([A-Za-z0-9._-]{20,})[\"']?", 0, 1),
    ("docker", "Dockerfile Hardcoded Credential", "critical", "(?im)^\\s*(?:ENV|ARG)\\s+([A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|API_?KEY|ACCESS_?KEY|PRIVATE_?KEY|CREDENTIAL)[A-Z0-9_]*)(?:=|\\s+)[\"']?([^\\s\"'$]{4,})", 1, 2),
]
TEMPLATE = "(?i)^(\\$\\{|!Ref|!Sub|var\\.|\\$\\(|data\\.|aws_|module\\.)"
VARIABLE = "(?i)^\\$\\{?\\{?[A-Z_]+\\}?\\}?$|^\\$\\(\\(|^(secrets|vars|env)\\."
STAND_IN = "(?i)^(your[_-]|<|\\{|\\$|xxx|change[_-]?me|placeholder|example|none$|null$|true$|false$)"
SKIP = {"terraform": TEMPLATE, "cloudformation": TEMPLATE, "cicd": VARIABLE, "docker": STAND_IN}


def group_of(path: Column) -> Column:
    """Which of the groups of ENTRIES a file belongs to."""
    from . import files as S

    route = S.route(path)
    return F.when(route == "docker", "docker").when(route == "cicd", "cicd").when(path.rlike("(?i)\\.(tf|tfvars|hcl)$"), "terraform").when(route == "iac", "cloudformation")


def entries(files: DataFrame) -> DataFrame:
    """Findings of infrastructure, pipeline and image files: path, line, rule_name, severity, category, variable, value.

    Every pattern is an expression over the whole text; a file is read once and only its own group's patterns run. The line of a
    hit comes from the text before it: the text is split at the hits once, and line feeds of the parts are summed by a window.
    """
    text, kind = F.col("content"), "array<struct<line: int, rule_name: string, severity: string, variable: string, value: string>>"
    feeds = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    def hits(name: str, severity: str, rx: str, key: int, value: int) -> Column:
        whole, gaps = F.regexp_extract_all(text, F.lit(rx), 0), F.split(text, rx)
        names = F.regexp_extract_all(text, F.lit(rx), key) if key else F.transform(whole, lambda _: F.lit(name))
        # Line feeds from one hit's beginning to the next one's; a window sums them up behind the explode.
        steps = F.zip_with(gaps, F.concat(F.array(F.lit("")), whole), lambda g, h: F.coalesce(feeds(g), F.lit(0)) + F.coalesce(feeds(h), F.lit(0)))
        each = F.arrays_zip(names.alias("k"), F.regexp_extract_all(text, F.lit(rx), value).alias("v"), F.slice(steps, 1, F.size(whole)).alias("n"))
        told = F.transform(each, lambda x: F.struct(x["n"].cast("int").alias("line"), F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), x["k"].alias("variable"), x["v"].alias("value")))
        return F.when(text.rlike(rx), told.cast(kind)).otherwise(F.array().cast(kind))

    group = F.col("category")
    found = F.array().cast(kind)
    for g in dict.fromkeys(g for g, *_ in ENTRIES):
        found = F.when(group == g, F.concat(*[hits(*e[1:]) for e in ENTRIES if e[0] == g])).otherwise(found)
    # A generated row: a file's group is told once, not for each group that it is compared with.
    own = files.select("path", "content", F.explode(F.array(group_of(F.col("path")))).alias("category")).where("category is not null")
    # The file's number stands before the explode, else it would be a row's.
    x = own.select("path", "content", "category", F.monotonically_increasing_id().alias("file")).select("path", "category", "file", F.posexplode(found).alias("pos", "x"))
    before = F.sum("x.line").over(Window.partitionBy("file", "x.rule_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.select("path", (before + 1).cast("int").alias("line"), "x.rule_name", "x.severity", "category", "x.variable", F.regexp_replace(F.trim("x.value"), "^[\"']+|[\"']+$", "").alias("value"))
    skip = F.lit(False)
    for g, rx in SKIP.items():
        skip = F.when(F.col("category") == g, F.col("value").rlike(rx)).otherwise(skip)
    return x.where(~skip)


def pipeline_platform(path: Column, content: Column) -> Column:
    return (
        F.when(path.contains(".github/workflows"), "github_actions").when(path.rlike("(?i)(^|/)\\.gitlab-ci\\.yml$"), "gitlab_ci").when(path.contains(".circleci/config.yml"), "circleci")
        .when(path.rlike("(?i)(^|/)jenkinsfile(\\.groovy)?$"), "jenkins").when(content.rlike("(?m)^\\s*(on|jobs)\\s*:") & content.contains("runs-on"), "github_actions").otherwise("unknown")
    )


def archive_files(binary: DataFrame, most_bytes: int | None = None, most_files: int | None = None, depth: int = 5) -> DataFrame:
    """path (archive!member), archive_path, content of files inside archives (and archives in them), skipped.

    What can't be read isn't there; `archives.rows` has it, with the reason. With limits (against archive bombs) a member beyond them is a
    row without content, like one that lies deeper than depth.
    """
    told = archives.rows(binary, most_bytes, most_files, depth).where("status <> 'failed' and coalesce(reason, '') not like '%outside%'")
    return told.select("path", "archive_path", "content", (F.col("status") == "skipped").alias("skipped"))


NAMES = re.compile(r"(?i)secret|token|passw|pwd|key|auth|cred|user|account|login|config|setting")


def sqlite_rows(binary: DataFrame, rows_per_table: int | None = None) -> DataFrame:
    """Strings of over 8 characters in telling columns of telling tables of SQLite files, rows_per_table of each table (None: all).

    A table that can't be read gives what came before the damage and a row of type `failed` with the reason as value; the other tables come. Rows are
    numbered as SQLite scans them: by rowid, or by primary key where there is none.
    """
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    frame = lambda rows: pd.DataFrame(rows, columns=["path", "key", "value", "line", "type"]).astype({"line": "Int32"})

    def table_rows(path: str, db: sqlite3.Connection, table: str) -> Iterator[tuple]:
        try:
            cursor = db.execute(f"select * from {quoted(table)} limit ?", (-1 if rows_per_table is None else rows_per_table,))
            columns = [c[0] for c in cursor.description]
            for n, row in enumerate(cursor):
                yield from ((path, f"{table}.{c}", v, n + 1, "sqlite") for c, v in zip(columns, row) if isinstance(v, str) and len(v) > 8 and NAMES.search(c))
        except sqlite3.Error as e:
            yield path, table, str(e), None, "failed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = []
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # one task's own copy, gone with it
                    f.write(bytes(data))
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    db.text_factory = lambda b: b.decode("utf-8", "replace")
                    try:
                        tables = [t for (t,) in db.execute("select name from sqlite_master where type = 'table' order by name").fetchall() if NAMES.search(t)]
                    except sqlite3.Error as e:
                        tables, rows = [], [(path, None, str(e), None, "failed")]
                    for table in tables:
                        for row in table_rows(path, db, table):
                            rows.append(row)
                            if len(rows) >= 10_000:
                                yield frame(rows)
                                rows = []
                    db.close()
                yield frame(rows)

    return binary.select("path", "content").mapInPandas(run, ITEM)


def sqlite_items(binary: DataFrame, rows_per_table: int | None = None) -> DataFrame:
    """sqlite_rows without the tables that couldn't be read."""
    return sqlite_rows(binary, rows_per_table).where("type <> 'failed'")


def image_entries(binary: DataFrame) -> DataFrame:
    """Credentials baked into image archives: environment of the configuration, key-value lines of layers' text files. See sources.images."""
    from . import images

    kind = F.when(F.col("kind") == "env", "image_env").otherwise("image_layer")
    path = F.when(F.col("at").isNull(), F.col("image")).otherwise(F.concat_ws("!", "image", "at"))
    return images.rows(binary).where("kind in ('env', 'value')").select(path.alias("path"), "key", "value", "line", kind.alias("type"))
