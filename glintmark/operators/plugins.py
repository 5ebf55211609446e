"""Analyzers and parsers of other modules in a scan, and this library's parsers in SQL.

An analyzer is a function of two tables, files (path, content) and lines (path, line, text), or the name of a table function of
(path, line, text), written in Python (a UDTF) or SQL. Its rows may have any columns of a finding; path and line are the line's if it doesn't give them, and
rule_id, rule_name, type, category, severity and confidence have defaults; other columns are left out. A parser, likewise, may be the name of a table function of
(path, content) with columns key, value, line, type. Table functions by name are kept in settings files; functions are code and aren't.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources import parsers
from ..sources.workers import reach
from . import detect

Analyzer = str | Callable[[DataFrame, DataFrame], DataFrame]


def by_name(table: DataFrame, function: str, columns: list[str]) -> DataFrame:
    """Rows of a table function of columns, for every row of table; its column c is told__c beside the table's."""
    if not re.fullmatch(r"\w+(\.\w+){0,2}", function):
        raise ValueError(f"not the name of a function: {function}")
    spark, given = table.sparkSession, ", ".join(f"t.`{c}`" for c in columns)
    out = spark.sql(f"SELECT t.*, f.* FROM {{table}} t, LATERAL {function}({given}) f", table=table.select(*columns))
    return out.toDF(*columns, *[f"told__{c}" for c in out.columns[len(columns) :]])


def analyzed(files: DataFrame, lines: DataFrame, analyzers: dict[str, Analyzer]) -> list[DataFrame]:
    """Findings of each analyzer."""
    parts = []
    for name, how in analyzers.items():
        if isinstance(how, str):
            x = by_name(lines, how, ["path", "line", "text"])
            told = {c.removeprefix("told__"): F.col(c) for c in x.columns if c.startswith("told__")}
            x = x.select(*[F.coalesce(told[c], F.col(c)).alias(c) if c in told else F.col(c) for c in ("path", "line")], *[v.alias(c) for c, v in told.items() if c not in ("path", "line")])
        else:
            x = how(files, lines)
        default = {"rule_id": name, "rule_name": name, "type": "analyzer", "category": "secrets", "severity": "medium", "confidence": 0.5}
        x = x.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in x.columns else F.lit(v) for c, v in default.items()})
        parts.append(detect.as_findings(x))
    return parts


def items(files: DataFrame, given: dict, route: F.Column | None = None) -> DataFrame:
    """parsers.items, where a parser may be the name of a table function."""
    from ..sources import files as S

    code = {k: v for k, v in given.items() if not isinstance(v, str)}
    out = parsers.items(files, code, route)
    for kind, function in given.items():
        if isinstance(function, str):
            own = files.where((S.route(F.col("path")) if route is None else route) == kind)
            x = by_name(own, function, ["path", "content"])
            out = out.unionByName(x.select("path", *[F.col(f"told__{c}").cast(t).alias(c) for c, t in (("key", "string"), ("value", "string"), ("line", "int"), ("type", "string"))]))
    return out


class ItemsOf:
    """items_of(kind, path, content): rows of the parser of a kind, which is a constant and one of parsers.PARSERS."""

    @staticmethod
    def analyze(kind: AnalyzeArgument, path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in parsers.PARSERS:
            raise ValueError(f"the kind must be one of {', '.join(parsers.PARSERS)}")
        if not all(isinstance(x.dataType, StringType) for x in (path, content)):
            raise ValueError("path and content must be strings")
        return AnalyzeResult(StructType().add("key", StringType()).add("value", StringType()).add("line", IntegerType()).add("type", StringType()))

    def eval(self, kind: str, path: str, content: str) -> Iterator[tuple]:
        yield from parsers.PARSERS[kind](path or "", content or "")


def register(spark: SparkSession) -> None:
    """Makes items_of known to the session's SQL."""
    reach(spark).udtf.register("items_of", F.udtf(ItemsOf))
