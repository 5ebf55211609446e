"""Analyzers and parsers of other modules, as functions, Python table functions and SQL ones."""

import pytest
from pyspark.sql import functions as F

from glintmark.operators import plugins
from glintmark.plans import engine
from glintmark.sources import parsers

OFF = {"keyword": False, "structural": False, "technology": False, "entropy": False, "entries": False, "use_context": False, "use_scores": False}


def test_analyzers_take_part_in_a_scan(spark, tmp_path):
    class Badges:
        def eval(self, path: str, line: int, text: str):
            for word in (text or "").split():
                if word.startswith("badge-"):
                    yield word, "high"

    spark.udtf.register("find_badges", F.udtf(Badges, returnType="value string, severity string"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION find_pins(path STRING, line INT, text STRING) RETURNS TABLE (value STRING, variable STRING, other INT) RETURN SELECT regexp_extract(text, 'pin:([0-9]{6,})', 1), 'pin', 1 WHERE text RLIKE 'pin:[0-9]{6,}'")
    files = spark.createDataFrame([("a.py", "x\nbadge-123456 badge-777777\npin:424242"), ("b.sh", "pin:1\nbadge-123456"), ("n.sh", None)], "path string, content string")
    own = lambda files, lines: files.where("content like '%pin:1%'").select("path", F.lit(1).alias("line"), F.lit("whole-file").alias("value"), F.lit("mine").alias("rule_id"))
    config = engine.ScanConfig(items=False, analyzers={"badge": "find_badges", "pin": "find_pins", "code": own}, **OFF)
    got = {(r.path, r.line, r.value, r.rule_id, r.severity, r.variable) for r in engine.scan(spark, files, config).collect()}
    assert got == {("a.py", 2, "badge-123456", "badge", "high", None), ("a.py", 2, "badge-777777", "badge", "high", None), ("a.py", 3, "424242", "pin", "medium", "pin"),
                   ("b.sh", 2, "badge-123456", "badge", "high", None), ("b.sh", 1, "whole-file", "mine", "medium", None)}
    config.write(str(tmp_path / "c.json"))
    again = engine.ScanConfig.read(str(tmp_path / "c.json"))
    assert again.analyzers == {"badge": "find_badges", "pin": "find_pins"} and again.parsers == parsers.PARSERS
    with pytest.raises(ValueError):
        plugins.by_name(files, "f(1); drop", ["path"])


def test_parsers_in_sql(spark, tmp_path):
    plugins.register(spark)
    files = spark.createDataFrame([("a.json", '{"a": {"token": "x1"}}'), ("b.json", "{"), ("c.json", None), ("d.ini", "k=v;w=z")], "path string, content string")
    files.createOrReplaceTempView("plugin_files")
    rows = spark.sql("SELECT path, i.* FROM plugin_files, LATERAL items_of('json', path, content) i").collect()
    assert [(r.path, r.key, r.value) for r in rows] == [("a.json", "a.token", "x1")]
    for bad in ("'nothing'", "path"):
        with pytest.raises(Exception, match="kind must be"):
            spark.sql(f"SELECT i.* FROM plugin_files, LATERAL items_of({bad}, path, content) i").collect()
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ini_items(path STRING, content STRING) RETURNS TABLE (key STRING, value STRING, line INT, type STRING) RETURN SELECT split_part(p, '=', 1), split_part(p, '=', 2), 1, 'ini' FROM explode(split(content, ';')) AS e(p)")
    own = parsers.PARSERS | {"code": "ini_items"}
    assert {(r.path, r.key, r.value) for r in plugins.items(files, own).collect()} == {("a.json", "a.token", "x1"), ("d.ini", "k", "v"), ("d.ini", "w", "z")}
    engine.ScanConfig(parsers=own).write(str(tmp_path / "c.yaml"))
    assert engine.ScanConfig.read(str(tmp_path / "c.yaml")).parsers == own
