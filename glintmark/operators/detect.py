"""Detectors: each takes lines, items or pages and gives findings in one schema."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import dims
from . import anchors

FINDING = [
    ("path", "string"), ("line", "int"), ("variable", "string"), ("value", "string"), ("rule_id", "string"), ("rule_name", "string"), ("type", "string"), ("pattern", "string"),
    ("pattern_category", "string"), ("category", "string"), ("severity", "string"), ("confidence", "double"), ("entropy", "double"), ("diversity", "double"),
    ("encoding_type", "string"), ("context_type", "string"), ("description", "string"),
]


#: Candidates that line_detectors has kept, until engine.release.
KEPT: list[DataFrame] = []


def as_findings(df: DataFrame) -> DataFrame:
    """The findings schema; columns that a detector doesn't have are null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in FINDING])


def first_in_file(found: DataFrame, order: list[str]) -> DataFrame:
    """Of each (path, pattern_category, value) the first, by order. An aggregate, so a path with many hits is summed in tasks first."""
    rest = [c for c in found.columns if c not in ("path", "pattern_category", "value")]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("x")
    return found.groupBy("path", "pattern_category", "value").agg(first).select("path", "pattern_category", "value", "x.*")


VALUE = "[A-Za-z0-9_\\-./+=]"
# One pattern finds every "word = value"; the lookahead lets candidates overlap. Which words count is a join's business.
CANDIDATE = f"\\b(\\w+)\\b(?=\\s*[:=]\\s*(['\"]?{VALUE}{{6,}}['\"]?))"


# Keywords with a dot in them need the whole dotted word.
DOTTED = CANDIDATE.replace("(\\w+)", "(\\w+\\.\\w+)", 1)
#: What every detector's candidates are until they are judged.
FOUND = "struct<kind: string, pos: int, word: string, value: string>"


def _pairs(kind: str, text: Column, *patterns: str) -> Column:
    """One FOUND a hit, the first group as word and the second as value."""
    pairs = [F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), 1).alias("w"), F.regexp_extract_all(text, F.lit(rx), 2).alias("v")) for rx in patterns]
    return F.transform(F.concat(*pairs) if len(pairs) > 1 else pairs[0], lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["w"].alias("word"), x["v"].alias("value")))


def _where(test: Column, hits: Column) -> Column:
    return F.when(test, hits).otherwise(F.array().cast(f"array<{FOUND}>"))


def keyword_hits(text: Column) -> Column:
    return _where(text.rlike(f"[:=]\\s*['\"]?{VALUE}{{6}}"), _pairs("keyword", text, CANDIDATE, DOTTED))


# What a text with one of dims.STRUCTURAL has in it: -----BEGIN A3T AKIA AGPA AIDA AROA AIPA ANPA ANVA ASIA AIza eyJ xox k_live_ ghp_ gho_ ghu_ ghs_ ghr_ sk- hf_.
# Each is looked for from a rare character on, so most of a text is passed over by one test of a class.
STRUCTURAL_MARK = "[_JBAx-](?:(?<=k_)live_|(?<=gh[pousr]_)|(?<=hf_)|(?<=eyJ)|(?<=-----B)EGIN|(?<=sk-)|(?<=A)(?:3T|KIA|GPA|IDA|ROA|IPA|NPA|NVA|SIA|Iza)|(?<=x)ox)"


def structural_likely(text: Column, patterns: list[tuple] = dims.STRUCTURAL) -> Column:
    return text.rlike(STRUCTURAL_MARK if patterns is dims.STRUCTURAL else "|".join(f"(?:{p[1]})" for p in patterns))


def likely_lines(lines: DataFrame, structural: bool, assigned: bool) -> DataFrame:
    """Lines with what a structural pattern, or a detector of assigned and quoted values, begins with. One pattern, so a text is decoded once."""
    return lines.where(F.col("text").rlike("|".join(["[:=\"']"] * assigned + [STRUCTURAL_MARK] * structural)))


def structural_hits(text: Column, patterns: list[tuple] = dims.STRUCTURAL) -> Column:
    """pos is the pattern's place in the list."""
    rows = F.array(*[F.struct(F.lit("structural").alias("kind"), F.lit(i).alias("pos"), F.lit(n).alias("word"), F.regexp_extract(text, rx, 0).alias("value")) for i, (n, rx, *_) in enumerate(patterns)])
    return _where(structural_likely(text, patterns), F.filter(rows, lambda x: x["value"] != ""))


def entropy_hits(text: Column) -> Column:
    text = F.trim(text)
    alone = F.transform(F.regexp_extract_all(text, F.lit(STANDALONE), 1), lambda v: F.struct(F.lit("entropy").alias("kind"), F.lit(0).alias("pos"), F.lit("").alias("word"), v.alias("value")))
    pairs = F.filter(_pairs("entropy", text, *ASSIGNMENTS), lambda x: F.length(x["value"]) >= 8)
    return _where(~F.coalesce(text, F.lit("")).rlike("^(#|//|/\\*|$)") & text.rlike("[:=\"']"), F.concat(pairs, alone))


def technology_hits(text: Column, own: Column) -> Column:
    """own: the technologies whose keywords count here."""
    text = F.trim(text)
    hits = F.filter(_pairs("technology", text, TECH_CANDIDATE), lambda x: (F.length(x["value"]) >= 8) & ~F.lower(x["value"]).rlike(TECH_HARMLESS))
    return _where((F.size(own) > 0) & text.rlike("[:=]") & ~text.rlike("^(#|//)"), hits)


def candidates(lines: DataFrame, *hits: Column) -> DataFrame:
    """path, line, kind, pos, word, value: what several detectors find in a line, in one pass over the lines."""
    return lines.select("path", "line", F.explode(F.concat(*hits) if len(hits) > 1 else hits[0]).alias("x")).select("path", "line", "x.*")


def keyword_findings(lines: DataFrame, keywords: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Assignments to keywords. keywords is a fixed dimension (dims.keywords), so it is broadcast. found: candidates, if they are there already."""
    raw = F.col("value")
    x = (candidates(lines, keyword_hits(F.col("text"))) if found is None else found.where("kind = 'keyword'")).select(
        "path", "line", "pos", F.lower("word").alias("word"), raw.rlike("^['\"].*['\"]$").alias("quoted"), raw.rlike("^['\"]").alias("opened"), F.regexp_replace(raw, "['\"]", "").alias("value")
    )
    n = F.length("value")
    enough = ~F.col("generic") | (F.col("quoted") & (n >= 8)) | (~F.col("opened") & (n >= 12))
    hits = x.join(F.broadcast(keywords), F.col("word") == F.col("keyword")).where(enough)
    # As a search would: of a keyword's hits on a line the first.
    key = ["path", "line", "category_ix", "keyword_ix"]
    first = hits.groupBy(*key).agg(F.min(F.struct("pos", "value", "category", "keyword", "severity", "confidence")).alias("x")).select(*key, "x.*")
    named = first.select(
        "path", "line", "category_ix", "keyword_ix", "value", F.col("category").alias("pattern_category"), F.initcap(F.replace(F.col("keyword"), F.lit("_"), F.lit(" "))).alias("pattern"),
        F.col("keyword").alias("variable"), "severity", "confidence",
    )
    once = first_in_file(named, ["line", "category_ix", "keyword_ix"])
    return as_findings(once.withColumns({"rule_id": F.lit("keyword_assignment"), "rule_name": F.col("pattern"), "type": F.lit("regex_match"), "category": F.col("pattern_category"), "description": F.concat(F.lit("Value assigned to "), "variable")}))


def structural_findings(lines: DataFrame, patterns: list[tuple] = dims.STRUCTURAL, found: DataFrame | None = None) -> DataFrame:
    """Credentials that their own form gives away: first hit of each pattern on a line, each value once a file."""
    x = candidates(lines, structural_hits(F.col("text"), patterns)) if found is None else found.where("kind = 'structural'")
    of = lambda k: F.get(F.array(*[F.lit(p[k]) for p in patterns]), F.col("pos"))
    hits = x.select("path", "line", F.col("pos").alias("ix"), F.col("word").alias("pattern"), "value", of(2).alias("severity"), of(3).alias("confidence"))
    once = first_in_file(hits.withColumn("pattern_category", F.lit(dims.STRUCTURAL_CATEGORY)), ["line", "ix"])
    return as_findings(once.withColumns({"rule_id": F.lit("structural_pattern"), "rule_name": F.col("pattern"), "type": F.lit("regex_match"), "category": F.col("pattern_category"), "description": F.concat("pattern", F.lit(" by its form"))}))


def extended_findings(lines: DataFrame, patterns: list[tuple] = dims.EXTENDED, categories: list[str] | None = None) -> DataFrame:
    """The second library: the bare value where a pattern has a group for it, else the whole match; each value once a file and category.

    Only patterns whose literals a line holds are tried on it (see anchors).
    """
    chosen = [p for p in patterns if not categories or p[0] in categories]
    told = lines.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(chosen)], "ix int, pattern_category string, pattern string, rx string, severity string, confidence double, part int")
    likely = anchors.candidates(lines.where(F.col("text").rlike("[=:'\"@$.-]")).select("path", "line", "text"), "text", {i: p[2] for i, p in enumerate(chosen)})
    value = F.expr("coalesce(nullif(regexp_extract(text, rx, part), ''), regexp_extract(text, rx, 0))")
    hits = likely.join(F.broadcast(told), "ix").select("path", "line", "ix", "pattern_category", "pattern", value.alias("value"), "severity", "confidence").where("value <> ''")
    once = first_in_file(hits, ["line", "ix"])
    return as_findings(once.withColumns({"rule_id": F.lit("extended_pattern"), "rule_name": F.col("pattern"), "type": F.lit("regex_match"), "category": F.col("pattern_category"), "description": F.concat("pattern", F.lit(" in text"))}))


ASSIGNMENTS = [
    "(?i)(\\w+)\\s*[:=]\\s*[\"']([^\"']+)[\"']",
    "(?i)(\\w+)\\s*[:=]\\s*([^\\s,;]+)",
    "(?i)export\\s+(\\w+)=[\"']?([^\"']+)[\"']?",
    "(?i)set\\s+(\\w+)=[\"']?([^\"']+)[\"']?",
    "(?i)env\\s+(\\w+)\\s*[:=]\\s*[\"']?([^\"']+)[\"']?",
]
STANDALONE = "[\"']([A-Za-z0-9+/=_-]{16,})[\"']"


def entropy_candidates(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path, line, variable, value: assigned values of 8 characters or more, and quoted strings. Comments are left out."""
    x = candidates(lines, entropy_hits(F.col("text"))) if found is None else found.where("kind = 'entropy'")
    return x.select("path", "line", F.col("word").alias("variable"), "value")


def entropy_findings(candidates: DataFrame, threshold: float | None = None) -> DataFrame:
    """Values whose entropy, length and confidence suffice for their encoding. threshold takes the place of all thresholds."""
    v = F.col("value")
    kept = candidates.where((F.length(v) >= min(X.LENGTH_AT.values())) & ~X.looks_harmless(v))
    measures = F.struct(X.encoding_type(v).alias("encoding_type"), X.name_context(F.col("variable"), F.col("path")).alias("context_type"), X.entropy(v).alias("bits"), X.diversity(v).alias("variety"))
    # A generated row: filters on the measures aren't pushed below it, where they would be computed once a mention.
    x = kept.select("*", F.explode(F.array(measures)).alias("m")).select("*", "m.*").drop("m")
    x = x.withColumn("confidence", X.entropy_confidence(v, F.col("encoding_type"), F.col("context_type"), F.col("bits"), F.col("variety")))
    enough = F.lit(threshold) if threshold is not None else X.by_encoding(F.col("encoding_type"), X.ENTROPY_AT)
    x = x.where((F.col("bits") >= enough) & (F.length("value") >= X.by_encoding(F.col("encoding_type"), X.LENGTH_AT)) & (F.col("confidence") >= 0.5))
    severity = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return as_findings(
        x.withColumns({
            "rule_id": F.concat(F.lit("enhanced_entropy_"), "encoding_type"), "rule_name": F.concat(F.lit("Entropy of a value, "), "encoding_type"), "type": F.lit("enhanced_entropy_match"), "severity": severity,
            "entropy": F.round("bits", 2), "diversity": F.round("variety", 2), "description": F.concat(F.lit("Random-looking "), "encoding_type", F.lit(" value, "), "context_type", F.lit(" context")),
        })
    )


def legacy_entropy_findings(items: DataFrame, found: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Items with random-looking values that no detector has found in the same file."""
    v, n = F.col("value"), F.length("value")
    plain_url = v.rlike("^https?://") & ~F.coalesce(F.try_element_at(F.split(v, "//"), F.lit(2)), F.lit("")).contains(":")
    x = items.where(n.between(8, 120) & ~F.lower(v).isin("true", "false", "null", "none", "undefined") & ~plain_url)
    # Entropy is the value's own: measured once for each value of a file that nothing else has found, behind the shuffle, not for every mention.
    first = x.groupBy("path", "value").agg(F.min(F.struct("line", "key")).alias("x")).join(found.select("path", "value").distinct(), ["path", "value"], "left_anti")
    # A generated row: the filter isn't pushed below it, where entropy would be computed twice.
    x = first.select("path", "value", "x.line", F.col("x.key").alias("variable"), F.explode(F.array(X.printable_entropy(v))).alias("bits"))
    once = x.where(F.col("bits") >= threshold + F.when(n < 12, 0.5).otherwise(0.0)).withColumn("entropy", F.round("bits", 2))
    return as_findings(once.withColumns({"rule_id": F.lit("entropy"), "rule_name": F.lit("Random-looking value"), "type": F.lit("entropy_match"), "severity": F.lit("medium")}))


def name_matches(rule: dict, name: Column) -> Column:
    if not rule["names"]:
        return F.lit(False)
    test = F.coalesce(name, F.lit("")).rlike(rule["names"])
    return test & ~name.rlike(rule["not_names"]) if rule["not_names"] else test


def value_excluded(rule: dict, value: Column) -> Column:
    short = F.coalesce(F.length(value), F.lit(0)) < rule["min_length"]
    return short | value.rlike(rule["not_values"]) if rule["not_values"] else short


def value_pattern(rule: dict, value: Column) -> Column:
    """The first of the rule's value patterns that matches, else null."""
    out = F.lit(None).cast("string")
    for name, rx in reversed(rule["values"]):
        out = F.when(value.rlike(rx), name).otherwise(out)
    return F.when(F.length(value) >= rule["min_length"], out)


#: More rules than these are rows of a table, not parts of an expression.
INLINE_RULES = 64


def rule_findings(items: DataFrame, rules: list[dict] = dims.RULES) -> DataFrame:
    """Item rules: a telling name with a value that isn't excluded, else a telling value. One pass over the items for all rules."""
    if len(rules) > INLINE_RULES:
        return many_rule_findings(items, rules)
    key, value = F.col("key"), F.col("value")

    def judged(r: dict) -> Column:
        by_name = name_matches(r, key) & ~value_excluded(r, value)
        pattern = value_pattern(r, value)
        by_value = pattern.isNotNull() & (~value_excluded(r, value) if r["not_values"] else F.lit(True))
        row = lambda kind, p: F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["name"]).alias("rule_name"), F.lit(r["severity"]).alias("severity"), F.lit(kind).alias("type"), p.cast("string").alias("pattern"))
        return F.when(by_name, row("variable_name_match", F.lit(None))).when(by_value, row("value_pattern_match", pattern))

    hits = items.select("path", key.alias("variable"), value, F.coalesce("line", F.lit(0)).alias("line"), F.explode(F.array_compact(F.array(*[judged(r) for r in rules]))).alias("x"))
    return as_findings(hits.select("path", "line", "variable", "value", "x.*"))


def many_rule_findings(items: DataFrame, rules: list[dict]) -> DataFrame:
    """rule_findings with the rules as rows: thousands of them leave the plan as it is, and only those are tried whose literals are there.

    Equal items are judged once, and each rule's first reason (its name pattern, else its first value pattern) is found by an aggregate.
    """
    spark = items.sparkSession
    told = [(i, r["id"], r["name"], r["severity"], r["min_length"], r["not_names"], r["not_values"]) for i, r in enumerate(rules)]
    tests = [(i, -1, None, r["names"]) for i, r in enumerate(rules) if r["names"]] + [(i, k, name, rx) for i, r in enumerate(rules) for k, (name, rx) in enumerate(r["values"])]
    rule = spark.createDataFrame(told, "rule int, rule_id string, rule_name string, severity string, min_length int, not_names string, not_values string")
    test = spark.createDataFrame([(n, *t) for n, t in enumerate(tests)], "ix int, rule int, at int, pattern string, rx string")
    once = items.groupBy("path", "key", "value", F.coalesce("line", F.lit(0)).alias("line")).agg(F.count("*").alias("times"))
    by = lambda col, names: anchors.candidates(once, col, {n: t[3] for n, t in enumerate(tests) if (t[1] < 0) == names})
    tried = by("key", True).union(by("value", False)).join(F.broadcast(test), "ix").join(F.broadcast(rule), "rule")
    size = F.coalesce(F.length("value"), F.lit(0))
    excluded = (size < F.col("min_length")) | F.coalesce(F.expr("value rlike not_values"), F.lit(False))
    named = (F.col("at") < 0) & F.expr("coalesce(key, '') rlike rx") & ~F.coalesce(F.expr("key rlike not_names"), F.lit(False)) & ~excluded
    telling = (F.col("at") >= 0) & F.expr("value rlike rx") & (F.length("value") >= F.col("min_length")) & (F.col("not_values").isNull() | ~excluded)
    first = F.min(F.struct("at", "pattern")).alias("x")
    hits = tried.where(named | telling).groupBy("path", "line", "key", "value", "times", "rule", "rule_id", "rule_name", "severity").agg(first)
    kind = F.when(F.col("x.at") < 0, "variable_name_match").otherwise("value_pattern_match")
    each = hits.select("path", "line", F.col("key").alias("variable"), "value", "rule_id", "rule_name", "severity", kind.alias("type"), F.col("x.pattern").alias("pattern"), F.explode(F.sequence(F.lit(1), F.col("times"))))
    return as_findings(each)


def enhanced_findings(items: DataFrame, keywords: DataFrame, rules: list[dict] = dims.ENHANCED_RULES) -> DataFrame:
    """Rules, and for each of them the keyword and structural library's hits in the items' values (of its categories)."""
    x = items.select("path", F.coalesce("line", F.lit(0)).alias("line"), F.col("value").alias("text"), "key")
    # An item's hits go back to its key: the key rides in the path, behind a separator that no path has.
    keyed = x.select(F.concat_ws("\0", "path", F.coalesce("key", F.lit(""))).alias("path"), "line", "text")
    library = keyword_findings(keyed, keywords).unionByName(structural_findings(keyed))
    parts = F.split("path", "\0")
    ids = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(r["name"]).alias("name"), F.array(*[F.lit(c) for c in r.get("categories") or []]).cast("array<string>").alias("categories")) for r in rules])
    hits = library.withColumn("r", F.explode(F.filter(ids, lambda r: (F.size(r["categories"]) == 0) | F.array_contains(r["categories"], F.col("pattern_category")))))
    named = hits.withColumns({
        "variable": F.nullif(parts[1], F.lit("")), "path": parts[0], "rule_id": F.col("r.id"), "rule_name": F.concat("r.name", F.lit(" ("), "pattern", F.lit(")")), "type": F.lit("enhanced_pattern_match"),
    })
    return rule_findings(items, rules).unionByName(as_findings(named))


def technologies(path: Column) -> Column:
    """Technologies that a file belongs to, by marks in its path."""
    test = lambda m: X.matches_glob(path, m) if "*" in m else path.contains(m)
    return F.array_compact(F.array(*[F.when(X.any_of([test(m) for m in marks]), t) for t, (marks, *_) in dims.TECHNOLOGIES.items() if marks]))


TECH_HARMLESS = "true|false|null|none|undefined|todo|fixme|example|sample|test|demo|placeholder|changeme|\\$"
TECH_CANDIDATE = "(\\w+)\\s*[:=]\\s*['\"]?([^'\"\\s{}]+)['\"]?"


def technology_findings(lines: DataFrame, keywords: DataFrame, every: bool = False, found: DataFrame | None = None) -> DataFrame:
    """Assignments to keywords of the technologies that the file belongs to (every: of all technologies).

    The keyword may be the end of a longer word. Candidates are cut into their ends at underscores, which join the
    broadcast dimension by equality.
    """
    own = F.array(*[F.lit(t) for t in dims.TECHNOLOGIES]) if every else technologies(F.col("path"))
    x = candidates(lines, technology_hits(F.col("text"), own)) if found is None else found.where("kind = 'technology'")
    x = x.select("path", "line", own.alias("own"), F.lower("word").alias("word"), "value")
    parts = F.split("word", "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    x = x.select("*", F.explode(ends).alias("end"))
    x = x.join(F.broadcast(keywords), F.col("end") == F.col("keyword")).where(F.array_contains("own", F.col("technology")))
    telling = F.col("keyword").rlike("private_key|secret_key|password|token")
    points = 0.8 + F.when(F.length("value") >= 32, 0.1).otherwise(0.0) + F.when(F.col("keyword").rlike("api_key|secret_key|private_key|token"), 0.1).otherwise(0.0)
    return as_findings(
        x.select("path", "line", F.col("keyword").alias("variable"), "value", F.col("technology").alias("category"), F.when(telling, "critical").otherwise(F.col("technology_severity")).alias("severity"), F.round(F.least(points, F.lit(1.0)), 6).alias("confidence"))
        .distinct()
        .withColumns({"rule_id": F.concat(F.lit("tech_"), F.regexp_replace(F.lower("category"), "[^a-z]+", "_")), "rule_name": F.concat("category", F.lit(" credential")), "type": F.lit("technology_match"), "pattern_category": F.col("category")})
    )


WEB_HARMLESS = "(?i)^\\s*(//|/\\*|\\*|<!--)|function\\s*\\(|addEventListener|\\.(min\\.js|css|png|jpe?g|svg)\\b|placeholder\\s*=|type\\s*=\\s*[\"']password"


def web_findings(pages: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Assignments to credential words in fetched pages, markup taken out and character references decoded first."""
    words = words or dims.GENERAL
    plain = F.regexp_replace("html", "(?s)<[^>]*>", " ")
    for code, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    x = pages.select(F.col("url").alias("path"), F.posexplode(F.split(plain, "\n")).alias("k", "text")).where(~F.col("text").rlike(WEB_HARMLESS))
    rx = f"(?i)\\b({'|'.join(words)})\\b\\s*[:=]\\s*[\"']?([A-Za-z0-9_\\-./+=]{{8,}})[\"']?"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), 1).alias("w"), F.regexp_extract_all("text", F.lit(rx), 2).alias("v"))
    found = x.where(F.col("text").rlike(rx)).select("path", (F.col("k") + 1).alias("line"), F.explode(both).alias("x")).select("path", "line", F.lower("x.w").alias("variable"), F.col("x.v").alias("value")).distinct()
    return as_findings(found.withColumns({"rule_id": F.lit("web_keyword"), "rule_name": F.lit("Credential in a page"), "type": F.lit("web_match"), "severity": F.lit("high")}))


def line_detectors(spark: SparkSession, lines: DataFrame, keywords: DataFrame | None, structural: bool = True, technology: bool = True, entropy: bool = True, threshold: float | None = None) -> list[DataFrame]:
    """Findings of the detectors that are on (keyword: if keywords are given). The lines are read once: candidates are few, kept, and judged by each."""
    text, own = F.col("text"), technologies(F.col("path"))
    hits = [keyword_hits(text)] * (keywords is not None) + [structural_hits(text)] * structural + [technology_hits(text, own)] * technology + [entropy_hits(text)] * entropy
    if not hits:
        return []
    # Few lines have what any detector begins with; on the others none of them is tried.
    found = candidates(likely_lines(lines, structural, keywords is not None or technology or entropy), *hits).persist(StorageLevel.MEMORY_AND_DISK)
    KEPT.append(found)
    return (
        ([keyword_findings(lines, keywords, found)] if keywords is not None else [])
        + ([structural_findings(lines, found=found)] if structural else [])
        + ([technology_findings(lines, dims.technology_keywords(spark), found=found)] if technology else [])
        + ([entropy_findings(entropy_candidates(lines, found), threshold)] if entropy else [])
    )
