"""One scan from files to reported findings: settings and the chain of operators."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, context, detect, merge, plugins, score
from ..sources import files as S
from ..sources import archives, images, parsers
from . import dims


ARCHIVE_NAMES = "(?i)\\.(zip|jar|war|ear|apk|ipa|tar|tgz|tbz2|txz|gz|bz2|xz)$"
SQLITE_NAMES = "(?i)\\.(sqlite3?|db)$"


#: What scans have kept, until release.
KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


@dataclass
class ScanConfig:
    """Settings of a scan. Presets: `full` (all detectors), `cli` (those on lines only), `strict`, `permissive`."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    keyword: bool = True
    structural: bool = True
    technology: bool = True
    entropy: bool = True
    extended: bool = False
    items: bool = True
    entries: bool = True
    rules: list[dict] = field(default_factory=lambda: [*dims.RULES, *dims.ENHANCED_RULES])
    parsers: dict = field(default_factory=lambda: dict(parsers.PARSERS))
    analyzers: dict = field(default_factory=dict)
    entropy_threshold: float | None = None
    min_length: int = 6
    keyword_file: str | None = None
    categories: list[str] = field(default_factory=list)
    disabled_categories: list[str] = field(default_factory=list)
    severity_at_least: str = "info"
    context_window: int = 5
    min_context: float = 0.1
    min_overall: float = 0.3
    max_multiplier: float = 2.0
    weights: dict[str, float] = field(default_factory=dict)
    use_context: bool = True
    use_scores: bool = True
    deduplicate: bool = True

    @classmethod
    def preset(cls, name: str) -> "ScanConfig":
        return {
            "full": cls(), "cli": cls(items=False, entries=False),
            "strict": cls(min_context=0.3, context_window=8, max_multiplier=1.8), "permissive": cls(min_context=0.05, context_window=3, max_multiplier=2.5, min_overall=0.0),
        }[name]

    def write(self, path: str) -> None:
        """JSON or YAML, by the name's ending. Parsers and analyzers that are code stay out, names of table functions go in."""
        named = lambda given: {k: v for k, v in given.items() if isinstance(v, str)}
        dims.write_tree(asdict(replace(self, parsers=named(self.parsers), analyzers=named(self.analyzers))), path)

    @classmethod
    def read(cls, path: str) -> "ScanConfig":
        told = dims.read_tree(path)
        config = cls(**{k: [r | {"values": [tuple(v) for v in r["values"]]} for r in v] if k == "rules" else v for k, v in told.items() if k != "parsers"})
        return replace(config, parsers=config.parsers | (told.get("parsers") or {}))


def item_findings(items: DataFrame, keywords: DataFrame | None, rules: list[dict], threshold: float | None = None) -> list[DataFrame]:
    """Rules, the library in values, and random-looking values that neither has found."""
    plain, with_library = [r for r in rules if "categories" not in r], [r for r in rules if "categories" in r]
    parts = [detect.rule_findings(items, plain)] if plain else []
    if with_library:
        parts.append(detect.enhanced_findings(items, keywords, with_library) if keywords is not None else detect.rule_findings(items, with_library))
    found = reduce(DataFrame.unionByName, parts) if parts else detect.as_findings(items.limit(0))
    return [*parts, detect.legacy_entropy_findings(items, found, threshold or 4.0)]


def entry_findings(entries: DataFrame) -> DataFrame:
    slug = F.regexp_replace(F.lower("rule_name"), "[^a-z0-9]+", "_")
    return detect.as_findings(entries.withColumns({"rule_id": slug, "type": F.lit("entry_match"), "pattern": F.col("rule_name"), "pattern_category": F.col("category"), "confidence": F.lit(0.8), "description": F.concat("rule_name", F.lit(": "), F.coalesce("variable", F.lit("")))}))


def detections(spark: SparkSession, files: DataFrame, lines: DataFrame, config: ScanConfig, more_items: DataFrame | None = None, more_entries: DataFrame | None = None) -> DataFrame:
    """Findings of all detectors that are on. more_items and more_entries: of files that aren't text (databases, images)."""
    wanted = lambda k: (not config.categories or k in config.categories) and k not in config.disabled_categories
    lists = {k: v for k, v in dims.keyword_lists(config.keyword_file).items() if wanted(k)}
    keywords = dims.keywords(spark, lists) if config.keyword and lists else None
    parts = detect.line_detectors(spark, lines, keywords, config.structural and wanted(dims.STRUCTURAL_CATEGORY), config.technology, config.entropy, config.entropy_threshold)
    once = {"tech_": ["path", "line", "variable", "value"], "enhanced_entropy_": ["path", "line", "value"]}
    if config.entropy:
        parts[-1] = merge.highest_confidence(parts[-1], once["enhanced_entropy_"])
    if config.technology:
        at = len(parts) - 1 - config.entropy
        parts[at] = merge.highest_confidence(parts[at], once["tech_"])
    if config.extended:
        parts.append(detect.extended_findings(lines))
    if config.items:
        items = plugins.items(files, config.parsers)
        # The rules, the library and the entropy part read the items several times: kept (memory and disk), so that each file is parsed once.
        items = kept(items if more_items is None else items.unionByName(more_items))
        parts += item_findings(items, keywords, config.rules)
    if config.entries:
        entries = parsers.entries(files)
        parts.append(entry_findings(entries if more_entries is None else entries.unionByName(more_entries)))
    parts += plugins.analyzed(files, lines, config.analyzers)
    if not parts:
        return detect.as_findings(lines.limit(0))
    return reduce(DataFrame.unionByName, [p.select(*[n for n, _ in detect.FINDING]) for p in parts]).where(F.length("value") >= config.min_length)


def scan_binary(spark: SparkSession, binary: DataFrame, config: ScanConfig | None = None, exclusions: dict | None = None) -> DataFrame:
    """Like scan, of files as bytes (path, content): archives are opened, databases and image archives read, the rest is text."""
    config = config or ScanConfig()
    binary = binary.where(S.admitted(F.col("path"), config.include, config.exclude)).select("path", "content")
    packed = binary.where(S.route(F.col("path")) == "binary")
    # Detectors and context read the texts several times: archives are opened once and their texts kept (memory and disk).
    inside = parsers.archive_files(packed.where(F.col("path").rlike(ARCHIVE_NAMES))).where("not skipped").select("path", "content")
    inside = kept(inside)
    plain = S.texts(binary.where(~F.coalesce(S.route(F.col("path")) == "binary", F.lit(False))))
    entries = parsers.image_entries(packed.where(F.col("path").rlike("(?i)\\.tar$")))
    baked = entries.select("path", F.coalesce("line", F.lit(1)).alias("line"), F.lit("Credential in an image").alias("rule_name"), F.lit("critical").alias("severity"), F.lit("docker").alias("category"), F.col("key").alias("variable"), "value")
    rows = parsers.sqlite_items(packed.where(F.col("path").rlike(SQLITE_NAMES)))
    return scan(spark, plain.unionByName(inside), config, exclusions, rows, baked)


def scan_archives(spark: SparkSession, at: str, config: ScanConfig | None = None, exclusions: dict | None = None, **options) -> DataFrame:
    """Like scan, of the members of archives below at, however large: see archives.read for splits, parts and options.

    Lines, contexts and technologies go over all parts of a member; items and infrastructure entries need a member whole, which those of
    up to partBytes are. `unread` tells what gave nothing.
    """
    config = config or ScanConfig()
    members = archives.read(spark, at, **options).where("status = 'ok'").select("path", "content", "first_line", "whole")
    return scan(spark, members, config, exclusions)


def unread(spark: SparkSession, binary: DataFrame) -> DataFrame:
    """path, status (failed, skipped), reason: what scan_binary gets nothing from, in archives and databases (path, content)."""
    packed = binary.where(S.route(F.col("path")) == "binary").select("path", "content")
    inside = archives.rows(packed.where(F.col("path").rlike(ARCHIVE_NAMES))).where("status <> 'ok'").select("path", "status", "reason")
    tables = parsers.sqlite_rows(packed.where(F.col("path").rlike(SQLITE_NAMES))).where("type = 'failed'")
    layers = images.rows(packed.where(F.col("path").rlike("(?i)\\.tar$"))).where("kind = 'failed' and layer is not null")
    inside = inside.union(layers.select(F.concat_ws("!", "image", "layer").alias("path"), F.lit("failed").alias("status"), F.col("value").alias("reason")))
    return inside.union(tables.select(F.concat_ws("!", "path", "key").alias("path"), F.lit("failed").alias("status"), F.col("value").alias("reason")))


def scan(spark: SparkSession, files: DataFrame, config: ScanConfig | None = None, exclusions: dict | None = None, more_items: DataFrame | None = None, more_entries: DataFrame | None = None) -> DataFrame:
    """Findings of files (path, content): detectors, baseline, context, scores, filters, groups, test values.

    exclusions: arguments of baseline.with_exclusions. Nothing runs until the result is written or read. Candidates, items and
    findings are kept meanwhile (memory and disk), as they are few against the lines; `release` gives them up.
    """
    config = config or ScanConfig()
    files = files.where(S.admitted(F.col("path"), config.include, config.exclude))
    lines = S.lines(files)
    # Of files that come in parts only those in one part are trees that a parser can read.
    x = detections(spark, files.where("whole") if "whole" in files.columns else files, lines, config, more_items, more_entries)
    # The context joins need the findings three times. Each detector's partitions are there one behind the other: as many small tasks every time.
    x = kept(S.fewer(x)) if config.use_context else x
    if exclusions:
        x = baseline.reported(x, **exclusions)
    # What only says in words what other columns hold is made of the merged rows: fewer, and merging sorts and shuffles shorter ones.
    now = not config.deduplicate
    if config.use_context:
        lines = S.lines(context.marked(files, x))
        x = context.with_context(x, files, lines, config.context_window, config.min_context, config.max_multiplier, words=now)
    if config.use_scores:
        x = score.scored(x, config.weights, listed=now)
    x = score.confident(x, config.min_context, config.min_overall)
    if config.deduplicate:
        x = merge.merged(x)
        x = context.with_words(x) if config.use_context else x
        x = score.with_factors(x, config.weights) if config.use_scores else x
        x = merge.with_test_flag(x)
    if config.severity_at_least != "info":
        x = x.where(merge.rank_of(F.col("severity")) >= dims.SEVERITIES.index(config.severity_at_least))
    return x


def release(spark: SparkSession) -> None:
    """Gives up what scans of this session have kept, once their results are written; what others cache stays."""
    for df in detect.KEPT + KEPT:
        df.unpersist()
    detect.KEPT.clear()
    KEPT.clear()
