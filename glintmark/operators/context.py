"""Context of findings: neighbouring lines, file and framework, the confidence modifier, risk and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import dims

#: Lines before and after a finding that count for a group of contexts.
FRAMES = {"code": (-5, 5), "config": (-9, 5), "api": (-10, 10)}
#: Lines of a file that one window task takes; longer files are split. Lines that are joined to texts come in smaller blocks.
BLOCK, SPAN = 8192, 256
#: Different marks of paths, so a broadcast of them is bounded.
MARKS = 1 << 20
CONFIG_FILE = "(?i)\\.(ya?ml|json|toml|ini|conf|cfg|env)$|config"


def _hits(group: str, text: Column, among: Column | None = None) -> Column:
    """Names of the group's contexts that match (among: only these are tried); only line feeds end lines."""
    tried = lambda n: F.lit(True) if among is None else F.array_contains(among, n)
    return F.array_compact(F.array(*[F.when(tried(n) & text.rlike(f"(?imd){rx}"), n) for g, n, _, rx in dims.CONTEXTS if g == group]))


def _block(line: Column) -> Column:
    return F.floor(line / BLOCK)


def _blocks(lines: DataFrame, before: int, after: int) -> DataFrame:
    """lines with a block of their file, and once more in the neighbour that their frames reach into.

    Windows by (path, block) then see all they need, so a huge file is many small groups. `_own` drops the extra rows.
    """
    reached = F.array_distinct(F.array(_block(F.col("line") - after), _block(F.col("line")), _block(F.col("line") + before)))
    return lines.select("*", F.explode(reached).alias("block"))


def _own(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("block").eqNullSafe(_block(F.col("line")))).drop("block")


def _span(line: Column, after: int, block: int) -> Column:
    """A line's block. Blocks begin a window's reach before a file's first line, else its first lines would be in the block before, too."""
    return F.floor((line + F.lit(float(after))) / block)


def _held(lines: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """path, line, text, block: lines in their block and in those whose windows reach them."""
    reached = F.sequence(_span(F.col("line") - after, after, block), _span(F.col("line") + before, after, block))
    return lines.select("path", "line", "text", F.explode(reached).alias("block"))


def line_contexts(lines: DataFrame, findings: DataFrame, frame: int = 5, block: int = SPAN) -> DataFrame:
    """path, line, code, config, api: contexts in the text of the lines around each line with a finding.

    A pattern may go over line ends: it is looked for in the window's lines, joined. Lines are brought together in blocks that overlap by the widest window, only
    those that hold a finding's window, so neither a long file nor one with many findings is a large group. The block's size changes nothing.
    Where each line is a finding (findings is lines), a block's own lines tell which are wanted: lines are read once, and meet in their tasks before the shuffle.

    A block is one row with all its findings' lines. What its whole text doesn't match none of its windows does, as windows end where lines end and no context looks
    around (a test asks for that): each window is tried on the rest only, and one that is the whole block on nothing.
    """
    spans = FRAMES | {"code": (-frame, frame)}
    before, after = max(-a for a, _ in spans.values()), max(b for _, b in spans.values())
    number = lambda line: _span(line, after, block)
    held = _held(lines, before, after, block)
    gathered = F.sort_array(F.collect_list(F.struct("line", "text"))).alias("lines")
    if findings is lines:
        own = F.filter("lines", lambda x: number(x["line"]) == F.col("block"))
        together = held.where("path is not null").groupBy("path", "block").agg(gathered)
        blocks = together.withColumn("wanted", F.array_distinct(F.transform(own, lambda x: x["line"]))).where(F.size("wanted") > 0)
    else:
        wanted = findings.where("line is not null").groupBy("path", number(F.col("line")).alias("block")).agg(F.collect_set("line").alias("wanted"))
        together = held.join(wanted.select("path", "block"), ["path", "block"], "left_semi").groupBy("path", "block").agg(gathered)
        blocks = wanted.join(together, ["path", "block"])
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), "\n")
    low, high = F.get("lines", F.lit(0))["line"], F.element_at("lines", -1)["line"]
    none = F.array().cast("array<string>")

    def near(group: str, line: Column, whole: Column) -> Column:
        first, last = line + spans[group][0], line + spans[group][1]
        same = (F.size(whole) == 0) | ((low >= first) & (high <= last))
        own = lambda: F.filter("lines", lambda x: x["line"].between(first, last))
        return F.when(same, whole).otherwise(X.let(joined(own()), lambda text: _hits(group, text, whole)))

    wholes = X.let(joined(F.col("lines")), lambda text: F.struct(_hits("code", text).alias("code"), F.when(F.col("path").rlike(CONFIG_FILE), _hits("config", text)).otherwise(none).alias("config"), _hits("api", text).alias("api")))
    each = X.let(wholes, lambda whole: F.transform("wanted", lambda line: F.struct(line.alias("line"), *[near(g, line, whole[g]).alias(g) for g in ("code", "config", "api")])))
    return blocks.select("path", F.inline(each))


def file_contexts(path: Column) -> Column:
    """Names of file contexts: production and the like by substrings, then files with a telling name."""
    low = F.lower(path)
    special = [F.when(X.basename(low).contains(k) | (X.extension(low) == k), n) for k, (n, _) in dims.SPECIAL_FILES.items()]
    named = [F.when(low.rlike(rx), n) for g, n, _, rx in dims.CONTEXTS if g == "file"]
    return F.array_compact(F.array(*named, *special))


def framework_contexts(files: DataFrame) -> DataFrame:
    x = files.select("path", F.array_union(_hits("framework", F.col("content")), _hits("framework", F.lower("path"))).alias("framework"))
    # A file that comes in parts has the contexts of all of them; each is a few names.
    return x.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_set("framework"))).alias("framework")) if "first_line" in files.columns else x


def modifiers(names: Column, group: str) -> Column:
    values = {n: m for g, n, m, _ in dims.CONTEXTS if g == group} | ({n: m for n, m in dims.SPECIAL_FILES.values()} if group == "file" else {})
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.element_at(table, n))


def combined_modifier(values: Column, least: float = 0.1, most: float = 2.0) -> Column:
    """Strongest modifier with weight .5, second .3, the rest share .2; one alone counts whole, none is 1."""

    def mixed(ordered: Column) -> Column:
        n = F.size(ordered)
        rest = F.aggregate(F.slice(ordered, 3, F.greatest(n - 2, F.lit(1))), F.lit(0.0), lambda a, x: a + x)
        mix = F.get(ordered, F.lit(0)) * 0.5 + F.get(ordered, F.lit(1)) * 0.3 + F.when(n > 2, rest * 0.2 / F.greatest(n - 2, F.lit(1))).otherwise(0.0)
        chosen = F.when(n == 0, 1.0).when(n == 1, F.get(ordered, F.lit(0))).otherwise(mix)
        return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), F.round(chosen, 9))))

    return X.let(F.sort_array(values, asc=False), mixed)


def risk_level(contexts: Column, modifier: Column) -> Column:
    has = lambda n: F.array_contains(contexts, n)
    return (
        F.when(has("production_indicators"), "high").when(has("staging_indicators"), "medium").when(has("test_indicators") | has("development_indicators"), "low")
        .when(modifier >= 1.5, "high").when(modifier >= 1.0, "medium").otherwise("low")
    )


def adjusted_severity(severity: Column, risk: Column, confidence: Column) -> Column:
    """One step up at high risk and confidence above .8, one down at low risk or confidence below .3."""
    steps = F.array(*[F.lit(s) for s in dims.SEVERITIES])
    at = F.array_position(steps, severity)
    up, down = (risk == "high") & (confidence > 0.8), (risk == "low") | (confidence < 0.3)
    to = F.when(up, F.least(at + 1, F.lit(5))).when(down, F.when(at > 2, at - 1).otherwise(at)).otherwise(at)
    return F.when(at > 0, F.get(steps, (to - 1).cast("int"))).otherwise(severity)


def reasoning(modifier: Column, primary: Column) -> Column:
    """Why a confidence was changed, in words (fixed values)."""
    high = F.concat(F.lit("High confidence due to "), primary, F.lit(" context in production-like environment"))
    return (
        F.when(modifier > 1.3, high).when(modifier > 1.0, F.concat(F.lit("Increased confidence due to "), primary, F.lit(" context")))
        .when(modifier < 0.5, "Reduced confidence due to test/example context").otherwise(F.concat(F.lit("Standard confidence with "), primary, F.lit(" context")))
    )


def marked(files: DataFrame, findings: DataFrame) -> DataFrame:
    """files without most of those that have no finding, so that few of a scan's texts are cut into lines and shuffled again; exact joins are left to the contexts.

    Paths are told by a hash with MARKS values. However many findings there are, no more rows than that are broadcast.
    """
    mark = F.pmod(F.xxhash64("path"), F.lit(MARKS)).cast("int")
    marks = findings.select(mark.alias("__mark")).distinct()
    return files.join(F.broadcast(marks), mark == F.col("__mark"), "left_semi")


def with_words(findings: DataFrame) -> DataFrame:
    """Findings with confidence_reasoning and context_descriptions, behind the columns of with_context that they follow from."""
    told = F.create_map(*[F.lit(v) for kv in dims.DESCRIPTIONS.items() for v in kv])
    described = F.transform("contexts", lambda n: F.element_at(told, n))
    words = {"confidence_reasoning": reasoning(F.col("context_modifier"), F.col("primary_context")), "context_descriptions": described}
    at = findings.columns.index("risk_level") + 1
    return X.computed(findings, words).select(*findings.columns[:at], *words, *findings.columns[at:])


def with_context(findings: DataFrame, files: DataFrame, lines: DataFrame, frame: int = 5, least: float = 0.1, most: float = 2.0, words: bool = True) -> DataFrame:
    """Findings with contexts, context_modifier, risk_level, confidence times the modifier, adjusted severity. words off: with_words is left to the caller."""
    near = line_contexts(lines, findings, frame)
    # Frameworks are told before the shuffle, so their names meet the findings, not the texts.
    wide = framework_contexts(marked(files, findings))
    x = findings.join(near, ["path", "line"], "left").join(wide, "path", "left")
    groups = ["file", "code", "config", "api", "framework"]
    empty = F.array().cast("array<string>")
    x = X.computed(x, {g: F.coalesce(file_contexts(F.col("path")) if g == "file" else F.col(g), empty) for g in groups})
    every = F.array_distinct(F.concat(*groups))
    primary = F.coalesce(*[F.get(F.col(g), F.lit(0)) for g in ("api", "config", "framework", "code", "file")], F.lit("unknown"))
    x = X.computed(x, {"context_modifier": combined_modifier(F.concat(*[modifiers(F.col(g), g) for g in groups]), least, most), "contexts": every, "primary_context": primary})
    x = x.withColumn("risk_level", risk_level(F.col("contexts"), F.col("context_modifier")))
    x = x.withColumn("confidence", F.round(F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7)) * F.col("context_modifier")), 2))
    x = x.withColumn("severity", adjusted_severity(F.col("severity"), F.col("risk_level"), F.col("confidence"))).drop(*groups)
    return with_words(x) if words else x


def config_section(lines: DataFrame, reach: int = 15) -> DataFrame:
    """path, line, section: the nearest preceding key:, [section] or "key": within reach lines; root if none."""
    own = F.coalesce(*[F.nullif(F.regexp_extract("text", rx, 1), F.lit("")) for rx in ("^\\s*([a-zA-Z_][a-zA-Z0-9_]*):", "^\\s*\\[([^\\]]+)\\]", '^\\s*"([^"]+)"\\s*:')])
    frame = Window.partitionBy("path", "block").orderBy("line").rangeBetween(-reach, 0)
    cut = _blocks(lines.select("path", "line", own.alias("own")), reach, 0)
    return _own(cut.select("path", "line", "block", F.coalesce(F.last("own", ignorenulls=True).over(frame), F.lit("root")).alias("section")))
