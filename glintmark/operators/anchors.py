"""Many patterns on many texts: only those whose literals a text holds are tried on it.

Of each regular expression follow literals, one of which must be in every text that it matches (its anchors). One pass over a text finds
all anchors in it, through one expression in the shape of a trie, so its cost doesn't grow with the number of patterns. The anchors found
join the patterns by equality, and only these are tried. Patterns are rows of a table, not branches of an expression: the plan is the
same for ten as for ten thousand. A pattern without anchors is tried on every text, so nothing is missed.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as K
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the shortest literal that is an anchor.
LEAST = 2
#: The anchor of patterns that have none.
ALWAYS = ""


def anchors(pattern: str) -> set[str]:
    """Lower-case literals of which a match holds at least one; only ALWAYS if none can be named."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        if re.search(r"\(\?[a-zA-Z]*x", pattern):
            return {ALWAYS}
        try:
            # Flags may stand anywhere in Java; literals are compared in lower case anyway.
            tree = parser.parse(re.sub(r"\(\?[a-zA-Z]*(?:-[a-zA-Z]+)?\)", "", pattern))
        except re.error:
            return {ALWAYS}
    return _of(tree) or {ALWAYS}


def _of(tree) -> set[str] | None:
    found: list[set[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if len(run) >= LEAST and run.isascii():
            found.append({run})
        run = ""

    for op, arg in tree:
        if op is K.LITERAL:
            run += chr(arg).lower()
            continue
        end()
        inner = None
        if op is K.SUBPATTERN:
            inner = _of(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
            inner = _of(arg[2])
        elif op is K.BRANCH:
            each = [_of(x) for x in arg[1]]
            inner = set().union(*each) if all(each) else None
        if inner:
            found.append(inner)
    end()
    # The longest shortest literal rules out most texts; of equal ones the smaller set.
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def trie(words: list[str]) -> str:
    """A regular expression for the longest of words at a place, with common beginnings written once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        more = [re.escape(c) + written(x) for c, x in sorted(at.items()) if c]
        if not more:
            return ""
        body = more[0] if len(more) == 1 and "" not in at else f"(?:{'|'.join(more)})"
        return f"{body}?" if "" in at else body

    return written(tree)


def candidates(texts: DataFrame, text_col: str, patterns: dict[int, str]) -> DataFrame:
    """texts with ix once for each pattern that may match text_col, for repeated rows each time. patterns: by number, a list that someone wrote."""
    of = {ix: anchors(rx) for ix, rx in patterns.items()}
    words = sorted({a for x in of.values() for a in x if a})
    starts: dict[str, list[str]] = {w: [] for w in words}
    for w in words:
        for n in range(LEAST, len(w) + 1):
            if w[:n] in starts:
                starts[w[:n]].append(w)
    # An anchor that another one begins with is there, too, where that is found: the trie gives the longest of a place.
    rows = []
    for ix, own in of.items():
        every = sorted({longer for a in own if a for longer in starts[a]} | (own & {ALWAYS}))
        rows += [(a, ix, every) for a in every]
    posting = F.broadcast(texts.sparkSession.createDataFrame(rows or [(ALWAYS, -1, [ALWAYS])], "anchor string, ix int, every array<string>"))
    low = F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({trie(words)}))"), 1)) if words else F.array().cast("array<string>")
    x = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("row"), F.array_append(found, F.lit(ALWAYS)).alias("found"))
    x = x.select("row", "found", F.explode("found").alias("anchor")).join(posting, "anchor")
    # Of a pattern's anchors in a text the first one found keeps it, so no pattern comes twice.
    return x.where(F.col("anchor") == F.get(F.filter("found", lambda a: F.array_contains("every", a)), F.lit(0))).select("row.*", "ix")
