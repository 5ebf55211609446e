"""Fill-in-middle transformation of texts by lines, on ropes.

A rope is a balanced tree whose leaves hold runs of a text and cache how many units (lines) end in them and how many code
points they have. A text's rope is split at two unit ranks, found by going down the
cached counts; prefix, middle and suffix are put together again with sentinels
between them as subtrees, so nothing is copied but the leaves that a cut goes through. The inverse makes a rope of the output, finds the
sentinels' ranks in code points, splits there and puts the parts back in order.

Where a text is cut, and its form, follow from a SHA-256 of the row's id: the same on every run and machine. Texts that
hold a sentinel stay plain, so the inverse is exact: a sentinel begins with `<` and ends with `>`, hence none can arise where parts meet.

Null texts count as empty; empty ones are plain with no lines. A null id is hashed as an empty one. Rows that repeat are
rows of their own; other columns are kept, those with the names of new ones are replaced. Very long texts are one rope
of many leaves; a line may span leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Code points of a leaf at most.
LEAF = 4096
#: Bytes of texts in one batch.
BATCH = 8 << 20


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Leaf(NamedTuple):
    units: int  # lines that end here; a text's last line ends with it
    chars: int
    text: str
    height: int = 0


class Node(NamedTuple):
    units: int
    chars: int
    left: Leaf | Node
    right: Leaf | Node
    height: int


Rope = Leaf | Node | None


def leaf(text: str, units: int | None = None) -> Rope:
    return Leaf(text.count("\n") if units is None else units, len(text), text) if text else None


def node(left: Rope, right: Rope) -> Node:
    return Node(left.units + right.units, left.chars + right.chars, left, right, 1 + max(left.height, right.height))


def rope(text: str) -> Rope:
    leaves = [leaf(text[at : at + LEAF]) for at in range(0, len(text), LEAF)]
    if leaves and not text.endswith("\n"):
        leaves[-1] = leaves[-1]._replace(units=leaves[-1].units + 1)
    while len(leaves) > 1:
        leaves = [node(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def concat(a: Rope, b: Rope) -> Rope:
    """a and b as one rope; heights of siblings differ by one at most where they did before."""
    if not a or not b:
        return a or b
    if a.height > b.height + 1:
        return balanced(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return balanced(concat(a, b.left), b.right)
    return node(a, b)


def balanced(a: Rope, b: Rope) -> Node:
    if a.height > b.height + 1:
        return node(a.left, node(a.right, b)) if a.left.height >= a.right.height else node(node(a.left, a.right.left), node(a.right.right, b))
    if b.height > a.height + 1:
        return node(node(a, b.left), b.right) if b.right.height >= b.left.height else node(node(a, b.left.left), node(b.left.right, b.right))
    return node(a, b)


def place(r: Rope, rank: int) -> int:
    """Code points of the first rank units."""
    if not r or rank <= 0:
        return 0
    at = 0
    while isinstance(r, Node):
        if rank <= r.left.units:
            r = r.left
        else:
            at, rank, r = at + r.left.chars, rank - r.left.units, r.right
    end = 0
    for _ in range(rank):
        end = r.text.find("\n", end) + 1 or r.chars
    return at + end


def split(r: Rope, chars: int) -> tuple[Rope, Rope]:
    """The first so many code points and the rest."""
    if not r or chars <= 0:
        return None, r
    if chars >= r.chars:
        return r, None
    if isinstance(r, Leaf):
        left = leaf(r.text[:chars])
        return left, leaf(r.text[chars:], r.units - left.units)
    if chars < r.left.chars:
        left, right = split(r.left, chars)
        return left, concat(right, r.right)
    left, right = split(r.right, chars - r.left.chars)
    return concat(r.left, left), right


def runs(r: Rope) -> Iterator[str]:
    """The leaves' texts in order."""
    stack = [r] if r else []
    while stack:
        x = stack.pop()
        if isinstance(x, Leaf):
            yield x.text
        else:
            stack += [x.right, x.left]


def text_of(r: Rope) -> str:
    return "".join(runs(r))


def rank_of(r: Rope, mark: str) -> int:
    """Code points before the first occurrence of mark, which may lie across leaves; -1 if there is none."""
    before, tail = 0, ""
    for x in runs(r):
        at = (tail + x).find(mark)
        if at >= 0:
            return before - len(tail) + at
        before += len(x)
        tail = (tail + x)[-(len(mark) - 1) :] if len(mark) > 1 else ""
    return -1


def arranged(prefix: Rope, middle: Rope, suffix: Rope, form: str, marks: Sentinels) -> Rope:
    p, s, m = (leaf(x, 0) for x in marks)
    parts = [p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle]
    out = None
    for x in parts:
        out = concat(out, x)
    return out


def restored(text: str, form: str, marks: Sentinels = Sentinels()) -> str:
    """The text of which text is the output in that form."""
    if form == "plain":
        return text
    first, second = (marks.prefix, marks.suffix) if form == "psm" else (marks.suffix, marks.prefix)
    rest, parts = rope(text), []
    for mark in (first, second, marks.middle):
        head, rest = split(rest, rank_of(rest, mark))
        parts.append(head)
        rest = split(rest, len(mark))[1]
    one, two = parts[1:]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return text_of(concat(concat(prefix, rest), suffix))


def transformed(text: str, draws: list[int], rate: int, spm_rate: int, marks: Sentinels) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    r = rope(text)
    n = r.units if r else 0
    if not text or any(x in text for x in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if draws[3] % 100 < spm_rate else "psm"
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    head, suffix = split(r, place(r, high))
    prefix, middle = split(head, place(r, low))
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, text_of(arranged(prefix, middle, suffix, form, marks))


def draws(id_col: Column, salt: str = "7:") -> Column:
    """Four 32-bit numbers from an id, the same everywhere."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return shared.let(h, lambda x: F.array(*[F.conv(F.substring(x, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: Sentinels = Sentinels(), rate: int = 100, spm_rate: int = 50, salt: str = "7:") -> DataFrame:
    """docs with n (lines), form, prefix_chars, middle_chars and fim, the transformed text. rate: percent that aren't plain."""

    def found(texts: pa.Array, ids: pa.Array) -> list[pa.Array]:
        rows = [transformed(t or "", d, rate, spm_rate, marks) for t, d in zip(texts.to_pylist(), ids.to_pylist())]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)]

    more = "n long, form string, prefix_chars long, middle_chars long, fim string"
    return shared.with_columns(docs, text_col, more, found, BATCH, also=(draws(F.col(f"`{id_col}`"), salt),))


def restore(df: DataFrame, fim_col: str = "fim", form_col: str = "form", marks: Sentinels = Sentinels()) -> DataFrame:
    """df with restored: the texts from which transform made fim, by their forms alone. Null stays null."""

    def found(texts: pa.Array, forms: pa.Array) -> list[pa.Array]:
        return [pa.array([None if t is None else restored(t, f, marks) for t, f in zip(texts.to_pylist(), forms.to_pylist())], pa.string())]

    return shared.with_columns(df, fim_col, "restored string", found, BATCH, also=(F.col(f"`{form_col}`"),))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(shared.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("fim").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS v FROM d),
k AS (SELECT *, len(l) AS n, least(v[1] % (len(l) + 1), v[2] % (len(l) + 1)) AS low, greatest(v[1] % (len(l) + 1), v[2] % (len(l) + 1)) AS high FROM u),
p AS (SELECT *, coalesce(array_to_string(l[1:low], ''), '') AS pre, coalesce(array_to_string(l[low + 1:high], ''), '') AS mid, coalesce(array_to_string(l[high + 1:n], ''), '') AS suf,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR v[3] % 100 >= 100 THEN 'plain' WHEN v[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
