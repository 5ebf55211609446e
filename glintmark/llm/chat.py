"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation again and again, each time one turn longer. Every turn gets a rolling hash of the
turns up to it: running exclusive ors of two 64-bit hashes of place, role and text, so a prefix's hash follows from the one
before, and nothing overflows however many turns there are. A conversation whose whole hash equals a proper prefix's hash of another is a snapshot; an anti-join leaves the
maximal ones. Equal conversations keep the smallest conv_id. The kept ones are rendered, one row each.

Only DataFrame operations. The joins' keys are unique on both sides, as whole conversations and prefixes are made
distinct first (with partial sums in each task), so a first turn that most logs share is one row. Turns are gathered
only per conversation, to render it.

Turns go by `turn` (null first), then role, then text; rows that repeat are turns of their own. Null differs from empty in
the comparison and is rendered as empty. Each row with a null conv_id is a conversation of one turn, so such rows are never
brought together, however many there are. Two conversations without turns can't exist; an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared



class Template(NamedTuple):
    """What stands before a role, between role and text, behind a text, and behind the last; marks inside roles and texts are replaced."""

    begin: str = "<|im_start|>"
    between: str = "\n"
    end: str = "<|im_end|>\n"
    last: str = ""
    escape: tuple[tuple[str, str], ...] = (("<|im_", "<| im_"),)


def _item(salt: str) -> Column:
    """64 bits for a turn's place, role and text."""
    return F.xxhash64(F.lit(salt), "k", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def single(rows: DataFrame) -> DataFrame:
    """ha, hb, role, text of the rows without a conversation's id."""
    return rows.where("conv_id is null").withColumn("k", F.lit(1)).select(_item("a").alias("ha"), _item("b").alias("hb"), "role", "text")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, k (turns so far), ha and hb (their hashes), more (whether turns follow)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    soon = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.where("conv_id is not null").withColumn("k", F.row_number().over(order))
    named = placed.select("conv_id", "k", F.bit_xor(_item("a")).over(soon).alias("ha"), F.bit_xor(_item("b")).over(soon).alias("hb"), F.lead(F.lit(1)).over(order).isNotNull().alias("more"))
    return named.union(single(rows).select(F.lit(None).cast(rows.schema["conv_id"].dataType), F.lit(1), "ha", "hb", F.lit(False)))


def maximal(marked: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, ha, hb of the conversations that no longer one begins with."""
    key = ["k", "ha", "hb"]
    whole = marked.where("not more").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = marked.where("more").select(*key).distinct()
    return whole.join(begun, key, "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies", "ha", "hb")


def rendered(role: Column, text: Column, template: Template = Template()) -> Column:
    def plain(c: Column) -> Column:
        out = F.coalesce(c, F.lit(""))
        for mark, other in template.escape:
            out = F.replace(out, F.lit(mark), F.lit(other))
        return out

    return F.concat(F.lit(template.begin), plain(role), F.lit(template.between), plain(text), F.lit(template.end))


def chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: one row for each maximal conversation."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kept = shared.stored(maximal(shared.stored(prefixes(rows), "chat-prefixes")), "chat-maximal")
    together = rows.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    named = together.select("conv_id", "n_turns", "n_copies", F.concat(F.array_join(F.transform("turns", lambda x: rendered(x["role"], x["text"], template)), ""), F.lit(template.last)).alias("chat"))
    # Rows of one hash are equal; they meet inside tasks before the join.
    alone = single(rows).groupBy("ha", "hb").agg(F.min(F.struct("role", "text")).alias("x")).join(kept.where("conv_id is null"), ["ha", "hb"])
    return named.union(alone.select("conv_id", "n_turns", "n_copies", F.concat(rendered(F.col("x.role"), F.col("x.text"), template), F.lit(template.last))))


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(shared.table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH r AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
t AS (SELECT conv_id, alone, role, text, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM r),
p AS (SELECT conv_id, k, list({'r': role, 't': text}) OVER (PARTITION BY conv_id, alone ORDER BY k) AS l, count(*) OVER (PARTITION BY conv_id, alone) AS n FROM t),
whole AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, max(n) AS n_turns FROM p WHERE k = n GROUP BY l),
begun AS (SELECT DISTINCT l FROM p WHERE k < n)
SELECT conv_id, n_turns, n_copies,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || replace(coalesce(x.r, ''), '<|im_', '<| im_') || chr(10)
                       || replace(coalesce(x.t, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10)), '') AS chat
FROM whole ANTI JOIN begun USING (l)
"""
