"""Collapse of cumulative conversation snapshots, and rendering.

A chat log often holds a conversation several times, each time with more turns. Every turn gets the hash of the turns up to it
(a pair of sums of 64-bit hashes, each over position, role and text, so that a running sum extends a prefix by a turn). A
conversation whose whole hash is another's prefix hash is a snapshot of it: an anti-join removes it. Of equal ones, the least
conv_id stays. Only minima, maxima and running sums are taken by prefix, so a first turn that a third of all conversations share is no burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, prefixes_of_it): conversations that are no prefix of another; ties go to the least conv_id, null last."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(w))
    one = [F.xxhash64(F.lit(salt), "k", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)") for salt in (1, 2)]
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy("conv_id"))
    t = t.select("conv_id", "k", *[F.sum(h).over(upto).alias(f"h{i}") for i, h in enumerate(one)], n.alias("n"))
    t = keep(t, "prefixes")
    longest = t.groupBy("k", "h0", "h1").agg(F.max("n").alias("longest"))
    whole = t.where("k = n").groupBy("k", "h0", "h1").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id"))["conv_id"].alias("conv_id"), F.count("*").alias("copies"))
    longer = longest.where("longest > k")
    return whole.join(longer, ["k", "h0", "h1"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies (conversations equal to it, itself counted), rendered.

    Turns are ordered by turn, role and text, nulls first; a null role renders as `unknown`, a null text as none. Rows with a
    null conv_id are one conversation. An empty table gives no row. The text of a conversation is one value, however long it is.
    """
    best = maximal(turns)
    t = turns.select("conv_id", "turn", "role", "text").join(best, turns["conv_id"].eqNullSafe(best["conv_id"])).drop(best["conv_id"])
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    t = t.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("all"))  # nulls first, as in `maximal`
    return t.select("conv_id", "n_turns", "copies", F.array_join(F.transform("all", lambda x: x["line"]), "").alias("rendered"))


SQL = r"""
WITH t AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM conversations GROUP BY conv_id
), u AS (
  SELECT min(conv_id) AS conv_id, turns, any_value(rendered) AS rendered, count(*) AS copies FROM t GROUP BY turns
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, copies, rendered FROM u a
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE len(b.turns) > len(a.turns) AND b.turns[1] = a.turns[1] AND b.turns[1:len(a.turns)] = a.turns)
"""
