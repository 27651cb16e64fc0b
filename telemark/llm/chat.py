"""Preference formatting: one prompt, two completions, and the masks that keep the prompt out of the loss.

A pair is a chosen and a rejected conversation, each an array of (role, text) turns. Their longest common turn prefix is
rendered once as the prompt; what follows it in either one is that one's completion. Only assistant turns of a completion are
learned from: each is a segment with mask 1, every other turn a segment with mask 0. A turn is rendered as
``<|role|>\\n``, its text and ``\\n``. Built-in column functions only.

Defined results: a null text reads as an empty one and a null role as ``user``; rows with a null conv_id or turn
belong to no conversation; equal rows of a conversation are one turn, other rows with one turn number stand in
the order of role and text; if one side of a pair is a prefix of the other its completion is empty; a pair of equal
conversations has two empty completions; an empty table gives an empty result; extra columns are not read. A conversation
is one training example and one row, so its turns are gathered; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one block of neighbours.
BLOCK = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, role, text)."""
    rows = conversations.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def rendered(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def masks(parts: Column) -> Column:
    return F.transform(parts, lambda t: F.when(t["role"] == "assistant", F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns have the same role and text."""
    n = F.least(F.size(a), F.size(b))
    differ = F.transform(F.sequence(F.lit(1), n), lambda i: (F.get(a, i - 1)["role"] == F.get(b, i - 1)["role"]) & (F.get(a, i - 1)["text"] == F.get(b, i - 1)["text"]))
    first = F.array_position(F.when(n > 0, differ).otherwise(F.array().cast("array<boolean>")), False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of turns) -> prompt, completions, masks, one row per pair.

    Masks have one entry per rendered turn: zeros for the prompt's, then those of the completion."""
    n = F.col("n_prompt_turns")
    cut = pairs.withColumn("n_prompt_turns", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    none = F.array_repeat(F.lit(0).cast("long"), n)
    return cut.select(
        "pair_id", n.cast("long").alias("n_prompt_turns"), rendered(F.slice("chosen", F.lit(1), n)).alias("prompt"),
        rendered(rest("chosen")).alias("chosen_completion"), rendered(rest("rejected")).alias("rejected_completion"),
        F.concat(none, masks(rest("chosen"))).alias("chosen_mask"), F.concat(none, masks(rest("rejected"))).alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs made of one table: a conversation, and the same one with its last assistant turn answered by
    the last assistant turn of the next conversation of its block of ids (the last of a block takes the first's).

    Conversations without an assistant turn make no pair; one alone in its block is paired with itself."""
    rows = turns(conversations)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)))
    rows = rows.withColumn("_last", last).where("_last > 0").withColumn("_block", F.floor(F.col("conv_id") / block))
    order = Window.partitionBy("_block").orderBy("conv_id")
    answer = F.element_at("turns", F.col("_last"))["text"]
    rows = rows.withColumn("_answer", answer)
    whole = Window.partitionBy("_block").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lead("_answer").over(order), F.first("_answer").over(whole))
    rows = rows.withColumn("_other", other)
    rejected = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("_last"), t.withField("text", F.col("_other"))).otherwise(t))
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


PREFERENCE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM t),
l AS (SELECT conv_id, max(i) AS last FROM p WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT p.conv_id, p.text AS answer, floor(p.conv_id / 4096) AS b FROM p JOIN l ON p.conv_id = l.conv_id AND p.i = l.last),
o AS (SELECT conv_id, coalesce(lead(answer) OVER (PARTITION BY b ORDER BY conv_id),
             first(answer) OVER (PARTITION BY b ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM a),
r AS (SELECT p.conv_id, p.i, p.role, p.text, CASE WHEN p.i = l.last THEN o.other ELSE p.text END AS rejected
      FROM p JOIN l USING (conv_id) JOIN o USING (conv_id)),
d AS (SELECT conv_id, coalesce(min(CASE WHEN text <> rejected THEN i END) - 1, count(*)) AS n FROM r GROUP BY conv_id),
s AS (SELECT r.*, d.n, '<|' || role || '|>' || chr(10) || text || chr(10) AS x, '<|' || role || '|>' || chr(10) || rejected || chr(10) AS y,
             CASE WHEN role = 'assistant' AND i > n THEN 1::BIGINT ELSE 0::BIGINT END AS mask FROM r JOIN d USING (conv_id))
SELECT conv_id AS pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen_completion,
       coalesce(string_agg(y, '' ORDER BY i) FILTER (WHERE i > n), '') AS rejected_completion,
       list(mask ORDER BY i) AS chosen_mask, list(mask ORDER BY i) AS rejected_mask
FROM s GROUP BY conv_id
"""
