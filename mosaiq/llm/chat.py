"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is
rendered once as prompt, the turns after it as two completions whose loss mask covers the
assistant's words only. DataFrame functions alone, so all of it runs in the JVM.

A turn is a struct of role and text. Null roles count as `user`, null texts as empty, null
conversations as empty. Equal conversations have the whole of them as prompt and empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns (role, text), by turn, then role, then text, nulls first; repeated rows stay.
    A null conv_id is a conversation of its own."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def with_earlier_reply(convs: DataFrame) -> DataFrame:
    """Pairs from single conversations: chosen is the conversation, rejected the same with its last
    assistant turn replaced by the assistant turn before it, or by an empty one if there is none."""
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    stale = F.when(F.size("replies") > 1, F.expr("replies[size(replies) - 2].text")).otherwise(F.lit(""))
    swapped = F.transform("turns", lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), F.col("stale").alias("text"))).otherwise(t))
    return convs.withColumns({"replies": replies, "last": last}).withColumn("stale", stale).select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END))


def _segments(turns: Column) -> Column:
    """Text and whether it counts for the loss: what the assistant wrote with its end mark, not the
    headers and not other turns."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.when(
                t["role"] == "assistant",
                F.array(F.struct(F.concat(F.lit(BEGIN), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("train")), F.struct(F.concat(t["text"], F.lit(END)).alias("text"), F.lit(True).alias("train"))),
            ).otherwise(F.array(F.struct(_render(t).alias("text"), F.lit(False).alias("train")))),
        )
    )


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with chosen and rejected (arrays of turns) replaced by n_prefix (turns in common), prompt,
    and for both sides completion (text) and segments (text, train), of which it is put together."""
    kind = "array<struct<role:string,text:string>>"
    keep = [c for c in pairs.columns if c not in (chosen, rejected, "n_prefix", "prompt", "chosen_completion", "chosen_segments", "rejected_completion", "rejected_segments")]
    whole = lambda c: F.transform(F.coalesce(F.col(c).cast(kind), F.array().cast(kind)), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    sides = pairs.select(*keep, whole(chosen).alias("__c"), whole(rejected).alias("__r"))
    most = F.least(F.size("__c"), F.size("__r"))
    same = F.zip_with("__c", "__r", lambda a, b: a == b)
    differs = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    sides = sides.withColumn("n_prefix", F.when(differs == 0, most).otherwise(F.least(most, differs - 1)).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    return sides.select(
        *keep,
        "n_prefix",
        F.array_join(F.transform(F.slice("__c", F.lit(1), F.col("n_prefix")), _render), "").alias("prompt"),
        F.array_join(F.transform(rest("__c"), _render), "").alias("chosen_completion"),
        _segments(rest("__c")).alias("chosen_segments"),
        F.array_join(F.transform(rest("__r"), _render), "").alias("rejected_completion"),
        _segments(rest("__r")).alias("rejected_segments"),
    )


def mask(segments: str) -> Column:
    """Run lengths of a completion's mask in code points: T trained, M masked."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.when(s["train"], "T").otherwise("M"), F.length(s["text"]).cast("string"))), " ")


#: Turns are numbered on both sides and compared row by row; the first difference ends the prefix.
PREFERENCE_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS n,
         coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations),
a AS (
  SELECT conv_id, n, text, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM t WHERE role = 'assistant'),
r AS (
  SELECT t.conv_id, t.n, t.role, t.text AS chosen, CASE WHEN l.n IS NULL THEN t.text ELSE coalesce(p.text, '') END AS rejected
  FROM t LEFT JOIN a l ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.back = 1 AND l.n = t.n
         LEFT JOIN a p ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.back = 2),
c AS (
  SELECT conv_id, coalesce(min(n) FILTER (WHERE chosen <> rejected), max(n) + 1) - 1 AS k FROM r GROUP BY conv_id),
s AS (
  SELECT r.*, c.k, '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id)
SELECT conv_id, CAST(any_value(k) AS INTEGER) AS n_prefix,
  coalesce(string_agg(head || chosen || tail, '' ORDER BY n) FILTER (WHERE n <= k), '') AS prompt,
  coalesce(string_agg(head || chosen || tail, '' ORDER BY n) FILTER (WHERE n > k), '') AS chosen_completion,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'M' || length(head) || ' T' || length(chosen || tail) ELSE 'M' || length(head || chosen || tail) END, ' ' ORDER BY n) FILTER (WHERE n > k), '') AS chosen_mask,
  coalesce(string_agg(head || rejected || tail, '' ORDER BY n) FILTER (WHERE n > k), '') AS rejected_completion,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'M' || length(head) || ' T' || length(rejected || tail) ELSE 'M' || length(head || rejected || tail) END, ' ' ORDER BY n) FILTER (WHERE n > k), '') AS rejected_mask
FROM s GROUP BY conv_id
"""
