"""Preference formatting: paired chosen and rejected conversations as prompt and completions.

The longest common prefix of turns is rendered once as the prompt. What follows on each
side is rendered as a completion with the spans that carry loss (assistant turns).
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidentia.llm.common import table

OPEN, SEP, CLOSE = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SEP), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column, trained_role: str) -> Column:
    """'start:end' in code points of the completion, one for each trained turn's text with its end mark."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + len(OPEN) + F.length(t["role"]) + len(SEP)
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == trained_role, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, zero, step)["out"], ";")


def format_preferences(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per pair from turns(pair_id, rejected boolean, turn, role, text).

    Null role or text counts as empty; turns are ordered by number (nulls first), then role,
    then text, so repeated turn numbers and repeated rows have a defined order. A pair with
    one side missing has an empty prompt and that side empty. Equal sides give empty
    completions. Rows with a null pair_id or side take no part. Other columns are ignored.

    A single shuffle by pair brings the turns together (combined on the map side); a pair's
    turns form one output row, so they meet in one task by the nature of the result.
    """
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("rejected").isNotNull()).select(
        "pair_id",
        "rejected",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    both = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("rejected"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("rejected"), F.col("t")))).alias("r"),
    )
    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(
        F.slice("c", F.lit(1), n), F.slice("r", F.lit(1), n), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])
    )
    at = F.array_position(same, F.lit(False))
    cut = both.withColumn("common_turns", F.when(at > 0, at - 1).otherwise(n).cast("long"))
    rest = lambda side: F.slice(side, F.col("common_turns").cast("int") + 1, F.greatest(F.size(side), F.lit(1)))
    return cut.select(
        "pair_id",
        "common_turns",
        _render(F.slice("c", F.lit(1), F.col("common_turns").cast("int"))).alias("prompt"),
        _render(rest("c")).alias("chosen"),
        _render(rest("r")).alias("rejected"),
        _spans(rest("c"), trained_role).alias("chosen_loss"),
        _spans(rest("r"), trained_role).alias("rejected_loss"),
    )


def with_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attach pairs(pair_id, chosen_id, rejected_id) to turns(conv_id, ...); a conversation may be in many pairs."""
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("chosen_id").alias("conv_id"), F.lit(False).alias("rejected")),
        F.struct(F.col("rejected_id").alias("conv_id"), F.lit(True).alias("rejected")),
    )).alias("s")).select("pair_id", "s.*")
    return turns.select("conv_id", "turn", "role", "text").join(sides, "conv_id")


def op8_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k+1 (rejected) of the whole table as pair k."""
    turns = table(spark, sf_dir, "conversations")
    return format_preferences(turns.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.col("conv_id") % 2 != 0).alias("rejected"), "turn", "role", "text"
    ))


OP8_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 <> 0 AS rej, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
n AS (SELECT pair_id, count(*) FILTER (NOT rej) AS nc, count(*) FILTER (rej) AS nr FROM t GROUP BY pair_id),
d AS (
  SELECT c.pair_id, min(c.pos) AS first_diff
  FROM t c JOIN t r ON c.pair_id = r.pair_id AND NOT c.rej AND r.rej AND c.pos = r.pos
  WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id),
p AS (SELECT n.pair_id, coalesce(d.first_diff - 1, least(nc, nr)) AS common_turns FROM n LEFT JOIN d USING (pair_id)),
x AS (
  SELECT t.*, common_turns, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN p USING (pair_id)),
y AS (
  SELECT *, sum(CASE WHEN pos > common_turns THEN length(head || body) ELSE 0 END)
            OVER (PARTITION BY pair_id, rej ORDER BY pos) AS upto FROM x)
SELECT pair_id, common_turns::BIGINT AS common_turns,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT rej AND pos <= common_turns), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT rej AND pos > common_turns), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (rej AND pos > common_turns), '') AS rejected,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || upto::BIGINT, ';' ORDER BY pos)
    FILTER (NOT rej AND pos > common_turns AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || upto::BIGINT, ';' ORDER BY pos)
    FILTER (rej AND pos > common_turns AND role = 'assistant'), '') AS rejected_loss
FROM y GROUP BY pair_id, common_turns
"""
