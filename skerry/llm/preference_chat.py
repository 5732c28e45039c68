"""Preference formatting: the common turns once as prompt, and two masked completions.

Only DataFrame functions; one row per conversation or pair, no shuffle but the
grouping of turns into conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around a turn's role and text.
HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"
TURN = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with conv_id, turn, role and text.

    Turns are ordered by turn, then role, then text (null first); rows without
    conv_id are left out; a null role or text becomes an empty one.
    """
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    differs = F.transform(pairs, lambda p, i: F.when(p["a"].eqNullSafe(p["b"]), None).otherwise(i))
    return F.coalesce(F.array_min(differs), F.size(pairs))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(BODY))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def masks(turns: Column, trained: str = "assistant") -> Column:
    """Spans (code points of the rendered turns, end exclusive) of the trained role's texts with their end marks."""
    state = "struct<at:int,spans:array<struct<start:int,stop:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")).cast(state)

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        stop = start + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(state)

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask of a table of pairs.

    ``pairs`` has pair_id and the turn lists chosen and rejected (struct of role and
    text); other columns are not read.  The longest common turn prefix is rendered
    as the prompt; a completion renders the turns after it, and its mask holds the
    spans that are trained on.  A null list counts as empty, a null turn, role or
    text as an empty one; equal conversations give two empty completions; repeated
    rows are each returned; an empty table gives an empty result.  Very long texts
    and conversations are rendered whole: a conversation is one training record.
    """
    empty = F.array().cast(TURN)
    told = lambda t: F.struct(*(F.coalesce(t[c], F.lit("")).alias(c) for c in ("role", "text")))
    own = pairs.select("pair_id", *(F.transform(F.coalesce(F.col(c).cast(TURN), empty), told).alias(c) for c in ("chosen", "rejected")))
    own = own.withColumn("n_prefix", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c), F.lit(1)))
    return own.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        render(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        render(rest("chosen")).alias("chosen"),
        render(rest("rejected")).alias("rejected"),
        masks(rest("chosen"), trained).alias("chosen_mask"),
        masks(rest("rejected"), trained).alias("rejected_mask"),
    )


def mismatched_pairs(turns: DataFrame) -> DataFrame:
    """Every conversation against itself with its last assistant turn, and all after it, replaced by that of the next conv_id.

    Where the next conversation or its assistant turn is missing, nothing takes the
    place; a conversation without assistant turn gets the other's as a further turn.
    Rows that repeat a turn are turns of their own; an empty table gives no pairs.
    """
    talks = conversations(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    talks = talks.select("conv_id", "turns", last.alias("last"))
    replies = talks.where("last is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.slice("turns", F.col("last") + 1, F.lit(1)).alias("reply"))
    both = talks.join(replies, "conv_id", "left")
    kept = F.slice("turns", F.lit(1), F.coalesce("last", F.size("turns")))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(kept, F.coalesce("reply", F.array().cast(TURN))).alias("rejected"))


def op1_preference_chat(spark, sf_dir: str) -> DataFrame:
    """Preference records of all conversations; masks as comma-joined start:stop."""
    out = format_pairs(mismatched_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias(c)
    return out.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", text("chosen_mask"), text("rejected_mask"))


OP1_SQL = """
WITH talks AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
ends AS (SELECT *, list_max([i FOR i IN range(1, len(turns) + 1) IF turns[i].role = 'assistant']) AS last FROM talks),
pairs AS (
  SELECT e.conv_id AS pair_id, e.turns AS chosen,
    list_concat(e.turns[1:coalesce(e.last - 1, len(e.turns))], CASE WHEN n.last IS NULL THEN [] ELSE n.turns[n.last:n.last] END) AS rejected
  FROM ends e LEFT JOIN ends n ON n.conv_id = e.conv_id + 1),
cut AS (
  SELECT *, coalesce(list_min([i FOR i IN range(1, greatest(len(chosen), len(rejected)) + 1) IF chosen[i] IS DISTINCT FROM rejected[i]]) - 1, len(chosen)) AS n_prefix FROM pairs),
parts AS (
  SELECT pair_id, n_prefix, chosen[1:n_prefix] AS p, chosen[n_prefix + 1:] AS c, rejected[n_prefix + 1:] AS r FROM cut)
SELECT pair_id, n_prefix,
  coalesce(array_to_string([concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN p], ''), '') AS prompt,
  coalesce(array_to_string([concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN c], ''), '') AS chosen,
  coalesce(array_to_string([concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN r], ''), '') AS rejected,
  coalesce(array_to_string([concat(coalesce(list_sum([length(x.role) + length(x.text) + 13 FOR x IN c[1:i - 1]]), 0) + length(c[i].role) + 5, ':',
    coalesce(list_sum([length(x.role) + length(x.text) + 13 FOR x IN c[1:i]]), 0)) FOR i IN range(1, len(c) + 1) IF c[i].role = 'assistant'], ','), '') AS chosen_mask,
  coalesce(array_to_string([concat(coalesce(list_sum([length(x.role) + length(x.text) + 13 FOR x IN r[1:i - 1]]), 0) + length(r[i].role) + 5, ':',
    coalesce(list_sum([length(x.role) + length(x.text) + 13 FOR x IN r[1:i]]), 0)) FOR i IN range(1, len(r) + 1) IF r[i].role = 'assistant'], ','), '') AS rejected_mask
FROM parts
"""
