"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

For each pair the longest common prefix of turns is found by comparing turn with turn: the
first turn number at which role or text differ (or one side has none) is a minimum that is
combined before the shuffle. The common turns are rendered once as the prompt; what follows
on either side becomes a completion with the spans that count for the loss (the texts of
assistant turns).

A rendered conversation is one training record, so the turns of one conversation meet in
one row; nothing larger is brought together.

Defined results: exact repeats of a turn count once; different rows of one turn number are
ordered by role and text; a null text is empty, a null role is ``unknown``; turns without a
conversation or a turn number are not part of any conversation; a pair with one side only
keeps its row, with an empty prompt and nulls for the missing side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per (conv_id, turn) with ``said``: the sorted, distinct (role, text) of that turn."""
    said = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", said.alias("said")).distinct()
    return rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("said")).alias("said"))


def common_prefix(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id and the first turn at which the two sides differ (null if they never do)."""
    sides = pairs.select("pair_id", F.explode(F.array(F.col("chosen_id"), F.col("rejected_id"))).alias("conv_id"))
    met = sides.where("conv_id is not null").distinct().join(turns, "conv_id")
    # a turn is common if both sides have it with the same words: two conversations, one content
    each = met.groupBy("pair_id", "turn").agg(
        F.count(F.lit(1)).alias("sides"), F.min("said").alias("low"), F.max("said").alias("high")
    )
    differs = (F.col("sides") < 2) | (F.col("low") != F.col("high"))
    return each.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("splits_at"))


def _spans(turns: Column) -> Column:
    """Texts of the spans start:end (end exclusive) of the assistants' words in the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        text_at = acc["at"] + F.length(_head(t["role"]))
        text_end = text_at + F.length(t["text"])
        span = F.concat_ws(":", text_at.cast("string"), text_end.cast("string"))
        return F.struct(
            (text_end + F.length(F.lit(END))).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.concat_ws(",", F.aggregate(turns, start, step)["spans"])


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(END))))


def format_preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: the prompt and both completions with their loss spans.

    ``pairs`` has pair_id (unique), chosen_id and rejected_id. Columns: pair_id, chosen_id,
    rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.
    """
    turns = turns_of(conversations)
    splits = common_prefix(turns, pairs)
    sides = pairs.where("chosen_id is not null or rejected_id is not null").select(
        "pair_id",
        F.explode(F.array(F.struct(F.lit("c").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("r").alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s"),
    )
    said = sides.select("pair_id", "s.side", "s.conv_id").where("conv_id is not null").join(turns, "conv_id").join(splits, "pair_id")
    common = F.col("splits_at").isNull() | (F.col("turn") < F.col("splits_at"))
    part = F.when(common, F.lit("p")).otherwise(F.col("side"))
    # the prompt is the chosen side's copy of the common turns; the rejected side's copy isn't rendered again
    parts = said.withColumn("part", part).where("part <> 'p' or side = 'c'")
    turn = F.struct("turn", "said")
    rows = parts.groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("part") == k, turn))).alias(k) for k in "pcr"]
    )
    flat = {k: F.flatten(F.transform(k, lambda t: t["said"])) for k in "pcr"}
    rows = rows.select(
        "pair_id",
        F.size("p").cast("long").alias("n_prompt_turns"),
        _rendered(flat["p"]).alias("prompt"),
        *[x.alias(f"{name}{suffix}") for k, name in (("c", "chosen"), ("r", "rejected")) for x, suffix in ((_rendered(flat[k]), ""), (_spans(flat[k]), "_spans"))],
    )
    out = pairs.select("pair_id", "chosen_id", "rejected_id").join(rows, "pair_id", "left")

    def side(name, suffix=""):
        return F.when(F.col(f"{name}_id").isNotNull(), F.coalesce(f"{name}{suffix}", F.lit(""))).alias(f"{name}{suffix}")

    return out.select(
        "pair_id", "chosen_id", "rejected_id",
        F.coalesce("n_prompt_turns", F.lit(0).cast("long")).alias("n_prompt_turns"), F.coalesce("prompt", F.lit("")).alias("prompt"),
        side("chosen"), side("rejected"), side("chosen", "_spans"), side("rejected", "_spans"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs conversations 2k (chosen) and 2k + 1 (rejected); a side that isn't there is null."""
    ids = conversations.where("conv_id is not null and turn is not null").select("conv_id").distinct()
    even = F.pmod("conv_id", F.lit(2)) == 0
    return ids.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(
        F.max(F.when(even, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(~even, F.col("conv_id"))).alias("rejected_id")
    )


SQL = """
WITH turns AS (
  SELECT conv_id, turn, list_sort(list({'role': role, 'text': text})) AS said
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
  GROUP BY conv_id, turn),
pairs AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id,
         max(conv_id) FILTER (WHERE conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (WHERE conv_id % 2 <> 0) AS rejected_id
  FROM (SELECT DISTINCT conv_id FROM turns) GROUP BY 1),
sides AS (
  SELECT pair_id, 'c' AS side, chosen_id AS conv_id FROM pairs WHERE chosen_id IS NOT NULL
  UNION ALL SELECT pair_id, 'r', rejected_id FROM pairs WHERE rejected_id IS NOT NULL),
met AS (SELECT pair_id, side, turn, said FROM sides JOIN turns USING (conv_id)),
splits AS (
  SELECT pair_id, min(turn) FILTER (WHERE sides < 2 OR kinds > 1) AS splits_at
  FROM (SELECT pair_id, turn, count(*) AS sides, count(DISTINCT CAST(said AS VARCHAR)) AS kinds FROM met GROUP BY pair_id, turn)
  GROUP BY pair_id),
parts AS (
  SELECT pair_id, turn, CASE WHEN splits_at IS NULL OR turn < splits_at THEN 'p' ELSE side END AS part, side, said
  FROM met JOIN splits USING (pair_id)),
words AS (
  SELECT pair_id, part, turn, pos, said[pos].role AS role, said[pos].text AS text
  FROM (SELECT *, unnest(range(1, len(said) + 1)) AS pos FROM parts WHERE part <> 'p' OR side = 'c')),
placed AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS head,
         coalesce(sum(length(role) + length(text) + 13) OVER (
           PARTITION BY pair_id, part ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM words),
bodies AS (
  SELECT pair_id, part, count(DISTINCT turn) AS n_turns,
         string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn, pos) AS body,
         coalesce(string_agg(CAST(CAST(begun + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begun + length(head) + length(text) AS BIGINT) AS VARCHAR), ','
           ORDER BY turn, pos) FILTER (WHERE role = 'assistant'), '') AS spans
  FROM placed GROUP BY pair_id, part)
SELECT pair_id, chosen_id, rejected_id, coalesce(p.n_turns, 0) AS n_prompt_turns, coalesce(p.body, '') AS prompt,
       CASE WHEN chosen_id IS NOT NULL THEN coalesce(c.body, '') END AS chosen,
       CASE WHEN rejected_id IS NOT NULL THEN coalesce(r.body, '') END AS rejected,
       CASE WHEN chosen_id IS NOT NULL THEN coalesce(c.spans, '') END AS chosen_spans,
       CASE WHEN rejected_id IS NOT NULL THEN coalesce(r.spans, '') END AS rejected_spans
FROM pairs
LEFT JOIN (SELECT * FROM bodies WHERE part = 'p') p USING (pair_id)
LEFT JOIN (SELECT * FROM bodies WHERE part = 'c') c USING (pair_id)
LEFT JOIN (SELECT * FROM bodies WHERE part = 'r') r USING (pair_id)
"""
