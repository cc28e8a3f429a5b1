"""Preference pairs from chosen and rejected conversations.

The longest common prefix of the two conversations' turns is rendered once, as the prompt; what
follows on either side is its completion.  Each completion's loss mask is a list of spans of its
text: what assistants wrote, with the marker that ends their turn.

The first turn at which a pair differs is found by one equi-join of turns on pair and place and
one minimum, so no conversation is gathered before it is cut; rendering gathers a conversation,
which is one example.

Edge cases: turns are ordered by ``turn``, then role and text, so rows that repeat a turn stay in
a fixed order; a null role or text is empty; a conversation without turns has an empty completion;
equal conversations have all turns as prompt and two empty completions; a null conversation id
belongs to no pair; a null side of a pair is a conversation without turns; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def render(role: Column, text: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(END))


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, n (from 0), role, text."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).where("conv is not null")
    return rows.select("conv", (F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")) - 1).alias("n"), "role", "text")


def format_preferences(pairs: DataFrame, turns: DataFrame, **columns: str) -> DataFrame:
    """pairs: pair_id, chosen, rejected (conversation ids).

    Returns pair_id, shared_turns, prompt, chosen, rejected, and per completion its loss spans as
    ``start:end`` in code points, comma-joined (chosen_loss, rejected_loss).
    """
    numbered = number_turns(turns, **columns)
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("conv")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("conv")))).alias("s")).select("pair_id", "s.side", "s.conv")
    rows = sides.join(numbered, "conv", "left").select("pair_id", "side", "n", "role", "text")

    # A place is shared if both sides have the same role and text there; the prompt ends at the first that is not.
    places = rows.where("n is not null").groupBy("pair_id", "n").agg(F.count("*").alias("sides"), F.min(F.xxhash64("role", "text")).alias("low"), F.max(F.xxhash64("role", "text")).alias("high"), F.min("text").alias("least"), F.max("text").alias("most"))
    same = (F.col("sides") == 2) & (F.col("low") == F.col("high")) & (F.col("least") == F.col("most"))
    cut = places.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~same, F.col("n"))), F.max("n") + 1).alias("shared"))

    rows = rows.join(cut, "pair_id", "left").withColumn("piece", F.when(F.col("n").isNotNull(), render(F.col("role"), F.col("text"))))
    rows = rows.withColumn("part", F.when(F.col("n") < F.col("shared"), "prompt").otherwise(F.col("side")))
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("pair_id", "side", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opening = F.length(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    span = F.when(F.col("role") == "assistant", F.concat((F.col("before") + opening).cast("string"), F.lit(":"), (F.col("before") + F.length("piece")).cast("string")))

    def joined(part: str, side: str, value: Column) -> Column:
        kept = F.when((F.col("part") == part) & (F.col("side") == side), F.struct("n", value.alias("x")))
        items = F.filter(F.sort_array(F.collect_list(kept)), lambda s: s["x"].isNotNull())
        return F.transform(items, lambda s: s["x"])

    return rows.groupBy("pair_id").agg(
        F.coalesce(F.max("shared"), F.lit(0)).cast("long").alias("shared_turns"),
        F.array_join(joined("prompt", "chosen", F.col("piece")), "").alias("prompt"),
        F.array_join(joined("chosen", "chosen", F.col("piece")), "").alias("chosen"),
        F.array_join(joined("rejected", "rejected", F.col("piece")), "").alias("rejected"),
        F.array_join(joined("chosen", "chosen", span), ",").alias("chosen_loss"),
        F.array_join(joined("rejected", "rejected", span), ",").alias("rejected_loss"),
    )
