"""Preference pairs as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(turns: Column) -> Column:
    line = lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(turns, line), "")


def _mask(turns: Column, role: str) -> Column:
    """Character spans of the ``role`` turns' texts with their end signs, in the rendered turns."""
    head = lambda t: F.length(t["role"]) + 13  # noqa: E731  "<|im_start|>" and the line break
    body = lambda t: F.length(t["text"]) + 10  # noqa: E731  "<|im_end|>"
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        a = state["at"] + head(t)
        span = F.array(F.struct(a.alias("start"), (a + body(t)).alias("end")))
        return F.struct((a + body(t) + 1).alias("at"), F.when(t["role"] == role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """``(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask)``, one row per pair.

    ``turns`` has ``pair_id, side`` (``chosen`` or ``rejected``), ``turn, role, text``. The longest common prefix
    of turns (role and text) is rendered once as the prompt; what follows on either side is its completion, with
    the character spans of the ``role`` turns to train on.

    Null roles and texts count as empty. Turns are ordered by number (null first), then role and text; repeated
    rows are repeated turns. A pair with one side only has an empty completion on the other and no common turn.
    Signs of the template inside a text are broken by a space. Rows with another or null side are left out; a null
    pair id is a pair of its own. Other columns are not read.
    """
    clean = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.where(F.col("side").isin("chosen", "rejected")).select("pair_id", "side", F.struct(F.col("turn").alias("turn"), clean("role").alias("role"), clean("text").alias("text")).alias("t"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t"))))
    both = rows.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), shared), F.slice("r", F.lit(1), shared), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    parted = F.array_position(same, False)
    both = both.withColumn("n_common", F.when(parted > 0, parted - 1).otherwise(shared).cast("long"))
    common = F.col("n_common").cast("int")
    rest = lambda s: F.slice(s, common + 1, F.size(s))
    both = both.select("pair_id", "n_common", F.slice("c", F.lit(1), common).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select(
        "pair_id", "n_common", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c"), role).alias("chosen_mask"), _mask(F.col("r"), role).alias("rejected_mask"),
    )


def paired_conversations(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: ``(pair_id, side, turn, role, text)``.

    Conversations 2k and 2k + 1 make pair k. The first is the chosen one. The rejected one is the first's turns
    below half of its turn numbers, then all turns of the second, whose numbers go on from there; so every turn of
    the table is on a side. Turns without a number are the first of their conversation. A second conversation
    without a first is rejected from its first turn. Turns without a conversation are all chosen, in a pair
    without an id.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    odd = F.coalesce(F.pmod(F.col("conv_id"), F.lit(2)) == 1, F.lit(False))
    sizes = rows.where("pair_id is not null").groupBy("pair_id").agg(F.coalesce(F.floor((F.max(F.when(~odd, F.col("turn"))) + 1) / 2), F.lit(0)).alias("half"), F.min(F.when(odd, F.col("turn"))).alias("least"))
    rows = rows.join(sizes, "pair_id", "left").withColumn("early", F.col("turn").isNull() | (F.col("turn") < F.col("half")))
    both = F.array(F.lit("chosen"), F.lit("rejected"))
    sides = F.when(odd, F.array(F.lit("rejected"))).when(F.col("pair_id").isNotNull() & F.col("early"), both).otherwise(F.array(F.lit("chosen")))
    turn = F.when(odd, F.col("half") + F.coalesce(F.col("turn") - F.col("least") + 1, F.lit(0))).otherwise(F.col("turn"))
    return rows.select("pair_id", F.explode(sides).alias("side"), turn.cast("long").alias("turn"), "role", "text")
