"""Operator 2: preference pairs as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Only this role's words are trained on.
TRAINED_ROLE = "assistant"
#: Ids of one block, at most, in one window.
ID_BLOCK = 64


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in turn order.

    Turns with a null conv_id belong to no conversation and are left out. Turns
    that repeat a number are ordered by role, then text; a null number comes
    first; a null role or text counts as empty. A conversation is one row, as
    each result row holds whole conversations.
    """
    t = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # array_sort puts null fields last, so numbers that are missing are moved to the front
    ordered = F.concat(F.filter("xs", lambda x: x["turn"].isNull()), F.filter("xs", lambda x: x["turn"].isNotNull()))
    return rows.select("conv_id", F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pair_with_other_reply(conversations: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """chosen and rejected conversations (structs of conv_id, turns), a pair for each conversation with a reply.

    Chosen is the conversation; rejected is the same but for its last reply,
    which is that of the next conversation by id inside the same block of
    ID_BLOCK ids, the first one following the last. A conversation without a
    turn of `role` has nothing to prefer and gives no pair; one that is alone in
    its block, or whose neighbour replies the same, is paired with itself.
    """
    last = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == role, i + 1)), lambda i: i.isNotNull()))
    c = conversations.withColumn("last", last).where("last is not null").withColumn("reply", F.element_at("turns", F.col("last"))["text"])
    ring = Window.partitionBy(F.floor(F.col("conv_id") / ID_BLOCK)).orderBy("conv_id")
    c = c.withColumn("other", F.coalesce(F.lead("reply").over(ring), F.first("reply").over(ring)))
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.col("other")).otherwise(t["text"]).alias("text")))
    return c.select(F.struct("conv_id", "turns").alias("chosen"), F.struct("conv_id", swapped.alias("turns")).alias("rejected"))


def _rendered(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _mask(turns):
    """(start, length) in characters, within the rendered completion, of the trained turns' texts."""
    start = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["role"]) + F.length(t["text"]) + 6).alias("at"),
            F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["role"]) + 5).alias("start"), F.length(t["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return start["spans"]


def preference_rows(pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The prompt is the longest run of leading turns, equal in role and text,
    that both conversations have, and is rendered once. The completions are
    the turns after it; a mask lists the character spans of the assistant's
    texts in its completion. Equal conversations share all turns and have empty
    completions; a pair without a common turn has an empty prompt.
    """
    a, b = F.col("chosen.turns"), F.col("rejected.turns")
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)) & (i <= shorter))
    first_other = F.array_position(same, False)
    n = F.when(first_other == 0, shorter).otherwise(first_other - 1).cast("int")
    p = pairs.withColumn("prompt_turns", n)
    rest = lambda turns: F.slice(turns, F.col("prompt_turns") + 1, F.greatest(F.size(turns) - F.col("prompt_turns"), F.lit(0)))
    return p.select(
        F.col("chosen.conv_id").alias("chosen_id"), F.col("rejected.conv_id").alias("rejected_id"), "prompt_turns",
        _rendered(F.slice(a, F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        _rendered(rest(a)).alias("chosen"), _rendered(rest(b)).alias("rejected"), _mask(rest(a)).alias("chosen_mask"), _mask(rest(b)).alias("rejected_mask"),
    )
