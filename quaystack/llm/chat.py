"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users; context roles
(``system``) keep their role and get no perspective. The loss mask covers
what the assistant says and its end mark, nothing else.

Turns are ranked within their conversation by a range-partitioned rank and
dealt into parts of ``PART_TURNS`` turns, so a conversation of any length
is rendered by many tasks: a row is one part of one perspective. Parts
joined in order are the whole dialogue; ``start`` is a part's place in it,
summed from lengths alone, first by blocks of parts and then inside each.

Edge cases: a null text is empty, a null role is the speaker ``unknown``.
Turns that tie are ordered by role and text; repeated rows are turns of
their own. A null conversation id is a conversation like any other. A
conversation of context turns alone has no perspective. Extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystack.llm.common import column, ready
from quaystack.operators.ranking import rank_within

PART_TURNS = 64
#: Parts whose starts one window sums.
BLOCK_PARTS = 4096
CONTEXT_ROLES = ("system",)
END = "<|im_end|>\n"


def opening(role: Column, name: Column) -> Column:
    """A turn's first line; ``name`` null leaves it out."""
    return F.concat(F.lit("<|im_start|>"), role,
                    F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))


def _starts(seen: DataFrame, block_parts: int) -> DataFrame:
    """``(conv, speaker, part, start)`` from the lengths of the parts."""
    sizes = (seen.groupBy("conv", "speaker", "part")
             .agg(F.sum((F.length("head") + F.length("body")).cast("long")).alias("n"))
             .withColumn("block", F.floor(F.col("part") / block_parts)))
    before = lambda *keys: Window.partitionBy("conv", "speaker", *keys[:-1]).orderBy(
        keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n, *keys: F.coalesce(F.sum(n).over(before(*keys)), F.lit(0))
    blocks = sizes.groupBy("conv", "speaker", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select(F.col("conv").alias("of"), F.col("speaker").alias("by"),
                           F.col("block").alias("nth_block"), total("n", "block").alias("base"))
    here = (F.col("conv").eqNullSafe(F.col("of")) & (F.col("speaker") == F.col("by"))
            & (F.col("block") == F.col("nth_block")))
    return (sizes.withColumn("inner", total("n", "block", "part")).join(blocks, here)
            .select("conv", "speaker", "part", (F.col("base") + F.col("inner")).alias("start")))


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text",
           context_roles: tuple[str, ...] = CONTEXT_ROLES,
           part_turns: int = PART_TURNS, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """One row per conversation, speaker and part: rendered, start, n_turns,
    mask (spans of the part's code points, ends exclusive)."""
    ready(df.sparkSession)
    turns = df.select(column(conv_col).alias("conv"), column(turn_col).alias("turn"),
                      F.coalesce(column(role_col), F.lit("unknown")).alias("role"),
                      F.coalesce(column(text_col), F.lit("")).alias("text"))
    ranked = rank_within(turns, ["conv"], ["turn", "role", "text"], name="nth").withColumn(
        "part", F.floor((F.col("nth") - 1) / part_turns))
    spoken = ~F.col("role").isin(*context_roles)
    speakers = ranked.filter(spoken).select(F.col("conv").alias("of"), F.col("role").alias("speaker")
                                            ).distinct()
    seen = ranked.join(speakers, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("role") == F.col("speaker")
    role = F.when(own, "assistant").when(spoken, "user").otherwise(F.col("role"))
    name = F.when(spoken & ~own, F.col("role"))
    seen = (seen.withColumn("head", opening(role, name))
            .withColumn("body", F.concat("text", F.lit(END))).withColumn("own", own))
    # Starts meet their parts in the shuffle that gathers the turns.
    turn = F.when(F.col("nth").isNotNull(), F.struct("nth", "head", "body", "own"))
    parts = (seen.select("conv", "speaker", "part", "nth", "head", "body", "own")
             .unionByName(_starts(seen, block_parts), allowMissingColumns=True)
             .groupBy("conv", "speaker", "part")
             .agg(F.sort_array(F.collect_list(turn)).alias("t"), F.max("start").alias("start")))
    size = lambda t: F.length(t["head"]) + F.length(t["body"])
    ends = F.aggregate("t", F.array(F.lit(0)), lambda acc, t: F.concat(
        acc, F.array(F.element_at(acc, -1) + size(t))))
    parts = (parts.withColumn("rendered", F.array_join(F.transform(
        "t", lambda t: F.concat(t["head"], t["body"])), "")).withColumn("ends", ends))
    spans = F.filter(F.transform("t", lambda t, i: F.struct(
        (F.get("ends", i) + F.length(t["head"])).alias("start"),
        F.get("ends", i + 1).alias("end"), t["own"].alias("own"))), lambda s: s["own"])
    return parts.select(
        F.col("conv").alias(conv_col), "speaker", F.col("part").cast("long"), "start", "rendered",
        F.size("t").cast("long").alias("n_turns"),
        F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("mask"))
