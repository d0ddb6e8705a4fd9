"""Yard model as tables: blocks, slot grid, occupancy, pile statistics.

A yard is (yard_id) x blocks x bays x rows x tiers. The block dimension is
a configuration table (a handful of rows fixed by ``YardSpec``), so it is
the only thing ever broadcast; slots and containers are shuffled by pile.

After ``occupancy`` (first claimant per slot wins) every pile holds at most
``max_height`` containers, which bounds every per-pile window, set and
array used below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystack.functions.flags import occupancy_band
from quaystack.functions.location import format_location, location_parts, parts_to_location
from quaystack.functions.parse import round_half_up
from quaystack.schema import (BLOCK_CELLS, DIST_BAY, DIST_BLOCK, DIST_ROW, MAIN_ROAD,
                              SERVICE_LANE, SLOT_LENGTH, SLOT_WIDTH, TIER_HEIGHT, YardSpec)

PILE = ["yard_id", "block_id", "bay", "row"]
SLOT = PILE + ["tier"]


def explode_blocks(df: DataFrame, spec: YardSpec) -> DataFrame:
    """One row per block of the spec for every input row (a generator over
    a literal array: no join with a block table is needed)."""
    arr = F.array(*[F.struct(F.lit(b).alias("block_id"), F.lit(i).alias("block_index"))
                    for i, b in enumerate(spec.block_ids)])
    return df.withColumn("_b", F.explode(arr)).select("*", "_b.*").drop("_b")


def blocks_dim(spark: SparkSession, spec: YardSpec) -> DataFrame:
    """Block dimension with layout (x, y, width, length) and distance index."""
    rows = [(b, i) for i, b in enumerate(spec.block_ids)]
    df = spark.createDataFrame(rows, "block_id string, block_index int")
    return with_layout(df, spec)


def with_layout(df: DataFrame, spec: YardSpec) -> DataFrame:
    """Layout columns from block_id / block_index (fixed grid cells for the
    named blocks, two columns from row 1 on for any other block)."""
    bw, bl = spec.n_rows * SLOT_WIDTH, spec.n_bays * SLOT_LENGTH
    base_x = -(2 * bw + MAIN_ROAD) / 2.0 + bw / 2.0
    base_y = -(2 * bl + SERVICE_LANE) / 2.0 + bl / 2.0
    col = F.col("block_index") % 2
    row_in = (F.col("block_index") / 2).cast("int") + 1
    for b, (c, r) in BLOCK_CELLS.items():
        col = F.when(F.col("block_id") == b, F.lit(c)).otherwise(col)
        row_in = F.when(F.col("block_id") == b, F.lit(r)).otherwise(row_in)
    return (df.withColumn("grid_col", col).withColumn("grid_row", row_in)
            .withColumn("x", F.lit(base_x) + F.col("grid_col") * F.lit(bw + MAIN_ROAD))
            .withColumn("y", F.lit(base_y) + F.col("grid_row") * F.lit(bl + SERVICE_LANE))
            .withColumn("width", F.lit(bw)).withColumn("length", F.lit(bl))
            .withColumn("rotation", F.lit(0.0))
            .withColumn("n_bays", F.lit(spec.n_bays)).withColumn("n_rows", F.lit(spec.n_rows))
            .withColumn("max_height", F.lit(spec.max_height)))


def yards_of(df: DataFrame) -> DataFrame:
    return df.select("yard_id").distinct()


def block_layout(yards: DataFrame, spec: YardSpec) -> DataFrame:
    return with_layout(explode_blocks(yards, spec), spec).select(
        "yard_id", "block_id", "x", "y", "width", "length", "rotation")


def pile_grid(yards: DataFrame, blocks: DataFrame, spec: YardSpec) -> DataFrame:
    """Every pile of every yard: yards x blocks x bays x rows, generated
    with explode (the grid is a function of the yard ids and the spec)."""
    return (explode_blocks(yards, spec)
            .withColumn("bay", F.explode(F.sequence(F.lit(1), F.lit(spec.n_bays))))
            .withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(spec.n_rows)))))


def slot_grid(yards: DataFrame, blocks: DataFrame, spec: YardSpec) -> DataFrame:
    return (pile_grid(yards, blocks, spec)
            .withColumn("tier", F.explode(F.sequence(F.lit(1), F.lit(spec.max_height)))))


def in_grid(spec: YardSpec) -> F.Column:
    """The parsed location names a slot of the yard (range test, no join)."""
    return (F.col("block_id").isin(spec.block_ids) & F.col("bay").between(1, spec.n_bays)
            & F.col("row").between(1, spec.n_rows) & F.col("tier").between(1, spec.max_height))


def with_location(df: DataFrame, spec: YardSpec, slot_col: str = "slot") -> DataFrame:
    """Add block_id, bay, row, tier parsed from the slot text.

    The matched parts are produced by a one-row ``inline`` generator: the
    fields and filters on them then read a column instead of having the
    regex inlined, so the pattern runs once per row. The parts are all that
    the generator makes; within it every use of a part would match anew.
    """
    names = ["block_id", "bay", "row", "tier"]
    keep = [c for c in df.columns if c not in names]
    g = df.select(*keep, F.inline(F.array(F.struct(location_parts(slot_col).alias("_parts")))))
    loc = parts_to_location("_parts", spec.max_height)
    return g.select(*keep, *[loc[c].alias(c) for c in names])


CONTAINER_COLS = ["id", "size", "weight", "type", "departure_time"]


def occupancy(snapshot: DataFrame, spec: YardSpec, order_cols: list[str]) -> DataFrame:
    """Slot-conflict resolution: of all records claiming a known slot, the
    first in ``order_cols`` keeps it. Found with a min-struct aggregate per
    slot, so a heavily contested slot is combined map-side, never gathered."""
    located = with_location(snapshot, spec).filter(in_grid(spec))
    key = F.struct(*[F.col(c) for c in order_cols], *[F.col(c).alias(f"_c_{c}") for c in CONTAINER_COLS])
    won = located.groupBy(*SLOT).agg(F.min(key).alias("_w"))
    return won.select(*SLOT, *[F.col(f"_w._c_{c}").alias(c) for c in CONTAINER_COLS])


def pile_stats(occ: DataFrame, spec: YardSpec) -> DataFrame:
    """Per occupied pile: height, top tier, lowest free tier, min departure,
    sizes present, weight of the top container, departures by tier. A slot
    holds one container, so what a pile holds are columns by tier: fixed in
    width, they are aggregated without sorting rows or collecting arrays."""
    tiers = range(1, spec.max_height + 1)
    at = lambda t, c: F.max(F.when(F.col("tier") == t, c))
    g = occ.groupBy(*PILE).agg(
        F.count(F.lit(1)).alias("height"),
        F.max("tier").alias("top_tier"),
        F.min("departure_time").alias("min_departure"),
        F.max_by("weight", "tier").alias("top_weight"),
        *[at(t, F.lit(True)).alias(f"_t{t}") for t in tiers],
        *[at(t, F.col("size")).alias(f"_s{t}") for t in tiers],
        *[at(t, F.col("departure_time")).alias(f"_d{t}") for t in tiers],
    )
    sizes = F.array_sort(F.array_distinct(F.array_compact(F.array(*[f"_s{t}" for t in tiers]))))
    free = F.coalesce(*[F.when(F.col(f"_t{t}").isNull(), F.lit(t)) for t in tiers])
    # A tier's departure may be null, so it is there if the tier is.
    held = F.filter(F.array(*[F.struct(F.col(f"_t{t}").alias("t"), F.col(f"_d{t}").alias("d")) for t in tiers]),
                    lambda s: s["t"].isNotNull())
    return g.select(*PILE, "height", "top_tier", "min_departure", sizes.alias("sizes"), "top_weight",
                    free.alias("top_free_tier"), F.transform(held, lambda s: s["d"]).alias("departures"))


def all_piles(yards: DataFrame, blocks: DataFrame, occ: DataFrame, spec: YardSpec) -> DataFrame:
    """Every pile of the grid with its stats (empty piles: height 0)."""
    stats = pile_stats(occ, spec)
    g = pile_grid(yards, blocks, spec).join(stats, PILE, "left")
    return (g.withColumn("height", F.coalesce("height", F.lit(0)))
            .withColumn("top_tier", F.coalesce("top_tier", F.lit(0)))
            .withColumn("top_free_tier", F.when(F.col("sizes").isNull(), F.lit(1))
                        .otherwise(F.col("top_free_tier")))
            .withColumn("is_full", F.col("height") >= F.lit(spec.max_height)))


def block_index(spec: YardSpec, block_col: str = "block_id") -> F.Column:
    """Position of the block in the yard's block list (0 if unknown)."""
    idx = F.lit(0)
    for i, b in reversed(list(enumerate(spec.block_ids))):
        idx = F.when(F.col(block_col) == b, F.lit(i)).otherwise(idx)
    return idx


def distance(spec: YardSpec) -> F.Column:
    """Normalised gate distance from block index, bay and row."""
    nb = max(1, spec.n_blocks - 1)
    nbay = max(1, spec.n_bays - 1)
    nrow = max(1, spec.n_rows - 1)
    return (F.lit(DIST_BLOCK) * block_index(spec) / F.lit(float(nb))
            + F.lit(DIST_BAY) * (F.col("bay") - 1) / F.lit(float(nbay))
            + F.lit(DIST_ROW) * (F.col("row") - 1) / F.lit(float(nrow)))


def free_slots(yards: DataFrame, blocks: DataFrame, occ: DataFrame, spec: YardSpec) -> DataFrame:
    return slot_grid(yards, blocks, spec).join(occ.select(*SLOT), SLOT, "left_anti")


def block_occupancy(yards: DataFrame, blocks: DataFrame, occ: DataFrame, spec: YardSpec) -> DataFrame:
    cap = spec.n_bays * spec.n_rows * spec.max_height
    used = occ.groupBy("yard_id", "block_id").agg(F.count(F.lit(1)).alias("used"))
    b = (explode_blocks(yards, spec).drop("block_index")
         .join(used, ["yard_id", "block_id"], "left")
         .withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
         .withColumn("capacity", F.lit(cap).cast("long")))
    pct = F.col("used") * 100.0 / F.col("capacity")
    return (b.withColumn("occupancy", round_half_up(F.col("used") / F.col("capacity"), 4))
            .withColumn("occupancy_pct", round_half_up(pct, 1))
            .withColumn("band", occupancy_band(pct))
            .withColumn("detail_alert", pct > F.lit(80.0)))


def yard_kpis(yards: DataFrame, occ: DataFrame, spec: YardSpec) -> DataFrame:
    used = occ.groupBy("yard_id").agg(F.count(F.lit(1)).alias("used_slots"))
    y = (yards.join(used, "yard_id", "left")
         .withColumn("used_slots", F.coalesce("used_slots", F.lit(0)).cast("long")))
    return (y.withColumn("total_capacity", F.lit(spec.capacity).cast("long"))
            .withColumn("occupancy_rate", round_half_up(F.col("used_slots") / F.lit(float(spec.capacity)), 4))
            .withColumn("average_stack_height",
                        round_half_up(F.col("used_slots") / F.lit(float(spec.n_piles)), 4))
            .withColumn("yard_alert", F.col("used_slots") > F.lit(spec.capacity * 0.8)))


def slot_position(occ: DataFrame, blocks: DataFrame, spec: YardSpec) -> DataFrame:
    """World coordinates of each occupied slot (metres)."""
    b = F.broadcast(blocks.select("block_id", "x", "y"))
    return occ.join(b, "block_id", "inner").select(
        "id", "yard_id", "block_id", "bay", "row", "tier",
        (F.col("x") + (F.col("row") - 1 - spec.n_rows / 2 + 0.5) * SLOT_WIDTH).alias("pos_x"),
        ((F.col("tier") - 1) * TIER_HEIGHT + TIER_HEIGHT / 2).alias("pos_y"),
        (F.col("y") + (F.col("bay") - 1 - spec.n_bays / 2 + 0.5) * SLOT_LENGTH).alias("pos_z"))


def yard_state(yards: DataFrame, blocks: DataFrame, occ: DataFrame, spec: YardSpec) -> DataFrame:
    """Every slot with its container (if any): grid LEFT JOIN occupancy."""
    return (slot_grid(yards, blocks, spec).join(occ, SLOT, "left")
            .withColumn("is_free", F.col("id").isNull())
            .withColumn("location", format_location("block_id", "bay", "row", "tier")))


def yard_state_nested(state: DataFrame, piles: DataFrame) -> DataFrame:
    """Yard -> blocks -> stacks -> slots. Each level's array is bounded by
    the yard geometry (tiers per pile, piles per block, blocks per yard)."""
    slots = state.groupBy(*PILE).agg(F.array_sort(F.collect_list(F.struct(
        "tier", "is_free", F.col("id").alias("container_id"),
        F.when(F.col("id").isNotNull(), F.struct("size", "weight", "type",
               F.date_format("departure_time", "yyyy-MM-dd HH:mm").alias("departure_time"),
               "location")).alias("container_details")))).alias("slots"))
    stacks = slots.join(piles.select(*PILE, "height", "is_full"), PILE, "left").groupBy(
        "yard_id", "block_id").agg(F.array_sort(F.collect_list(F.struct(
            "bay", "row", F.coalesce("height", F.lit(0)).alias("current_height"),
            F.coalesce("is_full", F.lit(False)).alias("is_full"), "slots"))).alias("stacks"))
    return stacks.groupBy("yard_id").agg(F.array_sort(F.collect_list(
        F.struct("block_id", "stacks"))).alias("blocks"))


def below_window() -> Window:
    return Window.partitionBy(*PILE).orderBy("tier")


def pile_audits(occ: DataFrame) -> DataFrame:
    """Per occupant: the container directly below, all-below rehandles,
    earliest departure below and the ids above. Frames span one pile, so
    every collected array has fewer than max_height entries."""
    w = below_window()
    below_all = w.rowsBetween(Window.unboundedPreceding, -1)
    above_all = w.rowsBetween(1, Window.unboundedFollowing)
    prev_deps = F.collect_list("departure_time").over(below_all)
    return (occ
            .withColumn("below_tier", F.lag("tier").over(w))
            .withColumn("below_id", F.lag("id").over(w))
            .withColumn("below_departure", F.lag("departure_time").over(w))
            .withColumn("below_weight", F.lag("weight").over(w))
            .withColumn("min_departure_below", F.min("departure_time").over(below_all))
            .withColumn("rehandles", F.size(F.filter(prev_deps, lambda d: d < F.col("departure_time"))))
            .withColumn("ids_above", F.collect_list("id").over(above_all)))
