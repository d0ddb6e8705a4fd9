"""Placement rules and scoring: zone policy, audits below a container,
valid open piles and slot scores.

Candidate search never materialises container x pile rows. Piles of one
(yard, size zone) are gathered into one array whose length is bounded by the
yard geometry, without the empty piles that cannot win; each container (or
distinct probe: yard, size, departure, weight) meets its zone's array once and
filters and sorts it with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystack.functions.location import format_location
from quaystack.functions.parse import round_half_up
from quaystack.operators.yard import PILE, SLOT, block_index, distance
from quaystack.schema import (BACKUP_BLOCKS, BACKUP_TIER_BONUS, SIZE_POLICY, TOP_K, W_DISTANCE,
                              W_HEIGHT, W_REHANDLES, YardSpec)
from quaystack.session import materialise, small_tasks


def zone_of(size_col: str = "size", block_col: str = "block_id") -> Column:
    """'primary' / 'backup' when the block accepts the size, else null."""
    z = F.lit(None).cast("string")
    for size, pol in SIZE_POLICY.items():
        s = F.col(size_col) == size
        z = (F.when(s & F.col(block_col).isin(pol["primary"]), F.lit("primary"))
             .when(s & F.col(block_col).isin(pol["backup"]), F.lit("backup")).otherwise(z))
    return z


def size_of_block(block_col: str = "block_id") -> Column:
    """The container size a block is reserved for (null for other blocks)."""
    out = F.lit(None).cast("int")
    for size, pol in SIZE_POLICY.items():
        out = F.when(F.col(block_col).isin(pol["primary"] + pol["backup"]), F.lit(size)).otherwise(out)
    return out


def height_term(tier: Column, block: Column) -> Column:
    """Backup blocks reward stacking high, primary blocks penalise it."""
    return F.when(block.isin(BACKUP_BLOCKS), F.lit(BACKUP_TIER_BONUS) * (tier - 1)) \
            .otherwise(F.lit(W_HEIGHT) * (tier - 1))


def below_audit(occ: DataFrame) -> DataFrame:
    """Each occupant against the occupant directly below (tier - 1): a self
    equi-join on the slot key (one container per slot, so 1:1)."""
    below = occ.select(*PILE, (F.col("tier") + 1).alias("tier"), F.col("id").alias("below_id"),
                       F.col("departure_time").alias("below_departure"))
    return (occ.join(below, SLOT, "left")
            .withColumn("would_rehandle", F.coalesce(F.col("departure_time") > F.col("below_departure"),
                                                     F.lit(False))))


def slot_scores(audits: DataFrame, spec: YardSpec) -> DataFrame:
    """Score of each occupant's own slot: 3 x rehandles below + height term
    + distance; total rounded to 4 decimals."""
    rh = F.lit(W_REHANDLES) * F.col("rehandles")
    ht = height_term(F.col("tier"), F.col("block_id"))
    ds = F.lit(W_DISTANCE) * distance(spec)
    return (audits.withColumn("rehandle_score", rh).withColumn("height_score", ht)
            .withColumn("distance_score", ds).withColumn("weight_penalty", F.lit(0.0))
            .withColumn("total_score", round_half_up(rh + ht + ds, 4)))


def zone_piles(piles: DataFrame, spec: YardSpec, k: int) -> DataFrame:
    """One row per (yard, size zone): the piles of its primary and of its
    backup blocks that can be among any container's ``k`` best, as arrays
    ascending by static score (then block, bay, row). The rows are stored:
    occupants and piles are shuffled and sorted in small tasks until then.

    An empty pile admits every container of the size, at its static score,
    so of the empty piles of a kind only the ``k`` cheapest can be in a top
    ``k``; all are counted in ``empty_primary`` / ``empty_backup``. Piles that
    hold only the other size admit nobody. An array is at most the occupied
    open piles of the zone plus ``k``: a geometry bound.
    """
    empty = F.col("height") == 0
    p = (piles.withColumn("size", size_of_block()).filter(F.col("size").isNotNull())
         .filter(~F.col("is_full") & (F.col("top_free_tier") == F.col("height") + 1))
         .filter(empty | (F.size(F.coalesce("sizes", F.array().cast("array<int>"))) == 0)
                 | F.array_contains("sizes", F.col("size"))))
    static = height_term(F.col("top_free_tier"), F.col("block_id")) + F.lit(W_DISTANCE) * distance(spec)
    entry = F.struct(
        _round4(static).alias("score4"), block_index(spec).alias("bidx"), "bay", "row",
        static.alias("static_score"), "block_id", F.col("top_free_tier").alias("next_tier"), "height",
        "min_departure", "top_weight",
        F.coalesce(F.col("departures"), F.array().cast("array<timestamp>")).alias("departures"))
    kinds = {f"{state}_{kind}": (empty if state == "empty" else ~empty) & (zone_of() == kind)
             for state in ("empty", "held") for kind in ("primary", "backup")}
    z = p.groupBy("yard_id", "size").agg(*[
        F.array_sort(F.collect_list(F.when(cond, entry))).alias(name) for name, cond in kinds.items()])
    both = lambda kind: F.col(f"held_{kind}") if k == 0 else F.array_sort(
        F.concat(f"held_{kind}", F.slice(f"empty_{kind}", 1, k)))
    z = z.select("yard_id", "size", F.size("empty_primary").alias("empty_primary"),
                 F.size("empty_backup").alias("empty_backup"),
                 both("primary").alias("primary"), both("backup").alias("backup"))
    with small_tasks(piles.sparkSession):
        # A stored zone is a small part of its size in memory, by which alone
        # it might be broadcast.
        return materialise(z, "zones", "zstd").hint("merge")


PROBE = ["yard_id", "size", "departure_time", "weight"]


def _round4(c: Column) -> Column:
    return F.floor(c * 10000.0 + 0.5) / 10000.0


def _light(p) -> Column:
    """The probe is not heavier than the pile's top."""
    return (p["next_tier"] == 1) | p["top_weight"].isNull() | (F.col("weight") <= p["top_weight"])


def _strict(p) -> Column:
    """Both rules: the weight, and leaving no later than all below."""
    return _light(p) & ((p["height"] == 0) | (F.col("departure_time") <= p["min_departure"]))


def _slot(p, score: Column, rehandles: Column) -> Column:
    return F.struct(score.alias("score"), p["bidx"].alias("bidx"), p["bay"].alias("bay"),
                    p["row"].alias("row"), p["block_id"].alias("block_id"),
                    p["next_tier"].alias("tier"), rehandles.alias("rehandles"))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_order(admitted: Column, k: int) -> Column:
    """The k cheapest where nothing below leaves earlier: the first k."""
    return F.transform(F.slice(admitted, 1, k), lambda p: _slot(p, p["score4"], F.lit(0)))


def _cheapest(admitted: Column, k: int) -> Column:
    """The k cheapest of piles ascending by static score. Rehandles only add
    to it, so the search ends once the k-th total is below the static score
    of the next pile; it looks at 4 k piles, then 16 k, then all."""

    def total(p) -> Column:
        rehandles = F.size(F.filter(p["departures"], lambda d: d < F.col("departure_time")))
        return _slot(p, _round4(F.lit(W_REHANDLES) * rehandles + p["static_score"]), rehandles)

    def search(piles: Column, sizes: list[int]) -> Column:
        if not sizes:
            return F.slice(F.array_sort(F.transform(piles, total)), 1, k)
        n, *more = sizes
        return _bind(F.array_sort(F.transform(F.slice(piles, 1, n), total)), lambda best: F.when(
            (F.size(piles) <= n) | (F.get(best, F.lit(k - 1))["score"] < F.get(piles, F.lit(n))["score4"]),
            F.slice(best, 1, k)).otherwise(search(piles, more)))

    return _bind(admitted, lambda piles: search(piles, [4 * k, 16 * k]))


def top_k_slots(containers: DataFrame, piles: DataFrame, spec: YardSpec,
                k: int = TOP_K) -> DataFrame:
    """For each container: its first non-empty stage (strict primary, strict
    backup, relaxed-departure primary, relaxed backup) and the k cheapest
    open piles of that stage, ranked by (score, block, bay, row).

    Each container meets its zone once and is solved in-row, in the task that
    returns its slots: ``k`` slots a row are several times the row, so they
    are never shuffled or sorted. A stage is looked at only if those before
    it are empty. Containers without a departure or weight have no slots."""
    zones = zone_piles(piles, spec, k)
    containers = containers.dropna(subset=PROBE)
    stages = [_in_order(F.filter("primary", _strict), k), _in_order(F.filter("backup", _strict), k),
              _cheapest(F.filter("primary", _light), k), _cheapest(F.col("backup"), k)]

    def first_of(number: int, found: list[Column]) -> Column:
        named = lambda s: F.struct(F.lit(number).alias("stage"), s.alias("slots"))
        if len(found) == 1:
            return named(found[0])
        return _bind(found[0], lambda s: F.when(F.size(s) > 0, named(s)).otherwise(
            first_of(number + 1, found[1:])))

    found = containers.select("id", *PROBE).join(zones, ["yard_id", "size"]).select(
        "yard_id", "size", "id", first_of(1, stages).alias("best"))
    return found.select("yard_id", "size", "id", F.col("best.stage").alias("stage"),
                        F.posexplode("best.slots").alias("pos", "c")).select(
        "yard_id", "size", "id", "stage", (F.col("pos") + 1).alias("rank"),
        *[F.col(f"c.{f}").alias(f) for f in ("block_id", "bay", "row", "tier", "score", "rehandles")])


def stage_counts(containers: DataFrame, piles: DataFrame, spec: YardSpec) -> DataFrame:
    """Per container, how many open piles each stage admits, once per distinct
    probe: of the occupied ones those that keep both rules, the weight rule,
    or none; an empty pile is stage 1 in a primary block and stage 2 in a
    backup block."""
    zones = zone_piles(piles, spec, 0)
    probes = containers.select(*PROBE).distinct().join(zones, ["yard_id", "size"])
    count = lambda kind, rule: F.size(F.filter(kind, rule))
    counted = probes.select(
        *PROBE, "empty_primary", "empty_backup", count("primary", _strict).alias("s1"),
        count("primary", _light).alias("light"), count("backup", _strict).alias("s2"),
        F.size("backup").alias("all")).select(
        *PROBE, (F.col("empty_primary") + F.col("s1")).alias("n_stage1"),
        (F.col("empty_backup") + F.col("s2")).alias("n_stage2"),
        (F.col("light") - F.col("s1")).alias("n_stage3"),
        (F.col("all") - F.col("s2")).alias("n_stage4"))
    return (containers.select("id", *PROBE).join(counted, PROBE, "left")
            .select("id", *[F.coalesce(f"n_stage{s}", F.lit(0)).alias(f"n_stage{s}") for s in range(1, 5)]))


def available(piles: DataFrame) -> DataFrame:
    """Lowest free slot of every non-full pile, with the pile height."""
    return (piles.filter(~F.col("is_full"))
            .select(*PILE, F.col("top_free_tier").alias("tier"), F.col("height").alias("stack_current_height"))
            .withColumn("localization", format_location("block_id", "bay", "row", "tier")))


def available_for_probe(piles: DataFrame, spec: YardSpec, probe_weight: float,
                        probe_departure: str) -> DataFrame:
    """Open piles a probe container of each size may take (all rules strict,
    primary and backup zones): the probe is a literal, piles are data."""
    dep = F.lit(probe_departure).cast("timestamp")
    p = piles.withColumn("size", F.explode(F.array(*[F.lit(s) for s in SIZE_POLICY])))
    p = p.filter(zone_of().isNotNull())
    empty = F.col("height") == 0
    ok = ((~F.col("is_full")) & (F.col("top_free_tier") == F.col("height") + 1)
          & (empty | F.array_contains(F.coalesce("sizes", F.array().cast("array<int>")), F.col("size")))
          & (empty | (dep <= F.col("min_departure")))
          & ((F.col("top_free_tier") == 1) | F.col("top_weight").isNull()
             | (F.lit(probe_weight) <= F.col("top_weight"))))
    return (p.filter(ok).select("size", *PILE, F.col("top_free_tier").alias("tier"),
                                F.col("height").alias("stack_current_height"))
            .withColumn("localization", format_location("block_id", "bay", "row", "tier")))

