"""Snapshot reconciliation and batch placement as set-based jobs.

Reconciliation (one outcome per record, checked in this order): DUPLICATE
(the yard already holds the id) -> NO_SLOT -> BAD_LOCATION -> WRONG_ZONE ->
then, per slot, records are taken in tier order and in record order within
a tier: a record that would sit above a container leaving earlier is
WOULD_REHANDLE, the first remaining claimant of a free slot takes it
(PLACED), later ones are SLOT_TAKEN.

Whether a record is refused depends on who holds the slot below, which is
decided one tier lower. Where the record order begins with the departure,
the first departure of each slot tells; those of a pile are reduced map-side
to one row. In any other order the fold runs tier by tier: ``max_height``
steps of (claims at tier t) x (holders at tier t-1) + a min-aggregate per
slot. No claims of a pile or slot are gathered into one row or task.
"""

from __future__ import annotations

import math
from functools import partial, reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quaystack.functions.parse import size_or_default
from quaystack.operators.rules import size_of_block, zone_of
from quaystack.operators.yard import PILE, SLOT, block_index, distance, in_grid, with_location
from quaystack.schema import BACKUP_TIER_BONUS, W_DISTANCE, W_HEIGHT, W_REHANDLES, YardSpec
from quaystack.session import fine_shuffles, materialise, scratch_path

PLACED, NO_SLOT, BAD_LOCATION, WRONG_ZONE = "PLACED", "NO_SLOT", "BAD_LOCATION", "WRONG_ZONE"
WOULD_REHANDLE, SLOT_TAKEN, DUPLICATE = "WOULD_REHANDLE", "SLOT_TAKEN", "DUPLICATE"


def _pre_label(records: DataFrame, spec: YardSpec) -> DataFrame:
    r = with_location(records.withColumn("size", size_or_default("size")), spec)
    slot_txt = F.trim(F.coalesce(F.col("slot"), F.lit("")))
    pre = (F.when(slot_txt == "", F.lit(NO_SLOT))
           .when(F.col("tier").isNull(), F.lit(BAD_LOCATION))
           .when(zone_of().isNull(), F.lit(WRONG_ZONE)))
    return r.withColumn("_pre", pre)


def reconcile(records: DataFrame, spec: YardSpec, order_cols: list[str],
              existing: DataFrame | None = None, keep: list[str] | tuple = (),
              new_ids: bool = False) -> DataFrame:
    """Outcome per record: id, outcome, slot key, floating flag, and the
    columns ``keep`` as they came.

    ``records`` needs id, size, slot, departure_time, yard_id and the
    ``order_cols`` giving record order within a tier. ``existing`` is the
    occupancy of a yard that already holds containers (slot key, id,
    departure_time): its slots are taken and its ids are duplicates, which
    need not be looked for if the records have ``new_ids``.
    """
    labelled = _pre_label(records, spec)
    if existing is not None and not new_ids:
        held_ids = existing.select("id", F.lit(True).alias("_dup")).distinct()
        labelled = (labelled.join(held_ids, "id", "left")
                    .withColumn("_pre", F.when(F.col("_dup"), F.lit(DUPLICATE)).otherwise(F.col("_pre")))
                    .drop("_dup"))
    # Parse once: of each record what decides on it is stored, claims apart
    # from the others. An order that does not begin with the departure reads
    # them tier by tier. Tier 0: no claims.
    claims_slot = F.col("_pre").isNull() & F.coalesce(in_grid(spec), F.lit(False))
    by_departure = order_cols[0] == "departure_time"
    cols = list(dict.fromkeys([*SLOT, "id", "departure_time", *order_cols, *keep]))
    path = scratch_path(labelled.sparkSession, "claims")
    kept = labelled.select(*cols, "_pre", F.when(claims_slot, F.col("tier")).otherwise(0).alias("_tier"))
    out = kept.write.option("compression", "zstd")
    (out if by_departure else out.partitionBy("_tier")).parquet(path)
    # The reader's schema names the folders' column, as an empty table has none.
    stored = labelled.sparkSession.read.schema(kept.schema).parquet(path)
    seq = F.struct(*[F.col(c) for c in order_cols], F.col("id").alias("_id"))
    claims = stored.filter(F.col("_tier") > 0).withColumn("_seq", seq)
    if existing is not None:
        existing = existing.filter(F.col("tier").between(1, spec.max_height))
    more = [k for k in keep if k not in [*SLOT, "id"]]
    if by_departure:
        c = _decided_by_departure(claims, existing, spec, list(dict.fromkeys([*SLOT, "id", "departure_time", *more])))
    else:
        c = claims.join(_holders_by_tier(claims, existing, spec), SLOT, "left").withColumn(
            "_mine", F.col("_holder") == F.col("id"))
    outcome = (F.when(F.col("_mine"), F.lit(PLACED))
               .when(F.col("_below_dep").isNotNull() & (F.col("departure_time") > F.col("_below_dep")),
                     F.lit(WOULD_REHANDLE))
               .otherwise(F.lit(SLOT_TAKEN)))
    floating = F.coalesce((F.col("tier") > 1) & ~F.coalesce("_has_below", F.lit(False)) & F.col("_mine"),
                          F.lit(False))
    decided = c.select("id", *SLOT, outcome.alias("outcome"), floating.alias("floating"), *more)
    rest = (stored.filter(F.col("_tier") == 0)
            .select("id", *SLOT, F.coalesce(F.col("_pre"), F.lit(SLOT_TAKEN)).alias("outcome"),
                    F.lit(False).alias("floating"), *more))
    return decided.unionByName(rest)


def _decided_by_departure(claims: DataFrame, existing: DataFrame | None, spec: YardSpec,
                          cols: list[str]) -> DataFrame:
    """Claims with ``_mine`` (it takes its slot), the departure of the
    container below (and whether there is one). The claims are stored.

    The first claimant in an order that begins with the departure leaves
    first. If it may not stand on the container below, nobody may. So the
    departures alone tell when the one leaves that a slot takes; only where
    nothing below has a departure may one without departure come before it.
    The first departures of a pile are columns by tier: fixed in width, they
    are reduced in every task, without sorting, before they are shuffled.
    Claimants of a slot with the same first departure are then looked
    through, if there are any."""
    tiers, tier, dep = range(1, spec.max_height + 1), F.col("tier"), F.col("departure_time")
    rows = claims.select(*SLOT, "departure_time", F.lit(True).alias("_claims"))
    if existing is not None:
        rows = rows.unionByName(existing.select(*SLOT, "departure_time", F.lit(False).alias("_claims")))
    claimed = lambda t, c: F.when((tier == t) & F.col("_claims"), c)
    held = lambda t, c: F.when((tier == t) & ~F.col("_claims"), c)
    piles = rows.groupBy(*PILE).agg(*[x for t in tiers for x in (
        F.min(claimed(t, dep)).alias(f"_first{t}"), F.max(claimed(t, dep.isNull())).alias(f"_undated{t}"),
        F.max(held(t, F.lit(True))).alias(f"_held{t}"), F.max(held(t, dep)).alias(f"_leaves{t}"))])
    of = lambda name, t: F.col(f"_{name}{t}")
    none, no = F.lit(None).cast(claims.schema["departure_time"].dataType), F.lit(False)
    for t in tiers:
        # Who stands at the tier, and when he leaves, from the tier below.
        below = of("stands", t - 1) if t > 1 else none
        wins = of("held", t).isNull() & of("undated", t).isNotNull() & (
            below.isNull() | F.coalesce(of("first", t) <= below, no))
        piles = piles.withColumn(f"_wins{t}", wins)
        dated = of("wins", t) & ~(below.isNull() & of("undated", t))
        piles = piles.withColumn(f"_stands{t}", F.when(of("held", t), of("leaves", t)).when(dated, of("first", t)))
    found = [F.struct(
        F.lit(t).alias("tier"), of("undated", t).isNotNull().alias("_claimed"), of("wins", t).alias("_wins"),
        of("stands", t).alias("_leaves"), (of("stands", t - 1) if t > 1 else none).alias("_below_dep"),
        (F.coalesce(of("held", t - 1), no) | of("wins", t - 1) if t > 1 else no).alias("_has_below"))
        for t in tiers]
    slots = piles.select(*PILE, F.inline(F.array(*found))).filter("_claimed").drop("_claimed")
    first = F.col("_wins") & dep.eqNullSafe(F.col("_leaves"))
    decided = materialise(claims.join(slots, SLOT, "left").select(
        *cols, "_seq", first.alias("_mine"), "_below_dep", "_has_below"), "holders-claims", "zstd")
    mine = decided.filter("_mine")
    ties = materialise(mine.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
                       .drop("_n"), "holders-ties", "zstd")
    if ties.isEmpty():
        return decided
    one = mine.join(ties, SLOT, "left_semi").groupBy(*SLOT).agg(F.min(F.struct("_seq", "id")).alias("_w"))
    return decided.join(one, SLOT, "left").withColumn(
        "_mine", F.col("_mine") & (F.col("_w").isNull() | (F.col("_w.id") == F.col("id"))))


def _holders_by_tier(claims: DataFrame, existing: DataFrame | None, spec: YardSpec) -> DataFrame:
    """Per slot its holder, the departure of the container below and whether
    there is one, for any order: whom a slot takes depends on who holds the
    slot below, so each tier is a step of its own."""
    holders = []
    prev = None
    for t in range(1, spec.max_height + 1):
        ct = claims.filter(F.col("_tier") == t).select(*SLOT, "id", "departure_time", "_seq")
        if prev is not None:
            below = prev.select(*PILE, F.col("departure_time").alias("_below_dep"))
            ct = ct.join(below, PILE, "left")
            ok = F.col("_below_dep").isNull() | (F.col("departure_time") <= F.col("_below_dep"))
        else:
            ok = F.lit(True)
        held = existing.filter(F.col("tier") == t).select(*SLOT, "id", "departure_time") \
            if existing is not None else None
        if held is not None:
            ct = ct.join(held.select(*SLOT), SLOT, "left_anti")
        win = (ct.filter(ok).groupBy(*SLOT)
               .agg(F.min(F.struct("_seq", "id", "departure_time")).alias("_w"))
               .select(*SLOT, F.col("_w.id").alias("id"), F.col("_w.departure_time").alias("departure_time")))
        # Holders of one tier are a small table (one row per slot); pin them
        # so the next tier's plan does not re-derive every lower tier.
        if held is not None:
            win = win.unionByName(held)
        win = materialise(win, f"holders-tier{t}", "zstd")
        holders.append(win)
        prev = win
    held = reduce(lambda a, b: a.unionByName(b), holders)
    below = held.select(*PILE, (F.col("tier") + 1).alias("tier"),
                        F.col("departure_time").alias("_below_dep"), F.lit(True).alias("_has_below"))
    mine = held.select(*SLOT, F.col("id").alias("_holder"))
    return mine.join(below, SLOT, "full_outer")


#: Stages of batch placement, in order: outcome, and what a pile must satisfy.
STAGES = [
    ("PLACED_PRIMARY", "primary block, not heavier than the top, leaves no later than all below"),
    ("PLACED_BACKUP", "backup block, the same rules"),
    ("PLACED_PRIMARY_RELAXED", "primary block, not heavier than the top"),
    ("PLACED_BACKUP_RELAXED", "backup block, any pile that is not full"),
]
UNPLACED = "UNPLACED"
#: Containers of a (yard, size) settled in one round; more than its piles
#: have slots, so most yards need one round.
ROUND = 8192
ZONE = ["yard_id", "size"]
#: About as many (yard, size)s does a call of the fold take.
LOT = 16
#: Later than any departure: an empty tier never leaves first.
_NEVER = np.iinfo(np.int64).max


def open_piles(piles: DataFrame, spec: YardSpec) -> DataFrame:
    """Piles that may take a container of their block's size: without holes,
    not full, empty or holding that size."""
    empty = F.col("height") == 0
    return (piles.withColumn("size", size_of_block()).filter(F.col("size").isNotNull())
            .filter(F.col("height") < spec.max_height)
            .filter(empty | ((F.col("top_free_tier") == F.col("height") + 1)
                             & F.array_contains("sizes", F.col("size"))))
            .select(*PILE, "size", (zone_of() == "primary").alias("primary"),
                    block_index(spec).alias("block_index"), distance(spec).alias("distance"),
                    F.col("height").cast("int").alias("height"), "top_weight",
                    F.transform(F.coalesce("departures", F.array().cast("array<timestamp>")),
                                F.unix_micros).alias("departures")))


def place_batch(to_place: DataFrame, piles: DataFrame, spec: YardSpec,
                per_round: int = ROUND) -> DataFrame:
    """Place containers one after the other, latest departure first (then by
    id), each on the best slot of its first stage that some pile admits: the
    slot that ``rules.top_k_slots`` ranks first in the yard as it then is.
    Every row of ``to_place`` comes back with outcome, stage and slot
    (null: UNPLACED).

    A (yard, size) never looks at another one's piles, so each is folded by
    itself; a call of the fold takes a lot of some ``LOT`` of them, as a call
    costs more than a small one's containers do. Its piles are bounded by
    geometry; of its containers a round takes the first ``per_round``
    (limited in every task before the shuffle), so a hot yard never gathers
    in a task. Who is refused once stays refused: backup piles only fill,
    primary piles only get lighter on top. A next round therefore goes on
    behind the last container offered, with those light enough for an open
    pile; the others are UNPLACED without being offered. A yard with no more
    than ``per_round`` containers of a size is done in one round, and if all
    are, neither containers are ranked nor piles stored before it.
    """
    cols = to_place.columns
    spark = to_place.sparkSession
    # Named anew, as containers and piles may come from the same table.
    seats = open_piles(piles, spec)
    seats = seats.select(*(F.col(c).alias(c) for c in seats.columns))
    pool, done = to_place, []
    nth = Window.partitionBy(*ZONE).orderBy(F.col("departure_time").desc(), "id")
    schema = StructType([*to_place.schema.fields, *(
        StructField(n, t) for n, t in (
            ("block_id", StringType()), ("bay", IntegerType()), ("row", IntegerType()),
            ("tier", IntegerType()), ("outcome", StringType()), ("stage", IntegerType()),
            ("_n", LongType())))])
    fold = partial(settle_lot, columns=[f.name for f in schema], max_height=spec.max_height)
    while True:
        asked = pool.groupBy(*ZONE).agg(F.count(F.lit(1)).alias("_c")).agg(
            F.count(F.lit(1)).alias("zones"), F.max("_c").alias("most")).first()
        last = (asked["most"] or 0) <= per_round
        if last:
            offered = pool.withColumn("_n", F.lit(None).cast("long"))
        else:
            offered = pool.withColumn("_n", F.row_number().over(nth).cast("long")).filter(F.col("_n") <= per_round)
            seats = materialise(seats, "place-piles")
        lot = F.pmod(F.xxhash64(*ZONE), F.lit(math.ceil(asked["zones"] / LOT) or 1)).cast("int")
        offered = offered.withColumn("_departure", F.unix_micros("departure_time")).withColumn("_lot", lot)
        with fine_shuffles(spark):
            settled = materialise(offered.groupBy("_lot").cogroup(
                seats.withColumn("_lot", lot).groupBy("_lot")).applyInArrow(fold, schema), "place-round")
        done.append(settled.drop("_n"))
        if last:
            break  # no (yard, size) has containers behind these
        cursor = (settled.filter(F.col("_n") == per_round)
                  .select(*ZONE, F.struct("departure_time", "id").alias("_last")))
        seats = materialise(_stacked(seats.join(cursor.select(*ZONE), ZONE, "left_semi"), settled,
                                     spec), "place-piles")
        still = F.col("height") < spec.max_height
        limits = seats.groupBy(*ZONE).agg(
            F.max(F.when(still, F.when(F.col("primary"), F.coalesce("top_weight", F.lit(math.inf)))
                         .otherwise(F.lit(math.inf)))).alias("_limit"))
        behind = ((F.col("departure_time") < F.col("_last.departure_time"))
                  | ((F.col("departure_time") == F.col("_last.departure_time"))
                     & (F.col("id") > F.col("_last.id"))))
        rest = materialise(
            pool.join(cursor, ZONE).filter(behind).join(limits, ZONE, "left")
            .select(*cols, F.coalesce(F.col("weight") <= F.col("_limit"), F.lit(False)).alias("_fits")),
            "place-pool")
        done.append(rest.filter(~F.col("_fits")).select(
            *cols, *(F.lit(None).cast(t).alias(n) for n, t in (
                ("block_id", "string"), ("bay", "int"), ("row", "int"), ("tier", "int"))),
            F.lit(UNPLACED).alias("outcome"), F.lit(None).cast("int").alias("stage")))
        pool = rest.filter("_fits").select(*cols)
    return reduce(lambda a, b: a.unionByName(b), done)


def _stacked(seats: DataFrame, settled: DataFrame, spec: YardSpec) -> DataFrame:
    """The piles with what a round put on them."""
    new = (settled.filter(F.col("tier").isNotNull()).groupBy(*PILE).agg(
        F.count(F.lit(1)).cast("int").alias("_h"), F.max_by("weight", "tier").alias("_w"),
        F.collect_list(F.unix_micros("departure_time")).alias("_d")))
    return seats.join(new, PILE, "left").select(
        *PILE, "size", "primary", "block_index", "distance",
        (F.col("height") + F.coalesce("_h", F.lit(0))).alias("height"),
        F.coalesce("_w", "top_weight").alias("top_weight"),
        F.when(F.col("_d").isNull(), F.col("departures"))
        .otherwise(F.concat("departures", "_d")).alias("departures"))


def _rounded(total):
    return np.floor(total * 10000.0 + 0.5)


class _Piles:
    """The piles of a kind in one (yard, size), as arrays in tie order; a
    departure that is not there is ``_NEVER``, a weight infinite. Containers
    come by descending departure, so a pile that nothing leaves earlier than
    one of them stays so: ``strict`` is the score of these, infinite for the
    others, of which the last to leave first does so at ``next_first``."""

    def __init__(self, keys: list, distance: np.ndarray, height: np.ndarray, top: np.ndarray,
                 leaves: np.ndarray, per_tier: float, max_height: int):
        self.keys, self.max_height, self.leaves = keys, max_height, leaves
        # By height: as piles grow, their scores are looked up.
        statics = per_tier * np.arange(max_height + 1)[:, None] + W_DISTANCE * distance
        self.statics, self.scores = statics.tolist(), _rounded(statics).tolist()
        self.height = height.tolist()
        self.static = per_tier * height + W_DISTANCE * distance
        self.score = _rounded(self.static)
        self.first = leaves.min(axis=1, initial=_NEVER)
        self.strict = np.full(len(keys), np.inf)
        self.next_first = _NEVER
        # A full pile admits nothing, not even a stage without rules.
        self.open, self.top = height < max_height, top
        top[~self.open] = -np.inf

    def cheapest(self, admitted: np.ndarray, departure: int) -> int:
        """The first admitted pile of the least rounded score, or -1."""
        if not admitted.any():
            return -1
        at = np.flatnonzero(admitted)
        rehandles = (self.leaves[at] < departure).sum(axis=1)
        return int(at[_rounded(W_REHANDLES * rehandles + self.static[at]).argmin()])

    def in_order(self, light: np.ndarray, departure: int) -> int:
        """The same of piles where nothing leaves earlier: without rehandles
        the score is the static one, kept as piles grow."""
        if departure <= self.next_first:
            self._admit(departure)
        if not len(light):
            return -1
        found = np.where(light, self.strict, np.inf)
        i = int(found.argmin())
        return i if found[i] < np.inf else -1

    def _admit(self, departure: int) -> None:
        kept = self.first >= departure
        self.strict = np.where(kept, self.score, np.inf)
        self.next_first = self.first[~kept].max(initial=-_NEVER)

    def put(self, i: int, weight: float, departure: int) -> tuple:
        height = self.height[i]
        self.leaves[i, height] = departure
        self.height[i] = height = height + 1
        if height < self.max_height:
            self.top[i] = weight
        else:
            self.top[i], self.open[i] = -np.inf, False
        self.static[i], self.score[i] = self.statics[height][i], self.scores[height][i]
        if departure <= self.first[i]:
            self.first[i], self.strict[i] = departure, self.score[i]
        return (*self.keys[i], height)


class _Seats:
    """The piles of some (yard, size)s as arrays, in the order given."""

    def __init__(self, blocks: list, bays: list, rows: list, primary, distance, height, top,
                 known: np.ndarray, counts: np.ndarray, max_height: int):
        self.keys = list(zip(blocks, bays, rows))
        self.primary = np.asarray(primary, dtype=bool)
        self.distance, self.height = np.asarray(distance, dtype=float), np.asarray(height, dtype=np.int64)
        self.top = np.asarray(top, dtype=float)
        self.top = np.where(np.isnan(self.top), np.inf, self.top)
        self.leaves = np.full((len(self.keys), max_height), _NEVER)
        at = np.repeat(np.arange(len(counts)), counts)
        self.leaves[at, np.arange(len(known)) - np.repeat(np.cumsum(counts) - counts, counts)] = known
        self.max_height = max_height

    def kind(self, rows: slice, primary: bool) -> _Piles:
        """A copy of the primary or of the backup piles of these rows."""
        at = rows.start + np.flatnonzero(self.primary[rows] == primary)
        return _Piles([self.keys[i] for i in at], self.distance[at], self.height[at], self.top[at],
                      self.leaves[at], W_HEIGHT if primary else BACKUP_TIER_BONUS, self.max_height)


def _fold(weights: list, departures: list, seats: _Seats, rows: slice) -> list[tuple]:
    """Slot, outcome and stage of the containers of one (yard, size), in order."""
    primary, backup = seats.kind(rows, True), seats.kind(rows, False)
    out = []
    for weight, departure in zip(weights, departures):
        # Stages 1 and 3 share the weight test, 2 and 4 the piles.
        light, piles, stage = weight <= primary.top, primary, 1
        i = primary.in_order(light, departure)
        if i < 0:
            piles, stage = backup, 2
            i = backup.in_order(weight <= backup.top, departure)
        if i < 0:
            piles, stage = primary, 3
            i = primary.cheapest(light, departure)
        if i < 0:
            piles, stage = backup, 4
            i = backup.cheapest(backup.open, departure)
        if i < 0:
            out.append((None, None, None, None, UNPLACED, None))
        else:
            out.append((*piles.put(i, weight, departure), STAGES[stage - 1][0], stage))
    return out


_GIVEN = ["block_id", "bay", "row", "tier", "outcome", "stage"]


def settle(todo: pd.DataFrame, seats: pd.DataFrame, columns: list[str],
           max_height: int) -> pd.DataFrame:
    """One round of one (yard, size): every container in order ``_n``."""
    seats, todo = seats.sort_values(["block_index", "bay", "row"]), todo.sort_values("_n")
    known = [np.asarray(d, dtype=np.int64) for d in seats["departures"]]
    piles = _Seats(*(seats[c].tolist() for c in (
        "block_id", "bay", "row", "primary", "distance", "height", "top_weight")),
        np.concatenate([np.empty(0, np.int64), *known]), np.array([len(d) for d in known], np.int64), max_height)
    rows = _fold(todo["weight"].tolist(), todo["_departure"].tolist(), piles, slice(0, len(seats)))
    slots = pd.DataFrame(rows, columns=_GIVEN, index=todo.index)
    for c in ("bay", "row", "tier", "stage"):
        slots[c] = slots[c].astype("Int32")
    return pd.concat([todo.drop(columns="_departure"), slots], axis=1)[columns]


def _sorted(table: pa.Table, *keys: tuple[str, str]) -> tuple[pa.Table, dict]:
    """Ordered by (yard, size), then ``keys``, nulls first as Spark has them;
    with the rows of each (yard, size)."""
    table = table.take(pc.sort_indices(table, [*((c, "ascending") for c in ZONE), *keys], null_placement="at_start"))
    zones, start = {}, 0
    for zone, same in groupby(zip(*(table[c].to_pylist() for c in ZONE))):
        zones[zone] = slice(start, start := start + sum(1 for _ in same))
    return table, zones


def settle_lot(todo: pa.Table, seats: pa.Table, columns: list[str], max_height: int) -> pa.Table:
    """One round of some (yard, size)s: every container, of each the one of
    the latest departure first (then by id)."""
    todo, zones = _sorted(todo, ("_departure", "descending"), ("id", "ascending"))
    seats, open_to = _sorted(seats, ("block_index", "ascending"), ("bay", "ascending"), ("row", "ascending"))
    known = seats["departures"].combine_chunks()
    piles = _Seats(*(seats[c].to_pylist() for c in ("block_id", "bay", "row")),
                   *(seats[c].to_numpy() for c in ("primary", "distance", "height", "top_weight")),
                   known.flatten().to_numpy(), known.value_lengths().to_numpy(), max_height)
    weights, departures = todo["weight"].to_pylist(), todo["_departure"].to_pylist()
    rows = []
    for zone, at in zones.items():
        rows += _fold(weights[at], departures[at], piles, open_to.get(zone, slice(0, 0)))
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    for name, kind, values in zip(_GIVEN, types, zip(*rows) if rows else [[]] * len(types)):
        todo = todo.append_column(name, pa.array(values, kind))
    return todo.select(columns)


def dedup_by_priority(frames: list[tuple[str, DataFrame]], order_cols: list) -> DataFrame:
    """Union several sources by name and keep one row per id: the earliest
    source in ``frames`` wins, then ``order_cols``. First row per id is an
    aggregate + join, so a hot id is combined map-side."""
    tagged = [df.withColumn("_src_rank", F.lit(i)).withColumn("source", F.lit(name))
              for i, (name, df) in enumerate(frames)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    key = F.struct(F.col("_src_rank"), *[F.col(c) if isinstance(c, str) else c for c in order_cols])
    u = u.withColumn("_k", key)
    first = u.groupBy("id").agg(F.min("_k").alias("_f"))
    return u.join(first, "id").filter(F.col("_k") == F.col("_f")).drop("_k", "_f", "_src_rank")


def violations(placed: DataFrame) -> DataFrame:
    """Departure and weight checks of each placed container against the one
    directly below it (self equi-join on the slot key); ``floating`` has none
    below."""
    below = placed.select(*PILE, (F.col("tier") + 1).alias("tier"),
                          F.col("departure_time").alias("_bd"), F.col("weight").alias("_bw"))
    below = below.withColumn("_on", F.lit(True))
    j = placed.join(below, SLOT, "left").withColumn(
        "floating", (F.col("tier") > 1) & F.col("_on").isNull()).drop("_on")
    return (j.withColumn("edd_violation", F.coalesce(F.col("departure_time") > F.col("_bd"), F.lit(False)))
            .withColumn("weight_violation", F.coalesce(F.col("weight") > F.col("_bw"), F.lit(False)))
            .drop("_bd", "_bw"))

