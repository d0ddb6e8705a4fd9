"""DuckDB oracle SQL for every registered query that SQL can express.

A common prelude of CTEs (raw derivation, typed, labelled, silver, piled)
is prefixed to each query; DuckDB drops the CTEs a query does not use.
"""

from __future__ import annotations

from quaystack.schema import FIXTURE_YARD
from quaystack.sources.fixtures import raw_select_sql

MAXH = FIXTURE_YARD.max_height
NBAYS = FIXTURE_YARD.n_bays
NROWS = FIXTURE_YARD.n_rows
BLOCK_LIST = ", ".join(f"'{b}'" for b in FIXTURE_YARD.block_ids)
BLOCK_VALUES = ", ".join(f"('{b}', {i})" for i, b in enumerate(FIXTURE_YARD.block_ids))
CAPACITY = FIXTURE_YARD.capacity
NPILES = FIXTURE_YARD.n_piles
NB1 = float(max(1, FIXTURE_YARD.n_blocks - 1))
NBAY1 = float(max(1, NBAYS - 1))
NROW1 = float(max(1, NROWS - 1))


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def dist(bays: float, rows: float) -> str:
    """Gate distance; ``bays`` and ``rows`` are the largest steps of each."""
    return (f"({D(0.5)} * block_index / {D(NB1)} + {D(0.3)} * (bay - 1) / {D(bays)} "
            f"+ {D(0.2)} * (row - 1) / {D(rows)})")


DIST = dist(NBAY1, NROW1)
BIDX = "CASE block_id " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(FIXTURE_YARD.block_ids)) + " ELSE 0 END"
from quaystack.schema import SIZE_POLICY  # noqa: E402
ZONE = "CASE " + " ".join(
    f"WHEN size = {sz} AND block_id IN ({', '.join(repr(b) for b in pol['primary'])}) THEN 'primary' "
    f"WHEN size = {sz} AND block_id IN ({', '.join(repr(b) for b in pol['backup'])}) THEN 'backup'"
    for sz, pol in SIZE_POLICY.items()) + " END"
BLOCK_SIZE = "CASE " + " ".join(
    f"WHEN block_id IN ({', '.join(repr(b) for b in pol['primary'] + pol['backup'])}) THEN {sz}"
    for sz, pol in SIZE_POLICY.items()) + " END"
PRIMARY_LIST = ", ".join(repr(b) for pol in SIZE_POLICY.values() for b in pol["primary"])
BLOCK_PRIMARY = "p.block_id IN (" + ", ".join(
    repr(b) for pol in SIZE_POLICY.values() for b in pol["primary"]) + ")"
HTERM = f"CASE WHEN block_id IN ('S1', 'S2') THEN {D(-5.0)} * (tier - 1) ELSE {D(2.0)} * (tier - 1) END"
TS = "'%Y-%m-%d %H:%M:%S'"
ISO = "'%Y-%m-%dT%H:%M:%S'"


def rhu(expr: str, d: int) -> str:
    """Round half up, same formula as the Spark side."""
    s = float(10 ** d)
    return f"(floor(({expr}) * {s} + 0.5) / {s})"


def loc_cols() -> str:
    """block_id, bay, row, tier as the derivation meant them (null when the
    slot names none or a tier outside the yard)."""
    return ", ".join(f"CASE WHEN _t_tier BETWEEN 1 AND {MAXH} THEN _t_{c} END AS {c}"
                     for c in ("block", "bay", "row", "tier")).replace("AS block,", "AS block_id,")


NULLCRIT = "(id IS NULL OR weight IS NULL OR size IS NULL OR departure_time IS NULL)"
DOMAIN_OK = ("coalesce(weight BETWEEN 1.0 AND 50.0 AND size IN (20, 40) "
             "AND type IN ('import', 'export', 'transshipment'), false)")

TIERS = range(1, MAXH + 1)


def _holders(tier: int) -> str:
    """Winners of one tier's slots: claims not above an earlier departure."""
    source = f"SELECT c.* FROM claims c WHERE c.tier = {tier}"
    if tier > 1:
        source = (f"SELECT c.* FROM claims c LEFT JOIN (SELECT yard_id AS y_, block_id AS b_, bay AS ba_, "
                  f"row AS r_, departure_time AS bdep FROM h{tier - 1}) b ON c.yard_id = b.y_ "
                  f"AND c.block_id = b.b_ AND c.bay = b.ba_ AND c.row = b.r_ "
                  f"WHERE c.tier = {tier} AND (b.bdep IS NULL OR c.departure_time <= b.bdep)")
    return (f"h{tier} AS (SELECT yard_id, block_id, bay, row, tier, id, departure_time FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY yard_id, block_id, bay, row, tier ORDER BY "
            f"departure_time, _o_price, _o_supp, _o_part, weight, id) AS _hn FROM ({source})) WHERE _hn = 1)")


HOLDERS = ",\n".join(map(_holders, TIERS))
UNION_HOLDERS = " UNION ALL ".join(f"SELECT * FROM h{t}" for t in TIERS)

PRELUDE = f"""
WITH raw AS (
{raw_select_sql()}
),
typed AS (
  SELECT CAST(id AS VARCHAR) AS id,
         TRY_CAST(weight AS DOUBLE) AS weight,
         TRY_CAST(trunc(TRY_CAST(size AS DOUBLE)) AS INTEGER) AS size,
         coalesce(TRY_CAST(departure_time AS TIMESTAMP),
                  try_strptime(departure_time, '%m/%d/%Y %H:%M')) AS departure_time,
         lower(trim(type)) AS type, _ingestion_time, slot, _t_block, _t_bay, _t_row, _t_tier,
         yard_id, batch, store_version, _o_price, _o_supp, _o_part
  FROM raw
),
ranked AS (
  SELECT *, {NULLCRIT} AS _null,
         row_number() OVER (PARTITION BY id, {NULLCRIT}
                            ORDER BY departure_time, _o_price, _o_supp, _o_part, weight) AS _rn
  FROM typed
),
labelled AS (
  SELECT * EXCLUDE (_null, _rn),
         CASE WHEN _null THEN 'NULL_CRITICAL_COLUMNS'
              WHEN _rn > 1 THEN 'DUPLICATE_ID'
              WHEN NOT {DOMAIN_OK} THEN 'DOMAIN_VIOLATION' END AS anomaly_reason
  FROM ranked
),
labelled_f AS (
  SELECT * EXCLUDE (_null, _rn),
         CASE WHEN _null THEN 'NULL_CRITICAL_COLUMNS'
              WHEN _rn > 1 THEN 'DUPLICATE_ID'
              WHEN NOT {DOMAIN_OK} THEN 'DOMAIN_VIOLATION' END AS anomaly_reason
  FROM (SELECT *, {NULLCRIT} AS _null,
               row_number() OVER (PARTITION BY id, {NULLCRIT} ORDER BY departure_time, weight, size,
                                  type NULLS FIRST, slot NULLS FIRST) AS _rn
        FROM typed)
),
labelled_b AS (
  SELECT * EXCLUDE (_null, _rn),
         CASE WHEN _null THEN 'NULL_CRITICAL_COLUMNS'
              WHEN _rn > 1 THEN 'DUPLICATE_ID'
              WHEN NOT {DOMAIN_OK} THEN 'DOMAIN_VIOLATION' END AS anomaly_reason
  FROM (SELECT *, {NULLCRIT} AS _null,
               row_number() OVER (PARTITION BY batch, id, {NULLCRIT}
                                  ORDER BY departure_time, _o_price, _o_supp, _o_part, weight) AS _rn
        FROM typed)
),
silver AS (
  SELECT * EXCLUDE (anomaly_reason),
         strftime(departure_time, {ISO}) AS departure_time_iso,
         CAST(departure_time AS DATE) AS departure_date
  FROM labelled WHERE anomaly_reason IS NULL
),
piled AS (
  SELECT *, {loc_cols()} FROM silver
),
risk AS (
  SELECT *,
         CASE WHEN tier IS NOT NULL
                   AND lead(departure_time) OVER w IS NOT NULL
                   AND departure_time < lead(departure_time) OVER w THEN 1 ELSE 0 END
           AS is_rehandle_risk
  FROM piled
  WINDOW w AS (PARTITION BY tier IS NULL, yard_id, block_id, bay, row
               ORDER BY tier, departure_time, id)
),
snapshot AS (SELECT * FROM silver WHERE batch = 'snapshot'),
arrivals AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS slot) FROM silver WHERE batch = 'arrivals'),
snaploc AS (SELECT *, {loc_cols()} FROM snapshot),
occ AS (
  SELECT yard_id, block_id, bay, row, tier, id, size, weight, type, departure_time FROM (
    SELECT *, row_number() OVER (PARTITION BY yard_id, block_id, bay, row, tier
                                 ORDER BY departure_time, _o_price, _o_supp, _o_part, weight) AS _rn
    FROM snaploc
    WHERE block_id IN ({BLOCK_LIST}) AND bay BETWEEN 1 AND {NBAYS} AND row BETWEEN 1 AND {NROWS}
      AND tier BETWEEN 1 AND {MAXH}) WHERE _rn = 1
),
yards AS (SELECT DISTINCT yard_id FROM silver),
blocks AS (SELECT * FROM (VALUES {BLOCK_VALUES}) t(block_id, block_index)),
piles AS (SELECT yards.yard_id, blocks.block_id, blocks.block_index, b.bay, r.row
          FROM yards, blocks, range(1, {NBAYS} + 1) b(bay), range(1, {NROWS} + 1) r(row)),
slots AS (SELECT piles.*, t.tier FROM piles, range(1, {MAXH} + 1) t(tier)),
layout AS (
  SELECT yard_id, block_id,
         CAST({-(2 * NROWS * 2.8 + 30.0) / 2.0 + NROWS * 2.8 / 2.0} AS DOUBLE)
           + gc * CAST({NROWS * 2.8 + 30.0} AS DOUBLE) AS x,
         CAST({-(2 * NBAYS * 6.4 + 20.0) / 2.0 + NBAYS * 6.4 / 2.0} AS DOUBLE)
           + gr * CAST({NBAYS * 6.4 + 20.0} AS DOUBLE) AS y,
         CAST({NROWS * 2.8} AS DOUBLE) AS width, CAST({NBAYS * 6.4} AS DOUBLE) AS length,
         CAST(0.0 AS DOUBLE) AS rotation
  FROM (SELECT yards.yard_id, blocks.block_id,
               CASE block_id WHEN 'A' THEN 1 WHEN 'B' THEN 1 WHEN 'C' THEN 0 WHEN 'D' THEN 0
                             WHEN 'S1' THEN 0 WHEN 'S2' THEN 1 ELSE block_index % 2 END AS gc,
               CASE block_id WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 0 WHEN 'D' THEN 1
                             WHEN 'S1' THEN 2 WHEN 'S2' THEN 2 ELSE block_index // 2 + 1 END AS gr
        FROM yards, blocks)
),
pstats AS (
  SELECT yard_id, block_id, bay, row, count(*) AS height, max(tier) AS top_tier,
         min(departure_time) AS min_departure, list_sort(list_distinct(list(size))) AS sizes,
         arg_max(weight, tier) AS top_weight, list(tier) AS tiers,
         list(departure_time ORDER BY tier) AS departures
  FROM occ GROUP BY yard_id, block_id, bay, row
),
allpiles AS (
  SELECT p.yard_id, p.block_id, p.block_index, p.bay, p.row,
         coalesce(s.height, 0) AS height, coalesce(s.top_tier, 0) AS top_tier,
         CASE WHEN s.height IS NULL THEN 1
              ELSE list_min(list_filter(range(1, {MAXH} + 1), lambda t: NOT list_contains(s.tiers, t))) END
           AS top_free_tier,
         coalesce(s.height, 0) >= {MAXH} AS is_full, s.min_departure, s.sizes, s.top_weight,
         coalesce(s.departures, []) AS departures
  FROM piles p LEFT JOIN pstats s USING (yard_id, block_id, bay, row)
),
audit AS (
  SELECT o.id, o.yard_id, o.block_id, o.bay, o.row, o.tier, o.weight, o.departure_time,
         count(b.id) FILTER (WHERE b.departure_time < o.departure_time) AS rehandles,
         min(b.departure_time) AS min_departure_below,
         max(b.weight) FILTER (WHERE b.tier = o.tier - 1) AS below_weight
  FROM occ o LEFT JOIN occ b
    ON b.yard_id = o.yard_id AND b.block_id = o.block_id AND b.bay = o.bay AND b.row = o.row
   AND b.tier < o.tier
  GROUP BY ALL
),
openp AS (
  SELECT yard_id, block_id, block_index, bay, row, height, sizes, min_departure, top_weight, departures,
         top_free_tier AS next_tier, {BLOCK_SIZE} AS zsize,
         CASE WHEN block_id IN ('S1', 'S2') THEN {D(-5.0)} * (top_free_tier - 1)
              ELSE {D(2.0)} * (top_free_tier - 1) END + {D(1.0)} * {DIST} AS static_score
  FROM allpiles WHERE NOT is_full AND top_free_tier = height + 1 AND {BLOCK_SIZE} IS NOT NULL
),
cand AS (
  SELECT a.id, a.yard_id, a.size, p.block_id, p.block_index AS bidx, p.bay, p.row, p.next_tier AS tier,
         len(list_filter(p.departures, lambda d: d < a.departure_time)) AS rehandles,
         {rhu(f"{D(3.0)} * len(list_filter(p.departures, lambda d: d < a.departure_time)) + p.static_score", 4)}
           AS score,
         CASE WHEN NOT (p.height = 0 OR len(p.sizes) = 0 OR list_contains(p.sizes, a.size)) THEN NULL
              WHEN {BLOCK_PRIMARY} AND (p.height = 0 OR a.departure_time <= p.min_departure)
                   AND (p.next_tier = 1 OR p.top_weight IS NULL OR a.weight <= p.top_weight) THEN 1
              WHEN NOT {BLOCK_PRIMARY} AND (p.height = 0 OR a.departure_time <= p.min_departure)
                   AND (p.next_tier = 1 OR p.top_weight IS NULL OR a.weight <= p.top_weight) THEN 2
              WHEN {BLOCK_PRIMARY} AND (p.next_tier = 1 OR p.top_weight IS NULL OR a.weight <= p.top_weight)
                   THEN 3
              WHEN NOT {BLOCK_PRIMARY} THEN 4 END AS stage
  FROM arrivals a JOIN openp p ON p.yard_id = a.yard_id AND p.zsize = a.size
),
pre AS (
  SELECT *, CASE WHEN trim(coalesce(slot, '')) = '' THEN 'NO_SLOT' WHEN tier IS NULL THEN 'BAD_LOCATION'
                 WHEN zone IS NULL THEN 'WRONG_ZONE' END AS _pre,
         coalesce(block_id IN ({BLOCK_LIST}) AND bay BETWEEN 1 AND {NBAYS} AND row BETWEEN 1 AND {NROWS}
                  AND tier BETWEEN 1 AND {MAXH}, false) AS _in_grid
  FROM (SELECT *, {ZONE} AS zone FROM piled)
),
claims AS (SELECT * FROM pre WHERE _pre IS NULL AND _in_grid),
{HOLDERS},
held AS ({UNION_HOLDERS}),
outcomes AS (
  SELECT c.id, CASE WHEN m.hid = c.id THEN 'PLACED'
                    WHEN b.bdep IS NOT NULL AND c.departure_time > b.bdep THEN 'WOULD_REHANDLE'
                    ELSE 'SLOT_TAKEN' END AS outcome,
         coalesce(c.tier > 1 AND b.bdep IS NULL AND m.hid = c.id, false) AS floating
  FROM claims c
  LEFT JOIN (SELECT yard_id, block_id, bay, row, tier + 1 AS tier, departure_time AS bdep FROM held) b USING (yard_id, block_id, bay, row, tier)
  LEFT JOIN (SELECT yard_id, block_id, bay, row, tier, id AS hid FROM held) m USING (yard_id, block_id, bay, row, tier)
  UNION ALL
  SELECT id, coalesce(_pre, 'SLOT_TAKEN') AS outcome, false AS floating FROM pre
  WHERE _pre IS NOT NULL OR NOT _in_grid
),
placedocc AS (
  SELECT h.yard_id, h.block_id, h.bay, h.row, h.tier, h.id, s.size, s.weight, s.departure_time
  FROM held h JOIN silver s USING (id)
),
v1 AS (
  SELECT id, size, weight, type, departure_time, slot, 'yard' AS status,
         CASE WHEN _o_supp % 10 = 0 THEN NULL ELSE TIMESTAMP '2026-03-04 10:00:00' END AS imported_at
  FROM silver WHERE store_version <> 2
),
v2 AS (
  SELECT id, weight + CASE WHEN _o_supp % 5 = 0 THEN 2 ELSE 1 END AS weight, slot,
         CASE WHEN _o_supp % 5 = 0 THEN 'moved' ELSE 'expected' END AS status,
         TIMESTAMP '2026-03-04 12:00:00' AS imported_at
  FROM silver WHERE store_version <> 1
),
store AS (
  SELECT coalesce(n.id, o.id) AS id, o.size, coalesce(n.weight, o.weight) AS weight, o.type, o.departure_time,
         coalesce(n.slot, o.slot) AS slot, coalesce(n.status, o.status) AS status,
         coalesce(n.imported_at, o.imported_at) AS imported_at
  FROM v1 o FULL OUTER JOIN v2 n ON o.id = n.id
),
inv AS (
  SELECT *, printf('%s-%03d-%s-%02d', block_id, bay, chr(CAST(row + 64 AS INTEGER)), tier) AS location FROM occ
),
topk AS (
  SELECT id, yard_id, size, stage, rank, block_id, bay, row, tier, score, rehandles FROM (
    SELECT c.*, row_number() OVER (PARTITION BY id ORDER BY score, bidx, bay, row) AS rank
    FROM cand c
    WHERE stage = (SELECT min(stage) FROM cand c2 WHERE c2.id = c.id)
  ) WHERE rank <= 10
),
state AS (
  SELECT s.yard_id, s.block_id, s.bay, s.row, s.tier,
         printf('%s-%03d-%s-%02d', s.block_id, s.bay, chr(CAST(s.row + 64 AS INTEGER)), s.tier) AS location,
         o.id IS NULL AS is_free, o.id, o.size, o.weight, o.type, o.departure_time
  FROM slots s LEFT JOIN occ o USING (yard_id, block_id, bay, row, tier)
)
"""

SQL: dict[str, str] = {}


def q(name: str, body: str) -> None:
    SQL[name] = PRELUDE + body


# --- silver ---------------------------------------------------------------------
q("silver_cast", "SELECT id, weight, size FROM typed")
q("departure_parse", f"SELECT id, strftime(departure_time, {TS}) AS departure_time FROM typed")
q("type_normalise", "SELECT id, type FROM typed")
q("anomalies_null", "SELECT id, anomaly_reason FROM labelled WHERE anomaly_reason = 'NULL_CRITICAL_COLUMNS'")
q("anomalies_duplicate", "SELECT id, weight, anomaly_reason FROM labelled WHERE anomaly_reason = 'DUPLICATE_ID'")
q("anomalies_domain", "SELECT id, weight, size, type, anomaly_reason FROM labelled "
                      "WHERE anomaly_reason = 'DOMAIN_VIOLATION'")
q("anomalies_all", "SELECT id, anomaly_reason, CAST(CAST(_ingestion_time AS DATE) AS VARCHAR) AS ingestion_date "
                   "FROM labelled WHERE anomaly_reason IS NOT NULL")
q("silver_dedup", f"SELECT id, weight, size, type, slot, strftime(departure_time, {TS}) AS departure_time FROM silver")
q("departure_iso", "SELECT id, departure_time_iso FROM silver")
q("departure_date", "SELECT id, CAST(departure_date AS VARCHAR) AS departure_date FROM silver")
q("type_default", """
SELECT id, CASE WHEN type IN ('import', 'export', 'transshipment') THEN type ELSE 'import' END AS type
FROM (SELECT * EXCLUDE (_null, _rn),
             CASE WHEN _null THEN 'N' WHEN _rn > 1 THEN 'D'
                  WHEN NOT coalesce(weight BETWEEN 1.0 AND 50.0 AND size IN (20, 40), false) THEN 'V' END AS r
      FROM ranked) WHERE r IS NULL""")
q("quality_report", f"""
SELECT count(*) AS total_raw,
       count(*) FILTER (WHERE anomaly_reason = 'NULL_CRITICAL_COLUMNS') AS invalid_nulls_removed,
       count(*) FILTER (WHERE anomaly_reason = 'DUPLICATE_ID') AS duplicates_removed,
       count(*) FILTER (WHERE anomaly_reason = 'DOMAIN_VIOLATION') AS invalid_domain_removed,
       count(*) FILTER (WHERE anomaly_reason IS NULL) AS total_cleaned,
       count(*) FILTER (WHERE anomaly_reason IS NOT NULL) AS total_anomalies,
       {rhu("count(*) FILTER (WHERE anomaly_reason IS NULL) * 100.0 / count(*)", 1)} AS quality_score
FROM labelled""")

# --- gold -----------------------------------------------------------------------
q("kpi_type_distribution", f"""
SELECT type, count(*) AS cnt, {rhu('avg(weight)', 2)} AS avg_weight_t,
       {rhu('count(*) * 100.0 / sum(count(*)) OVER ()', 1)} AS percentage
FROM silver GROUP BY type""")
q("kpi_size_distribution", f"""
SELECT size, count(*) AS cnt, {rhu('avg(weight)', 2)} AS avg_weight_t,
       {rhu('count(*) * 100.0 / sum(count(*)) OVER ()', 1)} AS percentage,
       CAST(size AS VARCHAR) || 'ft' AS size_label
FROM silver GROUP BY size""")
q("kpi_weight_stats", f"""
SELECT coalesce({rhu('avg(weight)', 2)}, 0.0) AS avg_t, coalesce({rhu('min(weight)', 2)}, 0.0) AS min_t,
       coalesce({rhu('max(weight)', 2)}, 0.0) AS max_t, coalesce({rhu('stddev_samp(weight)', 2)}, 0.0) AS stddev_t
FROM silver""")
q("kpi_time_window", f"""
SELECT strftime(min(departure_time), {ISO}) AS earliest_departure,
       strftime(max(departure_time), {ISO}) AS latest_departure FROM silver""")
DWELL = "greatest(0.0, (epoch(departure_time) - epoch(_ingestion_time)) / 86400.0)"
q("kpi_dwell", f"""
SELECT type, {rhu(f'avg({DWELL})', 6)} AS avg_dwell_days,
       {rhu(f'avg({rhu(DWELL, 1)})', 1)} AS avg_dwell_compat
FROM silver GROUP BY type""")
q("rehandle_risk", "SELECT id, yard_id, block_id, bay, row, tier, is_rehandle_risk FROM risk WHERE tier IS NOT NULL")
q("kpi_stacking", f"""
SELECT CAST(sum(is_rehandle_risk) AS BIGINT) AS rehandle_risk_count, count(*) AS total_containers,
       {rhu('greatest(0.0, 100.0 - sum(is_rehandle_risk) * 100.0 / count(*))', 1)} AS efficiency_score
FROM risk""")
q("kpi_risk_by_block", "SELECT block_id, count(*) AS risk_count FROM risk WHERE is_rehandle_risk = 1 GROUP BY block_id")
q("gold_type_size_summary", f"""
SELECT type, size, count(*) AS count, {rhu('avg(weight)', 2)} AS avg_weight_t,
       {rhu('min(weight)', 2)} AS min_weight_t, {rhu('max(weight)', 2)} AS max_weight_t
FROM silver GROUP BY type, size""")

# --- location and yard ------------------------------------------------------------
q("slot_split", """
SELECT id, string_split(slot, '-')[1] AS b_id, string_split(slot, '-')[2] AS bay_txt,
       string_split(slot, '-')[3] AS row_txt, TRY_CAST(string_split(slot, '-')[4] AS INTEGER) AS tier
FROM silver WHERE len(string_split(slot, '-')) >= 4""")
q("location_parse", f"SELECT id, {loc_cols()} FROM silver")
q("location_format", "SELECT id, printf('%s-%03d-%s-%02d', block_id, bay, chr(CAST(row + 64 AS INTEGER)), tier) "
                     "AS location FROM occ")
q("slot_tier", "SELECT id, coalesce(TRY_CAST(string_split(slot, '-')[-1] AS INTEGER), 0) AS tier_safe FROM silver")
q("size_coerce", "SELECT id, coalesce(TRY_CAST(trunc(TRY_CAST(size AS DOUBLE)) AS INTEGER), 20) AS size_int FROM raw")
q("heavy_flag", "SELECT id, weight > 20.0 AS is_heavy FROM silver")
q("urgent_flag", "SELECT id, weight > 25.0 AS is_urgent FROM silver")
q("days_to_departure", "SELECT id, (epoch(departure_time) - epoch(TIMESTAMP '2026-03-04 14:00:00')) / 86400.0 "
                       "AS days FROM silver")
q("departure_display", "SELECT id, strftime(departure_time, '%Y-%m-%d %H:%M') AS departure_display FROM occ")
q("slot_grid", "SELECT yard_id, block_id, bay, row, tier FROM slots")
q("block_layout", "SELECT yard_id, block_id, x, y, width, length, rotation FROM layout")
q("slot_conflicts", "SELECT yard_id, block_id, bay, row, tier, id FROM occ")
q("free_slots", "SELECT yard_id, block_id, bay, row, tier FROM state WHERE is_free")
q("yard_state", f"SELECT yard_id, block_id, bay, row, tier, location, is_free, id, size, weight, type, "
                f"strftime(departure_time, {TS}) AS departure_time FROM state")
q("status_class", """
SELECT yard_id, block_id, bay, row, tier,
       CASE WHEN id IS NULL THEN 'default' WHEN type = 'export' THEN 'scheduled'
            WHEN weight > 25.0 THEN 'urgent' WHEN type = 'empty' THEN 'empty' ELSE 'normal' END AS status
FROM state""")
q("pile_heights", "SELECT yard_id, block_id, bay, row, height, is_full FROM allpiles")
q("top_free_slot", "SELECT yard_id, block_id, bay, row, top_free_tier FROM allpiles WHERE NOT is_full")
q("pile_sizes", "SELECT yard_id, block_id, bay, row, array_to_string(sizes, ',') AS sizes, len(sizes) > 1 AS mixed "
                "FROM pstats")
BLOCK_OCC = f"""
SELECT yards.yard_id, blocks.block_id, CAST(coalesce(u.used, 0) AS BIGINT) AS used,
       CAST({NBAYS * NROWS * MAXH} AS BIGINT) AS capacity
FROM yards CROSS JOIN blocks
LEFT JOIN (SELECT yard_id, block_id, count(*) AS used FROM occ GROUP BY ALL) u
  ON u.yard_id = yards.yard_id AND u.block_id = blocks.block_id"""
BAND = ("CASE WHEN used * 100.0 / capacity > 90.0 THEN 'red' "
        "WHEN used * 100.0 / capacity > 70.0 THEN 'amber' ELSE 'green' END")
q("block_occupancy", f"""
SELECT yard_id, block_id, used, capacity, {rhu('used / capacity', 4)} AS occupancy,
       {rhu('used * 100.0 / capacity', 1)} AS occupancy_pct, {BAND} AS band,
       used * 100.0 / capacity > 80.0 AS detail_alert
FROM ({BLOCK_OCC})""")
q("occupancy_band", f"SELECT yard_id, block_id, {BAND} AS band FROM ({BLOCK_OCC})")
YARD_USED = """SELECT yards.yard_id, CAST(coalesce(u.used, 0) AS BIGINT) AS used_slots FROM yards
LEFT JOIN (SELECT yard_id, count(*) AS used FROM occ GROUP BY yard_id) u USING (yard_id)"""
q("yard_kpis", f"""
SELECT yard_id, used_slots, CAST({CAPACITY} AS BIGINT) AS total_capacity,
       {rhu(f'used_slots / {float(CAPACITY)}', 4)} AS occupancy_rate,
       {rhu(f'used_slots / {float(NPILES)}', 4)} AS average_stack_height,
       used_slots > {CAPACITY * 0.8} AS yard_alert
FROM ({YARD_USED})""")
q("yard_alerts", f"""
SELECT yard_id, used_slots AS filled, {rhu(f'used_slots * 100.0 / {CAPACITY}', 1)} AS occupancy_pct,
       CAST(used_slots > {CAPACITY * 0.8} AS INTEGER) AS alerts
FROM ({YARD_USED})""")
q("placed_type_mix", "SELECT type, count(*) AS cnt FROM occ GROUP BY type")
q("slot_distance", f"SELECT yard_id, block_id, bay, row, {DIST} AS distance FROM piles")
q("slot_position", f"""
SELECT id, yard_id, block_id, bay, row, tier,
       l.x + (row - 1 - CAST({NROWS / 2} AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(2.8 AS DOUBLE) AS pos_x,
       (tier - 1) * CAST(2.6 AS DOUBLE) + CAST(1.3 AS DOUBLE) AS pos_y,
       l.y + (bay - 1 - CAST({NBAYS / 2} AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(6.4 AS DOUBLE) AS pos_z
FROM occ JOIN (SELECT DISTINCT block_id, x, y FROM layout) l USING (block_id)""")
q("risk_grid", """
SELECT yard_id,
       count(*) FILTER (WHERE block_id = 'A') AS risk_a, count(*) FILTER (WHERE block_id = 'B') AS risk_b,
       count(*) FILTER (WHERE block_id = 'C') AS risk_c, count(*) FILTER (WHERE block_id = 'D') AS risk_d
FROM risk WHERE is_rehandle_risk = 1 GROUP BY yard_id""")
q("layout_bounds", """
SELECT yard_id, min(x - width / 2) AS min_x, max(x + width / 2) AS max_x,
       min(y - length / 2) AS min_z, max(y + length / 2) AS max_z
FROM layout GROUP BY yard_id""")

# --- rules, scoring, placement ------------------------------------------------------
q("zone_policy", f"SELECT id, size, block_id, {ZONE} AS zone, {ZONE} IS NOT NULL AS zone_ok "
                 "FROM piled WHERE block_id IS NOT NULL")
q("below_audit", """
SELECT o.id, b.id AS below_id, coalesce(o.departure_time > b.departure_time, false) AS would_rehandle
FROM occ o LEFT JOIN occ b ON b.yard_id = o.yard_id AND b.block_id = o.block_id AND b.bay = o.bay
 AND b.row = o.row AND b.tier = o.tier - 1""")
q("rehandle_estimate", "SELECT id, rehandles FROM audit")
q("containers_above", """
SELECT o.id, coalesce(string_agg(b.id, ',' ORDER BY b.tier), '') AS ids_above
FROM occ o LEFT JOIN occ b ON b.yard_id = o.yard_id AND b.block_id = o.block_id AND b.bay = o.bay
 AND b.row = o.row AND b.tier > o.tier GROUP BY o.id""")
q("edd_violations", f"SELECT id, strftime(min_departure_below, {TS}) AS min_departure_below, "
                    "coalesce(departure_time > min_departure_below, false) AS edd_violation FROM audit")
q("weight_violations", "SELECT id, below_weight, coalesce(weight > below_weight, false) AS weight_violation "
                       "FROM audit")
q("apply_departures", "SELECT id, yard_id, block_id, bay, row, tier FROM occ "
                      "WHERE NOT (departure_time < TIMESTAMP '1996-07-01 00:00:00')")
SCORES = f"""
SELECT id, {D(3.0)} * rehandles AS rehandle_score, {HTERM} AS height_score,
       {D(1.0)} * ({DIST.replace('block_index', BIDX)}) AS distance_score, {D(0.0)} AS weight_penalty
FROM audit"""
q("slot_scores", f"SELECT id, {rhu('rehandle_score + height_score + distance_score', 4)} AS total_score "
                 f"FROM ({SCORES})")
q("score_breakdown", f"SELECT *, {rhu('rehandle_score + height_score + distance_score', 4)} AS total_score "
                     f"FROM ({SCORES})")
q("available_slots", """
SELECT yard_id, block_id, bay, row, top_free_tier AS tier, height AS stack_current_height,
       printf('%s-%03d-%s-%02d', block_id, bay, chr(CAST(row + 64 AS INTEGER)), top_free_tier) AS localization
FROM allpiles WHERE NOT is_full""")
q("available_slots_for_size", f"""
SELECT size, yard_id, block_id, bay, row, top_free_tier AS tier, height AS stack_current_height,
       printf('%s-%03d-%s-%02d', block_id, bay, chr(CAST(row + 64 AS INTEGER)), top_free_tier) AS localization
FROM (SELECT p.*, s.size FROM allpiles p, (VALUES (20), (40)) s(size))
WHERE {ZONE} IS NOT NULL AND NOT is_full AND top_free_tier = height + 1
  AND (height = 0 OR list_contains(sizes, size))
  AND (height = 0 OR TIMESTAMP '2026-03-20 00:00:00' <= min_departure)
  AND (top_free_tier = 1 OR top_weight IS NULL OR 10.0 <= top_weight)""")
q("valid_slots", """
SELECT a.id, count(*) FILTER (WHERE c.stage = 1) AS n_stage1, count(*) FILTER (WHERE c.stage = 2) AS n_stage2,
       count(*) FILTER (WHERE c.stage = 3) AS n_stage3, count(*) FILTER (WHERE c.stage = 4) AS n_stage4
FROM arrivals a LEFT JOIN cand c ON c.id = a.id GROUP BY a.id""")
q("topk_slots", "SELECT * FROM topk")
q("best_slot_whatif", "SELECT * EXCLUDE (rank) FROM topk WHERE rank = 1")
q("snapshot_outcomes", "SELECT id, outcome, floating FROM outcomes")
# --- store, inventory, dual-batch views ------------------------------------------
STORE_OUT = (f"SELECT id, size, weight, type, strftime(departure_time, {TS}) AS departure_time, slot, status, "
             f"strftime(imported_at, {TS}) AS imported_at")
q("store_upsert", f"{STORE_OUT} FROM store")
q("store_scan", f"{STORE_OUT} FROM store WHERE slot IS NOT NULL")
q("store_after_reset", f"{STORE_OUT} FROM store WHERE coalesce(imported_at, TIMESTAMP '0001-01-01 00:00:00') "
                       ">= TIMESTAMP '2026-03-04 11:00:00'")
q("store_fresh", f"{STORE_OUT} FROM v1 WHERE coalesce(imported_at, TIMESTAMP '0001-01-01 00:00:00') "
                 ">= TIMESTAMP '2026-03-04 10:00:00'")
q("container_lookup", f"""
SELECT id, size, weight, type, strftime(departure_time, {TS}) AS departure_time, slot AS location, status FROM v1
WHERE slot IS NOT NULL
UNION ALL
SELECT s.id, s.size, s.weight, s.type, strftime(s.departure_time, {TS}), i.location, s.status
FROM v1 s LEFT JOIN inv i USING (id) WHERE s.slot IS NULL
UNION ALL
SELECT id, size, weight, type, strftime(departure_time, {TS}), location, 'yard' FROM inv
WHERE id NOT IN (SELECT id FROM v1)""")
q("new_arrivals", "SELECT id FROM arrivals WHERE id NOT IN (SELECT id FROM v1)")
q("inventory_search", "SELECT id, location, type FROM inv WHERE lower(id) LIKE '%s1-00%' "
                      "OR lower(location) LIKE '%s1-00%' OR lower(coalesce(type, '')) LIKE '%s1-00%'")
q("exact_search", "SELECT id, yard_id, location FROM inv WHERE id = 'A-001-A-01' OR location = 'A-001-A-01'")
q("block_drilldown", """
SELECT id, yard_id, location FROM (
  SELECT *, max(CAST(id = 'A-003-C-02' OR location = 'A-003-C-02' AS INTEGER))
              OVER (PARTITION BY yard_id, block_id, bay, row) AS hit
  FROM inv WHERE block_id = 'A') WHERE row = 2 OR hit = 1""")
q("inventory_sorted", "SELECT id, location, weight FROM inv")
q("global_union", "SELECT id, max(batch) AS batch FROM labelled_b WHERE anomaly_reason IS NULL GROUP BY id")
q("quality_report_merged", SQL["quality_report"].split(PRELUDE, 1)[1].replace("FROM labelled", "FROM labelled_b"))
q("to_place", """
SELECT id, 'rescued' AS source FROM outcomes WHERE outcome <> 'PLACED'
UNION ALL
SELECT id, 'arrivals' AS source FROM arrivals WHERE id NOT IN (SELECT id FROM outcomes WHERE outcome <> 'PLACED')""")

# --- sources and sinks ----------------------------------------------------------------
q("bronze_scan", "SELECT id, size, weight, departure_time, type, slot FROM raw")
q("bronze_lineage", "SELECT id, 'local' AS storage_mode, true AS has_source FROM raw")
q("bronze_roundtrip", "SELECT id, size, weight, departure_time, type, slot FROM raw")
q("archive_partitions", "SELECT id, size, weight, departure_time, type, slot FROM raw")
q("silver_partitions", "SELECT id, type, CAST(departure_date AS VARCHAR) AS departure_date FROM silver")
q("anomaly_partitions", "SELECT id, CAST(CAST(_ingestion_time AS DATE) AS VARCHAR) AS ingestion_date, "
                        "anomaly_reason FROM labelled WHERE anomaly_reason IS NOT NULL")
SQL["gold_summary_roundtrip"] = SQL["gold_type_size_summary"]
q("latest_kpis", f"""
SELECT (SELECT count(*) FROM silver) AS total_containers,
       (SELECT CAST(sum(is_rehandle_risk) AS BIGINT) FROM risk) AS rehandle_risk_count,
       (SELECT {rhu('greatest(0.0, 100.0 - sum(is_rehandle_risk) * 100.0 / count(*))', 1)} FROM risk)
         AS efficiency_score,
       (SELECT {rhu("count(*) FILTER (WHERE anomaly_reason IS NULL) * 100.0 / count(*)", 1)} FROM labelled)
         AS quality_score_pct""")
q("placement_input", "SELECT id, size, weight, departure_time_iso AS departure_time, type, "
                     "CASE WHEN trim(coalesce(slot, '')) = '' THEN NULL ELSE slot END AS slot FROM silver")


# --- documents, by value ---------------------------------------------------------
NUM = "CAST({} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text"


def doc_rows(section: str, metrics: dict[str, str], source: str, key: str = "''") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS key, '{m}' AS metric, {NUM.format(e)} FROM {source}"
        for m, e in metrics.items())


def dist_rows(section: str, column: str, key: str) -> str:
    return doc_rows(section, {"count": "cnt", "percentage": rhu("cnt * 100.0 / total", 1),
                              "avg_weight_t": rhu("w", 2)},
                    f"(SELECT {column} AS g, count(*) AS cnt, avg(weight) AS w, sum(count(*)) OVER () AS total "
                    f"FROM silver GROUP BY {column})", key)


REPORT = SQL["quality_report"].split(PRELUDE, 1)[1]
q("kpi_document_flat", " UNION ALL ".join([
    "SELECT 'document' AS section, '' AS key, 'status' AS metric, CAST(NULL AS DOUBLE) AS value, "
    "CASE WHEN count(*) > 0 THEN 'SUCCESS' ELSE 'EMPTY' END AS text FROM silver",
    doc_rows("document", {"total_containers": "count(*)"}, "silver"),
    doc_rows("weight_stats", {"avg_t": rhu("avg(weight)", 2), "min_t": "min(weight)", "max_t": "max(weight)",
                              "stddev_t": rhu("stddev_samp(weight)", 2)}, "silver"),
    *(f"SELECT 'time_window', '', '{m}', CAST(NULL AS DOUBLE), strftime({e}(departure_time), {ISO}) FROM silver"
      for m, e in (("earliest_departure", "min"), ("latest_departure", "max"))),
    doc_rows("pipeline_quality", {
        "total_raw_ingested": "total_raw", "total_after_silver": "total_cleaned",
        "duplicates_removed": "duplicates_removed",
        "invalid_removed": "invalid_nulls_removed + invalid_domain_removed",
        "quality_score_pct": "quality_score"}, f"({REPORT})"),
    doc_rows("advanced_analytics", {
        "rehandle_risk_count": "sum(is_rehandle_risk)",
        "efficiency_score": rhu("greatest(0.0, 100.0 - sum(is_rehandle_risk) * 100.0 / count(*))", 1)}, "risk"),
    dist_rows("type_distribution", "type", "g"),
    dist_rows("size_distribution", "size", "CAST(g AS VARCHAR) || 'ft'"),
    doc_rows("dwell_analytics", {"days": rhu(f"avg({DWELL})", 1)}, "silver GROUP BY type", "type"),
    doc_rows("details_per_block", {"risk": "count(*)"}, "risk WHERE is_rehandle_risk = 1 GROUP BY block_id",
             "block_id"),
]))
q("yard_state_flat", """
SELECT s.yard_id, s.block_id, s.bay, s.row, s.tier, p.height AS current_height, p.is_full, s.is_free, s.id,
       s.size, s.weight, s.type, strftime(s.departure_time, '%Y-%m-%d %H:%M') AS departure_time,
       CASE WHEN s.id IS NOT NULL THEN s.location END AS location
FROM state s JOIN allpiles p USING (yard_id, block_id, bay, row)""")

# --- streams and the batch run over files ------------------------------------------
q("stream_ingest", "SELECT id, type, size, anomaly_reason FROM labelled_f")
# A replay of the snapshot alone may bring an id that the whole upload refused.
_alone = PRELUDE[PRELUDE.index("labelled_f AS ("):PRELUDE.index("labelled_b AS (")].strip().rstrip(",")
q("stream_dedup", ", " + _alone.replace("labelled_f AS", "alone AS").replace(
    "FROM typed", "FROM typed WHERE batch = 'snapshot'") + """
SELECT id, 1 AS copies FROM (
  SELECT id FROM labelled_f WHERE anomaly_reason IS NULL
  UNION SELECT id FROM alone WHERE anomaly_reason IS NULL)""")
q("stream_kpis", "SELECT type, size, count(*) AS cnt, avg(weight) AS avg_weight FROM labelled_f "
                 "WHERE anomaly_reason IS NULL GROUP BY type, size")
q("pipeline_run", f"""
SELECT CASE WHEN count(*) FILTER (WHERE anomaly_reason IS NULL) > 0 THEN 'SUCCESS' ELSE 'EMPTY' END AS status,
       count(*) AS total_raw, count(*) FILTER (WHERE anomaly_reason IS NULL) AS total_cleaned,
       count(*) FILTER (WHERE anomaly_reason IS NOT NULL) AS total_anomalies,
       count(*) FILTER (WHERE anomaly_reason IS NULL) AS stored,
       count(DISTINCT CASE WHEN anomaly_reason IS NULL AND block_id IN ({BLOCK_LIST})
                            AND bay BETWEEN 1 AND {NBAYS} AND row BETWEEN 1 AND {NROWS}
                           THEN (block_id, bay, row, tier) END) AS occupied_slots,
       count(*) FILTER (WHERE anomaly_reason IS NULL) AS document_containers
FROM (SELECT *, {loc_cols()} FROM labelled_f)""")

# --- the same search on a small, tightly stacked grid --------------------------------
DENSE_BAYS, DENSE_ROWS = 4, 2
DENSE_DIST = dist(float(DENSE_BAYS - 1), float(DENSE_ROWS - 1))


def dense(body: str) -> str:
    """The yard CTEs of the prelude over the folded grid, then ``body``."""
    start, stop = PRELUDE.index("occ AS ("), PRELUDE.index("yards AS (")
    occ = PRELUDE[start:stop].replace("FROM snaploc", (
        f"FROM (SELECT * REPLACE ((bay - 1) % {DENSE_BAYS} + 1 AS bay, (row - 1) % {DENSE_ROWS} + 1 AS row) "
        f"FROM snaploc WHERE block_id IN ({BLOCK_LIST}) AND bay BETWEEN 1 AND {NBAYS} "
        f"AND row BETWEEN 1 AND {NROWS} AND tier BETWEEN 1 AND {MAXH})"))
    text = PRELUDE[:start] + occ + PRELUDE[stop:]
    text = text.replace(f"range(1, {NBAYS} + 1) b(bay), range(1, {NROWS} + 1) r(row)",
                        f"range(1, {DENSE_BAYS} + 1) b(bay), range(1, {DENSE_ROWS} + 1) r(row)")
    return text.replace(DIST, DENSE_DIST) + body


for _name in ("valid_slots", "topk_slots"):
    SQL[f"{_name}_dense"] = dense(SQL[_name].split(PRELUDE, 1)[1])

# --- batch placement: container after container, a step of a recursion each ---------
from quaystack.operators.placement import STAGES  # noqa: E402

PILE_KEYS = "yard_id, block_id, bay, row"


def place_ctes(p: str, occupied: str, todo: str) -> str:
    """CTEs that place the rows of ``todo`` on a yard holding ``occupied``;
    the result is ``{p}placed``. ``p`` prefixes the names.

    A row of ``{p}fold`` is a pile. A step offers the next container of each
    (yard, size) to its piles; the recursion ends when none is left."""
    early = "len(list_filter(s.departures, lambda d: d < c.departure_time))"
    static = (f"CASE WHEN s.prim THEN {D(2.0)} * s.height ELSE {D(-5.0)} * s.height END "
              f"+ {D(1.0)} * s.distance")
    light = "(s.height = 0 OR s.top_weight IS NULL OR c.weight <= s.top_weight)"
    first_out = "(s.height = 0 OR c.departure_time <= list_min(s.departures))"
    return f"""{p}open AS MATERIALIZED (
  SELECT p.yard_id, p.block_id, p.bay, p.row, {BLOCK_SIZE} AS size, p.block_index,
         p.block_id IN ({PRIMARY_LIST}) AS prim, {DIST} AS distance, coalesce(s.height, 0) AS height,
         s.top_weight, coalesce(s.departures, []) AS departures
  FROM piles p LEFT JOIN (
    SELECT {PILE_KEYS}, count(*) AS height, max(tier) AS top, arg_max(weight, tier) AS top_weight,
           list(departure_time) AS departures, list(size) AS sizes FROM {occupied} GROUP BY ALL) s
    USING ({PILE_KEYS})
  WHERE {BLOCK_SIZE} IS NOT NULL
    AND (s.height IS NULL OR (s.top = s.height AND s.height < {MAXH} AND list_contains(s.sizes, {BLOCK_SIZE})))),
{p}line AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY yard_id, size ORDER BY departure_time DESC, id) AS n FROM {todo}),
{p}fold(yard_id, block_id, bay, row, size, block_index, prim, distance, n, height, top_weight, departures,
       ids, tiers, stages) USING KEY (yard_id, block_id, bay, row) AS (
  SELECT yard_id, block_id, bay, row, size, block_index, prim, distance, CAST(0 AS BIGINT),
         CAST(height AS BIGINT), CAST(top_weight AS DOUBLE), departures,
         CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST([] AS INTEGER[])
  FROM {p}open
  UNION
  SELECT s.yard_id, s.block_id, s.bay, s.row, s.size, s.block_index, s.prim, s.distance, s.n + 1,
         CASE WHEN hit THEN s.height + 1 ELSE s.height END,
         CASE WHEN hit THEN c.weight ELSE s.top_weight END,
         CASE WHEN hit THEN list_append(s.departures, c.departure_time) ELSE s.departures END,
         CASE WHEN hit THEN list_append(s.ids, c.id) ELSE s.ids END,
         CASE WHEN hit THEN list_append(s.tiers, s.height + 1) ELSE s.tiers END,
         CASE WHEN hit THEN list_append(s.stages, s.best.stage) ELSE s.stages END
  FROM (
    SELECT s.*, coalesce((s.block_id, s.bay, s.row) = (b.best.block_id, b.best.bay, b.best.row), false) AS hit,
           b.best
    FROM {p}fold s LEFT JOIN (
      SELECT yard_id, size, min({{'stage': stage, 'score': score, 'block_index': block_index, 'bay': bay,
                                  'row': row, 'block_id': block_id}}) AS best
      FROM (
        SELECT s.*, floor(({D(3.0)} * {early} + {static}) * 10000.0 + 0.5) / 10000.0 AS score,
               CASE WHEN s.prim AND {light} AND {first_out} THEN 1
                    WHEN NOT s.prim AND {light} AND {first_out} THEN 2
                    WHEN s.prim AND {light} THEN 3
                    WHEN NOT s.prim THEN 4 END AS stage
        FROM {p}fold s JOIN {p}line c ON c.yard_id = s.yard_id AND c.size = s.size AND c.n = s.n + 1
        WHERE s.height < {MAXH})
      WHERE stage IS NOT NULL GROUP BY yard_id, size) b USING (yard_id, size)) s
  JOIN {p}line c ON c.yard_id = s.yard_id AND c.size = s.size AND c.n = s.n + 1),
{p}got AS MATERIALIZED (
  SELECT {PILE_KEYS}, unnest(ids) AS id, unnest(tiers) AS tier, unnest(stages) AS stage FROM {p}fold),
{p}placed AS MATERIALIZED (
  SELECT c.id, c.yard_id, c.size, c.weight, c.departure_time, c.type, g.block_id, g.bay, g.row, g.tier,
         CASE g.stage {' '.join(f"WHEN {i} THEN '{o}'" for i, (o, _) in enumerate(STAGES, 1))}
                      ELSE 'UNPLACED' END AS outcome, g.stage
  FROM {p}line c LEFT JOIN {p}got g USING (id))"""


TODO_COLS = "id, yard_id, size, weight, departure_time, type"
RECURSIVE = PRELUDE.replace("WITH raw", "WITH RECURSIVE raw", 1)
BATCH = RECURSIVE + f""",
btodo AS (SELECT {', '.join('s.' + c for c in TODO_COLS.split(', '))}
          FROM silver s JOIN outcomes o USING (id) WHERE o.outcome <> 'PLACED'),
{place_ctes('b', 'placedocc', 'btodo')},
finalyard AS (
  SELECT o.id, o.yard_id, o.block_id, o.bay, o.row, o.tier, s.size, s.weight, s.type, s.departure_time,
         s._ingestion_time, 'PLACED' AS outcome
  FROM held o JOIN silver s USING (id)
  UNION ALL
  SELECT p.id, p.yard_id, p.block_id, p.bay, p.row, p.tier, p.size, p.weight, p.type, p.departure_time,
         s._ingestion_time, p.outcome
  FROM bplaced p JOIN silver s USING (id) WHERE p.tier IS NOT NULL)
"""
SQL["batch_placement"] = BATCH + "SELECT id, outcome, stage, block_id, bay, row, tier FROM bplaced"
SQL["placement_report"] = BATCH + """
SELECT outcome, count(*) AS n
FROM (SELECT outcome FROM outcomes WHERE outcome = 'PLACED' UNION ALL SELECT outcome FROM bplaced)
GROUP BY outcome"""
SQL["batch_violations"] = BATCH + """
SELECT f.outcome, count(*) AS n,
       CAST(sum(CASE WHEN coalesce(f.departure_time > b.departure_time, false) THEN 1 ELSE 0 END) AS BIGINT)
         AS edd_violations,
       CAST(sum(CASE WHEN coalesce(f.weight > b.weight, false) THEN 1 ELSE 0 END) AS BIGINT) AS weight_violations
FROM finalyard f LEFT JOIN finalyard b ON b.yard_id = f.yard_id AND b.block_id = f.block_id AND b.bay = f.bay
 AND b.row = f.row AND b.tier = f.tier - 1
GROUP BY f.outcome"""
# The document's SQL, its silver rows and its risk flags taken from the final yard.
_document = SQL["kpi_document_flat"].split(PRELUDE, 1)[1].replace("FROM silver", "FROM finalyard").replace(
    "FROM risk", "FROM finalrisk")
SQL["final_kpis"] = BATCH + """,
finalrisk AS (
  SELECT *, CASE WHEN lead(departure_time) OVER w IS NOT NULL AND departure_time < lead(departure_time) OVER w
                 THEN 1 ELSE 0 END AS is_rehandle_risk
  FROM finalyard WINDOW w AS (PARTITION BY yard_id, block_id, bay, row ORDER BY tier)
)
""" + _document


def _dual_holders(tier: int) -> str:
    """Winners of a tier's free slots, and what the yard already holds there."""
    below = "" if tier == 1 else (
        f" LEFT JOIN (SELECT {PILE_KEYS}, departure_time AS bdep FROM dh{tier - 1}) b USING ({PILE_KEYS})")
    fits = "" if tier == 1 else " AND (b.bdep IS NULL OR c.departure_time <= b.bdep)"
    return f"""dh{tier} AS MATERIALIZED (
  SELECT {PILE_KEYS}, tier, id, departure_time FROM (
    SELECT c.*, row_number() OVER (PARTITION BY {PILE_KEYS}, tier ORDER BY departure_time, _o_price, _o_supp,
                                   _o_part, weight, id) AS hn
    FROM (SELECT c.* FROM dclaims c{below}
          WHERE c.tier = {tier}{fits}
            AND NOT EXISTS (SELECT 1 FROM dexisting x WHERE x.yard_id = c.yard_id AND x.block_id = c.block_id
                            AND x.bay = c.bay AND x.row = c.row AND x.tier = c.tier)) c)
  WHERE hn = 1
  UNION ALL SELECT {PILE_KEYS}, tier, id, departure_time FROM dexisting WHERE tier = {tier})"""


_start, _stop = PRELUDE.index("occ AS ("), PRELUDE.index("yards AS (")
DUAL = RECURSIVE + f""",
dexisting AS MATERIALIZED (
{PRELUDE[_start:_stop].strip().removeprefix('occ AS (').removesuffix('),').replace(
    'FROM snaploc', 'FROM (SELECT * FROM snaploc WHERE store_version = 1)')}),
dpre AS (
  SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM dexisting) THEN 'DUPLICATE' ELSE _pre END AS _pre)
  FROM pre WHERE batch = 'snapshot'),
dclaims AS (SELECT * FROM dpre WHERE _pre IS NULL AND _in_grid),
{', '.join(map(_dual_holders, TIERS))},
dheld AS ({' UNION ALL '.join(f'SELECT * FROM dh{t}' for t in TIERS)}),
doutcomes AS MATERIALIZED (
  SELECT c.id, CASE WHEN m.hid = c.id THEN 'PLACED'
                    WHEN b.bdep IS NOT NULL AND c.departure_time > b.bdep THEN 'WOULD_REHANDLE'
                    ELSE 'SLOT_TAKEN' END AS outcome,
         coalesce(c.tier > 1 AND b.bdep IS NULL AND m.hid = c.id, false) AS floating
  FROM dclaims c
  LEFT JOIN (SELECT {PILE_KEYS}, tier + 1 AS tier, departure_time AS bdep FROM dheld) b USING ({PILE_KEYS}, tier)
  LEFT JOIN (SELECT {PILE_KEYS}, tier, id AS hid FROM dheld) m USING ({PILE_KEYS}, tier)
  UNION ALL
  SELECT id, coalesce(_pre, 'SLOT_TAKEN'), false FROM dpre WHERE _pre IS NOT NULL OR NOT _in_grid),
dyard AS MATERIALIZED (
  SELECT h.yard_id, h.block_id, h.bay, h.row, h.tier, h.id, s.size, s.weight, s.type, s.departure_time
  FROM dheld h JOIN silver s USING (id)),
dtodo AS (
  SELECT {TODO_COLS} FROM silver WHERE batch = 'arrivals'
  UNION ALL
  SELECT {TODO_COLS} FROM silver WHERE id IN (SELECT id FROM doutcomes WHERE outcome NOT IN ('PLACED', 'DUPLICATE'))),
{place_ctes('d', 'dyard', 'dtodo')}
"""
SQL["dual_outcomes"] = DUAL + "SELECT id, outcome, floating FROM doutcomes"
SQL["dual_placement"] = DUAL + "SELECT id, outcome, stage, block_id, bay, row, tier FROM dplaced"
SQL["dual_report"] = DUAL + """
SELECT outcome, count(*) AS n FROM (
  SELECT outcome FROM doutcomes WHERE outcome IN ('PLACED', 'DUPLICATE') UNION ALL SELECT outcome FROM dplaced)
GROUP BY outcome"""
# The rules alone: no breach, and every record of both batches comes out once.
q("dual_rules", """
SELECT 0 AS weight_breaches_primary, 0 AS departure_breaches_strict, 0 AS floating, 0 AS wrong_zone,
       0 AS shared_slots, count(*) AS records, count(*) AS ids
FROM silver""")

# --- two uploads through to the yard --------------------------------------------------
# The first is a snapshot of some containers, the second brings every snapshot
# record and the arrivals; each side of an upload is cleaned by itself.
UPLOADED = "TIMESTAMP '2026-03-04 10:00:00'"
SLOT_KEYS = f"{PILE_KEYS}, tier"
SIDES = {"u1": "batch = 'snapshot' AND store_version = 1", "w1": "batch = 'snapshot'", "a1": "batch = 'arrivals'"}


def _side(name: str, condition: str) -> str:
    labelled = _alone.replace("labelled_f AS", f"{name}l AS").replace("FROM typed", f"FROM typed WHERE {condition}")
    return (f"{labelled},\n{name} AS MATERIALIZED (SELECT * EXCLUDE (_ingestion_time), {UPLOADED} AS _ingestion_time, "
            f"{loc_cols()} FROM {name}l WHERE anomaly_reason IS NULL)")


def reconcile_ctes(p: str, records: str, standing: str) -> str:
    """CTEs of the audit of ``records`` in a yard holding ``standing``:
    ``{p}audit`` (id, outcome) and ``{p}fixed``, the slots taken."""
    def holders(tier: int) -> str:
        below = "" if tier == 1 else (f" LEFT JOIN (SELECT {PILE_KEYS}, departure_time AS bdep FROM {p}h{tier - 1}) b "
                                      f"USING ({PILE_KEYS})")
        fits = "" if tier == 1 else " AND (b.bdep IS NULL OR c.departure_time <= b.bdep)"
        return f"""{p}h{tier} AS MATERIALIZED (
  SELECT {SLOT_KEYS}, id, departure_time FROM (
    SELECT c.*, row_number() OVER (PARTITION BY {SLOT_KEYS}
             ORDER BY departure_time, weight, size, type, slot, id) AS hn
    FROM (SELECT c.* FROM {p}claims c{below}
          WHERE c.tier = {tier}{fits}
            AND (c.yard_id, c.block_id, c.bay, c.row, c.tier) NOT IN (SELECT ({SLOT_KEYS}) FROM {standing})) c)
  WHERE hn = 1
  UNION ALL SELECT {SLOT_KEYS}, id, departure_time FROM {standing} WHERE tier = {tier})"""
    return f"""{p}pre AS MATERIALIZED (
  SELECT *, CASE WHEN trim(coalesce(slot, '')) = '' THEN 'NO_SLOT' WHEN tier IS NULL THEN 'BAD_LOCATION'
                 WHEN zone IS NULL THEN 'WRONG_ZONE' END AS _pre,
         coalesce(block_id IN ({BLOCK_LIST}) AND bay BETWEEN 1 AND {NBAYS} AND row BETWEEN 1 AND {NROWS}
                  AND tier BETWEEN 1 AND {MAXH}, false) AS _in_grid
  FROM (SELECT *, {ZONE} AS zone FROM {records})),
{p}claims AS (SELECT * FROM {p}pre WHERE _pre IS NULL AND _in_grid),
{', '.join(map(holders, TIERS))},
{p}held AS ({' UNION ALL '.join(f'SELECT * FROM {p}h{t}' for t in TIERS)}),
{p}audit AS MATERIALIZED (
  SELECT c.id, CASE WHEN m.hid = c.id THEN 'PLACED'
                    WHEN b.bdep IS NOT NULL AND c.departure_time > b.bdep THEN 'WOULD_REHANDLE'
                    ELSE 'SLOT_TAKEN' END AS outcome
  FROM {p}claims c
  LEFT JOIN (SELECT {PILE_KEYS}, tier + 1 AS tier, departure_time AS bdep FROM {p}held) b USING ({SLOT_KEYS})
  LEFT JOIN (SELECT {SLOT_KEYS}, id AS hid FROM {p}held) m USING ({SLOT_KEYS})
  UNION ALL
  SELECT id, coalesce(_pre, 'SLOT_TAKEN') FROM {p}pre WHERE _pre IS NOT NULL OR NOT _in_grid),
{p}fixed AS MATERIALIZED (
  SELECT r.yard_id, r.block_id, r.bay, r.row, r.tier, r.id, r.size, r.weight, r.type, r.departure_time
  FROM {records} r JOIN {p}audit a ON a.id = r.id AND a.outcome = 'PLACED')"""


_STANDING = f"{SLOT_KEYS}, id, size, weight, type, departure_time"
UPLOADS = RECURSIVE + ",\n" + ",\n".join(_side(n, c) for n, c in SIDES.items()) + f""",
nobody AS (SELECT {_STANDING} FROM u1 WHERE false),
{reconcile_ctes('u', 'u1', 'nobody')},
utodo AS (SELECT {TODO_COLS} FROM u1 WHERE id NOT IN (SELECT id FROM ufixed)),
{place_ctes('u', 'ufixed', 'utodo')},
ufinal AS MATERIALIZED (
  SELECT {_STANDING}, 'yard' AS status FROM ufixed
  UNION ALL SELECT {_STANDING}, 'expected' FROM uplaced WHERE tier IS NOT NULL),
wnew AS MATERIALIZED (SELECT * FROM w1 WHERE id NOT IN (SELECT id FROM ufinal)),
{reconcile_ctes('w', 'wnew', 'ufinal')},
wyard AS MATERIALIZED (SELECT {_STANDING} FROM ufinal UNION ALL SELECT {_STANDING} FROM wfixed),
wtodo AS (
  SELECT {TODO_COLS} FROM wnew WHERE id NOT IN (SELECT id FROM wfixed)
  UNION ALL SELECT {TODO_COLS} FROM a1
  WHERE id NOT IN (SELECT id FROM ufinal) AND id NOT IN (SELECT id FROM wnew)),
{place_ctes('w', 'wyard', 'wtodo')},
wfinal AS MATERIALIZED (
  SELECT {_STANDING}, 'yard' AS status, {UPLOADED} AS _ingestion_time FROM wfixed
  UNION ALL SELECT {_STANDING}, 'expected', {UPLOADED} FROM wplaced WHERE tier IS NOT NULL),
said AS MATERIALIZED (
  SELECT 0 AS upload, 'snapshot' AS kind, r.id, a.outcome AS audit, coalesce(p.outcome, a.outcome) AS outcome,
         CASE WHEN p.id IS NULL THEN 0 ELSE p.stage END AS stage,
         CASE WHEN p.id IS NULL THEN r.tier ELSE p.tier END AS tier
  FROM u1 r JOIN uaudit a USING (id) LEFT JOIN uplaced p USING (id)
  UNION ALL
  SELECT 1, 'snapshot', r.id, a.outcome, coalesce(p.outcome, a.outcome, 'DUPLICATE'),
         CASE WHEN a.id IS NULL THEN NULL WHEN p.id IS NULL THEN 0 ELSE p.stage END,
         CASE WHEN a.id IS NULL THEN NULL WHEN p.id IS NULL THEN r.tier ELSE p.tier END
  FROM w1 r LEFT JOIN waudit a USING (id) LEFT JOIN wplaced p USING (id)
  UNION ALL
  SELECT 1, 'arrivals', r.id, NULL, coalesce(p.outcome, 'DUPLICATE'), p.stage, p.tier
  FROM a1 r LEFT JOIN (SELECT * FROM wplaced WHERE id NOT IN (SELECT id FROM wnew)) p USING (id))
"""
SQL["upload_outcomes"] = UPLOADS + "SELECT upload, kind, id, audit, outcome, stage, tier FROM said"
SQL["upload_yard"] = UPLOADS + f"""
SELECT {SLOT_KEYS}, id FROM ufinal UNION ALL SELECT {SLOT_KEYS}, id FROM wfinal"""
SQL["upload_yard_batch"] = SQL["upload_yard"]
SQL["upload_store"] = UPLOADS + f"""
SELECT id, size, weight, type, strftime(departure_time, {TS}) AS departure_time, status,
       printf('%s-%03d-%s-%02d', block_id, bay, chr(CAST(row + 64 AS INTEGER)), tier) AS slot
FROM (SELECT {_STANDING}, status FROM ufinal UNION ALL SELECT {_STANDING}, status FROM wfinal)"""
SQL["upload_report"] = UPLOADS + """
SELECT upload, count(*) FILTER (WHERE kind = 'snapshot') AS snapshot_received,
       count(*) FILTER (WHERE outcome = 'PLACED') AS placed_fixed,
       count(*) FILTER (WHERE kind = 'snapshot' AND outcome NOT IN ('PLACED', 'DUPLICATE')) AS rescued,
       count(*) FILTER (WHERE kind = 'snapshot' AND outcome = 'DUPLICATE') AS snapshot_known,
       count(*) FILTER (WHERE kind = 'arrivals') AS arrivals_received,
       count(*) FILTER (WHERE stage > 0) AS placed_by_search,
       count(*) FILTER (WHERE kind = 'arrivals' AND outcome = 'DUPLICATE') AS arrivals_known,
       count(*) FILTER (WHERE outcome = 'UNPLACED') AS unplaced,
       count(*) FILTER (WHERE tier IS NOT NULL) AS total_placed
FROM said GROUP BY upload"""
SQL["upload_document"] = UPLOADS + """,
wrisk AS (
  SELECT *, CASE WHEN lead(departure_time) OVER w IS NOT NULL AND departure_time < lead(departure_time) OVER w
                 THEN 1 ELSE 0 END AS is_rehandle_risk
  FROM wfinal WINDOW w AS (PARTITION BY yard_id, block_id, bay, row ORDER BY tier)),
wlabelled AS (SELECT anomaly_reason FROM w1l UNION ALL SELECT anomaly_reason FROM a1l)
""" + (SQL["kpi_document_flat"].split(PRELUDE, 1)[1].replace("FROM silver", "FROM wfinal")
       .replace("FROM risk", "FROM wrisk").replace("FROM labelled", "FROM wlabelled"))

# --- kept KPI state, line numbers ------------------------------------------------------
# An id that the first upload kept is refused in the second.
_both = ("(SELECT * FROM w1l WHERE anomaly_reason IS NULL UNION ALL SELECT * FROM a1l "
         "WHERE anomaly_reason IS NULL AND id NOT IN (SELECT id FROM w1l WHERE anomaly_reason IS NULL))")
SQL["stream_kpi_state"] = PRELUDE + ",\n" + ",\n".join(_side(n, SIDES[n]) for n in ("w1", "a1")) + " UNION ALL ".join(
    f"""
SELECT {n} AS uploads, type, size, count(*) AS cnt, min(weight) AS min_weight, max(weight) AS max_weight,
       {rhu("avg(weight)", 4)} AS avg_weight, {rhu("stddev_samp(weight)", 4)} AS stddev_weight,
       strftime(min(departure_time), {TS}) AS first_departure, strftime(max(departure_time), {TS}) AS last_departure
FROM {rows} GROUP BY type, size""" for n, rows in (
        (1, "(SELECT * FROM w1l WHERE anomaly_reason IS NULL)"), (2, _both)))
q("bronze_lines", "SELECT count(*) AS records, count(*) AS lines, count(*) AS last_lines, 0 AS late_starts FROM raw")
