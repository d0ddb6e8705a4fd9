"""Gold layer: KPIs over clean containers.

Every KPI is a DataFrame (tidy rows); the nested KPI document is built from
one pre-aggregate over (type, size, block) so the clean table is scanned
once for the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystack.functions.parse import epoch_seconds, round_half_up
from quaystack.schema import ISO_FORMAT

PILE = ["yard_id", "block_id", "bay", "row"]


def _with_yard(df: DataFrame) -> DataFrame:
    return df if "yard_id" in df.columns else df.withColumn("yard_id", F.lit(0).cast("long"))


def _share(grouped: DataFrame) -> DataFrame:
    """Share of each group in the total. The window runs over the already
    aggregated rows (one per group of a closed domain), not over data."""
    total = F.sum("cnt").over(Window.partitionBy())
    return grouped.withColumn("percentage", round_half_up(F.col("cnt") * 100.0 / total, 1))


def type_distribution(clean: DataFrame) -> DataFrame:
    g = clean.groupBy("type").agg(F.count(F.lit(1)).alias("cnt"),
                                  round_half_up(F.avg("weight"), 2).alias("avg_weight_t"))
    return _share(g).orderBy(F.desc("cnt"), "type")


def size_distribution(clean: DataFrame) -> DataFrame:
    g = clean.groupBy("size").agg(F.count(F.lit(1)).alias("cnt"),
                                  round_half_up(F.avg("weight"), 2).alias("avg_weight_t"))
    return (_share(g).withColumn("size_label", F.concat(F.col("size").cast("string"), F.lit("ft")))
            .orderBy("size"))


def weight_stats(clean: DataFrame) -> DataFrame:
    return clean.agg(
        F.coalesce(round_half_up(F.avg("weight"), 2), F.lit(0.0)).alias("avg_t"),
        F.coalesce(round_half_up(F.min("weight"), 2), F.lit(0.0)).alias("min_t"),
        F.coalesce(round_half_up(F.max("weight"), 2), F.lit(0.0)).alias("max_t"),
        F.coalesce(round_half_up(F.stddev_samp("weight"), 2), F.lit(0.0)).alias("stddev_t"),
    )


def time_window(clean: DataFrame) -> DataFrame:
    return clean.agg(
        F.date_format(F.min("departure_time"), ISO_FORMAT).alias("earliest_departure"),
        F.date_format(F.max("departure_time"), ISO_FORMAT).alias("latest_departure"),
    )


def dwell_days(df: DataFrame) -> DataFrame:
    """Days from ingestion to departure, floored at 0."""
    secs = epoch_seconds("departure_time") - epoch_seconds("_ingestion_time")
    return df.withColumn("dwell_days", F.greatest(F.lit(0.0), secs / F.lit(86400.0)))


def dwell_by_type(clean: DataFrame) -> DataFrame:
    """Mean dwell days per type; ``avg_dwell_compat`` rounds per row first
    (the reference's double rounding), ``avg_dwell_days`` does not."""
    d = dwell_days(clean)
    return d.groupBy("type").agg(
        round_half_up(F.avg("dwell_days"), 6).alias("avg_dwell_days"),
        round_half_up(F.avg(round_half_up(F.col("dwell_days"), 1)), 1).alias("avg_dwell_compat"),
    )


def with_pile(df: DataFrame, max_height: int, slot_col: str | None = "slot") -> DataFrame:
    """Parsed location columns; rows whose slot does not parse get nulls.
    Without a slot text, rows have these columns already; those that no text
    could name get nulls as well."""
    from quaystack.operators.yard import YardSpec, with_location
    if slot_col is None:
        named = (F.col("block_id").rlike("^[A-Z0-9]{1,3}$") & F.col("bay").between(0, 999)
                 & F.col("row").between(1, 26) & F.col("tier").between(1, min(max_height, 99)))
        return _with_yard(df).withColumns({c: F.when(named, F.col(c)) for c in ("block_id", "bay", "row", "tier")})
    spec = YardSpec(max_height=max_height)
    return with_location(_with_yard(df), spec, slot_col)


def rehandle_risk(clean: DataFrame, max_height: int) -> DataFrame:
    """Adjacent-pair risk: the container below leaves before the one above.

    Only rows whose slot fully parses take part (slotless rows do not form
    a pile). Ties on a tier (slot collisions) are ordered by departure then
    id so the result is deterministic.
    """
    # Silver rows may collide on a slot, so a pile is not bounded here: the
    # lead is the chunked, range-partitioned one that splits a hot pile.
    from quaystack.operators.ranking import lead_within
    p = with_pile(clean, max_height).filter(F.col("tier").isNotNull())
    led = lead_within(p, PILE, ["tier", "departure_time", "id"], "departure_time", "next_departure")
    flag = F.col("next_departure").isNotNull() & (F.col("departure_time") < F.col("next_departure"))
    return led.withColumn("is_rehandle_risk", F.when(flag, 1).otherwise(0))


def tier_risks(clean: DataFrame, max_height: int, slot_col: str | None = "slot") -> DataFrame:
    """Per (pile, tier): containers ``n`` and how many of them are at
    ``risk`` as ``rehandle_risk`` flags them, without ordering any rows.

    Inside a tier the rows ascend by departure, so every departure but the
    last has a later one behind it, once, and the last is followed by the
    earliest of the next occupied tier. Counts need only the distinct
    departures, the first and the last of a tier, which are combined in every
    task before the shuffle, and a lead over the tiers of a pile. Rows
    without a full slot are one group of a yard with no risk.
    """
    p = with_pile(clean, max_height, slot_col)
    tier = (p.groupBy(*PILE, "tier", "departure_time").agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*PILE, "tier").agg(
                F.sum("n").alias("n"), F.count("departure_time").alias("days"),
                F.min("departure_time").alias("first"), F.max("departure_time").alias("last")))
    above = F.lead("first").over(Window.partitionBy(*PILE).orderBy("tier"))
    return tier.withColumn("above", above).select(
        *PILE, "tier", "n", F.when(F.col("tier").isNull(), 0).otherwise(
            F.greatest(F.col("days") - 1, F.lit(0))
            + F.coalesce((F.col("last") < F.col("above")).cast("int"), F.lit(0))).alias("risk"))


def stacking_kpi(clean: DataFrame, max_height: int) -> DataFrame:
    """Risk count and efficiency from the tiers' sums."""
    both = tier_risks(clean, max_height).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                                             F.sum("risk").alias("r"))
    r = F.coalesce(F.col("r"), F.lit(0)).cast("long")
    eff = F.when(F.col("n") > 0, round_half_up(
        F.greatest(F.lit(0.0), F.lit(100.0) - r * 100.0 / F.nullif(F.col("n"), F.lit(0))), 1)
        ).otherwise(F.lit(0.0))
    return both.select(r.alias("rehandle_risk_count"), F.col("n").alias("total_containers"),
                       eff.alias("efficiency_score"))


def risk_by_block(clean: DataFrame, max_height: int, slot_col: str | None = "slot") -> DataFrame:
    return (tier_risks(clean, max_height, slot_col).filter(F.col("risk") > 0)
            .groupBy("block_id").agg(F.sum("risk").alias("risk_count")))


def risk_by_yard(clean: DataFrame, max_height: int, blocks: list[str]) -> DataFrame:
    """Risk counts of the named blocks side by side, a row per yard with any."""
    p = (tier_risks(clean, max_height).filter(F.col("risk") > 0)
         .groupBy("yard_id").pivot("block_id", blocks).agg(F.sum("risk")))
    return p.select("yard_id", *[F.coalesce(F.col(b), F.lit(0)).cast("long").alias(f"risk_{b.lower()}")
                                 for b in blocks])


def type_size_summary(clean: DataFrame) -> DataFrame:
    return clean.groupBy("type", "size").agg(
        F.count(F.lit(1)).alias("count"),
        round_half_up(F.avg("weight"), 2).alias("avg_weight_t"),
        round_half_up(F.min("weight"), 2).alias("min_weight_t"),
        round_half_up(F.max("weight"), 2).alias("max_weight_t"),
    )


def write_summary(clean: DataFrame, path: str) -> None:
    type_size_summary(clean).coalesce(1).write.mode("overwrite").parquet(path)


def kpi_document(clean: DataFrame, report: DataFrame, max_height: int,
                 storage_mode: str = "parquet", slot_col: str | None = "slot") -> DataFrame:
    """The nested KPI document as one row.

    Data is reduced to per-(type, size) partial sums and per-block risk
    counts; every map in the document is built from these tiny frames, so
    ``collect_list`` only ever sees a bounded number of groups.
    """
    part = dwell_days(clean).groupBy("type", "size").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("sw"),
        F.avg("weight").alias("mu"), F.var_pop("weight").alias("vp"),
        F.min("weight").alias("mn"), F.max("weight").alias("mx"),
        F.min("departure_time").alias("d0"), F.max("departure_time").alias("d1"),
        F.sum("dwell_days").alias("sd"))
    # At most types x sizes and blocks rows; stored once so the summaries
    # below do not each re-run the scan.
    from quaystack.session import materialise
    part = materialise(part, "kpi-part")
    by_type = part.groupBy("type").agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"),
                                       F.sum("sd").alias("sd"))
    by_size = part.groupBy("size").agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"))
    by_block = materialise(risk_by_block(clean, max_height, slot_col).withColumnRenamed("risk_count", "rk"),
                           "kpi-risk")
    risks = by_block.agg(F.coalesce(F.sum("rk"), F.lit(0)).alias("rk"))
    # Merged variance: squares within the groups plus those of the group means
    # around the overall mean, over the few rows of ``part``.
    mean = F.sum("sw").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    squares = F.col("n") * (F.col("vp") + (F.col("mu") - F.col("mean")) * (F.col("mu") - F.col("mean")))
    total = part.withColumn("mean", mean).agg(
                     F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("sw").alias("sw"),
                     F.sum(squares).alias("squares"),
                     F.min("mn").alias("mn"), F.max("mx").alias("mx"),
                     F.min("d0").alias("d0"), F.max("d1").alias("d1"))

    def dist(g: DataFrame, key) -> DataFrame:
        return g.agg(F.map_from_entries(F.collect_list(F.struct(
            key, F.struct(F.col("n").alias("count"), F.col("sw").alias("sum_w"))))).alias("m"))

    tmap = by_type.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("type"), F.struct(
            F.col("n").alias("count"), F.col("sw").alias("sum_w"))))).alias("tm"),
        F.map_from_entries(F.collect_list(F.struct(
            F.col("type"), round_half_up(F.col("sd") / F.col("n"), 1)))).alias("dwell"))
    smap = dist(by_size, F.concat(F.col("size").cast("string"), F.lit("ft"))).withColumnRenamed("m", "sm")
    bmap = by_block.agg(F.map_from_entries(F.collect_list(
        F.struct("block_id", "rk"))).alias("bm"))
    doc = one_row(total, risks, tmap, smap, bmap, report)
    n = F.col("n")

    def shares(m: str):
        return F.transform_values(F.col(m), lambda k, v: F.struct(
            v["count"].alias("count"),
            round_half_up(v["count"] * 100.0 / n, 1).alias("percentage"),
            round_half_up(v["sum_w"] / v["count"], 2).alias("avg_weight_t")))

    var = F.when(n > 1, F.col("squares") / F.nullif(n - 1, F.lit(0)))
    rk = F.coalesce(F.col("rk"), F.lit(0))
    efficiency = F.when(n > 0, round_half_up(F.greatest(
        F.lit(0.0), F.lit(100.0) - rk * 100.0 / F.nullif(n, F.lit(0))), 1)).otherwise(F.lit(0.0))
    weight = lambda c: F.coalesce(round_half_up(c, 2), F.lit(0.0))
    return doc.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("computed_at"),
        F.when(n > 0, "SUCCESS").otherwise("EMPTY").alias("status"),
        n.alias("total_containers"),
        F.lit(storage_mode).alias("storage_mode"),
        shares("tm").alias("type_distribution"),
        shares("sm").alias("size_distribution"),
        F.struct(weight(F.col("sw") / F.nullif(n, F.lit(0))).alias("avg_t"),
                 weight(F.col("mn")).alias("min_t"), weight(F.col("mx")).alias("max_t"),
                 weight(F.sqrt(var)).alias("stddev_t")).alias("weight_stats"),
        F.struct(F.date_format("d0", ISO_FORMAT).alias("earliest_departure"),
                 F.date_format("d1", ISO_FORMAT).alias("latest_departure")).alias("time_window"),
        F.struct(F.col("total_raw").alias("total_raw_ingested"),
                 F.col("total_cleaned").alias("total_after_silver"),
                 F.col("duplicates_removed"),
                 (F.col("invalid_nulls_removed") + F.col("invalid_domain_removed")).alias("invalid_removed"),
                 F.col("quality_score").alias("quality_score_pct")).alias("pipeline_quality"),
        F.col("dwell").alias("dwell_analytics"),
        F.struct(rk.alias("rehandle_risk_count"),
                 efficiency.alias("efficiency_score"),
                 F.coalesce(F.col("bm"), F.create_map().cast("map<string,bigint>"))
                 .alias("details_per_block")).alias("advanced_analytics"),
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates into one row without a join: union by
    name (missing columns null) and keep each column's non-null value."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def write_kpi_document(doc: DataFrame, path: str) -> None:
    """JSON document sink (one small file: the document is one row)."""
    doc.coalesce(1).write.mode("append").json(path)


def flat_document(doc: DataFrame) -> DataFrame:
    """The document's values as rows: section, key, metric, value (text for
    times and the status, numbers as doubles)."""
    number = lambda c: c.cast("double")
    none = F.lit(None)

    def row(section, key, metric, value=none, text=none):
        return F.struct(F.lit(section).alias("section"), key.alias("key"), F.lit(metric).alias("metric"),
                        number(value).alias("value"), text.cast("string").alias("text"))

    def entries(column: str, make):
        return F.flatten(F.transform(F.map_entries(column), make))

    dist = lambda section: lambda e: F.array(*[
        row(section, e["key"], m, e["value"][m]) for m in ("count", "percentage", "avg_weight_t")])
    fields = [row("document", F.lit(""), "status", text=F.col("status")),
              row("document", F.lit(""), "total_containers", F.col("total_containers"))]
    for section, texts in (("weight_stats", False), ("time_window", True), ("pipeline_quality", False)):
        for f in doc.schema[section].dataType.names:
            c = F.col(f"{section}.{f}")
            fields.append(row(section, F.lit(""), f, text=c) if texts else row(section, F.lit(""), f, c))
    for f in ("rehandle_risk_count", "efficiency_score"):
        fields.append(row("advanced_analytics", F.lit(""), f, F.col(f"advanced_analytics.{f}")))
    return doc.select(F.inline(F.concat(
        F.array(*fields),
        entries("type_distribution", dist("type_distribution")),
        entries("size_distribution", dist("size_distribution")),
        entries("dwell_analytics", lambda e: F.array(row("dwell_analytics", e["key"], "days", e["value"]))),
        entries("advanced_analytics.details_per_block",
                lambda e: F.array(row("details_per_block", e["key"], "risk", e["value"]))))))


def latest_kpis(spark, path: str, epoch: str | None = None) -> DataFrame:
    """Newest document by ``computed_at`` (not by file name); after a reset
    only documents computed since its ``epoch`` count."""
    docs = spark.read.json(path)
    if epoch:
        docs = docs.filter(F.to_timestamp("computed_at") >= F.lit(epoch).cast("timestamp"))
    return docs.agg(F.max_by(F.struct(*docs.columns), F.col("computed_at")).alias("d")).select("d.*")
