"""Dense 1..n ranks inside groups that may be arbitrarily large.

``row_number().over(partitionBy(g))`` sorts each group inside one task, so
one group holding a third of all rows means one task sorting a third of the
data. Here rows are range-partitioned on (group, order) instead, so a big
group spans many partitions; each partition numbers its rows locally and a
small per-(partition, group) count table supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystack.session import materialise


def _by_range(df: DataFrame, keys: list, num_partitions: int | None) -> DataFrame:
    """Range partitions, as many as the session's shuffles have: left to
    adaptive execution, small inputs fall into one task that does all."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys)


def _by_chunk(rows: DataFrame, chunks: DataFrame, group_cols: list[str]) -> DataFrame:
    """Rows with the values of their (partition, group); a null group is one."""
    named = chunks.withColumnsRenamed({c: f"_g_{c}" for c in ["_pid", *group_cols]})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols]
    return rows.join(named, [F.col("_pid") == F.col("_g__pid"), *same], "inner").drop(
        "_g__pid", *[f"_g_{c}" for c in group_cols])


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Rank 1..n per group in ``order_cols`` order (must be a total order).

    The tagged frame is written once to the shared ``spark.checkpoint.dir``
    so partition ids and row positions are fixed once, even if a later stage
    is recomputed after an executor loss.
    """
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = (_by_range(df, keys, num_partitions).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id())
              )
    tagged = materialise(tagged, "ranked")
    counts = tagged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"),
                                                    F.min("_pos").alias("_p0"))
    # The count table has one row per (partition, group) pair: a group only
    # spans consecutive partitions, so this is ~#groups + #partitions rows.
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = _by_chunk(tagged, counts.select("_pid", *group_cols, "_off", "_p0"), group_cols)
    return (out.withColumn(name, (F.col("_pos") - F.col("_p0") + 1 + F.col("_off")).cast("long"))
            .drop("_pid", "_pos", "_p0", "_off"))


def lead_within(df: DataFrame, group_cols: list[str], order_cols: list, value: str,
                name: str, num_partitions: int | None = None) -> DataFrame:
    """``lead(value)`` over (group ordered by order_cols) for groups of any size.

    Rows are range-partitioned on (group, order), so one huge group becomes
    several contiguous chunks. Inside a chunk the lead is a window over
    (partition id, group), bounded by the chunk size; the last row of a
    chunk takes the first value of the group's next chunk from a small
    per-(partition, group) boundary table.
    """
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = materialise(_by_range(df, keys, num_partitions).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_pos", F.monotonically_increasing_id()), "lead")
    chunk = Window.partitionBy("_pid", *group_cols).orderBy("_pos")
    inner = tagged.withColumn("_in", F.lead(value).over(chunk))
    bounds = (tagged.groupBy("_pid", *group_cols)
              .agg(F.min_by(value, "_pos").alias("_first"), F.max("_pos").alias("_last")))
    nxt = Window.partitionBy(*group_cols).orderBy("_pid")
    bounds = bounds.withColumn("_next_first", F.lead("_first").over(nxt)).select(
        "_pid", *group_cols, "_last", "_next_first")
    j = _by_chunk(inner, bounds, group_cols)
    out = F.when(F.col("_pos") == F.col("_last"), F.col("_next_first")).otherwise(F.col("_in"))
    return j.withColumn(name, out).drop("_pid", "_pos", "_in", "_last", "_next_first")
