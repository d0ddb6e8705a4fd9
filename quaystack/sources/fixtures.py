"""Raw container records derived from the driver's ``lineitem`` and ``orders``.

The derivation (FIXTURES.md section 2) is written once as SQL expression
text, in the dialect subset that both Spark SQL and the DuckDB oracle
accept, so the two engines start from identical raw text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The derivation rules of the test tables.
_BLOCK = ("CASE (l_suppkey + CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END) % 6 "
          "WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'B' WHEN 3 THEN 'D' "
          "WHEN 4 THEN 'S1' ELSE 'S2' END")
_BAY, _ROW, _TIER = "l_partkey % 24 + 1", "l_orderkey % 6 + 1", "l_linenumber"
_PADDED = {"bay": f"lpad(CAST({_BAY} AS STRING), 3, '0')", "row": f"chr(CAST(64 + {_ROW} AS INT))",
           "tier": f"lpad(CAST({_TIER} AS STRING), 2, '0')"}
# Spellings of a location, by l_suppkey % 5: dashed, compact, spaced, lower
# case, not padded. A location of two parts is none.
_SLOT = f"""CASE WHEN l_orderkey % 11 = 0 THEN NULL
  WHEN l_orderkey % 13 = 0 THEN concat({_BLOCK}, '-', {_PADDED['bay']})
  WHEN l_suppkey % 5 = 1 THEN concat({_BLOCK}, {_PADDED['bay']}, {_PADDED['row']}, {_PADDED['tier']})
  WHEN l_suppkey % 5 = 2 THEN concat({_BLOCK}, ' ', {_PADDED['bay']}, ' ', {_PADDED['row']}, ' ', {_PADDED['tier']})
  WHEN l_suppkey % 5 = 3 THEN lower(concat({_BLOCK}, '-', {_PADDED['bay']}, '-', {_PADDED['row']}, '-', {_PADDED['tier']}))
  WHEN l_suppkey % 5 = 4 THEN concat({_BLOCK}, '-', CAST({_BAY} AS STRING), '-', {_PADDED['row']}, '-', CAST({_TIER} AS STRING))
  ELSE concat({_BLOCK}, '-', {_PADDED['bay']}, '-', {_PADDED['row']}, '-', {_PADDED['tier']}) END"""
_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
_TYPE = ("CASE WHEN l_returnflag = 'A' THEN 'import' WHEN l_returnflag = 'N' THEN 'export' "
         "ELSE 'transshipment' END")
_FEET = "CASE WHEN l_suppkey % 2 = 0 THEN '20' ELSE '40' END"

RAW_EXPRESSIONS: dict[str, str] = {
    "id": "concat('C', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
    "size": (f"CASE WHEN l_partkey % 50 = 0 THEN '45' WHEN l_partkey % 103 = 0 THEN 'x' "
             f"WHEN l_partkey % 31 = 0 THEN concat({_FEET}, '.0') ELSE {_FEET} END"),
    "weight": ("CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 101 = 0 THEN 'abc' "
               "WHEN l_partkey % 41 = 0 THEN CAST(CAST(l_quantity AS BIGINT) + 30 AS STRING) "
               "WHEN l_partkey % 43 = 0 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), '.5') "
               "ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END"),
    "departure_time": (f"CASE WHEN l_partkey % 107 = 0 THEN 'soon' "
                       f"WHEN l_partkey % 7 = 1 THEN concat({_DAY}, ' 00:00:00') "
                       f"WHEN l_partkey % 7 = 2 THEN concat({_DAY}, 'T18:15:00') "
                       f"WHEN l_partkey % 7 = 3 THEN concat({_DAY}, 'T06:30:00.000000') "
                       f"WHEN l_partkey % 7 = 4 THEN concat(CAST(month(l_shipdate) AS STRING), '/', "
                       f"CAST(day(l_shipdate) AS STRING), '/', CAST(year(l_shipdate) AS STRING), ' 9:05') "
                       f"ELSE {_DAY} END"),
    "type": (f"CASE WHEN l_partkey % 61 = 0 THEN NULL WHEN l_partkey % 53 = 0 THEN 'empty' "
             f"WHEN l_partkey % 19 = 0 THEN concat('  ', upper({_TYPE}), ' ') "
             f"WHEN l_partkey % 23 = 0 THEN concat(upper(substr({_TYPE}, 1, 1)), substr({_TYPE}, 2)) "
             f"ELSE {_TYPE} END"),
    "slot": _SLOT,
    "_ingestion_time": "CAST(o_orderdate AS TIMESTAMP)",
    # Yards grow with the orders: 938 orders each, 16 yards at 15,000 orders.
    "yard_id": "CAST(floor(l_orderkey / 938.0) AS BIGINT)",
    # Rows of one id may fall into both batches, as they differ in the part.
    "batch": ("CASE WHEN l_orderkey % 11 = 0 THEN 'arrivals' "
              "WHEN l_partkey % 17 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'arrivals' ELSE 'snapshot' END "
              "WHEN l_orderkey % 2 = 0 THEN 'snapshot' ELSE 'arrivals' END"),
    "store_version": ("CASE WHEN l_orderkey % 3 = 0 THEN 2 "
                      "WHEN l_orderkey % 3 = 1 THEN 1 ELSE 0 END"),
    "_o_price": "l_extendedprice",
    "_o_supp": "l_suppkey",
    "_o_part": "l_partkey",
}
# What the slot text means, for the oracle alone: it never parses the text.
_NAMED = "l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0"
TRUTH_EXPRESSIONS: dict[str, str] = {
    "_t_block": f"CASE WHEN {_NAMED} THEN {_BLOCK} END",
    "_t_bay": f"CASE WHEN {_NAMED} THEN CAST({_BAY} AS INT) END",
    "_t_row": f"CASE WHEN {_NAMED} THEN CAST({_ROW} AS INT) END",
    "_t_tier": f"CASE WHEN {_NAMED} THEN CAST({_TIER} AS INT) END",
}
# Dedup order of the fixture (after the parsed departure_time).
FIXTURE_ORDER = ["departure_time", "_o_price", "_o_supp", "_o_part", "weight"]
EXTRA_COLUMNS = ["yard_id", "batch", "store_version", "_o_price", "_o_supp", "_o_part"]

_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_returnflag", "l_shipdate"]


def raw_select_sql() -> str:
    """The derivation as one SELECT over the driver tables (oracle side)."""
    both = RAW_EXPRESSIONS | TRUTH_EXPRESSIONS
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in both.items())
    return (f"SELECT\n  {cols}\nFROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Rows of one file that a row's number has room for, as a power of two.
_ROW_BITS = 40


def positions(rows: DataFrame, file: str, index: str, name: str) -> DataFrame:
    """Replace a row's file and index in it by one number that orders rows
    alike: by file, then index. A path in every row would be a third of it
    in shuffles and sorts. Of several files each gets its place in the order
    of their paths."""
    if len(rows.inputFiles()) < 2:
        return rows.withColumn(name, F.col(index)).drop(file, index)
    place = F.row_number().over(Window.orderBy(file)).cast("long")
    places = rows.select(file).distinct().select(file, place.alias("_place"))
    number = F.shiftleft("_place", _ROW_BITS) + F.col(index)
    return rows.join(F.broadcast(places), file).withColumn(name, number).drop(file, index, "_place")


def arrivals_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records (all-text business columns) plus derivation extras.

    ``_rk`` is the lineitem row position (file, row index) as a number: a
    unique, deterministic tie-breaker for the dedup order.
    """
    li = positions(spark.read.parquet(table_path(sf_dir, "lineitem"))
                   .select(*_LINEITEM_COLS, F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.row_index").alias("_index")), "_file", "_index", "_rk")
    od = spark.read.parquet(table_path(sf_dir, "orders")).select("o_orderkey", "o_orderdate")
    joined = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return joined.selectExpr(*[f"{expr} AS {name}" for name, expr in RAW_EXPRESSIONS.items()], "_rk")
