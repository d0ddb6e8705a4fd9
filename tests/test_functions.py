"""Golden micro-frames for the column functions (FIXTURES.md section 3)."""

from datetime import datetime

from pyspark.sql import functions as F

from quaystack.functions import location
from quaystack.functions.parse import normalise_type, parse_departure, round_half_up, to_double, to_size
from quaystack.schema import DEPARTURE_FORMATS


def _one_col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_departure_formats(spark):
    got = _one_col(spark, ["2026-03-05T06:00:00.123456", "2026-03-05T08:00:00", "3/7/2026 6:05",
                           "2026-03-08 10:00:00", "2026-03-06", "notadate"], parse_departure)
    assert got[:5] == [datetime(2026, 3, 5, 6, 0, 0, 123456), datetime(2026, 3, 5, 8, 0),
                       datetime(2026, 3, 7, 6, 5), datetime(2026, 3, 8, 10, 0), datetime(2026, 3, 6)]
    assert got[5] is None


def test_numbers(spark):
    assert _one_col(spark, ["12.5", "1e1", "abc"], to_double) == [12.5, 10.0, None]
    assert _one_col(spark, ["20", "20.0", "x"], to_size) == [20, 20, None]


def test_type_text(spark):
    assert _one_col(spark, ["Import ", "EXPORT", "foo", None], normalise_type) == ["import", "export", "foo", None]


def test_location_parse(spark):
    cases = {"A-001-A-01": ("A", 1, 1, 1), "K019A04": ("K", 19, 1, 4), "S1-002-B-05": ("S1", 2, 2, 5),
             "K-19-A-1": ("K", 19, 1, 1), "A 001 A 1": ("A", 1, 1, 1), "B-1": None, None: None,
             "A-001-A-00": None}
    got = _one_col(spark, list(cases), lambda c: location.parse_location(c, 7))
    for (text, want), row in zip(cases.items(), got):
        assert (None if row is None else tuple(row)) == want, text


def test_format_parse_roundtrip(spark):
    df = spark.createDataFrame([("S2", 17, 6, 5), ("A", 1, 1, 1), ("C", 240, 3, 7)],
                               "b string, bay int, row int, tier int")
    txt = df.select(location.format_location("b", "bay", "row", "tier").alias("t"), "b", "bay", "row", "tier")
    back = txt.select(location.parse_location("t", 7).alias("p"), "b", "bay", "row", "tier").collect()
    assert [r["t"] for r in txt.collect()] == ["S2-017-F-05", "A-001-A-01", "C-240-C-07"]
    for r in back:
        assert tuple(r["p"]) == (r["b"], r["bay"], r["row"], r["tier"])


def test_round_half_up(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (76.25,)], "x double")
    assert [r[0] for r in df.select(round_half_up("x", 1)).collect()] == [1.0, 2.5, 76.3]


def test_departure_formats_are_tried_only_on_text_with_their_separator(spark):
    """Any case of T, and texts with several separators, parse as before."""
    texts = ["2026-03-05t08:00:00", "12/31/2026 23:59", "2026-03-08 1:00:00", "2026-3-6", "x/y", "T", "-", " ", "", None]
    old = lambda c: F.coalesce(F.try_to_timestamp(c), *[
        F.try_to_timestamp(c, F.lit(f)) for f in DEPARTURE_FORMATS])
    assert _one_col(spark, texts, parse_departure) == _one_col(spark, texts, old)
    plan = spark.range(1).select(parse_departure(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("contains(") == len(DEPARTURE_FORMATS)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
