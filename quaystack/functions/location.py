"""Slot locations: format, parse and split, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaystack.functions.parse import as_col

# Fixed value: one pattern covers the delimited spellings (``A-001-A-01``,
# ``K-19-A-1``, ``A 001 A 1``) and the compact one (``K019A04``). The block
# part is lazy and the bay part greedy, so digits go to the bay first.
LOCATION_PATTERN = r"^([A-Z0-9]{1,3}?)[- ]*([0-9]{1,3})[- ]*([A-Z])[- ]*([0-9]{1,2})$"


def format_location(block, bay, row, tier) -> Column:
    """``B-BBB-L-TT``: zero-padded bay, row as a letter, zero-padded tier. A
    format string is interpreted for every row, several times as slow as
    padding: it is left to nulls and numbers that are wider than their place."""
    block, bay, row, tier = map(as_col, (block, bay, row, tier))
    letter = F.chr(row + F.lit(64))
    fits = block.isNotNull() & row.isNotNull() & bay.between(0, 999) & tier.between(0, 99)
    padded = lambda c, n: F.lpad(c.cast("int").cast("string"), n, "0")
    return F.when(fits, F.concat_ws("-", block, padded(bay, 3), letter, padded(tier, 2))).otherwise(
        F.format_string("%s-%03d-%s-%02d", block, bay, letter, tier))


def location_parts(loc) -> Column:
    """The four location parts as an array (null when the text does not
    match). One regex rewrite to ``block|bay|row|tier`` and one split, so
    the pattern is evaluated once per row however many fields are used."""
    text = F.upper(F.trim(as_col(loc)))
    return F.when(text.rlike(LOCATION_PATTERN),
                  F.split(F.regexp_replace(text, LOCATION_PATTERN, "$1|$2|$3|$4"), "[|]"))


def parts_to_location(parts, max_height: int) -> Column:
    """Struct(block_id, bay, row, tier) from ``location_parts``; null when
    the tier is outside 1..max_height."""
    parts = as_col(parts)
    tier = F.get(parts, 3).try_cast("int")
    return F.when(tier.between(1, max_height), F.struct(
        F.get(parts, 0).alias("block_id"), F.get(parts, 1).try_cast("int").alias("bay"),
        (F.ascii(F.get(parts, 2)) - F.lit(64)).alias("row"), tier.alias("tier")))


def parse_location(loc, max_height: int) -> Column:
    """Struct(block_id, bay, row, tier) or null when invalid.

    Null when the text does not match, or the tier is outside 1..max_height.
    """
    return parts_to_location(location_parts(loc), max_height)


def split_slot(slot) -> dict[str, Column]:
    """Positional split on ``-`` (the gold KPI's reading of a slot).

    ``get`` returns null past the end of the array instead of throwing.
    """
    parts = F.split(as_col(slot), "-")
    return {
        "n_parts": F.size(parts),
        "b_id": F.get(parts, 0),
        "bay_txt": F.get(parts, 1),
        "row_txt": F.get(parts, 2),
        "tier": F.get(parts, 3).try_cast("int"),
    }


def slot_tier(slot) -> Column:
    """Tier as the last ``-`` part; 0 when the slot is absent or not a number."""
    return F.coalesce(F.element_at(F.split(as_col(slot), "-"), -1).try_cast("int"), F.lit(0))


def slot_block_prefix(slot) -> Column:
    """Text before the first dash (what a naive zone check reads)."""
    return F.get(F.split(as_col(slot), "-"), 0)
