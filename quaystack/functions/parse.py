"""Typed parsing of raw text columns; every cast is a non-throwing try-cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaystack.schema import DEPARTURE_FORMATS


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """Text to double; ``null`` for anything unparsable (``abc`` -> null)."""
    return as_col(c).try_cast("double")


def to_size(c) -> Column:
    """Text to integer feet; accepts ``20`` and ``20.0``; ``x`` -> null."""
    return as_col(c).try_cast("double").try_cast("int")


def normalise_type(c) -> Column:
    return F.lower(F.trim(as_col(c)))


def parse_departure(c) -> Column:
    """First format that parses wins: ISO default, then the fixed list. A
    failed attempt raises inside Spark, which is slow, so a format is tried
    only on text that holds its separator (``T`` in either case)."""
    c = as_col(c)
    separators = ["T", "/", " ", "-"]

    def attempt(fmt: str) -> Column:
        mark = next(s for s in separators if s in fmt)
        return F.when(F.upper(c).contains(mark), F.try_to_timestamp(c, F.lit(fmt)))

    return F.coalesce(F.try_to_timestamp(c), *[attempt(f) for f in DEPARTURE_FORMATS])


def round_half_up(c, digits: int) -> Column:
    """Round half up the same way in Spark and in the SQL oracle.

    ``round`` on doubles differs between engines on values such as 1.005,
    so KPIs that are compared use floor(x * 10^d + 0.5) / 10^d.
    """
    scale = float(10 ** digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def epoch_seconds(c) -> Column:
    """Seconds since the epoch for a timestamp (session zone is UTC)."""
    return F.unix_timestamp(as_col(c).cast("timestamp"))


def size_or_default(c, default: int = 20) -> Column:
    """Size coercion of the placement job: int(float(x)), default 20."""
    return F.coalesce(as_col(c).try_cast("double").try_cast("int"), F.lit(default))
