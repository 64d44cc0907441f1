"""Argument handling shared by the Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(v) -> Column:
    """A name becomes a column, a number becomes a literal."""
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(v)


def pow2(z) -> Column:
    """2^z as a bigint."""
    return F.pow(F.lit(2.0), col(z)).cast("bigint")


def as_utc(ts) -> Column:
    """Instant of a timestamp without zone that was written in UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col(ts)).cast("timestamp")
