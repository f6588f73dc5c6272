"""Reproducible draws: hash orders in place of a generator, equal on every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(*parts: Column) -> Column:
    """15 hex digits of the md5 of the parts joined by ':'; sorting by it is a random permutation."""
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15)


def order_number(*parts: Column) -> Column:
    """The same order as a bigint spread evenly over its whole range."""
    return (F.conv(order_key(*parts), 16, 10).cast("bigint") - F.lit(1 << 59)) * 16


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the md5 (exact in binary)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def digit(*parts: Column) -> Column:
    """0..15 from the first hex digit of the md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 1), 16, 10).cast("int")
