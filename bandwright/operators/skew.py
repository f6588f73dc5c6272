"""Joins and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.session import cut, fresh

#: A key is heavy if it has at least 1 / HEAVY of all rows, so there are at most HEAVY heavy keys.
HEAVY = 1000


def lookup_join(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """``left`` joined with ``right``, unique on ``on``; ``right.weight`` is the number of left rows with that key.

    Rows of heavy keys meet a broadcast side of at most ``heavy`` rows, as the weights add up to ``total`` at most; the
    others meet in a shuffle in which no key has more than ``total / heavy`` rows. ``weight`` is not in the result.
    Null keys match nothing. ``left`` is read twice; give a written table or a scan.
    """
    big = right.filter(F.col(weight) * heavy >= total).drop(weight)
    small = right.filter(F.col(weight) * heavy < total).drop(weight)
    hot = left.join(F.broadcast(big), on, "inner")
    rest = left.join(F.broadcast(big.select(on)), on, "left_anti").join(small, on, how)
    return hot.unionByName(rest)


def prefix_sums(df: DataFrame, group: list[str], order: Column, value: Column, out: str, buckets: int = 1024) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the group that stand before the row.

    ``order`` is a bigint spread evenly over its range (a hash) and unique within the group. Two levels keep any group
    out of one task: sums per (group, bucket of the order), offsets from the at most ``buckets`` sums of each group, and
    a running sum within the bucket. The join and the running sum share one
    partitioning. ``buckets`` is a power of two.
    """
    o, b, v, off = (fresh(df, c) for c in ("__order", "__bucket", "__value", "__offset"))
    keyed = df.withColumn(o, order).withColumn(v, F.coalesce(value.cast("bigint"), F.lit(0)))
    top = F.shiftright(F.col(o), 64 - (buckets.bit_length() - 1))
    keyed = keyed.withColumn(b, F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], top.alias("b")))
    sums = keyed.groupBy(b).agg(F.sum(v).alias(off))
    w = Window.partitionBy(*[F.col(f"{b}.g{i}") for i in range(len(group))]).orderBy(f"{b}.b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(b, F.coalesce(F.sum(off).over(w), F.lit(0)).alias(off))
    inner = Window.partitionBy(b).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.join(sums, b).withColumn(out, F.col(off) + F.coalesce(F.sum(v).over(inner), F.lit(0)))
    return summed.drop(o, b, v, off)


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with run_x, the sum of x over the rows of the keys up to and including the row, and all_x, over all of them; ``order`` is total within the keys.

    Sorted ranges of (keys, order) take the place of a window per key, so one key may hold all rows: sums per range, offsets from
    the few ranges of a key, and a running sum within the range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = fresh(df, "__range")
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn(at, F.spark_partition_id()))
    ranged = ranged.withColumn(at, F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(keys)], F.col(at).alias("r")))
    per = ranged.groupBy(at).agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    group = Window.partitionBy(*[F.col(f"{at}.g{i}") for i in range(len(keys))])  # no more rows than ranges
    before = group.orderBy(f"{at}.r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(at, *[F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"__{x}") for x in sums], *[F.sum(f"__{x}").over(group).alias(f"all_{x}") for x in sums])
    inner = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(per, at)
    return out.select(*df.columns, *[(F.col(f"__{x}") + F.sum(x).over(inner)).alias(f"run_{x}") for x in sums], *[f"all_{x}" for x in sums])


def one_row_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with one row per key, the smallest value of a repeated one.

    Keys are counted without their values; only rows of repeated keys, if there are any, are shuffled.
    """
    again = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("w")).filter("w > 1"))
    total = again.agg(F.sum("w")).first()[0] or 0
    if not total:
        return rows.select(key, value)
    many = lookup_join(rows.select(key, value), again, key, "w", total).groupBy(key).agg(F.min(value).alias(value))
    return rows.select(key, value).join(again.select(key), key, "left_anti").unionByName(many)


def heavy_keys(df: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """The keys with at least 1 / ``heavy`` of all rows, and their ``n``: at most ``heavy`` rows."""
    counts = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * heavy >= total)
