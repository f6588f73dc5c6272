"""The N highest-scoring rows of every group.

A histogram of scores per group, combined before the shuffle, gives each group the highest bin at or above which at least
N rows stand; no row of the N best can be below it. Rows below are filtered, the others ranked exactly by score and tie
keys. Groups with at least 1 / HEAVY of all rows (at most HEAVY of them) get their threshold from a broadcast, the others
in a shuffle by group; the rank keeps N rows of a group per task before its shuffle, so neither a huge group nor a
million ties in the threshold's bin meet in one task.

Cases: null and NaN scores rank last, after every number; a null in a group column is a value like any other; rows equal
in score and all tie keys are kept in any order, N rows in all; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.operators.skew import HEAVY
from bandwright.session import cut, fresh


def latest(rows: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """(key, value of the row with the greatest ts); rows without a key or a ts don't count."""
    return rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key).agg(F.max_by(value, ts).alias(value))


def thresholds(rows: DataFrame, group: str, bin_: str, n: int) -> DataFrame:
    """(group, low, total) of the groups with more than n rows: low is the bin below which none of the n best can be."""
    hist = rows.groupBy(group, bin_).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(F.desc(bin_)).rowsBetween(Window.unboundedPreceding, 0)
    reached = hist.withColumn("above", F.sum("c").over(w))
    return reached.groupBy(group).agg(F.max(F.when(F.col("above") >= n, F.col(bin_))).alias("low"), F.sum("c").alias("total")).filter(F.col("total") > n)


def top_n(rows: DataFrame, groups: list[str], score: str, ties: list[str], n: int, lo: float | None = None, hi: float | None = None, bins: int = 256) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``; ties go to the smaller ``ties``.

    ``lo`` and ``hi`` are the range the bins divide, found in a pass over the scores if not given; scores outside fall
    into the end bins, so any range gives the same result.
    """
    g, s, b, r = (fresh(rows, c) for c in ("__group", "__score", "__bin", "__rank"))
    plain = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    if lo is None or hi is None:
        lo, hi = rows.agg(F.min(plain), F.max(plain)).first()
        lo, hi = lo if lo is not None else 0.0, hi if hi is not None else 1.0
    span = hi - lo if hi > lo else 1.0
    in_range = F.least(F.greatest(F.col(s), F.lit(float(lo))), F.lit(float(hi)))
    place = F.when(F.col(s).isNull(), F.lit(-1)).otherwise(F.floor((in_range - F.lit(float(lo))) / F.lit(float(span)) * (bins - 1)).cast("int"))
    binned = cut(rows.withColumn(g, F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)])).withColumn(s, plain).withColumn(b, place))
    low = cut(thresholds(binned, g, b, n))
    total = low.agg(F.sum("total")).first()[0] or 0
    low = low.select(F.col(g), F.col("low").alias(fresh(binned, "__low")), F.col("total").alias(fresh(binned, "__total")))
    _, lowest, count = low.columns
    heavy = low.filter(F.col(count) * HEAVY >= total).drop(count)
    light = low.filter(F.col(count) * HEAVY < total).drop(count)
    hot = binned.join(F.broadcast(heavy), g).filter(F.col(b) >= F.col(lowest))
    rest = binned.join(F.broadcast(heavy.select(g)), g, "left_anti").join(light, g, "left").filter(F.col(lowest).isNull() | (F.col(b) >= F.col(lowest)))
    w = Window.partitionBy(g).orderBy(F.col(s).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties])
    best = [x.withColumn(r, F.row_number().over(w)).filter(F.col(r) <= n) for x in (hot, rest)]
    return best[0].unionByName(best[1]).select(*[F.col(f"`{c}`") for c in rows.columns])
