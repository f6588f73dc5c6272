"""Rank statistics over a small table of (encoder, block, value): Friedman, Nemenyi, cliques, Kendall."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.functions.stats import chi2_tail, normal_tail, studentised_range_tail
from bandwright.operators.windows import mid_ranks

# Fixed value: the Nemenyi critical value for nine treatments at 0.05.
Q_CRITICAL = 3.102


def mean_ranks(table: DataFrame) -> DataFrame:
    """(encoder, mean_rank): mid-ranks by ascending value within each block, averaged."""
    return mid_ranks(table, ["block"], "value").groupBy("encoder").agg(F.avg("mid_rank").alias("mean_rank"))


def friedman(table: DataFrame) -> DataFrame:
    """One row: encoders, blocks, chi2 (corrected for ties) and p."""
    ranked = mid_ranks(table, ["block"], "value")
    ties = table.groupBy("block", "value").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    size = table.agg(F.countDistinct("encoder").cast("double").alias("k"), F.countDistinct("block").cast("double").alias("n"))
    sums = ranked.groupBy("encoder").agg(F.sum("mid_rank").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("ss"))
    k, n = F.col("k"), F.col("n")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    fixed = F.try_divide(raw, 1 - F.col("ties") / (n * (k * k * k - k)))
    row = size.crossJoin(ties).crossJoin(sums).select(k.cast("int").alias("encoders"), n.cast("int").alias("blocks"), fixed.alias("chi2"))  # one row each
    tail = F.udf(lambda x, m: None if x is None else chi2_tail(x, m - 1), "double")  # one row
    return row.withColumn("p", tail("chi2", "encoders"))


def critical_difference(k: int, n: int) -> float:
    return Q_CRITICAL * math.sqrt(k * (k + 1) / (6 * n))


def nemenyi(table: DataFrame) -> DataFrame:
    """(a, b, gap, p) of each two encoders."""
    ranks = mean_ranks(table)
    k, n = table.agg(F.countDistinct("encoder"), F.countDistinct("block")).first()
    b = ranks.select(F.col("encoder").alias("b"), F.col("mean_rank").alias("rb"))
    gaps = ranks.select(F.col("encoder").alias("a"), F.col("mean_rank").alias("ra")).join(b, F.col("a") < F.col("b"))
    scale = math.sqrt(k * (k + 1) / (6 * max(n, 1)))
    tail = F.udf(lambda g: studentised_range_tail(g / scale * math.sqrt(2), k), "double")  # a row per two encoders
    return gaps.select("a", "b", F.abs(F.col("ra") - F.col("rb")).alias("gap")).withColumn("p", tail("gap"))


def cliques(ranks: DataFrame, difference: float) -> DataFrame:
    """(first, last, size): maximal runs of encoders, by mean rank, whose ends are less than ``difference`` apart; runs of one are none."""
    w = Window.orderBy("mean_rank", "encoder")  # a row per encoder
    pos = ranks.withColumn("pos", F.row_number().over(w))
    b = pos.select(F.col("encoder").alias("last"), F.col("mean_rank").alias("rb"), F.col("pos").alias("end"))
    runs = pos.join(b, (F.col("end") >= F.col("pos")) & (F.col("rb") - F.col("mean_rank") < difference)).groupBy("encoder", "pos").agg(F.max(F.struct("end", "last")).alias("m"))
    longest = runs.withColumn("before", F.max("m.end").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    kept = longest.filter((F.col("m.end") > F.col("pos")) & (F.col("before").isNull() | (F.col("m.end") > F.col("before"))))
    return kept.select(F.col("encoder").alias("first"), F.col("m.last").alias("last"), (F.col("m.end") - F.col("pos") + 1).alias("size"))


def kendall(table: DataFrame, by: str, item: str, value: str) -> DataFrame:
    """(a, b, n, tau, p): tau-b between each two groups' values of the same items; p by the normal approximation."""
    x = table.select(F.col(by).alias("a"), F.col(item).alias("i"), F.col(value).alias("x"))
    both = x.join(table.select(F.col(by).alias("b"), F.col(item).alias("i"), F.col(value).alias("y")), "i").filter("a < b")
    other = both.select("a", "b", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    two = both.join(other, ["a", "b"]).filter("i < j").select("a", "b", F.signum(F.col("x") - F.col("x2")).alias("sx"), F.signum(F.col("y") - F.col("y2")).alias("sy"))
    t = two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"))
    n = (1 + F.sqrt(1 + 8.0 * F.col("m"))) / 2
    tail = F.udf(lambda s, n: None if s is None else normal_tail(s / math.sqrt(n * (n - 1) * (2 * n + 5) / 18) if n > 1 else 0.0), "double")  # a row per two groups
    return t.select("a", "b", n.cast("int").alias("n"), F.try_divide("s", F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"), tail("s", n).alias("p"))
