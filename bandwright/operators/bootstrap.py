"""Cluster bootstrap: whole clusters are drawn with replacement, from counts taken once per cluster.

How often a cluster is in a replicate is drawn where its counts are: a Poisson number of mean 1 from the md5 of "q:cluster",
where q is a quarter of the replicate's number. That is what drawing as many clusters as there are comes to, and needs no
numbering and no join. Only sums per replicate leave the tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chances of less than k + 1 draws, as far as a 32-bit number can tell.
POISSON = [p for k in range(12) if (p := sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) * 2**32 <= 2**32 - 1]
#: The same as eight hex digits, which compare as text.
LIMITS = [f"{math.ceil(p * 2**32):08x}" for p in POISSON]
#: Replicates that share a digest: each has eight of its hex digits.
SHARED = 4


def replicates(clusters: DataFrame, key: str, counts: list[str], reps: int, keys: list[str] | None = None) -> DataFrame:
    """(rep, keys, sums of counts) of ``reps`` resamples of the clusters; a cluster has a row per value of the keys."""
    keys = keys or []
    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = clusters.repartition(n, key)  # few bytes, but many replicates of each: not to be put in one task for their size
    rows = spread.groupBy(key).agg(F.collect_list(F.struct(*keys, *counts)).alias("__rows"))
    each = rows.withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // SHARED))))
    each = each.withColumn("__h", F.explode(F.array(F.md5(F.concat_ws(":", F.col("__q").cast("string"), F.col(key))))))  # a generator's output is computed once, whatever is asked of it
    drawn = F.array(*[F.struct((F.col("__q") * SHARED + i).alias("rep"), F.substring("__h", 8 * i + 1, 8).alias("u")) for i in range(SHARED)])
    each = each.select("__rows", F.inline(drawn)).filter(F.col("rep") < reps)
    weighed = each.withColumn("__w", sum((F.col("u") >= x).cast("int") for x in LIMITS)).filter("__w > 0")
    long = weighed.select("rep", "__w", F.inline("__rows"))
    return long.groupBy("rep", *keys).agg(*[F.sum(F.col(c) * F.col("__w")).alias(c) for c in counts])


def percentile_interval(rows: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys, lo, hi): linear percentiles of the finite values."""
    a = (1 - level) / 2
    finite = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    q = finite.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return q.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def order_interval(rows: DataFrame, keys: list[str], value: str, reps: int) -> DataFrame:
    """(keys, lo, hi): the order statistics int(.025 B) and int(.975 B) - 1, from 0."""
    w = Window.partitionBy(*keys).orderBy(value)
    placed = rows.withColumn("__r", F.row_number().over(w) - 1)
    at = lambda i: F.max(F.when(F.col("__r") == i, F.col(value)))
    return placed.groupBy(*keys).agg(at(int(0.025 * reps)).alias("lo"), at(int(0.975 * reps) - 1).alias("hi"))


