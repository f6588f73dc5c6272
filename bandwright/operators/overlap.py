"""Overlap of score distributions: Irreducible Overlap, KS, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.operators.skew import running_sums

EPS = 1e-9


def class_counts(scores: DataFrame, keys: list[str], score: str = "sim", hit: str = "hit") -> DataFrame:
    """(keys, v, h, m): hits and misses at every distinct score."""
    return scores.groupBy(*keys, F.col(score).alias("v")).agg(F.sum(hit).alias("h"), F.sum(1 - F.col(hit)).alias("m"))


def irreducible_overlap(per: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, io, tau_star, n_hit, n_miss) of ``class_counts``: 1 - the best balanced accuracy over all thresholds, the lowest threshold winning.

    Candidates are every score minus and plus 1e-9. Scores and candidates are counted per value before they are sorted, so
    equal scores are one row; the running counts are over sorted ranges, so a key may hold all scores. Keys without one of the
    classes are left out.
    """
    cuts = per.select(*keys, F.explode(F.array(F.col("v") - EPS, F.col("v") + EPS)).alias("v")).distinct()
    none = F.lit(0).cast("bigint")
    both = per.select(*keys, "v", F.lit(0).alias("o"), "h", "m").unionByName(cuts.select(*keys, "v", F.lit(1).alias("o"), none.alias("h"), none.alias("m")))
    run = running_sums(both, keys, ["v", "o"], ["h", "m"]).filter("o = 1 AND all_h > 0 AND all_m > 0")
    ba = run.withColumn("ba", 0.5 * ((F.col("all_h") - F.col("run_h")) / F.col("all_h") + F.col("run_m") / F.col("all_m")))
    best = F.max_by(F.struct("v", "ba"), F.struct(F.col("ba"), (-F.col("v")).alias("low")))
    return ba.groupBy(*keys, "all_h", "all_m").agg(best.alias("b")).select(*keys, (1 - F.col("b.ba")).alias("io"), F.col("b.v").alias("tau_star"), F.col("all_h").alias("n_hit"), F.col("all_m").alias("n_miss"))


def against_hits(scores: DataFrame, by: str, keys: list[str] | None = None) -> DataFrame:
    """``class_counts`` of each ``by`` value's misses against pooled hits.

    Hits are counted per score before they are repeated for each value, so what is repeated is a histogram, not the rows.
    """
    keys = keys or []
    misses = class_counts(scores.filter("hit = 0"), [*keys, by])
    names = misses.select(*keys, by).distinct()
    hits = class_counts(scores.filter("hit = 1"), keys)
    pooled = hits.join(F.broadcast(names), keys) if keys else hits.crossJoin(F.broadcast(names))  # the values are the taxonomy's
    return misses.unionByName(pooled.select(*misses.columns)).groupBy(*keys, by, "v").agg(F.sum("h").alias("h"), F.sum("m").alias("m"))


def quantiles(per: DataFrame, keys: list[str], value: str, n: str, at: list[float]) -> DataFrame:
    """(keys, q array<double>): exact linear quantiles of the values, each counted ``n`` times; null values don't count.

    Ranks come from running counts over sorted ranges, and of each quantile the two values between which it lies, so no
    task holds a key's values.
    """
    run = running_sums(per.filter(F.col(value).isNotNull()).select(*keys, value, F.col(n).cast("bigint").alias("n")), keys, [value], ["n"])
    pos = lambda q: (F.col("all_n") - 1) * F.lit(float(q))
    is_ = lambda r: F.max(F.when((F.col("run_n") > r) & (F.col("run_n") - F.col("n") <= r), F.col(value)))
    found = run.groupBy(*keys, "all_n").agg(*[is_(f(pos(q))).cast("double").alias(f"{x}{i}") for i, q in enumerate(at) for x, f in (("a", F.floor), ("b", F.ceil))])
    linear = lambda i, q: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (pos(q) - F.floor(pos(q)))
    return found.select(*keys, F.array(*[linear(i, q) for i, q in enumerate(at)]).alias("q"))


def _counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, keys: list[str], value: str = "sim") -> DataFrame:
    """n, mean, population deviation, min, quartiles, p90 and max; exact linear quantiles."""
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(_counted(rows, keys, value), keys, value, "n", [0.25, 0.5, 0.75, 0.9])
    return stats.join(q, keys).select(*keys, "n", "mean", "std", "min", *[F.col("q")[i].alias(x) for i, x in enumerate(("p25", "p50", "p75", "p90"))], "max")


def quantile_grid(rows: DataFrame, keys: list[str], value: str = "sim") -> DataFrame:
    """The 19 quantiles 0.05 to 0.95."""
    q = quantiles(_counted(rows, keys, value), keys, value, "n", [round(0.05 * i, 2) for i in range(1, 20)])
    return q.select(*keys, F.posexplode("q")).select(*keys, F.round((F.col("pos") + 1) * 0.05, 2).alias("p"), F.col("col").alias("value"))


def ecdf(rows: DataFrame, keys: list[str], value: str = "sim") -> DataFrame:
    """(keys, value, n, cdf) at every distinct value."""
    return running_sums(_counted(rows, keys, value), keys, [value], ["n"]).select(*keys, value, "n", (F.col("run_n") / F.col("all_n")).alias("cdf"))


def ks_test(rows: DataFrame, keys: list[str], side: str, value: str = "sim") -> DataFrame:
    """(keys, d, p): the two-sample Kolmogorov-Smirnov statistic of rows where ``side`` is 1 against 0, and the asymptotic p of 100 terms."""
    run = running_sums(class_counts(rows, keys, value, side), keys, ["v"], ["h", "m"]).filter("all_h > 0 AND all_m > 0")
    gap = F.abs(F.col("run_h") / F.col("all_h") - F.col("run_m") / F.col("all_m"))
    d = run.groupBy(*keys, F.col("all_h").alias("na"), F.col("all_m").alias("nb")).agg(F.max(gap).alias("d"))
    n = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    lam = (n + 0.12 + 0.11 / n) * F.col("d")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(F.pmod(j, F.lit(2)) == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * lam * lam * j * j))
    p = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return d.select(*keys, "d", F.when(F.col("d") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("p"))


def histogram(rows: DataFrame, keys: list[str], lo: float, hi: float, bins: int, value: str = "sim") -> DataFrame:
    """(keys, bin, n, density) of fixed bins, the last one closed on the right; values outside don't count."""
    x = F.col(value)
    place = F.when(x == hi, F.lit(bins - 1)).otherwise(F.floor((x - lo) / (hi - lo) * bins)).cast("int")
    per = rows.filter(x.between(lo, hi)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * F.lit((hi - lo) / bins)))


def danger_zone(rows: DataFrame) -> DataFrame:
    """The share of cliff pairs above the first quartile of hits."""
    p25 = quantiles(_counted(rows.filter("hit = 1"), [], "sim"), [], "sim", "n", [0.25]).select(F.col("q")[0].alias("p25"))
    return rows.filter("axis_group = 'cliff'").crossJoin(F.broadcast(p25)).groupBy("p25").agg(F.avg((F.col("sim") > F.col("p25")).cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))


def surface_step(a: Column, b: Column) -> Column:
    """1 - the word Jaccard of two texts."""
    from bandwright.functions.text import jaccard, word_set

    return 1 - jaccard(word_set(a), word_set(b))
