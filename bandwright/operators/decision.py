"""Threshold decisions: balanced accuracy, rates, utility, verification configurations, held-out metrics.

Scores are compared with a grid of thresholds by counting scores between neighbouring thresholds once (a histogram over
the grid) and summing the counts, so a sweep costs one pass however long the grid is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.functions.taxonomy import HALF_BAND, TAUS
from bandwright.operators.overlap import quantiles
from bandwright.session import cut

RHOS = sorted({round(10 ** (3 * i / 24)) for i in range(25)})


def grid_counts(rows: DataFrame, keys: list[str], weights: dict[str, Column], taus: list[float] = TAUS, score: str = "sim") -> DataFrame:
    """(keys, tau, above_x, all_x): of each weight, the sum over rows with score > tau and over all rows."""
    grid = F.array(*[F.lit(t) for t in taus])
    place = F.size(F.filter(grid, lambda t: F.col(score) > t))  # thresholds the score is above
    per = rows.groupBy(*keys, place.alias("__k")).agg(*[F.sum(w).alias(x) for x, w in weights.items()])
    wide = per.groupBy(*keys).agg(*[F.sum(x).alias(f"all_{x}") for x in weights], F.collect_list(F.struct("__k", *weights)).alias("__cells"))
    each = wide.select(*keys, *[f"all_{x}" for x in weights], "__cells", F.posexplode(grid).alias("__i", "tau"))
    above = lambda x: F.aggregate(F.filter("__cells", lambda c: c["__k"] > F.col("__i")), F.lit(0).cast("bigint"), lambda s, c: s + c[x])
    return each.select(*keys, "tau", *[above(x).alias(f"above_{x}") for x in weights], *[f"all_{x}" for x in weights])


def _classes() -> dict[str, Column]:
    return {"hit": F.col("hit").cast("bigint"), "miss": (1 - F.col("hit")).cast("bigint")}


def _with_ba(counts: DataFrame) -> DataFrame:
    """Counts with ``ba``; null where a class is empty."""
    return counts.withColumn("ba", 0.5 * (F.try_divide("above_hit", "all_hit") + F.try_divide(F.col("all_miss") - F.col("above_miss"), "all_miss")))


def _best(ba: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max_by(F.struct("tau", "ba"), F.struct(F.coalesce("ba", F.lit(-1.0)).alias("ba"), (-F.col("tau")).alias("low")))
    return ba.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.tau", "b.ba")


def balanced_accuracy(rows: DataFrame, keys: list[str], taus: list[float] = TAUS, score: str = "sim") -> DataFrame:
    return _with_ba(grid_counts(rows, keys, _classes(), taus, score)).select(*keys, "tau", "ba")


def best_tau(rows: DataFrame, keys: list[str], taus: list[float] = TAUS, score: str = "sim") -> DataFrame:
    """(keys, tau, ba): the best threshold of the grid, ties to the lowest."""
    return _best(balanced_accuracy(rows, keys, taus, score), keys)


def sweep(rows: DataFrame, keys: list[str], taus: list[float] = TAUS) -> DataFrame:
    """(keys, tau, false_hit, false_miss, false_hit_slope, false_hit_cliff): rates, 0 where a class is empty."""
    group = lambda g: F.when((F.col("axis_group") == g) & (F.col("hit") == 0), 1).otherwise(0).cast("bigint")
    c = grid_counts(rows, keys, _classes() | {"slope": group("slope"), "cliff": group("cliff")}, taus)
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(
        *keys, "tau", rate("above_miss", "all_miss").alias("false_hit"), rate(F.col("all_hit") - F.col("above_hit"), F.col("all_hit")).alias("false_miss"),
        rate("above_slope", "all_slope").alias("false_hit_slope"), rate("above_cliff", "all_cliff").alias("false_hit_cliff"),
    )


def utility(rows: DataFrame, keys: list[str], taus: list[float] = TAUS, rhos: list[int] | None = None) -> DataFrame:
    """(keys, rho, tau, utility): per cost ratio the threshold with the greatest expected utility, ties to the lowest."""
    c = grid_counts(rows, keys, _classes(), taus)
    n = F.col("all_hit") + F.col("all_miss")
    u = (F.col("above_hit") - F.col("rho") * F.col("above_miss") - (F.col("all_hit") - F.col("above_hit"))) / n
    each = c.withColumn("rho", F.explode(F.array(*[F.lit(r) for r in rhos or RHOS]))).withColumn("utility", u)
    best = F.max_by(F.struct("tau", "utility"), F.struct("utility", (-F.col("tau")).alias("low")))
    return each.groupBy(*keys, "rho").agg(best.alias("b")).select(*keys, "rho", "b.tau", "b.utility")


def nearest_rho(table: DataFrame, wanted: list[float], keys: list[str]) -> DataFrame:
    """(keys, wanted, rho, tau): the row whose rho is nearest to each wanted one, ties to the smaller rho."""
    each = table.withColumn("wanted", F.explode(F.array(*[F.lit(float(x)) for x in wanted])))
    best = F.min_by(F.struct("rho", "tau"), F.struct(F.abs(F.col("rho") - F.col("wanted")).alias("d"), F.col("rho").alias("r")))
    return each.groupBy(*keys, "wanted").agg(best.alias("b")).select(*keys, "wanted", "b.rho", "b.tau")


def _others(table: DataFrame, k: int) -> DataFrame:
    """Rows of ``table`` (fold) once for each other fold, as its tuning set ``tune``."""
    return table.withColumn("tune", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))))


def fold_parameters(rows: DataFrame, k: int = 5) -> DataFrame:
    """(fold, tau, t_ce, domain_taus) tuned on the other folds.

    Grid counts are taken per fold in one pass, and a fold's tuning counts are the sum of the others', so no row is copied
    for tau; of the rows, only those in a band of another fold go on. t_ce is the best of the 19 quantiles of the cross score among the tuning rows in the band.
    """
    sums = ["above_hit", "above_miss", "all_hit", "all_miss"]

    def tuned(keys: list[str]) -> DataFrame:
        counts = _others(grid_counts(rows, ["fold", *keys], _classes()), k)
        return _best(_with_ba(counts.groupBy("tune", *keys, "tau").agg(*[F.sum(c).alias(c) for c in sums])), ["tune", *keys])

    tau = tuned([]).select("tune", "tau")
    per = tuned(["domain"]).filter("domain IS NOT NULL").groupBy("tune").agg(F.map_from_entries(F.collect_list(F.struct("domain", "tau"))).alias("domain_taus"))
    tau = cut(tau)
    band = {r.tune: r.tau for r in tau.collect()}  # one row per fold
    tunes = F.array_compact(F.array(*[F.when((F.col("fold") != f) & F.col("sim").between(F.lit(t) - F.lit(HALF_BAND), F.lit(t) + F.lit(HALF_BAND)), F.lit(f)) for f, t in sorted(band.items())])) if band else F.array().cast("array<int>")
    per_score = rows.select(F.explode(tunes).alias("tune"), "ce", "hit").groupBy("tune", "ce").agg(F.sum("hit").alias("h"), F.sum(1 - F.col("hit")).alias("m"))
    per_score = cut(per_score.withColumn("n", F.col("h") + F.col("m")))
    grid = [round(0.05 * i, 2) for i in range(1, 20)]
    cands = quantiles(per_score, ["tune"], "ce", "n", grid).select("tune", F.explode("q").alias("t")).distinct()
    each = per_score.join(F.broadcast(cands), "tune").groupBy("tune", "t")  # 19 candidates a fold
    above = lambda c: F.sum(F.when(F.col("ce") > F.col("t"), F.col(c)).otherwise(0))
    ce = each.agg(above("h").alias("above_hit"), above("m").alias("above_miss"), F.sum("h").alias("all_hit"), F.sum("m").alias("all_miss"))
    ce = _best(_with_ba(ce.withColumnRenamed("t", "tau")), ["tune"]).select("tune", F.col("tau").alias("t_ce"))
    return tau.join(ce, "tune", "left").join(per, "tune", "left").withColumnRenamed("tune", "fold")


def configurations(rows: DataFrame, parameters: DataFrame, half: float = HALF_BAND) -> DataFrame:
    """``rows`` (fold, domain, sim, ce, llm, slots) with the decision of each configuration.

    A serves above tau; B asks the cross scorer within the band; C the verifier (undecided: not served); C_fallback the
    verifier, undecided by tau; D above tau with equal slots; adaptive above the domain's tau. Outside the band B and C serve above it.
    """
    t, s = F.col("tau"), F.col("sim")
    lo, hi = t - F.lit(half), t + F.lit(half)
    band = s.between(lo, hi)
    joined = rows.join(F.broadcast(parameters), "fold")  # one row per fold
    return joined.select(
        *rows.columns, "tau", band.alias("in_band"), (s > t).alias("A"), F.when(band, F.col("ce") > F.col("t_ce")).otherwise(s > hi).alias("B"),
        F.when(band, F.col("llm") == 1).otherwise(s > hi).alias("C"), F.when(band & (F.col("llm") >= 0), F.col("llm") == 1).when(band, s > t).otherwise(s > hi).alias("C_fallback"),
        ((s > t) & F.col("slots")).alias("D"), (s > F.coalesce(F.try_element_at("domain_taus", F.coalesce("domain", F.lit(""))), t)).alias("adaptive"),
    )


def decided(pairs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (id) with the verifier's ``decision`` of those that have one, and one row: joined and total decisions."""
    rows = pairs.join(decisions.select(F.col("pair_id").alias("id"), "decision"), "id")
    known = decisions.select(F.col("pair_id").alias("id")).join(pairs.select("id", F.lit(1).alias("__there")), "id", "left")
    return rows, known.agg(F.count("__there").alias("joined"), F.count(F.lit(1)).alias("total"))


CONFIGS = ("A", "B", "C", "C_fallback", "D", "adaptive")


def long_form(predicted: DataFrame, configs: tuple[str, ...] = CONFIGS) -> DataFrame:
    """One row per pair and configuration: (config, served)."""
    each = F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("served")) for c in configs])
    rest = [c for c in predicted.columns if c not in configs]
    return predicted.withColumn("__e", F.explode(each)).select(*rest, "__e.config", "__e.served")


#: The 14 counts of a seed, as SQL.
COUNTS = {
    "n": "1", "misses": "1 - hit", "hits": "hit", "false_hits": "int(served) * (1 - hit)", "false_misses": "int(NOT served) * hit", "served_n": "int(served)",
    "slope": "int(axis_group = 'slope')", "false_slope": "int(served AND axis_group = 'slope')", "cliff": "int(axis_group = 'cliff')",
    "false_cliff": "int(served AND axis_group = 'cliff')", "band_misses": "int(in_band) * (1 - hit)", "band_false_hits": "int(in_band AND served) * (1 - hit)",
    "band_hits": "int(in_band) * hit", "band_false_misses": "int(in_band AND NOT served) * hit",
}
#: The nine ratios of the counts: numerator and denominator.
RATIOS = {
    "false_hit": ("false_hits", "misses"), "false_miss": ("false_misses", "hits"), "serve_rate": ("served_n", "n"), "hit_rate_on_hits": ("hits - false_misses", "hits"),
    "false_hit_slope": ("false_slope", "slope"), "false_hit_cliff": ("false_cliff", "cliff"), "band_false_hit": ("band_false_hits", "band_misses"),
    "band_false_miss": ("band_false_misses", "band_hits"), "served_wrong_share": ("false_hits", "served_n"),
}


def seed_counts(predicted: DataFrame, configs: tuple[str, ...] = CONFIGS) -> DataFrame:
    """(config, seed_id, 14 counts): all that the metrics and the bootstrap need of a seed."""
    return long_form(predicted, configs).groupBy("config", "seed_id").agg(*[F.sum(F.expr(x)).alias(c) for c, x in COUNTS.items()])


def ratios(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The nine ratios of the counts' totals; NaN where a denominator is 0."""
    t = counts.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in COUNTS])
    return t.select(*keys, *[F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(float("nan"))).alias(x) for x, (a, b) in RATIOS.items()])


def residual(predicted: DataFrame, config: str = "C") -> DataFrame:
    """(axis_group, false_hits, outside, share): where a configuration's false hits lie: in the band or above it."""
    rows = predicted.filter(F.col(config) & (F.col("hit") == 0))
    return rows.groupBy("axis_group").agg(F.count(F.lit(1)).alias("false_hits"), F.count_if(~F.col("in_band")).alias("outside")).withColumn("share", F.col("outside") / F.col("false_hits"))


def band_oracle(predicted: DataFrame) -> DataFrame:
    """(axis_group, fh_threshold, fh_oracle, reduction, in_band): false hits if every in-band decision were right; in_band is the share of A's false hits there."""
    above = ~F.col("in_band") & (F.col("sim") > F.col("tau") + F.lit(HALF_BAND))
    rate = lambda c: F.avg(c.cast("int"))
    out = predicted.filter("hit = 0").groupBy("axis_group").agg(
        rate(F.col("A")).alias("fh_threshold"), rate(above).alias("fh_oracle"), F.try_divide(F.count_if(F.col("A") & F.col("in_band")), F.count_if("A")).alias("in_band")
    )
    return out.withColumn("reduction", F.try_divide(F.col("fh_threshold") - F.col("fh_oracle"), "fh_threshold"))


def reduction(counts: DataFrame, base: str = "A") -> DataFrame:
    """(config, slope, cliff, gap): relative reduction of false hits against ``base`` per group, and cliff less slope."""
    t = counts.groupBy("config").agg(*[F.sum(c).alias(c) for c in ("slope", "cliff", "false_slope", "false_cliff")])
    rate = lambda g: F.try_divide(f"false_{g}", g)
    r = t.select("config", rate("slope").alias("s"), rate("cliff").alias("c"))
    b = r.filter(F.col("config") == base).select(F.col("s").alias("bs"), F.col("c").alias("bc"))
    out = r.filter(F.col("config") != base).crossJoin(F.broadcast(b))  # one row
    out = out.select("config", F.try_divide(F.col("bs") - F.col("s"), "bs").alias("slope"), F.try_divide(F.col("bc") - F.col("c"), "bc").alias("cliff"))
    return out.withColumn("gap", F.col("cliff") - F.col("slope"))


def split_half(rows: DataFrame) -> DataFrame:
    """(tau, n, false_hit, false_miss): the threshold tuned on even rows, scored on odd ones; ``parity`` is 0 or 1."""
    tuned = best_tau(rows.filter("parity = 0"), []).select("tau")
    scored = rows.filter("parity = 1").crossJoin(F.broadcast(tuned))  # one row
    return scored.groupBy("tau").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("hit") == 0, (F.col("sim") > F.col("tau")).cast("int"))), F.lit(0.0)).alias("false_hit"),
        F.coalesce(F.avg(F.when(F.col("hit") == 1, (F.col("sim") <= F.col("tau")).cast("int"))), F.lit(0.0)).alias("false_miss"),
    )


def logistic(rows: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """``rows`` with ``p``: out-of-fold probability of a hit, L2 with C = 1 (regParam 1 / n, unstandardised). One fold is tuned on itself."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="__x").transform(rows)
    out = None
    for f in range(k):
        tune = data.filter(F.col("fold") != f) if k > 1 else data
        n, classes = tune.agg(F.count(F.lit(1)), F.countDistinct("hit")).first()
        test = data.filter(F.col("fold") == f)
        if classes == 2:
            model = LogisticRegression(featuresCol="__x", labelCol="hit", regParam=1 / n, elasticNetParam=0.0, standardization=False, probabilityCol="__p", predictionCol="__y", rawPredictionCol="__w").fit(tune)
            test = model.transform(test).withColumn("p", vector_to_array("__p")[1]).drop("__p", "__y", "__w")
        else:
            test = test.withColumn("p", F.lit(None).cast("double"))
        out = test if out is None else out.unionByName(test)
    return out.drop("__x") if out is not None else rows.withColumn("p", F.lit(None).cast("double"))


