"""Threshold, verification and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.draws import digit
from bandwright.functions.taxonomy import TAUS, domain_of
from bandwright.functions.text import acronym_slots, jaccard, length_gap, number_slots, slots_equal, word_set
from bandwright.operators import bootstrap, decision
from bandwright.operators.windows import folds, number_rows
from bandwright.plans.base import PAIRS, SCORED, kept, pairs, r6, scored, with_
from bandwright.session import cut

FOLDS = 5
#: Replicates of the cluster bootstraps.
REPS = 2000
FEATURES = ["sim", "ce", "gap", "same_numbers", "same_acronyms"]


def verified(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with what the configurations need: fold, cross score ``ce`` (word Jaccard stands in for a model), verifier decision ``llm`` and slot equality.

    The verifier's decisions are a fixture: the label, flipped where the id's hash digit is 0, absent (-1) where it is 1.
    """

    def make():
        p = pairs(spark, d)
        q, v = F.coalesce("seed_question", F.lit("")), F.coalesce("variation", F.lit(""))
        h = digit(F.lit("verify"), F.col("id"))
        llm = F.when(h == 1, -1).when(h == 0, 1 - F.col("hit")).otherwise(F.col("hit"))
        same = lambda f: (f(q) == f(v)).cast("double")
        features = p.select(
            "id", jaccard(word_set(q), word_set(v)).alias("ce"), length_gap(q, v).alias("gap"), same(number_slots).alias("same_numbers"),
            same(acronym_slots).alias("same_acronyms"), slots_equal(q, v).alias("slots"), llm.alias("llm"),
        )
        seeds = folds(p.select("seed_id").distinct().withColumn("stratum", domain_of(F.col("seed_id"))), "stratum", "seed_id", FOLDS)
        return scored(spark, d).join(features, "id").join(seeds.select("seed_id", "fold"), "seed_id")

    return kept(spark, d, "verified", make)


def predicted(spark: SparkSession, d: str) -> DataFrame:
    def make():
        rows = verified(spark, d)
        return decision.configurations(rows, cut(decision.fold_parameters(rows, FOLDS)))

    return kept(spark, d, "predicted", make)


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return decision.sweep(scored(spark, d), []).select("tau", *r6("false_hit", "false_miss", "false_hit_slope", "false_hit_cliff"))


def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return decision.balanced_accuracy(scored(spark, d), ["lang"]).select("lang", "tau", *r6("ba"))


def best_tau(spark: SparkSession, d: str) -> DataFrame:
    return decision.best_tau(scored(spark, d), []).select("tau", *r6("ba"))


def domain_tau(spark: SparkSession, d: str) -> DataFrame:
    return decision.best_tau(scored(spark, d).filter("domain IS NOT NULL"), ["domain"]).select("domain", "tau", *r6("ba"))


def utility_tau_star(spark: SparkSession, d: str) -> DataFrame:
    return decision.utility(scored(spark, d).filter("domain IS NOT NULL"), ["domain"]).select("domain", "rho", "tau", *r6("utility"))


def nearest_rho(spark: SparkSession, d: str) -> DataFrame:
    table = decision.utility(scored(spark, d).filter("domain IS NOT NULL"), ["domain"])
    return decision.nearest_rho(table, [2.0, 12.0, 90.0, 700.0], ["domain"])


def slot_guard(spark: SparkSession, d: str) -> DataFrame:
    return verified(spark, d).groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.count_if("slots").alias("equal"))


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    return verified(spark, d).select("id", *r6("sim", "ce", "gap"), "same_numbers", "same_acronyms")


def seed_folds(spark: SparkSession, d: str) -> DataFrame:
    return verified(spark, d).select("seed_id", "fold").distinct()


def fold_parameters(spark: SparkSession, d: str) -> DataFrame:
    p = decision.fold_parameters(verified(spark, d), FOLDS)
    return p.select("fold", "tau", *r6("t_ce"), F.explode("domain_taus").alias("domain", "domain_tau"))


def config_predictions(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).select("id", "in_band", *decision.CONFIGS)


def config_metrics(spark: SparkSession, d: str) -> DataFrame:
    return decision.ratios(decision.seed_counts(predicted(spark, d)), ["config"]).select("config", *r6(*decision.RATIOS))


def tuned_on_all(spark: SparkSession, d: str) -> DataFrame:
    """One row: the parameters tuned on all pairs, as one pseudo-fold 0."""

    def make():
        return decision.fold_parameters(verified(spark, d).withColumn("fold", F.lit(1)), 2).filter("fold = 0")  # of fold 0, the others are all rows

    return kept(spark, d, "tuned_on_all", make)


def in_sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same configurations, and the learned one (E), tuned and scored on all pairs: one pseudo-fold, tuned on itself."""
    rows = verified(spark, d)
    tuned = tuned_on_all(spark, d)
    one = rows.withColumn("fold", F.lit(0))
    p = _learned(decision.configurations(one, tuned), 1)
    return decision.ratios(decision.seed_counts(p, (*decision.CONFIGS, "E")), ["config"]).select("config", *r6(*decision.RATIOS))


def in_sample_configs(spark: SparkSession, d: str) -> DataFrame:
    """in_sample_metrics without the learned configuration, which SQL can't fit."""
    p = decision.configurations(verified(spark, d).withColumn("fold", F.lit(0)), tuned_on_all(spark, d))
    return decision.ratios(decision.seed_counts(p), ["config"]).select("config", *r6(*decision.RATIOS))


def _learned(predicted: DataFrame, k: int) -> DataFrame:
    """``predicted`` with the decision E: served where the logistic regression says so."""
    return decision.logistic(predicted, FEATURES, k).withColumn("E", F.coalesce(F.col("p") > 0.5, F.lit(False)))


def learned_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of config_metrics for the learned configuration E, out of fold."""
    p = _learned(predicted(spark, d), FOLDS)
    return decision.ratios(decision.seed_counts(p, ("E",)), ["config"]).select("config", *r6(*decision.RATIOS))


def seed_counts(spark: SparkSession, d: str) -> DataFrame:
    return decision.seed_counts(predicted(spark, d))


def c4_reduction(spark: SparkSession, d: str) -> DataFrame:
    return decision.reduction(decision.seed_counts(predicted(spark, d))).select("config", *r6("slope", "cliff", "gap"))


def c_residual(spark: SparkSession, d: str) -> DataFrame:
    return decision.residual(predicted(spark, d)).select("axis_group", "false_hits", "outside", *r6("share"))


def band_oracle(spark: SparkSession, d: str) -> DataFrame:
    return decision.band_oracle(predicted(spark, d)).select("axis_group", *r6("fh_threshold", "fh_oracle", "in_band", "reduction"))


def verifier_in_band(spark: SparkSession, d: str) -> DataFrame:
    """The verifier's own false hits and misses among decided in-band pairs, per group; null where a group is empty."""
    rows = predicted(spark, d).filter("in_band AND llm >= 0")
    wrong = lambda y: F.avg(F.when(F.col("hit") == y, (F.col("llm") != y).cast("int")))
    return rows.groupBy("axis_group").agg(F.count(F.lit(1)).alias("n"), F.round(wrong(0), 6).alias("false_hit"), F.round(wrong(1), 6).alias("false_miss"))


def split_half(spark: SparkSession, d: str) -> DataFrame:
    rows = number_rows(scored(spark, d), [F.col("id")], "n").withColumn("parity", F.pmod("n", F.lit(2)))
    return decision.split_half(rows.drop("n")).select("tau", "n", *r6("false_hit", "false_miss"))


def _replicates(spark: SparkSession, d: str, n: int) -> DataFrame:
    return bootstrap.replicates(cut(decision.seed_counts(predicted(spark, d))), "seed_id", list(decision.COUNTS), n, ["config"])


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    reps = decision.ratios(_replicates(spark, d, REPS), ["rep", "config"])
    metrics = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in decision.RATIOS]))
    long = reps.select("config", metrics.alias("m")).select("config", "m.metric", "m.value")
    return bootstrap.percentile_interval(long, ["config", "metric"], "value").select("config", "metric", *r6("lo", "hi"))


def c4_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Share of replicates in which the cliff reduction exceeds the slope reduction, and the gap's interval."""
    reps = cut(_replicates(spark, d, REPS))
    rate = lambda g: F.try_divide(f"false_{g}", g)
    r = reps.select("rep", "config", rate("slope").alias("s"), rate("cliff").alias("c"))
    base = r.filter("config = 'A'").select("rep", F.col("s").alias("bs"), F.col("c").alias("bc"))
    red = r.filter("config <> 'A'").join(base, "rep").withColumn("gap", F.try_divide(F.col("bc") - F.col("c"), "bc") - F.try_divide(F.col("bs") - F.col("s"), "bs"))
    ci = bootstrap.percentile_interval(red, ["config"], "gap")
    return red.groupBy("config").agg(F.round(F.avg((F.col("gap") > 0).cast("int")), 6).alias("positive")).join(ci, "config", "left").select("config", "positive", *r6("lo", "hi"))


def all_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The nine ratios of all seven configurations, E decided out of fold, with their bootstrap intervals."""
    configs = (*decision.CONFIGS, "E")
    counts = cut(decision.seed_counts(_learned(predicted(spark, d), FOLDS), configs))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in decision.RATIOS])).alias("m")
    values = decision.ratios(counts, ["config"]).select("config", each).select("config", "m.metric", "m.value")
    reps = decision.ratios(bootstrap.replicates(counts, "seed_id", list(decision.COUNTS), REPS, ["config"]), ["rep", "config"])
    limits = bootstrap.percentile_interval(reps.select("config", each).select("config", "m.metric", "m.value"), ["config", "metric"], "value")
    return values.join(limits, ["config", "metric"], "left").select("config", "metric", *r6("value", "lo", "hi"))


def all_reductions(spark: SparkSession, d: str) -> DataFrame:
    """c4_reduction with the learned configuration."""
    counts = decision.seed_counts(_learned(predicted(spark, d), FOLDS), (*decision.CONFIGS, "E"))
    return decision.reduction(counts).select("config", *r6("slope", "cliff", "gap"))


def logistic_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = decision.logistic(verified(spark, d), FEATURES, FOLDS)
    served = (F.col("p") > 0.5).cast("int")
    return rows.groupBy("axis_group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(served), 4).alias("served"))


def logistic_balance(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on all pairs, the probabilities add up to the hits, as the intercept isn't penalised."""
    rows = decision.logistic(verified(spark, d).withColumn("fold", F.lit(0)), FEATURES, 1)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("bigint").alias("hits"), F.round(F.sum("p"), 0).cast("bigint").alias("expected"))


QUERIES = {
    f.__name__: f
    for f in (
        threshold_sweep, balanced_accuracy, best_tau, domain_tau, utility_tau_star, nearest_rho, slot_guard, pair_features, seed_folds, fold_parameters,
        config_predictions, config_metrics, in_sample_metrics, in_sample_configs, seed_counts, c4_reduction, c_residual, band_oracle, verifier_in_band, split_half,
        cluster_bootstrap, c4_bootstrap, logistic_pairs, logistic_balance, learned_metrics, all_metrics, all_reductions,
    )
}

_GRID = "grid AS (SELECT unnest([" + ", ".join(f"{t!r}e0" for t in TAUS) + "]) AS tau)"
_RHO = "rhos AS (SELECT unnest([" + ", ".join(map(str, decision.RHOS)) + "]) AS rho)"
_DOM = "CASE " + " ".join(f"WHEN starts_with(seed_id, '{k}_') THEN '{n}'" for k, n in (("d1", "a"), ("d2", "b"), ("d3", "c"), ("d4", "d"), ("d5", "e"))) + " END"


def _ba(rows: str, keys: str = "", tau: str = "g.tau", score: str = "sim") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}{tau} AS tau, 0.5 * (avg(CASE WHEN hit = 1 THEN CAST({score} > {tau} AS INT) END) + avg(CASE WHEN hit = 0 THEN CAST({score} <= {tau} AS INT) END)) AS ba
FROM {rows} GROUP BY {k}{tau}"""


def _first(ba: str, keys: str = "") -> str:
    p = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER ({p}ORDER BY coalesce(ba, -1) DESC, tau) AS r FROM ({ba})) WHERE r = 1"


_BLANK = r"[\s\p{Z}]+"
_W = lambda c: f"list_distinct(list_filter(string_split_regex(lower(coalesce({c}, '')), '{_BLANK}'), lambda w: w <> ''))"
_NUM = lambda c: rf"list_sort(list_distinct(regexp_extract_all(coalesce({c}, ''), '\d+(?:[.,/]\d+)*')))"
_ACR = lambda c: rf"list_sort(list_distinct(list_filter(string_split_regex(coalesce({c}, ''), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'), lambda w: regexp_full_match(w, '[A-ZĐ]{{2,}}'))))"
VERIFIED = f"""{SCORED},
ws AS (SELECT id, {_W("seed_question")} AS a, {_W("variation")} AS b, {_NUM("seed_question")} AS na, {_NUM("variation")} AS nb, {_ACR("seed_question")} AS ca, {_ACR("variation")} AS cb,
  length(coalesce(seed_question, '')) AS la, length(coalesce(variation, '')) AS lb, substring(md5('verify:' || id), 1, 1) AS h FROM pairs),
fold AS (SELECT seed_id, CAST((row_number() OVER (PARTITION BY {_DOM} ORDER BY substring(md5('fold:' || seed_id), 1, 15)) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT seed_id FROM pairs)),
verified AS (SELECT s.*, f.fold, len(list_intersect(a, b)) / CAST(greatest(1, len(list_distinct(list_concat(a, b)))) AS DOUBLE) AS ce,
  CASE WHEN greatest(la, lb) = 0 THEN 0.0 ELSE abs(la - lb) / CAST(greatest(la, lb) AS DOUBLE) END AS gap, CAST(na = nb AS INT) AS same_numbers, CAST(ca = cb AS INT) AS same_acronyms,
  na = nb AND ca = cb AS slots, CASE h WHEN '1' THEN -1 WHEN '0' THEN 1 - hit ELSE hit END AS llm FROM scored s JOIN ws ON s.id = ws.id JOIN fold f ON s.seed_id = f.seed_id)"""
_FS = "(SELECT unnest(range(0, 5)) AS fold)"
PARAMS = f"""{VERIFIED}, {_GRID},
tuned AS (SELECT k.fold AS tune, v.domain, v.sim, v.ce, v.hit FROM verified v JOIN {_FS} k ON v.fold <> k.fold),
tau AS ({_first(_ba("tuned, grid g", "tune"), "tune")}),
dtau AS ({_first(_ba("(SELECT * FROM tuned WHERE domain IS NOT NULL), grid g", "tune, domain"), "tune, domain")}),
band AS (SELECT b.tune, ce, hit FROM tuned b JOIN tau t ON b.tune = t.tune WHERE sim BETWEEN t.tau - 0.06e0 AND t.tau + 0.06e0),
cand AS (SELECT DISTINCT tune AS ct, unnest(quantile_cont(ce, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS t FROM band GROUP BY tune),
tce AS ({_first(_ba("band JOIN cand ON tune = ct", "tune", "t", "ce"), "tune")})"""
PREDICTED = f"""{PARAMS},
predicted AS (SELECT v.*, t.tau, sim BETWEEN t.tau - 0.06e0 AND t.tau + 0.06e0 AS in_band, sim > t.tau AS A,
  CASE WHEN sim BETWEEN t.tau - 0.06e0 AND t.tau + 0.06e0 THEN ce > c.tau ELSE sim > t.tau + 0.06e0 END AS B,
  CASE WHEN sim BETWEEN t.tau - 0.06e0 AND t.tau + 0.06e0 THEN llm = 1 ELSE sim > t.tau + 0.06e0 END AS C,
  CASE WHEN sim BETWEEN t.tau - 0.06e0 AND t.tau + 0.06e0 THEN CASE WHEN llm >= 0 THEN llm = 1 ELSE sim > t.tau END ELSE sim > t.tau + 0.06e0 END AS C_fallback,
  sim > t.tau AND slots AS D, sim > coalesce(dt.tau, t.tau) AS adaptive
  FROM verified v JOIN tau t ON v.fold = t.tune JOIN tce c ON v.fold = c.tune LEFT JOIN dtau dt ON v.fold = dt.tune AND v.domain = dt.domain)"""
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT seed_id, axis_group, hit, in_band, '{c}' AS config, {c} AS served FROM predicted" for c in decision.CONFIGS) + ")"


def _sql(x: str) -> str:
    import re

    return re.sub(r"int\(([^()]*)\)", r"CAST((\1) AS INT)", x)


_COUNTS = "counts AS (SELECT config, seed_id, " + ", ".join(f"CAST(sum({_sql(x)}) AS BIGINT) AS {c}" for c, x in decision.COUNTS.items()) + " FROM long GROUP BY config, seed_id)"
_RATIOS = ", ".join(f"CASE WHEN sum({b}) = 0 THEN NULL ELSE round(sum({a}) / CAST(sum({b}) AS DOUBLE), 6) END AS {x}" for x, (a, b) in decision.RATIOS.items())
_REPS = f"""seeds AS (SELECT DISTINCT seed_id FROM counts),
draws AS (SELECT rep, seed_id, CAST(('0x' || substring(md5((rep // 4) || ':' || seed_id), CAST(1 + 8 * (rep % 4) AS BIGINT), 8)) AS BIGINT) / 4294967296e0 AS u FROM seeds, range(0, {REPS}) a(rep)),
wt AS (SELECT rep, seed_id, {" + ".join(f"CAST(u >= {p!r}e0 AS INT)" for p in bootstrap.POISSON)} AS w FROM draws),
reps AS (SELECT rep, config, {", ".join(f"sum({c} * w) AS {c}" for c in decision.COUNTS)} FROM wt JOIN counts USING (seed_id) WHERE w > 0 GROUP BY rep, config)"""

ORACLES = {
    "threshold_sweep": with_(SCORED, _GRID) + """SELECT tau, round(coalesce(avg(CASE WHEN hit = 0 THEN CAST(sim > tau AS INT) END), 0), 6) AS false_hit, round(coalesce(avg(CASE WHEN hit = 1 THEN CAST(sim <= tau AS INT) END), 0), 6) AS false_miss,
round(coalesce(avg(CASE WHEN axis_group = 'slope' THEN CAST(sim > tau AS INT) END), 0), 6) AS false_hit_slope, round(coalesce(avg(CASE WHEN axis_group = 'cliff' THEN CAST(sim > tau AS INT) END), 0), 6) AS false_hit_cliff FROM scored, grid GROUP BY tau""",
    "balanced_accuracy": with_(SCORED, _GRID, f"b AS ({_ba('scored, grid g', 'lang')})") + "SELECT lang, tau, round(ba, 6) AS ba FROM b",
    "best_tau": with_(SCORED, _GRID, f"b AS ({_first(_ba('scored, grid g'))})") + "SELECT tau, round(ba, 6) AS ba FROM b",
    "domain_tau": with_(SCORED, _GRID, "x AS (SELECT * FROM scored WHERE domain IS NOT NULL)", f"b AS ({_first(_ba('x, grid g', 'domain'), 'domain')})") + "SELECT domain, tau, round(ba, 6) AS ba FROM b",
    "utility_tau_star": with_(SCORED, _GRID, _RHO, "c AS (SELECT domain, tau, count(*) FILTER (WHERE hit = 1 AND sim > tau) AS th, count(*) FILTER (WHERE hit = 0 AND sim > tau) AS fh, count(*) FILTER (WHERE hit = 1 AND sim <= tau) AS fm, count(*) AS n FROM scored, grid WHERE domain IS NOT NULL GROUP BY 1, 2)",
        "u AS (SELECT domain, CAST(rho AS INT) AS rho, tau, (th - rho * fh - fm) / CAST(n AS DOUBLE) AS u FROM c, rhos)") + "SELECT domain, rho, tau, round(u, 6) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY domain, rho ORDER BY u DESC, tau) AS r FROM u) WHERE r = 1",
    "slot_guard": with_(VERIFIED) + "SELECT axis, count(*) AS n, count(*) FILTER (WHERE slots) AS equal FROM verified GROUP BY axis",
    "pair_features": with_(VERIFIED) + "SELECT id, round(sim, 6) AS sim, round(ce, 6) AS ce, round(gap, 6) AS gap, CAST(same_numbers AS DOUBLE) AS same_numbers, CAST(same_acronyms AS DOUBLE) AS same_acronyms FROM verified",
    "seed_folds": with_(VERIFIED) + "SELECT seed_id, fold FROM fold",
    "fold_parameters": with_(PARAMS) + "SELECT CAST(t.tune AS INT) AS fold, t.tau, round(c.tau, 6) AS t_ce, d.domain, d.tau AS domain_tau FROM tau t JOIN tce c ON t.tune = c.tune JOIN dtau d ON t.tune = d.tune",
    "config_predictions": with_(PREDICTED) + "SELECT id, in_band, A, B, C, C_fallback, D, adaptive FROM predicted",
    "config_metrics": with_(PREDICTED, _LONG, _COUNTS) + f"SELECT config, {_RATIOS} FROM counts GROUP BY config",
    "in_sample_configs": with_(PREDICTED.replace("FROM verified v JOIN {0} k ON v.fold <> k.fold".format(_FS), "FROM verified v JOIN (SELECT 0 AS fold) k ON true").replace("v.fold = t.tune", "true").replace("v.fold = c.tune", "true").replace("v.fold = dt.tune", "true"), _LONG, _COUNTS) + f"SELECT config, {_RATIOS} FROM counts GROUP BY config",
    "logistic_balance": with_(PAIRS) + "SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(hit) AS BIGINT) AS expected FROM pairs",
    "seed_counts": with_(PREDICTED, _LONG, _COUNTS) + "SELECT * FROM counts",
    "c_residual": with_(PREDICTED) + "SELECT axis_group, count(*) AS false_hits, count(*) FILTER (WHERE NOT in_band) AS outside, round(count(*) FILTER (WHERE NOT in_band) / CAST(count(*) AS DOUBLE), 6) AS share FROM predicted WHERE C AND hit = 0 GROUP BY axis_group",
    "c4_reduction": with_(PREDICTED, _LONG, _COUNTS, "r AS (SELECT config, sum(false_slope) / CAST(sum(slope) AS DOUBLE) AS s, sum(false_cliff) / CAST(sum(cliff) AS DOUBLE) AS c FROM counts GROUP BY config)",
        "b AS (SELECT s AS bs, c AS bc FROM r WHERE config = 'A')") + "SELECT config, round((bs - s) / nullif(bs, 0), 6) AS slope, round((bc - c) / nullif(bc, 0), 6) AS cliff, round((bc - c) / nullif(bc, 0) - (bs - s) / nullif(bs, 0), 6) AS gap FROM r, b WHERE config <> 'A'",
    "band_oracle": with_(PREDICTED, "o AS (SELECT axis_group, avg(CAST(A AS INT)) AS fa, avg(CAST(NOT in_band AND sim > tau + 0.06e0 AS INT)) AS fo, count(*) FILTER (WHERE A AND in_band) / CAST(count(*) FILTER (WHERE A) AS DOUBLE) AS ib FROM predicted WHERE hit = 0 GROUP BY axis_group)")
    + "SELECT axis_group, round(fa, 6) AS fh_threshold, round(fo, 6) AS fh_oracle, round(ib, 6) AS in_band, round((fa - fo) / fa, 6) AS reduction FROM o",
    "verifier_in_band": with_(PREDICTED) + "SELECT axis_group, count(*) AS n, round(avg(CASE WHEN hit = 0 THEN CAST(llm <> 0 AS INT) END), 6) AS false_hit, round(avg(CASE WHEN hit = 1 THEN CAST(llm <> 1 AS INT) END), 6) AS false_miss FROM predicted WHERE in_band AND llm >= 0 GROUP BY axis_group",
    "split_half": with_(SCORED, _GRID, "x AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) % 2 AS parity FROM scored)", f"t AS ({_first(_ba('(SELECT * FROM x WHERE parity = 0), grid g'))})")
    + "SELECT tau, count(*) AS n, round(coalesce(avg(CASE WHEN hit = 0 THEN CAST(sim > tau AS INT) END), 0), 6) AS false_hit, round(coalesce(avg(CASE WHEN hit = 1 THEN CAST(sim <= tau AS INT) END), 0), 6) AS false_miss FROM x, t WHERE parity = 1 GROUP BY tau",
    "cluster_bootstrap": with_(PREDICTED, _LONG, _COUNTS, _REPS, "m AS (" + " UNION ALL ".join(f"SELECT config, '{x}' AS metric, CASE WHEN {b} = 0 THEN NULL ELSE ({a}) / CAST({b} AS DOUBLE) END AS v FROM reps" for x, (a, b) in decision.RATIOS.items()) + ")")
    + "SELECT config, metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m WHERE v IS NOT NULL GROUP BY config, metric",
    "c4_bootstrap": with_(PREDICTED, _LONG, _COUNTS, _REPS, "r AS (SELECT rep, config, false_slope / nullif(CAST(slope AS DOUBLE), 0) AS s, false_cliff / nullif(CAST(cliff AS DOUBLE), 0) AS c FROM reps)",
        "g AS (SELECT r.config, (b.c - r.c) / nullif(b.c, 0) - (b.s - r.s) / nullif(b.s, 0) AS gap FROM r JOIN r b ON r.rep = b.rep AND b.config = 'A' WHERE r.config <> 'A')")
    + "SELECT config, round(avg(CAST(gap > 0 AS INT)), 6) AS positive, round(quantile_cont(gap, 0.025), 6) AS lo, round(quantile_cont(gap, 0.975), 6) AS hi FROM g GROUP BY config",
    "nearest_rho": with_(SCORED, _GRID, _RHO, "c AS (SELECT domain, tau, count(*) FILTER (WHERE hit = 1 AND sim > tau) AS th, count(*) FILTER (WHERE hit = 0 AND sim > tau) AS fh, count(*) FILTER (WHERE hit = 1 AND sim <= tau) AS fm, count(*) AS n FROM scored, grid WHERE domain IS NOT NULL GROUP BY 1, 2)",
        "u AS (SELECT domain, CAST(rho AS INT) AS rho, tau, (th - rho * fh - fm) / CAST(n AS DOUBLE) AS u FROM c, rhos)", "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, rho ORDER BY u DESC, tau) AS r FROM u) WHERE r = 1)",
        "w AS (SELECT unnest([2e0, 12e0, 90e0, 700e0]) AS wanted)", "n AS (SELECT domain, wanted, rho, tau, row_number() OVER (PARTITION BY domain, wanted ORDER BY abs(rho - wanted), rho) AS r FROM t, w)") + "SELECT domain, wanted, rho, tau FROM n WHERE r = 1",
}
