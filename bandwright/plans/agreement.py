"""Agreement queries: a three-rater fixture over all pairs, and the two judgment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.draws import digit
from bandwright.functions.stats import normal_interval
from bandwright.operators import agreement, bootstrap
from bandwright.operators.windows import last_wins
from bandwright.plans.base import PAIRS, kept, pairs, r6, with_
from bandwright.session import cut, load

RATERS = ["a1", "a2", "a3"]
REPS = 10_000


def rated(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with three raters' labels: the pair's own, flipped where the id's hash digit for the rater is 0, UNSURE where it is 1; kept if there is a majority."""

    def make():
        p = pairs(spark, d).select("id", "seed_id", "domain", "lang", "axis", "axis_group", "expected_label", "hit")
        for r in RATERS:
            h = digit(F.lit(r), F.col("id"))
            p = p.withColumn(r, F.when(h == 1, "UNSURE").when((h == 0) == (F.col("hit") == 1), "DIFFERENT").otherwise("SAME"))
        g = agreement.majority(p, RATERS)
        return g.withColumn("agree", agreement.agrees(F.col("gold"), F.col("hit")))

    return kept(spark, d, "rated", make)


def _definite(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that all three raters labelled SAME or DIFFERENT."""
    return rated(spark, d).filter("n_same + n_diff = 3")


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).groupBy("gold", "expected_label").agg(F.count(F.lit(1)).alias("n"), F.sum("agree").alias("agree"))


def fleiss_ac1(spark: SparkSession, d: str) -> DataFrame:
    return agreement.fleiss(agreement.rater_sums(_definite(spark, d), []), []).select("n", *r6("kappa", "ac1", "raw", "p_same", "agreement"))


def group_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement.fleiss(agreement.rater_sums(_definite(spark, d), ["axis_group"]), ["axis_group"]).select("axis_group", "n", *r6("kappa", "ac1", "raw", "p_same"))


def pairwise_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agreement.pairwise(rated(spark, d), RATERS).select("pair", "n", *r6("raw", "kappa", "ac1"))


def unanimity(spark: SparkSession, d: str) -> DataFrame:
    rows = _definite(spark, d)
    una = F.col("n_same").isin(0, 3)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(una).alias("unanimous"), F.count_if(una & (F.col("agree") == 1)).alias("agree"))


def agreement_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = rated(spark, d).filter("gold IS NOT NULL")
    return agreement.buckets(rows, ["axis", "axis_group", "domain", "lang", "expected_label"]).select("dimension", "value", "n", "agree", *r6("share", "lo", "hi"))


def rater_marginals(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in RATERS])).alias("e")
    return rated(spark, d).select(each).groupBy("e.rater", "e.label").agg(F.count(F.lit(1)).alias("n"))


def disagreements(spark: SparkSession, d: str) -> DataFrame:
    rows = rated(spark, d).filter("gold IS NOT NULL AND agree = 0")
    return rows.select("id", "axis", "expected_label", "gold", F.concat_ws(",", *RATERS).alias("votes"))


def kappa_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    clusters = cut(agreement.rater_sums(_definite(spark, d), ["seed_id"]))
    reps = agreement.fleiss(bootstrap.replicates(clusters, "seed_id", ["n", "same", "pairs", "agree"], REPS), ["rep"])
    long = reps.select("rep", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("kappa", "ac1", "agreement")])).alias("m")).select("m.metric", "m.value")
    return bootstrap.order_interval(long, ["metric"], "value", REPS).select("metric", *r6("lo", "hi"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """(id, a, b): the latest verdicts of the two judgment tables on ids in both."""
    side = lambda t, c: last_wins(load(spark, d, t).filter("id IS NOT NULL AND axis_ok IS NOT NULL").select("id", "axis_ok", "ts"), ["id"], "ts").select("id", F.col("axis_ok").alias(c))
    return side("t04a_judgments_b1", "a").join(side("t04b_judgments_b2", "b"), "id")


def krippendorff(spark: SparkSession, d: str) -> DataFrame:
    return agreement.krippendorff(_both(spark, d), "a", "b").select("n", *r6("agreement", "alpha", "rate_a", "rate_b"))


def krippendorff_by_axis(spark: SparkSession, d: str) -> DataFrame:
    rows = _both(spark, d).withColumn("axis", F.element_at(F.split("id", "_"), -2))
    return agreement.krippendorff(rows, "a", "b", ["axis"]).select("axis", "n", *r6("agreement", "alpha"))


def rerun_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per axis and in all: ids judged in both tables, equal verdicts, and how often each table passes; and how many of the first table's ids the second lacks."""
    first = last_wins(load(spark, d, "t04a_judgments_b1").filter("id IS NOT NULL AND axis_ok IS NOT NULL").select("id", "axis_ok", "ts"), ["id"], "ts").select("id", F.col("axis_ok").alias("a"))
    second = last_wins(load(spark, d, "t04b_judgments_b2").filter("id IS NOT NULL AND axis_ok IS NOT NULL").select("id", "axis_ok", "ts"), ["id"], "ts").select("id", F.col("axis_ok").alias("b"))
    rows = first.join(second, "id", "left").withColumn("axis", F.element_at(F.split("id", "_"), -2))
    both = F.col("b").isNotNull()
    return rows.rollup("axis").agg(
        F.count_if(both).alias("decided"), F.count_if(~both).alias("missing"), F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count_if(both & F.col("a")).alias("serve_original"), F.count_if("b").alias("serve_rerun")
    )


def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of passed judgments per judge model, with the normal interval."""
    t = load(spark, d, "t04a_judgments_b1").unionByName(load(spark, d, "t04b_judgments_b2")).filter("axis_ok IS NOT NULL")
    c = t.groupBy("judge_model").agg(F.count(F.lit(1)).alias("n"), F.count_if("axis_ok").alias("k"))
    lo, hi = normal_interval(F.col("k").cast("double"), F.col("n"))
    return c.select("judge_model", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


QUERIES = {
    f.__name__: f
    for f in (
        majority_vote, fleiss_ac1, group_agreement, pairwise_kappa, unanimity, agreement_buckets, rater_marginals, disagreements, kappa_bootstrap,
        krippendorff, krippendorff_by_axis, rerun_agreement, pass_rates,
    )
}

_R = ", ".join(f"CASE WHEN substring(md5('{r}:' || id), 1, 1) = '1' THEN 'UNSURE' WHEN (substring(md5('{r}:' || id), 1, 1) = '0') = (hit = 1) THEN 'DIFFERENT' ELSE 'SAME' END AS {r}" for r in RATERS)
_N = lambda y: " + ".join(f"CAST({r} = '{y}' AS INT)" for r in RATERS)
RATED = f"""{PAIRS}, votes AS (SELECT *, {_R} FROM pairs), counted AS (SELECT *, {_N("SAME")} AS n_same, {_N("DIFFERENT")} AS n_diff FROM votes),
gold AS (SELECT *, CASE WHEN n_same >= 2 THEN 'SAME' WHEN n_diff >= 2 THEN 'DIFFERENT' END AS gold FROM counted),
rated AS (SELECT *, coalesce(CAST(gold = CASE WHEN hit = 1 THEN 'SAME' ELSE 'DIFFERENT' END AS INT), 0) AS agree FROM gold),
definite AS (SELECT * FROM rated WHERE n_same + n_diff = 3)"""


def _fleiss(rows: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""f AS (SELECT {k}n, pr / (6.0 * n) AS raw, same / CAST(n * 3 AS DOUBLE) AS p, agree / CAST(n AS DOUBLE) AS agreement FROM (
  SELECT {k}sum(n) AS n, sum(same) AS same, sum(pairs) AS pr, sum(agree) AS agree FROM {rows} {g})),
fl AS (SELECT {k}n, (raw - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))) AS kappa, (raw - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)) AS ac1, raw, p AS p_same, agreement FROM f)"""


_SUMS = "(SELECT seed_id, axis_group, 1 AS n, n_same AS same, n_same * (n_same - 1) + n_diff * (n_diff - 1) AS pairs, agree FROM definite)"
_LAST = "SELECT id, axis_ok FROM (SELECT id, axis_ok, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST) AS r FROM {0} WHERE id IS NOT NULL AND axis_ok IS NOT NULL) WHERE r = 1"
_BOTH = f"a AS ({_LAST.format('t04a_judgments_b1')}), b AS ({_LAST.format('t04b_judgments_b2')}), j AS (SELECT a.id, string_split(a.id, '_')[-2] AS axis, a.axis_ok AS a, b.axis_ok AS b FROM a JOIN b ON a.id = b.id)"
_ALPHA = "count(*) AS n, round(avg(CAST(a = b AS INT)), 6) AS agreement, round(1 - (1 - avg(CAST(a = b AS INT))) / (2.0 * (sum(CAST(a AS INT)) + sum(CAST(b AS INT))) * (2 * count(*) - (sum(CAST(a AS INT)) + sum(CAST(b AS INT)))) / (2.0 * count(*) * (2 * count(*) - 1))), 6) AS alpha"
_PK = lambda x, y: f"SELECT '{x}-{y}' AS pair, {x} AS x, {y} AS y FROM rated"
_WIL = "round((a / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {0} 1.96 * sqrt(a / n * (1 - a / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6)"

ORACLES = {
    "majority_vote": with_(RATED) + "SELECT gold, expected_label, count(*) AS n, CAST(sum(agree) AS BIGINT) AS agree FROM rated GROUP BY ALL",
    "fleiss_ac1": with_(RATED, _fleiss(_SUMS)) + "SELECT CAST(n AS BIGINT) AS n, round(kappa, 6) AS kappa, round(ac1, 6) AS ac1, round(raw, 6) AS raw, round(p_same, 6) AS p_same, round(agreement, 6) AS agreement FROM fl",
    "group_agreement": with_(RATED, _fleiss(_SUMS, "axis_group")) + "SELECT axis_group, CAST(n AS BIGINT) AS n, round(kappa, 6) AS kappa, round(ac1, 6) AS ac1, round(raw, 6) AS raw, round(p_same, 6) AS p_same FROM fl",
    "pairwise_kappa": with_(RATED, f"e AS ({_PK('a1', 'a2')} UNION ALL {_PK('a1', 'a3')} UNION ALL {_PK('a2', 'a3')})",
        "t AS (SELECT pair, count(*) AS n, avg(CAST(x = y AS INT)) AS po, avg(CAST(x = 'SAME' AS INT)) AS x0, avg(CAST(x = 'DIFFERENT' AS INT)) AS x1, avg(CAST(y = 'SAME' AS INT)) AS y0, avg(CAST(y = 'DIFFERENT' AS INT)) AS y1 FROM e GROUP BY pair)",
        "u AS (SELECT *, x0 * y0 + x1 * y1 AS pe, (x0 + y0) / 2 * (1 - (x0 + y0) / 2) + (x1 + y1) / 2 * (1 - (x1 + y1) / 2) AS pg FROM t)")
    + "SELECT pair, n, round(po, 6) AS raw, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pg) / (1 - pg), 6) AS ac1 FROM u",
    "unanimity": with_(RATED) + "SELECT count(*) AS n, count(*) FILTER (WHERE n_same IN (0, 3)) AS unanimous, count(*) FILTER (WHERE n_same IN (0, 3) AND agree = 1) AS agree FROM definite",
    "agreement_buckets": with_(RATED, "g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, CAST(count(*) AS DOUBLE) AS n, CAST(sum(agree) AS DOUBLE) AS a FROM rated WHERE gold IS NOT NULL GROUP BY {c}" for c in ("axis", "axis_group", "domain", "lang", "expected_label")) + ")")
    + f"SELECT dimension, value, CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS agree, round(a / n, 6) AS share, {_WIL.format('-')} AS lo, {_WIL.format('+')} AS hi FROM g",
    "rater_marginals": with_(RATED) + " UNION ALL ".join(f"SELECT '{r}' AS rater, {r} AS label, count(*) AS n FROM rated GROUP BY {r}" for r in RATERS),
    "disagreements": with_(RATED) + "SELECT id, axis, expected_label, gold, concat_ws(',', a1, a2, a3) AS votes FROM rated WHERE gold IS NOT NULL AND agree = 0",
    "kappa_bootstrap": with_(RATED, f"c AS (SELECT seed_id, sum(n) AS n, sum(same) AS same, sum(pairs) AS pairs, sum(agree) AS agree FROM {_SUMS} GROUP BY seed_id)",
        f"draws AS (SELECT rep, seed_id, CAST(('0x' || substring(md5((rep // 4) || ':' || seed_id), CAST(1 + 8 * (rep % 4) AS BIGINT), 8)) AS BIGINT) / 4294967296e0 AS u FROM c, range(0, {REPS}) a(rep))",
        f"wt AS (SELECT rep, seed_id, {' + '.join(f'CAST(u >= {p!r}e0 AS INT)' for p in bootstrap.POISSON)} AS w FROM draws)",
        "reps AS (SELECT rep, c.n * w AS n, same * w AS same, pairs * w AS pairs, agree * w AS agree FROM wt JOIN c USING (seed_id) WHERE w > 0)", _fleiss("reps", "rep"),
        "m AS (SELECT 'kappa' AS metric, kappa AS v FROM fl UNION ALL SELECT 'ac1', ac1 FROM fl UNION ALL SELECT 'agreement', agreement FROM fl)", "o AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS r FROM m)")
    + f"SELECT metric, round(max(v) FILTER (WHERE r = {int(0.025 * REPS)}), 6) AS lo, round(max(v) FILTER (WHERE r = {int(0.975 * REPS) - 1}), 6) AS hi FROM o GROUP BY metric",
    "krippendorff": with_(_BOTH) + f"SELECT {_ALPHA}, round(avg(CAST(a AS INT)), 6) AS rate_a, round(avg(CAST(b AS INT)), 6) AS rate_b FROM j",
    "krippendorff_by_axis": with_(_BOTH) + f"SELECT axis, {_ALPHA} FROM j GROUP BY axis",
    "rerun_agreement": with_(_BOTH, "l AS (SELECT a.id, string_split(a.id, '_')[-2] AS axis, a.axis_ok AS a, b.axis_ok AS b FROM a LEFT JOIN b ON a.id = b.id)")
    + "SELECT axis, count(b) AS decided, count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a AND b IS NOT NULL) AS serve_original, count(*) FILTER (WHERE b) AS serve_rerun FROM l GROUP BY ROLLUP (axis)",
    "pass_rates": """WITH t AS (SELECT judge_model, axis_ok FROM t04a_judgments_b1 UNION ALL SELECT judge_model, axis_ok FROM t04b_judgments_b2),
c AS (SELECT judge_model, count(*) AS n, avg(CAST(axis_ok AS INT)) AS p FROM t WHERE axis_ok IS NOT NULL GROUP BY judge_model)
SELECT judge_model, n, round(p, 6) AS share, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS lo, round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS hi FROM c""",
}
