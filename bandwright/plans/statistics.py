"""Rank statistics of scorers over axes, and batch durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.operators import overlap, ranks
from bandwright.plans.base import kept, r6, with_
from bandwright.plans.decision import VERIFIED, verified
from bandwright.plans.similarity import _io_sql
from bandwright.session import load

SCORERS = {"trigram": "sim", "words": "ce", "length": "1 - gap", "mixed": "(sim + ce) / 2"}


def _long(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("encoder"), F.expr(x).alias("sim")) for n, x in SCORERS.items()])).alias("e")
    return verified(spark, d).select("id", "axis", "hit", *extra, each).select("id", "axis", "hit", *extra, "e.encoder", "e.sim")


def table(spark: SparkSession, d: str) -> DataFrame:
    """(encoder, block, value): Irreducible Overlap of each scorer on each N-axis."""

    def make():
        io = overlap.irreducible_overlap(overlap.against_hits(_long(spark, d), "axis", ["encoder"]), ["encoder", "axis"])
        return io.select("encoder", F.col("axis").alias("block"), F.round("io", 6).alias("value"))

    return kept(spark, d, "encoder_io", make)


def encoder_io(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d)


def mid_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ranks.mean_ranks(table(spark, d)).select("encoder", *r6("mean_rank"))


def friedman(spark: SparkSession, d: str) -> DataFrame:
    return ranks.friedman(table(spark, d)).select("encoders", "blocks", *r6("chi2"))


def friedman_p(spark: SparkSession, d: str) -> DataFrame:
    return ranks.friedman(table(spark, d)).select("encoders", "blocks", *r6("chi2", "p"))


def nemenyi(spark: SparkSession, d: str) -> DataFrame:
    return ranks.nemenyi(table(spark, d)).select("a", "b", *r6("gap", "p"))


def cliques(spark: SparkSession, d: str) -> DataFrame:
    return ranks.cliques(ranks.mean_ranks(table(spark, d)), ranks.critical_difference(len(SCORERS), 6))


def _by_domain(spark: SparkSession, d: str) -> DataFrame:
    def make():
        io = overlap.irreducible_overlap(overlap.class_counts(_long(spark, d, "domain").filter("domain IS NOT NULL"), ["domain", "encoder"]), ["domain", "encoder"])
        return io.select("domain", "encoder", F.round("io", 6).alias("value"))

    return kept(spark, d, "domain_io", make)


def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return ranks.kendall(_by_domain(spark, d), "domain", "encoder", "value").select("a", "b", "n", *r6("tau"))


def kendall_p(spark: SparkSession, d: str) -> DataFrame:
    return ranks.kendall(_by_domain(spark, d), "domain", "encoder", "value").select("a", "b", *r6("tau", "p"))


def batch_durations(spark: SparkSession, d: str) -> DataFrame:
    """Per judge model the median milliseconds per judgment of a batch, rounded half to even; batches of one row are skipped."""
    t = load(spark, d, "t04a_judgments_b1").filter("batch_id IS NOT NULL AND ts IS NOT NULL")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    per = t.groupBy("judge_model", "batch_id").agg(F.count(F.lit(1)).alias("n"), (F.max(us) - F.min(us)).alias("us")).filter("n > 1")
    return per.groupBy("judge_model").agg(F.count(F.lit(1)).alias("batches"), F.bround(F.percentile(F.col("us") / 1000 / F.col("n"), F.lit(0.5)), 0).alias("ms"))


QUERIES = {f.__name__: f for f in (encoder_io, mid_ranks, friedman, friedman_p, nemenyi, cliques, kendall_tau, kendall_p, batch_durations)}

_LONG = " UNION ALL ".join(f"SELECT id, axis, hit, '{n}' AS encoder, {x} AS s FROM verified" for n, x in SCORERS.items())
_AGAINST = "SELECT encoder, axis, s AS sim, hit FROM long WHERE hit = 0 UNION ALL SELECT h.encoder, n.axis, h.s, h.hit FROM long h JOIN (SELECT DISTINCT encoder, axis FROM long WHERE hit = 0) n ON h.encoder = n.encoder WHERE h.hit = 1"


def _verified_io(keys: str, rows: str) -> str:
    from bandwright.plans.base import SCORED

    return _io_sql(keys, rows).replace(SCORED, f"{VERIFIED}, long AS ({_LONG})", 1)


_TABLE = _verified_io("encoder, axis", _AGAINST)
_T = f"t AS (SELECT encoder, axis AS block, io AS value FROM ({_TABLE}))"
_R = "r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY value) + (count(*) OVER (PARTITION BY block, value) - 1) / 2.0 AS mr FROM t)"
_MR = "mr AS (SELECT encoder, avg(mr) AS m, row_number() OVER (ORDER BY avg(mr), encoder) AS pos FROM r GROUP BY encoder)"
_GEN = _verified_io("domain, encoder", "SELECT v.domain, l.encoder, l.s AS sim, l.hit FROM long l JOIN verified v ON l.id = v.id WHERE v.domain IS NOT NULL")

_CHI2 = "c2 AS (SELECT k, n, (12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / CAST(n * (k * k * k - k) AS DOUBLE)) AS x FROM k, s, c)"
_TIES = ("k AS (SELECT count(DISTINCT encoder) AS k, count(DISTINCT block) AS n FROM t)", "s AS (SELECT sum(x * x) AS ss FROM (SELECT sum(mr) AS x FROM r GROUP BY encoder))", "c AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM t GROUP BY block, value))")
#: The normal distribution function by a series of positive terms, x ** (2 n + 1) / (1 * 3 * ... * (2 n + 1)).
_PHI = lambda x: f"(0.5 + CASE WHEN ({x}) = 0 THEN 0 ELSE sign({x}) * exp(-({x}) * ({x}) / 2.0) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda m: exp((2 * m + 1) * ln(abs({x})) - (m + 1) * ln(2.0) - lgamma(m + 1.5) + ln(pi()) / 2))) END)"

ORACLES = {
    "friedman_p": with_(_T, _R, *_TIES, _CHI2)
    + "SELECT CAST(k AS INT) AS encoders, CAST(n AS INT) AS blocks, CAST(round(x, 6) AS DOUBLE) AS chi2, round(CASE WHEN x <= 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 400), lambda m: exp(-x / 2 + ((k - 1) / 2.0 + m) * ln(x / 2) - lgamma((k - 1) / 2.0 + m + 1))))) END, 6) AS p FROM c2",
    "nemenyi": with_(_T, _R, _MR, "k AS (SELECT count(DISTINCT encoder) AS k, count(DISTINCT block) AS n FROM t)", "g AS (SELECT a.encoder AS a, b.encoder AS b, abs(a.m - b.m) AS gap, abs(a.m - b.m) / sqrt(k * (k + 1) / (6.0 * n)) * sqrt(2.0) AS q, k FROM mr a JOIN mr b ON a.encoder < b.encoder, k)",
        "x AS (SELECT i, -8.0e0 + i * 0.008e0 AS x FROM range(0, 2001) t(i))", f"f AS (SELECT x.i, x.x, {_PHI('x.x')} AS lo FROM x)", f"h AS (SELECT g.*, f.i, f.x, f.lo, {_PHI('f.x + g.q')} AS hi FROM g, f)")
    + "SELECT a, b, CAST(round(any_value(gap), 6) AS DOUBLE) AS gap, round(least(1, greatest(0, 1 - sum(CASE WHEN i IN (0, 2000) THEN 0.5 ELSE 1.0 END * k * exp(-x * x / 2) / sqrt(2 * pi()) * pow(greatest(hi - lo, 0), k - 1) * 0.008e0))), 6) AS p FROM h GROUP BY a, b",
    "encoder_io": with_(_T) + "SELECT * FROM t",
    "mid_ranks": with_(_T, _R) + "SELECT encoder, CAST(round(avg(mr), 6) AS DOUBLE) AS mean_rank FROM r GROUP BY encoder",
    "friedman": with_(_T, _R, "k AS (SELECT count(DISTINCT encoder) AS k, count(DISTINCT block) AS n FROM t)", "s AS (SELECT sum(x * x) AS ss FROM (SELECT sum(mr) AS x FROM r GROUP BY encoder))", "c AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM t GROUP BY block, value))")
    + "SELECT CAST(k AS INT) AS encoders, CAST(n AS INT) AS blocks, CAST(round((12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / CAST(n * (k * k * k - k) AS DOUBLE)), 6) AS DOUBLE) AS chi2 FROM k, s, c",
    "cliques": with_(_T, _R, _MR, f"e AS (SELECT a.encoder, a.pos, max(b.pos) AS fin FROM mr a JOIN mr b ON b.pos >= a.pos AND b.m - a.m < {ranks.critical_difference(len(SCORERS), 6)!r} GROUP BY a.encoder, a.pos)", "l AS (SELECT *, max(fin) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)")
    + "SELECT l.encoder AS first, mr.encoder AS last, CAST(fin - l.pos + 1 AS INT) AS size FROM l JOIN mr ON mr.pos = fin WHERE fin > l.pos AND (before IS NULL OR fin > before)",
    "kendall_tau": with_(f"g AS (SELECT domain AS gm, encoder AS i, io AS v FROM ({_GEN}))", "b AS (SELECT x.gm AS a, y.gm AS b, x.i, x.v AS x, y.v AS y FROM g x JOIN g y ON x.i = y.i AND x.gm < y.gm)",
        "p AS (SELECT l.a, l.b, sign(l.x - r.x) AS sx, sign(l.y - r.y) AS sy FROM b l JOIN b r ON l.a = r.a AND l.b = r.b AND l.i < r.i)")
    + "SELECT a, b, CAST((1 + sqrt(1 + 8.0 * count(*))) / 2 AS INT) AS n, round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 6) AS tau FROM p GROUP BY a, b",
    "kendall_p": with_(f"g AS (SELECT domain AS gm, encoder AS i, io AS v FROM ({_GEN}))", "b AS (SELECT x.gm AS a, y.gm AS b, x.i, x.v AS x, y.v AS y FROM g x JOIN g y ON x.i = y.i AND x.gm < y.gm)",
        "p AS (SELECT l.a, l.b, sign(l.x - r.x) AS sx, sign(l.y - r.y) AS sy FROM b l JOIN b r ON l.a = r.a AND l.b = r.b AND l.i < r.i)", "t AS (SELECT a, b, (1 + sqrt(1 + 8.0 * count(*))) / 2 AS n, CAST(sum(sx * sy) AS DOUBLE) AS s, sqrt(sum(abs(sx)) * sum(abs(sy))) AS d FROM p GROUP BY a, b)",
        "z AS (SELECT *, CASE WHEN n > 1 THEN abs(s) / sqrt(n * (n - 1) * (2 * n + 5) / 18) ELSE 0 END AS z FROM t)")
    + f"SELECT a, b, round(s / d, 6) AS tau, round(2 * (1 - {_PHI('z')}), 6) AS p FROM z",
    "batch_durations": "WITH p AS (SELECT judge_model, batch_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM t04a_judgments_b1 WHERE batch_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT judge_model, count(*) AS batches, round_even(quantile_cont(us / 1000.0e0 / n, 0.5), 0) AS ms FROM p GROUP BY judge_model",
}
