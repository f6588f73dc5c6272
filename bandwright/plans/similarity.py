"""Similarity queries over the pair relation and the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.text import fold
from bandwright.operators import graph, overlap
from bandwright.operators.pairs import embed
from bandwright.plans.base import PAIRS, SCORED, pairs, r6, scored, with_
from bandwright.session import cut, load

TAU = 0.25


def trigram_embed(spark: SparkSession, d: str) -> DataFrame:
    texts = pairs(spark, d).select(F.coalesce("seed_question", F.lit("")).alias("text"))
    v = embed(texts)
    return v.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("buckets"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))


def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", *r6("sim"))


def axis_similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    return overlap.summary(scored(spark, d), ["axis"]).select("axis", "n", *r6("mean", "std", "min", "p25", "p50", "p75", "p90", "max"))


def group_mean_similarity(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("axis_group", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("mean"))


def _io(rows: DataFrame, *keys: str) -> DataFrame:
    return overlap.irreducible_overlap(rows, list(keys)).select(*keys, *r6("io", "tau_star"), "n_hit", "n_miss")


def _scores(rows: DataFrame, *keys: str) -> DataFrame:
    return overlap.class_counts(rows, list(keys))


def io_per_axis(spark: SparkSession, d: str) -> DataFrame:
    return _io(overlap.against_hits(scored(spark, d), "axis"), "axis")


def io_per_group(spark: SparkSession, d: str) -> DataFrame:
    return _io(overlap.against_hits(scored(spark, d), "axis_group"), "axis_group")


def io_per_domain(spark: SparkSession, d: str) -> DataFrame:
    return _io(overlap.against_hits(scored(spark, d).filter("domain IS NOT NULL"), "axis", ["domain"]), "domain", "axis")


def io_overall(spark: SparkSession, d: str) -> DataFrame:
    return _io(_scores(scored(spark, d).withColumn("model", F.lit("trigram")), "model"), "model")


def danger_zone(spark: SparkSession, d: str) -> DataFrame:
    return overlap.danger_zone(scored(spark, d)).select(*r6("p25", "share"), "n")


def ks_slope_cliff(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).filter("hit = 0").withColumn("cliff", (F.col("axis_group") == "cliff").cast("int"))
    return overlap.ks_test(rows, ["lang"], "cliff").select("lang", *r6("d", "p"))


def similarity_ecdf(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).withColumn("sim", F.round("sim", 3))
    return overlap.ecdf(rows, ["axis"]).select("axis", "sim", "n", *r6("cdf"))


def quantile_grid(spark: SparkSession, d: str) -> DataFrame:
    return overlap.quantile_grid(scored(spark, d), ["axis_group"]).select("axis_group", "p", *r6("value"))


def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return overlap.histogram(scored(spark, d), ["hit"], 0.55, 1.0, 45).select("hit", "bin", "n", *r6("density"))


def surface_step(spark: SparkSession, d: str) -> DataFrame:
    step = overlap.surface_step(F.coalesce("seed_question", F.lit("")), F.coalesce("variation", F.lit("")))
    return overlap.summary(pairs(spark, d).select("axis", step.alias("sim")), ["axis"]).select("axis", "n", *r6("p25", "p50", "p75"))


def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(load(spark, d, "embeddings"), TAU).select("i", "j", *r6("sim"))


def transitivity(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitivity(cut(graph.edges(load(spark, d, "embeddings"), TAU))).select("triples", "violations", *r6("share"))


def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest(load(spark, d, "embeddings")).select("id", "nearest", *r6("sim"))


def transitivity_verdict(spark: SparkSession, d: str) -> DataFrame:
    """weak if few triples are open, strong if many, else middle, at three thresholds."""
    e = cut(graph.edges(load(spark, d, "embeddings"), 0.2))
    out = None
    for tau in (0.2, 0.25, 0.3):
        t = graph.transitivity(e.filter(F.col("sim") > tau)).select(F.lit(tau).alias("tau"), "triples", "violations", "share")
        out = t if out is None else out.unionByName(t)
    verdict = F.when(F.coalesce("share", F.lit(0.0)) < 0.01, "weak").when(F.col("share") >= 0.05, "strong").otherwise("middle")
    return out.select("tau", "triples", "violations", verdict.alias("verdict"))


def separation_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether slope and cliff pairs coincide, per language: KS p above 0.05 and means closer than 0.02."""
    rows = scored(spark, d).filter("hit = 0").withColumn("cliff", (F.col("axis_group") == "cliff").cast("int"))
    gap = rows.groupBy("lang").agg((F.avg(F.when(F.col("cliff") == 0, F.col("sim"))) - F.avg(F.when(F.col("cliff") == 1, F.col("sim")))).alias("gap"))
    both = overlap.ks_test(rows, ["lang"], "cliff").join(gap, "lang")
    same = (F.col("p") > 0.05) & (F.abs("gap") < 0.02)
    each = both.agg(F.count_if(same).alias("coincide"), F.count(F.lit(1)).alias("of"))
    return each.select("coincide", "of", F.when(F.col("coincide") == F.col("of"), "BAD").when(F.col("coincide") > 0, "MIXED").otherwise("SUPPORTED").alias("verdict"))


def domain_spellings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "t05_final").groupBy(fold(F.col("domain")).alias("domain")).agg(F.countDistinct("domain").alias("spellings"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        trigram_embed, pair_cosine, axis_similarity_stats, group_mean_similarity, io_per_axis, io_per_group, io_per_domain, io_overall, danger_zone,
        ks_slope_cliff, similarity_ecdf, quantile_grid, similarity_histogram, surface_step, similarity_edges, transitivity, nearest_neighbor,
        transitivity_verdict, separation_verdict, domain_spellings,
    )
}


def _io_sql(keys: str, rows: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    a = ", ".join(f"a.{k}" for k in keys.split(", "))
    return with_(SCORED, f"""
rows AS ({rows}),
points AS (SELECT {keys}, sim AS v, 0 AS o, hit AS h, 1 - hit AS m FROM rows
  UNION ALL SELECT DISTINCT {keys}, sim - 1e-9, 1, 0, 0 FROM rows UNION ALL SELECT DISTINCT {keys}, sim + 1e-9, 1, 0, 0 FROM rows),
run AS (SELECT {keys}, v, o, sum(h) OVER w AS ch, sum(m) OVER w AS cm FROM points WINDOW w AS (PARTITION BY {keys} ORDER BY v, o ROWS UNBOUNDED PRECEDING)),
n AS (SELECT {keys}, sum(hit) AS nh, sum(1 - hit) AS nm FROM rows GROUP BY {keys}),
ba AS (SELECT {a}, a.v, 0.5 * ((b.nh - a.ch) / CAST(b.nh AS DOUBLE) + a.cm / CAST(b.nm AS DOUBLE)) AS ba, nh, nm FROM run a JOIN n b ON {on} WHERE o = 1 AND nh > 0 AND nm > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ba DESC, v) AS r FROM ba)""") + f"SELECT {keys}, round(1 - ba, 6) AS io, round(v, 6) AS tau_star, CAST(nh AS BIGINT) AS n_hit, CAST(nm AS BIGINT) AS n_miss FROM best WHERE r = 1"


def _against(by: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    join = f"JOIN (SELECT DISTINCT {k}{by} FROM scored WHERE hit = 0) n " + (f"ON h.{key} = n.{key}" if key else "ON true")
    return f"SELECT {k}{by}, sim, hit FROM scored WHERE hit = 0 UNION ALL SELECT {f'h.{key}, ' if key else ''}n.{by}, h.sim, h.hit FROM scored h {join} WHERE h.hit = 1"


_EDGES = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.x, b.x) AS sim FROM v a JOIN v b ON a.id < b.id)"""
_TRIPLES = """b AS (SELECT tau, i AS b, j AS n FROM t UNION ALL SELECT tau, j, i FROM t),
p AS (SELECT x.tau, x.n AS a, y.n AS c FROM b x JOIN b y ON x.tau = y.tau AND x.b = y.b AND x.n < y.n),
c AS (SELECT p.tau, count(*) AS triples, count(*) FILTER (WHERE t.i IS NULL) AS violations FROM p LEFT JOIN t ON p.tau = t.tau AND p.a = t.i AND p.c = t.j GROUP BY p.tau)"""
_KS = """ks AS (SELECT lang, max(abs(a / CAST(na AS DOUBLE) - b / CAST(nb AS DOUBLE))) AS d, any_value(na) AS na, any_value(nb) AS nb FROM (
  SELECT lang, sim, sum(a) OVER u AS a, sum(b) OVER u AS b, sum(a) OVER (PARTITION BY lang) AS na, sum(b) OVER (PARTITION BY lang) AS nb FROM (
    SELECT lang, sim, count(*) FILTER (WHERE axis_group = 'cliff') AS a, count(*) FILTER (WHERE axis_group <> 'cliff') AS b FROM scored WHERE hit = 0 GROUP BY lang, sim)
  WINDOW u AS (PARTITION BY lang ORDER BY sim)) GROUP BY lang),
lam AS (SELECT lang, d, (sqrt(na * nb / CAST(na + nb AS DOUBLE)) + 0.12 + 0.11 / sqrt(na * nb / CAST(na + nb AS DOUBLE))) * d AS l FROM ks),
kp AS (SELECT lang, d, greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * l * l * j * j)) FROM range(1, 101) t(j)))) AS p FROM lam)"""
_STATS = "count(*) AS n, {0} round(quantile_cont(sim, 0.25), 6) AS p25, round(quantile_cont(sim, 0.5), 6) AS p50, round(quantile_cont(sim, 0.75), 6) AS p75"
_WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '[\s\p{{Z}}]+'), lambda w: w <> ''))"

ORACLES = {
    "trigram_embed": with_(PAIRS, r"""
texts AS (SELECT DISTINCT coalesce(seed_question, '') AS text FROM pairs),
padded AS (SELECT text, '  ' || regexp_replace(lower(text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') || '  ' AS t FROM texts),
hexes AS (SELECT text, md5(substring(t, CAST(i AS INT), 3)) AS h FROM (SELECT text, t, unnest(range(1, length(t) - 1)) AS i FROM padded)),
b AS (SELECT text, substring(h, 15, 2) AS b, sum(CASE WHEN substring(h, 14, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END) AS v FROM hexes GROUP BY 1, 2)""")
    + "SELECT md5(text) AS digest, count(*) AS buckets, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * v) AS BIGINT) AS squares FROM b WHERE v <> 0 GROUP BY text",
    "pair_cosine": with_(SCORED) + "SELECT id, round(sim, 6) AS sim FROM scored",
    "axis_similarity_stats": with_(SCORED) + "SELECT axis, " + _STATS.format("round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, round(min(sim), 6) AS min, round(max(sim), 6) AS max, round(quantile_cont(sim, 0.9), 6) AS p90,") + " FROM scored GROUP BY axis",
    "group_mean_similarity": with_(SCORED) + "SELECT axis_group, lang, count(*) AS n, round(avg(sim), 6) AS mean FROM scored GROUP BY ALL",
    "io_per_axis": _io_sql("axis", _against("axis")),
    "io_per_group": _io_sql("axis_group", _against("axis_group")),
    "io_per_domain": _io_sql("domain, axis", _against("axis", "domain")),
    "io_overall": _io_sql("model", "SELECT 'trigram' AS model, sim, hit FROM scored"),
    "danger_zone": with_(SCORED, "q AS (SELECT quantile_cont(sim, 0.25) AS p25 FROM scored WHERE hit = 1)") + "SELECT round(p25, 6) AS p25, round(avg(CASE WHEN sim > p25 THEN 1 ELSE 0 END), 6) AS share, count(*) AS n FROM scored, q WHERE axis_group = 'cliff' GROUP BY p25",
    "ks_slope_cliff": with_(SCORED, _KS) + "SELECT lang, round(d, 6) AS d, round(p, 6) AS p FROM kp",
    "similarity_ecdf": with_(SCORED, "c AS (SELECT axis, round(sim, 3) AS sim, count(*) AS n FROM scored GROUP BY 1, 2)") + "SELECT axis, sim, n, round(sum(n) OVER (PARTITION BY axis ORDER BY sim) / CAST(sum(n) OVER (PARTITION BY axis) AS DOUBLE), 6) AS cdf FROM c",
    "quantile_grid": with_(SCORED, "g AS (SELECT i * 5 AS q FROM range(1, 20) t(i))", "l AS (SELECT axis_group, list(sim) AS s FROM scored GROUP BY axis_group)",
        "q AS (SELECT axis_group, unnest(quantile_cont(sim, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS value, unnest(range(1, 20)) AS i FROM scored GROUP BY axis_group)")
    + "SELECT axis_group, CAST(round(i * 0.05, 2) AS DOUBLE) AS p, round(value, 6) AS value FROM q",
    "similarity_histogram": with_(SCORED, "b AS (SELECT hit, CASE WHEN sim = 1.0 THEN 44 ELSE CAST(floor((sim - 0.55e0) / (1e0 - 0.55e0) * 45) AS INT) END AS bin, count(*) AS n FROM scored WHERE sim BETWEEN 0.55 AND 1.0 GROUP BY 1, 2)")
    + "SELECT hit, bin, n, round(n / (sum(n) OVER (PARTITION BY hit) * ((1e0 - 0.55e0) / 45)), 6) AS density FROM b",
    "surface_step": with_(PAIRS, f"w AS (SELECT axis, {_WORDS.format('seed_question')} AS a, {_WORDS.format('variation')} AS b FROM pairs)",
        "s AS (SELECT axis, 1 - len(list_intersect(a, b)) / CAST(greatest(1, len(list_distinct(list_concat(a, b)))) AS DOUBLE) AS sim FROM w)") + "SELECT axis, " + _STATS.format("") + " FROM s GROUP BY axis",
    "similarity_edges": with_(_EDGES) + f"SELECT i, j, round(sim, 6) AS sim FROM e WHERE sim > {TAU}",
    "transitivity": with_(_EDGES, f"t AS (SELECT 0 AS tau, i, j FROM e WHERE sim > {TAU})", _TRIPLES) + "SELECT triples, violations, round(violations / CAST(triples AS DOUBLE), 6) AS share FROM c",
    "nearest_neighbor": with_(_EDGES, "b AS (SELECT i AS id, j AS o, sim FROM e UNION ALL SELECT j, i, sim FROM e)", "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, o) AS k FROM b)") + "SELECT id, o AS nearest, round(sim, 6) AS sim FROM r WHERE k = 1",
    "transitivity_verdict": with_(_EDGES, "g(tau) AS (VALUES (0.2), (0.25), (0.3))", "t AS (SELECT CAST(tau AS DOUBLE) AS tau, i, j FROM e JOIN g ON e.sim > g.tau)", _TRIPLES,
        "a AS (SELECT CAST(g.tau AS DOUBLE) AS tau, coalesce(triples, 0) AS triples, coalesce(violations, 0) AS violations FROM g LEFT JOIN c ON CAST(g.tau AS DOUBLE) = c.tau)")
    + "SELECT tau, triples, violations, CASE WHEN triples = 0 OR violations / CAST(triples AS DOUBLE) < 0.01 THEN 'weak' WHEN violations / CAST(triples AS DOUBLE) >= 0.05 THEN 'strong' ELSE 'middle' END AS verdict FROM a",
    "separation_verdict": with_(SCORED, _KS, "g AS (SELECT lang, avg(sim) FILTER (WHERE axis_group <> 'cliff') - avg(sim) FILTER (WHERE axis_group = 'cliff') AS gap FROM scored WHERE hit = 0 GROUP BY lang)",
        "s AS (SELECT count(*) FILTER (WHERE p > 0.05 AND abs(gap) < 0.02) AS coincide, count(*) AS n FROM kp JOIN g ON kp.lang = g.lang)") + "SELECT coincide, n AS of, CASE WHEN coincide = n THEN 'BAD' WHEN coincide > 0 THEN 'MIXED' ELSE 'SUPPORTED' END AS verdict FROM s",
    "domain_spellings": r"SELECT nullif(lower(regexp_replace(domain, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') AS domain, count(DISTINCT domain) AS spellings, count(*) AS n FROM t05_final GROUP BY 1",
}
