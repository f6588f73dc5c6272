"""Registered queries of the training-data operators and their SQL, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwright.functions.text import fold
from bandwright.llm import bpe, consensus, formats, mixing, neighbors, sample, spans, splits, topn
from bandwright.session import cut, load


def _scored(spark: SparkSession, d: str) -> DataFrame:
    conf = topn.latest(load(spark, d, "t04a_judgments_b1"), "id", "conf", "ts")
    rows = load(spark, d, "t05_final").select("seed_id", "axis", "id")
    return rows.join(conf, "id", "left").withColumn("conf", F.coalesce(F.nanvl("conf", F.lit(0.0)), F.lit(0.0)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_scored(spark, d), ["seed_id", "axis"], "conf", ["id"], 2, 0.0, 1.0).select("seed_id", "axis", "id")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_scored(spark, d), ["seed_id", "axis"], "conf", ["id"], 2, 0.0, 1.0).select("seed_id", "axis", "id", "conf")


def _report2(spark: SparkSession, d: str) -> DataFrame:
    return sample.plan(load(spark, d, "t05_final"), load(spark, d, "sample_targets"))[0]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _report2(spark, d).select("plan_id", "cell_id", "available", "short")


def p2_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Of every plan: its cells, the sum of their quotas, and whether in each what is drawn and what is lacking are the quota, and no more is drawn than there is."""
    r = _report2(spark, d)
    fine = (F.col("drawn") + F.col("shortfall") == F.col("quota")) & (F.col("drawn") <= F.col("available"))
    return r.groupBy("plan_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("quota").alias("quota"), F.bool_and(fine).alias("adds_up"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _report2(spark, d).filter("short").select("plan_id", "cell_id")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.draw(load(spark, d, "t05_final"), load(spark, d, "sample_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = formats.runs(load(spark, d, "t02_seeds"), "seed_id", ["question", "answer"])
    return found.filter("id <> representative").select(F.col("representative").alias("seed_id"), F.col("id").alias("copy_seed_id"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formats.collapsed(load(spark, d, "t02_seeds"), "seed_id", ["question", "answer"]).withColumnRenamed("representative", "seed_id")


def _tables5(spark: SparkSession, d: str) -> list[DataFrame]:
    return [load(spark, d, t) for t in ("t05_final", "t02_seeds", "source_index")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.smallest(splits.tied_seeds(*_tables5(spark, d)))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(*_tables5(spark, d)).select("id", "split")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of every domain: its records, and whether each split's are its share, give or take the largest set of tied records there."""
    rows = splits.assign(*_tables5(spark, d))
    per = cut(rows.groupBy("domain", "component", "split").agg(F.count(F.lit(1)).alias("n")))
    sums = per.groupBy("domain").agg(F.sum("n").alias("records"), F.max("n").alias("most"), *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in splits.SPLITS])
    off = F.greatest(*[F.abs(F.col(s) - F.col("records") * x) for s, x in zip(splits.SPLITS, splits.SHARES, strict=True)])
    return sums.select("domain", "records", (off <= F.col("most")).alias("near"))


def p5_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of tied seeds by their smallest: how many seeds and records, and in how many splits they lie."""
    rows = splits.assign(*_tables5(spark, d)).filter("seed_id IS NOT NULL")
    seeds = rows.groupBy("component", "seed_id", "split").agg(F.count(F.lit(1)).alias("n"))
    sets = seeds.groupBy("component").agg(F.min("seed_id").alias("seed_id"), F.countDistinct("seed_id").alias("seeds"), F.sum("n").alias("records"), F.countDistinct("split").alias("splits"))
    return sets.drop("component")


def p6_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest(load(spark, d, "pair_vectors")).select(F.col("id").alias("vec_id"), F.col("other").alias("other_vec_id"), "sim")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbors.pairs(neighbors.nearest(load(spark, d, "pair_vectors")))
    return found.select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def _judgments(spark: SparkSession, d: str) -> list[DataFrame]:
    return [load(spark, d, "t04a_judgments_b1"), load(spark, d, "t04b_judgments_b2")]


def p7_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.fit(_judgments(spark, d))[0]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids of which more than half of the votes are false. The votes alone decide, so no expectation-maximisation runs here: it decides p7_consensus and p7_judges."""
    return consensus.shares(_judgments(spark, d)).filter("p_start < 0.5").select("id")


def p7_votes(spark: SparkSession, d: str) -> DataFrame:
    return p7_consensus(spark, d).select("id", "n_votes", "n_false")


def p7_judges(spark: SparkSession, d: str) -> DataFrame:
    return consensus.fit(_judgments(spark, d))[1].withColumnRenamed("annotator", "judge_model")


def p7_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(_judgments(spark, d)).select("n_items", "n_votes", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(load(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.count(load(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sizes(load(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.lacking(mixing.reach(_sizes(spark, d), load(spark, d, "mix_targets")))


def p9_letters(spark: SparkSession, d: str) -> DataFrame:
    """p9_found with sizes in code points in place of tokens, which SQL can count too."""
    counted = load(spark, d, "documents").select("doc_id", fold(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))
    return mixing.lacking(mixing.reach(counted, load(spark, d, "mix_targets")))


def p9_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Slots of each mix and source in the schedule, and the tokens they want, rounded."""
    rows = mixing.slots(mixing.reach(_sizes(spark, d), load(spark, d, "mix_targets")))
    return rows.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.sum("wanted"), 3).alias("wanted"), (F.max("slot") >= F.count(F.lit(1)) - 1).alias("in_turn"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(_sizes(spark, d)), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(cut(_sizes(spark, d)), load(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = spans.Shared(load(spark, d, "documents")).pairs()
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    shared = spans.coverage(spans.parse(spans.Shared(documents).matches()), documents)
    return shared.select(F.col("id").alias("doc_id"), "chars", "shared_chars", F.round("share", 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_scores, p2_found, p2_report, p2_quotas, p2_sample, p3_found, p3_collapsed, p5_found, p5_splits, p5_shares, p5_sets, p6_found,
        p6_neighbors, p7_found, p7_consensus, p7_votes, p7_judges, p7_agreement, p8_ids, p8_counts, p9_found, p9_letters, p9_blocks, p9_mix, p9_shares, p10_found, p10_shared,
    )
}

_BEST = """
WITH latest AS (SELECT id, conf FROM (SELECT id, conf, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS r
                FROM t04a_judgments_b1 WHERE ts IS NOT NULL) WHERE r = 1),
ranked AS (SELECT f.seed_id, f.axis, f.id, coalesce(l.conf, 0) AS conf,
           row_number() OVER (PARTITION BY f.seed_id, f.axis ORDER BY coalesce(l.conf, 0) DESC, f.id) AS r
           FROM t05_final f LEFT JOIN latest l ON f.id = l.id)
"""
_FORMS = r"""
WITH pieces AS (SELECT seed_id, unnest(string_split(concat(coalesce(question, ''), ';', coalesce(answer, '')), ';')) AS p FROM t02_seeds),
clean AS (SELECT seed_id, trim(regexp_replace(lower(p), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS p FROM pieces),
forms AS (SELECT seed_id, coalesce(string_agg(p, ';' ORDER BY p) FILTER (WHERE p <> ''), '') AS form FROM clean GROUP BY seed_id),
firsts AS (SELECT seed_id, min(seed_id) OVER (PARTITION BY form) AS first FROM forms)
"""
_VOTES = """
WITH rows AS (SELECT id, judge_model, axis_ok, ts FROM t04a_judgments_b1 UNION ALL SELECT id, judge_model, axis_ok, ts FROM t04b_judgments_b2),
votes AS (SELECT id, judge_model, axis_ok FROM (SELECT *, row_number() OVER (PARTITION BY id, judge_model ORDER BY ts DESC, axis_ok DESC) AS r
          FROM rows WHERE axis_ok IS NOT NULL AND id IS NOT NULL AND judge_model IS NOT NULL AND ts IS NOT NULL) WHERE r = 1)
"""
_FOLD = r"nullif(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"

_CELLS = f"""
WITH f AS (SELECT {_FOLD.format("domain")} AS domain, {_FOLD.format("axis")} AS axis, {_FOLD.format("expected_label")} AS label FROM t05_final),
c AS (SELECT domain, axis, label, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT plan_id, cell_id, {_FOLD.format("domain")} AS domain, {_FOLD.format("axis")} AS axis, {_FOLD.format("expected_label")} AS label,
      target_share, min_rows, sample_size FROM sample_targets),
n AS (SELECT plan_id, cell_id, target_share, min_rows, sample_size, coalesce(sum(c.n), 0) AS n FROM t LEFT JOIN c
      ON (t.domain IS NULL OR t.domain = c.domain) AND (t.axis IS NULL OR t.axis = c.axis) AND (t.label IS NULL OR t.label = c.label)
      GROUP BY ALL)
"""
_TIED = f"""
WITH RECURSIVE ties AS (SELECT DISTINCT doc_id, 'e' || {_FOLD.format("editor")} AS k FROM source_index WHERE {_FOLD.format("editor")} IS NOT NULL
      UNION SELECT DISTINCT doc_id, 'u' || {_FOLD.format("url")} FROM source_index WHERE {_FOLD.format("url")} IS NOT NULL),
near AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM ties a JOIN ties b ON a.k = b.k),
own AS (SELECT DISTINCT f.seed_id, s.doc_id FROM t05_final f JOIN t02_seeds s ON f.seed_id = s.seed_id WHERE s.doc_id IS NOT NULL),
start AS (SELECT DISTINCT doc_id FROM own),
reach AS (SELECT doc_id AS s, doc_id AS x FROM start UNION SELECT r.s, n.y FROM reach r JOIN near n ON r.x = n.x),
tied AS (SELECT o.seed_id, min(p.seed_id) AS first FROM own o JOIN reach r ON r.s = o.doc_id JOIN own p ON p.doc_id = r.x GROUP BY o.seed_id)
"""

_NEAREST = """
WITH v AS (SELECT vec_id, CAST(vec AS DOUBLE[]) AS vec FROM pair_vectors WHERE vec IS NOT NULL AND list_sum(list_transform(vec, lambda x: x * x)) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM s WHERE sim >= 0.9)
"""
_STRETCHES = f"""
WITH g AS (SELECT doc_id, i, md5(substring(text, i, {spans.LENGTH})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {spans.LENGTH - 2})) AS i FROM documents WHERE length(text) >= {spans.LENGTH})),
k AS (SELECT h, doc_id FROM g GROUP BY ALL), s AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1)
"""

ORACLES = {
    "p10_found": _STRETCHES + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id WHERE a.h IN (SELECT h FROM s)",
    "p10_shared": _STRETCHES + f""", c AS (SELECT doc_id, least({spans.LENGTH}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {spans.LENGTH})) AS n FROM g WHERE h IN (SELECT h FROM s)),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS chars, CAST(coalesce(t.n, 0) AS BIGINT) AS shared_chars, round(coalesce(t.n, 0) / nullif(CAST(length(coalesce(text, '')) AS DOUBLE), 0), 6) AS share FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "p1_found": _BEST + "SELECT seed_id, axis, id FROM ranked WHERE r <= 2",
    "p1_scores": _BEST + "SELECT seed_id, axis, id, conf FROM ranked WHERE r <= 2",
    "p2_found": _CELLS + "SELECT plan_id, cell_id FROM n WHERE n < target_share * sample_size OR n < min_rows",
    "p2_report": _CELLS + "SELECT plan_id, cell_id, CAST(n AS BIGINT) AS available, n < target_share * sample_size OR n < min_rows AS short FROM n",
    "p2_quotas": "SELECT plan_id, count(*) AS cells, CAST(greatest(max(sample_size), sum(min_rows)) AS BIGINT) AS quota, true AS adds_up FROM sample_targets GROUP BY plan_id",
    "p3_found": _FORMS + "SELECT first AS seed_id, seed_id AS copy_seed_id FROM firsts WHERE first <> seed_id",
    "p3_collapsed": _FORMS + "SELECT first AS seed_id, count(*) AS copies FROM firsts GROUP BY first",
    "p5_found": _TIED + "SELECT first AS seed_id, seed_id AS linked_seed_id FROM tied WHERE first <> seed_id",
    "p5_sets": _TIED + """, n AS (SELECT seed_id, count(*) AS n FROM t05_final WHERE seed_id IS NOT NULL GROUP BY seed_id)
SELECT coalesce(t.first, n.seed_id) AS seed_id, count(*) AS seeds, CAST(sum(n) AS BIGINT) AS records, CAST(1 AS BIGINT) AS splits FROM n LEFT JOIN tied t ON n.seed_id = t.seed_id GROUP BY 1""",
    "p5_shares": f"SELECT {_FOLD.format('domain')} AS domain, count(*) AS records, true AS near FROM t05_final GROUP BY 1",
    "p6_found": _NEAREST + "SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE k <= 5",
    "p6_neighbors": _NEAREST + "SELECT a AS vec_id, b AS other_vec_id, sim FROM r WHERE k <= 5",
    "p7_found": _VOTES + "SELECT id FROM votes GROUP BY id HAVING 2 * count(*) FILTER (WHERE NOT axis_ok) > count(*)",
    "p9_letters": f"""
WITH n AS (SELECT {_FOLD.format("source")} AS s, sum(length(coalesce(text, ''))) AS n FROM documents GROUP BY 1)
SELECT mix_id, source FROM mix_targets m LEFT JOIN n ON n.s = {_FOLD.format("m.source")}
WHERE coalesce(n.n, 0) * coalesce(max_uses, 1) < coalesce(target_weight, 0) * coalesce(budget_tokens, 0)""",
    "p9_blocks": f"""
SELECT mix_id, source, CAST(ceil(target_weight * budget_tokens / {mixing.BLOCK}) AS BIGINT) AS blocks, round(target_weight * budget_tokens, 3) AS wanted, true AS in_turn
FROM mix_targets WHERE target_weight * budget_tokens > 0""",
    "p7_votes": _VOTES + "SELECT id, count(*) AS n_votes, count(*) FILTER (WHERE NOT axis_ok) AS n_false FROM votes GROUP BY id",
    "p7_agreement": _VOTES
    + """, items AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE NOT axis_ok) AS f FROM votes GROUP BY id HAVING count(*) > 1),
s AS (SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_votes, CAST(sum(f) AS DOUBLE) AS f, sum(2.0 * f * (n - f) / (n - 1)) AS d FROM items)
SELECT n_items, n_votes, round(d / n_votes, 6) AS observed, round(2 * f * (n_votes - f) / (n_votes * (n_votes - 1.0)), 6) AS expected,
round(1 - (d / n_votes) / (2 * f * (n_votes - f) / (n_votes * (n_votes - 1.0))), 6) AS alpha FROM s""",
}
