"""What queries share: derived relations of a data folder, written once a session, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.taxonomy import AXES, DOMAINS
from bandwright.operators.pairs import pair_cosine, pair_relation
from bandwright.session import cut, load, versions

_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A relation of the folder that several queries read, as scored pairs are: written to the shared folder when first asked
    for, and anew when a table of the folder has changed."""
    key = (spark.sparkContext.applicationId, d, name, versions(spark, d))
    if key not in _KEPT:
        _KEPT[key] = cut(make())
    return _KEPT[key]


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return pair_relation(load(spark, d, "t05_final"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(id, seed_id, domain, lang, axis, axis_group, hit, sim) of every pair."""

    def make():
        p = pairs(spark, d)
        return p.select("id", "seed_id", "domain", "lang", "axis", "axis_group", "hit").join(pair_cosine(p), "id")

    return kept(spark, d, "scored", make)



def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def fold_sql(x: str) -> str:
    return f"nullif(lower({strip_sql(x)}), '')"


def _grams_sql(x: str) -> str:
    text = strip_sql(f"lower(coalesce({x}, ''))")
    return f"(SELECT id, '  ' || {text} || '  ' AS t FROM pairs)"


_AXES = ", ".join(f"('{a}', '{g}', '{y}', {n})" for a, g, y, n in AXES)
TAXONOMY = f"tax(axis, axis_group, label, expected) AS (VALUES {_AXES})"
PAIRS = f"""{TAXONOMY},
pairs AS (SELECT f.id, f.seed_id, {fold_sql("f.domain")} AS domain,
  CASE WHEN {fold_sql("f.domain")} = '{DOMAINS[-1][1]}' THEN 'vi' ELSE 'en' END AS lang, f.axis, t.axis_group, t.label AS expected_label,
  CASE WHEN t.label = 'HIT' THEN 1 ELSE 0 END AS hit, f.seed_question, f.variation, f.answer, f.delta, f.generator_model, f.batch_id, f.judge1, f.judge2, f.ts
  FROM t05_final f JOIN tax t ON f.axis = t.axis)"""
SCORED = f"""{PAIRS},
padded AS (SELECT id, t, 1 AS x, 0 AS y FROM {_grams_sql("seed_question")} UNION ALL SELECT id, t, 0, 1 FROM {_grams_sql("variation")}),
hexes AS (SELECT id, x, y, md5(substring(t, CAST(i AS INT), 3)) AS h FROM (SELECT id, x, y, t, unnest(range(1, length(t) - 1)) AS i FROM padded)),
buckets AS (SELECT id, substring(h, 15, 2) AS b, sum(x * s) AS x, sum(y * s) AS y
  FROM (SELECT *, CASE WHEN substring(h, 14, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END AS s FROM hexes) GROUP BY 1, 2),
sums AS (SELECT id, CAST(sum(x * y) AS BIGINT) AS xy, CAST(sum(x * x) AS BIGINT) AS xx, CAST(sum(y * y) AS BIGINT) AS yy FROM buckets GROUP BY id),
scored AS (SELECT p.id, p.seed_id, p.domain, p.lang, p.axis, p.axis_group, p.hit,
  CASE WHEN s.xx = 0 OR s.yy = 0 THEN 0.0 ELSE CAST(s.xy AS DOUBLE) / sqrt(CAST(s.xx * s.yy AS DOUBLE)) END AS sim FROM pairs p JOIN sums s ON p.id = s.id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]
