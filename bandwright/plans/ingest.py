"""Ingest queries: salvage of raw lines made from the judgment tables, document scans, text functions, near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from bandwright.functions import prompts
from bandwright.functions.draws import digit
from bandwright.functions.taxonomy import DOMAINS
from bandwright.functions.text import normalise_answer, strip
from bandwright.operators import dedupe, windows
from bandwright.plans.base import fold_sql, pairs, strip_sql, with_
from bandwright.schemas import RAW_JUDGMENT
from bandwright.sources import documents, salvage
from bandwright.session import load

SECTION = r"(?md)^(?=[A-Z][a-z]+ \d+$)"


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw log lines of the shapes that occur: by the id's hash digit fenced, cut short, with a quoted boolean, prose, indented, or plain JSON."""
    rows = load(spark, d, "t04a_judgments_b1").filter("id IS NOT NULL")
    line = F.to_json(F.struct("id", "axis_ok", "conf", "issue"), {"ignoreNullFields": "false"})
    h = digit(F.lit("raw"), F.col("id"))
    noisy = (
        F.when(h == 0, F.concat(F.lit("`"), line, F.lit("`")))
        .when(h == 1, F.substring(line, F.lit(1), F.length(line) - 3))
        .when(h == 2, F.regexp_replace(line, r'"axis_ok":(true|false)', r'"axis_ok":"$1"'))
        .when(h == 3, F.concat(F.lit("Auditing item "), F.col("id"), F.lit(":")))
        .when(h == 4, F.concat(F.lit("\t  "), line, F.lit(" ")))
        .when(h == 5, F.lit("```jsonl"))
        .otherwise(line)
    )
    return rows.select(noisy.alias("value"))


def salvage_parse(spark: SparkSession, d: str) -> DataFrame:
    return salvage.tally(salvage.salvage(raw_lines(spark, d), RAW_JUDGMENT))


def salvage_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = salvage.valid_judgments(salvage.good(salvage.salvage(raw_lines(spark, d), RAW_JUDGMENT)))
    return rows.select("id", "axis_ok", "conf")


def route_rows(spark: SparkSession, d: str) -> DataFrame:
    """Facts and seeds of one stream of rows, told apart by type and counted per domain."""
    seeds = load(spark, d, "t02_seeds")
    facts = seeds.filter("fact_ids IS NOT NULL").select(F.lit("fact").alias("type"), F.col("doc_id"), F.explode("fact_ids").alias("x"))
    rows = facts.unionByName(seeds.select(F.lit("seed").alias("type"), "doc_id", F.col("seed_id").alias("x")))
    parts = salvage.route(rows)
    out = [p.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "domain", "n") for k, p in zip(("fact", "seed", "rest"), parts, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def question_loader(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "t05_final").select(F.col("id"), F.lit(None).cast("string").alias("question"), "variation", F.col("seed_question").alias("q2"))
    return documents.questions(rows, "id").withColumnRenamed("position", "id")


def doc_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents of at least 200 characters, cut at 7,000, in order of key."""
    rows = load(spark, d, "documents").select(F.col("doc_key").alias("name"), "text")
    return documents.scan(rows, 200, 7000).withColumnRenamed("name", "doc_key")


def doc_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", "source", "text")
    return documents.quota(rows, "source", "doc_id", 10).select("doc_id", "source", "key")


def sections_until(spark: SparkSession, d: str) -> DataFrame:
    """How many leading paragraphs of a document, and characters, are read until 1,500 are passed."""
    parts = documents.until(F.split(F.coalesce("text", F.lit("")), "\n\n"), 1500)
    kept = load(spark, d, "documents").select("doc_id", parts.alias("p"))
    return kept.select("doc_id", F.size("p").alias("parts"), F.aggregate("p", F.lit(0), lambda s, x: s + F.length(x)).alias("chars"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", F.col("text").alias("html"), documents.html_to_text(F.col("text")).alias("text"))
    return rows.select("doc_id", F.length("html").alias("before"), F.length("text").alias("after"))


def chunk_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.chunks(load(spark, d, "documents"), "doc_id", "title", "text", SECTION, 2, 300, 2)
    return rows.select("doc_id", "chunk", F.length("text").alias("chars"))


def provenance_last(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_index").filter("doc_id IS NOT NULL")
    last = windows.last_wins(rows, ["doc_id"], "retrieved", [F.col("url").asc_nulls_last(), F.col("editor").asc_nulls_last()])
    return last.select("doc_id", "url", "editor", "license")


def provenance_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents numbered within their domain's prefix, with their last known address, null where there is none."""
    rows = load(spark, d, "documents").select("doc_key", F.substring_index("doc_key", "_", 1).alias("prefix"))
    return windows.running_index(rows, ["prefix"], [F.col("doc_key")], "n").join(provenance_last(spark, d).select(F.col("doc_id").alias("doc_key"), "url"), "doc_key", "left")


def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """Per axis a digest of the ids that doesn't depend on their order, and their number: the key of what is kept for them."""
    part = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint")
    return pairs(spark, d).groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest"))


def answer_identity(spark: SparkSession, d: str) -> DataFrame:
    """Normalised answers that several seeds share."""
    a = load(spark, d, "t02_seeds").filter("answer IS NOT NULL").select("seed_id", normalise_answer(F.col("answer")).alias("answer"))
    return a.groupBy("answer").agg(F.countDistinct("seed_id").alias("seeds")).filter("seeds > 1")


def opaque_key(spark: SparkSession, d: str) -> DataFrame:
    """Opaque ids for pairs without a judgment of the second table and a stratified sample of the others."""
    p = pairs(spark, d).select("id", "axis")
    judged = load(spark, d, "t04b_judgments_b2").select("id").distinct()
    missing = p.join(judged, "id", "left_anti").select("id", F.lit("missing").alias("role"))
    sample = windows.stratified_pick(p.join(judged, "id", "left_semi"), "axis", "id", 100).select("id", F.lit("sample").alias("role"))
    return missing.unionByName(sample).select(prompts.opaque_id(F.col("id"), "rerun").alias("opaque_id"), F.col("id").alias("pair_id"), "role")


def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """A judge prompt per pair from a template with slots, and its digest."""
    t = F.lit("Axis {axis}. Cached: {q}\nNew: {v}\nDelta: {delta}")
    x = lambda c: F.coalesce(c, F.lit(""))
    p = pairs(spark, d)
    text = prompts.fill(t, {"axis": x("axis"), "q": x("seed_question"), "v": x("variation"), "delta": x("delta")})
    return p.select("id", F.length(text).alias("chars"), prompts.digest(text, 16).alias("digest"))


def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language in one spelling: number, blank ones, code points, and rows whose n_chars says otherwise."""
    rows = load(spark, d, "documents").withColumn("lang", F.lower(strip(F.col("lang"))))
    n = F.length(F.coalesce("text", F.lit("")))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(strip(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.sum(n).alias("chars"), F.count_if(n != F.col("n_chars")).alias("other"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("id", F.lower(F.concat(F.col("seed_id"), F.coalesce("variation", F.lit("")))).alias("text"))


def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    """Rows by whether their text came before within the seed."""
    p = pairs(spark, d).filter("variation IS NOT NULL").select("id", "seed_id", "variation")
    w = Window.partitionBy("seed_id", "variation").orderBy("id")
    return p.select("id", (F.row_number().over(w) > 1).alias("repeated"))


def dedupe_lsh(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.lsh(_keyed(spark, d), "id", "text")


def dedupe_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.jaccard(_keyed(spark, d), "id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        salvage_parse, salvage_rows, route_rows, question_loader, doc_scan, doc_quota, sections_until, html_to_text, chunk_articles, provenance_last,
        provenance_index, table_digest, answer_identity, opaque_key, prompt_lines, document_lengths, dedupe_exact, dedupe_lsh, dedupe_jaccard,
    )
}

_H = "SELECT *, substring(md5('raw:' || id), 1, 1) AS h FROM t04a_judgments_b1 WHERE id IS NOT NULL"
_PROV = "prov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY retrieved DESC NULLS LAST, url NULLS LAST, editor NULLS LAST) AS r FROM source_index WHERE doc_id IS NOT NULL) WHERE r = 1)"
_PREFIX = "CASE " + " ".join(f"WHEN starts_with(doc_id, '{k}_') THEN '{n}'" for k, n in DOMAINS) + " END"
_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
ORACLES = {
    "salvage_parse": f"SELECT count(*) FILTER (WHERE h NOT IN ('3', '5')) AS candidates, count(*) FILTER (WHERE h NOT IN ('1', '3', '5') AND NOT (h = '2' AND axis_ok IS NOT NULL)) AS parsed, count(*) FILTER (WHERE h = '1' OR (h = '2' AND axis_ok IS NOT NULL)) AS bad FROM ({_H})",
    "salvage_rows": f"SELECT id, axis_ok, conf FROM ({_H}) WHERE h NOT IN ('1', '2', '3', '5') AND axis_ok IS NOT NULL AND conf BETWEEN 0 AND 1",
    "route_rows": f"WITH x AS (SELECT 'fact' AS t, doc_id, unnest(fact_ids) AS x FROM t02_seeds UNION ALL SELECT 'seed', doc_id, seed_id FROM t02_seeds), y AS (SELECT t, {_PREFIX} AS domain FROM x) SELECT CASE WHEN domain IS NULL THEN 'rest' ELSE t END AS kind, domain, count(*) AS n FROM y GROUP BY 1, 2",
    "question_loader": f"WITH x AS (SELECT id, 0 AS k, nullif({strip_sql('variation')}, '') AS q FROM t05_final UNION ALL SELECT id, 1, nullif({strip_sql('seed_question')}, '') FROM t05_final) SELECT id, q AS question FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id, k) AS r FROM x WHERE q IS NOT NULL) WHERE r = 1",
    "doc_scan": "SELECT doc_key, substring(text, 1, 7000) AS text FROM documents WHERE length(text) >= 200",
    "doc_quota": "SELECT doc_id, source, source || '_' || doc_id AS key FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IS NOT NULL AND length(text) >= 3000) WHERE r <= 5",
    "sections_until": "WITH p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) AS l FROM documents)), c AS (SELECT doc_id, s, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT doc_id, CAST(count(*) AS INT) AS parts, CAST(sum(length(s)) AS INT) AS chars FROM c WHERE b <= 1500 GROUP BY doc_id",
    "chunk_articles": rf"""WITH p AS (SELECT doc_id, title, string_split(regexp_replace(text, '(?m)^([A-Z][a-z]+ \d+)$', chr(1) || '\1', 'g'), chr(1)) AS l FROM documents),
a AS (SELECT doc_id, title, list_filter(l, lambda y: regexp_matches(y, '(?m)^[A-Z][a-z]+ \d+$')) AS l FROM p), e AS (SELECT doc_id, title, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS y FROM a WHERE len(l) >= 2),
c AS (SELECT doc_id, title, CAST(floor(i / 2) AS INT) AS chunk, string_agg(y, '' ORDER BY i) AS body FROM e GROUP BY ALL),
t AS (SELECT doc_id, chunk, concat_ws(chr(10) || chr(10), title, {strip_sql('body')}) AS text FROM c) SELECT doc_id, chunk, CAST(length(text) AS INT) AS chars FROM t WHERE length(text) >= 300""",
    "provenance_last": with_(_PROV) + "SELECT doc_id, url, editor, license FROM prov",
    "provenance_index": with_(_PROV, "d AS (SELECT doc_key, string_split(doc_key, '_')[1] AS prefix FROM documents)") + "SELECT d.doc_key, prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY d.doc_key) AS INT) AS n, url FROM d LEFT JOIN prov ON d.doc_key = prov.doc_id",
    "table_digest": "SELECT axis, count(*) AS n, CAST(sum(CAST('0x' || substring(md5(id), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM t05_final WHERE axis IN ('P1', 'P2', 'P3', 'N1', 'N2', 'N3', 'N4', 'N5', 'N6') GROUP BY axis",
    "answer_identity": "WITH a AS (SELECT seed_id, " + strip_sql(rf"regexp_replace(regexp_replace(lower(answer), '[^{_WORD}\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')") + " AS answer FROM t02_seeds WHERE answer IS NOT NULL) SELECT answer, count(DISTINCT seed_id) AS seeds FROM a GROUP BY answer HAVING count(DISTINCT seed_id) > 1",
    "opaque_key": "WITH p AS (SELECT id, axis FROM t05_final WHERE axis IN ('P1', 'P2', 'P3', 'N1', 'N2', 'N3', 'N4', 'N5', 'N6')), j AS (SELECT DISTINCT id FROM t04b_judgments_b2), s AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY substring(md5('pick:' || id), 1, 15), id) AS r FROM p WHERE id IN (SELECT id FROM j)), u AS (SELECT id, 'missing' AS role FROM p WHERE id NOT IN (SELECT id FROM j) UNION ALL SELECT id, 'sample' FROM s WHERE r <= 100) SELECT 'q' || substring(sha256('rerun:' || id), 1, 10) AS opaque_id, id AS pair_id, role FROM u",
    "prompt_lines": "WITH t AS (SELECT id, 'Axis ' || axis || '. Cached: ' || coalesce(seed_question, '') || chr(10) || 'New: ' || coalesce(variation, '') || chr(10) || 'Delta: ' || CASE WHEN starts_with(axis, 'N') THEN coalesce(delta, '') ELSE '' END AS t FROM t05_final WHERE axis IN ('P1', 'P2', 'P3', 'N1', 'N2', 'N3', 'N4', 'N5', 'N6')) SELECT id, CAST(length(t) AS INT) AS chars, substring(sha256(t), 1, 16) AS digest FROM t",
    "document_lengths": f"SELECT lower({strip_sql('lang')}) AS lang, count(*) AS n, count(*) FILTER (WHERE coalesce({fold_sql('text')}, '') = '') AS blank, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, count(*) FILTER (WHERE length(coalesce(text, '')) <> n_chars) AS other FROM documents GROUP BY 1",
    "dedupe_exact": "SELECT id, row_number() OVER (PARTITION BY seed_id, variation ORDER BY id) > 1 AS repeated FROM t05_final WHERE variation IS NOT NULL AND axis IN ('P1', 'P2', 'P3', 'N1', 'N2', 'N3', 'N4', 'N5', 'N6')",
}
