"""Relational queries over the stage tables: composition, joins, upserts, picks, samples, validators, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.taxonomy import DOMAINS, NAMES, axis_group, domain_of, expected_label
from bandwright.functions.text import strip
from bandwright.operators import freeze, ledger, validate, windows
from bandwright.plans.base import PAIRS, TAXONOMY, pairs, strip_sql, with_
from bandwright.session import load
from bandwright.sources import reports

SAMPLE = 5000


def pairs_composition(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("axis").pivot("domain", [n for _, n in DOMAINS]).count().na.fill(0)


def axis_weakest(spark: SparkSession, d: str) -> DataFrame:
    counts = pairs(spark, d).groupBy("domain", "axis").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("domain").agg(F.min(F.struct("n", "axis")).alias("m"), F.sum("n").alias("all")).select("domain", "m.axis", "m.n", F.round(F.col("m.n") / F.col("all"), 6).alias("share"))


def composition_report(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for c in ("axis", "axis_group", "expected_label", "domain", "lang"):
        line = reports.distribution(pairs(spark, d), c).select(F.lit(c).alias("field"), "report")
        out = line if out is None else out.unionByName(line)
    return out


def seeds_per_domain(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("domain").agg(F.countDistinct("seed_id").alias("seeds"), F.count(F.lit(1)).alias("pairs"))


def judge_join_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = freeze.judged(load(spark, d, "t05_final"), load(spark, d, "t04a_judgments_b1"), load(spark, d, "t04b_judgments_b2"))
    return freeze.passed(rows).select("id", F.col("judge1.axis_ok").alias("ok1"), F.col("judge1.conf").alias("conf1"), F.col("judge2.axis_ok").alias("ok2"))


def topk_per_seed_axis(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).select("id", "seed_id", "axis", F.col("judge1.conf").alias("conf"))
    return windows.top_of_axes(rows, ["N4", "N5"], 2, ["seed_id", "axis"], "conf", "id").select("id")


def freeze_benchmark(spark: SparkSession, d: str) -> DataFrame:
    rows = freeze.frozen(load(spark, d, "t03_variations"), load(spark, d, "t04a_judgments_b1"), load(spark, d, "t04b_judgments_b2"))
    return rows.select("id", "axis_group", "expected_label", F.col("judge1.axis_ok").alias("ok1"), F.col("judge2.axis_ok").alias("ok2"))


def unjudged_anti(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "t05_final").join(load(spark, d, "t04a_judgments_b1").select("id"), "id", "left_anti").select("id", "axis", "seed_question", "answer", "variation", "delta")


def judged_semi(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "t05_final").join(load(spark, d, "t04b_judgments_b2").select("id"), "id", "left_semi").select("id", "axis")


def unused_seeds(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "t02_seeds").join(load(spark, d, "t05_final").select("seed_id"), "seed_id", "left_anti").select("seed_id", "domain")


def unseeded_documents(spark: SparkSession, d: str) -> DataFrame:
    seeds = load(spark, d, "t02_seeds").select(F.col("doc_id").alias("doc_key"))
    return load(spark, d, "documents").join(seeds, "doc_key", "left_anti").select("doc_id", "doc_key")


def last_judgment(spark: SparkSession, d: str) -> DataFrame:
    return windows.last_wins(load(spark, d, "t04a_judgments_b1"), ["id"], "ts").select("id", "judge_model", "axis_ok", "conf")


def first_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "t05_final").filter("variation IS NOT NULL")
    return windows.first_wins(rows, ["seed_id", "variation"], [F.col("id")]).select("id", "seed_id")


def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    last = lambda t, s: windows.last_wins(load(spark, d, t).filter("axis_ok IS NOT NULL"), ["id"], "ts").select("id", "axis_ok", F.lit(s).alias("source"))
    return freeze.filled(last("t04a_judgments_b1", "original"), last("t04b_judgments_b2", "rerun"))


def assemble_variations(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "t03_variations").select("seed_id", "axis", F.col("variation").alias("text"), "ts")
    return freeze.assembled(raw, load(spark, d, "t02_seeds"), [F.col("ts").asc_nulls_last(), F.col("axis"), F.md5("text")]).select("id", "seed_id", "axis", "text")


def derive_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored group or label, blanks and case aside, isn't the one the axis gives."""
    rows = load(spark, d, "t05_final").filter(F.col("axis").isin(NAMES))
    y, g = expected_label(F.col("axis")), axis_group(F.col("axis"))
    stored = F.upper(strip(F.col("expected_label")))
    return rows.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.count_if(stored != y).alias("other_label"), F.count_if(F.col("expected_label").isNull()).alias("no_label"), F.count_if(F.col("axis_group") != g).alias("other_group"))


def parse_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "t05_final").select("id", "seed_id", "axis")
    seed, axis = F.substring_index("id", "_", 2), F.element_at(F.split("id", "_"), -2)
    return rows.groupBy(domain_of(F.col("id")).alias("domain"), axis.alias("axis")).agg(F.count(F.lit(1)).alias("n"), F.count_if(seed != F.col("seed_id")).alias("other_seed"))


def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.running_index(load(spark, d, "t02_seeds").select("seed_id", domain_of(F.col("seed_id")).alias("domain")), ["domain"], [F.col("seed_id")])
    return rows.select("seed_id", F.format_string("%s_f%05d", F.substring_index("seed_id", "_", 1), "k").alias("fact_id"))


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "t02_seeds").withColumn("domain", domain_of(F.col("seed_id")))
    return windows.round_robin(rows, "domain", "doc_id", "seed_id", 400).select("seed_id", "domain")


def first_n_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "t02_seeds").withColumn("domain", domain_of(F.col("seed_id")))
    return windows.first_n(rows, ["domain"], [F.col("seed_id")], 20).select("seed_id", "domain")


def capped_sources(spark: SparkSession, d: str) -> DataFrame:
    """At most 4 documents of a source, in order of id, and of these the first 60."""
    rows = load(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", "source")
    return windows.first_n(rows, ["source"], [F.col("doc_id")], 4).orderBy("doc_id").limit(60)


def family_sample(spark: SparkSession, d: str) -> DataFrame:
    return windows.family_sample(pairs(spark, d).select("id", "seed_id"), "seed_id", SAMPLE)


def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    return windows.stratified_pick(pairs(spark, d).select("id", "axis"), "axis", "id", 100)


def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return windows.batches(load(spark, d, "t05_final").select("id"), [F.col("id")], 60)


def line_slice(spark: SparkSession, d: str) -> DataFrame:
    return windows.slice_rows(load(spark, d, "t05_final").select("id", "axis"), [F.col("id")], 101, 340)


def contract_deviation(spark: SparkSession, d: str) -> DataFrame:
    final = load(spark, d, "t05_final")
    return validate.deviations(final.select("seed_id"), final.select("seed_id", "axis"))


def validate_seeds(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(load(spark, d, "t02_seeds"), validate.seeds())


def validate_variations(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(load(spark, d, "t03_variations"), validate.variations())


def validate_judgments(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(load(spark, d, "t04a_judgments_b1"), validate.judgments())


def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    """Per table of judgments the compliance rate and whether it reaches 80 %; per axis table the weakest share and whether it reaches 8 %."""
    rate = lambda t: load(spark, d, t).agg(F.avg(F.col("axis_ok").cast("int")).alias("value")).select(F.lit(f"compliance {t}").alias("gate"), F.round("value", 6).alias("value"), (F.col("value") >= 0.8).alias("ok"))
    counts = pairs(spark, d).groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
    weak = counts.agg((F.min("n") / F.sum("n")).alias("value")).select(F.lit("weakest axis").alias("gate"), F.round("value", 6).alias("value"), (F.col("value") >= 0.08).alias("ok"))
    return rate("t04a_judgments_b1").unionByName(rate("t04b_judgments_b2")).unionByName(weak)


def judged_both(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "t04a_judgments_b1").select("id").intersect(load(spark, d, "t04b_judgments_b2").select("id"))


def judged_once(spark: SparkSession, d: str) -> DataFrame:
    """Ids in one of the two judgment tables only: empty if the sets are equal."""
    a, b = (load(spark, d, t).select("id").distinct() for t in ("t04a_judgments_b1", "t04b_judgments_b2"))
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def pooled_axes(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select("id", "axis")
    return p.filter("axis = 'P1'").unionByName(p.filter("axis = 'P2'")).unionByName(p.filter("axis = 'P3'")).select("id", F.lit("P").alias("axis"))


def batches_judged(spark: SparkSession, d: str) -> DataFrame:
    """Batches of variations and whether all their ids are judged."""
    rows = load(spark, d, "t03_variations").filter("id IS NOT NULL AND batch_id IS NOT NULL").select("batch_id", strip(F.col("id")).alias("id")).distinct()
    marks = rows.join(load(spark, d, "t04a_judgments_b1").select("id").distinct().withColumn("ok", F.lit(True)), "id", "left")
    return marks.groupBy("batch_id").agg(F.count(F.lit(1)).alias("ids"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("judged"))


def shared_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "t02_seeds").filter("answer IS NOT NULL").groupBy(F.lower(strip(F.col("answer"))).alias("answer"))
    return rows.agg(F.countDistinct("seed_id").alias("seeds")).filter("seeds > 1")


def default_axis(spark: SparkSession, d: str) -> DataFrame:
    """Judgments per axis of the pair they judge, '?' where the pair isn't in the final table."""
    rows = load(spark, d, "t04a_judgments_b1").select("id", "axis_ok").join(load(spark, d, "t05_final").select("id", "axis"), "id", "left")
    return rows.groupBy(F.coalesce("axis", F.lit("?")).alias("axis")).agg(F.count(F.lit(1)).alias("n"), F.count_if("axis_ok").alias("ok"))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """Batches of the stages: done if over 0.9 of the judgments pass, failed if under 0.8, else pending."""
    out = None
    for pos, (stage, table) in enumerate((("B1", "t04a_judgments_b1"), ("B2", "t04b_judgments_b2"))):
        t = load(spark, d, table).filter("batch_id IS NOT NULL").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("axis_ok").cast("int")).alias("p"), F.max("ts").alias("ts"))
        t = t.select(F.lit(stage).alias("stage"), F.lit(pos).alias("stage_pos"), "batch_id", F.when(F.coalesce("p", F.lit(0.85)).between(0.8, 0.9), "pending").when(F.col("p") < 0.8, "failed").otherwise("done").alias("status"), "n", "ts", F.when(F.col("p") < 0.8, "low compliance").alias("note"))
        out = t if out is None else out.unionByName(t)
    return out


def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ledger.roll_up(ledger.state(_ledger(spark, d)))


def ledger_next(spark: SparkSession, d: str) -> DataFrame:
    return ledger.next_pending(ledger.state(_ledger(spark, d))).select("stage", "batch_id", "status")


def ledger_notes(spark: SparkSession, d: str) -> DataFrame:
    return ledger.last_notes(_ledger(spark, d))


def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Orders and lines by market segment, by return flag, by both and in all, in one pass of grouping sets."""
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.cube("c_mktsegment", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("o_orderkey").alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        pairs_composition, axis_weakest, composition_report, seeds_per_domain, judge_join_filter, topk_per_seed_axis, freeze_benchmark, unjudged_anti, judged_semi,
        unused_seeds, unseeded_documents, last_judgment, first_texts, fill_missing, assemble_variations, derive_labels, parse_ids, sequence_ids, round_robin,
        first_n_seeds, capped_sources, family_sample, stratified_pick, batch_assign, line_slice, contract_deviation, validate_seeds, validate_variations,
        validate_judgments, quality_gates, judged_both, judged_once, pooled_axes, batches_judged, shared_answers, default_axis, ledger_rollup, ledger_next,
        ledger_notes, order_statistics,
    )
}

_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, judge_model, batch_id) AS r FROM {0} WHERE {1}) WHERE r = 1)"
_DOMAIN = lambda c: "CASE " + " ".join(f"WHEN starts_with({c}, '{k}_') THEN '{n}'" for k, n in DOMAINS) + " END"
_DOMS = ", ".join(f"count(*) FILTER (WHERE domain = '{n}') AS {n}" for _, n in DOMAINS)
_LEDGER = "led AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS stage, {i} AS stage_pos, batch_id, CASE WHEN coalesce(p, 0.85e0) BETWEEN 0.8e0 AND 0.9e0 THEN 'pending' WHEN p < 0.8e0 THEN 'failed' ELSE 'done' END AS status, n, ts, CASE WHEN p < 0.8e0 THEN 'low compliance' END AS note "
    f"FROM (SELECT batch_id, count(*) AS n, avg(CAST(axis_ok AS INT)) AS p, max(ts) AS ts FROM {t} WHERE batch_id IS NOT NULL GROUP BY batch_id)"
    for i, (s, t) in enumerate((("B1", "t04a_judgments_b1"), ("B2", "t04b_judgments_b2")))
) + ")"
_SEEDS = f"s AS (SELECT *, {_DOMAIN('seed_id')} AS dom FROM t02_seeds)"


def _first_missing(fields: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {f} IS NULL OR {f} = '' THEN '{f} is absent or empty' END" for f in fields) + ")"


def _report(table: str, fields: list[str], checks: list[tuple[str, str]]) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS problem FROM g WHERE gate IS NULL AND ({c})" for c, m in checks)
    return f"WITH {TAXONOMY}, g AS (SELECT x.*, {_first_missing(fields)} AS gate FROM {table} x), p AS (SELECT gate AS problem FROM g WHERE gate IS NOT NULL UNION ALL {each}) SELECT problem, count(*) AS n FROM p GROUP BY problem"


_KNOWN = "axis IN (" + ", ".join(f"'{a}'" for a in NAMES) + ")"
ORACLES = {
    "pairs_composition": with_(PAIRS) + f"SELECT axis, {_DOMS} FROM pairs GROUP BY axis",
    "axis_weakest": with_(PAIRS, "c AS (SELECT domain, axis, count(*) AS n FROM pairs GROUP BY ALL)", "r AS (SELECT *, sum(n) OVER (PARTITION BY domain) AS t, row_number() OVER (PARTITION BY domain ORDER BY n, axis) AS r FROM c)") + "SELECT domain, axis, n, round(n / CAST(t AS DOUBLE), 6) AS share FROM r WHERE r = 1",
    "composition_report": with_(PAIRS) + " UNION ALL ".join(f"SELECT '{c}' AS field, string_agg(k || ':' || n, '  ' ORDER BY k) AS report FROM (SELECT coalesce({c}, '?') AS k, count(*) AS n FROM pairs GROUP BY 1)" for c in ("axis", "axis_group", "expected_label", "domain", "lang")),
    "seeds_per_domain": with_(PAIRS) + "SELECT domain, count(DISTINCT seed_id) AS seeds, count(*) AS pairs FROM pairs GROUP BY domain",
    "judge_join_filter": f"SELECT f.id, a.axis_ok AS ok1, a.conf AS conf1, b.axis_ok AS ok2 FROM t05_final f LEFT JOIN {_LAST.format('t04a_judgments_b1', 'id IS NOT NULL')} a ON {strip_sql('f.id')} = a.id LEFT JOIN {_LAST.format('t04b_judgments_b2', 'id IS NOT NULL')} b ON f.id = b.id WHERE a.axis_ok",
    "topk_per_seed_axis": with_(PAIRS, "r AS (SELECT id, axis, row_number() OVER (PARTITION BY seed_id, axis ORDER BY coalesce(judge1.conf, 0) DESC, id) AS r FROM pairs)") + "SELECT id FROM r WHERE axis NOT IN ('N4', 'N5') OR r <= 2",
    "freeze_benchmark": f"""WITH {TAXONOMY}, v AS (SELECT * EXCLUDE (id), {strip_sql('id')} AS id FROM t03_variations WHERE id IS NOT NULL),
o AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts NULLS LAST, batch_id NULLS LAST, axis NULLS LAST) AS r FROM v) WHERE r = 1),
j AS (SELECT o.id, o.seed_id, o.axis, t.axis_group, t.label AS expected_label, a.axis_ok AS ok1, a.conf, b.axis_ok AS ok2 FROM o JOIN tax t ON o.axis = t.axis
  LEFT JOIN {_LAST.format('t04a_judgments_b1', 'id IS NOT NULL')} a ON o.id = a.id LEFT JOIN {_LAST.format('t04b_judgments_b2', 'id IS NOT NULL')} b ON o.id = b.id WHERE a.axis_ok),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_id, axis ORDER BY coalesce(conf, 0) DESC, id) AS r FROM j)
SELECT id, axis_group, expected_label, ok1, ok2 FROM r WHERE axis NOT IN ('N4', 'N5') OR r <= 2""",
    "unjudged_anti": "SELECT id, axis, seed_question, answer, variation, delta FROM t05_final WHERE NOT EXISTS (SELECT 1 FROM t04a_judgments_b1 j WHERE j.id = t05_final.id)",
    "judged_semi": "SELECT id, axis FROM t05_final WHERE EXISTS (SELECT 1 FROM t04b_judgments_b2 j WHERE j.id = t05_final.id)",
    "unused_seeds": "SELECT seed_id, domain FROM t02_seeds WHERE NOT EXISTS (SELECT 1 FROM t05_final f WHERE f.seed_id = t02_seeds.seed_id)",
    "unseeded_documents": "SELECT doc_id, doc_key FROM documents WHERE NOT EXISTS (SELECT 1 FROM t02_seeds s WHERE s.doc_id = documents.doc_key)",
    "last_judgment": "SELECT id, judge_model, axis_ok, conf FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST) AS r FROM t04a_judgments_b1) WHERE r = 1",
    "first_texts": "SELECT min(id) AS id, seed_id FROM t05_final WHERE variation IS NOT NULL GROUP BY seed_id, variation",
    "fill_missing": f"WITH a AS {_LAST.format('t04a_judgments_b1', 'axis_ok IS NOT NULL')}, b AS {_LAST.format('t04b_judgments_b2', 'axis_ok IS NOT NULL')} SELECT id, axis_ok, 'original' AS source FROM a UNION ALL SELECT id, axis_ok, 'rerun' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = b.id)",
    "assemble_variations": f"""WITH {TAXONOMY}, v AS (SELECT v.seed_id, v.axis, {strip_sql('v.variation')} AS text, v.ts, {strip_sql('s.question')} AS q FROM t03_variations v JOIN t02_seeds s ON v.seed_id = s.seed_id JOIN tax ON v.axis = tax.axis),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, text ORDER BY ts NULLS LAST, axis, md5(text)) AS r FROM v WHERE text <> '' AND text <> coalesce(q, '')) WHERE r = 1)
SELECT seed_id || '_' || axis || '_v' || row_number() OVER (PARTITION BY seed_id, axis ORDER BY ts NULLS LAST, axis, md5(text)) AS id, seed_id, axis, text FROM n""",
    "derive_labels": f"WITH {TAXONOMY} SELECT f.axis, count(*) AS n, count(*) FILTER (WHERE upper({strip_sql('f.expected_label')}) <> t.label) AS other_label, count(*) FILTER (WHERE f.expected_label IS NULL) AS no_label, count(*) FILTER (WHERE f.axis_group <> t.axis_group) AS other_group FROM t05_final f JOIN tax t ON f.axis = t.axis GROUP BY f.axis",
    "parse_ids": f"SELECT {_DOMAIN('id')} AS domain, string_split(id, '_')[-2] AS axis, count(*) AS n, count(*) FILTER (WHERE string_split(id, '_')[1] || '_' || string_split(id, '_')[2] <> seed_id) AS other_seed FROM t05_final GROUP BY 1, 2",
    "sequence_ids": with_(_SEEDS) + "SELECT seed_id, string_split(seed_id, '_')[1] || '_f' || lpad(CAST(row_number() OVER (PARTITION BY dom ORDER BY seed_id) AS VARCHAR), 5, '0') AS fact_id FROM s",
    "round_robin": with_(_SEEDS, "t AS (SELECT *, row_number() OVER (PARTITION BY dom, doc_id ORDER BY seed_id) AS turn, min(seed_id) OVER (PARTITION BY dom, doc_id) AS began FROM s)", "r AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY turn, began, seed_id) AS r FROM t)") + "SELECT seed_id, dom AS domain FROM r WHERE r <= 400",
    "first_n_seeds": with_(_SEEDS, "r AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY seed_id) AS r FROM s)") + "SELECT seed_id, dom AS domain FROM r WHERE r <= 20",
    "capped_sources": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IS NOT NULL) WHERE r <= 4 ORDER BY doc_id LIMIT 60",
    "family_sample": with_(PAIRS, "f AS (SELECT seed_id, count(*) AS n FROM pairs GROUP BY seed_id)", "c AS (SELECT seed_id, coalesce(sum(n) OVER (ORDER BY substring(md5('family:' || seed_id), 1, 15) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)") + f"SELECT id, seed_id FROM pairs WHERE seed_id IN (SELECT seed_id FROM c WHERE b < {SAMPLE})",
    "stratified_pick": with_(PAIRS, "r AS (SELECT id, axis, row_number() OVER (PARTITION BY axis ORDER BY substring(md5('pick:' || id), 1, 15), id) AS r FROM pairs)") + "SELECT id, axis FROM r WHERE r <= 100",
    "batch_assign": "SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 60) AS BIGINT) AS batch FROM t05_final",
    "line_slice": "SELECT id, axis FROM (SELECT id, axis, row_number() OVER (ORDER BY id) AS r FROM t05_final) WHERE r BETWEEN 101 AND 340",
    "contract_deviation": f"WITH {TAXONOMY}, s AS (SELECT DISTINCT seed_id FROM t05_final), c AS (SELECT seed_id, axis, count(*) AS n FROM t05_final GROUP BY ALL) SELECT s.seed_id, t.axis, t.expected, coalesce(c.n, 0) AS actual FROM s CROSS JOIN tax t LEFT JOIN c ON s.seed_id = c.seed_id AND t.axis = c.axis WHERE coalesce(c.n, 0) <> t.expected",
    "validate_seeds": _report("t02_seeds", ["seed_id", "domain", "question", "answer"], [("NOT regexp_full_match(seed_id, 'd[1-5]_s[0-9]{4,}')", "seed_id has another form"), ("domain NOT IN (" + ", ".join(f"'{n}'" for _, n in DOMAINS) + ")", "domain is not one of the five")]),
    "validate_variations": _report("t03_variations", ["id", "seed_id", "variation", "axis", "axis_group", "expected_label", "generator_model", "batch_id"], [
        ("NOT regexp_full_match(id, 'd[1-5]_s[0-9]{4,}_(P[1-3]|N[1-6])_v[0-9]+')", "id has another form"), (f"NOT {_KNOWN}", "axis is not in the taxonomy"),
        ("EXISTS (SELECT 1 FROM tax t WHERE t.axis = g.axis AND t.axis_group <> g.axis_group)", "axis_group is another axis'' group"), ("EXISTS (SELECT 1 FROM tax t WHERE t.axis = g.axis AND t.label <> g.expected_label)", "expected_label is not the axis'' label"),
        (f"{_KNOWN} AND starts_with(axis, 'N') AND coalesce(delta, '') = ''", "a change axis needs a delta")]),
    "validate_judgments": _report("t04a_judgments_b1", ["id", "judge_model", "batch_id"], [("axis_ok IS NULL", "no verdict"), ("NOT coalesce(conf BETWEEN 0 AND 1, false)", "confidence outside 0 to 1")]),
    "quality_gates": with_(PAIRS, "c AS (SELECT axis, count(*) AS n FROM pairs GROUP BY axis)", "g AS (SELECT 'compliance t04a_judgments_b1' AS gate, avg(CAST(axis_ok AS INT)) AS v, 0.8e0 AS need FROM t04a_judgments_b1 UNION ALL SELECT 'compliance t04b_judgments_b2', avg(CAST(axis_ok AS INT)), 0.8e0 FROM t04b_judgments_b2 UNION ALL SELECT 'weakest axis', min(n) / CAST(sum(n) AS DOUBLE), 0.08e0 FROM c)") + "SELECT gate, round(v, 6) AS value, v >= need AS ok FROM g",
    "judged_both": "SELECT id FROM t04a_judgments_b1 INTERSECT SELECT id FROM t04b_judgments_b2",
    "judged_once": "(SELECT id, 'a' AS side FROM (SELECT id FROM t04a_judgments_b1 EXCEPT SELECT id FROM t04b_judgments_b2)) UNION ALL (SELECT id, 'b' FROM (SELECT id FROM t04b_judgments_b2 EXCEPT SELECT id FROM t04a_judgments_b1))",
    "pooled_axes": with_(PAIRS) + "SELECT id, 'P' AS axis FROM pairs WHERE axis IN ('P1', 'P2', 'P3')",
    "batches_judged": f"WITH v AS (SELECT DISTINCT batch_id, {strip_sql('id')} AS id FROM t03_variations WHERE id IS NOT NULL AND batch_id IS NOT NULL), j AS (SELECT DISTINCT id FROM t04a_judgments_b1) SELECT batch_id, count(*) AS ids, bool_and(j.id IS NOT NULL) AS judged FROM v LEFT JOIN j ON v.id = j.id GROUP BY batch_id",
    "shared_answers": f"SELECT lower({strip_sql('answer')}) AS answer, count(DISTINCT seed_id) AS seeds FROM t02_seeds WHERE answer IS NOT NULL GROUP BY 1 HAVING count(DISTINCT seed_id) > 1",
    "default_axis": "SELECT coalesce(f.axis, '?') AS axis, count(*) AS n, count(*) FILTER (WHERE j.axis_ok) AS ok FROM t04a_judgments_b1 j LEFT JOIN t05_final f ON j.id = f.id GROUP BY 1",
    "ledger_rollup": with_(_LEDGER) + "SELECT stage, count(*) AS batches, CAST(sum(n) AS BIGINT) AS rows, CASE WHEN bool_and(status = 'done') THEN 'done' WHEN bool_and(status IN ('done', 'failed')) THEN 'done_with_failures' WHEN bool_or(status <> 'pending') THEN 'running' ELSE 'pending' END AS status FROM led GROUP BY stage",
    "ledger_next": with_(_LEDGER) + "SELECT stage, batch_id, status FROM led WHERE status = 'pending' ORDER BY stage_pos, batch_id LIMIT 1",
    "ledger_notes": with_(_LEDGER) + "SELECT ts, batch_id, note FROM led WHERE note IS NOT NULL ORDER BY ts DESC, batch_id DESC LIMIT 5",
    "order_statistics": "SELECT c_mktsegment, l_returnflag, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, l_returnflag)",
}
