"""Queries of sources, sinks and guards: tables go through a sink into the shared folder and come back through a source."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from bandwright.functions import encoders, prompts, text, vectors
from bandwright.functions.draws import digit
from bandwright.functions.taxonomy import DOMAINS, domain_of
from bandwright.functions.text import strip
from bandwright.operators import agreement, decision, ledger, validate, windows
from bandwright.plans.agreement import RATED, RATERS, rated
from bandwright.plans.base import PAIRS, fold_sql, pairs, strip_sql, with_
from bandwright.plans.decision import VERIFIED
from bandwright.plans.ingest import raw_lines
from bandwright.plans.relational import _LEDGER, _SEEDS, _ledger
from bandwright.schemas import RAW_JUDGMENT
from bandwright.session import load, scratch
from bandwright.sources import documents, jsonl, salvage
from bandwright.streaming import gaps

JUDGED = StructType([StructField("id", StringType()), StructField("judge_model", StringType()), StructField("axis_ok", BooleanType()), StructField("conf", DoubleType()), StructField("issue", StringType()), StructField("batch_id", StringType())])


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "t04a_judgments_b1").select(*JUDGED.names)


def jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    """The judgments written as JSON lines and read strictly."""
    jsonl.overwrite(_judgments(spark, d), path := scratch(spark))
    return jsonl.read_strict(spark, path, JUDGED)


def jsonl_lenient(spark: SparkSession, d: str) -> DataFrame:
    """The raw log lines read leniently: what isn't a record with an id is skipped."""
    raw_lines(spark, d).write.text(path := scratch(spark))
    return jsonl.read_lenient(spark, path, RAW_JUDGMENT, "id")


def jsonl_appended(spark: SparkSession, d: str) -> DataFrame:
    """The judgments appended in two parts to one stage table, passed ones first."""
    rows, path = _judgments(spark, d), scratch(spark)
    for part in ("axis_ok", "NOT coalesce(axis_ok, false)"):
        jsonl.append_some(rows.filter(part), path, "judgments")
    return jsonl.read_strict(spark, path, JUDGED).groupBy("judge_model", "axis_ok").agg(F.count(F.lit(1)).alias("n"))


def jsonl_merged(spark: SparkSession, d: str) -> DataFrame:
    """Seeds written in shards by batch, merged in the order of batches and numbered."""
    keys = StructType([StructField("batch_id", StringType()), StructField("seed_id", StringType())])
    jsonl.overwrite(load(spark, d, "t02_seeds").select(*keys.names).repartition("batch_id"), path := scratch(spark))
    return windows.number_rows(jsonl.merge_shards(spark, path, keys, ["batch_id", "seed_id"]), [F.col("batch_id"), F.col("seed_id")], "n")


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    raw_lines(spark, d).write.text(path := scratch(spark))
    found = (jsonl.count_lines(spark, path), jsonl.count_lines(spark, path, F.startswith("value", F.lit("{"))))
    return spark.createDataFrame([found], "lines bigint, records bigint")


def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """A summary of each judgment table saved as its own document, one of them twice, and all read again."""
    path = scratch(spark)
    for name, table in (("b1", "t04a_judgments_b1"), ("b2", "t04b_judgments_b2"), ("b1", "t04a_judgments_b1")):
        row = load(spark, d, table).agg(F.count(F.lit(1)).alias("n"), F.count_if("axis_ok").alias("ok"), F.count("issue").alias("issues"))
        jsonl.save_result(row.select(F.lit(name).alias("stage"), "n", "ok", "issues").coalesce(1), path, name)
    schema = StructType([StructField("stage", StringType()), *[StructField(c, LongType()) for c in ("n", "ok", "issues")]])
    return jsonl.read_documents(spark, f"{path}/model=*/*.json", schema)


def pretty_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON documents with nulls, parsed again."""
    rows = load(spark, d, "t02_seeds").select("seed_id", "answer", "doc_id")
    back = F.from_json("json", "seed_id string, answer string, doc_id string")
    return jsonl.result_document(rows).select(back.alias("r"), F.contains("json", F.lit("\n")).alias("pretty")).select("r.*", "pretty")


def rater_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Labels of three raters through CSV sheets, joined with the pairs if all three have the same ids."""
    rows, sheets = rated(spark, d), {}
    for r in RATERS:
        rows.select(F.col("id").alias("gid"), F.lower(r).alias("label (SAME)")).write.option("header", True).csv(path := scratch(spark))
        sheets[r] = documents.read_sheet(spark, path, "gid", "label (SAME)", ("SAME", "DIFFERENT", "UNSURE"))
    joined = agreement.joined_raters(rows.select(F.col("id").alias("gid"), "axis"), sheets)
    return joined.groupBy("axis", *RATERS).agg(F.count(F.lit(1)).alias("n"))


def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    """Questions by seed, in a map per document, some of which a later file overrides with the answer."""
    rows = load(spark, d, "t02_seeds").filter("doc_id IS NOT NULL")
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct("seed_id", F.coalesce(v, F.lit("")).alias("v")))).alias("entries")
    first = rows.groupBy(F.concat(F.lit("1"), "doc_id").alias("file")).agg(entry("question"))
    later = rows.filter(digit(F.lit("archive"), F.col("seed_id")) < 4).groupBy(F.concat(F.lit("2"), "doc_id").alias("file")).agg(entry("answer"))
    return documents.explode_archive(first.unionByName(later), "entries", "file")


def numbered_files(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the source index as files of a provenance list."""
    files = load(spark, d, "source_index").filter("url IS NOT NULL").groupBy(F.col("url").alias("path")).agg(F.max("retrieved").alias("retrieved"))
    return documents.numbered(files, "as listed").drop("retrieved")


def question_xml(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a document as an XML record of questions and answers; those with three or more are read."""
    clean = lambda c: F.regexp_replace(c, r"\p{C}", " ")  # noqa: E731 - not allowed in XML
    rows = load(spark, d, "t02_seeds").filter("doc_id IS NOT NULL").select("doc_id", clean("question").alias("q"), clean("answer").alias("a"))
    docs = rows.groupBy(F.col("doc_id").alias("Focus")).agg(F.struct(F.collect_list(F.struct(F.col("q").alias("Question"), F.col("a").alias("Answer"))).alias("QAPair")).alias("QAPairs"))
    docs.write.format("xml").option("rootTag", "Documents").option("rowTag", "Document").save(path := scratch(spark))
    return documents.read_question_xml(spark, path, 3, 0).select("focus")


def mixed_questions(spark: SparkSession, d: str) -> DataFrame:
    """A file of which some lines are records and some plain questions: each question once."""
    rows = load(spark, d, "t02_seeds").filter("question IS NOT NULL").select("seed_id", F.regexp_replace("question", r"[\r\n]+", " ").alias("q"))
    line = F.when(digit(F.lit("mixed"), F.col("seed_id")) < 8, F.to_json(F.struct(F.col("q").alias("q1")))).otherwise(F.col("q"))
    rows.select(line.alias("value")).write.text(path := scratch(spark))
    return documents.read_questions(spark, path).select("question")


def fact_refs(spark: SparkSession, d: str) -> DataFrame:
    """Facts and seeds of a document as lines of one stream; references of a seed count the facts before it from 0."""
    seeds = windows.running_index(load(spark, d, "t02_seeds").filter("doc_id IS NOT NULL AND fact_ids IS NOT NULL"), ["doc_id"], [F.col("seed_id")])
    seeds = seeds.withColumn("line", F.col("k").cast("bigint") * 100 + 99)
    facts = seeds.select("doc_id", (F.col("k").cast("bigint") * 100).alias("at"), F.posexplode("fact_ids").alias("pos", "fact_id")).select("doc_id", (F.col("at") + F.col("pos")).alias("line"), "fact_id")
    asked = seeds.select("seed_id", "doc_id", "line", F.array(F.lit(0), F.pmod("line", F.lit(7)).cast("int"), F.lit(-1), F.lit(99)).alias("fact_refs"))
    return salvage.fact_ids(asked, facts).select("seed_id", F.concat_ws(",", "fact_ids").alias("fact_ids"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """The verifier's decisions: of every pair, by its hash digit none, one that isn't known, one without a pair, or the label's."""
    h = digit(F.lit("decide"), F.col("id"))
    said = F.when(h == 1, "MAYBE").when((h == 2) | (F.col("hit") == 0), "REGENERATE").otherwise("SERVE")
    rows = pairs(spark, d).select("id", "hit").filter(h > 0)
    return rows.select(F.when(h == 3, F.concat(F.lit("x"), "id")).when(h == 4, F.lit("")).otherwise(F.col("id")).alias("pair_id"), said.alias("decision"))


def decisions_joined(spark: SparkSession, d: str) -> DataFrame:
    """Valid decisions by label, and how many of all valid ones have a pair."""
    rows, total = decision.decided(pairs(spark, d).select("id", "hit"), salvage.valid_decisions(_decisions(spark, d)))
    return rows.groupBy("decision", "hit").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row


def validate_risk_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as a hand-made list with faults by hash digit: group, axis, language, label and question."""
    h = digit(F.lit("risk"), F.col("id"))
    roman = F.when(F.col("axis_group") == "invariant", "I").when(F.col("axis_group") == "slope", "II").otherwise("III")
    rows = pairs(spark, d).select(
        F.col("id").alias("pair_id"), F.when(h == 0, "IV").when(h == 1, "II").otherwise(roman).alias("group"), F.when(h == 2, "P9").otherwise(F.col("axis")).alias("axis"),
        F.when(h == 3, "fr").otherwise(F.col("lang")).alias("lang"), F.col("seed_question").alias("q1"), F.when(h == 4, F.concat(F.lit(" "), "seed_question")).otherwise(F.col("variation")).alias("q2"), F.when(h == 5, "HIT").otherwise(F.col("expected_label")).alias("expected"),
    )
    return validate.report(rows, validate.risk_pairs())


def guarded_axes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per axis, if there are a hundred pairs at all."""
    return validate.require(pairs(spark, d).select("id", "axis"), 100, "pairs").groupBy("axis").agg(F.count(F.lit(1)).alias("n"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Length of each vector, before and after it is made a unit; a zero vector stays."""
    rows = load(spark, d, "pair_vectors").filter("vec IS NOT NULL")
    return rows.select("vec_id", F.round(vectors.norm(F.col("vec")), 5).alias("length"), F.round(vectors.norm(vectors.unit(F.col("vec"))), 5).alias("unit"))


def family_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each variation with its seed's question; null with a zero vector."""
    v = load(spark, d, "pair_vectors").filter("vec IS NOT NULL")
    asked = v.filter("field = 'seed_question'").select("seed_id", F.col("vec").alias("q"))
    return v.filter("field = 'variation'").join(asked, "seed_id").select("vec_id", F.round(vectors.cosine(F.col("vec"), F.col("q")), 5).alias("sim"))


def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    """A rendered prompt taken apart: its version, the cached block, the rest's size, the first number in it and the generator's short name."""
    p = pairs(spark, d).withColumn("v", F.coalesce("variation", F.lit("")))
    t = F.concat(F.lit("---\nversion: v1."), F.substring("axis", 2, 1), F.lit("\n---\n<<CACHED>>Axis "), "axis", F.lit("<<END>>"), "v")
    p = p.withColumn("t", t)
    rest = F.element_at(F.split("t", "<<END>>", 2), 2)
    name = prompts.short_name(F.coalesce("generator_model", F.lit("?")), ("gen-", "-latest"))
    return p.select("id", prompts.version(F.col("t")).alias("version"), prompts.between(F.col("t"), "<<CACHED>>", "<<END>>").alias("cached"), F.length(rest).alias("rest"), prompts.first_integer(rest).alias("first"), name.alias("model"), prompts.digest(F.col("t"), 16).alias("digest"))


def _shape_model():
    """An encoder for the interface: letters, words and digits of a text."""
    return lambda texts: [[float(len(t)), float(t.count(" ")), float(sum(c in "0123456789" for c in t))] for t in texts]


def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct questions through the encoder interface, with the prefix of a family of models."""
    rows = pairs(spark, d).select(F.coalesce("seed_question", F.lit("")).alias("text"))
    vec = encoders.encode(rows, "text", _shape_model, encoders.PREFIXES["e5"])
    return vec.select("text", *[F.round(F.col("vec")[i].cast("double"), 4).alias(c) for i, c in enumerate(("letters", "blanks", "digits"))])


def _word_model():
    """A cross scorer for the interface: word Jaccard."""

    def run(two: list[tuple[str, str]]) -> list[float]:
        sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in two]
        return [len(a & b) / max(1, len(a | b)) for a, b in sets]

    return run


def cross_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every pair through the cross scorer interface."""
    p = pairs(spark, d)
    return p.select("id", F.round(encoders.score(F.col("seed_question"), F.col("variation"), _word_model), 6).alias("ce"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct character trigrams of each pair's text."""
    p = pairs(spark, d).select("id", F.lower(F.concat("seed_id", F.coalesce("variation", F.lit("")))).alias("t"))
    return p.select("id", F.size(text.shingles(F.col("t"))).alias("n"))


def gap_batches(spark: SparkSession, d: str) -> DataFrame:
    """What a batch of the append log leaves to be judged, as the stream's batch function writes it."""
    run = gaps.answer_gap(lambda: load(spark, d, "t04a_judgments_b1"), path := scratch(spark))
    run(load(spark, d, "t03_variations").select("id"), 0)
    return spark.read.schema("id string").parquet(f"{path}/batch=0")


def continued_ids(spark: SparkSession, d: str) -> DataFrame:
    """Fact ids of new seeds that go on from the number of the domain's earlier ones."""
    rows = load(spark, d, "t02_seeds").select("seed_id", domain_of(F.col("seed_id")).alias("domain"))
    old = digit(F.lit("old"), F.col("seed_id")) < 6
    new = windows.continued(rows.filter(~old), rows.filter(old), "domain", [F.col("seed_id")])
    return new.select("seed_id", F.format_string("%s_f%05d", F.substring_index("seed_id", "_", 1), "k").alias("fact_id"))


def question_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 500 questions, drawn without replacement."""
    rows = load(spark, d, "t02_seeds").filter("question IS NOT NULL").select("seed_id", "question")
    return windows.capped_sample(rows, "seed_id", 500)


def ledger_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Batches that are begun, end well or badly, or are cut off and wait again; an end without a beginning is refused."""
    rows = _ledger(spark, d)
    at, h = F.coalesce(F.col("ts").cast("timestamp"), F.lit(datetime.datetime(2026, 1, 1))), digit(F.lit("ledger"), F.col("batch_id"))
    end = F.when(h == 1, "pending").when(F.col("status") == "failed", "failed").otherwise("done")
    moves = F.array(F.when(h > 0, F.struct(at.alias("at"), F.lit("running").alias("status"))), F.struct((at + F.expr("INTERVAL 1 MINUTE")).alias("at"), end.alias("status")))
    events = rows.select("stage", "batch_id", F.explode(F.array_compact(moves)).alias("e")).select("stage", "batch_id", "e.*")
    return ledger.advance(rows.select("stage", "batch_id", F.lit("pending").alias("status")), events)


def ledger_saved(spark: SparkSession, d: str) -> DataFrame:
    """The ledger replaced as a whole, twice, and read again."""
    schema = StructType([StructField("stage", StringType()), StructField("batch_id", StringType()), StructField("status", StringType()), StructField("n", LongType())])
    rows, path = _ledger(spark, d).select(*schema.names), scratch(spark)
    ledger.save(rows.filter("stage = 'B1'"), path)
    ledger.save(ledger.read(spark, path, schema).unionByName(rows.filter("stage = 'B2'")), path)
    return ledger.read(spark, path, schema)


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_strict, jsonl_lenient, jsonl_appended, jsonl_merged, line_counts, result_documents, pretty_documents, rater_sheets, archive_entries, numbered_files,
        question_xml, mixed_questions, fact_refs, decisions_joined, validate_risk_pairs, guarded_axes, unit_vectors, family_cosine, prompt_parts, encoded_texts,
        cross_scores, shingle_counts, gap_batches, continued_ids, question_cap, ledger_resumed, ledger_saved,
    )
}

_H = "SELECT *, substring(md5('raw:' || id), 1, 1) AS h FROM t04a_judgments_b1 WHERE id IS NOT NULL"
_J = ", ".join(JUDGED.names)
_HEX = lambda salt, c: f"substring(md5('{salt}:' || {c}), 1, 1)"
_NORM = lambda v: f"sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * y)))"
_DECIDED = f"""{PAIRS}, h AS (SELECT id, hit, {_HEX('decide', 'id')} AS h FROM pairs),
dec AS (SELECT CASE h WHEN '3' THEN 'x' || id WHEN '4' THEN '' ELSE id END AS pair_id, CASE WHEN h = '1' THEN 'MAYBE' WHEN h = '2' OR hit = 0 THEN 'REGENERATE' ELSE 'SERVE' END AS decision FROM h WHERE h <> '0'),
ok AS (SELECT * FROM dec WHERE pair_id <> '' AND decision <> 'MAYBE')"""
_RISK = f"""{PAIRS}, r AS (SELECT id AS pair_id, CASE {_HEX('risk', 'id')} WHEN '0' THEN 'IV' WHEN '1' THEN 'II' ELSE CASE axis_group WHEN 'invariant' THEN 'I' WHEN 'slope' THEN 'II' ELSE 'III' END END AS g,
  CASE WHEN {_HEX('risk', 'id')} = '2' THEN 'P9' ELSE axis END AS axis, axis_group, CASE WHEN {_HEX('risk', 'id')} = '3' THEN 'fr' ELSE lang END AS lang, seed_question AS q1,
  CASE WHEN {_HEX('risk', 'id')} = '4' THEN ' ' || seed_question ELSE variation END AS q2, CASE WHEN {_HEX('risk', 'id')} = '5' THEN 'HIT' ELSE expected_label END AS expected FROM pairs),
gate AS (SELECT *, coalesce(CASE WHEN q1 IS NULL OR q1 = '' THEN 'q1 is absent or empty' END, CASE WHEN q2 IS NULL OR q2 = '' THEN 'q2 is absent or empty' END, CASE WHEN g = 'IV' THEN 'group is not a Roman one to three' END, CASE WHEN axis = 'P9' THEN 'axis is not in the taxonomy' END) AS gate FROM r),
p AS (SELECT gate AS problem FROM gate WHERE gate IS NOT NULL
  UNION ALL SELECT 'axis lies in another group' FROM gate WHERE gate IS NULL AND axis_group <> CASE g WHEN 'I' THEN 'invariant' WHEN 'II' THEN 'slope' ELSE 'cliff' END
  UNION ALL SELECT 'expected is not the group''s label' FROM gate WHERE gate IS NULL AND expected <> CASE g WHEN 'I' THEN 'HIT' ELSE 'MISS' END
  UNION ALL SELECT 'language is neither en nor vi' FROM gate WHERE gate IS NULL AND lang = 'fr'
  UNION ALL SELECT 'both questions are the same' FROM gate WHERE gate IS NULL AND {strip_sql('q1')} = {strip_sql('q2')})"""
_PREFIX = "CASE " + " ".join(f"WHEN starts_with(seed_id, '{k}_') THEN '{n}'" for k, n in DOMAINS) + " END"

ORACLES = {
    "jsonl_strict": f"SELECT {_J} FROM t04a_judgments_b1",
    "jsonl_lenient": f"SELECT id, axis_ok, conf, issue FROM ({_H}) WHERE h NOT IN ('0', '1', '3', '5') AND NOT (h = '2' AND axis_ok IS NOT NULL)",
    "jsonl_appended": "SELECT judge_model, axis_ok, count(*) AS n FROM t04a_judgments_b1 GROUP BY ALL",
    "jsonl_merged": "SELECT batch_id, seed_id, row_number() OVER (ORDER BY batch_id NULLS FIRST, seed_id) - 1 AS n FROM t02_seeds",
    "line_counts": f"SELECT count(*) AS lines, count(*) FILTER (WHERE h NOT IN ('0', '3', '4', '5')) AS records FROM ({_H})",
    "result_documents": " UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) AS n, count(*) FILTER (WHERE axis_ok) AS ok, count(issue) AS issues FROM {t}" for s, t in (("b1", "t04a_judgments_b1"), ("b2", "t04b_judgments_b2"))),
    "pretty_documents": "SELECT seed_id, answer, doc_id, true AS pretty FROM t02_seeds",
    "rater_sheets": with_(RATED) + f"SELECT axis, {', '.join(RATERS)}, count(*) AS n FROM rated GROUP BY ALL",
    "archive_entries": f"WITH s AS (SELECT seed_id AS key, CASE WHEN {_HEX('archive', 'seed_id')} IN ('0', '1', '2', '3') THEN coalesce(answer, '') ELSE coalesce(question, '') END AS value FROM t02_seeds WHERE doc_id IS NOT NULL) SELECT key, value, CAST(row_number() OVER (ORDER BY key) AS INT) AS n FROM s",
    "numbered_files": "WITH u AS (SELECT DISTINCT url FROM source_index WHERE url IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY url) AS INT) AS n, string_split(url, '/')[-1] AS file, 'as listed' AS license FROM u",
    "question_xml": rf"WITH c AS (SELECT doc_id, regexp_replace(question, '\p{{C}}', ' ', 'g') AS q, regexp_replace(answer, '\p{{C}}', ' ', 'g') AS a FROM t02_seeds WHERE doc_id IS NOT NULL) SELECT doc_id AS focus FROM c WHERE coalesce({fold_sql('q')}, '') <> '' AND coalesce({fold_sql('a')}, '') <> '' GROUP BY doc_id HAVING count(*) >= 3",
    "mixed_questions": rf"SELECT DISTINCT {strip_sql(chr(113))} AS question FROM (SELECT regexp_replace(question, '[\r\n]+', ' ', 'g') AS q FROM t02_seeds WHERE question IS NOT NULL) WHERE {strip_sql('q')} <> ''",
    "fact_refs": """WITH s AS (SELECT seed_id, doc_id, fact_ids, row_number() OVER (PARTITION BY doc_id ORDER BY seed_id) AS k FROM t02_seeds WHERE doc_id IS NOT NULL AND fact_ids IS NOT NULL),
f AS (SELECT doc_id, k * 100 + generate_subscripts(fact_ids, 1) - 1 AS line, unnest(fact_ids) AS fact_id FROM s),
e AS (SELECT s.seed_id, s.k * 100 + 99 AS line, coalesce((SELECT list(f.fact_id ORDER BY f.line, f.fact_id) FROM f WHERE f.doc_id = s.doc_id AND f.line < s.k * 100 + 99), []) AS l FROM s)
SELECT seed_id, array_to_string(list_transform(list_filter([0, line % 7, -1, 99], lambda r: r >= 0 AND r < len(l)), lambda r: l[r + 1]), ',') AS fact_ids FROM e""",
    "decisions_joined": with_(_DECIDED, "t AS (SELECT count(*) AS total, count(p.id) AS joined FROM ok LEFT JOIN pairs p ON ok.pair_id = p.id)") + "SELECT decision, hit, count(*) AS n, any_value(joined) AS joined, any_value(total) AS total FROM ok JOIN pairs p ON ok.pair_id = p.id, t GROUP BY decision, hit",
    "validate_risk_pairs": with_(_RISK) + "SELECT problem, count(*) AS n FROM p GROUP BY problem",
    "guarded_axes": with_(PAIRS) + "SELECT axis, count(*) AS n FROM pairs GROUP BY axis",
    "unit_vectors": f"SELECT vec_id, round({_NORM('vec')}, 5) AS length, CASE WHEN {_NORM('vec')} = 0 THEN 0e0 ELSE 1e0 END AS unit FROM pair_vectors WHERE vec IS NOT NULL",
    "family_cosine": f"""WITH v AS (SELECT vec_id, seed_id, field, CAST(vec AS DOUBLE[]) AS x, {_NORM('vec')} AS n FROM pair_vectors WHERE vec IS NOT NULL)
SELECT a.vec_id, CASE WHEN a.n = 0 OR b.n = 0 THEN NULL ELSE round(list_dot_product(a.x, b.x) / (a.n * b.n), 5) END AS sim FROM v a JOIN v b ON a.seed_id = b.seed_id WHERE a.field = 'variation' AND b.field = 'seed_question'""",
    "prompt_parts": with_(PAIRS) + r"""SELECT id, 'v1.' || substring(axis, 2, 1) AS version, 'Axis ' || axis AS cached, CAST(length(coalesce(variation, '')) AS INT) AS rest, TRY_CAST(nullif(regexp_extract(coalesce(variation, ''), '([0-9]+)', 1), '') AS BIGINT) AS first,
replace(replace(coalesce(generator_model, '?'), 'gen-', ''), '-latest', '') AS model, substring(sha256('---' || chr(10) || 'version: v1.' || substring(axis, 2, 1) || chr(10) || '---' || chr(10) || '<<CACHED>>Axis ' || axis || '<<END>>' || coalesce(variation, '')), 1, 16) AS digest FROM pairs""",
    "encoded_texts": with_(PAIRS, "t AS (SELECT DISTINCT coalesce(seed_question, '') AS text FROM pairs)", "p AS (SELECT text, 'query: ' || text AS p FROM t)",
        "c AS (SELECT text, CAST(length(p) AS DOUBLE) AS a, CAST(length(p) - length(replace(p, ' ', '')) AS DOUBLE) AS b, CAST(length(regexp_replace(p, '[^0-9]', '', 'g')) AS DOUBLE) AS c FROM p)")
    + "SELECT text, round(a / sqrt(a * a + b * b + c * c), 4) AS letters, round(b / sqrt(a * a + b * b + c * c), 4) AS blanks, round(c / sqrt(a * a + b * b + c * c), 4) AS digits FROM c",
    "cross_scores": with_(VERIFIED) + "SELECT id, round(ce, 6) AS ce FROM verified",
    "shingle_counts": with_(PAIRS, "t AS (SELECT id, lower(seed_id || coalesce(variation, '')) AS t FROM pairs)") + "SELECT id, CAST(len(list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3)))) AS INT) AS n FROM t",
    "gap_batches": f"SELECT DISTINCT {strip_sql('id')} AS id FROM t03_variations WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t04a_judgments_b1 j WHERE j.id = {strip_sql('t03_variations.id')})",
    "continued_ids": with_(_SEEDS, f"o AS (SELECT *, {_HEX('old', 'seed_id')} IN ('0', '1', '2', '3', '4', '5') AS old FROM s)", "n AS (SELECT *, row_number() OVER (PARTITION BY dom, old ORDER BY seed_id) + count(*) FILTER (WHERE old) OVER (PARTITION BY dom) AS k FROM o)")
    + "SELECT seed_id, string_split(seed_id, '_')[1] || '_f' || lpad(CAST(k AS VARCHAR), 5, '0') AS fact_id FROM n WHERE NOT old",
    "question_cap": "SELECT seed_id, question FROM t02_seeds WHERE question IS NOT NULL ORDER BY substring(md5('cap:' || seed_id), 1, 15), seed_id LIMIT 500",
    "ledger_resumed": with_(_LEDGER, f"h AS (SELECT *, {_HEX('ledger', 'batch_id')} AS h FROM led)")
    + "SELECT stage, batch_id, CASE WHEN h IN ('0', '1') THEN 'pending' WHEN status = 'failed' THEN 'failed' ELSE 'done' END AS status, CASE WHEN h = '0' THEN 0 ELSE 2 END AS moves, CASE WHEN h = '0' THEN 1 ELSE 0 END AS refused FROM h",
    "ledger_saved": with_(_LEDGER) + "SELECT stage, batch_id, status, n FROM led",
}
