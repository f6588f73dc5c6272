import pytest
from pyspark.sql.types import StructType

from bandwright import schemas
from bandwright.session import cut, fresh, shared_dir
from bandwright.sources import documents, jsonl, salvage


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "axis_ok": true, "conf": 1}\n\n{"id": "b", "axis_ok"\n{"conf": 0.5}\n', encoding="utf-8")
    lenient = jsonl.read_lenient(spark, str(p), schemas.RAW_JUDGMENT, "id")
    assert [(r.id, r.axis_ok, r.conf) for r in lenient.collect()] == [("a", True, 1.0)]
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(p), schemas.RAW_JUDGMENT).collect()
    assert jsonl.count_lines(spark, str(p)) == 3
    out = str(tmp_path / "out")
    jsonl.append(lenient, out)
    jsonl.append(lenient, out)
    assert jsonl.read_strict(spark, out, schemas.RAW_JUDGMENT).count() == 2
    jsonl.overwrite(lenient, out)
    assert jsonl.read_strict(spark, out, schemas.RAW_JUDGMENT).count() == 1 and '"issue":null' in "".join(r.value for r in spark.read.text(out).collect())
    with pytest.raises(ValueError):
        jsonl.append_some(lenient.limit(0), out)
    assert '"issue" : null' in jsonl.result_document(lenient).first().json
    jsonl.save_result(lenient, str(tmp_path / "res"), "m1")
    jsonl.save_result(lenient, str(tmp_path / "res"), "m2")
    assert {r.model for r in spark.read.json(str(tmp_path / "res")).select("model").collect()} == {"m1", "m2"}


def test_salvage(spark):
    lines = ["```jsonl", '`{"id": "a", "axis_ok": true, "conf": 0.5}`', "Auditing:", ' \t{"id":"b","axis_ok":"true","conf":0.5}', '{"id": "c", "conf": 2, "axis_ok": false}', '{"id": "d"', '{"id": "", "axis_ok": true, "conf": 1}', ""]
    s = salvage.salvage(spark.createDataFrame([(x,) for x in lines], "value string"), schemas.RAW_JUDGMENT)
    assert tuple(salvage.tally(s).first()) == (5, 3, 2)
    assert [r.id for r in salvage.valid_judgments(salvage.good(s)).collect()] == ["a"]
    d = spark.createDataFrame([("p", "SERVE"), ("q", "MAYBE"), (None, "SERVE")], "pair_id string, decision string")
    assert salvage.valid_decisions(d).count() == 1


def test_routing_and_fact_refs(spark):
    rows = spark.createDataFrame([("fact", "d1_x"), ("seed", "d2_y"), ("fact", "z"), ("other", "d1_x"), (None, "d1_x")], "type string, doc_id string")
    assert [x.count() for x in salvage.route(rows)] == [1, 1, 3]
    facts = spark.createDataFrame([("d", 1, "f1"), ("d", 2, "f2"), ("d", 9, "f9")], "doc_id string, line bigint, fact_id string")
    seeds = spark.createDataFrame([("d", 5, [1, 0, 2, -1]), ("e", 5, [0]), ("d", 1, [0])], "doc_id string, line bigint, fact_refs array<int>")
    assert sorted((r.doc_id, r.line, r.fact_ids) for r in salvage.fact_ids(seeds, facts).collect()) == [("d", 1, []), ("d", 5, ["f2", "f1"]), ("e", 5, [])]


def test_documents(spark, tmp_path):
    for n, t in (("b.txt", "x" * 50), ("a.txt", "y" * 20), ("c.txt", "short")):
        (tmp_path / n).write_text(t)
    assert [(r.name, len(r.text)) for r in documents.read_folder(spark, str(tmp_path), 10, 30).collect()] == [("a.txt", 20), ("b.txt", 30)]
    assert [r.file for r in documents.provenance(spark, str(tmp_path), "cc").orderBy("n").collect()] == ["a.txt", "b.txt", "c.txt"]
    xml = tmp_path / "q.xml"
    pair = "<QAPair><Question>q</Question><Answer>" + "a" * 600 + "</Answer></QAPair>"
    xml.write_text(f"<r><Document><Focus>F</Focus><QAPairs>{pair * 3}</QAPairs></Document><Document><Focus>G</Focus><QAPairs>{pair * 2}</QAPairs></Document></r>")
    assert [r.focus for r in documents.read_question_xml(spark, str(xml)).collect()] == ["F"]
    sheet = tmp_path / "s.csv"
    sheet.write_text("﻿gid,note,label (SAME)\ng1,x,same\ng2,,DIFFERENT \n", encoding="utf-8")
    assert sorted(tuple(r) for r in documents.read_sheet(spark, str(sheet), "gid", "label (SAME)", ("SAME", "DIFFERENT")).collect()) == [("g1", "SAME"), ("g2", "DIFFERENT")]
    sheet.write_text("gid,label (SAME)\ng1,maybe\n")
    with pytest.raises(ValueError):
        documents.read_sheet(spark, str(sheet), "gid", "label (SAME)", ("SAME", "DIFFERENT"))


def test_html_chunks_until(spark):
    from pyspark.sql import functions as F

    page = "<html><nav>menu<nav>deep</nav>still</nav><p> one &amp; two </p><script>var x</script>\n\n<p>three</p></html>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r[0] for r in df.select(documents.html_to_text(F.col("h"))).collect()] == ["one & two\nthree", None]
    law = "Preamble\n" + "".join(f"Điều {i}. " + "x" * 300 + "\n" for i in range(1, 8))
    got = documents.chunks(spark.createDataFrame([(1, "T", law), (2, "U", "Điều 1. a\nĐiều 2. b")], "k int, title string, text string"), "k", "title", "text").orderBy("chunk").collect()
    assert [(r.k, r.chunk) for r in got] == [(1, 0), (1, 1)] and all(r.text.startswith("T\n\nĐiều") for r in got)
    parts = spark.createDataFrame([(["aa", "bbb", "c", "d"],)], "p array<string>").select(documents.until(F.col("p"), 4)).first()[0]
    assert parts == ["aa", "bbb"]
    archive = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"a": "z"})], "at int, m map<string,string>")
    assert sorted((r.key, r.value, r.n) for r in documents.explode_archive(archive, "m", "at").collect()) == [("a", "z", 1), ("b", "y", 2)]
    q = spark.createDataFrame([(1, "", "v", "s"), (2, " q ", "w", "v"), (3, None, None, None)], "i int, question string, variation string, q2 string")
    assert sorted(tuple(r) for r in documents.questions(q, "i").collect()) == [(1, "s"), (1, "v"), (2, "q")]


def test_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([(1, None)], "a int, A2 string")
    assert cut(df).schema == df.schema and fresh(df, "a") == "_a" and fresh(df, "a2") == "_a2"
    assert isinstance(schemas.VARIATIONS, StructType)


def test_reports_and_encoders(spark):
    from pyspark.sql import functions as F

    from bandwright.functions import encoders
    from bandwright.sources import reports

    t = spark.createDataFrame([("a_b", 0.12345, 3), (None, None, 4)], "name string, x double, n int")
    assert {r.line for r in reports.latex_rows(t, ["name", "x", "n"]).collect()} == {r"a\_b & 0.123 & 3 \\", r"-- & -- & 4 \\"}
    p = spark.createDataFrame([("r", "u", 1.0), ("r", "v", 2.0), ("q", "u", 3.0)], "r string, c string, x double")
    assert [x.line for x in reports.latex_pivot(p, "r", "c", "x", ["u", "v"], 1).collect()] == [r"q & 3.0 & -- \\", r"r & 1.0 & 2.0 \\"]
    assert reports.distribution(t, "name").first()[0] == "?:1  a_b:1"
    df = spark.createDataFrame([("ab",), ("ab",), ("",)], "t string")
    got = {r.t: r.vec for r in encoders.encode(df, "t", lambda: lambda ts: [[float(len(t)), 0.0] for t in ts], prefix="x").collect()}
    assert got == {"ab": [1.0, 0.0], "": [1.0, 0.0]}
    assert sorted(r[0] for r in df.select(encoders.score(F.col("t"), F.lit("zz"), lambda: lambda ps: [float(len(a) + len(b)) for a, b in ps])).collect()) == [2.0, 4.0, 4.0]


def test_cut_keeps_clashing_names(spark):
    df = spark.range(3).selectExpr("id AS a", "id AS A", "id + 1 AS b").toDF("a", "a", "b")
    assert cut(df).columns == ["a", "a", "b"] and sorted(r[2] for r in cut(df).collect()) == [1, 2, 3]


def test_archives_and_mixed_questions(spark, tmp_path):
    import io
    import json
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, content in (("1.json", {"k": "first", "x": "only"}), ("2.json", {"k": "later"}), ("3.txt", {"k": "no"}), ("4.json", [1])):
            data = json.dumps(content).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = documents.explode_archive(documents.read_archive(spark, str(tmp_path / "a.tar.gz"), "string"), "entries", "file").collect()
    assert sorted((r.key, r.value, r.n) for r in got) == [("k", "later", 1), ("x", "only", 2)]
    (tmp_path / "q.jsonl").write_text('{"q1": "one", "q2": "two"}\nplain question\n\n{"variation": "one"}\n{"broken\n{"question": "", "text": " three "}\n', encoding="utf-8")
    assert sorted(r.question for r in documents.read_questions(spark, str(tmp_path / "q.jsonl")).collect()) == ["one", "plain question", "three", "two"]
    (tmp_path / "m.yaml").write_text("models:\n  - {name: a, dim: 3}\n  - {name: b, dim: 4}\n")
    assert sorted(tuple(r) for r in documents.read_dimension(spark, str(tmp_path / "m.yaml"), "models").collect()) == [("a", 3), ("b", 4)]


def test_raters_must_have_equal_sets(spark):
    from bandwright.operators import agreement

    pairs = spark.createDataFrame([("g1",), ("g2",)], "gid string")
    sheet = lambda *ids: spark.createDataFrame([(i, "SAME") for i in ids], "gid string, label string")
    got = agreement.joined_raters(pairs, {"a": sheet("g1", "g2"), "b": sheet("g2", "g1")}).collect()
    assert sorted(tuple(r) for r in got) == [("g1", "SAME", "SAME"), ("g2", "SAME", "SAME")]
    with pytest.raises(ValueError):
        agreement.joined_raters(pairs, {"a": sheet("g1", "g2"), "b": sheet("g2")})


def test_ledger_is_replaced_as_a_whole(spark, tmp_path):
    from bandwright.operators import ledger
    from bandwright.session import locked

    rows, path = spark.createDataFrame([("s", "b1", "pending")], "stage string, batch_id string, status string"), str(tmp_path / "ledger")
    assert ledger.read(spark, path, rows.schema).isEmpty()
    for _ in range(3):
        ledger.save(rows, path)
    assert sorted(p.name for p in (tmp_path / "ledger").iterdir() if not p.name.startswith(".")) == ["v1", "v2"]
    with locked(spark, path), pytest.raises(RuntimeError):
        ledger.save(rows, path)
    ledger.save(ledger.read(spark, path, rows.schema).unionByName(rows), path)
    assert ledger.read(spark, path, rows.schema).count() == 2
    import datetime

    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    events = [("s", "b1", at(m), x) for m, x in enumerate(("done", "running", "failed", "done", "running", "done", "running"))]
    got = ledger.advance(rows, spark.createDataFrame(events, "stage string, batch_id string, at timestamp, status string")).first()
    assert (got.status, got.moves, got.refused) == ("done", 4, 3)


def test_capped_sample_and_continued_numbers(spark):
    from bandwright.operators import windows

    rows = spark.createDataFrame([(f"k{i}", "ab"[i % 2]) for i in range(20)] + [("n", None)], "k string, g string")
    assert windows.capped_sample(rows, "k", 50).count() == 21 and windows.capped_sample(rows, "k", 5).count() == 5
    got = windows.continued(rows, rows.filter("g = 'a'"), "g", ["k"], "n").collect()
    assert sorted(r.n for r in got if r.g == "a") == list(range(11, 21)) and sorted(r.n for r in got if r.g == "b") == list(range(1, 11)) and [r.n for r in got if r.g is None] == [1]
