import random
import unicodedata

from bandwright.llm import formats

SCHEMA = "seed_id string, question string, answer string, first string, part int"


def canonical(*fields):
    out = []
    for f in fields:
        for p in (f or "").split(";"):
            q = " ".join("".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in p.lower()).split())
            if q:
                out.append(q)
    return tuple(sorted(out))


def check(spark, data, partitions):
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    groups = {}
    for s, q, a in data:
        if s is not None:
            groups.setdefault(canonical(q, a), []).append(s)
    want = sorted((min(v), s) for v in groups.values() for s in v)
    assert sorted((r.representative, r.id) for r in formats.runs(df, "seed_id", ["question", "answer"], partitions).collect()) == want
    assert sorted(r.copies for r in formats.collapsed(df, "seed_id", ["question", "answer"], partitions).collect()) == sorted(map(len, groups.values()))


def test_cases(spark):
    data = [("s1", "A  b; C", "d"), ("s2", "d", "c;a-B"), ("s3", "a b; c; c", "d"), ("s4", None, None), ("s5", "", " ;; "), (None, "A b;c", "d"), ("s6", "Đại  học", None), ("s7", "ĐẠI HỌC!", ""), ("s8", "x" * 300_000, "y"), ("s9", "Y", "X" * 300_000), ("s1", "A b; c", "d")]
    for partitions in (1, 3, 20):
        check(spark, data, partitions)


def test_hot_form_over_many_partitions(spark):
    rng = random.Random(4)
    data = [(f"h{i:04d}", "same", rng.choice(["One", "one ", "ONE;"])) for i in range(700)] + [(f"o{i}", f"q{i % 90}", "z") for i in range(300)]
    for partitions in (7, 40):
        check(spark, data, partitions)


def test_empty(spark):
    assert formats.runs(spark.createDataFrame([], SCHEMA), "seed_id", ["question", "answer"], 4).count() == 0
