import random
from collections import Counter

from pyspark.sql import functions as F

from bandwright.operators import messages

SCHEMA = "id string, ts int, batch_id string, __key int, producer string"


def log(spark, ids):
    return spark.createDataFrame([(x, i, f"b{i}", i, "p") for i, x in enumerate(ids)], SCHEMA)


def test_forms_and_blanks(spark, rows):
    df = log(spark, ["a_v1", " a_v1\t", "a_v01", "a_v1 ", None, None, "", " ", "a_v", "a_v", "x\ny_v2", "x\ny_v2", "a_v9999999999999999999", "a_v9999999999999999999", "solo"])
    assert rows(messages.repeated(df)) == sorted([("a_v1", 3), ("", 2), ("a_v", 2), ("x\ny_v2", 2), ("a_v9999999999999999999", 2)], key=repr)
    kept, _, _ = messages.accept(df)
    got = Counter(r.id for r in kept.collect())
    assert got[None] == 2 and all(n == 1 for x, n in got.items() if x is not None) and len(got) == 8


def test_random_against_counter(spark):
    rng = random.Random(3)
    ids = [f"p{rng.randrange(3)}_v{rng.choice([rng.randrange(40), rng.randrange(65500, 65600), 2**40 + rng.randrange(5)])}" for _ in range(2000)]
    df = log(spark, ids)
    want = {k: n for k, n in Counter(ids).items() if n > 1}
    assert {r.id: r.copies for r in messages.repeated(df).collect()} == want
    kept, seen, names = messages.accept(df)
    assert sorted(r.id for r in kept.collect()) == sorted(set(ids))
    numbers = {(r.producer, n) for r in seen.collect() for n in range(r.lo, r.hi + 1)}
    assert numbers == {(x.rsplit("_v", 1)[0], int(x.rsplit("_v", 1)[1])) for x in ids}
    ranges = sorted((r.producer, r.block, r.lo, r.hi) for r in seen.collect())
    assert all(a[:2] != b[:2] or a[3] + 1 < b[2] for a, b in zip(ranges, ranges[1:], strict=False))
    more = log(spark, [*ids[:500], "p0_v777777", "odd", "odd"])
    kept2, seen2, names2 = messages.accept(more, seen, names)
    assert sorted(r.id for r in kept2.collect()) == ["odd", "p0_v777777"]
    kept3, _, _ = messages.accept(more, seen2, names2)
    assert kept3.count() == 0


def test_first_by_order_and_extra_columns(spark):
    df = spark.createDataFrame([("a_v1", 5, "b"), ("a_v1", 2, "z"), (" a_v1", 2, "c"), ("a_v1", None, "a")], "id string, ts int, batch_id string").withColumn("__rank", F.lit(1))
    kept, _, _ = messages.accept(df)
    assert [tuple(r) for r in kept.collect()] == [("a_v1", 2, "c", 1)]


def test_empty(spark):
    df = log(spark, ["a_v1"]).limit(0)
    kept, seen, names = messages.accept(df)
    assert messages.repeated(df).count() == kept.count() == seen.count() == names.count() == 0
