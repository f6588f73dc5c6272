import random

from pyspark.sql import functions as F

from bandwright.llm import topn

SCHEMA = "g string, h string, score double, id string, extra int, __score int"


def brute(data, n):
    groups = {}
    for r in data:
        groups.setdefault((r[0], r[1]), []).append(r)
    out = []
    for rows in groups.values():
        key = lambda r: (r[2] is None or r[2] != r[2], -(r[2] if r[2] is not None and r[2] == r[2] else 0), r[3] is None, r[3] or "")
        out += sorted(rows, key=key)[:n]
    return sorted(out, key=repr)


def test_random_with_hot_group_nulls_and_ties(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice(["x", None]), rng.choice([None, float("nan"), 0.5, 0.5, 1.0, rng.random() * 3 - 1]), f"i{k}", k, k) for k in range(3000)]
    data += [("hot", "x", 0.5, f"h{k:05d}", k, k) for k in range(4000)]
    df = spark.createDataFrame(data, SCHEMA)
    for n, bounds in ((1, (None, None)), (5, (0.0, 1.0)), (5, (10.0, 11.0)), (10_000, (0.0, 1.0))):
        got = sorted((tuple(r) for r in topn.top_n(df, ["g", "h"], "score", ["id"], n, *bounds).collect()), key=repr)
        assert [r[3] for r in got] == [r[3] for r in brute(data, n)]


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([("a", "x", 1.0, "i", 1, 1)] * 5, SCHEMA)
    assert topn.top_n(df, ["g"], "score", ["id"], 2).count() == 2
    assert topn.top_n(df.limit(0), ["g"], "score", ["id"], 2).count() == 0


def test_thresholds_never_drop_one_of_the_best(spark):
    data = [("a", k % 7) for k in range(100)]
    df = spark.createDataFrame(data, "g string, b int")
    r = topn.thresholds(df, "g", "b", 10).first()
    assert r.total == 100 and sum(b >= r.low for _, b in data) >= 10


def test_latest(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("b", 3.0, None), (None, 4.0, 5), ("c", 5.0, 1)], "id string, conf double, ts int")
    assert {(r.id, r.conf) for r in topn.latest(df, "id", "conf", "ts").collect()} == {("a", None), ("c", 5.0)}
    assert topn.latest(df.filter(F.lit(False)), "id", "conf", "ts").count() == 0
