import random
from collections import Counter

import numpy as np

from bandwright.llm import sample

ROWS = "id string, domain string, axis string, expected_label string, rank int"
TARGETS = "plan_id int, cell_id int, domain string, axis string, expected_label string, target_share double, min_rows bigint, sample_size bigint"


def make(spark, rng, n=600):
    pick = lambda *x: rng.choice(x)
    return spark.createDataFrame([(f"r{i}", pick("A", " a ", "b", None), pick("P1", "p1", "N1"), pick("HIT", "hit ", None), i) for i in range(n)], ROWS)


def test_report_and_draw(spark):
    df = make(spark, random.Random(2))
    targets = [(1, 1, "a", None, None, 0.5, 5, 100), (1, 2, "B", None, None, 0.3, 40, 100), (1, 3, "zz", None, None, 0.2, 5, 100), (2, 1, None, "P1", "HIT", 0.9, 0, 5000), (2, 2, None, "N1", None, 0.1, 0, 5000)]
    t = spark.createDataFrame(targets, TARGETS)
    report = {(r.plan_id, r.cell_id): r for r in sample.plan(df, t)[0].collect()}
    there = Counter()
    for r in df.collect():
        d, a, y = (x.strip().lower() if x else None for x in (r.domain, r.axis, r.expected_label))
        there[1, 1] += d == "a"
        there[1, 2] += d == "b"
        there[2, 1] += a == "p1" and y == "hit"
        there[2, 2] += a == "n1"
    for (p, c, *_, share, low, size) in targets:
        r = report[p, c]
        assert r.available == there[p, c] and r.short == (there[p, c] < share * size or there[p, c] < low)
        assert r.drawn + r.shortfall == r.quota and r.drawn == min(r.quota, there[p, c])
    assert sum(r.quota for (p, _), r in report.items() if p == 1) == 100 and report[1, 2].quota == 40
    drawn = sample.draw(df, t).collect()
    assert Counter((r.plan_id, r.cell_id) for r in drawn) == Counter({k: r.drawn for k, r in report.items() if r.drawn})
    assert len({(r.plan_id, r.id) for r in drawn}) == len(drawn)


def test_overlapping_cells_share_rows(spark):
    df = spark.createDataFrame([(f"r{i}", "a", "P1", "HIT", i) for i in range(10)], ROWS)
    t = spark.createDataFrame([(1, 1, "a", None, None, 0.5, 0, 12), (1, 2, None, "P1", None, 0.5, 0, 12)], TARGETS)
    report = sample.plan(df, t)[0].collect()
    assert sum(r.drawn for r in report) == 10 and sum(r.shortfall for r in report) == 2
    assert not any(r.short for r in report)
    assert sample.draw(df, t).select("id").distinct().count() == 10


def test_empty_and_zero(spark):
    df, t = make(spark, random.Random(1), 10), spark.createDataFrame([(1, 1, "a", None, None, 1.0, None, 0)], TARGETS)
    assert sample.draw(df, t).count() == 0 and sample.draw(df, t.limit(0)).count() == 0
    assert sample.plan(df.limit(0), spark.createDataFrame([(1, 1, None, None, None, 1.0, 2, 4)], TARGETS))[0].first().short


def test_quotas():
    assert sample.quotas([0.5, 0.5], [0, 0], 5) == [3, 2]
    assert sample.quotas([0.9, 0.1], [0, 30], 100) == [70, 30]
    assert sample.quotas([0.5, 0.5], [80, 80], 100) == [80, 80]
    assert sample.quotas([0.0, 0.0], [0, 0], 10) == [0, 0]


def test_every_row_is_equally_likely():
    """Cross cells that two targets share, and one that only the first fits: over many seeds each row is drawn as often as the others of its kind."""
    counts = {("a", "p1", None): 10, ("a", "p2", None): 30, ("a", "p3", None): 5, ("b", "p1", None): 40}
    targets = [{"cell_id": 1, "cell": ("a", None, None), "target_share": 0.5, "min_rows": 0, "sample_size": 18}, {"cell_id": 2, "cell": (None, "p1", None), "target_share": 0.5, "min_rows": 0, "sample_size": 18}]
    got, rounds = Counter(), 3000
    for seed in range(rounds):
        report, draws = sample.solve(targets, counts, seed)
        assert [r["drawn"] for r in report] == [9, 9] and not any(r["short"] for r in report)
        for d in draws:
            got[d["cell_id"], d["cross"]] += d["last"] - d["first"] + 1
    per = {k: n / rounds / counts[k[1]] for k, n in got.items()}
    first, second = [v for (c, _), v in per.items() if c == 1], [v for (c, _), v in per.items() if c == 2]
    assert len(first) == 3 and len(second) == 2
    assert all(abs(v - 9 / 45) < 0.02 for v in first) and all(abs(v - 9 / 50) < 0.02 for v in second)


def test_random_rounding():
    rng = np.random.default_rng(1)
    got = np.array([sample.dealt(7, [3, 50, 10**12, 1], rng) for _ in range(200)])
    assert (got.sum(axis=1) == 7).all() and (got <= [3, 50, 10**12, 1]).all()
    mean = np.mean([sample.dealt(5, [1, 4, 5], rng) for _ in range(4000)], axis=0)
    assert np.allclose(mean, [0.5, 2, 2.5], atol=0.05) and sample.dealt(0, [], rng) == [] and sample.dealt(10, [1, 4, 5], rng) == [1, 4, 5]


def test_many_disjoint_targets_and_a_null_plan(spark):
    counts = {(f"d{i}", "p1", None): 20 for i in range(5000)}
    targets = [{"cell_id": i, "cell": (f"d{i}", None, None), "target_share": 1 / 5000, "min_rows": 30 if i == 7 else 0, "sample_size": 50_000} for i in range(5000)]
    report, _ = sample.solve(targets, counts, 1)
    assert [r["cell_id"] for r in report if r["short"]] == [7] and sum(r["quota"] for r in report) == 50_000
    t = spark.createDataFrame([(None, 1, "a", None, None, 1.0, 0, 4), (1, 1, "a", None, None, 1.0, 0, 4)], TARGETS)
    got = Counter(r.plan_id for r in sample.draw(make(spark, random.Random(1), 90), t).collect())
    assert got == {None: 4, 1: 4}
