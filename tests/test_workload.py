from pyspark.sql import functions as F

from bandwright.plans import stateful


def test_the_workload_is_as_large_as_asked(spark, data, monkeypatch):
    monkeypatch.setattr(stateful, "kept", lambda spark, d, name, make: make())
    monkeypatch.setattr(stateful, "WORKLOAD", 60)
    items = stateful.workload(spark, data).toPandas()
    assert (items["kind"] != "seed").sum() >= 60
    assert set(items["family"]) == set(items.loc[items["kind"] == "seed", "family"])
    assert sorted(items["item"]) == list(range(len(items))) and all(any(v) for v in items["vec"])


def test_orders_and_sizes_of_the_reference(spark, data, monkeypatch):
    asked = []
    made = stateful.cachesim.settings
    monkeypatch.setattr(stateful.cachesim, "settings", lambda spark, taus, orders, **more: asked.append(orders) or made(spark, taus, 1, **more))
    for q in ("index_keyed_sim", "cache_sim_eviction", "cache_sim_zipf", "arch_rules", "cache_sim_text", "serve_classes", "answer_text_keys", "seed_confusion"):
        stateful.QUERIES[q](spark, data)
    assert asked == [200, 50, 50, 50, 500, 500, 500, 500]
    sizes = {r["items"] for r in stateful.cache_sim_size(spark, data).collect()}
    total = stateful.vectors(spark, data).count()
    assert sizes == {min(n, total) for n in (100, 500, 1000, 2500, 5231)}


def test_rates_against_a_plain_walk(spark):
    """Vectors on a line and three orders: hit rate and sensitivity as counted by hand from the walk."""
    import numpy as np

    from bandwright.operators import cachesim

    x = np.random.default_rng(0).standard_normal((30, 4))
    items = spark.createDataFrame([(i, x[i].tolist(), str(i % 7)) for i in range(30)], "item int, vec array<double>, key string")
    got = stateful._rates(cachesim.simulate(items, cachesim.settings(spark, [0.5], 40)), items).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    keys, hits = [set() for _ in range(30)], 0
    for o in range(40):
        for _, i, stored, _ in cachesim.walk(unit, cachesim.permutation(o, 30), 0.5):
            hits += stored >= 0
            keys[i].add((stored if stored >= 0 else i) % 7)
    assert len(got) == 1 and got[0].arrivals == 1200
    assert got[0].hit == round(hits / 1200, 6) and got[0].sensitivity == round(sum(len(k) > 1 for k in keys) / 30, 6)


def test_encoders_of_the_sweep(spark):
    """Hashed trigrams give the same cosine as the pair operator; a text without words is a zero vector."""
    import numpy as np

    from bandwright.operators.pairs import pair_cosine

    rows = [(0, "where is the office", [1.0]), (1, "where is the new office", [1.0]), (2, "", [1.0])]
    items = spark.createDataFrame(rows, "item int, text string, vec array<double>").selectExpr("*", "filter(split(text, ' '), w -> w <> '') AS words")
    got = {r.item: np.array(r.vec) for r in stateful._encoded(items, "trigrams").collect()}
    pair = spark.createDataFrame([(1, rows[0][1], rows[1][1])], "id int, seed_question string, variation string")
    want = pair_cosine(pair).first().sim
    assert abs(got[0] @ got[1] / np.linalg.norm(got[0]) / np.linalg.norm(got[1]) - want) < 1e-12
    words = {r.item: np.array(r.vec) for r in stateful._encoded(items, "words").collect()}
    assert words[0].sum() == 4 and words[1].sum() == 5 and not words[2].any() and len(words[2]) == 256
    assert stateful._encoded(items, "table") is items
