import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.functions import prompts, stats, text
from bandwright.operators import agreement, bootstrap, cachesim, decision, dedupe, freeze, graph, ledger, overlap, ranks, skew, validate, windows
from bandwright.operators.pairs import pair_cosine


def grams(t):
    t = t.lower()
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


def texts(rng, n):
    base = ["the cache keeps an answer for a question", "a new seed is drawn from the pool of documents", "đại học bách khoa"]
    return [(f"r{i:03d}", "".join(c if rng.random() > 0.02 else rng.choice("xyz") for c in rng.choice(base) * 2)) for i in range(n)] + [("z1", ""), ("z2", ""), ("z3", "ab")]


def test_jaccard_classes_against_brute_force(spark):
    data = texts(random.Random(1), 150)
    df = spark.createDataFrame(data, "id string, text string")
    sets = {i: grams(t) for i, t in data}
    near = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9 - 1e-12}
    members, reps = dedupe.classes_of_sets(df, "id", "text")
    rep = {r.id: r.rep for r in members.collect()}
    assert rep == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets} and {r.id: r.w for r in reps.collect()} == Counter(rep.values())
    stay, keeper = [], {}
    for i in sorted(sets):
        k = [j for j in stay if (j, i) in near]
        if k:
            keeper[i] = k[0]
        else:
            stay.append(i)
    got = {r.id: r for r in dedupe.jaccard(df, "id", "text").collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: keeper.get(i, i) for i in sets}
    assert all(r.links == sum(i in p for p in near) for i, r in got.items())


def test_a_family_of_near_copies_gives_no_pairs(spark, monkeypatch):
    """Many texts that are all alike, some of them equal, in blocks; and null, empty and short texts."""
    monkeypatch.setattr(dedupe, "SPLIT", 300)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))
    data = [(i, base[: i % 197] + rng.choice("XYZ") + base[i % 197 + 1 :]) for i in range(1000)]
    data += [(2000, None), (2001, ""), (2002, ""), (2003, "ab"), (2004, "AB"), (2005, "\x00a"), (2006, None)]
    got = {r.id: r for r in dedupe.jaccard(spark.createDataFrame(data, "id bigint, text string").withColumn("t", F.lit(1)), "id", "text").collect()}
    assert len(got) == len(data) and all(got[i].class_id == 0 and got[i].links == 999 for i in range(1000))
    assert {i: (got[i].class_id, got[i].links) for i in range(2000, 2007)} == {2000: (2000, 0), 2001: (2001, 1), 2002: (2001, 1), 2003: (2003, 1), 2004: (2003, 1), 2005: (2005, 0), 2006: (2006, 0)}


def test_rows_hardly_meet_where_no_shingle_is_rare(spark):
    """Texts over few letters share their rarest shingles with many others: few pairs are compared all the same, and the similar ones are found."""
    rng = random.Random(4)
    data = [(i, "".join(rng.choice("abcdef") for _ in range(60))) for i in range(1000)]
    data += [(1000 + i, data[i][1][:-1]) for i in range(0, 1000, 50)]
    df = spark.createDataFrame(data, "id bigint, text string")
    posted = dedupe.postings(dedupe.classes_of_sets(df, "id", "text")[1], 0.9)[0]
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in posted.groupBy("t", "x", "y").count().collect()) < 10 * len(data)
    got = {r.id: (r.class_id, r.links) for r in dedupe.jaccard(df, "id", "text").collect()}
    assert got == {i: (i - 1000 if i >= 1000 else i, int(i >= 1000 or i % 50 == 0)) for i, _ in data}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 0.97, 1.0])
def test_similar_sets_have_a_part_in_common(threshold):
    """Texts of all lengths, at one key all together and at their keys: each similar pair comes once."""
    rng = random.Random(6)
    data = []
    for n in [*range(40), *range(40, 400, 17)]:
        t = [rng.choice("abcdefgh ") for _ in range(n)]
        data.append("".join(t))
        for _ in range(6):
            for _ in range(rng.randrange(1, 3 + n // 40)):
                at = rng.randrange(n + 1)
                t[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
            data.append("".join(t))
    data = list({frozenset(grams(t)): t for t in data}.values())
    sets = [grams(t) for t in data]
    want = {(a, b) for a, b in itertools.combinations(range(len(data)), 2) if len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) * threshold - 1e-9}
    parts, keys = dedupe.Parts(threshold), defaultdict(set)
    row, found = dedupe.codes(data)
    n, mixed = np.bincount(row), dedupe._mixed(found, 5)
    for i in range(len(data)):
        one = np.array([n[i]])
        first, last = parts.taken(one)
        for place in range(first[0], last[0] + 1):
            for k in parts.keys(place, np.zeros(n[i], np.int64), mixed[row == i], 1)[0]:
                keys[k].add(i)
    at = [(k, i) for k, of in keys.items() for i in sorted(of)]
    key, who = np.array([k for k, _ in at], np.uint64), np.array([i for _, i in at])
    group = np.unique(key, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    got = [tuple(sorted((int(who[order[i]]), int(who[order[j]])))) for a, b in dedupe.similar_within([data[i] for i in who[order]], key[order], group[order], np.full(len(at), -1), parts, threshold) for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and (threshold == 1 or want)


def test_greedy_equals_sequential(spark):
    rng = random.Random(2)
    keys = [(i, f"k{rng.randrange(60)}") for i in range(150) for _ in range(3)]
    held, stay, keeper = {}, set(), {}
    mine = defaultdict(set)
    for i, k in keys:
        mine[i].add(k)
    for i in sorted(mine):
        hit = [held[k] for k in mine[i] if k in held]
        if hit:
            keeper[i] = min(hit)
        else:
            stay.add(i)
            for k in mine[i]:
                held[k] = i
    got = dedupe.greedy(spark.createDataFrame(keys, "id int, key string"))
    assert {r.id: r.keeper for r in got.collect()} == keeper


def test_lsh_equal_texts_collide(spark):
    df = spark.createDataFrame([("a", "same text here"), ("b", "same text here"), ("c", "other words entirely"), ("d", "same text here")], "id string, text string")
    assert {r.id: r.class_id for r in dedupe.lsh(df, "id", "text").collect()} == {"a": "a", "b": "a", "c": "c", "d": "a"}


def test_irreducible_overlap_against_loop(spark):
    rng = random.Random(3)
    for ties in (True, False):
        data = [("m", round(rng.random(), 1 if ties else 9), rng.randrange(2)) for _ in range(200)] + [("one class", 0.5, 1)]
        got = {r.model: r for r in overlap.irreducible_overlap(overlap.class_counts(spark.createDataFrame(data, "model string, sim double, hit int"), ["model"]), ["model"]).collect()}
        hits, misses = [s for m, s, h in data if m == "m" and h], [s for m, s, h in data if m == "m" and not h]
        cands = sorted({c for s in hits + misses for c in (s - 1e-9, s + 1e-9)})
        ba = [(sum(s > t for s in hits) / len(hits) + sum(s <= t for s in misses) / len(misses)) / 2 for t in cands]
        assert set(got) == {"m"} and abs(got["m"].io - (1 - max(ba))) < 1e-12 and got["m"].tau_star == cands[ba.index(max(ba))]
        assert 0 <= got["m"].io <= 0.5


def test_running_sums_and_quantiles_of_one_hot_key(spark):
    rng = random.Random(8)
    data = [(None if k % 50 == 0 else "hot", rng.choice([0.1, 0.2, rng.random()]), 1) for k in range(2000)] + [("one", 0.7, 1)]
    df = spark.createDataFrame(data, "g string, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    values = defaultdict(list)
    for g, v, _ in data:
        values[g].append(v)
    for r in skew.running_sums(df, ["g"], ["v"], ["n"]).collect():
        assert r.all_n == len(values[r.g]) and r.run_n == sum(x <= r.v for x in values[r.g])
    for r in overlap.quantiles(df, ["g"], "v", "n", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert np.allclose(r.q, np.quantile(values[r.g], [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert overlap.quantiles(df.limit(0), ["g"], "v", "n", [0.5]).count() == 0
    assert np.allclose(overlap.quantiles(df.groupBy("v").agg(F.sum("n").alias("n")), [], "v", "n", [0.5]).first().q, [np.median([v for _, v, _ in data])])


def test_ks_and_summary(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 80).round(2), rng.normal(0.5, 1, 70).round(2)
    df = spark.createDataFrame([("g", float(x), 1) for x in a] + [("g", float(x), 0) for x in b], "g string, sim double, side int")
    points = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    r = overlap.ks_test(df, ["g"], "side").first()
    assert abs(r.d - d) < 1e-12 and 0 <= r.p <= 1
    s = overlap.summary(df, ["side"]).filter("side = 1").first()
    assert abs(s["std"] - a.std()) < 1e-9 and abs(s["p75"] - np.quantile(a, 0.75)) < 1e-9


def test_best_tau_takes_the_lowest(spark):
    df = spark.createDataFrame([(0.99, 1, "slope"), (0.5, 0, "cliff"), (0.5, 0, "slope")], "sim double, hit int, axis_group string")
    assert decision.best_tau(df, []).first().tau == 0.7
    sweep = decision.sweep(df.filter("hit = 1"), [])
    assert sweep.filter("false_hit = 0 AND false_hit_slope = 0").count() == 29
    assert decision.utility(df, []).count() == len(decision.RHOS) == 23


def test_ratios_are_nan_where_empty(spark):
    row = {c: 0 for c in decision.COUNTS} | {"n": 3, "hits": 3, "false_misses": 1}
    r = decision.ratios(spark.createDataFrame([("A", *row.values())], ["config", *row]), ["config"]).first()
    assert math.isnan(r.false_hit) and abs(r.hit_rate_on_hits - 2 / 3) < 1e-12


def test_bootstrap_of_one_cluster_is_that_cluster(spark):
    df = spark.createDataFrame([("s", 3, 10)], "seed_id string, k int, n int")
    reps = bootstrap.replicates(df, "seed_id", ["k", "n"], 20)
    drawn = [(r.k, r.n) for r in reps.collect()]
    assert all(k * 10 == n * 3 and k % 3 == 0 for k, n in drawn) and 5 < len(drawn) < 20  # in a third of the replicates it isn't drawn
    many = spark.createDataFrame([(f"s{i}", i % 2, 1) for i in range(300)], "seed_id string, k int, n int")
    shares = [r.k / r.n for r in bootstrap.replicates(many, "seed_id", ["k", "n"], 400).collect()]
    assert abs(np.mean(shares) - 0.5) < 0.01 and abs(np.std(shares) - math.sqrt(0.25 / 300)) < 0.005
    long = spark.createDataFrame([("m", float(i)) for i in range(100)] + [("m", float("nan"))], "metric string, value double")
    assert tuple(bootstrap.percentile_interval(long, ["metric"], "value").first())[1:] == pytest.approx((2.475, 96.525))
    assert tuple(bootstrap.order_interval(long.filter("NOT isnan(value)"), ["metric"], "value", 100).first())[1:] == (2.0, 96.0)


def test_agreement_formulas(spark):
    votes = [("SAME", "SAME", "SAME"), ("SAME", "SAME", "DIFFERENT"), ("DIFFERENT", "DIFFERENT", "DIFFERENT"), ("UNSURE", "SAME", "DIFFERENT")]
    df = agreement.majority(spark.createDataFrame([(i, *v) for i, v in enumerate(votes)], "i int, a string, b string, c string"), ["a", "b", "c"])
    assert [r.gold for r in df.orderBy("i").collect()] == ["SAME", "SAME", "DIFFERENT", None]
    r = agreement.fleiss(agreement.rater_sums(df.filter("n_same + n_diff = 3").withColumn("agree", F.lit(1)), []), []).first()
    raw, p = (6 + 2 + 6) / 6 / 3, 5 / 9
    assert abs(r.kappa - (raw - (p * p + (1 - p) ** 2)) / (1 - (p * p + (1 - p) ** 2))) < 1e-12
    assert abs(r.ac1 - (raw - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p))) < 1e-12
    same = agreement.pairwise(df, ["a", "b", "c"]).filter("pair = 'a-b'").first()
    assert same.n == 4 and same.raw == 0.75
    lo, hi = spark.range(1).select(*stats.wilson(F.lit(8.0), F.lit(10))).first()
    assert abs(lo - 0.4902) < 1e-3 and abs(hi - 0.9433) < 1e-3


def test_special_functions():
    assert abs(stats.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(stats.chi2_tail(15.507313, 8) - 0.05) < 1e-6
    assert abs(stats.normal_tail(1.959964) - 0.05) < 1e-6 and stats.chi2_tail(0, 3) == 1
    assert abs(stats.studentised_range_tail(3.102 * math.sqrt(2), 9) - 0.05) < 2e-3


def test_ranks(spark):
    t = spark.createDataFrame([(e, b, v) for b in range(4) for e, v in (("x", 1.0), ("y", 2.0), ("z", 2.0 if b else 3.0))], "encoder string, block int, value double")
    assert {r.encoder: r.mean_rank for r in ranks.mean_ranks(t).collect()} == {"x": 1.0, "y": (2 + 2.5 * 3) / 4, "z": (3 + 2.5 * 3) / 4}
    f = ranks.friedman(t).first()
    sums = [4.0, 9.5, 10.5]
    raw = 12 / (4 * 3 * 4) * sum(s * s for s in sums) - 3 * 4 * 4
    assert abs(f.chi2 - raw / (1 - 3 * 6 / (4 * 24))) < 1e-9
    c = spark.createDataFrame([("a", 1.0), ("b", 1.5), ("c", 2.4), ("d", 5.0)], "encoder string, mean_rank double")
    assert [tuple(r) for r in ranks.cliques(c, 1.0).orderBy("first").collect()] == [("a", "b", 2), ("b", "c", 2)]
    k = spark.createDataFrame([(g, i, v) for g, vs in (("p", (1, 2, 3, 4)), ("q", (1, 3, 2, 4))) for i, v in zip("wxyz", map(float, vs), strict=True)], "g string, i string, v double")
    assert abs(ranks.kendall(k, "g", "i", "v").first().tau - 4 / 6) < 1e-12


def test_edges_over_blocks_and_triples(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (500, None)], "vec_id bigint, embedding array<double>")
    s = x @ x.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] > 0.5}
    for block in (7, 1000):
        e = graph.edges(df, 0.5, block=block).cache()
        assert {(r.i, r.j) for r in e.collect()} == want
    adj = defaultdict(set)
    for i, j in want:
        adj[i].add(j)
        adj[j].add(i)
    paths = [(a, b, c) for b in adj for a in adj[b] for c in adj[b] if a < c]
    r = graph.transitivity(e).first()
    assert (r.triples, r.violations) == (len(paths), sum((a, c) not in want for a, _, c in paths))
    hub = spark.createDataFrame([(0, k, 1.0) for k in range(1, 400)] + [(1, 2, 1.0)], "i bigint, j bigint, sim double")
    r = graph.transitivity(hub).first()
    assert (r.triples, r.violations) == (399 * 398 // 2 + 2, 399 * 398 // 2 + 2 - 3)
    np.fill_diagonal(s, -2)
    near = {r.id: r.nearest for r in graph.nearest(df, block=7).collect()}
    assert near == {i: int(s[i].argmax()) for i in range(90)}
    assert graph.edges(df.limit(0), 0.5).count() == 0


def test_cache_walk_properties():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((80, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = cachesim.permutation(1, 80)
    free = list(cachesim.walk(x, order, 0.7))
    assert free == list(cachesim.walk(x, order, 0.7, policy="fifo", capacity=80)) == list(cachesim.walk(x, order, 0.7, policy="lru", capacity=80))
    assert all(s < 0 for _, _, s, _ in cachesim.walk(x, order, 1.001))
    strict = {t for t, _, s, _ in cachesim.walk(x, order, 0.7, accept=lambda i, j, s: s > 0.7 and (i + j) % 2) if s >= 0}
    assert all(s < 0 or (i + s) % 2 for t, i, s, _ in cachesim.walk(x, order, 0.7, accept=lambda i, j, s: s > 0.7 and (i + j) % 2)) and strict
    line = np.eye(3)
    assert [s for *_, s, _ in cachesim.walk(line, [0, 1, 0, 2, 0, 1], 0.5, policy="lru", capacity=2)] == [-1, -1, 0, -1, 0, -1]
    assert [s for *_, s, _ in cachesim.walk(line, [0, 1, 0, 2, 0, 1], 0.5, policy="fifo", capacity=2)] == [-1, -1, 0, -1, -1, -1]
    draws = cachesim.zipf(0, 50, 1.2, 4000)
    assert len(draws) == 4000 and Counter(draws).most_common(1)[0][1] > 400


def test_simulate_refuses_large_workloads(spark, monkeypatch):
    monkeypatch.setattr(cachesim, "MAX_ITEMS", 3)
    items = spark.createDataFrame([(i, [1.0]) for i in range(5)], "item int, vec array<double>")
    with pytest.raises(ValueError):
        cachesim.simulate(items, cachesim.settings(spark, [0.5], 1))


def test_windows(spark):
    df = spark.createDataFrame([(f"k{i % 7}", i, f"f{i % 11}") for i in range(100)], "k string, v int, f string")
    n = windows.number_rows(df, [F.desc("v")])
    assert all(r.n == 99 - r.v for r in n.collect())
    assert Counter(r.batch for r in windows.batches(df, [F.col("v")], 30).collect()) == {0: 30, 1: 30, 2: 30, 3: 10}
    assert sorted(r.v for r in windows.slice_rows(df, [F.col("v")], 3, 5).collect()) == [2, 3, 4]
    kept = Counter(r.f for r in windows.family_sample(df, "f", 25).collect())
    assert 25 <= sum(kept.values()) <= 34 and all(n in (9, 10) for n in kept.values())
    folds = windows.folds(df.select("f").distinct().withColumn("s", F.lit("x")), "s", "f", 3)
    assert sorted(Counter(r.fold for r in folds.collect()).values()) == [3, 4, 4]
    assert windows.last_wins(df, ["k"], "v").agg(F.min("v")).first()[0] == 93
    rr = windows.round_robin(spark.createDataFrame([("g", s, i) for i, s in enumerate("aaabbc")], "g string, s string, p int"), "g", "s", "p", 4)
    assert sorted(r.p for r in rr.collect()) == [0, 1, 3, 5]
    assert windows.number_rows(df.limit(0), [F.col("v")]).count() == 0


def test_skew_helpers(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(300)}", i) for i in range(1500)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k string, v int")
    counts = Counter(k for k, _ in rows if k)
    right = spark.createDataFrame([(k, n, k.upper()) for k, n in counts.items() if k != "k1"], "k string, w int, u string")
    for how in ("inner", "left"):
        got = skew.lookup_join(df, right, "k", "w", len(rows), how, heavy=10).collect()
        assert len(got) == sum(1 for k, _ in rows if (k and k != "k1") or how == "left") and all(r.u == (r.k.upper() if r.k and r.k != "k1" else None) for r in got)
    sums = skew.prefix_sums(df, ["k"], F.xxhash64("v"), F.col("v"), "before").withColumn("o", F.xxhash64("v")).collect()
    groups = defaultdict(list)
    for r in sums:
        groups[r.k].append((r.o, r.v, r.before))
    for g in groups.values():
        total = 0
        for _, v, before in sorted(g):
            assert before == total
            total += v
    assert {r.k for r in skew.heavy_keys(df, ["k"], 10).collect()} == {"hot"}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.strip(F.lit("\t a \n\x1c"))) == "a" and one(text.fold(F.lit(" \t"))) is None
    assert one(text.number_slots(F.lit("3,5 and 7/8 ٣"))) == sorted(["3,5", "7/8", "٣"])
    assert one(text.acronym_slots(F.lit("ĐH ÀBC AB x"))) == ["AB", "ĐH"]
    assert one(text.normalise_answer(F.lit("  A-b, C!  đ "))) == "a b c đ"
    assert one(text.shingles(F.lit("ab"))) == ["ab"] and one(text.shingles(F.lit(""))) == [""]
    assert one(text.padded_trigrams(F.lit(" Ab "))) == ["  a", " ab", "ab ", "b  "]
    assert one(text.length_gap(F.lit(""), F.lit(""))) == 0.0
    assert one(prompts.between(F.lit("x <a>mid<b> y"), "<a>", "<b>")) == "mid" and one(prompts.between(F.lit("x"), "<a>", "<b>")) is None
    assert one(prompts.version(F.lit("---\nversion: 1.2\n---"))) == "1.2" and one(prompts.first_integer(F.lit("got 17 rows"))) == 17
    assert one(prompts.milliseconds(F.lit("2026-01-01T00:00:00Z"), F.lit("2026-01-01T00:00:01.5Z"))) == 1500.0
    df = spark.createDataFrame([("a", "same", "same"), ("b", "", ""), ("c", None, "x")], "id string, seed_question string, variation string")
    got = {r.id: r.sim for r in pair_cosine(df).collect()}
    assert abs(got["a"] - 1) < 1e-12 and len(got) == 3


def test_validators(spark):
    v = spark.createDataFrame(
        [("d1_s0001_N1_v1", "d1_s0001", "t", "N1", "slope", "MISS", None, "g", "b"), ("bad", "s", "t", "P9", "x", "HIT", None, "g", "b"), ("d1_s0001_P1_v1", "s", "", "P1", "slope", "MISS", None, "g", "b")],
        "id string, seed_id string, variation string, axis string, axis_group string, expected_label string, delta string, generator_model string, batch_id string",
    )
    got = {(r.id, r.problem) for r in validate.problems(v, validate.variations(), ["id"]).collect()}
    assert got == {("d1_s0001_N1_v1", "a change axis needs a delta"), ("bad", "id has another form"), ("bad", "axis is not in the taxonomy"), ("d1_s0001_P1_v1", "variation is absent or empty")}
    r = spark.createDataFrame([("1", "I", "P1", "en", " a", "a ", "HIT"), ("2", "IV", "P1", "en", "a", "b", "HIT"), ("3", "II", "P1", "fr", "a", "b", "HIT"), (None, "I", "P1", "en", "a", "b", "HIT")], "pair_id string, group string, axis string, lang string, q1 string, q2 string, expected string")
    got = Counter((x.pair_id, x.problem) for x in validate.problems(r, validate.risk_pairs(), ["pair_id"]).collect())
    assert got == Counter([("1", "both questions are the same"), ("2", "group is not a Roman one to three"), ("3", "axis lies in another group"), ("3", "expected is not the group's label"), ("3", "language is neither en nor vi"), (None, "pair_id is absent or empty")])
    with pytest.raises(ValueError):
        validate.require(v, 4, "variations")
    assert validate.require(v, 3, "variations").count() == 3


def test_assembled_numbers_after_dropping(spark):
    raw = spark.createDataFrame([("s", "P1", " a ", 1), ("s", "P1", "a", 2), ("s", "P1", "q", 3), ("s", "P1", "b", 4), ("s", "X", "c", 5), ("t", "P1", "d", 6), ("s", "P1", " ", 7)], "seed_id string, axis string, text string, line int")
    seeds = spark.createDataFrame([("s", "q ")], "seed_id string, question string")
    assert sorted((r.id, r.text) for r in freeze.assembled(raw, seeds, [F.col("line")]).collect()) == [("s_P1_v1", "a"), ("s_P1_v2", "b")]


def test_ledger(spark):
    rows = [("A", 0, "1", "running", 1, 1, None), ("A", 0, "1", "done", 1, 2, "n1"), ("A", 0, "2", "failed", 1, 1, None), ("B", 1, "1", "pending", 1, 1, None), ("B", 1, "0", "pending", 1, 1, "n2"), ("C", 2, "1", "done", 4, 1, None)]
    e = ledger.state(spark.createDataFrame(rows, "stage string, stage_pos int, batch_id string, status string, n int, ts int, note string"))
    assert {r.stage: (r.batches, r.status) for r in ledger.roll_up(e).collect()} == {"A": (2, "done_with_failures"), "B": (2, "pending"), "C": (1, "done")}
    assert ledger.next_pending(e).first().batch_id == "0" and ledger.last_notes(e, 1).first().note == "n1"
