import itertools
import random
from collections import Counter, defaultdict

from bandwright.llm import splits

FINAL, SEEDS, SOURCES = "id string, seed_id string, domain string, doc_id string", "seed_id string, doc_id string, domain string", "doc_id string, editor string, url string, title string"


def components(final, seeds, sources):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for d, e, u, _ in sources:
        for k, v in (("e", e), ("u", u)):
            if v and v.strip() and d:
                parent[find(("d", d))] = find((k, v.strip().lower()))
    doc = {s: d for s, d, _ in seeds}
    sets = defaultdict(set)
    for _, s, *_ in final:
        if s:
            sets[find(("d", doc[s])) if doc.get(s) else ("s", s)].add(s)
    return list(sets.values())


def test_against_union_find(spark):
    rng = random.Random(6)
    for n in (0, 5, 120):
        seeds = [(f"s{i:03d}", rng.choice([None, "", *[f"doc{j}" for j in range(n)]]), "x") for i in range(n)]
        chain = [(f"doc{j}", f"E{j // 2}", f"u{(j + 1) // 2}", "t") for j in range(0, n, 3)]
        sources = chain + [(f"doc{rng.randrange(n)}", rng.choice([None, " ", f" e{rng.randrange(40)} ", f"E{rng.randrange(40)}"]), rng.choice([None, "", f"u{rng.randrange(60)}"]), "t") for _ in range(n)] + [(None, "e1", "u1", "t")]
        final = [(f"r{k}", rng.choice([s for s, *_ in seeds] + [None, "unknown"]), rng.choice(["a", " A", "b", None]), "q") for k in range(3 * n)]
        args = spark.createDataFrame(final, FINAL), spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(sources, SOURCES)
        sets = components(final, seeds, sources)
        want = {(min(v), s) for v in sets for s in v if s != min(v)}
        assert {tuple(r) for r in splits.smallest(splits.tied_seeds(*args)).collect()} == want
        got = splits.assign(*args).collect()
        assert Counter(r.id for r in got) == Counter(r[0] for r in final)
        split = defaultdict(set)
        for r in got:
            split[r.seed_id].add(r.split)
        assert all(len(set().union(*(split[s] for s in v))) == 1 for v in sets)


def test_long_path_and_hub(spark):
    path = [(f"v{i:03d}", f"v{(i + 1):03d}") for i in range(60)]
    random.Random(1).shuffle(path)
    hub = [("z", f"y{i:03d}") for i in range(200)]
    got = {r.v: r.root for r in splits.components(spark.createDataFrame(path + hub + [("m", "m"), (None, "m")], "a string, b string")).collect()}
    assert all(got[f"v{i:03d}"] == "v000" for i in range(61)) and got["z"] == "y000" and got["y199"] == "y000" and got["m"] == "m"


def test_closest_is_best():
    rng = random.Random(2)
    for _ in range(40):
        sizes = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        target = rng.randrange(0, 120)
        took = splits.closest(sizes, target)
        assert all(took[s] <= sizes[s] for s in took)
        best = min(abs(sum(s * c for s, c in zip(sizes, cs, strict=True)) - target) for cs in itertools.product(*[range(n + 1) for n in sizes.values()]))
        assert abs(sum(s * c for s, c in took.items()) - target) == best


def test_shares_are_near(spark):
    final = [(f"r{i}-{k}", f"s{i}", "a" if i % 2 else "b", "q") for i in range(400) for k in range(1 + i % 5)]
    got = Counter((r.domain, r.split) for r in splits.assign(spark.createDataFrame(final, FINAL), spark.createDataFrame([], SEEDS), spark.createDataFrame([], SOURCES)).collect())
    for d in "ab":
        n = sum(v for (x, _), v in got.items() if x == d)
        assert all(abs(got[d, s] - share * n) <= 1 for s, share in zip(splits.SPLITS, splits.SHARES, strict=True))


def test_a_seed_with_several_documents_ties_them(spark):
    seeds = [("a", "d1", "x"), ("b", "d1", "x"), ("b", "d2", "x"), ("c", "d2", "x"), ("e", "d3", "x"), ("u", "d1", "x"), ("u", "d3", "x")]
    final = [(f"r{s}", s, "x", "q") for s in ("a", "b", "c", "e")]  # u has no record and ties nothing
    tied = splits.tied_seeds(spark.createDataFrame(final, FINAL), spark.createDataFrame(seeds, SEEDS), spark.createDataFrame([], SOURCES))
    assert {tuple(r) for r in splits.smallest(tied).collect()} == {("a", "b"), ("a", "c")}


def test_closest_on_spread_sizes():
    rng = random.Random(3)
    for _ in range(60):
        sizes = {rng.choice([7, 14, 21, 30, 31, 60, 90, 500]) * rng.choice([1, 2]): rng.randrange(1, 5) for _ in range(5)}
        target = rng.randrange(0, 900)
        reach = {0}
        for s, n in sizes.items():
            reach = {r + s * k for r in reach for k in range(n + 1)}
        took = splits.closest(sizes, target)
        assert all(took[s] <= sizes[s] for s in took)
        assert abs(sum(s * c for s, c in took.items()) - target) == min(abs(r - target) for r in reach)


def test_closest_needs_little_memory():
    import tracemalloc

    rng = random.Random(4)
    sizes = {rng.randrange(1, 100_000): rng.randrange(1, 10_000) for _ in range(1000)}
    target = sum(s * n for s, n in sizes.items()) // 10
    tracemalloc.start()
    took = splits.closest(sizes, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s * n for s, n in took.items()) == target and peak < 500_000_000


def test_closest_where_only_one_odd_size_can_help():
    assert sum(s * n for s, n in splits.closest({2: 10_000_000, 1_001: 3}, 5_000_001).items()) == 5_000_001
    assert splits.closest({10: 4}, 15) in ({10: 1}, {10: 2}) and splits.closest({10: 4}, 100) == {10: 4} and splits.closest({}, 5) == {} and splits.closest({3: 1}, 0) == {}


def test_components_over_several_domains_and_a_hot_one(spark):
    final = [(f"h{i}", "hot", "a", "q") for i in range(300)]
    final += [(f"m{i}-{k}", f"m{i}", "ab"[k % 2], "q") for i in range(40) for k in range(2 + i % 4)]
    final += [(f"r{i}-{k}", f"s{i}", "ab"[i % 2], "q") for i in range(300) for k in range(1 + i % 3)] + [(f"n{i}", f"n{i}", None, "q") for i in range(20)]
    rows = splits.assign(spark.createDataFrame(final, FINAL), spark.createDataFrame([], SEEDS), spark.createDataFrame([], SOURCES)).collect()
    assert Counter(r.id for r in rows) == Counter(r[0] for r in final)
    got = Counter((r.domain, r.split) for r in rows)
    for d in ("a", "b", None):
        n = sum(v for (x, _), v in got.items() if x == d)
        assert all(abs(got[d, s] - share * n) <= 1 for s, share in zip(splits.SPLITS, splits.SHARES, strict=True)), (d, got)
