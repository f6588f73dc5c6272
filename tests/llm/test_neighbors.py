import numpy as np

from bandwright.llm import neighbors

SCHEMA = "vec_id bigint, vec array<float>, id string, sim double"


def brute(data, k, floor):
    seen = {}
    for i, v, *_ in data:
        if i is None or v is None or len(v) != 64 or any(e is None or not np.isfinite(e) for e in v) or not any(v):
            continue
        v = tuple(np.float32(v))
        seen[i] = min(seen.get(i, v), v)
    ids = np.array(sorted(seen), dtype=np.int64)
    x = np.array([seen[i] for i in ids], dtype=np.float64).reshape(-1, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for a in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != a and s[a, j] >= floor), key=lambda j: (-s[a, j], ids[j]))[:k]
        out |= {(int(ids[a]), int(ids[j])) for j in order}
    return out


def make(rng, n, families):
    base = rng.standard_normal((families, 64))
    return [(i, (base[i % families] + 0.25 * rng.standard_normal(64)).astype(float).tolist(), "x", 0.0) for i in range(n)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data = make(rng, 400, 60)
    data += [(1000 + i, data[3][1], "x", 0.0) for i in range(40)]  # a crowd of equal vectors
    data += [(2000 + i, [2 * e for e in data[i][1]], "x", 0.0) for i in range(5)]  # the same direction
    data += [(3000, None, "x", 0.0), (3001, [0.0] * 64, "x", 0.0), (3002, [1.0] * 63, "x", 0.0), (3003, [float("nan")] * 64, "x", 0.0), (3004, [None] * 64, "x", 0.0), (None, data[0][1], "x", 0.0), (7, data[7][1], "x", 0.0), (8, data[9][1], "x", 0.0)]
    got = neighbors.nearest(spark.createDataFrame(data, SCHEMA), 5, 0.9)
    assert {(r.id, r.other) for r in got.collect()} == brute(data, 5, 0.9)


def test_recall_when_the_ascent_ends_early(spark):
    data = make(np.random.default_rng(1), 3000, 400)
    want = brute(data, 5, 0.9)
    rows, got = spark.createDataFrame(data, SCHEMA), []
    for n in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({(r.id, r.other) for r in neighbors.nearest(rows, 5, 0.9, enough=200, piece=700).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(want) > 1000 and len(got[0] & want) / len(want) >= 0.9 and got[0] == got[1]


def test_levels(spark):
    """The level is the longest prefix at which all trees together hold enough others."""
    rng = np.random.default_rng(3)
    codes = np.sort(rng.integers(0, 1 << 62, (2, 300)) & ~((1 << 40) - 1), axis=1)
    ids = [rng.permutation(300) for _ in range(2)]
    rows = [(t, int(codes[t][r]), int(ids[t][r]), r) for t in range(2) for r in range(300)]
    of = {(t, i): h for t, h, i, _ in rows}
    noted = neighbors.levels(spark.createDataFrame(rows, "tree int, hash bigint, id bigint, rank bigint"), 300, 20, 128, 62).toArrow().combine_chunks()
    got = dict(zip(noted["id"].to_pylist(), neighbors.ascended(noted["notes"].combine_chunks(), 20, 62).tolist(), strict=True))
    for i in range(0, 300, 17):
        sizes = [sum(int(((codes[t] >> (62 - v)) == (of[t, i] >> (62 - v))).sum()) - 1 for t in range(2)) for v in range(63)]
        assert got[i] == max(v for v in range(63) if sizes[v] >= 20)


def test_empty(spark):
    assert neighbors.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbors.nearest(spark.createDataFrame([(1, [1.0] * 64, "x", 0.0)], SCHEMA)).count() == 0


def test_crowds_beyond_the_window(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    near = centre + 0.03 / 8 * rng.standard_normal((900, 64))  # pairwise cosine about 0.999
    line = rng.standard_normal(64)
    data = [(int(i), v.tolist(), "x", 0.0) for i, v in zip(rng.permutation(900), near, strict=True)]
    data += [(1000 + i, ((1 + i / 7) * line).tolist(), "x", 0.0) for i in range(500)]  # multiples of one vector
    data += [(2000 + i, *r[1:]) for i, r in enumerate(make(rng, 300, 60))]
    got = {(r.id, r.other) for r in neighbors.nearest(spark.createDataFrame(data, SCHEMA), 5, 0.9, enough=60, piece=200).collect()}
    want = {p for p in brute(data, 5, 0.9) if p[0] < 2000}
    assert len(want) == 1400 * 5 and {p for p in got if p[0] < 2000} == want
