from collections import Counter, defaultdict

import pytest

from bandwright.llm import mixing

TARGETS = "mix_id int, source string, target_weight double, max_uses int, budget_tokens bigint"


def test_schedule_stays_within_a_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    blocks = {s: round(w * 400) for s, w in weights.items()}
    out = list(mixing.schedule(blocks, weights))
    assert Counter(s for s, *_ in out) == blocks and len({t for *_, t in out}) == len(out)
    done = Counter()
    for s, j, t in sorted(out, key=lambda x: x[2]):
        assert done[s] == j
        done[s] += 1
        assert all(abs(done[x] - weights[x] * (t + 1)) < 1 for x in weights)


def test_mix_and_shares(spark):
    docs = [(i, s, t) for i, (s, t) in enumerate([("a", 10)] * 50 + [("b", 7)] * 20 + [("hot", 3)] * 400 + [(None, 5), ("a", 0)])]
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = [(1, " A ", 0.5, 2, 1000), (1, "b", 0.3, 2, 1000), (1, "none", 0.2, 1, 1000), (2, "hot", 1.0, 1, 900), (3, "b", 0.0, 1, 10)]
    t = spark.createDataFrame(targets, TARGETS)
    reach = {(r.mix_id, r.source): r for r in mixing.reach(counted, t).collect()}
    assert {k for k, r in reach.items() if r.short} == {(1, "b"), (1, "none")}
    assert reach[1, " A "].available_tokens == 1000 and reach[1, "b"].available_tokens == 280
    rows = mixing.mix(counted, t).collect()
    uses = Counter((r.mix_id, r.source, r.doc_id) for r in rows)
    assert max(n for (m, *_), n in uses.items() if m == 1) <= 2 and all(n == 1 for (m, *_), n in uses.items() if m == 2)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.mix_id, r.source] += r.tokens
    assert 500 <= tokens[1, " A "] < 510 and tokens[1, "b"] == 280 and 900 <= tokens[2, "hot"] < 903
    share = {(r.mix_id, r.source): r for r in mixing.shares(counted, t).collect()}
    assert len(share) == 5 and share[1, "none"].used_tokens == 0 and abs(share[1, "b"].share - 280 / (280 + tokens[1, " A "])) < 1e-9


def test_sources_stay_within_a_block_of_their_share_whatever_the_budget(spark):
    docs = [(i, s, 1 + i % 9) for i, s in enumerate(["a", "b", "hot", "hot", "hot"] * 600)]
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    weights, block = {"a": 0.2, "b": 0.15, "hot": 0.65}, 64
    for budget in (500, 8000):
        t = spark.createDataFrame([(1, s, w, 5, budget) for s, w in weights.items()], TARGETS)
        rows = sorted(mixing.slots(mixing.reach(counted, t), block).collect(), key=lambda r: r.slot)
        assert len({r.slot for r in rows}) == len(rows) and not mixing.lacking(mixing.reach(counted, t), block).count()
        done = Counter()
        for n, r in enumerate(rows, 1):
            done[r.source] += 1
            assert all(abs(done[s] - w * n) < 1 + 1e-9 for s, w in weights.items()) or n > len(rows) - 4
        got = mixing.mix(counted, t, block=block).collect()
        slot = {(r.source, r.block): r.slot for r in rows}
        assert all(slot[r.source, r.block] == r.slot and r.start // block == r.block for r in got)


def test_lacking_is_what_reach_says(spark):
    counted = spark.createDataFrame([(1, "a", 1000), (2, "b", 4096), (3, "c", 4097)], "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([(m, s, 1 / 3, u, b) for m, (b, u) in enumerate(((3000, 1), (3001, 1), (12288, 1), (12289, 1), (24576, 2), (0, 1)), 1) for s in ("a", " B", "c", None)] + [(None, "a", 1.0, 1, 1001)], TARGETS)
    reached = mixing.reach(counted, t)
    want = {(r.mix_id, r.source) for r in reached.collect() if r.short}
    assert {(r.mix_id, r.source) for r in mixing.lacking(reached).collect()} == want and (None, "a") in want and (1, None) in want


def test_sizes_and_empty(spark):
    df = spark.createDataFrame([(1, " A\t", "one two", 5), (2, None, None, 5), (3, "", "", 5)], "doc_id bigint, source string, text string, tokens int")
    assert sorted((r.doc_id, r.source, r.tokens) for r in mixing.sizes(df).collect()) == [(1, "a", 2), (2, None, 0), (3, None, 0)]
    t = spark.createDataFrame([(1, "a", 1.0, 1, 10)], TARGETS)
    assert mixing.mix(mixing.sizes(df.limit(0)), t).count() == 0 and mixing.reach(mixing.sizes(df.limit(0)), t).first().short
    assert mixing.mix(mixing.sizes(df), t.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.9, "b": 0.1}, {f"s{i}": 1 / 7 for i in range(7)}])
def test_no_slot_twice(weights):
    out = list(mixing.schedule({s: 20 for s in weights}, weights))
    assert len({t for *_, t in out}) == len(out) == 20 * len(weights)
