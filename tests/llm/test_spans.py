import random

import pytest

from bandwright.llm import spans

SCHEMA = "doc_id bigint, text string, id string, h bigint"
L, B = 40, 16


def brute(docs, length):
    grams = {}
    for i, t, *_ in docs:
        if i is not None and t:
            for p in range(len(t) - length + 1):
                grams.setdefault(t[p : p + length], set()).add(i)
    pairs, cover = set(), {}
    for s in grams.values():
        pairs |= {(a, b) for a in s for b in s if a < b}
    for i, t, *_ in docs:
        if i is None:
            continue
        inside = set()
        for p in range(len(t or "") - length + 1):
            if len(grams[t[p : p + length]]) > 1:
                inside |= set(range(p, p + length))
        cover[i] = len(inside)
    return pairs, cover


def words(rng, n, alphabet="abcdefgh "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus(rng):
    quote, note, header = words(rng, 90), words(rng, 60, "đ👩xyz "), words(rng, L - 1)
    docs = [words(rng, rng.randrange(0, 300)) for _ in range(40)]
    docs += [words(rng, rng.randrange(50)) + quote + words(rng, 30) for _ in range(4)]
    docs += [words(rng, 40) + quote[:L] + words(rng, 5), quote[10 : 10 + L], quote[-L:], quote[: L - 1]]
    docs += [header + words(rng, 80) for _ in range(30)] + [words(rng, 20) + note + words(rng, 20)] * 3 + [note]
    docs += [" " * 200, " " * 60, "ab" * 100, "ab" * 30 + "c", "", None, "x" * (L - 1), "z" * L, "z" * L]
    data = [(i, t, "k", 1) for i, t in enumerate(docs)]
    return data + [(None, quote, "k", 1)]


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_against_brute_force(spark, crowd):
    for seed in range(2):
        data = corpus(random.Random(seed))
        pairs, cover = brute(data, L)
        df = spark.createDataFrame(data, SCHEMA)
        shared = spans.Shared(df, length=L, block=B, crowd=crowd)
        assert {(r.a, r.b) for r in shared.pairs().collect()} == pairs
        got = {r.id: r for r in spans.coverage(spans.parse(shared.matches()), df).collect()}
        assert {i: r.shared_chars for i, r in got.items()} == cover
        assert all(r.chars == len(data[i][1] or "") for i, r in got.items())


def test_pieces_of_long_text(spark, monkeypatch):
    rng = random.Random(9)
    shared = words(rng, L)
    long = words(rng, 2 * spans.PIECE - 10) + shared + words(rng, 1000)
    df = spark.createDataFrame([(1, long, "k", 1), (2, "q" + shared, "k", 1), (3, words(rng, 500), "k", 1)], SCHEMA)
    got = spans.Shared(df, length=L, block=B)
    assert {(r.a, r.b) for r in got.pairs().collect()} == {(1, 2)}


def test_repeated_id_and_empty(spark):
    text = words(random.Random(3), 100)
    df = spark.createDataFrame([(5, text, "k", 1), (5, text, "k", 1)], SCHEMA)
    assert spans.Shared(df, length=L, block=B).pairs().count() == 0
    other = "A" + text[5:]
    both = spark.createDataFrame([(5, text, "k", 1), (5, other, "k", 1), (6, other, "k", 1), (7, text[: L + 2], "k", 1)], SCHEMA)
    want, _ = brute([(5, min(text, other)), (6, other), (7, text[: L + 2])], L)
    assert {(r.a, r.b) for r in spans.Shared(both, length=L, block=B).pairs().collect()} == want
    assert spans.Shared(df.limit(0), length=L, block=B).pairs().count() == 0
    assert spans.coverage(spans.parse(spans.Shared(df.limit(0), length=L, block=B).matches()), df).count() == 1


def test_common():
    assert spans.common("abc", "abd") == 2 and spans.common("", "a") == 0 and spans.common("aa", "aaa") == 2 and spans.common("b", "a") == 0


def test_parse_goes_on_from_the_end_of_a_factor(spark):
    matches = [(1, 0, 50), (1, 10, 90), (1, 20, 70), (1, 80, 130), (1, 95, 135), (1, 300, 340), (2, 5, 45)]
    got = sorted(tuple(r) for r in spans.parse(spark.createDataFrame(matches, "id bigint, lo bigint, hi bigint")).collect())
    assert got == [(1, 0, 50, 50), (1, 10, 90, 40), (1, 80, 130, 40), (1, 95, 135, 5), (1, 300, 340, 40), (2, 5, 45, 40)]


def test_large_sets_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spans, "PART", 3)
    rng = random.Random(4)
    note, other = words(rng, L + 20), words(rng, L + 5)
    docs = [words(rng, rng.randrange(9)) + note for _ in range(15)] + [note + other] * 7 + [other + words(rng, 9) for _ in range(8)]
    data = [(i, t, "k", 1) for i, t in enumerate(docs)]
    got = [(r.a, r.b) for r in spans.Shared(spark.createDataFrame(data, SCHEMA), length=L, block=B).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, L)[0]
