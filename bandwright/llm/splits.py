"""Train, validation and test splits that keep related records together.

Seeds, documents, editors and addresses are vertices; components come from parallel hooking and shortcutting over tables:
every root with a smaller neighbouring root hooks onto its smallest one, pointer jumping makes the trees stars, edges are
renamed to roots, and what joins a root with itself is dropped, until no edge is left. Parents are looked up with heavy
keys apart, so a hub with a third of all edges is no hot task.

Split sizes: components over several domains are dealt per home domain (that of most of their records), then those within
one domain per domain, towards what the first left of the domain's shares. Every component goes the same way, whatever its size:
components are counted per size, and in one task per domain the totals of the splits, rarest first, are made the closest ones
there are by subset sums over these multiplicities. Which components of a size go where is a hash order. A domain of n
records has at most sqrt(2 n) sizes; nothing is collected to the driver.

Cases: null and blank editors, addresses and documents tie nothing; a seed without a document is alone unless repeated, one with several ties them all; a null seed
stands for no seed: each such record is alone; records without a domain count for their component's domains not at all,
and are a domain of their own if it has none; sources in circles and repeated rows change nothing; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.functions.text import fold
from bandwright.operators.skew import lookup_join, prefix_sums
from bandwright.session import cut, release

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)


def _renamed(rows: DataFrame, key: str, to: DataFrame) -> DataFrame:
    """``rows`` with ``key`` replaced by its parent in ``to`` (v, p) where it has one."""
    total = rows.count()
    weighed = rows.groupBy(key).agg(F.count(F.lit(1)).alias("w")).join(to.withColumnRenamed("v", key), key)
    return lookup_join(rows, weighed, key, "w", total, "left").withColumn(key, F.coalesce("p", key)).drop("p")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b); the root is the smallest vertex of the component."""
    held = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    parents = cut(held.select(F.col("a").alias("v")).union(held.select("b")).distinct().withColumn("root", F.col("v")))
    edges = held.filter("a <> b")
    while not edges.isEmpty():
        hooks = cut(edges.groupBy(F.greatest("a", "b").alias("v")).agg(F.min(F.least("a", "b")).alias("p")))
        while True:  # shortcut until every parent is a root
            h = hooks.select(F.col("v").alias("p"), F.col("p").alias("up"))
            weighed = hooks.groupBy("p").agg(F.count(F.lit(1)).alias("w")).join(h, "p")
            if weighed.isEmpty():
                break
            last, hooks = hooks, cut(lookup_join(hooks, weighed, "p", "w", hooks.count(), "left").select("v", F.coalesce("up", "p").alias("p")))
            release(last)
        last, parents = parents, cut(_renamed(parents, "root", hooks))
        half = cut(_renamed(edges, "a", hooks))
        edges = cut(_renamed(half, "b", hooks).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(last, hooks, half, held)
        held = edges
    return parents


def tied_seeds(final: DataFrame, seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """(seed_id, component, w) of the seeds of ``final``; w is the number of its seeds in the component."""
    doc = F.concat(F.lit("d:"), F.nullif(F.col("doc_id"), F.lit("")))
    ties = [sources.select(doc.alias("a"), F.concat(F.lit(f"{c[0]}:"), fold(F.col(c))).alias("b")) for c in ("editor", "url")]
    own = final.select("seed_id").filter("seed_id IS NOT NULL").distinct()
    placed = seeds.filter("seed_id IS NOT NULL").select("seed_id", doc.alias("v"))
    of = placed.groupBy("seed_id").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    several = of.filter("v <> last").select("seed_id").join(own, "seed_id", "left_semi")
    ties.append(placed.join(several, "seed_id").select(F.col("v").alias("a"), F.concat(F.lit("s:"), "seed_id").alias("b")))  # a seed ties all its documents
    roots = components(reduce(DataFrame.unionByName, ties))
    known = cut(own.join(of, "seed_id", "left").select("seed_id", F.coalesce("v", F.concat(F.lit("s:"), "seed_id")).alias("v")))
    total = known.count()
    weighed = known.groupBy("v").agg(F.count(F.lit(1)).alias("w")).join(roots, "v")
    rooted = cut(lookup_join(known, weighed, "v", "w", total, "left").select("seed_id", F.coalesce("root", "v").alias("component")))
    return rooted


def smallest(tied: DataFrame) -> DataFrame:
    """(seed_id, linked_seed_id): the smallest seed of each component with each of the others."""
    least = tied.groupBy("component").agg(F.min("seed_id").alias("first"), F.count(F.lit(1)).alias("w")).filter("w > 1")
    pairs = lookup_join(tied, least, "component", "w", tied.count())
    return pairs.filter("seed_id <> first").select(F.col("first").alias("seed_id"), F.col("seed_id").alias("linked_seed_id"))


def _reached(bits: int, parts: list[int], mask: int) -> int:
    """Sums reachable from ``bits`` with any of the parts added."""
    for w in parts:
        bits |= bits << w & mask
    return bits


def _taken(bits: int, parts: list[int], at: int) -> list[bool]:
    """Which of the parts lead from ``bits`` to the sum ``at``: bitsets are made again on the way back, so log2(parts) are held at once."""
    if len(parts) == 1:
        return [not bits >> at & 1]
    mask, mid = (1 << at + 1) - 1, len(parts) // 2
    right = _taken(_reached(bits & mask, parts[:mid], mask), parts[mid:], at)
    return _taken(bits, parts[:mid], at - sum(w for w, t in zip(parts[mid:], right, strict=True) if t)) + right


def _nearest(free: dict[int, int], target: int, within: int, higher: bool) -> dict[int, int]:
    """How many of each size add up closest to ``target``, of two sums as close the ``higher`` or the smaller; some sum is within ``within``."""
    parts = []
    for s, n in sorted(free.items()):
        k = 1
        while n > 0:
            parts.append((s, min(k, n)))
            n -= k
            k *= 2
    limit = target + within
    mask, bits, used = (1 << limit + 1) - 1, 1, 0
    for s, n in parts:  # as many parts as it takes to meet the target
        if bits >> target & 1:
            break
        bits |= bits << s * n & mask
        used += 1
    below, above = (bits & ((1 << target + 1) - 1)).bit_length() - 1, bits >> target
    up = (above & -above).bit_length() - 1
    at = below if not above or target - below < up + (not higher) else target + up
    took: dict[int, int] = {}
    if used:
        for (s, n), t in zip(parts[:used], _taken(1, [s * n for s, n in parts[:used]], at), strict=True):
            if t:
                took[s] = took.get(s, 0) + n
    return took


def closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many of each size (1 or more) add up closest to ``target``; no other choice is closer.

    A start takes the same share of every size and fills up with what fits. Bitsets of reachable sums then run over what may
    change: first few of the small sizes by few components, then ever more, until the target is met or the change is as
    large as it can usefully be. Let D be the largest size and e the start's distance. A closest choice that changes least
    has its additions and removals ordered so that the running sum stays within D of the start or beyond it towards the target; no
    running sum comes twice (what lies between could be left out), so it changes at most D + max(D, 2 e) components. So
    the bitsets' lengths depend on the sizes, never on how many components there are.
    """
    sizes = {s: n for s, n in sizes.items() if n > 0}
    if target <= 0 or not sizes:
        return {}
    g = math.gcd(*sizes)
    counts = {s // g: n for s, n in sizes.items()}
    down, rest = divmod(target, g)
    goal = down + (2 * rest > g)  # in units of the common divisor; of two as close the smaller
    whole = sum(s * n for s, n in counts.items())
    if goal >= whole:
        return dict(sizes)
    start = {s: n * goal // whole for s, n in counts.items()}
    left = goal - sum(s * n for s, n in start.items())
    for s in sorted(counts, reverse=True):
        more = min(counts[s] - start[s], left // s)
        start[s] += more
        left -= more * s
    order, most = sorted(counts), max(counts) + max(max(counts), 2 * left)
    few, change = 64, 1
    while left:
        part = order[:few]
        floor = {s: max(0, start[s] - change) for s in part}
        free = {s: n for s in part if (n := min(counts[s], start[s] + change) - floor[s])}
        took = _nearest(free, left + sum(s * (start[s] - floor[s]) for s in part), left, 0 < rest and goal == down)
        best = start | {s: floor[s] + took.get(s, 0) for s in part}
        if sum(s * n for s, n in best.items()) == goal or (few >= len(order) and change >= min(most, max(counts.values()))):
            start = best
            break
        few, change = few * 4, change * 4
    return {s * g: n for s, n in start.items() if n}


def dealt(sizes: dict[int, int], want: list[float]) -> dict[int, list[int]]:
    """Components of each size per split, the totals as close to ``want`` as can be, the rarest split first; the last takes the rest."""
    order = sorted(range(len(want)), key=lambda k: (want[k], -k))
    left, given = dict(sizes), {s: [0] * len(want) for s in sizes}
    for k in order[:-1]:
        for s, n in closest(left, math.floor(want[k] + 0.5)).items():
            given[s][k] = n
            left[s] -= n
    for s, n in left.items():
        given[s][order[-1]] = n
    return given


def _deal(parts: DataFrame, want: DataFrame) -> DataFrame:
    """(component, split) of ``parts`` (component, of, size), as ``want`` (of, want array<double>) has it for every ``of``."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        given = dealt(dict(zip(rows["size"].tolist(), rows["w"].tolist(), strict=True)), list(rows["want"].iloc[0]))
        ends = [[sum(given[s][: k + 1]) for k in range(len(given[s]))] for s in rows["size"].tolist()]
        return pd.DataFrame({"of": rows["of"], "size": rows["size"], "w": rows["w"], "ends": ends})

    counts = parts.groupBy("of", "size").agg(F.count(F.lit(1)).alias("w")).join(want.withColumnRenamed("of", "__of"), F.col("of").eqNullSafe(F.col("__of"))).drop("__of")
    ends = cut(counts.groupBy("of").applyInPandas(one, "of string, size bigint, w bigint, ends array<bigint>"))
    keyed = cut(prefix_sums(parts, ["of", "size"], F.xxhash64("component"), F.lit(1), "rank").select("component", F.struct("of", "size").alias("key"), "rank"))
    placed = lookup_join(keyed, ends.select(F.struct("of", "size").alias("key"), "w", "ends"), "key", "w", keyed.count())
    nth = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    return placed.select("component", F.element_at(F.array(*[F.lit(s) for s in SPLITS]), nth + 1).alias("split"))


def assign(final: DataFrame, seeds: DataFrame, sources: DataFrame, shares: tuple[float, ...] = SHARES, id_col: str = "id") -> DataFrame:
    """(id, domain, seed_id, component, split) of every record of ``final``."""
    tied = tied_seeds(final, seeds, sources)
    records = final.select(F.col(id_col).alias("id"), "seed_id", fold(F.col("domain")).alias("domain"))
    cells = records.groupBy("seed_id", F.when(F.col("seed_id").isNull(), F.col("id")).alias("lone"), "domain").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(cells.join(tied, "seed_id", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("r:"), F.coalesce("lone", F.lit(""))))))
    per = cut(cells.groupBy("component", "domain").agg(F.sum("n").alias("n")))
    named = F.when(F.col("domain").isNotNull(), F.col("n"))
    home = F.max_by("domain", F.when(F.col("domain").isNotNull(), F.struct("n", "domain")))
    shape = per.groupBy("component").agg(F.count("domain").alias("domains"), home.alias("of"), F.coalesce(F.sum(named), F.sum("n")).alias("size"))
    shape = cut(shape)
    several, single = (shape.filter(c).select("component", "of", "size") for c in ("domains > 1", "domains <= 1"))
    by = lambda total: F.array(*[F.col(total) * s for s in shares])
    first = cut(_deal(several, several.groupBy("of").agg(F.sum("size").alias("n")).select("of", by("n").alias("want"))))
    counted = per.join(shape.filter("domains > 0").select("component"), "component", "left_semi").filter("domain IS NOT NULL").unionByName(per.join(shape.filter("domains = 0").select("component"), "component", "left_semi"))
    whole = counted.groupBy("domain").agg(F.sum("n").alias("n"))
    gone = counted.join(first, "component").groupBy("domain").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in SPLITS])
    rest = whole.join(gone.withColumnRenamed("domain", "__d"), F.col("domain").eqNullSafe(F.col("__d")), "left")
    want = rest.select(F.col("domain").alias("of"), F.array(*[F.col("n") * x - F.coalesce(s, F.lit(0)) for s, x in zip(SPLITS, shares, strict=True)]).alias("want"))
    chosen = first.unionByName(_deal(single, want))
    parts = cut(cells.groupBy("seed_id", "lone", "component").agg(F.sum("n").alias("n")))
    weighed = chosen.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("w")), "component")
    of = cut(lookup_join(parts, cut(weighed), "component", "w", parts.count()).select(F.struct("seed_id", "lone").alias("key"), "component", "split", F.col("n").alias("w")))
    rows = records.withColumn("key", F.struct(F.col("seed_id"), F.when(F.col("seed_id").isNull(), F.col("id")).alias("lone")))
    return lookup_join(rows, of, "key", "w", of.agg(F.sum("w")).first()[0] or 0).select("id", "domain", "seed_id", "component", "split")
