"""Samples whose cells match target proportions.

Rows are counted by cross cell (domain, axis, label), in which every value that no target names is one value, so there are no
more than the named values' products. Cross cells that the same targets can draw from are one class. In each plan a min-cost flow
carries rows from the target cells to the classes: an arc per cell for its floor, one for the rest of its quota, an arc per
class with the rows there are, and a slack arc per cell that takes what can't be met and so exposes the shortfall. Arcs to
classes are cheaper up to an amount drawn at random in proportion to the rows, so every row of a cell is as likely as any other
where the flow is free, and targets that share nothing are solved apart. A cell falls short if the slack arc of
its own demand takes anything when the cell stands alone. The amounts of a class are dealt to its cross cells at random, whoever
draws from it: whole numbers that are in proportion but for a random rounding, so every row is equally likely.
Rows are drawn by their rank in a hash order, by sums on two levels, so a cell of any size is spread over tasks.

Cases: cells compare without regard to letter case and surrounding blanks; a null (or blank) attribute of a row fits only
cells that leave the attribute open; floors go before shares when a sample can't hold both; a target whose size is 0 or
null draws nothing; a null plan_id is a plan of its own; empty tables give empty results; the columns of the rows other than the attributes don't matter.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.functions.text import fold
from bandwright.operators.skew import prefix_sums

ATTRIBUTES = ("domain", "axis", "expected_label")
#: Target rows the driver takes: they are a specification written by hand or by a planner, not data.
MAX_TARGETS = 100_000


class Flow:
    """Min-cost flow by successive shortest paths; integral, deterministic."""

    def __init__(self) -> None:
        self.arcs: list[list] = []
        self.out: dict = defaultdict(list)

    def arc(self, u, v, cap: int, cost: int = 0) -> int:
        self.out[u].append(len(self.arcs))
        self.arcs.append([v, cap, cost])
        self.out[v].append(len(self.arcs))
        self.arcs.append([u, 0, -cost])
        return len(self.arcs) - 2

    def run(self, s, t) -> None:
        while True:
            dist, via, queue, waiting = {s: 0}, {}, deque([s]), {s}
            while queue:
                u = queue.popleft()
                waiting.discard(u)
                for a in self.out[u]:
                    v, cap, cost = self.arcs[a]
                    if cap > 0 and dist[u] + cost < dist.get(v, math.inf):
                        dist[v], via[v] = dist[u] + cost, a
                        if v not in waiting:
                            waiting.add(v)
                            queue.append(v)
            if t not in via:
                return
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.arcs[via[v] ^ 1][0]
            most = min(self.arcs[a][1] for a in path)
            for a in path:
                self.arcs[a][1] -= most
                self.arcs[a ^ 1][1] += most

    def flow(self, a: int) -> int:
        return self.arcs[a ^ 1][1]


def quotas(shares: list[float], floors: list[int], size: int) -> list[int]:
    """Whole numbers that add up to ``size`` (or to the floors, if these need more), none below its floor.

    Cells whose share is less than their floor get the floor; the others share the rest by largest remainder.
    """
    fixed: set[int] = set()
    while True:
        free = [i for i in range(len(shares)) if i not in fixed]
        rest, weight = max(0, size - sum(floors[i] for i in fixed)), sum(shares[i] for i in free)
        ideal = {i: rest * shares[i] / weight if weight > 0 else 0.0 for i in free}
        below = {i for i in free if ideal[i] < floors[i]}
        if not below:
            break
        fixed |= below
    got = [floors[i] if i in fixed else math.floor(ideal[i]) for i in range(len(shares))]
    for i in sorted((i for i in free if shares[i] > 0), key=lambda i: (got[i] - ideal[i], i))[: max(0, rest - sum(got[i] for i in free))]:
        got[i] += 1
    return got


def dealt(n: int, counts: list[int], rng: np.random.Generator) -> list[int]:
    """``n`` of the counted rows in whole numbers: each count's proportion, rounded up or down at random so that every row is equally likely."""
    whole, got = sum(counts), [0] * len(counts)
    if not n:
        return got
    shift, run, before = int(rng.integers(0, 1 << 62)) * whole >> 62, 0, 0
    for j in rng.permutation(len(counts)).tolist():
        run += counts[j]
        upto = (n * run + shift) // whole
        got[j], before = upto - before, upto
    return got


def _fitting(cells: list[tuple], counts: dict[tuple, int]) -> list[list[tuple]]:
    """Of each target cell the cross cells that fit it, by a lookup of the attributes that it names."""
    found: dict = {}
    for named in {tuple(v is not None for v in c) for c in cells}:
        by = found.setdefault(named, defaultdict(list))
        for x in counts:
            by[tuple(v for v, n in zip(x, named, strict=True) if n)].append(x)
    return [found[tuple(v is not None for v in c)][tuple(v for v in c if v is not None)] for c in cells]


def _connected(holders: list[tuple[int, ...]], n: int) -> list[list[int]]:
    """Targets 0..n-1 in groups that share no class."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for h in holders:
        for i in h[1:]:
            up[root(i)] = root(h[0])
    groups = defaultdict(list)
    for i in range(n):
        groups[root(i)].append(i)
    return list(groups.values())


def _lacking(need: int, rows: dict) -> int:
    """What the slack arc takes of a demand that has ``rows`` for itself."""
    net = Flow()
    net.arc("s", "cell", need)
    slack = net.arc("cell", "t", need, 100)
    for c, n in rows.items():
        net.arc("cell", ("class", c), n, 1)
        net.arc(("class", c), "t", n)
    net.run("s", "t")
    return net.flow(slack)


def solve(targets: list[dict], counts: dict[tuple, int], seed: int) -> tuple[list[dict], list[dict]]:
    """Of one plan: a report per cell, and quotas (cell_id, attributes of the cross cell, first rank, last rank)."""
    size = targets[0]["sample_size"] or 0
    shares, floors = [t["target_share"] or 0.0 for t in targets], [t["min_rows"] or 0 for t in targets]
    want = quotas(shares, floors, size) if size else [0] * len(targets)
    fits = _fitting([t["cell"] for t in targets], counts)
    holders: dict = defaultdict(list)
    for i, own in enumerate(fits):
        for x in own:
            holders[x].append(i)
    classes: dict = defaultdict(list)
    for x in sorted(holders, key=str):
        classes[tuple(holders[x])].append(x)
    rows = {c: sum(counts[x] for x in xs) for c, xs in classes.items()}
    of: dict = defaultdict(list)
    for c in classes:
        for i in c:
            of[i].append(c)
    rng, take, slack = np.random.default_rng(seed), {}, {}
    for group in _connected(list(classes), len(targets)):
        net, arcs, spare = Flow(), defaultdict(list), {}
        for i in group:
            low = min(floors[i], want[i])
            net.arc("s", ("floor", i), low, 0)
            net.arc("s", ("rest", i), want[i] - low, 0)
            net.arc(("floor", i), ("cell", i), low, 0)
            net.arc(("rest", i), ("cell", i), want[i] - low, 0)
            spare[i] = (net.arc(("floor", i), "t", low, 1000), net.arc(("rest", i), "t", want[i] - low, 100))
            there = [rows[c] for c in of[i]]
            for c, n in zip(of[i], dealt(min(want[i], sum(there)), there, rng), strict=True):
                arcs[i, c] += [net.arc(("cell", i), ("class", c), n, 1), net.arc(("cell", i), ("class", c), want[i] - n, 2)]
        for c in {c for i in group for c in of[i]}:
            net.arc(("class", c), "t", rows[c], 0)
        net.run("s", "t")
        take |= {k: sum(map(net.flow, a)) for k, a in arcs.items()}
        slack |= {i: sum(map(net.flow, a)) for i, a in spare.items()}
    draws, used = [], defaultdict(int)
    for c, xs in classes.items():
        left = [counts[x] for x in xs]
        for i in rng.permutation(len(c)).tolist():
            got = dealt(take[c[i], c], left, rng)
            left = [n - g for n, g in zip(left, got, strict=True)]
            for x, g in zip(xs, got, strict=True):
                if g:
                    draws.append({"cell_id": targets[c[i]]["cell_id"], "cross": x, "first": used[x], "last": used[x] + g - 1})
                    used[x] += g
    report = []
    for i, t in enumerate(targets):
        need = max(math.ceil(shares[i] * size), floors[i])
        report.append({"cell_id": t["cell_id"], "available": sum(rows[c] for c in of[i]), "quota": want[i], "drawn": sum(take[i, c] for c in of[i]), "shortfall": slack[i], "short": _lacking(need, {c: rows[c] for c in of[i]}) > 0})
    return report, draws


def plan(rows: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame, dict]:
    """The report per cell, the quotas per cross cell, and the attribute values that targets name."""
    spark = rows.sparkSession
    spec = targets.select("plan_id", "cell_id", *[fold(F.col(a)).alias(a) for a in ATTRIBUTES], "target_share", "min_rows", "sample_size").limit(MAX_TARGETS + 1).collect()
    if len(spec) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target cells")
    named = {a: sorted({t[a] for t in spec} - {None}) for a in ATTRIBUTES}
    counts = {tuple(r[a] for a in ATTRIBUTES): r["n"] for r in crossed(rows, named).groupBy(*ATTRIBUTES).agg(F.count(F.lit(1)).alias("n")).collect()}
    plans: dict = defaultdict(list)
    for t in sorted(spec, key=lambda t: (t["plan_id"] is not None, t["plan_id"] or 0, t["cell_id"] is not None, t["cell_id"] or 0)):
        plans[t["plan_id"]].append(t.asDict() | {"cell": tuple(t[a] for a in ATTRIBUTES)})
    reports, draws = [], []
    for p, cells in plans.items():
        report, quota = solve(cells, counts, (seed << 33) + (1 << 32) + (p or 0) if p is not None else seed)
        reports += [(p, x["cell_id"], x["available"], x["quota"], x["drawn"], x["shortfall"], bool(x["short"])) for x in report]
        draws += [(p, x["cell_id"], *x["cross"], x["first"], x["last"]) for x in quota]
    ints, strings = T.IntegerType(), T.StringType()
    at = [T.StructField("plan_id", ints), T.StructField("cell_id", ints)]
    longs = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    return (
        spark.createDataFrame(reports, T.StructType([*at, *longs("available", "quota", "drawn", "shortfall"), T.StructField("short", T.BooleanType())])),
        spark.createDataFrame(draws, T.StructType([*at, *[T.StructField(a, strings) for a in ATTRIBUTES], *longs("first", "last")])),
        named,
    )


def crossed(rows: DataFrame, named: dict, *keep: str) -> DataFrame:
    """``keep`` and the folded attributes; a value that no target names is null."""
    values = [F.when(fold(F.col(a)).isin(named[a]), fold(F.col(a))).alias(a) if named[a] else F.lit(None).cast("string").alias(a) for a in ATTRIBUTES]
    return rows.select(*keep, *values)


def draw(rows: DataFrame, targets: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """(plan_id, cell_id, id) of the rows drawn; a row is in a plan's sample once at most.

    Rows with equal ids are drawn apart only if their position in the table is the same on every read; ids are unique here.
    The quotas are bounded by the targets, so they are broadcast.
    """
    _, quota, named = plan(rows, targets, seed)
    keyed = crossed(rows, named, F.col(id_col).alias("id"))
    ranked = prefix_sums(keyed, list(ATTRIBUTES), F.xxhash64(F.lit(seed), "id"), F.lit(1), "rank")
    same = [ranked[a].eqNullSafe(quota[a]) for a in ATTRIBUTES]
    return ranked.join(F.broadcast(quota), (same[0] & same[1] & same[2]) & F.col("rank").between(F.col("first"), F.col("last"))).select("plan_id", "cell_id", "id")
