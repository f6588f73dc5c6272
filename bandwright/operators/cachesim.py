"""Arrival-order simulations of a similarity cache.

A simulation is sequential by nature, so one (setting, order) is one task's work and settings and orders are what is spread. What
can be served to an item is the same in all orders, so each task makes these lists once and a step looks up which of them are stored.
The workload is a sample of whole families of at most MAX_ITEMS items (checked), so it is broadcast once and
not repeated per setting; each task walks its orders and gives one row per arrival. What is served is then classified and counted by joins.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 20_000
SERVED = "tau double, rule string, policy string, capacity int, alpha double, order_id int, pos int, item int, stored int, sim double"


def permutation(order_id: int, n: int) -> list[int]:
    """Items by the md5 of "order:item"."""
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{order_id}:{i}".encode()).hexdigest()[:15], i))


def zipf(order_id: int, n: int, alpha: float, length: int) -> list[int]:
    """``length`` draws with repeats: rank by inverse CDF of weights 1 / rank**alpha, u from the md5 of "zipf:order:draw"; ranks are items in the order's permutation."""
    cdf = np.cumsum(1 / np.arange(1, n + 1) ** alpha)
    u = np.array([int(hashlib.md5(f"zipf:{order_id}:{k}".encode()).hexdigest()[:8], 16) for k in range(length)]) / 2.0**32
    items = permutation(order_id, n)
    return [items[r] for r in np.minimum(np.searchsorted(cdf / cdf[-1], u, side="right"), n - 1)]


class Near:
    """Of each unit vector those more similar than ``floor``, itself among them, the most similar first; made block by block when asked for."""

    HELD = 20_000_000

    def __init__(self, x: np.ndarray, floor: float, block: int = 256) -> None:
        self.x, self.floor, self.block, self.lists, self.size = x, floor, block, {}, 0

    def of(self, i: int) -> tuple[list[int], list[float]]:
        if i not in self.lists:
            if self.size > self.HELD:  # made anew when asked for again
                self.lists, self.size = {}, 0
            lo = i - i % self.block
            s = self.x[lo : lo + self.block] @ self.x.T
            rows, cols = np.nonzero(s > self.floor)
            sims = s[rows, cols]
            order = np.lexsort((-sims, rows))
            cols, sims, ends = cols[order], sims[order], np.cumsum(np.bincount(rows, minlength=len(s)))
            for r, e in enumerate(ends):
                b = ends[r - 1] if r else 0
                self.lists[lo + r] = (cols[b:e].tolist(), sims[b:e].tolist())
            self.size += len(cols)
        return self.lists[i]


def walk(x: np.ndarray, arrivals: list[int], tau: float, accept=None, policy: str = "none", capacity: int = 0, near: Near | None = None) -> Iterator[tuple[int, int, int, float | None]]:
    """(pos, item, stored or -1, sim): the most similar stored entry (ties to the earliest stored) is served if it is more similar
    than ``tau``, or if ``accept(item, stored, sim)`` says so where that is given; a miss is stored unless it is; beyond ``capacity`` the
    entry stored first (fifo) or used longest ago (lru; storing and serving are uses) goes. Entries below the floor of ``near`` are
    taken not to be accepted; sim is None where there is none above it."""
    near = near or Near(x, tau if accept is None else -2.0)
    stored: dict[int, int] = {}
    used: OrderedDict[int, None] = OrderedDict()
    for t, i in enumerate(arrivals):
        served, best = -1, None
        others, sims = near.of(i)
        for k, j in enumerate(others):
            if j in stored:
                best = sims[k]
                for m in range(k + 1, len(others)):
                    if sims[m] < best:
                        break
                    if others[m] in stored and stored[others[m]] < stored[j]:
                        j = others[m]
                if best > tau if accept is None else accept(i, j, best):
                    served = j
                    used.move_to_end(j)
                break
        if served < 0 and i not in stored:
            stored[i] = t
            used[i] = None
            if capacity and len(stored) > capacity:
                out = next(iter(used if policy == "lru" else stored))
                del stored[out], used[out]
        yield t, i, served, best


#: A verifier's fixture: the keys are equal, but for a sixteenth of the pairs in which it errs.
def verified(i: int, j: int, keys: list) -> bool:
    return (keys[i] == keys[j]) != (hashlib.md5(f"verify:{i}:{j}".encode()).hexdigest()[0] == "0")


def simulate(items: DataFrame, grid: DataFrame, half_band: float = 0.06, cross: float = 0.5) -> DataFrame:
    """Rows of SERVED for every setting of ``grid`` (tau, rule, policy, capacity, alpha, length, order_id) over ``items`` (item 0..n-1, vec, and for
    rules B and D: words, slots; for rule V: key); ``stored`` is null on a miss, ``sim`` too where no entry could be served.

    Rule A: similarity above tau; B: within the band the cross score (word Jaccard) above ``cross``, outside above the band; D: above tau with equal
    slots; V: above tau, and the verifier says so, which is asked there only. alpha null: every item once, in the order's permutation; else ``length`` Zipf draws.
    """
    spark = items.sparkSession
    rows = items.orderBy("item").limit(MAX_ITEMS + 1).toPandas()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"a workload has at most {MAX_ITEMS} items; sample whole families first")
    x = np.array(rows["vec"].tolist(), dtype=np.float64).reshape(len(rows), -1)
    norms = np.sqrt((x * x).sum(axis=1))
    x /= np.where(norms == 0, 1, norms)[:, None]
    words = [frozenset(w) for w in rows["words"]] if "words" in rows else None
    slots, keys = (rows[c].tolist() if c in rows else None for c in ("slots", "key"))
    data = spark.sparkContext.broadcast((x, words, slots, keys))
    width = half_band

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, words, slots, keys = data.value
        n, near = len(x), Near(x, 2.0)
        for batch in batches:
            for g in batch.itertuples(index=False):
                alpha = None if pd.isna(g.alpha) else g.alpha
                arrivals = permutation(g.order_id, n) if alpha is None else zipf(g.order_id, n, alpha, g.length)

                def crossed(i, j, s, tau=g.tau):
                    if tau - width <= s <= tau + width:
                        return len(words[i] & words[j]) / max(1, len(words[i] | words[j])) > cross
                    return s > tau + width

                accept = {"A": None, "B": crossed, "D": lambda i, j, s, tau=g.tau: s > tau and slots[i] == slots[j], "V": lambda i, j, s, tau=g.tau: s > tau and verified(i, j, keys)}[g.rule]
                floor = g.tau - width - 1e-9 if g.rule == "B" else g.tau
                if near.floor != floor:
                    near = Near(x, floor)
                out = pd.DataFrame(list(walk(x, arrivals, g.tau, accept, g.policy, g.capacity, near)), columns=["pos", "item", "stored", "sim"])
                out["sim"] = out["sim"].astype(float)
                for c in ("tau", "rule", "policy", "capacity", "alpha", "order_id"):
                    out[c] = getattr(g, c)
                out["alpha"] = out["alpha"].astype(float)
                out["stored"] = out["stored"].where(out["stored"] >= 0).astype("Int32")
                yield out[["tau", "rule", "policy", "capacity", "alpha", "order_id", "pos", "item", "stored", "sim"]]

    n = grid.count()
    tasks = max(1, min(n, 2 * spark.sparkContext.defaultParallelism))
    return grid.repartition(tasks).sortWithinPartitions("tau", "rule").mapInPandas(run, SERVED)


def settings(spark, taus: list[float], orders: int, rules=("A",), policies=(("none", 0),), alphas=(None,), length: int = 0) -> DataFrame:
    rows = [(float(t), r, p, c, a, length, o) for t in taus for r in rules for p, c in policies for a in alphas for o in range(orders)]
    return spark.createDataFrame(rows, "tau double, rule string, policy string, capacity int, alpha double, length int, order_id int")


SETTING = ["tau", "rule", "policy", "capacity", "alpha"]


def outcome(served: DataFrame, items: DataFrame, key: str = "key") -> DataFrame:
    """``served`` with the arriving item's key and the key it got: the stored entry's on a hit, its own on a miss."""
    own, other = items.select("item", F.col(key).alias("own")), items.select(F.col("item").alias("stored"), F.col(key).alias("other"))
    rows = served.join(F.broadcast(own), "item").join(F.broadcast(other), "stored", "left")  # at most MAX_ITEMS rows
    return rows.withColumn("got", F.coalesce("other", "own")).withColumn("hit", F.col("stored").isNotNull().cast("int")).withColumn("wrong", (F.col("got") != F.col("own")).cast("int"))


def rates(out: DataFrame) -> DataFrame:
    """(setting, arrivals, hit, hit_std, wrong, sensitivity): mean and population deviation over orders, and the share of items that got more than one key."""
    per = out.groupBy(*SETTING, "order_id").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("h"), F.avg("wrong").alias("w"))
    means = per.groupBy(*SETTING).agg(F.sum("n").alias("arrivals"), F.avg("h").alias("hit"), F.stddev_pop("h").alias("hit_std"), F.avg("w").alias("wrong"))
    keys = out.groupBy(*SETTING, "item").agg(F.countDistinct("got").alias("k")).groupBy(*SETTING).agg(F.avg((F.col("k") > 1).cast("int")).alias("sensitivity"))
    same = [means[c].eqNullSafe(keys[c]) for c in SETTING]
    on = same[0] & same[1] & same[2] & same[3] & same[4]
    return means.join(keys, on).select(*[means[c] for c in SETTING], "arrivals", "hit", "hit_std", "wrong", "sensitivity")


def classify(served: DataFrame, items: DataFrame) -> DataFrame:
    """Hits of ``served`` with their class; items need key, family, kind (seed, HIT, MISS), axis, doc, ans (null: not verifiable)."""
    a = items.select("item", *[F.col(c).alias(f"{c}_i") for c in ("key", "family", "kind", "axis", "doc", "ans")])
    b = items.select(F.col("item").alias("stored"), *[F.col(c).alias(f"{c}_j") for c in ("key", "family", "kind", "axis", "doc", "ans")])
    rows = served.filter("stored IS NOT NULL").join(F.broadcast(a), "item").join(F.broadcast(b), "stored")  # at most MAX_ITEMS rows
    miss = (F.col("kind_i") == "MISS") & (F.col("kind_j") == "MISS")
    within = F.when(miss & (F.col("axis_i") == F.col("axis_j")), "miss_miss_same_axis").when(miss, "miss_miss_other_axis").otherwise("within_label")
    known = F.col("ans_i").isNotNull() & F.col("ans_j").isNotNull()
    cross = F.when(~known, "cross_unverified").when(F.col("ans_i") == F.col("ans_j"), "cross_verified_same").otherwise("cross_verified_other")
    cls = F.when(F.col("key_i") == F.col("key_j"), "right").when(F.col("family_i") == F.col("family_j"), within).otherwise(cross)
    return rows.withColumn("class", cls).withColumn("same_doc", (F.col("family_i") != F.col("family_j")) & F.col("doc_i").eqNullSafe(F.col("doc_j"))).withColumn(
        "stored_slope", (F.col("kind_j") == "MISS") & F.col("axis_j").isin("N1", "N2")
    )


def serve_counts(classified: DataFrame) -> DataFrame:
    """(setting, class, serves, same_doc, stored_miss, stored_slope, seed_involved)."""
    seed = (F.col("kind_i") == "seed") | (F.col("kind_j") == "seed")
    return classified.groupBy(*SETTING, "class").agg(
        F.count(F.lit(1)).alias("serves"), F.count_if("same_doc").alias("same_doc"), F.count_if(F.col("kind_j") == "MISS").alias("stored_miss"), F.count_if("stored_slope").alias("stored_slope"), F.count_if(seed).alias("seed_involved")
    )


def confusion(classified: DataFrame) -> DataFrame:
    """(seed_a, seed_b, n): serves across families with other answers, by unordered pair of families."""
    rows = classified.filter("class = 'cross_verified_other'")
    return rows.groupBy(F.least("family_i", "family_j").alias("seed_a"), F.greatest("family_i", "family_j").alias("seed_b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "seed_a", "seed_b")
