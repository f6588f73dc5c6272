"""Documents combined so that each source gives its target share of a token budget.

A source's documents stand in a hash order; its uses are that order repeated ``max_uses`` times at most, and a use belongs
to the mix if it begins before the source's target is reached. The uses are cut into blocks of a fixed number of tokens.
Block j of a source with weight w is released at slot floor(j / w) and due at slot ceil((j + 1) / w); each slot takes the
released block that is due first, so at any slot every source is less than one block from its share (Pfair scheduling).
A block is ``BLOCK`` tokens, whatever the budget, and the last one of a source what is left. Blocks that a source can't fill stay
(partly) empty in their slots, which is how a shortfall shows. A mix is scheduled by one task, which holds a block of each
source and gives on slots as it goes, about half a million a second; choose the block so that the budget has as many as that allows.

Cases: sources compare without regard to letter case and surrounding blanks; null and blank sources belong to no target; null and
empty texts have 0 tokens and are never used; a source that no document has can reach only a target of 0; a budget or
weight that is null counts as 0; repeated rows are separate documents; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.functions.text import fold
from bandwright.llm import bpe
from bandwright.operators.skew import prefix_sums
from bandwright.session import cut

#: Tokens of a block: the most by which a source is ahead of or behind its share at any point of a mix.
BLOCK = 4096
#: Rows of targets the driver takes: they are a specification, not data.
MAX_TARGETS = 100_000


def sizes(documents: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), the source folded."""
    return bpe.count(documents, "text", ("doc_id", "source"), path).withColumn("source", fold(F.col("source")))


def reach(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source can give: key (the folded source), target_tokens, source_tokens, available_tokens (all uses), short (less than the target)."""
    totals = counted.filter("source IS NOT NULL").groupBy(F.col("source").alias("__s")).agg(F.sum("tokens").alias("t"))
    spec = targets.withColumn("__s", fold(F.col("source")))
    joined = spec.join(totals, "__s", "left")
    given = F.coalesce("t", F.lit(0))
    return joined.select(
        "mix_id", "source", F.col("__s").alias("key"), F.coalesce("max_uses", F.lit(1)).alias("max_uses"),
        (F.coalesce("target_weight", F.lit(0.0)) * F.coalesce("budget_tokens", F.lit(0))).alias("target_tokens"),
        given.alias("source_tokens"), (given * F.coalesce("max_uses", F.lit(1))).alias("available_tokens"),
    ).withColumn("short", F.col("available_tokens") < F.col("target_tokens"))


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, slot): the released block that is due first takes the slot; sources without blocks or weight have none."""
    released: list = []
    waiting = [(0, math.ceil(1 / weights[s] - 1e-9), s, 0) for s in sorted(blocks) if blocks[s] and weights[s] > 0]
    heapq.heapify(waiting)
    slot = 0
    while waiting or released:
        if not released and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            r, due, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (due, s, j))
        _, s, j = heapq.heappop(released)
        yield s, j, slot
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (math.floor((j + 1) / weights[s] + 1e-9), math.ceil((j + 2) / weights[s] - 1e-9), s, j + 1))


def slots(reached: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mix_id, source, key, block, slot, wanted, filled) of the rows that ``reach`` gives: tokens wanted of the source in the block, and those it has."""

    def one(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        target, given = rows["target_tokens"].tolist(), rows["available_tokens"].tolist()
        whole = sum(target)
        if whole <= 0:
            return
        names = ["mix_id", "source", "key", "block", "slot", "wanted", "filled"]
        mix, source, key, held = rows["mix_id"].iloc[0], rows["source"].tolist(), rows["key"].tolist(), []
        for i, j, slot in schedule({i: math.ceil(t / block) for i, t in enumerate(target)}, {i: t / whole for i, t in enumerate(target)}):
            wanted = min(float(block), target[i] - j * block)
            held.append((mix, source[i], key[i], j, slot, wanted, min(wanted, max(0.0, float(given[i] - j * block)))))
            if len(held) == 50_000:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))  # specifications
        for _, mix in rows.groupby("mix_id", dropna=False):
            yield from one(mix.sort_values(["key", "source"], na_position="last"))

    spec = reached.select("mix_id", "source", "key", F.greatest("target_tokens", F.lit(0.0)).alias("target_tokens"), "available_tokens")
    return spec.repartition("mix_id").mapInPandas(each, "mix_id int, source string, key string, block bigint, slot bigint, wanted double, filled double")


def lacking(reached: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mix_id, source) of the targets that have a block in the schedule which the source can't fill."""
    return slots(reached, block).filter("filled < wanted").select("mix_id", "source").distinct()


def mix(counted: DataFrame, targets: DataFrame, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(mix_id, source, doc_id, use, start, tokens, block, slot): order by mix_id, slot, start to read a mix.

    ``counted`` is read twice; give a written table. The targets are broadcast, a specification of at most MAX_TARGETS rows; slots and
    uses meet by block.
    """
    reached = cut(reach(counted, targets))
    if reached.count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    give = F.least(F.col("available_tokens").cast("double"), "target_tokens")
    goal = reached.withColumn("goal", give).filter("key IS NOT NULL AND goal > 0")
    goal = F.broadcast(goal.select("mix_id", "source", "key", "goal", F.col("source_tokens").alias("pass"), F.least("max_uses", F.ceil(F.col("goal") / F.col("source_tokens"))).cast("int").alias("uses")))
    placed = prefix_sums(counted.filter("tokens > 0 AND source IS NOT NULL").withColumnRenamed("source", "key"), ["key"], F.xxhash64(F.lit(seed), "doc_id"), F.col("tokens"), "before")
    uses = placed.join(goal, "key").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    uses = uses.withColumn("start", F.col("before") + (F.col("use") - 1) * F.col("pass")).filter("start < goal")
    uses = uses.withColumn("block", F.floor(F.col("start") / block).cast("bigint"))
    at = slots(reached, block).select("mix_id", F.col("source").alias("__source"), "block", "slot")
    same = uses["mix_id"].eqNullSafe(at["mix_id"]) & (uses["source"] == at["__source"]) & (uses["block"] == at["block"])
    return uses.join(at, same).select(uses["mix_id"], "source", "doc_id", "use", "start", "tokens", uses["block"], "slot")


def shares(counted: DataFrame, targets: DataFrame, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Of every target: tokens wanted, available and used, documents' uses, the share reached, and whether it falls short."""
    used = mix(counted, targets, seed, block).groupBy("mix_id", "source").agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"))
    all_ = reach(counted, targets).join(used, ["mix_id", "source"], "left").na.fill(0, ["used_tokens", "uses"])
    whole = all_.groupBy("mix_id").agg(F.sum("used_tokens").alias("__whole"))
    return all_.join(whole, "mix_id").select("mix_id", "source", "target_tokens", "available_tokens", "used_tokens", "uses", F.try_divide("used_tokens", "__whole").alias("share"), "short")
