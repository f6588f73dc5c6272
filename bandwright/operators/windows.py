"""Numbering, picking and sampling by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.functions.draws import order_key, order_number
from bandwright.operators.skew import prefix_sums
from bandwright.session import cut


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; one row per key leaves each task, so a key of any size is no hot spot."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def last_wins(rows: DataFrame, keys: list[str], at: str, then: list | None = None) -> DataFrame:
    """The row of each key with the greatest ``at`` (nulls least): an upsert log's state."""
    return first_wins(rows, keys, [F.col(at).desc_nulls_last(), *(then or [])])


def running_index(rows: DataFrame, keys: list[str], order: list, name: str = "k") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def top_of_axes(rows: DataFrame, axes: list[str], n: int, keys: list[str], score: str, tie: str) -> DataFrame:
    """The ``n`` best rows per key on ``axes`` (a null score is 0, ties to the smaller id), every row on the others."""
    best = first_n(rows.filter(F.col("axis").isin(axes)), keys, [F.coalesce(score, F.lit(0.0)).desc(), F.col(tie)], n)
    return best.unionByName(rows.filter(~F.col("axis").isin(axes)))


def number_rows(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Row numbers from 0 in a total order, without a one-task window: sorted ranges are numbered and offset by the sizes of those before."""
    placed = cut(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__p", part).join(F.broadcast(before), "__p")  # one row per task of the sort
    return joined.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__before")


def continued(rows: DataFrame, existing: DataFrame, group: str, order: list, name: str = "k") -> DataFrame:
    """Numbers within the group that go on from as many as ``existing`` has of it."""
    there = existing.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    new = running_index(rows, [group], order, name).join(there, F.col(group).eqNullSafe(F.col("__g")), "left")
    return new.withColumn(name, (F.col(name) + F.coalesce("__n", F.lit(0))).cast("int")).drop("__g", "__n")


def capped_sample(rows: DataFrame, key: str, n: int, salt: str = "cap") -> DataFrame:
    """All rows if there are no more than ``n``, else the first ``n`` in a hash order."""
    return rows.orderBy(order_key(F.lit(salt), F.col(key)), key).limit(n)


def batches(rows: DataFrame, order: list, per: int) -> DataFrame:
    """Batch numbers from 0, ``per`` rows each."""
    return number_rows(rows, order, "__n").withColumn("batch", F.floor(F.col("__n") / per).cast("bigint")).drop("__n")


def slice_rows(rows: DataFrame, order: list, lo: int, hi: int) -> DataFrame:
    """Rows ``lo`` to ``hi``, from 1, both included."""
    return number_rows(rows, order, "__n").filter(F.col("__n").between(lo - 1, hi - 1)).drop("__n")


def folds(keys: DataFrame, stratum: str, key: str, k: int, salt: str = "fold") -> DataFrame:
    """Fold 0..k-1 of each distinct key: its rank in a hash order within the stratum, modulo k."""
    ranked = prefix_sums(keys, [stratum], order_number(F.lit(salt), F.col(key)), F.lit(1), "__r")
    return ranked.withColumn("fold", F.pmod("__r", F.lit(k)).cast("int")).drop("__r")


def family_sample(rows: DataFrame, family: str, n: int, salt: str = "family") -> DataFrame:
    """Whole families in a hash order until at least ``n`` rows are reached, the crossing family included."""
    sizes = rows.groupBy(family).agg(F.count(F.lit(1)).alias("__size"))
    before = prefix_sums(sizes, [], order_number(F.lit(salt), F.col(family)), F.col("__size"), "__before")
    return rows.join(before.filter(F.col("__before") < n).select(family), family, "left_semi")


def stratified_pick(rows: DataFrame, stratum: str, key: str, n: int, salt: str = "pick") -> DataFrame:
    return first_n(rows, [stratum], [order_key(F.lit(salt), F.col(key)), F.col(key)], n)


def round_robin(rows: DataFrame, group: str, source: str, position: str, limit: int) -> DataFrame:
    """Rows taken from the sources of a group in turn, sources by first appearance, until ``limit`` per group."""
    turn = running_index(rows, [group, source], [F.col(position)], "__turn")
    began = rows.groupBy(group, source).agg(F.min(position).alias("__began"))
    same = turn[group].eqNullSafe(began[group]) & turn[source].eqNullSafe(began[source])
    joined = turn.join(began, same).select(*[turn[c] for c in turn.columns], began["__began"])
    return first_n(joined, [group], [F.col("__turn"), F.col("__began"), F.col(position)], limit).drop("__turn", "__began")


def mid_ranks(rows: DataFrame, keys: list[str], value: str, name: str = "mid_rank") -> DataFrame:
    """Ranks from 1 by ascending value, ties at the mean of their ranks."""
    w = Window.partitionBy(*keys)
    tie = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (tie - 1) / 2)
