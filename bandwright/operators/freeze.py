"""Assembling variations and freezing the judged, deduplicated pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.functions.taxonomy import NAMES, derived
from bandwright.functions.text import strip
from bandwright.operators.windows import first_wins, last_wins, running_index, top_of_axes


def judge_struct(judgments: DataFrame, name: str, key: str = "id") -> DataFrame:
    """(id, name struct<model, axis_ok, conf, issue>): the last judgment of each id."""
    rows = last_wins(judgments.filter(F.col(key).isNotNull()), [key], "ts", [F.col("judge_model"), F.col("batch_id")])
    return rows.select(F.col(key).alias("id"), F.struct(F.col("judge_model").alias("model"), "axis_ok", "conf", "issue").alias(name))


def judged(variations: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Variations with judge1 and judge2, null where there is no judgment; ids compare without surrounding blanks."""
    rows = variations.drop("judge1", "judge2").withColumn("id", strip(F.col("id")))
    return rows.join(judge_struct(first, "judge1"), "id", "left").join(judge_struct(second, "judge2"), "id", "left")


def passed(rows: DataFrame) -> DataFrame:
    return rows.filter("judge1.axis_ok")


def frozen(variations: DataFrame, first: DataFrame, second: DataFrame, top: int = 2) -> DataFrame:
    """Judged, passed, known axes, one row per id (the first delivered), the ``top`` best per seed on N4 and N5, before near-duplicates."""
    once = first_wins(variations.filter("id IS NOT NULL").withColumn("id", strip(F.col("id"))), ["id"], [F.col("ts").asc_nulls_last(), F.col("batch_id").asc_nulls_last(), F.col("axis").asc_nulls_last()])
    rows = derived(passed(judged(once, first, second))).withColumn("conf", F.col("judge1.conf"))
    return top_of_axes(rows, ["N4", "N5"], top, ["seed_id", "axis"], "conf", "id").drop("conf")


def assembled(raw: DataFrame, seeds: DataFrame, order: list) -> DataFrame:
    """Raw (seed_id, axis, text) rows as variations: known axis and seed, text that isn't blank, isn't the seed's question and is
    new for the seed; ids numbered within seed and axis after that."""
    texts = raw.withColumn("text", strip(F.col("text"))).filter(F.col("axis").isin(NAMES) & (F.col("text") != ""))
    known = texts.join(seeds.select("seed_id", F.col("question").alias("__q")), "seed_id").filter(F.col("text") != F.coalesce(strip(F.col("__q")), F.lit("")))
    new = first_wins(known, ["seed_id", "text"], order).drop("__q")
    return running_index(new, ["seed_id", "axis"], order).withColumn("id", F.format_string("%s_%s_v%d", "seed_id", "axis", "k"))


def filled(original: DataFrame, rerun: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``original``, and those of ``rerun`` whose key it lacks."""
    return original.unionByName(rerun.join(original.select(key), key, "left_anti"))
