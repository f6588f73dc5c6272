"""A ledger of batches: (stage, stage_pos, batch_id, status, n, ts, note), newest entry of a batch counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bandwright.operators.windows import last_wins
from bandwright.session import locked, newest, publish

#: What a batch may become: it is run, ends well or badly, is run again after a failure, and waits again if its run was cut off.
MOVES = {"pending": ("running",), "running": ("done", "failed", "pending"), "failed": ("running",), "done": ()}


def state(entries: DataFrame) -> DataFrame:
    """The last entry of each batch."""
    return last_wins(entries, ["stage", "batch_id"], "ts")


def roll_up(batches: DataFrame) -> DataFrame:
    """(stage, batches, rows, status): done if every batch is, done_with_failures if each is done or failed, else running if any is not pending."""
    is_ = lambda *s: F.col("status").isin(*s)
    status = (
        F.when(F.bool_and(is_("done")), "done").when(F.bool_and(is_("done", "failed")), "done_with_failures").when(F.bool_or(~is_("pending")), "running").otherwise("pending")
    )
    return batches.groupBy("stage").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("rows"), status.alias("status"))


def next_pending(batches: DataFrame) -> DataFrame:
    """The first pending batch by stage position and id: one row or none."""
    return batches.filter("status = 'pending'").orderBy("stage_pos", "batch_id").limit(1)


def last_notes(entries: DataFrame, n: int = 5) -> DataFrame:
    return entries.filter("note IS NOT NULL").orderBy(F.desc("ts"), F.desc("batch_id")).limit(n).select("ts", "batch_id", "note")


def advance(batches: DataFrame, events: DataFrame) -> DataFrame:
    """(stage, batch_id, status, moves, refused) of ``batches`` after ``events`` (stage, batch_id, at, status) in order of time; a move that isn't allowed is refused and changes nothing."""
    key = ["stage", "batch_id"]
    taken = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("__events"))
    allowed = lambda was, to: F.coalesce(F.array_contains(F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])[was], to), F.lit(False))
    start = F.struct(F.col("status").alias("status"), F.lit(0).alias("moves"), F.lit(0).alias("refused"))
    step = lambda s, e: F.when(allowed(s["status"], e["status"]), F.struct(e["status"].alias("status"), (s["moves"] + 1).alias("moves"), s["refused"].alias("refused"))).otherwise(F.struct(s["status"].alias("status"), s["moves"].alias("moves"), (s["refused"] + 1).alias("refused")))
    none = F.array().cast("array<struct<at:timestamp,status:string>>")
    joined = batches.select(*key, "status").join(taken, key, "left").withColumn("__events", F.coalesce(F.col("__events").cast("array<struct<at:timestamp,status:string>>"), none))
    return joined.select(*key, F.aggregate("__events", start, step).alias("s")).select(*key, "s.*")


def save(entries: DataFrame, path: str) -> None:
    """Replaces the ledger at ``path`` as a whole: written beside the last version and renamed into place, one writer at a time."""
    spark = entries.sparkSession
    with locked(spark, path):
        publish(spark, path, lambda to: entries.write.parquet(to))


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The last whole version; empty if there is none."""
    at = newest(spark, path)
    return spark.read.schema(schema).parquet(at) if at else spark.createDataFrame([], schema)
