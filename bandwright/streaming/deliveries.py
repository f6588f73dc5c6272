"""Exactly-once delivery of a stream: each micro-batch meets the ranges seen before.

The state is a table of seen ranges and malformed identifiers in the shared folder, one version per batch, and a batch is
written under its number; a batch that is run again after a failure reads the version before it and overwrites its own
output, so the result is the same. Batch 0 begins without a state; a later batch whose state is missing is an error, as it would
accept everything again. The version before the last is removed when a batch is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from bandwright.operators.messages import accept
from bandwright.session import exists, remove

RANGES = StructType([StructField("producer", StringType()), StructField("block", LongType()), StructField("lo", LongType()), StructField("hi", LongType())])
IDS = StructType([StructField("id", StringType())])


class MissingState(RuntimeError):
    """What was seen before a batch isn't known."""


def keep_once(state: str, out: str, id_col: str = "id", order: tuple[str, ...] = ("ts", "batch_id")):
    """A function for ``foreachBatch``: writes what is accepted of batch n to ``out``/batch=n and the state after it to ``state``/n."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        seen = ids = None
        if n:
            if not all(exists(spark, f"{state}/{n - 1}/{part}/_SUCCESS") for part in ("ranges", "ids")):
                raise MissingState(f"no state of batch {n - 1} in {state}")
            seen = spark.read.schema(RANGES).parquet(f"{state}/{n - 1}/ranges")
            ids = spark.read.schema(IDS).parquet(f"{state}/{n - 1}/ids")
        kept, ranges, names = accept(batch, seen, ids, id_col, order)
        kept.write.mode("overwrite").parquet(f"{out}/batch={n}")
        names.write.mode("overwrite").parquet(f"{state}/{n}/ids")
        ranges.select(*[f.name for f in RANGES.fields]).write.mode("overwrite").parquet(f"{state}/{n}/ranges")
        if n > 1:
            remove(spark, f"{state}/{n - 2}")

    return run
