"""Reprocessing the gap: of an append-only stage, what a later stage hasn't answered yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.functions.text import strip


def answer_gap(answered, out: str, key: str = "id"):
    """A function for ``foreachBatch``: rows whose key ``answered()`` (a table read anew each time) lacks go to ``out``/batch=n."""

    def run(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn(key, strip(F.col(key))).filter(F.col(key).isNotNull())
        rows.dropDuplicates([key]).join(answered().select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return run
