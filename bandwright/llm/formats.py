"""Records equal but for format, collapsed into one each with the number of copies.

A record's canonical form is the sorted list of its pieces: fields cut at semicolons, lower case, runs of characters that
are neither letters nor digits as one blank. Canonical records are range-partitioned and sorted (Spark's sort spills to
disk) by form and id, so equal forms stand in adjacent rows; the scan compares each full form with the one before. The id
is part of the range, so copies of one form may fill many partitions: a run at a partition's start gets its representative
in a second step from at most two rows per partition (which are broadcast).

Cases: null fields have no pieces; records without any piece are equal to each other; rows with a null id are not
records and are left out; a repeated row is one more copy; texts of any length are compared whole; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.session import cut

NAMES = ["id", "first", "head", "top_form", "top_first", "last_form"]


def canonical(fields: list[str]) -> Column:
    """The sorted pieces, a semicolon behind each: no piece holds one, so forms are equal only if pieces are."""
    cuts = F.flatten(F.array(*[F.split(F.coalesce(F.col(f), F.lit("")), ";") for f in fields]))
    pieces = F.transform(cuts, lambda p: F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{Nd}]+", " ")))
    return F.concat_ws(";", F.sort_array(F.filter(pieces, lambda p: p != "")))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (form, id) -> id and the first id of its run here; head: the run began at the partition's start.

    A last row without id has the forms and first ids of the partition's first and last run.
    """
    last = first = top = None
    head = True
    for batch in batches:
        ids, forms = batch.column(0), batch.column(1)
        n = len(ids)
        if not n:
            continue
        turn = np.empty(n, dtype=bool)
        turn[0] = last is None or forms[0].as_py() != last
        turn[1:] = pc.not_equal(forms.slice(1), forms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if last is None:
            top, first = (forms[0].as_py(), ids[0].as_py()), ids[0].as_py()
            turn[0] = False
        run = np.cumsum(turn)
        firsts = pa.concat_arrays([pa.array([first], pa.string()), ids.take(pa.array(np.flatnonzero(turn)))])
        heads = pa.array((run == 0) & head)
        yield pa.RecordBatch.from_arrays([ids, firsts.take(pa.array(run)), heads, *[pa.nulls(n, pa.string())] * 3], names=NAMES)
        first, last, head = firsts[-1].as_py(), forms[n - 1].as_py(), head and run[-1] == 0
    if top is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((None, pa.string()), (first, pa.string()), (head, pa.bool_()), (top[0], pa.string()), (top[1], pa.string()), (last, pa.string()))], names=NAMES)


def runs(records: DataFrame, id_col: str, fields: list[str], partitions: int | None = None) -> DataFrame:
    """(id, representative) of every record; the representative is the smallest id of the equal records."""
    spark = records.sparkSession
    forms = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), canonical(fields).alias("form"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = forms.repartitionByRange(n, "form", "id").sortWithinPartitions("form", "id")
    seen = cut(ordered.mapInArrow(_scan, "id string, first string, head boolean, top_form string, top_first string, last_form string").withColumn("part", F.spark_partition_id()))
    ends = seen.filter("id IS NULL")
    tops = ends.select("part", F.col("top_form").alias("form"), F.col("top_first").alias("first"), F.lit(True).alias("head"))
    ends = tops.unionByName(ends.select("part", F.col("last_form").alias("form"), "first", F.lit(False).alias("head")))
    began = ends.groupBy("form").agg(F.min("first").alias("representative"))
    began = ends.filter("head").join(began, "form").select("part", "representative")
    rows = seen.filter("id IS NOT NULL")
    inner = rows.filter("NOT head").select("id", F.col("first").alias("representative"))
    return inner.unionByName(rows.filter("head").join(F.broadcast(began), "part").select("id", "representative"))


def collapsed(records: DataFrame, id_col: str, fields: list[str], partitions: int | None = None) -> DataFrame:
    """(representative, copies): one row per set of equal records."""
    return runs(records, id_col, fields, partitions).groupBy("representative").agg(F.count(F.lit(1)).alias("copies"))
