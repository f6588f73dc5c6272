"""Exactly one row of each message that was delivered at least once.

An identifier ``{producer}_v{number}`` is a number of a producer's sequence. What was seen of a producer is a set of
disjoint ranges of numbers, not a set of numbers: each delivery adds +1 at its number and -1 behind it, neighbours cancel,
and the running sum over the few positions that are left is the number of copies on each stretch. Stretches with a sum of
1 or more are the seen ranges, those with 2 or more hold the repeats. Ranges are cut at multiples of 2**BLOCK numbers, so
a producer with a third of all messages is spread over many tasks; the sums are combined before the shuffle, so a number
delivered a million times is one row. Identifiers of any other form are looked up by their exact text.

Cases: blanks around an identifier don't count; a null identifier is none, so such rows are never repeats and all stay; a
blank one is the identifier "" (malformed); numbers with leading zeros or more than 18 digits are malformed. An empty
table gives empty results. Extra columns of any name stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.functions.text import strip
from bandwright.session import fresh

BLOCK = 16
FORM = r"^((?s:.*))_v(0|[1-9][0-9]{0,17})$"


def _keys(id_col: str):
    key = strip(F.col(id_col))
    number = F.nullif(F.regexp_extract(key, FORM, 2), F.lit("")).cast("bigint")
    return key, F.when(number.isNotNull(), F.regexp_extract(key, FORM, 1)), number


def copies(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(producer, block, lo, hi, copies): disjoint ranges of numbers delivered equally often, at least once."""
    _, producer, number = _keys(id_col)
    seq = df.select(producer.alias("producer"), number.alias("n")).filter("n IS NOT NULL")
    ends = F.explode(F.array(F.struct(F.col("n").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("n") + 1).alias("pos"), F.lit(-1).alias("d"))))
    moves = seq.select("producer", F.shiftright("n", BLOCK).alias("block"), ends.alias("e")).groupBy("producer", "block", "e.pos").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("producer", "block").orderBy("pos")
    stretch = moves.filter("d <> 0").select("producer", "block", F.col("pos").alias("lo"), (F.lead("pos").over(w) - 1).alias("hi"), F.sum("d").over(w).alias("copies"))
    return stretch.filter("copies > 0")


def merge(ranges: DataFrame) -> DataFrame:
    """Disjoint, maximal (producer, block, lo, hi) from ranges that may overlap or touch."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("pos"), F.lit(-1).alias("d"))))
    moves = ranges.select("producer", "block", ends.alias("e")).groupBy("producer", "block", "e.pos").agg(F.sum("e.d").alias("d")).filter("d <> 0")
    w = Window.partitionBy("producer", "block").orderBy("pos")
    depth = moves.select("producer", "block", "pos", F.sum("d").over(w).alias("depth"))
    turns = depth.withColumn("was", F.coalesce(F.lag("depth").over(w), F.lit(0))).filter("(depth > 0) <> (was > 0)")
    return turns.select("producer", "block", F.col("pos").alias("lo"), (F.lead("pos").over(w) - 1).alias("hi"), "depth").filter("depth > 0").drop("depth")


def uncovered(new: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Disjoint (producer, block, lo, hi): what ``new`` covers and ``seen`` does not; both are disjoint in themselves."""
    if seen is None:
        return new.select("producer", "block", "lo", "hi")
    ends = lambda df, n, s: df.select("producer", "block", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.lit(n).alias("n"), F.lit(s).alias("s")), F.struct((F.col("hi") + 1).alias("pos"), F.lit(-n).alias("n"), F.lit(-s).alias("s")))).alias("e"))
    moves = ends(new, 1, 0).unionByName(ends(seen, 0, 1)).groupBy("producer", "block", "e.pos").agg(F.sum("e.n").alias("n"), F.sum("e.s").alias("s"))
    w = Window.partitionBy("producer", "block").orderBy("pos")
    stretch = moves.select("producer", "block", F.col("pos").alias("lo"), (F.lead("pos").over(w) - 1).alias("hi"), F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"))
    return stretch.filter("n > 0 AND s = 0").select("producer", "block", "lo", "hi")


def within(rows: DataFrame, producer: str, block: str, number: str, ranges: DataFrame) -> DataFrame:
    """The ``rows`` whose number lies in one of the disjoint ``ranges``: ranges and rows are put in one order per block, and a
    row is inside if the range that began last before it reaches it. No row meets more than one range."""
    hi, side = fresh(rows, "__hi"), fresh(rows, "__side")
    starts = ranges.select(F.col("producer").alias(producer), F.col("block").alias(block), F.col("lo").alias(number), F.col("hi").alias(hi), F.lit(0).alias(side))
    both = rows.withColumn(side, F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(producer, block).orderBy(number, side).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(hi, F.last(hi, ignorenulls=True).over(w)).filter((F.col(side) == 1) & (F.col(hi) >= F.col(number))).select(*rows.columns)


def malformed(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, copies) of the identifiers that are not of the producer's form."""
    key, _, number = _keys(id_col)
    return df.select(key.alias("id"), number.alias("n")).filter("id IS NOT NULL AND n IS NULL").groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


def repeated(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, copies) of every identifier on more than one row, without surrounding blanks."""
    runs = copies(df, id_col).filter("copies > 1").select("producer", F.explode(F.sequence("lo", "hi")).alias("n"), "copies")
    return runs.select(F.concat("producer", F.lit("_v"), F.col("n").cast("string")).alias("id"), "copies").unionByName(malformed(df, id_col).filter("copies > 1"))


def accept(batch: DataFrame, seen: DataFrame | None = None, seen_ids: DataFrame | None = None, id_col: str = "id", order: tuple[str, ...] = ("ts", "batch_id")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``batch`` to keep, and the seen ranges and malformed identifiers including them.

    What the batch's ranges cover and the seen ones don't is accepted, each number once; malformed identifiers that aren't
    among ``seen_ids`` are. The rank only picks which copy within the batch stands for an accepted identifier: the first by
    ``order`` (nulls last); it keeps one row of an identifier per task before the shuffle, so the copies of one never meet in
    one task, and a block has at most 2**BLOCK rows then. Kept rows have their identifier without blanks.
    """
    key, producer, number = _keys(id_col)
    k, p, n, b, r = (fresh(batch, c) for c in ("__key", "__producer", "__number", "__block", "__rank"))
    keyed = batch.withColumn(k, key).withColumn(p, producer).withColumn(n, number).withColumn(b, F.shiftright(F.col(n), BLOCK))
    none = keyed.filter(F.col(k).isNull())
    w = Window.partitionBy(k).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    first = lambda rows: rows.withColumn(r, F.row_number().over(w)).filter(F.col(r) == 1).drop(r).withColumn(id_col, F.col(k))
    new, ids = copies(batch, id_col).drop("copies"), malformed(batch, id_col).select("id")
    numbered = within(first(keyed.filter(F.col(n).isNotNull())), p, b, n, uncovered(new, seen))
    lone = first(keyed.filter(F.col(k).isNotNull() & F.col(n).isNull()))
    if seen_ids is not None:
        lone = lone.join(seen_ids.select(F.col("id").alias("__sid")), F.col(k) == F.col("__sid"), "left_anti")
        ids = ids.unionByName(seen_ids.select("id")).distinct()
    ranges = merge(new if seen is None else new.unionByName(seen.select("producer", "block", "lo", "hi")))
    kept = reduce(DataFrame.unionByName, [numbered, lone, none])
    return kept.drop(k, p, n, b), ranges, ids
