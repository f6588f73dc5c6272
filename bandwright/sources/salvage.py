"""Rows salvaged from raw logs: prose, code fences and JSON lines, some broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bandwright.functions.taxonomy import domain_of
from bandwright.functions.text import strip

BAD = "__bad"


def candidate(line: Column) -> Column:
    """The line without blanks and backticks around it."""
    return F.regexp_replace(strip(line), "^`+|`+$", "")


def salvage(lines: DataFrame, schema: StructType, line: str = "value") -> DataFrame:
    """``lines`` that begin with a brace, parsed: a struct ``row``, and ``bad`` where a line isn't JSON of the schema.

    A value of another type than the schema's (a quoted boolean, say) makes the line bad, as the token is checked, not a cast.
    """
    marked = StructType([*schema.fields, StructField(BAD, StringType())])
    text = F.col("__text")
    parsed = F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = lines.withColumn("__text", candidate(F.col(line))).filter(F.startswith(text, F.lit("{")))
    rows = rows.withColumn("__row", F.explode(F.array(parsed)))  # a generator is evaluated once, whatever is asked of its output
    keep = F.struct(*[F.col(f"__row.{f}") for f in schema.names])
    return rows.withColumn("bad", F.col(f"__row.{BAD}").isNotNull()).withColumn("row", F.when(~F.col("bad"), keep)).drop("__text", "__row")


def good(salvaged: DataFrame) -> DataFrame:
    return salvaged.filter("NOT bad").select("row.*")


def tally(salvaged: DataFrame) -> DataFrame:
    """One row: candidates, parsed, bad."""
    return salvaged.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(~F.col("bad")).alias("parsed"), F.count_if("bad").alias("bad"))


def valid_judgments(rows: DataFrame) -> DataFrame:
    """A true id, a boolean verdict and a confidence of 0 to 1."""
    return rows.filter((F.coalesce("id", F.lit("")) != "") & F.col("axis_ok").isNotNull() & F.col("conf").between(0, 1))


def valid_decisions(rows: DataFrame) -> DataFrame:
    return rows.filter((F.coalesce("pair_id", F.lit("")) != "") & F.col("decision").isin("SERVE", "REGENERATE"))


def route(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, seeds, and what is neither or of an unknown domain, of rows with ``type`` and ``doc_id``."""
    tagged = rows.withColumn("domain", domain_of(F.col("doc_id")))
    known = F.col("domain").isNotNull() & F.col("type").isin("fact", "seed")
    return tagged.filter(F.col("domain").isNotNull() & (F.col("type") == "fact")), tagged.filter(F.col("domain").isNotNull() & (F.col("type") == "seed")), tagged.filter(~F.coalesce(known, F.lit(False)))


def fact_ids(seeds: DataFrame, facts: DataFrame) -> DataFrame:
    """``seeds`` (doc_id, line, fact_refs) with fact_ids: the document's facts on earlier lines, by reference from 0.

    References that aren't below the number of those facts are dropped, negative ones too: they aren't positions.
    """
    known = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "fact_id"))).alias("__facts"))
    joined = seeds.join(known, "doc_id", "left")
    earlier = F.filter(F.coalesce("__facts", F.array().cast("array<struct<line:bigint,fact_id:string>>")), lambda f: f["line"] < F.col("line"))
    joined = joined.withColumn("__facts", earlier)
    ids = F.transform(F.filter("fact_refs", lambda r: (r >= 0) & (r < F.size("__facts"))), lambda r: F.col("__facts")[r]["fact_id"])
    return joined.withColumn("fact_ids", F.coalesce(ids, F.array().cast("array<string>"))).drop("__facts")
