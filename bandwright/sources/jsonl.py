"""JSONL tables: strict and lenient scans, append and overwrite, guards, line counts, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bandwright.functions.text import strip
from bandwright.operators.validate import require

CORRUPT = "_corrupt_record"


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A malformed line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """Undecodable lines and rows without the key are skipped."""
    marked = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.filter(F.col(CORRUPT).isNull() & F.col(key).isNotNull()).select(*schema.names)


def read_documents(spark: SparkSession, glob: str, schema: StructType | None = None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(glob)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a stage table, nulls written out."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def overwrite(rows: DataFrame, path: str) -> None:
    """Replaces a build artifact."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_some(rows: DataFrame, path: str, what: str = "stage") -> None:
    """Appends, or ValueError if there is no row; nothing is written then."""
    append(require(rows, 1, what), path)


def merge_shards(spark: SparkSession, glob: str, schema: StructType, order: list[str]) -> DataFrame:
    """Shards of a stage in the order of their batches, whatever order they were written in."""
    return read_strict(spark, glob, schema).orderBy(*order)


def count_lines(spark: SparkSession, path: str, where: Column | None = None) -> int:
    """Lines that aren't blank, and satisfy ``where`` on ``value``."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    return lines.count() if where is None else lines.filter(where).count()


def result_document(row: DataFrame) -> DataFrame:
    """Each row as one JSON document with nulls, in ``json``."""
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def save_result(row: DataFrame, path: str, model: str) -> None:
    """A model's results as its own partition of the result table: other models' stay, its own are replaced."""
    row.write.mode("overwrite").json(f"{path}/model={model}")
