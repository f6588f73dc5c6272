"""Queries of the exactly-once operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandwright.operators import messages
from bandwright.session import load


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return messages.repeated(load(spark, d, "t03_variations")).select("id")


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "t03_variations").select("id", "ts", "batch_id")
    return messages.accept(rows)[0]


QUERIES = {f.__name__: f for f in (p4_found, p4_kept)}

_KEY = r"regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"

ORACLES = {
    "p4_found": f"SELECT {_KEY} AS id FROM t03_variations WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "p4_kept": f"""
WITH k AS (SELECT {_KEY} AS id, ts, batch_id FROM t03_variations)
SELECT id, ts, batch_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts NULLS LAST, batch_id NULLS LAST) AS r FROM k WHERE id IS NOT NULL) WHERE r = 1
UNION ALL SELECT id, ts, batch_id FROM k WHERE id IS NULL""",
}
