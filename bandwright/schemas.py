"""Schemas of the stage tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType, TimestampType


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


JUDGE = StructType([StructField("model", StringType()), StructField("axis_ok", BooleanType()), StructField("conf", DoubleType()), StructField("issue", StringType())])
TS = [StructField("ts", TimestampType())]
FACTS = StructType([*_strings("fact_id", "domain", "doc_id", "statement", "source_span", "batch_id"), *TS])
SEEDS = StructType([*_strings("seed_id", "domain", "doc_id"), StructField("fact_ids", ArrayType(StringType())), *_strings("question", "answer", "generator_model", "batch_id"), *TS])
VARIATIONS = StructType(
    [
        *_strings("id", "domain", "seed_id", "seed_question", "answer", "variation", "axis", "axis_group", "expected_label", "delta", "generator_model", "batch_id"),
        StructField("judge1", JUDGE), StructField("judge2", JUDGE), *TS,
    ]
)
RAW_JUDGMENT = StructType([StructField("id", StringType()), StructField("axis_ok", BooleanType()), StructField("conf", DoubleType()), StructField("issue", StringType())])
JUDGMENTS = StructType([StructField("id", StringType()), StructField("judge_model", StringType()), *RAW_JUDGMENT.fields[1:], StructField("batch_id", StringType()), *TS])
DECISIONS = StructType([*_strings("pair_id", "decision"), StructField("conf", DoubleType()), *_strings("verifier_model", "batch_id"), *TS])
RISK_PAIRS = StructType(_strings("pair_id", "group", "axis", "lang", "domain", "q1", "q2", "expected", "note"))
ANNOTATIONS = StructType(_strings("gid", "label"))
