"""The axis taxonomy: groups, derived labels, expected counts. Labels are derived from axes, never read from models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Axis, group, label, expected variations per seed.
AXES = [
    ("P1", "invariant", "HIT", 4),
    ("P2", "invariant", "HIT", 4),
    ("P3", "invariant", "HIT", 4),
    ("N1", "slope", "MISS", 2),
    ("N2", "slope", "MISS", 2),
    ("N3", "cliff", "MISS", 2),
    ("N4", "cliff", "MISS", 4),
    ("N5", "cliff", "MISS", 4),
    ("N6", "cliff", "MISS", 2),
]
# Domain key and name, by id prefix.
DOMAINS = [("d1", "university_admin"), ("d2", "academic_nlp"), ("d3", "tech_docs"), ("d4", "medical"), ("d5", "vietnamese_admin_edu")]
NAMES = [a for a, *_ in AXES]
TAUS = [round(0.70 + 0.01 * i, 3) for i in range(29)]
HALF_BAND = 0.06


def _lookup(axis: Column, place: int) -> Column:
    out = F.lit(None)
    for row in AXES:
        out = F.when(axis == row[0], F.lit(row[place])).otherwise(out)
    return out


def axis_group(axis: Column) -> Column:
    return _lookup(axis, 1)


def expected_label(axis: Column) -> Column:
    return _lookup(axis, 2)


def domain_of(id_: Column) -> Column:
    """The domain an id's prefix names; null for an unknown prefix."""
    out = F.lit(None)
    for key, name in DOMAINS:
        out = F.when(F.startswith(id_, F.lit(f"{key}_")), F.lit(name)).otherwise(out)
    return out


def language(domain: Column) -> Column:
    return F.when(domain == DOMAINS[-1][1], "vi").otherwise("en")


def derived(rows: DataFrame, axis: str = "axis") -> DataFrame:
    """Rows of known axes with axis_group and expected_label derived, and delta kept for N-axes only."""
    known = rows.filter(F.col(axis).isin(NAMES)).withColumn("axis_group", axis_group(F.col(axis))).withColumn("expected_label", expected_label(F.col(axis)))
    return known.withColumn("delta", F.when(F.startswith(F.col(axis), F.lit("N")), F.col("delta"))) if "delta" in rows.columns else known
