"""The five appendix tables as LaTeX rows: overlap by scorer and by domain, thresholds by cost ratio, configurations, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.taxonomy import NAMES
from bandwright.operators import decision, overlap
from bandwright.plans.base import SCORED, pairs, scored, with_
from bandwright.plans.decision import _COUNTS, _GRID, _LONG, _RHO, PREDICTED, predicted
from bandwright.plans.similarity import ORACLES as SIMILARITY
from bandwright.plans.similarity import io_per_domain
from bandwright.plans.statistics import _T, _long, _verified_io, table
from bandwright.sources import reports

CHANGES = [a for a in NAMES if a.startswith("N")]
COSTS = [1.0, 10.0, 100.0, 1000.0]
SHOWN = ["A", "B", "C"]


def appendix_scorers(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each scorer on each change axis."""
    return reports.latex_pivot(table(spark, d), "encoder", "block", "value", CHANGES)


def appendix_domains(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each domain on each change axis."""
    return reports.latex_pivot(io_per_domain(spark, d), "domain", "axis", "io", CHANGES)


def appendix_costs(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of greatest utility in each domain, at cost ratios nearest to 1, 10, 100 and 1,000."""
    best = decision.utility(scored(spark, d).filter("domain IS NOT NULL"), ["domain"])
    near = decision.nearest_rho(best, COSTS, ["domain"]).withColumn("wanted", F.col("wanted").cast("int").cast("string"))
    return reports.latex_pivot(near, "domain", "wanted", "tau", [str(int(c)) for c in COSTS], 2)


def appendix_configurations(spark: SparkSession, d: str) -> DataFrame:
    """Per cent of false hits of threshold, cross scorer and verifier: in all, on slopes and on cliffs."""
    rates = decision.ratios(decision.seed_counts(predicted(spark, d), tuple(SHOWN)), ["config"])
    cents = [F.concat(F.format_string("%.1f", F.round(F.col(c) * 100, 1)), F.lit("%")).alias(c) for c in ("false_hit", "false_hit_slope", "false_hit_cliff")]
    return reports.latex_rows(rates.select("config", *cents), ["config", "false_hit", "false_hit_slope", "false_hit_cliff"])


def appendix_generators(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap on the change axes of each scorer, by the model that generated the pairs."""
    by = pairs(spark, d).filter("generator_model IS NOT NULL").select("id", "generator_model")
    rows = _long(spark, d).join(by, "id")
    io = overlap.irreducible_overlap(overlap.against_hits(rows, "axis", ["generator_model", "encoder"]), ["generator_model", "encoder", "axis"])
    mean = io.groupBy("encoder", "generator_model").agg(F.round(F.avg(F.round("io", 6)), 9).alias("value"))
    return reports.latex_rows(mean, ["encoder", "generator_model", "value"])


QUERIES = {f.__name__: f for f in (appendix_scorers, appendix_domains, appendix_costs, appendix_configurations, appendix_generators)}

_CELL = "coalesce(printf('%.{0}f', round({1}, {0})), '--')"
_ROW = "SELECT replace({0}, '_', '\\_') || ' & ' || string_agg({1}, ' & ' ORDER BY {2}) || ' \\\\' AS line FROM {3} GROUP BY {0}"
_AXES = ", ".join(f"('{a}')" for a in CHANGES)
_BY = (
    "SELECT p.generator_model, l.encoder, l.axis, l.s AS sim, l.hit FROM long l JOIN pairs p ON l.id = p.id WHERE l.hit = 0 AND p.generator_model IS NOT NULL UNION ALL "
    "SELECT h.generator_model, h.encoder, n.axis, h.s, h.hit FROM (SELECT l.*, p.generator_model FROM long l JOIN pairs p ON l.id = p.id WHERE l.hit = 1) h JOIN "
    "(SELECT DISTINCT p.generator_model, l.encoder, l.axis FROM long l JOIN pairs p ON l.id = p.id WHERE l.hit = 0) n ON h.generator_model = n.generator_model AND h.encoder = n.encoder"
)
_RATE = lambda a, b: f"printf('%.1f', round(sum({a}) * 100 / CAST(sum({b}) AS DOUBLE), 1)) || '\\%'"

ORACLES = {
    "appendix_scorers": with_(_T, f"a(axis) AS (VALUES {_AXES})", "c AS (SELECT e.encoder, a.axis, t.value FROM (SELECT DISTINCT encoder FROM t) e CROSS JOIN a LEFT JOIN t ON t.encoder = e.encoder AND t.block = a.axis)") + _ROW.format("encoder", _CELL.format(3, "value"), "axis", "c"),
    "appendix_domains": with_(f"i AS ({SIMILARITY['io_per_domain']})", f"a(axis) AS (VALUES {_AXES})", "c AS (SELECT e.domain, a.axis, i.io FROM (SELECT DISTINCT domain FROM i) e CROSS JOIN a LEFT JOIN i ON i.domain = e.domain AND i.axis = a.axis)") + _ROW.format("domain", _CELL.format(3, "io"), "axis", "c"),
    "appendix_costs": with_(SCORED, _GRID, _RHO, "c AS (SELECT domain, tau, count(*) FILTER (WHERE hit = 1 AND sim > tau) AS th, count(*) FILTER (WHERE hit = 0 AND sim > tau) AS fh, count(*) FILTER (WHERE hit = 1 AND sim <= tau) AS fm, count(*) AS n FROM scored, grid WHERE domain IS NOT NULL GROUP BY 1, 2)",
        "u AS (SELECT domain, CAST(rho AS INT) AS rho, tau, (th - rho * fh - fm) / CAST(n AS DOUBLE) AS u FROM c, rhos)", "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, rho ORDER BY u DESC, tau) AS r FROM u) WHERE r = 1)",
        "w AS (SELECT unnest([1e0, 10e0, 100e0, 1000e0]) AS wanted)", "n AS (SELECT domain, wanted, tau, row_number() OVER (PARTITION BY domain, wanted ORDER BY abs(rho - wanted), rho) AS r FROM t, w)", "c2 AS (SELECT * FROM n WHERE r = 1)") + _ROW.format("domain", _CELL.format(2, "tau"), "wanted", "c2"),
    "appendix_configurations": with_(PREDICTED, _LONG, _COUNTS) + f"SELECT config || ' & ' || {_RATE('false_hits', 'misses')} || ' & ' || {_RATE('false_slope', 'slope')} || ' & ' || {_RATE('false_cliff', 'cliff')} || ' \\\\' AS line FROM counts WHERE config IN ('A', 'B', 'C') GROUP BY config",
    "appendix_generators": with_(f"i AS ({_verified_io('generator_model, encoder, axis', _BY)})") + "SELECT encoder || ' & ' || replace(generator_model, '_', '\\_') || ' & ' || printf('%.3f', round(avg(io), 3)) || ' \\\\' AS line FROM i GROUP BY encoder, generator_model",
}
