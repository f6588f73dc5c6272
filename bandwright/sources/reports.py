"""Reports: LaTeX rows, text distributions, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latex_rows(table: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """One LaTeX row per row in ``line``: numbers with a fixed number of digits, a dash for null, special characters escaped."""

    def cell(c: str) -> Column:
        kind = table.schema[c].dataType.typeName()
        text = F.format_string(f"%.{digits}f", F.col(c)) if kind in ("double", "float") else F.regexp_replace(F.col(c).cast("string"), r"([&%$#_{}])", r"\\$1")
        return F.when(F.col(c).isNull(), F.lit("--")).otherwise(text)

    return table.select(F.concat(F.concat_ws(" & ", *[cell(c) for c in columns]), F.lit(r" \\")).alias("line"))


def latex_pivot(rows: DataFrame, row: str, column: str, value: str, columns: list[str], digits: int = 3) -> DataFrame:
    """A value per row and column as LaTeX rows, in order of ``row``; the columns are named, so no pass finds them."""
    table = rows.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row)
    return latex_rows(table, [row, *columns], digits)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """One row: ``k:n  k:n`` in order of k, '?' for null."""
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("?")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat_ws(":", x["k"], x["n"].cast("string")))
    return counts.agg(F.concat_ws("  ", line).alias("report"))
