"""Agreement of raters: majority, Fleiss, Gwet, Cohen, Krippendorff, buckets with Wilson intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.functions.stats import wilson
from bandwright.operators.validate import require_equal

DEFINITE = ("SAME", "DIFFERENT")


def majority(rows: DataFrame, raters: list[str]) -> DataFrame:
    """``rows`` with n_same, n_diff and gold: the label at least two of three raters gave; null without one."""
    votes = F.array(*[F.col(r) for r in raters])
    n = lambda y: F.size(F.filter(votes, lambda v: v == y))
    counted = rows.withColumn("n_same", n("SAME")).withColumn("n_diff", n("DIFFERENT"))
    need = len(raters) // 2 + 1
    return counted.withColumn("gold", F.when(F.col("n_same") >= need, "SAME").when(F.col("n_diff") >= need, "DIFFERENT"))


#: What is summed, as SQL.
SUMS = {"n": "1", "same": "n_same", "pairs": "n_same * (n_same - 1) + n_diff * (n_diff - 1)", "agree": "agree"}


def rater_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, same, pairs, agree): all that kappa, AC1 and agreement need; ``agree`` of a row is 0 or 1."""
    return rows.groupBy(*keys).agg(*[F.sum(F.expr(x)).cast("bigint").alias(c) for c, x in SUMS.items()])


def fleiss(sums: DataFrame, keys: list[str], raters: int = 3) -> DataFrame:
    """(keys, n, kappa, ac1, raw, p_same, agreement) of two categories; null where the chance term leaves nothing."""
    raw = F.col("pairs") / (F.lit(float(raters * (raters - 1))) * F.col("n"))
    p = F.col("same") / (F.col("n") * raters)
    k, g = p * p + (1 - p) * (1 - p), 2 * p * (1 - p)
    return sums.select(*keys, "n", F.try_divide(raw - k, 1 - k).alias("kappa"), F.try_divide(raw - g, 1 - g).alias("ac1"), raw.alias("raw"), p.alias("p_same"), (F.col("agree") / F.col("n")).alias("agreement"))


def pairwise(rows: DataFrame, raters: list[str]) -> DataFrame:
    """(pair, n, raw, kappa, ac1) of each two raters; other labels than the definite ones agree but have no chance share."""
    two = [F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(raters) for b in raters[i + 1 :]]
    each = rows.select(F.explode(F.array(*two)).alias("e")).select("e.*")
    at = lambda c, y: F.count_if(F.col(c) == y)
    t = each.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"), *[at(c, y).alias(f"{c}{i}") for c in "xy" for i, y in enumerate(DEFINITE)])
    n = F.col("n").cast("double")
    po = F.col("same") / n
    pe = (F.col("x0") * F.col("y0") + F.col("x1") * F.col("y1")) / (n * n)
    share = [(F.col(f"x{i}") + F.col(f"y{i}")) / (2 * n) for i in (0, 1)]
    pg = share[0] * (1 - share[0]) + share[1] * (1 - share[1])
    return t.select("pair", "n", po.alias("raw"), F.try_divide(po - pe, 1 - pe).alias("kappa"), F.try_divide(po - pg, 1 - pg).alias("ac1"))


def buckets(rows: DataFrame, dimensions: list[str], agree: str = "agree") -> DataFrame:
    """(dimension, value, n, agree, share, lo, hi) of every value of every dimension, in one pass over grouping sets."""
    rows.createOrReplaceTempView("__buckets")
    sets = ", ".join(f"({c})" for c in dimensions)
    name = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in dimensions) + " END"
    value = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN cast({c} AS string)" for c in dimensions) + " END"
    t = rows.sparkSession.sql(f"SELECT {name} AS dimension, {value} AS value, count(*) AS n, sum({agree}) AS agree FROM __buckets GROUP BY GROUPING SETS ({sets})")
    lo, hi = wilson(F.col("agree").cast("double"), F.col("n"))
    return t.select("dimension", "value", "n", "agree", (F.col("agree") / F.col("n")).alias("share"), lo.alias("lo"), hi.alias("hi"))


def krippendorff(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, agreement, alpha, rate_a, rate_b) of two coders with boolean values: alpha = 1 - observed / expected."""
    keys = keys or []
    t = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.count_if(a).alias("ta"), F.count_if(b).alias("tb"))
    n = F.col("n").cast("double")
    values, true = 2 * n, F.col("ta") + F.col("tb")
    observed = 1 - F.col("same") / n
    expected = F.try_divide(2 * true * (values - true), values * (values - 1))
    return t.select(*keys, "n", (F.col("same") / n).alias("agreement"), (1 - F.try_divide(observed, expected)).alias("alpha"), (F.col("ta") / n).alias("rate_a"), (F.col("tb") / n).alias("rate_b"))


def joined_raters(pairs: DataFrame, sheets: dict[str, DataFrame], key: str = "gid") -> DataFrame:
    """``pairs`` with a column of labels per rater; ValueError unless every sheet (key, label) has the same keys. Keys without a pair are left out."""
    first, *rest = sheets
    for r in rest:
        require_equal(sheets[first], sheets[r], key, f"raters {first} and {r}")
    for r, sheet in sheets.items():
        pairs = pairs.join(sheet.select(key, F.col("label").alias(r)), key)
    return pairs


def agrees(gold: Column, hit: Column) -> Column:
    """1 where the gold label says what the pair's label says."""
    return F.coalesce((gold == F.when(hit == 1, "SAME").otherwise("DIFFERENT")).cast("int"), F.lit(0))
