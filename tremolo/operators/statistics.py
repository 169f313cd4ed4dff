"""Ranks, distribution statistics and rank tests as aggregates and window frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Studentised range quantiles at alpha 0.05 for infinitely many degrees of freedom, by number of methods.
Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def average_rank(by: Sequence[str], value: str, descending: bool = True) -> Column:
    """Rank from 1; ties get the mean of their places."""
    w = Window.partitionBy(*by)
    order = F.desc(value) if descending else F.asc(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(w.orderBy(order)) + (ties - 1) / 2.0


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    out = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"),
    )
    return out.select(*by, "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def ci95(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and its normal 95% interval."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("lo"), (F.avg(value) + half).alias("hi"))


def friedman(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """One row over complete blocks: n, k, chi2 (corrected for ties) and its p, Iman-Davenport's F with df1 and df2,
    Nemenyi's critical difference at 0.05, and ``ranking``: (method, avg_rank), the best first, ties by name.
    """
    whole = Window.partitionBy(F.lit(0))
    k = F.size(F.collect_set(method).over(whole))
    full = df.withColumn("_k", k).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(block))).filter("_k = _m")
    ranked = full.withColumn("r", average_rank([block], value))
    ties = full.groupBy(block, value).count().agg(F.coalesce(F.sum(F.pow("count", F.lit(3)) - F.col("count")), F.lit(0.0)).alias("ties"))
    sums = ranked.groupBy(method).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    place = F.array_sort(F.collect_list(F.struct((F.col("s") / F.col("n")).alias("avg_rank"), F.col(method).alias("method"))))
    one = sums.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s")).alias("ss"), place.alias("ranking")).crossJoin(ties)
    n, k = F.col("n"), F.col("k")
    raw = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3.0 * n * (k + 1)
    chi2 = raw / (1 - F.col("ties") / (n * k * (k * k - 1)))
    one = one.select("n", "k", chi2.alias("chi2"), F.transform("ranking", lambda r: F.struct(r["method"].alias("method"), r["avg_rank"].alias("avg_rank"))).alias("ranking"))
    one = one.withColumn("iman_davenport", F.try_divide((n - 1) * F.col("chi2"), n * (k - 1) - F.col("chi2")))
    q = F.create_map(*[F.lit(x) for kv in Q05.items() for x in kv])[k.cast("int")]
    tail = F.udf(lambda x, dof: None if x is None else chi2_sf(x, int(dof)), "double")  # one row
    return one.select("n", "k", "chi2", tail("chi2", k - 1).alias("p"), "iman_davenport", (k - 1).alias("df1"), ((k - 1) * (n - 1)).alias("df2"), (q * F.sqrt(k * (k + 1) / (6.0 * n))).alias("critical_difference"), "ranking")


def critical_difference(k: int, n: int) -> float:
    """Nemenyi's critical difference of average ranks at 0.05."""
    return Q05[k] * math.sqrt(k * (k + 1) / (6.0 * n))


def cliques(ranking: DataFrame, method: str, rank: str, cd: float) -> DataFrame:
    """For each method, those within the critical difference on either side, the best first; equal sets once."""
    a, b = ranking.select(F.col(method).alias("m"), F.col(rank).alias("ra")), ranking.select(F.col(method).alias("o"), F.col(rank).alias("rb"))
    near = a.crossJoin(b).filter(F.abs(F.col("rb") - F.col("ra")) <= cd)  # as many rows as methods, squared
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rb", "o"))), lambda x: x["o"].cast("string"))
    return near.groupBy("m").agg(F.array_join(ordered, ",").alias("members")).select("members").distinct()


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (series and continued fraction of the incomplete gamma)."""
    a, x = dof / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h
