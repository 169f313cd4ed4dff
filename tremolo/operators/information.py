"""Mutual information of each feature with the label from distances to neighbours of the class, exactly over all rows.

In one dimension neighbours are next to each other in sorted order, so no pair of rows is made.  Equal values of a
class become one row with their number; the values of a feature are cut into ranges of about ``RANGE`` rows at
quantiles, and the rows of a class that lie next to a range are handed over its borders.  A row's neighbourhood is then
counted by cumulative numbers at its two ends, each of which goes to the range that it falls in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, and ranges of a feature, at most.
RANGE, RANGES = 1 << 16, 1000


def digamma(v: np.ndarray) -> np.ndarray:
    """By the recurrence up to 12, then the asymptotic series (off by less than 1e-13)."""
    v, out = np.array(v, float), np.zeros(len(v))
    while (low := v < 12).any():
        out[low] -= 1 / v[low]
        v[low] += 1
    w = 1 / (v * v)
    return out + np.log(v) - 0.5 / v - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w / 240)))


def _nearest(v: np.ndarray, c: np.ndarray, size: int, k: int) -> np.ndarray:
    """Distance of each distinct value (c times there) to its k-th neighbour, among values in order that hold all candidates."""
    k = min(k, size - 1)
    if k < 1:
        return np.full(len(v), np.nan)
    side = []  # (distances, numbers) of the k places before and behind
    for step in [*range(-k, 0), *range(1, k + 1)]:
        far, n = np.full(len(v), np.inf), np.zeros(len(v))
        at = np.arange(len(v)) + step
        ok = (at >= 0) & (at < len(v))
        far[ok], n[ok] = np.abs(v[at[ok]] - v[ok]), c[at[ok]]
        side.append((far, n))
    best = np.where(c - 1 >= k, 0.0, np.inf)
    for far, _ in side:
        held = c - 1 + sum(n * (d <= far) for d, n in side)
        best = np.where(held >= k, np.minimum(best, far), best)
    return best


def nearest_information(df: DataFrame, k: int = 3) -> DataFrame:
    """(feature, score) over (y, features): psi(n) + mean of psi(k) - psi(size of the class) - psi(rows in reach), not below 0.

    A row's reach is the distance to the k-th other row of its class (of the class's last one, if it is smaller),
    without that row itself; equal values are in reach.  Classes of one row, nulls and NaN don't count.
    """
    long = df.select(F.col("y").cast("string").alias("y"), F.posexplode("features").alias("feature", "v")).withColumn("v", F.col("v").cast("double"))
    values = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("feature", "y", "v").agg(F.count(F.lit(1)).alias("c")).cache()
    sizes = values.groupBy("feature", "y").agg(F.sum("c").alias("size"))
    n = values.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    ranges = min(RANGES, -(-n // RANGE))
    if ranges > 1:
        cuts = values.groupBy("feature").agg(F.percentile_approx("v", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges)).alias("cuts"))  # RANGES numbers a feature
    else:
        cuts = values.select("feature", F.array().cast("array<double>").alias("cuts")).distinct()
    place = lambda v: F.aggregate("cuts", F.lit(0), lambda a, e: a + (e < v).cast("int"))
    rows = values.join(sizes.filter("size > 1"), ["feature", "y"]).join(cuts, "feature").withColumn("part", place(F.col("v"))).drop("cuts")

    group = Window.partitionBy("feature", "y", "part")
    edge = rows.withColumns({"a": F.row_number().over(group.orderBy("v")), "b": F.row_number().over(group.orderBy(F.desc("v")))}).filter((F.col("a") <= k) | (F.col("b") <= k))
    line = Window.partitionBy("feature", "y").orderBy("v")  # at most 2 * k rows a range
    pair = F.struct("v", "c")
    ends = edge.withColumns({"before": F.collect_list(pair).over(line.rowsBetween(-k, -1)), "behind": F.collect_list(pair).over(line.rowsBetween(1, k))})
    context = ends.groupBy("feature", "y", "part").agg(F.min_by("before", "v").alias("before"), F.max_by("behind", "v").alias("behind"))
    given = rows.select("feature", "y", "part", "size", "v", "c", F.lit(True).alias("own"))
    lent = context.join(sizes, ["feature", "y"]).select("feature", "y", "part", "size", F.explode(F.concat("before", "behind")).alias("x"))
    given = given.unionByName(lent.select("feature", "y", "part", "size", "x.v", "x.c", F.lit(False).alias("own")))

    def reach(t: pa.Table) -> pa.Table:
        v, c, own, size = (t.column(x).to_numpy() for x in ("v", "c", "own", "size"))
        order = np.argsort(v, kind="stable")
        d = np.empty(len(v))
        d[order] = _nearest(v[order], c[order].astype(float), int(size[0]), k)
        mine = np.flatnonzero(own)
        d = d[mine] * (1 - 1e-9)  # without the neighbour itself
        took = lambda x: t.column(x).take(pa.array(mine))
        return pa.table({**{x: took(x) for x in ("feature", "y", "size", "v", "c")}, "low": pa.array(v[mine] - d), "high": pa.array(v[mine] + d)})

    reached = given.groupBy("feature", "y", "part").applyInArrow(reach, "feature int, y string, size long, v double, c long, low double, high double")
    # Both ends of a reach ask their range how many rows of the feature lie below (the low end) or not above (the high one).
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("low").alias("at")), F.struct(F.lit(1).alias("sign"), F.col("high").alias("at"))))
    asked = reached.select("feature", "y", "size", "c", F.col("v").alias("own"), ends.alias("q")).join(cuts, "feature").withColumn("part", place(F.col("q.at")))
    every = rows.groupBy("feature", "part", "v").agg(F.sum("c").alias("c"))
    both = every.select("feature", "part", F.lit(None).cast("string").alias("y"), F.lit(0).cast("long").alias("size"), "c", F.lit(0.0).alias("own"), F.lit(0).alias("sign"), F.col("v").alias("at"))
    both = both.unionByName(asked.select("feature", "part", "y", "size", "c", "own", "q.sign", "q.at"))

    def count(t: pa.Table) -> pa.Table:
        at, sign, c = (t.column(x).to_numpy() for x in ("at", "sign", "c"))
        data = np.flatnonzero(sign == 0)
        data = data[np.argsort(at[data])]
        total = np.concatenate([[0], np.cumsum(c[data])])
        ask = np.flatnonzero(sign != 0)
        found = np.where(sign[ask] < 0, total[np.searchsorted(at[data], at[ask], "left")], total[np.searchsorted(at[data], at[ask], "right")])
        took = lambda x: t.column(x).take(pa.array(ask))
        return pa.table({**{x: took(x) for x in ("feature", "part", "y", "size", "c", "own", "sign")}, "found": pa.array(found.astype(np.int64))})

    found = both.groupBy("feature", "part").applyInArrow(count, "feature int, part int, y string, size long, c long, own double, sign int, found long")
    parts = every.groupBy("feature", "part").agg(F.sum("c").alias("n")).groupBy("feature").agg(F.collect_list(F.struct("part", "n")).alias("parts"))  # a number a range
    before = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(p["part"] < F.col("part"), p["n"]).otherwise(F.lit(0).cast("long")))
    held = found.join(parts, "feature").groupBy("feature", "y", "own", "size", "c").agg(F.sum(F.col("sign") * (F.col("found") + before)).alias("m"))

    def terms(batches):
        for b in batches:
            size, c, m = (b.column(x).to_numpy().astype(float) for x in ("size", "c", "m"))
            yield pa.RecordBatch.from_arrays([b.column("feature"), b.column("c"), pa.array(c * (digamma(np.minimum(k, size - 1)) - digamma(size) - digamma(m)))], names=["feature", "c", "t"])

    def last(batches):
        for b in batches:
            n, t = b.column("n").to_numpy().astype(float), b.column("t").to_numpy(zero_copy_only=False)
            some = np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("feature"), pa.array(np.where(n > 0, np.maximum(0.0, digamma(some) + np.nan_to_num(t) / some), 0.0))], names=["feature", "score"])

    sums = held.select("feature", "size", "c", "m").mapInArrow(terms, "feature int, c long, t double").groupBy("feature").agg(F.sum("c").alias("n"), F.sum("t").alias("t"))
    whole = long.select("feature").distinct().join(sums, "feature", "left").na.fill(0)
    return whole.select("feature", "n", "t").mapInArrow(last, "feature int, score double")
