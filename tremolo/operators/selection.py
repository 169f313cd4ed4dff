"""Feature selection: scores per feature, an ensemble of votes, and what follows from them.

Input: ``id``, ``y`` and ``features`` (array).  A scorer returns (feature, score), feature from 0; higher is
better.  All run over all rows, in tasks; ``n_max`` bounds the rows of the slow ones by a seeded sample, if wanted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .information import digamma, nearest_information
from .splits import seeded, stratified
from .statistics import average_rank


def long(df: DataFrame) -> DataFrame:
    return df.select("id", "y", F.posexplode("features").alias("feature", "v")).withColumn("v", F.col("v").cast("double"))


def variance(df: DataFrame) -> DataFrame:
    """Population variance."""
    return long(df).groupBy("feature").agg(F.var_pop("v").alias("score"))


def pearson(df: DataFrame) -> DataFrame:
    """Mean over classes of |correlation with the class indicator|: class sums give all of them in one pass."""
    by = long(df).groupBy("feature", "y").agg(F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("feature")
    n, s, q = F.sum("c").over(w), F.sum("s").over(w), F.sum("q").over(w)
    by = by.withColumns({"n": n, "m": s / n, "sd": F.sqrt(F.greatest(q / n - (s / n) ** 2, F.lit(0.0))), "t": F.col("c") / n})
    r = (F.col("s") / F.col("n") - F.col("m") * F.col("t")) / ((F.col("sd") + 1e-12) * (F.sqrt(F.col("t") * (1 - F.col("t"))) + 1e-12))
    return by.groupBy("feature").agg(F.avg(F.abs(r)).alias("score"))


def mutual_information(df: DataFrame, bins: int = 8) -> DataFrame:
    """Mutual information with the label over equal-width bins of all rows (``nearest_information`` estimates it from neighbours)."""
    v = long(df)
    edge = v.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = v.join(F.broadcast(edge), "feature").withColumn("b", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") + 1e-12 - F.col("lo")) * bins), F.lit(bins - 1)))
    c = b.groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("feature")
    n = F.sum("c").over(w)
    px, py = F.sum("c").over(Window.partitionBy("feature", "b")), F.sum("c").over(Window.partitionBy("feature", "y"))
    return c.withColumn("t", F.col("c") / n * F.log(F.col("c") * n / (px * py))).groupBy("feature").agg(F.sum("t").alias("score"))


def _frame(df: DataFrame, scores) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "feature int, score double")


def _arrays(b: pa.RecordBatch, column: str) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)


def _bounded(df: DataFrame, n_max: int | None, seed: int = 42) -> DataFrame:
    """All rows, or a stratified seeded sample of about ``n_max``."""
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("y").cast("string").alias("y"), F.col("features").cast("array<double>").alias("features"))
    return rows if n_max is None else stratified(rows, "y", n_max, seeded("id", seed))


def relieff(df: DataFrame, k: int = 10, n_max: int | None = None) -> DataFrame:
    """Near misses less near hits, k neighbours of each class, classes weighted by size.

    Features count by their range.  Neighbours are found by blocks against blocks, exactly and over all rows; each
    pair then adds its differences to sums that are made in the tasks.
    """
    from .balancing import crossed, neighbours, vectors

    rows = _bounded(df, n_max)
    if rows.isEmpty():
        return _frame(df, [])
    spans = long(rows).groupBy("feature").agg((F.max("v") - F.min("v")).alias("s")).orderBy("feature").collect()  # one row a feature
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one row a class
    n, span = sum(sizes.values()), np.array([r["s"] for r in spans]) + 1e-12
    sent = df.sparkSession.sparkContext.broadcast(span)

    def scale(batches):
        for b in batches:
            yield b.set_column(2, "features", pa.array(list(_arrays(b, "features") / sent.value), pa.list_(pa.float64())))

    rows = rows.mapInArrow(scale, rows.schema)
    share = F.create_map(*[F.lit(x) for y, c in sizes.items() for x in (y, c / n)])
    near = neighbours(rows, rows, k, each_class=True, metric="manhattan").join(rows.select("id", "y"), "id")
    weight = F.when(F.col("other") == F.col("y"), -1.0).otherwise(share[F.col("other")] / (1 - share[F.col("y")])) / F.size("near")
    # A query's block takes its neighbours along and meets the blocks of rows again; no pair's vectors are shuffled.
    pairs = near.select("id", F.transform("near.id", lambda i: F.struct(i.alias("to"), weight.alias("w"))).alias("p"))
    pairs = pairs.groupBy("id").agg(F.flatten(F.collect_list("p")).alias("p")).select("id", F.col("p.to").alias("to"), F.col("p.w").alias("w"))
    met = crossed(rows.join(pairs, "id"), rows, more=("to", "w"), counted=rows).select("q_x", "q_to", "q_w", "r_id", "r_x")

    def add(batches):
        total = np.zeros(len(span))
        for b in batches:
            for n in range(b.num_rows):
                x, z, ids = vectors(b.column("q_x"), n), vectors(b.column("r_x"), n), b.column("r_id")[n].values.to_numpy()
                to, w = b.column("q_to")[n].values, b.column("q_w")[n].values.flatten().to_numpy()
                i, to = np.repeat(np.arange(len(x)), to.value_lengths().to_numpy()), to.flatten().to_numpy()
                order = np.argsort(ids)
                j = order[np.minimum(np.searchsorted(ids, to, sorter=order), len(ids) - 1)]
                here = np.flatnonzero(ids[j] == to)
                for lo in range(0, len(here), 4096):
                    some = here[lo : lo + 4096]
                    total += (w[some][:, None] * np.abs(x[i[some]] - z[j[some]])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["feature", "s"])

    sums = met.mapInArrow(add, "feature int, s double").groupBy("feature").agg((F.sum("s") / max(n, 1)).alias("score"))
    return sums


def comoments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray, dict]:
    """(rows, means, co-moments about them, {class: (rows, means, squares about them)}) of all features, in one pass.

    A task keeps running sums about its own means and hands on one row a feature; parts are merged feature by
    feature.  What comes back is features x features and classes x features numbers.
    """
    rows = df.select(F.col("y").cast("string").alias("y"), F.col("features").cast("array<double>").alias("features"))

    def merged(a, b):
        """Two parts (rows, means, moments), moments of vectors or of pairs."""
        (n, m, s), (k, u, t) = a, b
        gap, both = u - m, n + k
        cross = np.outer(gap, gap) if np.ndim(s) == 2 else gap * gap
        return both, m + gap * k / both, s + t + cross * (n * k / both)

    def part(batches):
        whole, by = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _arrays(b, "features"), np.array(b.column("y").to_pylist(), object)
            mean = x.mean(axis=0)
            mine = len(x), mean, (x - mean).T @ (x - mean)
            whole = mine if whole is None else merged(whole, mine)
            for c in sorted(set(y.tolist()), key=str):
                z = x[y == c]
                one = len(z), z.mean(axis=0), ((z - z.mean(axis=0)) ** 2).sum(axis=0)
                by[c] = one if c not in by else merged(by[c], one)
        if whole is None:
            return
        n, mean, moments = whole
        blob = lambda v: v.astype(np.float64).tobytes()
        out = [(f, None, n, blob(mean), blob(moments[f])) for f in range(len(mean))] + [(-1, c, k, blob(m), blob(s)) for c, (k, m, s) in by.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["feature", "y", "n", "mean", "s"])

    def merge(table: pa.Table) -> pa.Table:
        f = table.column("feature")[0].as_py()
        total = None
        for n, m, s in sorted(zip(*(table.column(c).to_pylist() for c in ("n", "mean", "s")), strict=True)):  # in one order
            m, s = np.frombuffer(m), np.frombuffer(s)
            if total is None:
                total = n, m, s
            elif f < 0:
                total = merged(total, (n, m, s))
            else:
                k, u, t = total
                total = k + n, u + (m - u) * n / (k + n), t + s + (m - u)[f] * (m - u) * (k * n / (k + n))
        return pa.table([table.column("feature")[:1], table.column("y")[:1], pa.array([total[0]]), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())], names=["feature", "y", "n", "mean", "s"])

    shape = "feature int, y string, n long, mean binary, s binary"
    found = rows.mapInArrow(part, shape).groupBy("feature", "y").applyInArrow(merge, shape).collect()  # one row a feature and a class
    whole = sorted((r for r in found if r["feature"] >= 0), key=lambda r: r["feature"])
    if not whole:
        return 0, np.zeros(0), np.zeros((0, 0)), {}
    by = {r["y"]: (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["s"])) for r in found if r["feature"] < 0}
    return whole[0]["n"], np.frombuffer(whole[0]["mean"]), np.array([np.frombuffer(r["s"]) for r in whole]), by


def f_statistic(n: int, mean: np.ndarray, by: dict) -> np.ndarray:
    """One-way analysis of variance per feature, from the moments of classes."""
    between = sum(k * (m - mean) ** 2 for k, m, _ in by.values()) / max(len(by) - 1, 1)
    within = sum(s for *_, s in by.values()) / max(n - len(by), 1)
    return between / (within + 1e-12)


def mrmr(df: DataFrame, n_select: int = 400, n_max: int | None = None) -> DataFrame:
    """Greedy relevance (F) over redundancy (mean |correlation| with those chosen); score K - rank, the rest 0."""
    rows, mean, moments, by = comoments(_bounded(df, n_max))
    relevance, n = f_statistic(rows, mean, by), len(mean)
    spread = np.sqrt(np.diag(moments)) + 1e-12
    corr = np.abs(moments / np.outer(spread, spread))
    score, left, redundancy, k = np.zeros(n), list(range(n)), np.zeros(n), min(n_select, n)
    for rank in range(k):
        best = max(left, key=lambda j: (relevance[j] / max(redundancy[j] / max(rank, 1), 1e-3) if rank else relevance[j], -j))
        score[best] = k - rank
        left.remove(best)
        redundancy += corr[best]
    return _frame(df, score)


def _encoded(rows: DataFrame) -> DataFrame:
    """``y`` as the place of its label in their order."""
    labels = sorted(r["y"] for r in rows.select("y").distinct().collect())  # one row a class
    return rows.withColumn("y", F.array_position(F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>"), F.col("y")) - 1)


def _vectors(df: DataFrame, columns: list[int] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    f = F.col("features") if columns is None else F.transform(F.array(*map(F.lit, columns)), lambda i: F.get("features", i))
    return df.select("id", F.col("y").cast("double").alias("label"), array_to_vector(F.transform(f, lambda v: v.cast("double"))).alias("features"), *more)


def rfe(df: DataFrame, keep: int = 1, drop: float = 0.1, n_max: int | None = None, steps: int = 300) -> DataFrame:
    """Recursive elimination by the weights of a balanced logistic model; score minus the rank."""
    from pyspark.ml.classification import LogisticRegression

    from .balancing import class_weights

    rows = class_weights(_encoded(_bounded(df, n_max)), "y").cache()
    first = rows.first()
    left = list(range(len(first["features"]) if first else 0))
    rank: dict[int, int] = {}
    while len(left) > keep:
        model = LogisticRegression(maxIter=steps, regParam=0.01, standardization=True, weightCol="weight").fit(_vectors(rows, left, ("weight",)))
        size = np.abs(model.coefficientMatrix.toArray()).sum(axis=0)
        gone = np.argsort(size, kind="stable")[: max(1, min(int(len(left) * drop), len(left) - keep))]
        for i in gone:
            rank[left[i]] = len(left)
        left = [f for k, f in enumerate(left) if k not in set(gone.tolist())]
    for f in left:
        rank[f] = 1
    rows.unpersist()
    return _frame(df, [-rank[i] for i in range(len(rank))])


def shapley(df: DataFrame, trees: int = 50, depth: int = 8, seed: int = 42) -> DataFrame:
    """Mean |Shapley value| of a forest with balanced weights, over all rows and classes."""
    from pyspark.ml.classification import RandomForestClassifier

    from .balancing import class_weights
    from .shapley import exported, mean_shapley

    rows = class_weights(_encoded(_bounded(df, None)), "y").cache()
    if rows.isEmpty():
        return _frame(df, [])
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(_vectors(rows, more=("weight",)))
    out = mean_shapley(df, exported(df.sparkSession, model))
    rows.unpersist()
    return out


def with_shadows(df: DataFrame, seed: int, bucket: int = 4096) -> DataFrame:
    """``features`` followed by a shuffled copy of every feature, from (id, y, features).

    For each feature rows are dealt to buckets of about ``bucket`` by a hash and put in the order of another; each
    takes the value of the next, the last that of the first.  So a shadow holds the values of its feature, no row
    keeps its own, and no task sorts more than a bucket.
    """
    buckets = max(1, -(-df.count() // bucket))
    v = df.select("id", F.posexplode("features").alias("feature", "v"))
    h = F.xxhash64(F.lit(seed), "feature", "id")
    v = v.withColumns({"b": F.pmod(h, F.lit(buckets)), "h": F.xxhash64(F.lit(seed + 1), "feature", "id")})
    w = Window.partitionBy("feature", "b").orderBy("h", "id")
    whole = Window.partitionBy("feature", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy("feature", "b"))
    v = v.withColumn("s", F.when(last, F.first("v").over(whole)).otherwise(F.lead("v").over(w)))
    shadow = v.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "s"))), lambda x: x["s"]).alias("shadow"))
    return df.join(shadow, "id").select("id", "y", F.concat("features", "shadow").alias("features"))


def boruta(df: DataFrame, rounds: int = 60, n_max: int | None = None, trees: int = 100, depth: int = 8, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(feature, score, hits, tried, decision): how often a feature beat the best shadow, and what a fair coin's tail says of it.

    Each round shuffles the features that aren't rejected, fits a forest over them and their shadows, and decides
    those whose hits a fair coin gives with less than ``alpha`` over all features; it ends when none is tentative.
    The score is minus the rank: accepted, tentative, then the rejected by their share of hits.
    """
    from pyspark.ml.classification import RandomForestClassifier

    rows = _encoded(_bounded(df, n_max, seed)).cache()
    first = rows.first()
    n = len(first["features"]) if first else 0
    hits, tried, state = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)  # 0 tentative, 1 accepted, -1 rejected
    for k in range(rounds):
        left = np.flatnonzero(state >= 0)
        if not (state == 0).any():
            break
        part = rows.select("id", "y", F.transform(F.array(*[F.lit(int(i)) for i in left]), lambda i: F.get("features", i)).alias("features"))
        got = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed + k).fit(_vectors(with_shadows(part, seed + 2 * k))).featureImportances.toArray()
        best = got[len(left) :].max()
        hits[left] += got[: len(left)] > best
        tried[left] += 1
        for i in left[state[left] == 0]:
            for sign, won in ((1, hits[i]), (-1, tried[i] - hits[i])):
                if sum(math.comb(int(tried[i]), j) for j in range(int(won), int(tried[i]) + 1)) / 2 ** int(tried[i]) * n <= alpha:
                    state[i] = sign
    rows.unpersist()
    share = hits / np.maximum(tried, 1)
    gone = sorted({share[i] for i in range(n) if state[i] < 0}, reverse=True)
    rank = [1 if s > 0 else 2 if s == 0 else 3 + gone.index(share[i]) for i, s in enumerate(state)]
    names = {1: "accepted", 0: "tentative", -1: "rejected"}
    return df.sparkSession.createDataFrame([(i, -float(rank[i]), int(hits[i]), int(tried[i]), names[int(state[i])]) for i in range(n)], "feature int, score double, hits int, tried int, decision string")


def boruta_decisions(hits: DataFrame, rounds: int, alpha: float = 0.05) -> DataFrame:
    """``hits`` (feature, score) with ``decision``: accepted or rejected where a fair coin's tail, over all features, is below ``alpha``; else tentative."""
    n = hits.count()
    tail = [sum(math.comb(rounds, j) for j in range(k, rounds + 1)) / 2**rounds for k in range(rounds + 1)]  # at least k heads
    least = next((k for k in range(rounds + 1) if tail[k] * n <= alpha), rounds + 1)
    most = max((k for k in range(rounds + 1) if tail[rounds - k] * n <= alpha), default=-1)
    return hits.withColumn("decision", F.when(F.col("score") >= least, "accepted").when(F.col("score") <= most, "rejected").otherwise("tentative"))


def importance(df: DataFrame, trees: int = 50, depth: int = 8, seed: int = 42) -> DataFrame:
    """Impurity importances of a forest: faster than Shapley values, and partial to features with many values."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = _vectors(_encoded(_bounded(df, None)))
    return _frame(df, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows).featureImportances.toArray())


SCORERS = {"variance": variance, "pearson": pearson, "mutual_info": nearest_information, "relieff": relieff, "mrmr": mrmr, "rfe": rfe, "boruta": boruta, "shap": shapley, "importance": importance}
#: Those that vote.
METHODS = ("variance", "pearson", "mutual_info", "relieff", "mrmr", "rfe", "boruta", "shap")


def ensemble(df: DataFrame, methods: tuple[str, ...] = ("variance", "pearson", "mutual_info"), top: float = 0.5, settings: dict[str, dict] | None = None) -> DataFrame:
    """(feature, votes, avg_rank, selection_pct): each method selects the best half; ties by feature.  ``settings``: of a method, by name."""
    scores = None
    for m in methods:
        s = SCORERS[m](df, **(settings or {}).get(m, {})).select("feature", "score", F.lit(m).alias("method"))
        scores = s if scores is None else scores.unionByName(s)
    return votes(scores, top)


def votes(scores: DataFrame, top: float = 0.5) -> DataFrame:
    """Votes from a table (method, feature, score); NaN ranks last."""
    s = scores.withColumn("score", F.when(F.isnan("score") | F.col("score").isNull(), float("-inf")).otherwise(F.round("score", 9)))
    w = Window.partitionBy("method")
    place = F.row_number().over(w.orderBy(F.desc("score"), "feature"))
    s = s.withColumns({"selected": place <= F.bround(F.count(F.lit(1)).over(w) * top), "rank": average_rank(["method"], "score")})
    return s.groupBy("feature").agg(F.count_if("selected").alias("votes"), F.avg("rank").alias("avg_rank"), (100.0 * F.avg(F.col("selected").cast("int"))).alias("selection_pct"))


def consensus(table: DataFrame, threshold: int) -> DataFrame:
    return table.filter(F.col("votes") >= threshold)


def jaccard(selected: DataFrame) -> DataFrame:
    """Similarity of the selections of each pair of methods, from (method, feature, selected); two empty ones are alike."""
    a, b = selected.select(F.col("method").alias("a"), "feature", F.col("selected").alias("x")), selected.select(F.col("method").alias("b"), "feature", F.col("selected").alias("y"))
    both = a.join(b, "feature").groupBy("a", "b").agg(F.count_if(F.col("x") & F.col("y")).alias("i"), F.count_if(F.col("x") | F.col("y")).alias("u"))
    return both.select("a", "b", F.when(F.col("u") == 0, 1.0).otherwise(F.try_divide(F.col("i").cast("double"), F.col("u"))).alias("jaccard"))
