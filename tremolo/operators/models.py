"""Classifiers over (id, y, features): MLlib estimators and histogram trees, one fit per model and strategy, scored by SQL aggregates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation, trees
from .balancing import SAMPLERS
from .splits import grouped_folds


def build(name: str, seed: int = 42, n_features: int = 0, n_classes: int = 0):
    """An unfitted estimator by name."""
    common = {"featuresCol": "vector", "labelCol": "label"}
    weighted = common | {"weightCol": "weight"}
    if name == "logistic":
        return LogisticRegression(maxIter=100, family="multinomial", **weighted)
    if name == "tree":
        return DecisionTreeClassifier(maxDepth=15, seed=seed, **weighted)
    if name == "forest":
        return RandomForestClassifier(numTrees=60, maxDepth=12, seed=seed, **weighted)
    if name == "boosting":
        return OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, seed=seed, **common), **weighted)
    if name == "perceptron":
        return MultilayerPerceptronClassifier(layers=[n_features, 64, n_classes], maxIter=100, seed=seed, **common)
    raise ValueError(f"unknown model {name}")


#: Models of ``trees``: (training rows, seed, settings of their growth) -> Forest.
TREES = {
    "leafwise": lambda rows, seed, **more: trees.boost(rows, replace(trees.LEAFWISE, seed=seed, **more)),
    "regularised": lambda rows, seed, **more: trees.boost(rows, replace(trees.REGULARISED, seed=seed, **more)),
    "histogram": lambda rows, seed, **more: trees.boost(rows, replace(trees.HISTOGRAM, seed=seed, **more)),
    "extra_trees": lambda rows, seed, **more: trees.extra_trees(rows, seed=seed, **more),
}
MODELS = ("leafwise", "regularised", "histogram", "forest", "extra_trees", "logistic", "tree", "boosting", "perceptron")


def fit(train: DataFrame, name: str, strategy: str = "none", seed: int = 42, **settings):
    """(model, labels): scaler and classifier fitted on the balanced training rows; ``settings`` go to models of ``TREES``."""
    rows = SAMPLERS[strategy](train).cache()
    try:
        return _fit(rows, name, seed, **settings)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, name: str, seed: int, **settings):
    """As ``fit``, over rows that are balanced already."""
    if "weight" in rows.columns and name == "perceptron":
        raise ValueError("a perceptron takes no weights: balance its rows by sampling")
    if name in TREES:
        model = TREES[name](rows, seed, **settings)
        return model, model.labels
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn("y", F.col("y").cast("string")).withColumn("raw", array_to_vector(F.col("features").cast("array<double>")))
    index = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    n = len(rows.first()["features"])
    stages = [index, StandardScaler(inputCol="raw", outputCol="vector", withMean=True, withStd=True), build(name, seed, n, len(index.labels))]
    return Pipeline(stages=stages).fit(rows), index.labels


def predict(model, labels: list[str], df: DataFrame) -> DataFrame:
    """(id, y_true, y_pred, proba) with names for labels; proba is null where a model has none."""
    if isinstance(model, trees.Forest):
        return model.predict(df)
    rows = df.withColumn("y", F.col("y").cast("string")).withColumn("raw", array_to_vector(F.col("features").cast("array<double>")))
    out = model.transform(rows)
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1)
    proba = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    return out.select("id", F.col("y").alias("y_true"), name.alias("y_pred"), proba.alias("proba"))


def fit_predict(train: DataFrame, test: DataFrame, name: str, strategy: str = "none", seed: int = 42, **settings) -> tuple[DataFrame, float]:
    began = time.time()
    model, labels = fit(train, name, strategy, seed, **settings)
    took = time.time() - began
    return predict(model, labels, test), took


def auc(pred: DataFrame, labels: list[str]) -> DataFrame:
    """One row: the macro one-versus-rest AUC of predictions with ``proba``; null without probabilities or without a class."""
    each = pred.filter("proba is not null").select(F.col("id").alias("sample"), "y_true", F.posexplode(F.slice("proba", 1, len(labels))).alias("k", "score"))
    return evaluation.auc_ovr(each.withColumn("cls", F.element_at(F.array(*map(F.lit, labels)), F.col("k") + 1)))


def assess(model, labels: list[str], df: DataFrame) -> DataFrame:
    """One row: metrics, AUC, rows, and the seconds that predicting them took."""
    began = time.time()
    pred = predict(model, labels, df).cache()
    n = pred.count()
    took = time.time() - began
    row = evaluation.scores(pred).crossJoin(auc(pred, labels)).withColumns({"rows": F.lit(n), "predict_seconds": F.lit(took)})  # a row and a row
    out = df.sparkSession.createDataFrame(row.collect(), row.schema)
    pred.unpersist()
    return out


def permutation_importances(model, labels: list[str], df: DataFrame, seed: int = 42) -> DataFrame:
    """(feature, importance): accuracy lost when a feature's values are shuffled among the rows; all features in one pass."""
    from .selection import with_shadows

    rows = df.select(F.col("id").cast("long").alias("id"), F.col("y").cast("string").alias("y"), F.col("features").cast("array<double>").alias("features"))
    n = len(rows.first()["features"])
    both = with_shadows(rows, seed)
    each = both.withColumn("f", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))  # -1: as it is
    mixed = F.transform(F.slice("features", 1, n), lambda v, i: F.when(i == F.col("f"), F.get("features", i + n)).otherwise(v))
    pred = predict(model, labels, each.select((F.col("id") * (n + 1) + F.col("f") + 1).alias("id"), "y", mixed.alias("features")))
    right = pred.groupBy((F.pmod("id", F.lit(n + 1)) - 1).cast("int").alias("feature")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a"))
    base = right.filter("feature < 0").select(F.col("a").alias("base"))
    return right.filter("feature >= 0").crossJoin(base).select("feature", (F.col("base") - F.col("a")).alias("importance"))  # times one row


def importances(model, labels: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance, kind): what the model states, else mean |coefficient|, else by permutation over ``df``."""
    last = model if isinstance(model, trees.Forest) else model.stages[-1]
    if isinstance(model, trees.Forest):
        found, kind = model.importances(), "native"
    elif hasattr(last, "featureImportances"):
        found, kind = last.featureImportances.toArray(), "native"
    elif hasattr(last, "coefficientMatrix"):
        found, kind = np.abs(last.coefficientMatrix.toArray()).mean(axis=0), "coefficients"
    else:
        return permutation_importances(model, labels, df).withColumn("kind", F.lit("permutation"))
    return df.sparkSession.createDataFrame([(i, float(v), kind) for i, v in enumerate(found)], "feature int, importance double, kind string")


def probe(df: DataFrame, group: str, domains: Mapping[str, list[int]], name: str = "tree", least_test: int = 30, **settings) -> DataFrame:
    """(class, domain, n_groups, majority_chance, accuracy, above_chance_pp): how well a domain tells a class's groups apart.

    ``df``: id, y, features, ``group`` and split.  A class counts if its training rows and its test rows have two
    groups or more and there are ``least_test`` of the latter.
    """
    in_split = lambda s, c: F.when(F.col("split") == s, c)
    known = df.groupBy(F.col("y").cast("string").alias("class")).agg(
        F.countDistinct(group).alias("n_groups"), F.countDistinct(in_split("train", F.col(group))).alias("tr"), F.countDistinct(in_split("test", F.col(group))).alias("te"),
        F.count(in_split("test", F.lit(1))).alias("n")
    )
    kept = known.filter((F.col("tr") >= 2) & (F.col("te") >= 2) & (F.col("n") >= least_test)).orderBy("class").collect()  # one row a class
    out = []
    for r in kept:
        mine = df.filter(F.col("y").cast("string") == r["class"]).select("id", F.col(group).alias("y"), "features", "split").cache()
        test = mine.filter("split = 'test'")
        n = test.groupBy("y").count().agg((F.max("count") / F.sum("count"))).first()[0]
        for domain, columns in domains.items():
            pick = F.array(*[F.lit(c) for c in columns])
            part = mine.withColumn("features", F.transform(pick, lambda i: F.get("features", i)))
            pred, _ = fit_predict(part.filter("split = 'train'").drop("split"), part.filter("split = 'test'").drop("split"), name, **settings)
            accuracy = pred.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]
            out.append((r["class"], domain, r["n_groups"], 100 * n, 100 * accuracy, 100 * (accuracy - n)))
        mine.unpersist()
    return df.sparkSession.createDataFrame(out, "class string, domain string, n_groups long, majority_chance double, accuracy double, above_chance_pp double")


def benchmark(df: DataFrame, names: Iterable[str], strategies: Iterable[str], seed: int = 42, settings: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(model, strategy, split, metrics, seconds, error) over rows with a ``split``: one fit, scored on val and test.

    The best macro F1 on test first.  A combination that fails is a row with its error and without metrics.
    ``settings``: of a model, by name.
    """
    parts = {s: df.filter(F.col("split") == s).drop("split").cache() for s in ("train", "val", "test")}
    rows, metrics = [], None
    for strategy in strategies:
        balanced = SAMPLERS[strategy](parts["train"]).cache()  # once for all models
        for name in names:
            began = time.time()
            try:
                model, labels = _fit(balanced, name, seed, **(settings or {}).get(name, {}))
                took = time.time() - began
                for s in ("val", "test"):
                    found = evaluation.scores(predict(model, labels, parts[s]))
                    metrics = metrics or found.columns
                    rows.append((name, strategy, s, *map(float, found.first()), took, None))
            except Exception as e:  # one combination must not end the grid: its error is the result
                rows.append((name, strategy, "test", None, time.time() - began, f"{type(e).__name__}: {e}"[:300]))
        balanced.unpersist()
    for p in parts.values():
        p.unpersist()
    metrics = metrics or []
    rows = [r if len(r) == 5 + len(metrics) else (*r[:3], *[None] * len(metrics), *r[-2:]) for r in rows]
    rows.sort(key=lambda r: (r[2] != "test", r[-1] is not None, -(dict(zip(metrics, r[3:-2], strict=True)).get("f1_macro") or 0.0)))
    return df.sparkSession.createDataFrame(rows, "model string, strategy string, split string, " + "".join(f"{m} double, " for m in metrics) + "seconds double, error string")


def folds(df: DataFrame, group: str, n: int = 5) -> DataFrame:
    """``fold``: whole groups, dealt so that every fold's label counts stay near a share of 1 / n."""
    return grouped_folds(df, group, "y", n)


def grouped_cv(df: DataFrame, group: str, name: str, strategy: str = "none", n: int = 5, selector: Callable[[DataFrame], list[int]] | None = None) -> DataFrame:
    """Metrics per fold; ``selector`` picks features on the training part of each fold."""
    rows = folds(df, group, n).cache()
    out, metrics = [], []
    for k in range(n):
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        if selector is not None:
            pick = F.array(*map(F.lit, selector(train)))
            train, test = (d.withColumn("features", F.transform(pick, lambda i: F.get("features", i))) for d in (train, test))
        pred, _ = fit_predict(train.drop("fold"), test.drop("fold"), name, strategy)
        found = evaluation.scores(pred)
        metrics = found.columns
        out.append((k, *(None if v is None else float(v) for v in found.first())))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "fold int" + "".join(f", {m} double" for m in metrics))


def normal_quantiles(source: DataFrame, n_quantiles: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """A map of ``features`` to normal scores, fitted on ``source``: quantiles of each feature, found by Spark, then the normal inverse.

    Between quantiles the map is linear, beyond them it is held at the ends (5.2 standard deviations), and a value
    that a run of equal quantiles holds gets the middle of their ranks.
    """
    long = source.select(F.posexplode("features").alias("feature", "v"))
    grid = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    rows = long.groupBy("feature").agg(F.percentile_approx("v", F.array(*map(F.lit, grid)), F.lit(10 * n_quantiles)).alias("q")).orderBy("feature").collect()  # n_quantiles numbers a feature
    table = np.array([r["q"] for r in rows], float)
    z = np.array([NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in grid])
    sent = source.sparkSession.sparkContext.broadcast((table, z))

    def scores(batches):
        q, to = sent.value
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            out = np.column_stack([(np.interp(x[:, j], q[j], to) + -np.interp(-x[:, j], -q[j][::-1], -to[::-1])) / 2 for j in range(x.shape[1])]) if b.num_rows else x
            at = b.schema.get_field_index("features")
            yield b.set_column(at, "features", pa.array(list(out), pa.list_(pa.float64())))

    def apply(df: DataFrame) -> DataFrame:
        df = df.withColumn("features", F.col("features").cast("array<double>"))
        return df.mapInArrow(scores, df.schema)

    return apply


def transfer(source: DataFrame, target: DataFrame, name: str = "logistic", strategy: str = "none", seed: int = 42) -> DataFrame:
    """Metrics on ``target`` of a model fitted on ``source``; the scaler knows the source only."""
    scale = normal_quantiles(source)
    return evaluation.scores(fit_predict(scale(source), scale(target), name, strategy, seed)[0])


# The published thresholds of the verdict, in percentage points, and what makes a class usable.
CLEAN_COST, CONFOUND_ABOVE, MIXED_ABOVE, LEAST_GROUPS, MOST_CHANCE = 2.0, 15.0, 10.0, 3, 70.0


def verdict(probe: DataFrame, cost: DataFrame, least_groups: int = LEAST_GROUPS, most_chance: float = MOST_CHANCE) -> DataFrame:
    """Per dataset, whether its spatial features carry the event or the place of the recording.

    ``probe``: dataset, class, domain, n_groups, majority_chance, above_chance_pp (how well a domain tells
    recordings apart).  ``cost``: dataset, spatial_cost (points lost without the spatial domain).
    """
    other = ~F.col("domain").isin("spatial", "all")
    usable = probe.filter((F.col("n_groups") >= least_groups) & (F.col("majority_chance") <= most_chance))
    each = usable.groupBy("dataset", "class").agg(F.max(F.when(F.col("domain") == "spatial", F.col("above_chance_pp"))).alias("s"), F.max(F.when(other, F.col("above_chance_pp"))).alias("o"))
    mean = each.groupBy("dataset").agg(F.count(F.lit(1)).alias("usable"), F.avg("s").alias("spatial"), F.avg("o").alias("best_other"), F.avg(F.col("s") - F.col("o")).alias("differential"))
    m = cost.join(mean, "dataset", "left").na.fill(0, ["usable"])
    rule = (
        F.when(F.col("spatial_cost") < CLEAN_COST, "CLEAN").when(F.col("best_other") > CONFOUND_ABOVE, "DATASET-WIDE CONFOUND").when(F.col("differential") > MIXED_ABOVE, "MIXED")
        .when(F.col("differential").isNull(), "UNDETERMINED").otherwise("GENUINE")
    )
    return m.select("dataset", "spatial_cost", "usable", *[F.round(c, 2).alias(c) for c in ("spatial", "best_other", "differential")], rule.alias("verdict"))
