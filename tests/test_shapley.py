"""Shapley values against their definition over all subsets of features."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier

from tremolo.operators import selection, shapley


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(240, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)
    return x, spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, y int, features array<double>").repartition(3).cache()


def expected(t, row, known, n=0):
    """The prediction of one tree with the features ``known``; the others are averaged by cover."""
    if t.left[n] < 0:
        return t.value[n]
    if t.feature[n] in known:
        return expected(t, row, known, t.left[n] if row[t.feature[n]] <= t.threshold[n] else t.right[n])
    share = t.cover[t.left[n]] / t.cover[n]
    return share * expected(t, row, known, t.left[n]) + (1 - share) * expected(t, row, known, t.right[n])


def by_definition(trees, row, f):
    n = len(row)
    mean = lambda s: np.mean([expected(t, row, set(s)) for t in trees], axis=0)
    others = [j for j in range(n) if j != f]
    return sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (mean((*s, f)) - mean(s)) for k in range(n) for s in combinations(others, k))


@pytest.mark.parametrize("model", [lambda: RandomForestClassifier(numTrees=4, maxDepth=5, seed=2), lambda: DecisionTreeClassifier(maxDepth=7, seed=2)])
def test_equals_the_definition(spark, table, model, monkeypatch):
    x, df = table
    monkeypatch.setattr(shapley, "LEAVES", 5)
    fitted = model().fit(selection._vectors(df))
    trees = shapley.exported(spark, fitted)
    leaves = shapley.leaves(trees)
    got, base = shapley.shapley_values(leaves, x), shapley.base_value(leaves)
    from pyspark.ml.functions import vector_to_array

    proba = np.array([r["p"] for r in fitted.transform(selection._vectors(df)).orderBy("id").select(vector_to_array("probability").alias("p")).collect()])
    assert np.allclose(got.sum(axis=1) + base, proba, atol=1e-9)  # additivity
    for i in (0, 7, 100, 239):
        for f in range(6):
            assert np.allclose(got[i, f], by_definition(trees, x[i], f), atol=1e-9)


def test_missing_values_go_right(spark, table):
    x, df = table
    trees = shapley.exported(spark, DecisionTreeClassifier(maxDepth=4, seed=2).fit(selection._vectors(df)))
    leaves = shapley.leaves(trees)
    row = x[:1].copy()
    row[0, 0] = np.nan
    assert np.allclose(shapley.shapley_values(leaves, row).sum(axis=1) + shapley.base_value(leaves), expected(trees[0], np.where(np.isnan(row[0]), np.inf, row[0]), set(range(6))))


def test_mean_over_all_rows(spark, table):
    x, df = table
    trees = shapley.exported(spark, RandomForestClassifier(numTrees=3, maxDepth=4, seed=1).fit(selection._vectors(df)))
    got = {r.feature: r.score for r in shapley.mean_shapley(df, trees).collect()}
    want = np.abs(shapley.shapley_values(shapley.leaves(trees), x)).mean(axis=(0, 2))
    assert np.allclose([got[f] for f in range(6)], want)
    assert want.argmax() == 0


def test_selector_ranks_what_matters(table):
    _, df = table
    got = {r.feature: r.score for r in selection.SCORERS["shap"](df).collect()}
    assert set(got) == set(range(6)) and max(got, key=got.get) == 0 and got[3] > max(got[4], got[5])
