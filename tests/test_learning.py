"""Balancing, selection and models against plain restatements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import balancing, models, selection, splits, statistics


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    y = np.array([0] * 70 + [1] * 25 + [2] * 9 + [3])
    x = r.normal(size=(len(y), 3)) + y[:, None] * 0.7
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, y int, features array<double>").repartition(3).cache()
    return x, y, df


def nearest(x, i, among, k):
    d = ((x[among] - x[i]) ** 2).sum(axis=1)
    order = [j for j in np.array(among)[np.lexsort((among, d))] if j != i]
    return [int(j) for j in order[:k]]


def test_neighbours_are_exact_over_blocks(table, monkeypatch):
    x, y, df = table
    monkeypatch.setattr(balancing, "BLOCK", 8)
    got = {r.id: [n.id for n in r.near] for r in balancing.neighbours(df.filter("y > 0"), df, 4).collect()}
    assert got == {i: nearest(x, i, np.arange(len(y)), 4) for i in np.flatnonzero(y > 0).tolist()}
    got = {r.id: [n.id for n in r.near] for r in balancing.neighbours(df, df, 4, within_class=True).collect()}
    assert got == {i: nearest(x, i, np.flatnonzero(y == y[i]), 4) for i in range(len(y))}


@pytest.mark.parametrize("borderline", [False, True])
def test_smote(table, borderline):
    x, y, df = table
    rows = balancing.smote(df, k=3, borderline=borderline).collect()
    made = [r for r in rows if r.id < 0]
    assert len({r.id for r in rows}) == len(rows)
    sizes = {c: sum(r.y == c for r in rows) for c in range(4)}
    assert sizes == {0: 70, 1: 70, 2: 70, 3: 1}  # a class of one row has no neighbour
    for r in made:
        i = (-r.id) >> 20
        assert y[i] == r.y
        if borderline:
            other = np.mean([y[j] != y[i] for j in nearest(x, i, np.arange(len(y)), 3)])
            assert 0.5 <= other < 1
        v = np.array(r.features)
        ends = [x[j] for j in nearest(x, i, np.flatnonzero(y == y[i]), 3)]
        assert any(np.linalg.norm(v - x[i]) + np.linalg.norm(e - v) - np.linalg.norm(e - x[i]) < 1e-9 for e in ends)


def test_tomek_links(table):
    x, y, df = table
    near = [nearest(x, i, np.arange(len(y)), 1)[0] for i in range(len(y))]
    assert {r.id for r in balancing.tomek_links(df).collect()} == {i for i in range(len(y)) if near[near[i]] == i and y[i] != y[near[i]]}


def test_grouped_folds(spark):
    rows = [(i, f"g{i % 17}", f"c{(i % 17) % 3}") for i in range(1700)]
    got = splits.grouped_folds(spark.createDataFrame(rows, "id long, g string, y string"), "g", "y", 4).collect()
    assert len(got) == 1700 and all(len({r.fold for r in got if r.g == f"g{k}"}) == 1 for k in range(17))
    assert max(sum(r.fold == f for r in got) for f in range(4)) <= 500


def test_information_from_neighbours(table):
    x, y, df = table
    got = [r.score for r in selection.nearest_information(df, k=3).orderBy("feature").collect()]
    psi = lambda n: -0.5772156649015329 + sum(1 / j for j in range(1, n))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    on = np.flatnonzero(y < 3)
    for f in range(3):
        v, terms = z[:, f], []
        for i in on:
            mine = [abs(v[j] - v[i]) for j in on if y[j] == y[i] and j != i]
            d = sorted(mine)[2]
            m = sum(abs(v[j] - v[i]) < d for j in on if j != i) + 1
            terms.append(psi(3) - psi(len(mine) + 1) - psi(m))
        assert abs(got[f] - max(0, psi(len(on)) + np.mean(terms))) < 0.02
    assert np.allclose(selection.digamma(np.array([1.0, 2, 10, 50])), [psi(1), psi(2), psi(10), psi(50)], atol=1e-8)


def test_boruta_decisions(spark):
    hits = spark.createDataFrame([(0, 12.0), (1, 6.0), (2, 0.0)], "feature int, score double")
    assert [r.decision for r in selection.boruta_decisions(hits, 12).orderBy("feature").collect()] == ["accepted", "tentative", "rejected"]


def test_weights_reach_every_model(table):
    _, _, df = table
    two = df.filter("y < 2")
    assert models.fit_predict(two, two, "boosting", "class_weight")[0].filter("y_pred = '1'").count() > 0
    with pytest.raises(ValueError, match="no weights"):
        models.fit(two, "perceptron", "class_weight")


def test_benchmark_keeps_failures(table):
    _, _, df = table
    rows = df.filter("y < 2").withColumn("split", F.when(F.col("id") % 4 == 0, "test").when(F.col("id") % 4 == 1, "val").otherwise("train"))
    got = models.benchmark(rows, ("tree", "perceptron"), ("class_weight",)).collect()
    assert [(r.model, r.split, r.error is None) for r in got] == [("tree", "test", True), ("perceptron", "test", False), ("tree", "val", True)]


def test_quantile_scaler_knows_the_source_only(spark):
    r = np.random.default_rng(1)
    v = np.exp(r.normal(size=3000))
    df = spark.createDataFrame([(i, 0, [float(a), 1.0]) for i, a in enumerate(v)], "id long, y int, features array<double>")
    scale = models.normal_quantiles(df, 200)
    got = np.array([x.features for x in scale(df).orderBy("id").collect()])
    assert abs(got[:, 0].mean()) < 0.05 and abs(got[np.abs(got[:, 0]) < 3, 0].std() - 1) < 0.1 and np.allclose(got[:, 1], 0, atol=1e-9)
    far = scale(spark.createDataFrame([(1, 0, [1e9, 1.0]), (2, 0, [-5.0, 1.0])], "id long, y int, features array<double>")).orderBy("id").collect()
    assert far[0].features[0] > 5 and far[1].features[0] < -5


def test_friedman_and_cliques(spark):
    scores = [("b1", [3.0, 2.0, 1.0]), ("b2", [3.0, 1.0, 2.0]), ("b3", [3.0, 2.0, 1.5]), ("b4", [2.0, 3.0, 1.0])]
    df = spark.createDataFrame([(b, f"m{j}", s) for b, v in scores for j, s in enumerate(v)], "block string, method string, score double")
    f = statistics.friedman(df, "block", "method", "score").first()
    assert (f.n, f.k, f.df1, f.df2) == (4, 3, 2, 6) and [(r.method, r.avg_rank) for r in f.ranking] == [("m0", 1.25), ("m1", 2.0), ("m2", 2.75)]
    assert abs(f.chi2 - 4.5) < 1e-9 and abs(f.p - math.exp(-2.25)) < 1e-9 and abs(f.critical_difference - 2.343 * math.sqrt(3 * 4 / 24)) < 1e-9
    ranking = spark.createDataFrame([("a", 1.0), ("b", 1.8), ("c", 2.6), ("d", 9.0)], "m string, r double")
    assert {x.members for x in statistics.cliques(ranking, "m", "r", 1.0).collect()} == {"a,b", "a,b,c", "b,c", "d"}
