"""Boosted and randomised trees against plain loops over all rows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import trees
from tremolo.operators.trees import HISTOGRAM, LEAFWISE, REGULARISED, Growth, boost, extra_trees


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(8)
    y = np.array([0] * 60 + [1] * 45 + [2] * 30)
    x = r.normal(size=(len(y), 4)) + y[:, None] * [0.8, -0.4, 0.0, 0.2]
    x[r.random(x.shape) < 0.08] = np.nan
    x[:, 2] = r.integers(0, 3, len(y))
    w = r.uniform(0.5, 2, len(y))
    rows = [(i, f"c{c}", [None if np.isnan(a) else float(a) for a in v], float(b)) for i, (c, v, b) in enumerate(zip(y, x, w, strict=True))]
    return x, y, w, spark.createDataFrame(rows, "id long, y string, features array<double>, weight double").repartition(3).cache()


def plain_tree(bins, grad, curve, g: Growth):
    """{path: (feature, bin, missing left)} and the value of each leaf path, by trying every cut of every node."""
    def split(rows):
        whole = grad[rows].sum(), curve[rows].sum()
        best = None
        for to_left in (False, True):
            for f in range(bins.shape[1]):
                if to_left and not (bins[rows, f] == 0).any():
                    continue
                for cut in range(1, bins.max() + 1):
                    left = np.where(bins[rows, f] == 0, to_left, bins[rows, f] <= cut)
                    a = rows[left]
                    b = rows[~left]
                    if len(a) < g.min_rows or len(b) < g.min_rows or curve[a].sum() < g.min_curve or curve[b].sum() < g.min_curve:
                        continue
                    s = lambda q: grad[q].sum() ** 2 / (curve[q].sum() + g.l2)
                    gain = (s(a) + s(b) - whole[0] ** 2 / (whole[1] + g.l2)) / 2 - g.gamma
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, cut, to_left, a, b)
        return best

    leaves, inner = {"": np.arange(len(bins))}, {}
    known = {"": split(leaves[""])}
    while g.leaves is None or len(leaves) < g.leaves:
        able = [p for p in leaves if known[p] and known[p][0] > 0 and len(p) < g.depth]
        if not able:
            break
        for p in able if g.leaves is None else [max(able, key=lambda p: known[p][0])]:
            _, f, cut, to_left, a, b = known[p]
            inner[p] = (f, cut, to_left)
            del leaves[p]
            for q, rows in ((p + "l", a), (p + "r", b)):
                leaves[q], known[q] = rows, split(rows)
    return inner, {p: -g.rate * grad[rows].sum() / (curve[rows].sum() + g.l2) for p, rows in leaves.items()}


def paths(tree):
    inner, leaves = {}, {}

    def walk(n, p):
        if tree.left[n] < 0:
            leaves[p] = tree.value[n]
        else:
            inner[p] = (tree.feature[n], tree.bin[n], tree.missing_left[n])
            walk(tree.left[n], p + "l")
            walk(tree.right[n], p + "r")

    walk(0, "")
    return inner, leaves


def plain_value(inner, leaves, bins):
    out = np.zeros(len(bins))
    for i, b in enumerate(bins):
        p = ""
        while p in inner:
            f, cut, to_left = inner[p]
            p += "l" if (to_left if b[f] == 0 else b[f] <= cut) else "r"
        out[i] = leaves[p]
    return out


@pytest.mark.parametrize("growth", [
    replace(LEAFWISE, rounds=2, leaves=6, min_rows=5, row_share=1.0, column_share=1.0, rate=0.3),
    replace(REGULARISED, rounds=2, depth=3, row_share=1.0, column_share=1.0, rate=0.3),
    replace(HISTOGRAM, rounds=2, leaves=5, min_rows=8, rate=0.2, bins=12),
])
def test_trees_equal_plain_ones(table, growth, monkeypatch):
    """Every split and leaf of two rounds over three classes, with weights and missing values."""
    x, y, w, df = table
    monkeypatch.setattr(trees, "CELLS", 400)  # a few nodes a pass
    monkeypatch.setattr(trees, "SETTLE", 1)
    monkeypatch.setattr(trees, "MERGED", 2)
    model = boost(df, growth)
    bins = trees.binned(x, model.edges)
    assert (bins == 0).sum() == np.isnan(x).sum()
    scores = np.tile(model.start, (len(y), 1))
    assert np.allclose(model.start, np.log([w[y == k].sum() / w.sum() for k in range(3)]) if growth.prior else 0)
    for r in range(growth.rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        for k in range(3):
            c = growth.curve if growth.curve is not None else 3 / 2
            want = plain_tree(bins, w * (p[:, k] - (y == k)), w * c * p[:, k] * (1 - p[:, k]), growth)
            got = paths(model.rounds[r][k])
            assert got[0] == want[0] and got[1].keys() == want[1].keys()
            assert all(abs(got[1][q] - want[1][q]) < 1e-9 for q in want[1])
            scores[:, k] += plain_value(*want, bins)
    got = {r.id: r.proba for r in model.predict(df).collect()}
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert np.allclose([got[i] for i in range(len(y))], p, atol=1e-9)


def test_boosters_differ_and_reruns_agree(table):
    _, _, _, df = table
    made = {n: boost(df, replace(g, rounds=3, rate=0.3)) for n, g in (("leaf", LEAFWISE), ("level", REGULARISED), ("hist", HISTOGRAM))}
    proba = {n: np.array([r.proba for r in m.predict(df).orderBy("id").collect()]) for n, m in made.items()}
    assert all(np.allclose(p.sum(axis=1), 1) for p in proba.values())
    assert min(np.abs(proba[a] - proba[b]).max() for a, b in (("leaf", "level"), ("leaf", "hist"), ("level", "hist"))) > 1e-3
    again = boost(df.repartition(5), replace(LEAFWISE, rounds=3, rate=0.3)).predict(df).orderBy("id").collect()
    assert np.allclose([r.proba for r in again], proba["leaf"], atol=1e-9)
    assert made["leaf"].importances().sum() == pytest.approx(1)


def test_row_and_column_shares():
    ids = np.arange(20_000)
    a, b = trees._chosen(ids, 1, 0.8), trees._chosen(ids, 2, 0.8)
    assert abs(a.mean() - 0.8) < 0.02 and abs((a & b).mean() - 0.64) < 0.02


def test_extra_trees_draw_their_thresholds(table):
    """Cuts lie between the node's values, differ between trees and from the best cut; reruns agree."""
    x, y, w, df = table
    model = extra_trees(df, trees=12, depth=4, seed=3)
    same = extra_trees(df.repartition(2), trees=12, depth=4, seed=3)
    assert [paths(t)[0] for (t,) in model.rounds] == [paths(t)[0] for (t,) in same.rounds]
    bins, best = trees.binned(x, model.edges), 0
    roots = set()
    for (t,) in model.rounds:
        inner, leaves = paths(t)
        roots.add(inner[""])

        def walk(p, rows, inner=inner, leaves=leaves):
            if p not in inner:
                share = np.array([w[rows][y[rows] == k].sum() for k in range(3)])
                assert np.allclose(leaves[p], share / share.sum())
                return 0
            f, cut, _ = inner[p]
            left = (bins[rows, f] > 0) & (bins[rows, f] <= cut)  # missing values go right
            assert 0 < left.sum() < len(rows)
            gini = lambda c: (lambda s: s.sum() - (s**2).sum() / s.sum())(np.array([w[rows][left if c else ~left][y[rows][left if c else ~left] == k].sum() for k in range(3)]))
            mine = gini(True) + gini(False)
            others = []
            for c in range(1, bins.max() + 1):
                old, left = left, (bins[rows, f] > 0) & (bins[rows, f] <= c)
                if 0 < left.sum() < len(rows):
                    others.append(gini(True) + gini(False))
                left = old
            n = int(mine > min(others) + 1e-9)
            return n + walk(p + "l", rows[left]) + walk(p + "r", rows[~left])

        best += walk("", np.arange(len(y)))
    assert len(roots) > 6 and best > 10
    pred = model.predict(df).collect()
    assert np.mean([r.y_true == r.y_pred for r in pred]) > 0.6


def test_rows_stay_off_the_driver(table, monkeypatch):
    """What is collected: a row a class, a feature or a node."""
    from pyspark.sql.classic.dataframe import DataFrame

    _, _, _, df = table
    seen, whole = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (seen.append((len(rows), self.columns)), rows)[1])(whole(self)))
    boost(df.drop("weight"), replace(LEAFWISE, rounds=1))
    assert seen and all("id" not in columns and n <= 64 for n, columns in seen)


def test_one_class_and_constant_features(spark):
    df = spark.createDataFrame([(i, "a", [1.0, float("nan")]) for i in range(9)], "id long, y string, features array<double>")
    for model in (boost(df, replace(LEAFWISE, rounds=2)), extra_trees(df, trees=2)):
        assert {r.y_pred for r in model.predict(df).collect()} == {"a"}
    two = df.withColumn("y", F.when(F.col("id") < 6, "a").otherwise("b"))
    assert {r.y_pred for r in boost(two, replace(HISTOGRAM, rounds=2)).predict(two).collect()} == {"a"}
