"""Models by name, their importances, AUC and timings, the probe of groups, and resampled windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.functions import dsp
from tremolo.operators import extraction, models


@pytest.fixture(scope="module")
def table(spark):
    """Feature 2 tells the classes apart; feature 0 tells the groups of class b apart."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(240):
        y, g = "ab"[i % 2], (i // 2) % 3
        x = r.normal(size=4)
        x[2] += 4 * (i % 2)
        x[0] += 5 * g * (i % 2)
        rows.append((i, y, x.tolist(), g, "test" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "id long, y string, features array<double>, g int, split string").cache()


@pytest.mark.parametrize(("name", "settings"), [("leafwise", {"rounds": 4, "rate": 0.3}), ("regularised", {"rounds": 4, "rate": 0.3}), ("histogram", {"rounds": 4, "rate": 0.3}), ("extra_trees", {"trees": 10})])
def test_tree_models_by_name_and_strategy(table, name, settings):
    train, test = (table.filter(F.col("split") == s).select("id", "y", "features") for s in ("train", "test"))
    for strategy in ("class_weight", "undersample"):
        pred, _ = models.fit_predict(train, test, name, strategy, **settings)
        rows = pred.collect()
        assert len(rows) == test.count() and np.mean([r.y_true == r.y_pred for r in rows]) > 0.9
    model, labels = models.fit(train, name, **settings)
    got = models.importances(model, labels, test).orderBy("feature").collect()
    assert max(got, key=lambda r: r.importance).feature == 2 and {r.kind for r in got} == {"native"}


@pytest.mark.parametrize(("name", "kind"), [("tree", "native"), ("logistic", "coefficients"), ("perceptron", "permutation")])
def test_importances(table, name, kind):
    train, test = (table.filter(F.col("split") == s).select("id", "y", "features") for s in ("train", "test"))
    model, labels = models.fit(train, name)
    got = models.importances(model, labels, test).collect()
    assert len(got) == 4 and {r.kind for r in got} == {kind} and max(got, key=lambda r: r.importance).feature == 2


def test_permutation_equals_a_plain_one(table):
    """Each feature's loss, with the same shuffled values put in one by one."""
    from tremolo.operators.selection import with_shadows

    rows = table.select("id", "y", "features")
    model, labels = models.fit(rows, "tree")
    got = {r.feature: r.importance for r in models.permutation_importances(model, labels, rows, seed=3).collect()}
    base = [r.y_true == r.y_pred for r in models.predict(model, labels, rows).collect()]
    for f in range(4):
        mixed = with_shadows(rows, 3).withColumn("features", F.transform(F.slice("features", 1, 4), lambda v, i: F.when(i == f, F.get("features", i + 4)).otherwise(v)))
        worse = [r.y_true == r.y_pred for r in models.predict(model, labels, mixed).collect()]
        assert abs(got[f] - (np.mean(base) - np.mean(worse))) < 1e-12


def test_assess_has_auc_and_timings(table):
    train, test = (table.filter(F.col("split") == s).select("id", "y", "features") for s in ("train", "test"))
    model, labels = models.fit(train, "logistic")
    r = models.assess(model, labels, test).first()
    pred = models.predict(model, labels, test).collect()
    for k, label in enumerate(labels):
        pos, neg = ([x.proba[k] for x in pred if (x.y_true == label) == p] for p in (True, False))
        assert abs(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) - r.auc_ovr_macro) < 1e-9  # two classes: the same for both
    assert r.rows == 48 and r.predict_seconds > 0 and r.accuracy > 0.9


def test_probe_finds_the_groups(table):
    got = {(r["class"], r.domain): r for r in models.probe(table, "g", {"first": [0], "rest": [1, 2, 3], "all": [0, 1, 2, 3]}, least_test=20).collect()}
    assert len(got) == 6 and all(r.n_groups == 3 for r in got.values())
    assert got["b", "first"].above_chance_pp > 30 and got["b", "all"].above_chance_pp > 30
    assert max(got["b", "rest"].above_chance_pp, got["a", "first"].above_chance_pp, got["a", "all"].above_chance_pp) < 30
    assert abs(got["a", "all"].accuracy - got["a", "all"].majority_chance - got["a", "all"].above_chance_pp) < 1e-9
    assert models.probe(table, "g", {"all": [0]}, least_test=1000).count() == 0


def test_resampling_keeps_low_tones_and_drops_high_ones():
    t = np.arange(1000) / 1000.0
    x = np.stack([np.sin(2 * np.pi * 50 * t), np.sin(2 * np.pi * 450 * t), np.full(1000, 3.0)])
    for up, down in ((4, 5), (1, 2), (5, 4), (3, 1)):
        y = dsp.resample(x, up, down)
        at = np.arange(y.shape[1]) / (1000.0 * up / down)
        inner = slice(100, -100)
        assert y.shape[1] == 1000 * up // down and np.abs(y[0][inner] - np.sin(2 * np.pi * 50 * at)[inner]).max() < 1e-4 and np.allclose(y[2], 3)
        if up < down:
            assert np.abs(y[1][inner]).max() < 1e-3  # above the new Nyquist frequency
        else:
            assert np.abs(y[1][inner]).max() > 0.7
    assert dsp.resample(x, 7, 7) is x


def test_resampled_windows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3, 2, 128))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, patch array<array<double>>")
    got = {row.sample_id: np.array(row.patch) for row in extraction.resampled(df, 4, 5).collect()}
    assert all(np.allclose(got[i], dsp.resample(x[i], 4, 5)) and got[i].shape == (2, 103) for i in range(3))


def test_votes_over_all_eight(table):
    """Selections, ranks and votes from the eight scores, against plain counting."""
    from tremolo.operators import selection

    few = {"boruta": lambda d: selection.boruta(d, rounds=6, trees=10), "shap": lambda d: selection.shapley(d, trees=5)}
    rows = table.select("id", "y", "features").cache()
    scores = {m: {r.feature: r.score for r in few.get(m, f)(rows).collect()} for m in selection.METHODS for f in [selection.SCORERS[m]]}
    long = rows.sparkSession.createDataFrame([(m, f, float(s)) for m, v in scores.items() for f, s in v.items()], "method string, feature int, score double")
    got = {r.feature: r for r in selection.votes(long).collect()}
    for f in range(4):
        won = [sum((-round(scores[m][g], 9), g) < (-round(scores[m][f], 9), f) for g in range(4)) < 2 for m in scores]
        rank = [np.mean([sum(round(v, 9) > round(scores[m][f], 9) for v in scores[m].values()) + 1, sum(round(v, 9) >= round(scores[m][f], 9) for v in scores[m].values())]) for m in scores]
        assert got[f].votes == sum(won) and abs(got[f].avg_rank - np.mean(rank)) < 1e-9 and abs(got[f].selection_pct - 100 * np.mean(won)) < 1e-9
    assert len(scores) == 8 and got[2].votes >= 7 and min(got.values(), key=lambda r: r.avg_rank).feature == 2
