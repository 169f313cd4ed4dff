"""Pairwise ranking: the fit against plain loops over pairs, held-out accuracy, and awkward rows."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tremolo.llm.quality_ranker as quality
import tremolo.llm.words as words
from tremolo.llm import catalogue
from tremolo.llm.quality_ranker import THRESHOLD, Ranker, fit_pairs, quantile, rank_quality

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=240):
    """Prose, and prose of shouts and marks."""
    r = random.Random(7)
    for i in range(n):
        text = brute.prose(r, 40)
        good = r.random() < 0.7
        yield i, text if good else " ".join(w.upper() + r.choice(["!!", "$$$", ""]) for w in text.split(" ")), int(good)


def test_fit_minimises_the_loss_of_all_pairs():
    r = np.random.default_rng(3)
    better, worse = r.normal(0.3, 1, (40, 6)).astype(np.float32), r.normal(0, 1, (25, 6)).astype(np.float32)
    w, ridge = fit_pairs(better, worse, 0.01), 0.01

    def loss(w):
        return sum(np.log1p(np.exp(-(w @ (b - c)))) for b in better.astype(float) for c in worse.astype(float)) / (len(better) * len(worse)) + ridge / 2 * w @ w

    best = loss(w)
    for j in range(6):
        for step in (-1e-3, 1e-3):
            assert loss(w + step * np.eye(6)[j]) > best - 1e-9
    assert best < loss(np.zeros(6)) - 0.01


def test_quantile():
    u, w = np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4)
    assert quantile(u, w, 0.5) == 2.5 and quantile(u, w, 0.25) == 1.5 and quantile(u, w, 1.0) == 4.0
    assert quantile(u, np.array([1.0, 8.0, 1.0, 1.0]), 0.5) == 1.5


def test_the_score_is_the_threshold_at_the_threshold():
    m = Ranker(np.ones(1), 0.1, 3.0)
    u, p = m.scores(np.array([[0.1], [np.nextafter(0.1, 0)], [5.0], [-50.0]]))
    assert p[0] == THRESHOLD and p[1] < THRESHOLD and p[2] > 0.99 and 0 <= p[3] < 0.01


def test_held_out(spark):
    rows = list(corpus())
    docs = brute.table(spark, [(i, t, None, None, 1) for i, t, _ in rows])
    got = {r.doc_id: r.score for r in rank_quality(docs, labels(spark, [(i, q, 0) for i, _, q in rows if i % 3]), F.col("doc_id") % 4 != 2).collect()}
    held = [(got[i] >= THRESHOLD, q) for i, _, q in rows if i % 4 == 2 or i % 3 == 0]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95


def test_held_out_on_the_tables(spark):
    got = catalogue.queries()["op12_quality_ranking"](spark, SF).collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_held_out_labels_change_nothing(spark):
    rows = list(corpus(120))
    docs = brute.table(spark, [(i, t, None, None, 1) for i, t, _ in rows])
    one, two = ({r.doc_id: r.score for r in rank_quality(docs.repartition(n), labels(spark, [(i, q if i % 4 != 2 else flip(q), 0) for i, _, q in rows]), F.col("doc_id") % 4 != 2).collect()} for n, flip in ((2, lambda q: q), (5, lambda q: 1 - q)))
    assert one == two


def test_awkward_rows(spark):
    """Null, empty and very long texts, repeated ids, contradicting and unusable labels, clashing columns."""
    docs = brute.table(spark)
    known = labels(spark, [(10, 1, 0), (10, 0, 0), (11, 1, 0), (12, 1, None), (400, 0, 0), (401, 0, 1), (409, 0, 0), (406, 0, 0), (None, 1, 0), (13, None, 0), (14, 7, 0), (99999, 1, 0)])
    got = rank_quality(docs, known)
    assert [c for c in got.columns if c not in ("utility", "score")] == [c for c in docs.columns if c != "score"]
    rows = got.collect()
    assert len(rows) == len(brute.documents()) and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if not r.text}
    assert len(same) == 1  # null as empty


@pytest.mark.parametrize(("known", "score"), [([], 0.5), ([(11, 1, 0)], 1.0), ([(11, 0, 0), (12, 0, 0)], 0.0)])
def test_no_preference(spark, known, score):
    assert {r.score for r in rank_quality(brute.table(spark), labels(spark, known)).collect()} == {score}


def test_no_rows(spark):
    assert rank_quality(brute.table(spark, []), labels(spark, [(1, 1, 0)])).count() == 0


def test_bounded_sample(spark):
    rows = list(corpus(200))
    docs = brute.table(spark, [(i, t, None, None, 1) for i, t, _ in rows])
    got = rank_quality(docs, labels(spark, [(i, q, 0) for i, _, q in rows]), max_sample=40).collect()
    want = {i: q for i, _, q in rows}
    assert np.mean([(r.score >= THRESHOLD) == want[r.doc_id] for r in got]) > 0.9


def test_pieces(monkeypatch):
    r = np.random.default_rng(2)
    column = pa.array([*("".join(r.choice(list("abc def GHI é È\t\n'sß! "), n)) for n in (0, 5, 3000, 700, 9000)), "z" * 4000 + " end", " " * 3000, None])
    whole = np.concatenate([x for _, x in quality._features(column)])
    assert len(whole) == len(column) and (whole[0] == whole[-1]).all() and not whole[0].any()
    for step in (64, 500):
        words._POWERS.clear()
        monkeypatch.setattr(words, "STEP_BYTES", step)
        monkeypatch.setattr(quality, "STEP_BYTES", step)
        assert np.allclose(np.concatenate([x for _, x in quality._features(column)]), whole)
    words._POWERS.clear()


def test_all_labelled_rows_count(spark):
    """Weights, threshold and slope don't depend on the rows that the fit starts from: they come from all."""
    rows = list(corpus(200))
    docs, known = brute.table(spark, [(i, t, None, None, 1) for i, t, _ in rows]).repartition(3), labels(spark, [(i, q, 0) for i, _, q in rows])
    whole, started = (quality.fit(docs, known, F.lit(True), n) for n in (10_000, 40))
    x = np.concatenate([f for _, f in quality._features(pa.array([t for _, t, _ in rows]))]).astype(float)
    good = np.array([q for _, _, q in rows])

    def loss(m):
        u, w = x @ m.weights, m.weights.copy()
        w[quality.DIMENSIONS :] *= 4 * x[:, quality.DIMENSIONS :].std(axis=0)
        return np.logaddexp(0, -np.subtract.outer(u[good == 1], u[good == 0])).mean() + quality.RIDGE / 2 * w @ w

    assert abs(loss(whole) - loss(started)) < 2 * quality.EXCESS
    u = x @ started.weights
    assert abs(quantile(u, np.ones(len(u)), 1 - good.mean()) - started.threshold) < 1e-9
    assert abs(whole.slope - started.slope) < 0.1 and np.abs(whole.scores(x)[1] - started.scores(x)[1]).max() < 0.02


def test_sums_over_pairs_on_a_grid():
    r = np.random.default_rng(5)
    a, b = r.normal(0, 9, 300), r.normal(1, 3, 200)
    lo, weights = quality._on_grid(a, quality.GRID)
    points = (lo + np.arange(len(weights))) * quality.GRID
    got, want = np.logaddexp(0, -np.subtract.outer(b, points)) @ weights, np.logaddexp(0, -np.subtract.outer(b, a)).sum(axis=1)
    assert np.abs(got - want).max() / len(a) < 1e-8
    assert np.allclose(quality._off_grid(a, lo, np.tanh(points / 4), quality.GRID), np.tanh(a / 4), atol=1e-8)


def test_smallest(spark):
    u = [3.0, -1.0, 3.0, 3.0, 7.5, 1e-9, 2e9, -5.0]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    assert [quality._smallest(df, k) for k in range(1, 9)] == sorted(u)
