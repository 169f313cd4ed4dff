"""Selectors that need pairs, permutations or neighbours, against plain forms over all rows."""

import numpy as np
import pytest

from tremolo.operators import balancing, selection


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(6)
    y = np.array([0] * 50 + [1] * 30 + [2] * 15)
    x = r.normal(size=(len(y), 5)) * [1, 10, 0.1, 1, 1] + y[:, None] * [0.7, 0.0, 0.05, 0.0, 0.1]
    x[:, 3] = np.round(x[:, 3])  # ties
    x[10] = x[11]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, y int, features array<double>").repartition(4).cache()
    return x, y, df


def scores(df):
    return np.array([r.score for r in df.orderBy("feature").collect()])


def test_relieff_equals_numpy(table, monkeypatch):
    x, y, df = table
    monkeypatch.setattr(balancing, "BLOCK", 16)
    span, k = np.ptp(x, axis=0) + 1e-12, 4
    want, share = np.zeros(5), {c: (y == c).mean() for c in range(3)}
    for i in range(len(x)):
        gap = np.abs(x / span - x[i] / span)
        far = gap.sum(axis=1)
        far[i] = np.inf
        for c, p in share.items():
            at = np.flatnonzero((y == c) & np.isfinite(far))
            at = at[np.argsort(far[at], kind="stable")[:k]]
            want += gap[at].mean(axis=0) * (-1 if c == y[i] else p / (1 - share[y[i]]))
    got = scores(selection.relieff(df, k))
    assert np.allclose(got, want / len(x)) and got.argmax() in (0, 2)


def test_comoments_and_mrmr_equal_numpy(table):
    x, y, df = table
    n, mean, moments, by = selection.comoments(df)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(moments, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
    assert all(np.allclose(by[str(c)][2], ((x[y == c] - x[y == c].mean(axis=0)) ** 2).sum(axis=0)) and by[str(c)][0] == (y == c).sum() for c in range(3))
    f = selection.f_statistic(n, mean, by)
    between = sum((y == c).sum() * (x[y == c].mean(axis=0) - x.mean(axis=0)) ** 2 for c in range(3)) / 2
    within = sum(((x[y == c] - x[y == c].mean(axis=0)) ** 2).sum(axis=0) for c in range(3)) / (len(y) - 3)
    assert np.allclose(f, between / (within + 1e-12))
    corr, chosen = np.abs(np.corrcoef(x.T)), [int(f.argmax())]
    while len(chosen) < 3:
        left = [j for j in range(5) if j not in chosen]
        chosen.append(max(left, key=lambda j: f[j] / max(corr[j, chosen].mean(), 1e-3)))
    got = scores(selection.mrmr(df, n_select=3))
    assert [got[j] for j in chosen] == [3, 2, 1] and sorted(got)[:2] == [0, 0]


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, y int, features array<double>")
    assert selection.mrmr(none).count() == 0 and selection.relieff(none).count() == 0


def test_shadows_keep_the_values_of_each_feature(table):
    x, y, df = table
    for bucket in (4096, 10):
        rows = selection.with_shadows(df, 7, bucket).orderBy("id").collect()
        both = np.array([r.features for r in rows])
        assert len(rows) == len(x) and [r.y for r in rows] == y.tolist() and (both[:, :5] == x).all()
        assert (np.sort(both[:, 5:], axis=0) == np.sort(x, axis=0)).all()
        assert (both[:, 5] == x[:, 0]).mean() < 0.1 and abs(np.corrcoef(both[:, 5], both[:, 6])[0, 1]) < 0.3
        again = selection.with_shadows(df.repartition(2), 7, bucket).orderBy("id").collect()
        assert rows == again


def test_boruta_finds_what_matters_and_stops(spark):
    r = np.random.default_rng(1)
    y = np.arange(300) % 2
    x = r.normal(size=(300, 4))
    x[:, 1] += 3 * y
    df = spark.createDataFrame([(i, f"c{c}", v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, y string, features array<double>")
    got = {r.feature: r for r in selection.boruta(df, rounds=30, trees=20).collect()}
    assert got[1].decision == "accepted" and got[1].score == -1 and got[1].hits == got[1].tried
    assert sum(got[f].decision == "rejected" for f in (0, 2, 3)) >= 2 and min(got[f].tried for f in (0, 2, 3)) < 30


@pytest.mark.parametrize("sized", [1 << 16, 9])
def test_information_equals_plain_loops(table, spark, monkeypatch, sized):
    """All rows, ties included, over many ranges; nulls and classes of one row apart."""
    from tremolo.operators import information

    monkeypatch.setattr(information, "RANGE", sized)
    x, y, df = table
    more = spark.createDataFrame([(1000, 9, [0.0] * 5), (1001, 1, [None, float("nan"), 0.0, 0.0, 100.0])], "id long, y int, features array<double>")
    got = scores(selection.nearest_information(df.unionByName(more), k=3))
    x, y = np.vstack([x, [np.nan, np.nan, 0.0, 0.0, 100.0]]), np.append(y, 1)
    psi = lambda n: -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))
    for f in range(5):
        on = np.flatnonzero(~np.isnan(x[:, f]))
        terms = []
        for i in on:
            mine = sorted(abs(x[j, f] - x[i, f]) for j in on if y[j] == y[i] and j != i)
            d = mine[2] * (1 - 1e-9)
            terms.append(psi(3) - psi(len(mine) + 1) - psi(sum(x[i, f] - d <= x[j, f] <= x[i, f] + d for j in on)))
        assert abs(got[f] - max(0, psi(len(on)) + np.mean(terms))) < 1e-9


def test_information_of_small_classes(spark):
    df = spark.createDataFrame([(i, c, [v]) for i, (c, v) in enumerate([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 7.0), ("c", 3.0)])], "id long, y string, features array<double>")
    psi = lambda n: -0.5772156649015329 + sum(1 / j for j in range(1, n))
    terms = [psi(2) - psi(3) - psi(2)] * 2 + [psi(2) - psi(3) - psi(1)] + [psi(1) - psi(2) - psi(1)] * 2
    assert abs(scores(selection.nearest_information(df, 3))[0] - max(0, psi(5) + np.mean(terms))) < 1e-9


def test_rfe_takes_any_labels(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, "ab"[i % 2], [float(r.normal() + 4 * (i % 2)), float(r.normal())]) for i in range(80)], "id long, y string, features array<double>")
    assert scores(selection.rfe(df)).tolist() == [-1.0, -2.0]


@pytest.mark.parametrize("within", [False, True])
def test_no_pair_of_blocks_is_shuffled(table, spark, monkeypatch, within):
    """Blocks are dealt out once and meet in tasks that read them from there: a join by block shuffled each as often as it met another."""
    *_, df = table
    monkeypatch.setattr(balancing, "BLOCK", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = balancing.neighbours(df, df, 3, within_class=within)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("place", [0.0, 1e7, 1e20])
def test_neighbours_far_from_zero(spark, monkeypatch, metric, place):
    """Rough distances only rule out rows: far from zero, where they say little, the exact ones decide."""
    monkeypatch.setattr(balancing, "BLOCK", 16)
    x = place + np.random.default_rng(2).integers(0, 4, (60, 3)) * (1.0 if place < 1e10 else 1e16)  # ties, and equal rows
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, y int, features array<double>").repartition(3)
    got = {r.id: [n.id for n in r.near] for r in balancing.neighbours(df, df, 5, metric=metric).collect()}
    for i in range(len(x)):
        gap = x - x[i]
        far = (gap**2 if metric == "euclidean" else np.abs(gap)).sum(axis=1)
        assert got[i] == [int(j) for j in np.lexsort((np.arange(60), far)) if j != i][:5]
