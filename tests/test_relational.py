"""Splits, audits, metrics and samplers on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tremolo.operators import audits, balancing, evaluation, extraction, models, selection, splits, statistics


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(1)
    rows = [(f"w{i}", f"r{i % 3}", r.randrange(300) if i % 3 else r.randrange(60), f"c{r.randrange(4)}") for i in range(900)]
    return spark.createDataFrame(rows, "sample_id string, recording_id string, block int, label string").cache()


def test_segments_never_cut_a_block(frame):
    s = splits.segments(frame)
    assert s.groupBy("recording_id", "block").agg(F.countDistinct("segment").alias("n")).filter("n > 1").isEmpty()
    assert s.agg(F.min("segment"), F.max("segment")).first() == (0, 9)


def test_guard_equals_brute_force(frame):
    s = splits.rotate(splits.segments(frame), F.lit(2))
    rows = [(r.sample_id, r.recording_id, r.block, r.split) for r in s.collect()]
    want = {a: all(not (r2 == r and s2 != sp and abs(b2 - b) <= 7) for _, r2, b2, s2 in rows) for a, r, b, sp in rows}
    assert {r.sample_id: r.keep for r in splits.guard(s).collect()} == want


def test_guarded_split_passes_and_random_split_fails(frame):
    good = splits.blocked_split(frame, F.lit(0)).withColumn("g", F.concat_ws("|", "recording_id", F.col("segment").cast("string")))
    card = {r.check: r.status for r in audits.scorecard(good, "g").collect()}
    assert card["no block read by two splits"] == card["groups in one split"] == card["unique sample ids"] == "PASS"
    assert splits.contaminated(good).filter("contaminated").isEmpty()
    bad = splits.random_split(frame, "label", splits.seeded("sample_id"))
    assert not splits.contaminated(bad).filter("contaminated").isEmpty()
    with pytest.raises(ValueError):
        audits.require_empty(audits.shared_blocks(bad), "blocks are shared")


def test_grouped_three_way(frame):
    s = splits.grouped_three_way(frame.withColumn("group", F.concat_ws("-", "recording_id", (F.col("block") % 20).cast("string"))), "group", "label")
    assert audits.group_offenders(s, "group").isEmpty()
    share = {r.split: r["count"] / 900 for r in s.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.05
    with pytest.raises(ValueError):
        splits.grouped_three_way(frame, "recording_id", "label", (0.85, 0.1, 0.05))


def test_samples(frame):
    s = splits.stratified(frame, "label", 100, splits.seeded("sample_id"))
    assert abs(s.count() - 100) <= 4
    assert {r.sample_id for r in s.collect()} == {r.sample_id for r in splits.stratified(frame.repartition(7), "label", 100, splits.seeded("sample_id")).collect()}


def test_metrics_by_hand(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y_true string, y_pred string")
    m = evaluation.scores(p).first()
    assert (m.accuracy, round(m.balanced_accuracy, 6)) == (0.5, 0.5) and abs(m.f1_macro - (2 / 3 + 0.5) / 3) < 1e-9
    assert {(r.y_true, r.y_pred, r.n) for r in evaluation.error_modes(p).collect()} == {("a", "b", 1), ("c", "b", 1)}
    assert evaluation.nar_fnr(p, "b").first() == (0.0, 2 / 3)


def test_auc(spark):
    rows = [(i, c, float(i if c == "x" else -i), "x" if i > 2 else "y") for i in range(5) for c in "xy"]
    d = spark.createDataFrame(rows, "sample int, cls string, score double, y_true string")
    assert evaluation.auc_ovr(d).first()[0] == 1.0
    assert evaluation.auc_ovr(d.filter("y_true = 'x'")).first()[0] is None


def test_friedman_known_answer(spark):
    """Three methods in one order over four blocks: the largest statistic there is."""
    d = spark.createDataFrame([(b, m, float(v + b)) for b in range(4) for v, m in enumerate("abc")], "b int, m string, v double")
    f = statistics.friedman(d, "b", "m", "v").first()
    assert (f.n, f.k, f.chi2, f.iman_davenport) == (4, 3, 8.0, None)
    assert abs(statistics.chi2_sf(8.0, 2) - math.exp(-4)) < 1e-12 and abs(statistics.critical_difference(7, 6) - 3.678) < 1e-3


def labelled(spark):
    r = random.Random(5)
    rows = [(i, i % 5 // 4, [r.gauss(3.0 * (i % 5 // 4), 1), r.gauss(0, 1), r.gauss(0, 1)], i % 7) for i in range(200)]
    return spark.createDataFrame(rows, "id long, y int, features array<double>, group int")


def test_selection_finds_the_feature(spark):
    d = labelled(spark)
    for m in ("pearson", "mutual_info", "relieff", "mrmr", "importance"):
        assert selection.SCORERS[m](d).orderBy(F.desc("score")).first().feature == 0, m
    top = selection.ensemble(d).orderBy(F.desc("votes"), "avg_rank").first()
    assert top.feature == 0 and top.votes == 3


def test_balancing(spark):
    d = labelled(spark)
    sizes = lambda x: {r.y: r["count"] for r in x.groupBy("y").count().collect()}
    assert sizes(balancing.undersample(d)) == {0: 40, 1: 40}
    more = balancing.smote(d)
    assert abs(sizes(more)[1] - 160) <= 20 and sizes(more)[0] == 160
    low, high = (min, max)
    xs = [r.features[0] for r in d.filter("y = 1").collect()]
    assert all(low(xs) <= r.features[0] <= high(xs) for r in more.filter("id < 0").collect())
    w = {r.y: r.weight for r in balancing.class_weights(d).select("y", "weight").distinct().collect()}
    assert w == {0: 200 / 320, 1: 200 / 80}


def test_models(spark):
    d = labelled(spark).withColumn("split", F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 8, "val").otherwise("test"))
    b = models.benchmark(d, ("logistic",), ("none", "class_weight")).collect()
    assert len(b) == 4 and all(r.accuracy > 0.8 for r in b)
    assert models.grouped_cv(d.drop("split"), "group", "tree", n=2, selector=lambda t: [0]).count() == 2


def test_extraction_from_blocks(spark):
    """Windows meet their blocks; the ends of the cable move the patch inwards; features come in four arrays."""
    blocks = spark.createDataFrame([("r", b, c, [float(b * 100 + c)] * 16) for b in range(6) for c in range(5)], "recording_id string, block int, locus int, samples array<double>")
    man = spark.createDataFrame([("a", "r", 0, 0, 5), ("b", "r", 2, 4, 5), ("late", "r", 4, 2, 5)], "sample_id string, recording_id string, block int, locus int, n_loci int")
    p = {r.sample_id: r.patch for r in extraction.patches(man, blocks, 3).collect()}
    assert set(p) == {"a", "b"} and [row[0] for row in p["a"]] == [0.0, 1.0, 2.0] and [row[-1] for row in p["b"]] == [502.0, 503.0, 504.0]
    e = extraction.extract(extraction.patches(man, blocks, 3), 1000.0).first()
    assert (len(e.time), len(e.freq), len(e.tf), len(e.spatial)) == (112, 90, 739, 61)
    assert {r.sample_id for r in extraction.pending(man, spark.createDataFrame([("a",)], "sample_id string")).collect()} == {"b", "late"}
