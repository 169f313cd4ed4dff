"""Splits of one long recording: equal to restatements, without a recording or a class in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tremolo.operators import splits


@pytest.fixture(scope="module")
def skewed(spark):
    """One recording holds nine of ten windows; a few have no recording."""
    r = random.Random(4)
    rows = [(i, "long" if r.random() < 0.9 else r.choice(["a", "b", None]), r.randint(0, 60), "c0" if r.random() < 0.8 else r.choice(["c1", "c2", None])) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id long, recording_id string, block int, label string").repartition(6)


def test_segments_and_guard(skewed):
    rows, df = skewed
    got = splits.guard(splits.rotate(splits.segments(df), F.lit(3)), guard_blocks=4).collect()
    blocks = {}
    for _, rec, b, _ in rows:
        blocks.setdefault(rec, []).append(b)
    segment = {(rec, b): min(9, sum(x < b for x in bs) * 10 // len(bs)) for rec, bs in blocks.items() for b in bs}
    split = {k: "val" if (s - 3) % 10 < 1 else "test" if (s - 3) % 10 < 2 else "train" for k, s in segment.items()}
    keep = {k: len({split[k[0], b] for b in blocks[k[0]] if abs(b - k[1]) <= 7}) == 1 for k in split}
    assert len(got) == len(rows)
    assert all((r.segment, r.split, r.keep) == (segment[r.recording_id, r.block], split[r.recording_id, r.block], keep[r.recording_id, r.block]) for r in got)


def test_window_frames_see_blocks_only(skewed, spark):
    """No task sorts a recording: what reaches the frames is a row for each block."""
    rows, df = skewed
    out = splits.guard(splits.rotate(splits.segments(df), F.lit(3)))
    below = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    frames = [k for k, line in enumerate(below) if "Window [" in line]
    assert frames
    for k in frames:
        assert "Aggregate [" in next(line for line in below[k:] if "Window [" not in line and "Project [" not in line)
    assert out.count() == len(rows)


def test_stratified_and_decimated(skewed):
    rows, df = skewed
    got = splits.stratified(df, "label", 100, ["id"]).collect()
    count = {}
    for *_, y in rows:
        count[y] = count.get(y, 0) + 1
    for y, n in count.items():
        want = sorted(r[0] for r in rows if r[3] == y)[: max(1, round(100 * n / len(rows)))]
        assert sorted(r.id for r in got if r.label == y) == want
    s = df.withColumn("split", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    cut = splits.decimate(s, {"c0": 200}, ["id"])
    total = count["c0"]
    for name in ("train", "test"):
        sub = sorted(r[0] for r in rows if r[3] == "c0" and (r[0] % 4 == 0) == (name == "test"))
        assert sorted(r.id for r in cut.filter((F.col("label") == "c0") & (F.col("split") == name)).collect()) == sub[: round(200 / total * len(sub))]
    assert cut.filter("label is null or label <> 'c0'").count() == len(rows) - total
    assert "WindowGroupLimit" in cut._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_over_ranges(skewed):
    """Ranks with ties in a label that holds most rows; ranges are what a task sorts."""
    rows, df = skewed
    got = {r.id: (r.rank, r.group_size) for r in splits.ranked(df, "label", ["block"]).collect()}
    for i, _, b, y in rows[::37]:
        mine = [x[2] for x in rows if x[3] == y]
        assert got[i] == (sum(x < b for x in mine) + 1, len(mine))
    assert len(got) == len(rows)


def test_random_split_is_a_percent_rank(skewed):
    rows, df = skewed
    got = {r.id: r.split for r in splits.random_split(df, "label", ["id"]).collect()}
    for y in {r[3] for r in rows}:
        mine = sorted(r[0] for r in rows if r[3] == y)
        for k, i in enumerate(mine):
            p = k / max(len(mine) - 1, 1)
            assert got[i] == ("train" if p < 0.8 else "val" if p < 0.9 else "test")


def test_held_out_counts(skewed):
    rows, df = skewed
    some = df.filter("recording_id is not null")
    want = {tuple(r) for r in splits.leave_one_group_out(some, "recording_id").groupBy("held_out", "role").count().collect()}
    assert {tuple(r) for r in splits.held_out_counts(some, "recording_id").collect()} == want


def test_folds_of_many_groups(spark, monkeypatch):
    """Large groups one by one, thousands of small ones by strata: whole groups, and label shares of folds near a fifth."""
    monkeypatch.setattr(splits, "GREEDY", 30)
    monkeypatch.setattr(splits, "STRATUM", 100)
    r = random.Random(8)
    rows = []
    for g in range(4000):
        y = r.choice(["a", "a", "a", "b", "c"])
        for _ in range(r.choice([1, 1, 2, 5]) if g > 20 else 300):
            rows.append((len(rows), f"g{g}", y if r.random() < 0.9 else "b"))
    seen = []
    whole = splits._dealt_greedily
    monkeypatch.setattr(splits, "_dealt_greedily", lambda picked, *a: (seen.append(len({x["g"] for x in picked})), whole(picked, *a))[1])
    got = splits.grouped_folds(spark.createDataFrame(rows, "id long, g string, y string"), "g", "y", 5).collect()
    assert seen == [30] and len(got) == len(rows)
    folds = {}
    for x in got:
        folds.setdefault(x.g, set()).add(x.fold)
    assert all(len(f) == 1 for f in folds.values())
    for y in "abc":
        n = sum(x.y == y for x in got)
        for f in range(5):
            assert abs(sum(x.y == y and x.fold == f for x in got) / n - 0.2) < 0.04
