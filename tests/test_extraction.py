"""Extraction from blocks to the fused table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.functions import dsp
from tremolo.functions.features import SIZES, window_features
from tremolo.operators import extraction

FS = 1000.0


@pytest.fixture(scope="module")
def parts(spark):
    """Three recordings of six loci and nine blocks of 40 samples, and a window at most blocks."""
    r = np.random.default_rng(1)
    data = {(rec, b, c): r.normal(size=40) for rec in range(3) for b in range(9) for c in range(6)}
    blocks = spark.createDataFrame([(*k, v.tolist()) for k, v in data.items()], "recording_id long, block long, locus long, samples array<double>").repartition(4)
    manifest = [(f"{rec}-{b}", rec, b, (b * 2) % 6, 6) for rec in range(3) for b in range(6)]
    return data, blocks, spark.createDataFrame(manifest, "sample_id string, recording_id long, block long, locus long, n_loci long"), manifest


def patch_of(data, rec, b, locus, n):
    first = max(0, min(locus - n // 2, 6 - n))
    return np.array([np.concatenate([data[rec, k, c] for k in range(b, b + 4)]) for c in range(first, first + n)])


def test_patches_and_features(parts):
    data, blocks, manifest, rows = parts
    found = extraction.patches(manifest, blocks, 4)
    got = {r.sample_id: r for r in extraction.extract(found, FS, reference="energy").collect()}
    assert set(got) == {r[0] for r in rows}
    for sid, rec, b, locus, _ in rows:
        x = patch_of(data, rec, b, locus, 4)
        one = ((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1).argmax()
        y = dsp.preprocess(x, FS)
        with np.errstate(all="ignore"):
            want = window_features(y[one][None], y[None], FS)
        for d in SIZES:
            assert np.allclose(got[sid][d], want[d][0], rtol=1e-4, atol=1e-5)


def test_windows_of_several_shapes(spark):
    """Shapes are told apart inside a batch; no window changes another's features."""
    r = np.random.default_rng(2)
    shapes = [(2, 128), (3, 128), (2, 200), (1, 64)]
    rows = [(i, r.normal(size=shapes[i % 4]).tolist()) for i in range(20)]
    whole = {x.sample_id: x for x in extraction.extract(spark.createDataFrame(rows, "sample_id long, patch array<array<double>>").coalesce(1), FS).collect()}
    for i, p in rows[:5]:
        alone = extraction.extract(spark.createDataFrame([(i, p)], "sample_id long, patch array<array<double>>"), FS).first()
        assert all(np.allclose(whole[i][d], alone[d], rtol=1e-3, atol=1e-4) for d in SIZES)  # the log of a zero bin holds rounding


def test_resume_assemble_fuse(parts, spark):
    _, blocks, manifest, _ = parts
    found = extraction.patches(manifest, blocks, 4)
    done = found.filter("sample_id like '0-%'").select("sample_id")
    assert extraction.pending(manifest, done).count() == 12
    shards = extraction.extract(found, FS, domains=("time", "freq")).withColumn("chunk", F.split("sample_id", "-")[0].cast("long"))
    expected = manifest.select(F.col("recording_id").alias("chunk"))
    assert extraction.assemble(shards, expected).count() == 18
    with pytest.raises(ValueError, match="chunk 1"):
        extraction.assemble(shards.filter("chunk <> 1"), expected)
    fused = extraction.fuse(shards.drop("chunk"), manifest.union(manifest), "block")
    assert fused.count() == 18 and {len(r.features) for r in fused.select("features").collect()} == {SIZES["time"] + SIZES["freq"]}
    with pytest.raises(Exception, match="no manifest row for 2-5"):
        extraction.fuse(shards.drop("chunk"), manifest.filter("sample_id <> '2-5'"), "block").collect()


def test_domain_statistics_are_those_of_each_column(spark):
    rows = [([1.0, 2.0], [float(i), 5.0, float("nan") if i == 2 else 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = {(r.domain, r.idx): repr(tuple(r)[2:]) for r in extraction.domain_statistics(df, ("a", "b")).collect()}
    want = {(d, r.idx): repr(tuple(r)[1:]) for d in "ab" for r in extraction.column_statistics(df, d).collect()}
    assert got == want and len(got) == 5
