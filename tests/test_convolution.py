"""Convolutional baselines: gradients against differences, sizes of the published nets, and a task that needs position."""

import numpy as np
import pytest

from tremolo.operators import convolution as cnn


@pytest.mark.parametrize("layers", [
    (("conv", 3, (3, 2), (2, 1), 1), ("leaky", 0.1), ("pool", (2, 2), 1), ("conv", 2, (2, 2), (1, 1), 0), ("leaky", 0.0), ("pool", (2, 1), 0), ("dense", 5), ("sigmoid",)),
    (("conv", 4, (3, 1), (1, 1), 0), ("leaky", 0.01), ("pool", (2, 1), 0)),
])
def test_gradients(layers):
    r = np.random.default_rng(0)
    net = cnn.Network(layers, (2, 11, 5), 3)
    net.weights = [w.astype(np.float64) for w in net.weights]
    x, y = r.normal(size=(4, 2, 11, 5)), np.array([0, 1, 2, 1])
    _, grads = net.loss(x, y)
    for w, g in zip(net.weights, grads, strict=True):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in w.shape)
            old, step = w[at], 1e-5
            w[at] = old + step
            up = net.loss(x, y)[0]
            w[at] = old - step
            down = net.loss(x, y)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_published_sizes():
    cao = cnn.Network(cnn.CAO_CNN, (1, 10_000, 12), 6)
    assert sum(w.size for w in cao.weights) == 7421
    tom = cnn.Network(cnn.TOMASOV_CNN, (1, 2048, 1), 9)
    assert tom.weights[4].shape == (256 * 126, 256) and cnn.Network(cnn.DAS_CNN, (1, 2048, 1), 9).weights[4].shape == (32_256, 1024)


def test_fits_over_partitions(spark):
    """A bump of either sign anywhere: a linear model of the samples can't tell, a convolution can."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(240):
        x, at = r.normal(size=40) * 0.1, r.integers(3, 37)
        x[at - 2 : at + 2] += [1, 2, 2, 1] if i % 2 else [-1, 2, -2, 1]
        rows.append((i, f"c{i % 2}", x.tolist()))
    df = spark.createDataFrame(rows, "id long, y string, features array<double>")
    layers = (("conv", 8, (5, 1), (1, 1), 0), ("leaky", 0.01), ("pool", (4, 1), 0), ("dense", 16), ("sigmoid",), ("dropout", 0.1))
    a = cnn.fit_predict(df.filter("id < 180"), df.filter("id >= 180"), layers, (1, 40, 1), epochs=12, rate=0.02, partitions=3).orderBy("id").collect()
    assert len(a) == 60 and sum(x.y_true == x.y_pred for x in a) > 54


def test_minibatches_hold_one_batch():
    import pyarrow as pa

    made = []

    def stream():
        for k in range(0, 103, 10):
            n = min(10, 103 - k)
            made.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n) % 3 + 1), pa.array([[float(i), -float(i)] for i in range(k, k + n)])], names=["label", "features"])

    out, seen = [], []
    for x, y in cnn.minibatches(stream(), (1, 2, 1), 16):
        out.append((x, y))
        seen.append(len(made))
    assert [len(y) for _, y in out] == [16] * 6 + [7] and seen == [2, 4, 5, 7, 8, 10, 11]  # read no further than needed
    assert np.concatenate([x[:, 0, 0, 0] for x, _ in out]).tolist() == list(range(103)) and (np.concatenate([y for _, y in out]) == np.arange(103) % 3).all()


def test_epochs_resume(spark, tmp_path):
    """A call that was cut off after two epochs goes on with the third, and ends where one call of four does."""
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, f"c{i % 2}", (r.normal(size=12) + (i % 2)).tolist()) for i in range(80)], "id long, y string, features array<double>").cache()
    layers = (("conv", 3, (3, 1), (1, 1), 0), ("leaky", 0.01), ("dense", 4), ("sigmoid",))
    weights = lambda top: [x["w"] for x in spark.read.parquet(f"{top}/4").orderBy("chunk").collect()]
    whole, cut = f"file://{tmp_path}/whole", f"file://{tmp_path}/cut"
    cnn.fit_predict(df, df, layers, (1, 12, 1), epochs=4, partitions=2, state=whole)
    cnn.fit_predict(df, df, layers, (1, 12, 1), epochs=2, partitions=2, state=cut)
    cnn.fit_predict(df, df, layers, (1, 12, 1), epochs=4, partitions=2, state=cut)
    assert weights(whole) == weights(cut) and cnn._kept(spark, cut, 9) == 4
    assert cnn._kept(spark, f"file://{tmp_path}/none", 3) == 0


@pytest.mark.parametrize("kind", ["rdft", "dwt", "mfcc"])
def test_three_inputs_tell_planted_tones_apart(spark, kind):
    """Two tones in noise, by the published layers for each input: far above chance on rows that were not learned from."""
    from tremolo.functions import baselines

    r, fs, rows = np.random.default_rng(6), 10_000.0, []
    for i in range(160):
        t = np.arange(4096) / fs
        x = np.sin(2 * np.pi * (300 if i % 2 else 2100) * t + r.uniform(0, 6)) + r.normal(size=4096) * 0.5
        rows.append((i, f"c{i % 2}", baselines.TRANSFORMS[kind](x if kind != "dwt" else x[:512], fs).tolist()))
    shape = (1, len(rows[0][2]), 1)
    df = spark.createDataFrame(rows, "id long, y string, features array<double>").cache()
    got = cnn.fit_predict(df.filter("id < 120"), df.filter("id >= 120"), cnn.TOMASOV_CNN, shape, epochs=6, rate=3e-4, partitions=2).collect()
    assert len(got) == 40 and np.mean([x.y_true == x.y_pred for x in got]) > 0.8


def test_images_are_made_a_mini_batch_at_a_time(spark, tmp_path):
    """The same weights and predictions as from images that are rows, of windows that are; no more than a mini-batch of images is made at once."""
    from pyspark.sql import functions as F

    def make(x):
        assert len(x) <= 8
        return np.hstack([x, -x, x * x])

    r = np.random.default_rng(4)
    windows = [(i, f"c{i % 2}", (r.normal(size=6) + (i % 2)).tolist()) for i in range(90)]
    small = spark.createDataFrame(windows, "id long, y string, features array<double>").cache()
    large = small.withColumn("features", F.concat("features", F.transform("features", lambda v: -v), F.transform("features", lambda v: v * v)))
    layers, got = (("conv", 3, (3, 1), (1, 1), 0), ("leaky", 0.01), ("dense", 4), ("sigmoid",)), []
    for df, more in ((small, {"make": make}), (large, {})):
        top = f"file://{tmp_path}/{len(got)}"
        found = cnn.fit_predict(df, df, layers, (1, 18, 1), epochs=2, batch=8, partitions=2, state=top, **more)
        got.append((sorted(map(tuple, found.collect())), [x["w"] for x in spark.read.parquet(f"{top}/2").orderBy("chunk").collect()]))
    assert got[0] == got[1]


def test_updates_in_pieces(monkeypatch):
    """Adam by pieces of the weights, the last one short, ends with the same numbers."""
    def trained(piece):
        monkeypatch.setattr(cnn, "PIECE", piece)
        r, net = np.random.default_rng(0), cnn.Network((("conv", 3, (3, 1), (1, 1), 0), ("leaky", 0.01), ("dense", 5), ("sigmoid",)), (1, 9, 1), 2)
        net.train([(r.normal(size=(4, 1, 9, 1)).astype(np.float32), np.array([0, 1, 1, 0])) for _ in range(3)], 0.01, r)
        return [w.tobytes() for w in net.weights]

    assert trained(7) == trained(1 << 20)
