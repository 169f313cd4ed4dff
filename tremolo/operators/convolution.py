"""Convolutional baselines: networks in NumPy, fitted data-parallel by Spark.

In each epoch every partition trains its own copy of the weights on its own rows, and the copies are averaged by
their numbers of rows (local stochastic gradients).  Only one set of weights, whose size the architecture fixes,
is broadcast and comes back; rows never leave their partitions.  Spark puts a partition's rows in a new random order
for each epoch, and a task takes them as a stream of mini-batches: its memory doesn't grow with its rows.  Large inputs (images, spectra) can be made of small ones a mini-batch at a
time, and are then never kept or shuffled.  The weights
of each epoch can be kept in a folder, from which a later call goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a piece of the weights that are averaged in one group, and of one that is updated while it is in the cache.
CHUNK, PIECE = 1 << 20, 1 << 15

# The published architectures.  A layer is its name and its numbers; sizes are (rows, columns).
#: One spectrum or coefficient vector as (1, length, 1): 64 and 256 filters, dense layer.
DAS_CNN = (("conv", 64, (7, 1), (1, 1), 0), ("leaky", 0.01), ("pool", (4, 1), 0), ("conv", 256, (7, 1), (1, 1), 0), ("leaky", 0.01), ("pool", (4, 1), 0), ("dense", 1024), ("sigmoid",), ("dropout", 0.3))
TOMASOV_CNN = (*DAS_CNN[:6], ("dense", 256), *DAS_CNN[7:])
#: A record as an image (1, 10,000, 12).
CAO_CNN = (("conv", 5, (200, 3), (50, 1), 1), ("leaky", 0.0), ("pool", (2, 2), 1), ("conv", 10, (20, 2), (4, 1), 1), ("leaky", 0.0), ("pool", (2, 2), 0))


class Network:
    """Layers over (batch, channels, rows, columns), then one score a class."""

    def __init__(self, layers: tuple, shape: tuple[int, int, int], classes: int, seed: int = 42):
        self.layers, self.shape, self.weights = (*layers, ("dense", classes)), shape, []
        rng, at = np.random.default_rng(seed), (1, *shape)
        for name, *args in self.layers:
            if name == "conv":
                filters, size, *_ = args
                self._add(rng, (filters, at[1], *size), at[1] * size[0] * size[1])
            elif name == "dense":
                self._add(rng, (int(np.prod(at[1:])), args[0]), int(np.prod(at[1:])))
            at = self._size(name, args, at)

    def _add(self, rng, shape: tuple, inputs: int) -> None:
        edge = 1 / np.sqrt(inputs)
        self.weights += [rng.uniform(-edge, edge, shape).astype(np.float32), np.zeros(shape[0] if len(shape) == 4 else shape[1], np.float32)]

    @staticmethod
    def _size(name: str, args: list, at: tuple) -> tuple:
        if name == "conv":
            filters, size, step, pad = args
            return (1, filters, *((n + 2 * pad - k) // s + 1 for n, k, s in zip(at[2:], size, step, strict=True)))
        if name == "pool":
            size, pad = args
            return (1, at[1], *((n + 2 * pad) // k for n, k in zip(at[2:], size, strict=True)))
        return (1, args[0]) if name == "dense" else at

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Scores, and what ``backward`` needs of each layer; ``rng``: for dropout, which only training has."""
        kept, at = [], 0
        for name, *args in self.layers:
            if name == "conv":
                _, size, step, pad = args
                padded = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
                seen = np.lib.stride_tricks.sliding_window_view(padded, size, axis=(2, 3))[:, :, :: step[0], :: step[1]]
                kept.append((seen, padded.shape))
                x = np.tensordot(seen, self.weights[at], axes=([1, 4, 5], [1, 2, 3])).transpose(0, 3, 1, 2) + self.weights[at + 1][:, None, None]
                at += 2
            elif name == "pool":
                (kh, kw), pad = args
                x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)), constant_values=-np.inf)
                b, c, h, w = x.shape
                cells = x[:, :, : h // kh * kh, : w // kw * kw].reshape(b, c, h // kh, kh, w // kw, kw)
                top = cells.max(axis=(3, 5), keepdims=True)
                kept.append((cells == top, x.shape))
                x = top[:, :, :, 0, :, 0]
            elif name == "dense":
                kept.append((x.reshape(len(x), -1), x.shape))
                x = kept[-1][0] @ self.weights[at] + self.weights[at + 1]
                at += 2
            elif name == "leaky":
                kept.append(x > 0)
                x = np.where(kept[-1], x, args[0] * x)
            elif name == "sigmoid":
                x = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                kept.append(x)
            else:
                kept.append(None if rng is None else (rng.random(x.shape) >= args[0]) / np.float32(1 - args[0]))
                x = x if rng is None else x * kept[-1]
        return x, kept

    def backward(self, grad: np.ndarray, kept: list) -> list[np.ndarray]:
        """Gradients of the weights."""
        out, at = [None] * len(self.weights), len(self.weights)
        for k in range(len(self.layers) - 1, -1, -1):
            (name, *args), held = self.layers[k], kept[k]
            if name == "conv":
                _, size, step, pad = args
                at -= 2
                seen, shape = held
                out[at], out[at + 1] = np.tensordot(grad, seen, axes=([0, 2, 3], [0, 2, 3])), grad.sum(axis=(0, 2, 3))
                if k == 0:
                    break
                back = np.zeros(shape, np.float32)
                for i in range(size[0]):
                    for j in range(size[1]):
                        part = np.tensordot(grad, self.weights[at][:, :, i, j], axes=([1], [0])).transpose(0, 3, 1, 2)
                        back[:, :, i : i + step[0] * part.shape[2] : step[0], j : j + step[1] * part.shape[3] : step[1]] += part
                grad = back[:, :, pad : shape[2] - pad, pad : shape[3] - pad]
            elif name == "pool":
                (kh, kw), pad = args
                mask, shape = held
                spread = (mask * (grad[:, :, :, None, :, None] / mask.sum(axis=(3, 5), keepdims=True))).reshape(*shape[:2], mask.shape[2] * kh, mask.shape[4] * kw)
                back = np.zeros(shape, np.float32)
                back[:, :, : spread.shape[2], : spread.shape[3]] = spread
                grad = back[:, :, pad : shape[2] - pad, pad : shape[3] - pad]
            elif name == "dense":
                at -= 2
                flat, shape = held
                out[at], out[at + 1] = flat.T @ grad, grad.sum(axis=0)
                grad = (grad @ self.weights[at].T).reshape(shape)
            elif name == "leaky":
                grad = np.where(held, grad, args[0] * grad)
            elif name == "sigmoid":
                grad = grad * held * (1 - held)
            elif held is not None:
                grad = grad * held
        return out

    def loss(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy and its gradients."""
        scores, kept = self.forward(x, rng)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        value = float(-np.log(p[np.arange(len(y)), y] + 1e-12).mean())
        p[np.arange(len(y)), y] -= 1
        return value, self.backward((p / len(y)).astype(np.float32), kept)

    def train(self, batches: Iterable[tuple[np.ndarray, np.ndarray]], rate: float, rng: np.random.Generator) -> int:
        """One pass over mini-batches (x, y): Adam.  The number of rows."""
        first, second, rows = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for t, (x, y) in enumerate(batches, 1):
            _, grads = self.loss(x, y, rng)
            rows += len(y)
            for whole in zip(self.weights, grads, first, second, strict=True):
                flat = [a.reshape(-1) for a in whole]
                for at in range(0, len(flat[0]), PIECE):
                    w, g, m, v = (a[at : at + PIECE] for a in flat)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + np.float32(1e-8))
        return rows


def minibatches(batches: Iterable[pa.RecordBatch], shape: tuple, size: int, make: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of ``size`` rows each, the last of what is left, from a stream of Arrow batches; never more than one of both is held."""
    xs, ys, n = [], [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, size - n)
            xs.append(_rows(part, shape, make))
            ys.append(part.column("label").to_numpy(zero_copy_only=False) - 1)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ys)


def _rows(b: pa.RecordBatch, shape: tuple, make: Callable | None = None) -> np.ndarray:
    x = b.column("features").flatten().to_numpy(zero_copy_only=False)
    if make is not None:
        x = np.asarray(make(x.reshape(b.num_rows, -1)))
    return x.astype(np.float32).reshape(b.num_rows, *shape)


def _kept(spark, state: str, epochs: int) -> int:
    """The epochs whose weights the folder ``state`` holds whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    done = 0
    while done < epochs and fs.exists(path(f"{state}/{done + 1}/_SUCCESS")):
        done += 1
    return done


def fit_predict(
    train: DataFrame, test: DataFrame, layers: tuple, shape: tuple[int, int, int], epochs: int = 5, rate: float = 1e-3, batch: int = 16, partitions: int | None = None, seed: int = 42, state: str | None = None,
    make: Callable | None = None,
) -> DataFrame:
    """(id, y_true, y_pred) of ``test`` by a network fitted on ``train`` (id, y, features: the numbers of a ``shape``).

    ``partitions``: copies that train side by side (the session's parallelism, or fewer for few rows).  ``state``: a
    folder for the weights of each epoch; epochs that it holds are not run again.
    ``make``: gives the numbers of a ``shape`` for each row of a matrix of features, where ``features`` are what they are made of.
    """
    spark = train.sparkSession
    labels = sorted(r["y"] for r in train.select(F.col("y").cast("string").alias("y")).distinct().collect())  # one row a class
    net = Network(layers, shape, len(labels), seed)
    features = F.col("features").cast("array<float>" if make is None else "array<double>").alias("features")
    rows = train.select("id", F.array_position(F.array(*map(F.lit, labels)), F.col("y").cast("string")).alias("label"), features)
    if partitions is None:
        partitions = max(1, min(spark.sparkContext.defaultParallelism, train.count() // (8 * batch)))
    rows = rows.repartition(partitions, "id").cache()
    cuts = np.cumsum([w.size for w in net.weights])[:-1]

    def take(found: DataFrame) -> None:
        flat = np.frombuffer(b"".join(r["w"] for r in found.orderBy("chunk").collect()), np.float32)  # one set of weights
        if len(flat):
            net.weights = [p.reshape(w.shape).copy() for p, w in zip(np.split(flat, cuts), net.weights, strict=True)]

    done = _kept(spark, state, epochs) if state else 0
    if done:
        take(spark.read.schema("chunk long, w binary").parquet(f"{state}/{done}"))
    for epoch in range(done, epochs):
        sent = spark.sparkContext.broadcast(net.weights)

        def work(batches, sent=sent, epoch=epoch):
            mine = Network(layers, shape, len(labels))
            mine.weights = [w.copy() for w in sent.value]
            part = TaskContext.get().partitionId()
            n = mine.train(minibatches(batches, shape, batch, make), rate, np.random.default_rng([seed, epoch, part]))
            flat = np.concatenate([w.ravel() for w in mine.weights])
            for k in range(0, len(flat) if n else 0, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK]), pa.array([part]), pa.array([n]), pa.array([flat[k : k + CHUNK].tobytes()], pa.binary())], names=["chunk", "part", "n", "w"])

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")  # sums in one order
            total = sum(n * np.frombuffer(w, np.float32).astype(float) for n, w in zip(pdf["n"], pdf["w"], strict=True)) / pdf["n"].sum()
            return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "w": [total.astype(np.float32).tobytes()]})

        shuffled = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), F.lit(epoch), "id"), "id")
        found = shuffled.mapInArrow(work, "chunk long, part long, n long, w binary").groupBy("chunk").applyInPandas(mean, "chunk long, w binary")
        if state:
            found.write.mode("overwrite").parquet(f"{state}/{epoch + 1}")
            found = spark.read.schema("chunk long, w binary").parquet(f"{state}/{epoch + 1}")
        take(found)
    rows.unpersist()
    sent = spark.sparkContext.broadcast(net.weights)

    def predict(batches):
        mine = Network(layers, shape, len(labels))
        mine.weights = sent.value
        for b in batches:
            best = np.concatenate([mine.forward(_rows(b.slice(k, batch), shape, make))[0].argmax(axis=1) for k in range(0, b.num_rows, batch)]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([labels[i] for i in best], pa.string())], names=["id", "y_true", "y_pred"])

    return test.select(F.col("id").cast("long").alias("id"), F.col("y").cast("string").alias("y"), features).mapInArrow(predict, "id long, y_true string, y_pred string")
