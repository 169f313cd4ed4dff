"""Shapley values of forests, along the paths of their trees.

A feature that is left out is averaged over the training rows that went each way (the cover of the children).  Then
the game of one leaf is a product over the features of its path, z where a feature is left out and o (does the row fit
the path's interval?) where it is known, and a Shapley value is an integral of such products over [0, 1]:

    value * (o_j - z_j) * integral of the product over k != j of (z_k * (1 - t) + o_k * t)

The integrand is a polynomial of degree d - 1, so Gauss-Legendre quadrature with ceil(d / 2) points is exact.  All
leaves with the same number of features are taken together, for many rows at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_dir
from .trees import _delete, _matrix

#: Rows and leaves that are taken together.
ROWS, LEAVES = 64, 64


@dataclass
class FlatTree:
    """Nodes by number; ``left`` is -1 at a leaf.  ``value``: (nodes, classes)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray


def exported(spark: SparkSession, model) -> list[FlatTree]:
    """The trees of a fitted MLlib forest or tree: its saved form has a row a node, which the parameters bound."""
    path = f"{work_dir(spark)}/tremolo-forest-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    rows = data.select("treeID", "id", "impurityStats", "leftChild", "rightChild", "split.featureIndex", F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("cut")).orderBy("treeID", "id").collect()
    _delete(data, path)
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r)
    out = []
    for nodes in trees.values():
        stats = np.array([r["impurityStats"] for r in nodes], float)
        cover = stats.sum(axis=1)
        out.append(FlatTree(*(np.array([r[c] for r in nodes]) for c in ("featureIndex",)), np.array([np.nan if r["cut"] is None else r["cut"] for r in nodes]), *(np.array([r[c] for r in nodes]) for c in ("leftChild", "rightChild")), cover, stats / np.maximum(cover, 1e-15)[:, None]))
    return out


@dataclass
class Leaves:
    """Leaves whose paths have the same number of features: (leaves, features) and (leaves, classes)."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    absent: np.ndarray
    value: np.ndarray


def leaves(trees: list[FlatTree]) -> list[Leaves]:
    """All leaves by number of path features; a feature's tests along a path become one interval, low < v <= high."""
    found: dict[int, list] = {}
    for t in trees:
        stack = [(0, {})]
        while stack:
            n, path = stack.pop()
            if t.left[n] < 0:
                item = sorted((f, *x) for f, x in path.items())
                found.setdefault(len(item), []).append((item, t.value[n] / len(trees)))
                continue
            f, cut = int(t.feature[n]), float(t.threshold[n])
            low, high, z = path.get(f, (-np.inf, np.inf, 1.0))
            for child, interval in ((t.left[n], (low, min(high, cut))), (t.right[n], (max(low, cut), high))):
                share = t.cover[child] / t.cover[n]
                if share > 0:
                    stack.append((int(child), path | {f: (*interval, z * share)}))
    out = []
    for d, items in sorted(found.items()):
        for k in range(0, len(items), LEAVES):
            part = items[k : k + LEAVES]
            a = np.array([i for i, _ in part], float).reshape(len(part), d, 4)
            out.append(Leaves(a[:, :, 0].astype(np.int64), a[:, :, 1], a[:, :, 2], a[:, :, 3], np.array([v for _, v in part])))
    return out


def base_value(table: list[Leaves]) -> np.ndarray:
    """The prediction when every feature is left out."""
    return sum((p.absent.prod(axis=1)[:, None] * p.value).sum(axis=0) for p in table)


def shapley_values(table: list[Leaves], x: np.ndarray) -> np.ndarray:
    """(rows, features, classes) of Shapley values; a missing value goes right, as it does in the forest."""
    out = np.zeros((len(x), x.shape[1], table[0].value.shape[1]))
    for part in table:
        d = part.feature.shape[1]
        if not d:
            continue
        t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
        t, w = (t + 1) / 2, w / 2
        flat = part.feature.ravel()
        order = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
        leaf = np.repeat(np.arange(len(part.value)), d)[order]
        for lo in range(0, len(x), ROWS):
            v = x[lo : lo + ROWS][:, part.feature]
            o = ~(v <= part.low) & ((v <= part.high) | np.isinf(part.high))
            m = part.absent[..., None] * (1 - t) + o[..., None] * t  # above zero, as no child is empty
            each = (o - part.absent) * ((m.prod(axis=2)[:, :, None, :] / m) @ w)
            each = each.reshape(len(v), -1)[:, order]
            for k in range(out.shape[2]):
                out[lo : lo + ROWS, flat[order][heads], k] += np.add.reduceat(each * part.value[leaf, k], heads, axis=1)
    return out


def mean_shapley(df: DataFrame, trees: list[FlatTree]) -> DataFrame:
    """(feature, score): the mean |Shapley value| over all rows and classes; sums are made in the tasks."""
    sent = df.sparkSession.sparkContext.broadcast(leaves(trees))

    def run(batches):
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                found = np.abs(shapley_values(sent.value, _matrix(b))).mean(axis=2).sum(axis=0)
                total, n = found if total is None else total + found, n + b.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array([n] * len(total))], names=["feature", "total", "n"])

    sums = df.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "feature int, total double, n long")
    return sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("score"))
