"""Histogram trees grown by Spark: boosted trees of three kinds, and extremely randomised trees.

Rows are binned once (bin 0: missing) and kept as a table in the shared folder.  A pass over it adds up one histogram
for every node that waits for its split, of all trees that grow at the time; a task holds ``CELLS`` numbers at most,
and what reaches the driver is one best split a node.  Trees are grown by passes that look one level ahead of the
nodes chosen so far, so that a tree of 64 leaves, grown leaf by leaf, takes about as many passes as it is deep.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import work_dir

#: Numbers of all histograms that a task holds; rows that it takes at a time; blocks that are added up in one group.
CELLS, STEP_ROWS, MERGED = 1 << 23, 1 << 15, 64
#: Rounds after which the scores of all rows are written anew.
SETTLE = 10
_BEST = "slot long, feature long, bin long, missing_left boolean, gain double, left binary, whole binary"


@dataclass(frozen=True)
class Growth:
    """How trees grow.  ``leaves``: the most, best first; None: all that gain, level by level."""

    rounds: int = 500
    rate: float = 0.05
    depth: int = 15
    leaves: int | None = None
    bins: int = 254
    l2: float = 0.0
    gamma: float = 0.0
    min_rows: int = 1
    min_curve: float = 1e-3
    row_share: float = 1.0
    column_share: float = 1.0
    #: Curvature of the softmax loss is this times p * (1 - p); None: classes / (classes - 1).
    curve: float | None = 1.0
    prior: bool = True
    seed: int = 42


# The published settings of the three boosters.
LEAFWISE = Growth(leaves=64, min_rows=20, row_share=0.8, column_share=0.8, curve=None)
REGULARISED = Growth(l2=1.0, min_curve=1.0, row_share=0.8, column_share=0.8, curve=2.0, prior=False)
HISTOGRAM = Growth(leaves=31, min_rows=20)


@dataclass
class Tree:
    """Nodes by number; ``left`` is -1 where a node has no children.  ``stats``: sums over a node's training rows."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    stats: list[np.ndarray | None] = field(default_factory=list)
    value: list = field(default_factory=list)
    columns: np.ndarray | None = None
    number: int = 0

    def add(self, depth: int, stats: np.ndarray | None) -> int:
        for column, x in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.gain, math.nan), (self.depth, depth), (self.stats, stats), (self.value, 0.0)):
            column.append(x)
        return len(self.left) - 1

    def fork(self, node: int) -> None:
        """Children for a node whose split is known."""
        if self.left[node] < 0:
            a, b = self.stats[node]
            self.left[node], self.right[node] = self.add(self.depth[node] + 1, a), self.add(self.depth[node] + 1, b)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.asarray(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))

    def cut(self, inner: set[int]) -> Tree:
        """The tree whose inner nodes are ``inner``; its leaves keep their values."""
        out, new = Tree(columns=self.columns, number=self.number), {}

        def copy(k: int, depth: int) -> int:
            new[k] = at = out.add(depth, None)
            out.value[at] = self.value[k]
            if k in inner:
                out.feature[at], out.bin[at], out.missing_left[at], out.gain[at] = self.feature[k], self.bin[k], self.missing_left[k], self.gain[k]
                out.left[at], out.right[at] = copy(self.left[k], depth + 1), copy(self.right[k], depth + 1)
            return at

        copy(0, 0)
        return out


def route(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node without children that each row comes to."""
    feature, cut, missing_left, left, right = tree
    at = np.zeros(len(bins), np.int64)
    rows = np.flatnonzero(left[at] >= 0)
    while len(rows):
        k = at[rows]
        b = bins[rows, feature[k]]
        at[rows] = np.where(np.where(b == 0, missing_left[k], b <= cut[k]), left[k], right[k])
        rows = rows[left[at[rows]] >= 0]
    return at


# ---------------------------------------------------------------- rows
def bin_edges(df: DataFrame, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature: the upper edges of all bins but the last."""
    long = df.select(F.posexplode("features").alias("feature", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = long.groupBy("feature").agg(F.percentile_approx("v", at, F.lit(100 * bins)).alias("q"), F.max("v").alias("top")).collect()  # ``bins`` numbers a feature
    found = {r["feature"]: np.array(sorted({x for x in r["q"] if x < r["top"]}), float) for r in rows}
    return [found.get(j, np.zeros(0)) for j in range(len(df.select("features").first()["features"]))]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], "left"))
    return out


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    """Features of a batch; a null is NaN."""
    return b.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _steps(batches):
    """(ids, labels, weights, bins, scores) of about STEP_ROWS rows."""
    def joined(held):
        col = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])
        blob = lambda c, kind: np.frombuffer(b"".join(x for b in held for x in b.column(c).to_pylist()), kind).reshape(sum(b.num_rows for b in held), -1)
        return col("id"), col("label"), col("weight"), blob("bins", np.uint8), blob("scores", np.float64)

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= STEP_ROWS:
            yield joined(held)
            held, n = [], 0
    if held:
        yield joined(held)


def _chosen(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    """The rows of a seeded sample."""
    h = (ids.astype(np.uint64) + np.uint64(seed % (1 << 32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / (1 << 53) < share


# ---------------------------------------------------------------- splits
def best_split(h: np.ndarray, g: Growth) -> tuple[float, int, int, bool, np.ndarray, np.ndarray]:
    """(gain, feature, bin, missing left, left sums, all sums) over histograms (features, bins, [gradient, curvature, rows]).

    The first of equal gains counts: missing values to the right before the left, then the least feature and bin.
    """
    whole = h[0].sum(axis=0)
    miss, cum = h[:, :1, :], np.cumsum(h[:, 1:, :], axis=1)[:, :-1, :]
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + g.l2, 1e-15)
    best = (-np.inf, 0, 0, False, whole, whole)
    for to_left in (False, True):
        if to_left and not miss[..., 2].any():
            break
        a = cum + miss if to_left else cum
        b = whole - a
        ok = (a[..., 2] >= g.min_rows) & (b[..., 2] >= g.min_rows) & (a[..., 1] >= g.min_curve) & (b[..., 1] >= g.min_curve)
        gain = np.where(ok, (score(a) + score(b) - score(whole)) / 2 - g.gamma, -np.inf)
        if gain.size:
            at = int(gain.argmax())
            f, k = divmod(at, gain.shape[1])
            if gain[f, k] > best[0]:
                best = (float(gain[f, k]), f, k + 1, to_left, a[f, k], whole)
    return best


def random_split(h: np.ndarray, edges: list[np.ndarray], columns: np.ndarray, seed: list[int]) -> tuple[float, int, int, bool, np.ndarray, np.ndarray]:
    """The best, by Gini impurity, of one random threshold a feature over histograms (features, bins, classes)."""
    rng = np.random.default_rng(seed)
    whole = h[0].sum(axis=0)
    best = (-np.inf, 0, 0, False, whole, whole)
    impurity = lambda s: s.sum() - (s**2).sum() / max(s.sum(), 1e-15)
    for j, f in enumerate(columns):
        u = rng.random()
        some = np.flatnonzero(h[j, 1:].sum(axis=1) > 0)
        if len(some) < 2:
            continue
        e, lo, hi = edges[f], int(some[0]), int(some[-1])
        at = e[lo] + u * (e[hi - 1] - e[lo])  # between the edges that part the node's rows
        k = min(max(int(np.searchsorted(e, at, "left")), lo), hi - 1)
        a = h[j, 1 : k + 2].sum(axis=0)
        gain = impurity(whole) - impurity(a) - impurity(whole - a)
        if gain > best[0]:
            best = (float(gain), j, k + 1, False, a, whole)
    return best


class _Pass:
    """Histograms of the waiting nodes of growing trees, and the best split of each."""

    def __init__(self, rows: DataFrame, edges: list[np.ndarray], growth: Growth, classes: int, random: bool):
        self.rows, self.edges, self.growth, self.classes, self.random = rows, edges, growth, classes, random
        self.width, self.spark = max((len(e) for e in edges), default=0) + 2, rows.sparkSession
        self.parts = rows.rdd.getNumPartitions()

    def run(self, trees: list[Tree], waiting: list[tuple[int, int]], pending: list[list[Tree]], number: int) -> dict[tuple[int, int], tuple]:
        """{(tree, node): best split}; ``pending``: rounds whose trees the stored scores lack."""
        channels = self.classes if self.random else 3
        out, k = {}, 0
        while k < len(waiting):
            part, cells = [], 0
            while k < len(waiting) and (not part or cells < CELLS):
                part.append(waiting[k])
                cells += len(trees[waiting[k][0]].columns) * self.width * channels
                k += 1
            out |= self._some(trees, part, pending, number)
        return out

    def _columns(self, tree: Tree, node: int) -> np.ndarray:
        if not self.random:
            return tree.columns
        m = max(1, round(math.sqrt(len(self.edges))))
        return np.sort(np.random.default_rng([self.growth.seed, tree.number, node]).choice(len(self.edges), m, replace=False))

    def _some(self, trees, part, pending, number):
        g, width, classes, random, edges = self.growth, self.width, self.classes, self.random, self.edges
        by = {}
        for slot, (t, node) in enumerate(part):
            by.setdefault(t, []).append((node, slot))
        grow = [(t, trees[t].number, trees[t].arrays(), nodes, np.array([self._columns(trees[t], n) for n, _ in nodes])) for t, nodes in by.items()]
        past = [[(tree.arrays(), np.array(tree.value)) for tree in r] for r in pending]
        names = {slot: self._columns(trees[t], node) for slot, (t, node) in enumerate(part)}
        sent = self.spark.sparkContext.broadcast((grow, past))

        def packed(slots, pid: int, sums) -> pa.Table:
            """Rows (slot, pid, at, h): the cells of each slot that hold anything."""
            some = [np.flatnonzero(h.any(axis=1)).astype(np.int32) for h in sums]
            blobs = [at.tobytes() for at in some], [h[at].tobytes() for h, at in zip(sums, some, strict=True)]
            return pa.table([pa.array(slots, pa.int64()), pa.array([pid] * len(slots), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["slot", "pid", "at", "h"])

        channels = classes if random else 3

        def work(batches):
            grow, past = sent.value
            sums = [np.zeros((len(nodes), cols.shape[1] * width, channels)) for *_, nodes, cols in grow]
            for ids, label, weight, bins, scores in _steps(batches):
                if not random:
                    p = _softmax(_add(scores, past, bins))
                    keep = _chosen(ids, g.seed + 7919 * number, g.row_share)
                for (t, tree_number, arrays, nodes, cols), total in zip(grow, sums, strict=True):
                    slot = np.full(len(arrays[3]), -1)
                    slot[[n for n, _ in nodes]] = np.arange(len(nodes))
                    at = slot[route(arrays, bins)]
                    use = at >= 0 if random else (at >= 0) & keep
                    rows = np.flatnonzero(use)
                    if not len(rows):
                        continue
                    at, m = at[rows], cols.shape[1]
                    key = ((at[:, None] * m + np.arange(m)) * width + bins[rows[:, None], cols[at]]).ravel()
                    size = total.shape[0] * total.shape[1]
                    if random:
                        total += np.bincount(key * classes + np.repeat(label[rows], m), np.repeat(weight[rows], m), size * classes).reshape(total.shape)
                    else:
                        q, w = p[rows, t], weight[rows]
                        curve = g.curve if g.curve is not None else classes / max(classes - 1, 1)
                        for c, v in enumerate((w * (q - (label[rows] == t)), w * np.maximum(curve * q * (1 - q), 1e-16), np.ones(len(rows)))):
                            total[..., c] += np.bincount(key, np.repeat(v, m), size).reshape(total.shape[:2])
            pid = TaskContext.get().partitionId()
            for (*_, nodes, _), total in zip(grow, sums, strict=True):
                yield packed([s for _, s in nodes], pid, total).combine_chunks().to_batches()[0]

        def added(table: pa.Table):
            """(slot, sums) of each slot of a table."""
            table = table.sort_by([("slot", "ascending"), ("pid", "ascending")])  # sums in one order
            slots = table.column("slot").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, slots[1:] != slots[:-1])), len(slots))
            cells, blobs = table.column("at").to_pylist(), table.column("h").to_pylist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                total = np.zeros((len(names[int(slots[lo])]) * width, channels))
                for k in range(lo, hi):
                    total[np.frombuffer(cells[k], np.int32)] += np.frombuffer(blobs[k], np.float64).reshape(-1, channels)
                yield int(slots[lo]), total

        def merge(table: pa.Table) -> pa.Table:
            slots, sums = zip(*added(table), strict=True)
            return packed(list(slots), table.column("pid")[0].as_py(), sums)

        def best(table: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("slot", "feature", "bin", "missing_left", "gain", "left", "whole")}
            for slot, sums in added(table):
                columns, (t, node) = names[slot], part[slot]
                h = sums.reshape(len(columns), width, -1)
                gain, f, k, to_left, left, whole = random_split(h, edges, columns, [g.seed, number, t, node]) if random else best_split(h, g)
                for column, x in zip(out.values(), (slot, int(columns[f]), k, bool(to_left), gain, left.tobytes(), whole.tobytes()), strict=True):
                    column.append(x)
            return pa.table({c: pa.array(v, pa.binary()) if c in ("left", "whole") else pa.array(v) for c, v in out.items()})

        blocks = self.rows.mapInArrow(work, "slot long, pid long, at binary, h binary")
        size = max(len(c) for c in names.values()) * width * channels
        unit = F.floor(F.col("slot") / max(1, CELLS // (size * min(self.parts, MERGED)))).alias("unit")  # slots that one group can hold
        if self.parts > MERGED:
            blocks = blocks.groupBy(unit, F.floor(F.col("pid") / MERGED).alias("group")).applyInArrow(merge, "slot long, pid long, at binary, h binary")
        found = blocks.groupBy(unit).applyInArrow(best, _BEST).collect()  # one row a node
        sent.destroy()
        return {part[r["slot"]]: (r["gain"], r["feature"], r["bin"], r["missing_left"], np.frombuffer(r["left"]), np.frombuffer(r["whole"])) for r in found}


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _add(scores: np.ndarray, rounds, bins: np.ndarray) -> np.ndarray:
    out = scores.copy()
    for r in rounds:
        for k, (arrays, value) in enumerate(r):
            out[:, k] += value[route(arrays, bins)]
    return out


def _take(tree: Tree, node: int, split: tuple) -> None:
    gain, feature, k, to_left, left, whole = split
    tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = feature, k, to_left, gain
    tree.stats[node] = (left, whole - left)


class _Grower:
    """One tree: nodes chosen so far, and those whose split must be known before the next choice."""

    def __init__(self, tree: Tree, growth: Growth):
        self.tree, self.growth, self.inner, self.sums = tree, growth, set(), {}
        tree.add(0, None)
        self.front = [0]

    def told(self, node: int, split: tuple) -> None:
        self.sums[node] = split[5]
        _take(self.tree, node, split)
        if split[0] > 0 and self.tree.depth[node] < self.growth.depth:
            self.tree.fork(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                self.sums[child] = self.tree.stats[child]
                self.tree.stats[child] = None
                if self.tree.depth[child] >= self.growth.depth:
                    self.tree.gain[child] = -np.inf

    def waiting(self) -> list[int]:
        """Chooses as long as all splits in question are known; what must be looked up, with the children of the front."""
        t, g = self.tree, self.growth
        while g.leaves is None or len(self.front) < g.leaves:
            if any(math.isnan(t.gain[n]) for n in self.front):
                break
            able = [n for n in self.front if t.left[n] >= 0]
            if not able:
                return []
            chosen = able if g.leaves is None else [max(able, key=lambda n: (t.gain[n], -n))]
            for n in chosen:
                self.inner.add(n)
                self.front.remove(n)
                self.front += [t.left[n], t.right[n]]
        else:
            return []
        ahead = [c for n in self.front if t.left[n] >= 0 for c in (t.left[n], t.right[n])] if g.leaves is not None else []
        return [n for n in self.front + ahead if math.isnan(t.gain[n])]


def _grow(step: _Pass, trees: list[Tree], pending: list[list[Tree]], number: int) -> list[_Grower]:
    growers = [_Grower(t, step.growth) for t in trees]
    while True:
        waiting = [(k, n) for k, gr in enumerate(growers) for n in gr.waiting()]
        if not waiting:
            return growers
        for (k, n), split in step.run(trees, waiting, pending, number).items():
            growers[k].told(n, split)
        for k, n in waiting:  # no row of the sample came to it
            if math.isnan(trees[k].gain[n]):
                trees[k].gain[n] = -np.inf


# ---------------------------------------------------------------- models
@dataclass
class Forest:
    """Fitted trees; ``rounds[r][k]``: the tree of class k in round r, or the r-th randomised tree alone."""

    labels: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]
    random: bool = False

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features."""
        bins = binned(x, self.edges)
        if self.random:
            out = np.zeros((len(x), len(self.labels)))
            for (tree,) in self.rounds:
                out += np.array(tree.value)[route(tree.arrays(), bins)]
            return out / max(len(self.rounds), 1)
        rounds = [[(t.arrays(), np.array(t.value)) for t in r] for r in self.rounds]
        return _softmax(_add(np.tile(self.start, (len(x), 1)), rounds, bins))

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, y_true, y_pred, proba)."""
        sent = df.sparkSession.sparkContext.broadcast(self)  # as large as the parameters allow trees to be

        def run(batches):
            for b in batches:
                p = sent.value.scores(_matrix(b)) if b.num_rows else np.zeros((0, len(sent.value.labels)))
                names = np.array(sent.value.labels, object)[p.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(list(names), pa.string()), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "y_true", "y_pred", "proba"])

        rows = df.select(F.col("id").cast("long").alias("id"), F.col("y").cast("string").alias("y"), F.col("features").cast("array<double>").alias("features"))
        return rows.mapInArrow(run, "id long, y_true string, y_pred string, proba array<double>")

    def importances(self) -> np.ndarray:
        """Shares of the gain by feature."""
        out = np.zeros(len(self.edges))
        for r in self.rounds:
            for t in r:
                for f, gain, left in zip(t.feature, t.gain, t.left, strict=True):
                    if left >= 0:
                        out[f] += gain
        return out / max(out.sum(), 1e-15)


def _prepared(train: DataFrame, bins: int, prior: bool) -> tuple[DataFrame, list[str], list[np.ndarray], np.ndarray, str]:
    rows = train if "weight" in train.columns else train.withColumn("weight", F.lit(1.0))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("y").cast("string").alias("y"), F.col("weight").cast("double").alias("weight"), F.col("features").cast("array<double>").alias("features"))
    sums = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("weight").alias("w")).collect()}  # one row a class
    labels = sorted(sums)
    edges = bin_edges(rows, min(bins, 254))
    start = np.log(np.array([sums[k] for k in labels]) / sum(sums.values())) if prior else np.zeros(len(labels))
    sent = rows.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        for b in batches:
            x = binned(_matrix(b), sent.value) if b.num_rows else np.zeros((0, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("weight"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([start.tobytes()] * b.num_rows, pa.binary())], names=["id", "label", "weight", "bins", "scores"])

    at = F.array_position(F.array(*map(F.lit, labels)), F.col("y")).cast("long") - 1
    lean = rows.select("id", at.alias("label"), "weight", "features").mapInArrow(run, "id long, label long, weight double, bins binary, scores binary")
    path = f"{work_dir(rows.sparkSession)}/tremolo-trees-{uuid.uuid4().hex[:12]}"
    return _table(lean, f"{path}/0"), labels, edges, start, path


def _delete(df: DataFrame, path: str) -> None:
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def _settled(rows: DataFrame, pending: list[list[Tree]], path: str) -> DataFrame:
    """The table with the trees of ``pending`` added to its scores."""
    sent = rows.sparkSession.sparkContext.broadcast([[(t.arrays(), np.array(t.value)) for t in r] for r in pending])

    def run(batches):
        for b in batches:
            for ids, label, weight, bins, scores in _steps([b]):
                new = _add(scores, sent.value, bins)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(weight), b.column("bins"), pa.array([v.tobytes() for v in new], pa.binary())], names=["id", "label", "weight", "bins", "scores"])

    return _table(rows.mapInArrow(run, rows.schema), path)


def boost(train: DataFrame, growth: Growth) -> Forest:
    """Softmax boosting of one tree a class and round, over (id, y, features) with an optional weight."""
    rows, labels, edges, start, path = _prepared(train, growth.bins, growth.prior)
    rounds: list[list[Tree]] = []
    pending: list[list[Tree]] = []
    held = rows.cache()
    step = _Pass(held, edges, growth, len(labels), random=False)
    for r in range(growth.rounds):
        m = max(1, round(growth.column_share * len(edges)))
        pick = lambda k, r=r: np.sort(np.random.default_rng([growth.seed, r, k]).choice(len(edges), m, replace=False))
        trees = [Tree(columns=pick(k), number=k) for k in range(len(labels))]
        done = []
        for gr in _grow(step, trees, pending, r):
            for n, s in gr.sums.items():
                gr.tree.value[n] = -growth.rate * s[0] / max(s[1] + growth.l2, 1e-15) if gr.inner else 0.0
            done.append(gr.tree.cut(gr.inner))
        if all(len(t.left) == 1 for t in done):
            break  # nothing gains any more
        rounds.append(done)
        pending.append(done)
        if len(pending) == SETTLE and r + 1 < growth.rounds:
            new = _settled(held, pending, f"{path}/{r + 1}").cache()
            held.unpersist()
            held, pending = new, []
            step = _Pass(held, edges, growth, len(labels), random=False)
    held.unpersist()
    _delete(train, path)
    return Forest(labels, edges, start, rounds)


def extra_trees(train: DataFrame, trees: int = 300, depth: int = 15, seed: int = 42, bins: int = 254) -> Forest:
    """Extremely randomised trees: at each node one random threshold for each of sqrt(features) features, the best by Gini impurity."""
    rows, labels, edges, start, path = _prepared(train, bins, False)
    growth = replace(Growth(), depth=depth, seed=seed)
    held = rows.cache()
    step = _Pass(held, edges, growth, len(labels), random=True)
    made = [Tree(columns=np.zeros(max(1, round(math.sqrt(len(edges)))), np.int64), number=k) for k in range(trees)]
    done = []
    for gr in _grow(step, made, [], 0):
        for n, s in gr.sums.items():
            gr.tree.value[n] = s / max(s.sum(), 1e-15)
        done.append([gr.tree.cut(gr.inner)])
    held.unpersist()
    _delete(train, path)
    return Forest(labels, edges, start, done, random=True)
