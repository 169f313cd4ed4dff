"""Quality by Bradley-Terry pairwise ranking.

A document's utility is linear in its features: hashed n-grams of its bytes (1 to 3; A-Z in lower case, digits as 0,
white space as one space, punctuation as it is) and a few measures of style.  Each pair of a document labelled 1 and
one labelled 0 is a preference; the weights minimise the mean logistic loss of the pairs on feature differences plus
a ridge term.  The threshold is a quantile of the utilities of the labelled documents: as large a share lies below it
as is labelled 0.  The score is logistic in the distance to it, and ``THRESHOLD`` exactly there.

Weights, threshold and slope come from all labelled rows and all their pairs.  Up to ``max_sample`` of them are fitted
by one Spark task.  Of more, that task fits a first guess (on ``max_sample`` rows, dealt evenly over the labels in the
order of a hash of the id), and passes over a table of the features of all take it to the minimum by L-BFGS, until the
mean loss is within ``EXCESS`` of the least.  The sum over pairs needs the utilities alone: each pass adds them up on a
grid (by cubic interpolation, off by less than 1e-8 a pair at the step ``GRID``), and the loss of every pair of grid
points counts as often as their weights say.  A prediction reads nothing but the text.

Defined results
* null text: as an empty one; empty texts get a score like any other (all their features are 0).
* labels other than 0 and 1, and null ids: not learned from.  A doc_id with several labels counts with the least.
* rows that repeat a doc_id count once in the sample, with the least text; all rows are scored one by one.
* no preference: without a label 0.5 for all, with one label only that label.
* no rows give no rows; extra columns pass through unread (utility and score are replaced).
* very long texts are counted in pieces; a task holds the text itself about three times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, fresh
from .words import STEP_BYTES, text_slices, word_hashes, word_spans

#: Labelled documents that one task fits; of more, the rows that passes over all of them start from.
MAX_SAMPLE = 4000
#: How far the mean loss over all pairs may be above the least when passes end, and the most of them.
EXCESS, MAX_PASSES = 5e-7, 400
#: Step of the grid of utilities, and points that it may have at first (the step grows beyond).
GRID, POINTS = 1 / 32, 2048
#: The score of the threshold.
THRESHOLD = 0.7
#: Hash buckets of the n-grams, and measures of style.
DIMENSIONS, STYLES = 1 << 12, 10
#: Weight of the ridge term.
RIDGE = 1e-4
_STEP_ROWS = 256
_UTILITY, _SCORE = "utility", "score"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[[0x20, *range(0x09, 0x0E)]] = 0x20
_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 punctuation, 4 line end, 5 not ASCII
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 3
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[0x0A] = 4
_KIND[0x80:] = 5


def _hashed(low: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Rows: texts; columns: counts of hashed n-grams of the folded bytes."""
    out = np.zeros(texts * DIMENSIONS, np.int64)
    low, gram = low.astype(np.int64), np.zeros(len(low), np.int64)
    for k in (1, 2, 3):
        m = len(low) - k + 1
        if m <= 0:
            break
        gram = gram[:m] * 256 + low[k - 1 :]
        h = ((gram + k * 0x51ED27) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
        whole = doc[:m] == doc[k - 1 :]
        out += np.bincount(doc[:m][whole] * DIMENSIONS + h[whole], minlength=len(out))
    return out.reshape(texts, DIMENSIONS)


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows: texts; columns: counts of hashed n-grams that begin and end in the text.  A run of white space is one space."""
    if len(raw) <= 2 * STEP_BYTES:
        low, doc = _FOLD[raw], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20) | (doc[1:] != doc[:-1])
        return _hashed(low[keep], doc[keep], len(offsets) - 1)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.int64)
    for d, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        tail = np.zeros(0, np.uint8)  # long texts go in pieces, each behind the last two characters of the one before
        for at in range(lo, hi, STEP_BYTES):
            low = _FOLD[raw[at : min(at + STEP_BYTES, hi)]]
            before = np.concatenate([tail[-1:] if len(tail) else np.zeros(1, np.uint8), low[:-1]])
            low = np.concatenate([tail, low[(low != 0x20) | (before != 0x20)]])
            out[d] += (_hashed(low, np.zeros(len(low), np.int64), 1) - _hashed(tail, np.zeros(len(tail), np.int64), 1))[0]
            tail = low[-2:]
    return out


def _styles(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows: texts; columns: shares of kinds of characters, lengths of words and text, distinct words and pairs of words."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * 6 + _KIND[raw], minlength=n * 6).reshape(n, 6)[:, 1:] / size[:, None]
    starts, ends, first = word_spans(raw, offsets)
    words, of = np.diff(first), np.repeat(np.arange(n), np.diff(first))
    h = word_hashes(raw, starts, ends)
    pair = h[:-1] * np.uint64(31) + h[1:]
    of_pair = of[:-1][of[1:] == of[:-1]] if len(of) else of
    pair = pair[of[1:] == of[:-1]] if len(of) else h

    def distinct(h, of):
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
        return np.bincount(of[new], minlength=n)

    some = np.maximum(words, 1)
    mean = np.bincount(of, ends - starts, minlength=n) / some
    after = np.bincount(of, (_KIND[raw[ends - 1]] == 3) if len(ends) else None, minlength=n) / some  # words that punctuation ends
    return np.column_stack([kinds, np.log1p(words), mean, after, distinct(h, of) / some, distinct(pair, of_pair) / np.maximum(words - 1, 1)])


def _features(column: pa.Array):
    """(first row, features) of steps of the column: counts' roots at unit length, then styles."""
    for row, raw, offsets in text_slices(column):
        for i in range(0, len(offsets) - 1, _STEP_ROWS):
            part = offsets[i : i + _STEP_ROWS + 1]
            some, at = raw[part[0] : part[-1]], part - part[0]
            x = np.sqrt(_grams(some, at).astype(np.float32))
            yield row + i, np.column_stack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), _styles(some, at)]).astype(np.float32)


def fit_pairs(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-(w . (b - c)))) over all pairs (b, c) plus ridge * |w|^2 / 2; truncated Newton."""
    w, pairs = np.zeros(better.shape[1], np.float64), len(better) * len(worse)

    def gaps(v):
        return np.subtract.outer((better @ v), (worse @ v))

    def back(m):  # the sum of m times the feature differences of the pairs
        return (m.sum(axis=1) @ better - m.sum(axis=0) @ worse).astype(np.float64)

    def value(w, gap):
        return float(np.logaddexp(0, -gap).sum()) / pairs + ridge / 2 * float(w @ w)

    gap = gaps(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(gap, -30, 30)))  # how much each preference is missed
        grad = ridge * w - back(p) / pairs
        if float(grad @ grad) < 1e-12:
            break
        curve = p * (1 - p)
        step, r = np.zeros_like(w), -grad
        d, rr = r.copy(), float(r @ r)
        for _ in range(20):
            hd = ridge * d + back(curve * gaps(d)) / pairs
            a = rr / max(float(d @ hd), 1e-30)
            step += a * d
            r = r - a * hd
            new = float(r @ r)
            if new < 1e-4 * float(grad @ grad):
                break
            d, rr = r + (new / rr) * d, new
        size, before, along = 1.0, value(w, gap), gaps(step)
        while size > 1e-3 and value(w + size * step, gap + size * along) > before:
            size /= 2
        w, gap = w + size * step, gap + size * along
    return w


def quantile(utility: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The middle of the gap below which ``share`` of the weight lies."""
    order = np.argsort(utility, kind="stable")
    u, below = utility[order], np.cumsum(weight[order])
    k = min(int(np.searchsorted(below, share * below[-1] * (1 - 1e-9))), len(u) - 1)
    return float(u[k] + u[min(k + 1, len(u) - 1)]) / 2


def _slope(distance: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The slope of the logistic curve through the threshold."""
    a, shift = 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * distance + shift, -30, 30)))
        g = float((weight * (label - p) * distance).sum()) - 1e-2 * a
        h = float((weight * p * (1 - p) * distance**2).sum()) + 1e-2
        a = min(10.0, max(0.1, a + g / h))
    return a


def _near(u: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The first of four grid points about each utility, and the weights of cubic interpolation between the four."""
    at = np.floor(u / step)
    t = u / step - at
    weights = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6])
    return at.astype(np.int64) - 1, weights


def _on_grid(u: np.ndarray, step: float) -> tuple[int, np.ndarray]:
    """The first grid point with weight, and the weights from it on."""
    first, weights = _near(u, step)
    lo = int(first.min())
    return lo, sum(np.bincount(first - lo + k, weights[k], minlength=int(first.max()) - lo + 4) for k in range(4))


def _off_grid(u: np.ndarray, lo: int, values: np.ndarray, step: float) -> np.ndarray:
    """Values at the utilities, between grid points from ``lo`` on."""
    first, weights = _near(u, step)
    first = np.clip(first - lo, 0, len(values) - 4)
    return sum(weights[k] * values[first + k] for k in range(4))


def minimise(value, gradient, w: np.ndarray, small: float, calls: int, memory: int = 12) -> np.ndarray:
    """L-BFGS from ``w`` until the gradient is as ``small`` as this, or for so many ``calls`` of ``value`` and ``gradient``."""
    here, grad, past = value(w), gradient(w), []
    calls -= 2
    while calls > 0 and float(grad @ grad) > small**2:
        d, alphas = -grad, []
        for ds, dg in reversed(past):
            alphas.append(float(ds @ d) / float(ds @ dg))
            d = d - alphas[-1] * dg
        if past:
            ds, dg = past[-1]
            d = d * (float(ds @ dg) / float(dg @ dg))
        for (ds, dg), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - float(dg @ d) / float(ds @ dg)) * ds
        size, along = 1.0, float(grad @ d)
        while calls > 0:
            there, calls = value(w + size * d), calls - 1
            if there <= here + 1e-4 * size * along + 1e-9 or size < 1e-6:
                break
            size /= 2
        new, calls = gradient(w + size * d), calls - 1
        if float(size * d @ (new - grad)) > 0:
            past = [*past, (size * d, new - grad)][-memory:]
        w, here, grad = w + size * d, there, new
    return w


class Ranker:
    """Weights over scaled features, the threshold and the slope; or a constant score."""

    def __init__(self, weights: np.ndarray, threshold: float, slope: float, constant: float | None = None):
        self.weights, self.threshold, self.slope, self.constant = weights, threshold, slope, constant

    @classmethod
    def train(cls, x: np.ndarray, label: np.ndarray, shares: dict[int, float]) -> Ranker:
        """From features, labels (0 or 1) and the share of each label among all labelled documents."""
        scale = np.ones(x.shape[1])
        scale[DIMENSIONS:] = 1 / np.maximum(4 * x[:, DIMENSIONS:].std(axis=0), 1e-6)
        x = (x * scale).astype(np.float32)
        w = fit_pairs(x[label == 1], x[label == 0])
        weight = np.where(label == 1, shares[1] / max((label == 1).sum(), 1), shares[0] / max((label == 0).sum(), 1))
        u = x @ w.astype(np.float32)
        at = quantile(u.astype(float), weight, shares[0] / (shares[0] + shares[1]))
        return cls(w * scale, at, _slope(u - at, label, weight * len(label) / weight.sum()))

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Utilities and scores."""
        if self.constant is not None:
            return np.zeros(len(x)), np.full(len(x), self.constant)
        u = x.astype(np.float64) @ self.weights
        p = 1 / (1 + np.exp(-np.clip(self.slope * (u - self.threshold), -30, 30)) * (1 - THRESHOLD) / THRESHOLD)
        return u, np.where(u >= self.threshold, np.maximum(p, THRESHOLD), np.minimum(p, np.nextafter(THRESHOLD, 0)))  # whatever rounding does


def _fit_task(texts: DataFrame, count: dict[int, int]) -> Ranker:
    """From all rows (doc_id, quality, text), by one task; rows that repeat an id count once."""

    def features(batches):
        for b in batches:
            for row, x in _features(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(x)), b.column("quality").slice(row, len(x)), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "quality", "x"])

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")  # the same weights in whatever order rows come
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(table.num_rows, -1)
        model = Ranker.train(x, table.column("quality").to_numpy(), {0: float(count[0]), 1: float(count[1])})
        return pa.table({"w": pa.array([model.weights.tobytes()], pa.binary()), "at": [model.threshold], "slope": [model.slope]})

    sample = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).mapInArrow(features, "doc_id long, quality int, x binary")
    got = sample.groupBy(F.lit("all")).applyInArrow(train, "w binary, at double, slope double").first()  # 33 KB
    return Ranker(np.frombuffer(got["w"], np.float64), got["at"], got["slope"])


#: A labelled row: buckets that aren't empty, their features, and measures of style.
ROWS = "quality int, bucket binary, share binary, style binary"


def _sparse(batches):
    for b in batches:
        for row, x in _features(b.column("text")):
            grams, at = x[:, :DIMENSIONS], [np.flatnonzero(v) for v in x[:, :DIMENSIONS]]
            columns = [i.astype(np.uint16).tobytes() for i in at], [v[i].tobytes() for v, i in zip(grams, at, strict=True)], [v.tobytes() for v in x[:, DIMENSIONS:]]
            yield pa.RecordBatch.from_arrays([b.column("quality").slice(row, len(x)), *(pa.array(c, pa.binary()) for c in columns)], names=["quality", "bucket", "share", "style"])


def _batch(b: pa.RecordBatch):
    """(labels, row, bucket and share of each filled bucket, styles) of a batch of ``ROWS``."""
    bucket, share, style = (b.column(c).to_pylist() for c in ("bucket", "share", "style"))
    row = np.repeat(np.arange(len(bucket)), [len(x) // 2 for x in bucket])
    styles = np.frombuffer(b"".join(style), np.float32).reshape(len(style), STYLES).astype(np.float64)
    return b.column("quality").to_numpy(), row, np.frombuffer(b"".join(bucket), np.uint16).astype(np.int64), np.frombuffer(b"".join(share), np.float32).astype(np.float64), styles


def _utilities(w: np.ndarray, row: np.ndarray, bucket: np.ndarray, share: np.ndarray, styles: np.ndarray) -> np.ndarray:
    return np.bincount(row, share * w[bucket], minlength=len(styles)) + styles @ w[DIMENSIONS:]


def _fit_passes(scratch: Scratch, rows: DataFrame, count: dict[int, int], guess: Ranker) -> Ranker:
    """From all ``rows``, starting at ``guess``; every pass gives the driver one row of bounded size a task."""
    pairs, n = float(count[0]) * count[1], float(count[0] + count[1])

    def of_tasks(task) -> list:
        return rows.mapInArrow(task, "x binary, y binary, lo long").collect()

    def row(x, y, lo=0):
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()), pa.array([lo], pa.int64())], names=["x", "y", "lo"])

    def moments(batches):
        total, square, span = np.zeros(STYLES), np.zeros(STYLES), np.array([np.inf, -np.inf])
        for b in batches:
            _, *x = _batch(b)
            u = _utilities(guess.weights, *x)
            total, square = total + x[-1].sum(axis=0), square + (x[-1] ** 2).sum(axis=0)
            span = np.array([min(span[0], u.min(initial=np.inf)), max(span[1], u.max(initial=-np.inf))])
        yield row(np.concatenate([total, square]), span)

    got = of_tasks(moments)
    total, square = np.sum([np.frombuffer(r["x"]) for r in got], axis=0).reshape(2, STYLES)
    span = np.array([np.frombuffer(r["y"]) for r in got])
    scale = np.ones(DIMENSIONS + STYLES)
    scale[DIMENSIONS:] = 1 / np.maximum(4 * np.sqrt(np.maximum(square / n - (total / n) ** 2, 0)), 1e-6)
    step = max(GRID, float(span[:, 1].max() - span[:, 0].min()) / POINTS)
    grids: dict[bytes, tuple[int, np.ndarray, np.ndarray]] = {}

    def grid(w) -> tuple[int, np.ndarray, np.ndarray]:
        """The first grid point, and the weights of label 0 and label 1 from it on."""
        if w.tobytes() not in grids:
            v = w * scale

            def task(batches):
                found = []
                for b in batches:
                    label, *x = _batch(b)
                    u = _utilities(v, *x)
                    found += [(k, *_on_grid(u[label == k], step)) for k in (0, 1) if (label == k).any()]
                if found:
                    lo = min(f[1] for f in found)
                    out = np.zeros((2, max(f[1] + len(f[2]) for f in found) - lo))
                    for k, first, weights in found:
                        out[k, first - lo : first - lo + len(weights)] += weights
                    yield row(out[0], out[1], lo)

            got = of_tasks(task)
            lo = min(r["lo"] for r in got)
            out = np.zeros((2, max(r["lo"] + len(r["x"]) // 8 for r in got) - lo))
            for r in got:
                for k, c in enumerate("xy"):
                    weights = np.frombuffer(r[c])
                    out[k, r["lo"] - lo : r["lo"] - lo + len(weights)] += weights
            grids.clear()
            grids[w.tobytes()] = lo, out[0], out[1]
        return grids[w.tobytes()]

    def convolved(f, weights):
        """f(t - s) at every grid point t, summed over grid points s by their weights."""
        points = np.arange(len(weights)) * step
        return np.concatenate([f(np.subtract.outer(points[i : i + 256], points)) @ weights for i in range(0, len(points), 256)])

    def value(w):
        _, worse, better = grid(w)
        return float(better @ convolved(lambda gap: np.logaddexp(0, -gap), worse)) / pairs + RIDGE / 2 * float(w @ w)

    def gradient(w):
        lo, worse, better = grid(w)
        sigmoid = lambda gap: 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
        slopes = convolved(lambda gap: sigmoid(gap), better) / pairs, -convolved(lambda gap: sigmoid(-gap), worse) / pairs  # of label 0, of label 1
        v = w * scale

        def task(batches):
            out = np.zeros(DIMENSIONS + STYLES)
            for b in batches:
                label, at, bucket, share, styles = _batch(b)
                u = _utilities(v, at, bucket, share, styles)
                m = np.where(label == 1, _off_grid(u, lo, slopes[1], step), _off_grid(u, lo, slopes[0], step))
                out[:DIMENSIONS] += np.bincount(bucket, share * m[at], minlength=DIMENSIONS)
                out[DIMENSIONS:] += m @ styles
            yield row(out, np.zeros(0))

        return np.sum([np.frombuffer(r["x"]) for r in of_tasks(task)], axis=0) * scale + RIDGE * w

    # The loss is convex, and RIDGE more than flat: it is within |gradient| ** 2 / (2 * RIDGE) of the least.
    weights = minimise(value, gradient, guess.weights / scale, float(np.sqrt(2 * RIDGE * EXCESS)), MAX_PASSES) * scale

    def utilities(batches):
        for b in batches:
            label, *x = _batch(b)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(_utilities(weights, *x))], names=["quality", "u"])

    u = scratch.table(rows.mapInArrow(utilities, "quality int, u double"), free=True)
    threshold = (_smallest(u, count[0]) + _smallest(u, count[0] + 1)) / 2
    distance, slope, shift = F.col("u") - threshold, 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD)))
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * distance + shift))))
        g, h = u.agg(F.sum((F.col("quality") - p) * distance), F.sum(p * (1 - p) * distance**2)).first()
        before, slope = slope, min(10.0, max(0.1, slope + (g - 1e-2 * slope) / (h + 1e-2)))
        if abs(slope - before) < 1e-9:
            break
    return Ranker(weights, threshold, slope)


def _smallest(u: DataFrame, k: int) -> float:
    """The k-th smallest ``u`` (from 1), by counts in 1,024 ranges of the range that has it."""
    lo, hi = u.agg(F.min("u"), F.max("u")).first()
    below = 0  # rows less than lo
    while hi > lo:
        width = (hi - lo) / 1024
        part = F.least(F.lit(1023), F.floor((F.col("u") - lo) / width)) if width > 0 else F.lit(0)
        parts = u.filter(F.col("u").between(lo, hi)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")).orderBy("part").collect()
        for r in parts:
            if below + r["n"] >= k:
                break
            below += r["n"]
        lo, hi = r["lo"], r["hi"]
    return float(lo)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_sample: int = MAX_SAMPLE) -> Ranker:
    """Learn from labelled documents for which ``learn`` (over doc_id) holds."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(ids, "doc_id", "left_semi")
    scratch = Scratch(docs.sparkSession, "labels")
    known = scratch.table(known)
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    if len(count) < 2:
        return Ranker(np.zeros(DIMENSIONS + STYLES), 0.0, 1.0, float(next(iter(count), 0.5)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if sum(count.values()) <= max_sample:
        return _fit_task(texts.join(F.broadcast(known), "doc_id"), count)
    quota = max(1, max_sample // 2)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    rate = F.when(F.col("quality") == 1, (2.0 * quota + 50) / count[1]).otherwise((2.0 * quota + 50) / count[0])
    rank = F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))
    chosen = known.withColumn("h", h).filter(F.col("h") < rate).withColumn("k", rank).filter(F.col("k") <= quota).select(F.col("doc_id").alias("i"), "quality")
    guess = _fit_task(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("i")), count)  # at most max_sample ids
    texts = texts.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = scratch.table(texts.select("doc_id", "quality", "text").mapInArrow(_sparse, ROWS), free=True)
    return _fit_passes(scratch, rows, count, guess)


def rank_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``docs`` with utility and score; at ``THRESHOLD`` and above a document is as good as those labelled 1."""
    Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels, F.lit(True) if learn is None else learn, max_sample)
    kept, read = [c for c in docs.columns if c.lower() not in (_UTILITY, _SCORE)], fresh(docs, "text")

    def run(batches):
        for b in batches:
            utility, score = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for row, x in _features(b.column(read)):
                utility[row : row + len(x)], score[row : row + len(x)] = model.scores(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(utility), pa.array(score)], names=[*kept, _UTILITY, _SCORE])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(_UTILITY, T.DoubleType()), T.StructField(_SCORE, T.DoubleType())])
    return docs.select(*kept, F.col("text").cast("string").alias(read)).mapInArrow(run, schema)
