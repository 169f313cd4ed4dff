"""Language ID by hierarchical discrimination.

Level 1 predicts the language family with one-versus-rest linear support vector machines; level 2 tells
the closely related languages inside that family apart with one-versus-one machines.  Features are hashed
byte n-grams (1 to 4, lower case, non-letters as one space) of the whole text.

The machines are fitted on a bounded sample of labelled rows (``max_sample`` or one for each language,
dealt evenly over the languages in the order of a hash of the id), each machine by a Spark task over the
broadcast sample; prediction reads nothing but the text.  All labelled languages are learned.

Defined results
* null text, or a text without a letter: ``und`` with score 1.0.
* null lang: not learned from.  Null doc_id: not learned from, ``held_out`` false, predicted like any other.
* no labelled row: every text with a letter is ``und`` with score 0.0.  One language: that one.
* ties between languages: the larger sum of margins, then the first by code point.
* rows that repeat a doc_id and lang count once in the sample, with the least text; all rows are predicted one by one.
* no rows give no rows; extra columns pass through unread (lang_pred and score are replaced).
* very long texts are counted in pieces; a task holds the text itself about three times.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh
from .words import STEP_BYTES, text_slices

#: Labelled documents that the machines are fitted on, at most (one for each language if there are more languages).
MAX_SAMPLE = 3000
#: Hash buckets of the n-grams.
DIMENSIONS = 1 << 12
#: Texts that are counted in one step.
_STEP_ROWS = 256

# Well-known language codes by family; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la rm",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indic": "hi bn pa gu mr ne si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv su",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], "=" + lang)


# ---------------------------------------------------------------- features
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _folded(raw: np.ndarray, before: int = 0x20) -> np.ndarray:
    """Letters in lower case, all else as spaces; ``before`` is the byte in front."""
    low = _FOLD[raw]
    ahead = np.concatenate([[before], raw[:-1]])  # accented capitals of Latin-1
    low[(ahead == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    return low


def _grams(low: np.ndarray, doc: np.ndarray, texts: int, old: int = 0) -> np.ndarray:
    """Rows: texts; columns: hashed n-gram counts of those that end behind the first ``old`` characters."""
    out = np.zeros(texts * DIMENSIONS, np.int64)
    low, gram = low.astype(np.int64), np.zeros(len(low), np.int64)
    for k in range(1, 5):
        n = len(low) - k + 1
        if n <= 0:
            break
        gram = gram[:n] * 256 + low[k - 1 :]
        h = ((gram + k * 0x51ED27) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
        ink = (gram != 0x20) & (doc[:n] == doc[k - 1 :])
        ink[: max(0, old - k + 1)] = False
        out += np.bincount(doc[:n][ink] * DIMENSIONS + h[ink], minlength=len(out))
    return out.reshape(-1, DIMENSIONS)


def _counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows: texts; columns: hashed n-gram counts.  A run of spaces is one space."""
    if len(raw) <= 2 * STEP_BYTES:
        low, doc = _folded(raw), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20) | (doc[1:] != doc[:-1])
        return _grams(low[keep], doc[keep], len(offsets) - 1)
    rows = []  # long texts, in pieces that go on with the last characters of the one before
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        total, tail = np.zeros((1, DIMENSIONS), np.int64), np.zeros(0, np.uint8)
        for at in range(lo, hi, STEP_BYTES):
            low = _folded(raw[at : min(at + STEP_BYTES, hi)], int(raw[at - 1]) if at > lo else 0x20)
            ahead = np.concatenate([tail[-1:] if len(tail) else [0], low[:-1]])
            low = np.concatenate([tail, low[(low != 0x20) | (ahead != 0x20)]])
            total += _grams(low, np.zeros(len(low), np.int64), 1, len(tail))
            tail = low[-3:]
        rows.append(total)
    return np.concatenate(rows)


def _features(column: pa.Array):
    """(first row, features of unit length) of steps of the column."""
    for row, raw, offsets in text_slices(column):
        for i in range(0, len(offsets) - 1, _STEP_ROWS):
            part = offsets[i : i + _STEP_ROWS + 1]
            x = np.sqrt(_counts(raw[part[0] : part[-1]], part - part[0]).astype(np.float32))
            yield row + i, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)


# ---------------------------------------------------------------- fitting
def _svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 8) -> np.ndarray:
    """Weights (last: bias) that minimise |w|^2/2 + c * squared hinge; truncated Newton.  Rows with y = 0 don't count."""
    cost = np.where(y > 0, 50 * c / max(1, int((y > 0).sum())), 50 * c / max(1, int((y < 0).sum()))).astype(np.float32)
    cost[y == 0] = 0
    w = np.zeros(x.shape[1] + 1, np.float32)
    over = lambda v: x @ v[:-1] + v[-1]
    under = lambda u: np.append(u @ x, u.sum())

    def value(w, m):
        return 0.5 * float(w @ w) + float((cost * np.maximum(0, 1 - y * m) ** 2).sum())

    m = over(w)
    for _ in range(steps):
        active = (y * m < 1).astype(np.float32) * cost
        grad = w + 2 * under(active * (m - y))
        step, r = np.zeros_like(w), -grad
        p, rr = r.copy(), float(r @ r)
        if rr < 1e-8:
            break
        for _ in range(10):
            hp = p + 2 * under(active * over(p))
            a = rr / max(float(p @ hp), 1e-20)
            step += a * p
            r = r - a * hp
            new = float(r @ r)
            if new < 1e-4 * rr and new < 1e-6:
                break
            p, rr = r + (new / rr) * p, new
        size, before, ms = 1.0, value(w, m), over(step)
        while size > 1e-3 and value(w + size * step, m + size * ms) > before:
            size /= 2
        w, m = w + np.float32(size) * step, m + np.float32(size) * ms
    return w.astype(np.float32)


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve over the margins."""
    a = 1.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * margin * y, -30, 30)))
        g = float(((1 - p) * margin * y).sum()) - 1e-2 * a
        h = float((p * (1 - p) * margin**2).sum()) + 1e-2
        a = min(20.0, max(0.1, a + g / h))
    return a


class Hierarchy:
    """Families, then the languages of each family, by linear machines."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(k) for k in self.langs})
        self.members = [[k for k in self.langs if family(k) == f] for f in self.families]
        self.duels = [[(i, j) for i in range(len(m)) for j in range(i + 1, len(m))] for m in self.members]
        self.top, self.pairs = None, [None] * len(self.families)

    def machines(self) -> list[tuple[str, str]]:
        """(yes, no) of every machine: languages, or families with ``no`` = '*' for all others."""
        out = [("/" + f, "*") for f in self.families] if len(self.families) > 1 else []
        return out + [(m[i], m[j]) for m, duels in zip(self.members, self.duels, strict=True) for i, j in duels]

    @staticmethod
    def fit_one(x: np.ndarray, langs: np.ndarray, yes: str, no: str) -> tuple[np.ndarray, float]:
        if no == "*":
            y = np.where(np.array(["/" + family(k) for k in langs]) == yes, 1.0, -1.0)
        else:
            y = np.where(langs == yes, 1.0, np.where(langs == no, -1.0, 0.0))
        y = y.astype(np.float32)
        w = _svm(x, y)
        rows = y != 0
        return w, _slope((x @ w[:-1] + w[-1])[rows], y[rows])

    def take(self, fitted: dict[tuple[str, str], tuple[np.ndarray, float]]) -> None:
        """The machines' weights and slopes, once they are fitted."""
        stack = lambda keys: (np.array([fitted[k][0] for k in keys], np.float32), np.array([fitted[k][1] for k in keys]))
        if len(self.families) > 1:
            self.top = stack([("/" + f, "*") for f in self.families])
        self.pairs = [stack([(m[i], m[j]) for i, j in duels]) if duels else None for m, duels in zip(self.members, self.duels, strict=True)]

    @staticmethod
    def _margins(x, fitted):
        w, slopes = fitted
        m = x @ w[:, :-1].T + w[:, -1]
        return m, 1 / (1 + np.exp(-np.clip(m * slopes, -30, 30)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if self.top is None:
            at, p = np.zeros(n, int), np.ones(n)
        else:
            m, q = self._margins(x, self.top)
            at = m.argmax(axis=1)
            p = q[np.arange(n), at] / q.sum(axis=1)
        out, score = np.empty(n, object), p.astype(float)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(at == f)
            duels, fitted = self.duels[f], self.pairs[f]
            if not duels or not len(rows):
                out[rows] = members[0]
                continue
            m, q = self._margins(x[rows], fitted)
            votes, sums, sure = (np.zeros((len(rows), len(members))) for _ in range(3))
            for k, (i, j) in enumerate(duels):
                win = m[:, k] >= 0
                votes[:, i] += win
                votes[:, j] += ~win
                sums[:, i] += m[:, k]
                sums[:, j] -= m[:, k]
                sure[:, i] += q[:, k]
                sure[:, j] += 1 - q[:, k]
            best = np.lexsort((-np.arange(len(members)) * np.ones_like(sums), sums, votes), axis=1)[:, -1]
            out[rows] = np.array(members, object)[best]
            score[rows] *= sure[np.arange(len(rows)), best] / (len(members) - 1)
        return list(out), np.clip(score, 0.0, 1.0)


def fit(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Hierarchy | None:
    """Learn from documents whose crc32(doc_id as text) mod 5 isn't 0 and whose lang isn't null."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    lean = lean.filter("lang is not null and crc32(cast(doc_id as string)) % 5 != 0")
    counts = lean.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return None
    quota = max(1, max_sample // len(counts))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    rates = docs.sparkSession.createDataFrame([(r["lang"], (2.0 * quota + 50) / r["count"]) for r in counts], "lang string, rate double")
    near = lean.join(F.broadcast(rates), "lang").withColumn("h", h).filter(F.col("h") < F.col("rate"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.withColumn("k", rank).filter(F.col("k") <= quota).select(F.col("doc_id").alias("i"), F.col("lang").alias("l")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")))
    texts = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")  # at most max_sample ids

    def run(batches):
        for b in batches:
            lettered = _lettered(b.column("text"))
            for row, x in _features(b.column("text")):
                ok = lettered[row : row + len(x)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").slice(row, len(x)).filter(pa.array(ok)), pa.array([v.astype(np.float16).tobytes() for v in x[ok]], pa.binary())], names=["lang", "x"]
                )

    rows = texts.mapInArrow(run, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    # The same machines in whatever order rows come.
    sample = sorted(zip(rows.column("lang").to_pylist(), rows.column("x").to_pylist(), strict=True))
    del rows
    langs, model = [k for k, _ in sample], Hierarchy([k for k, _ in sample])
    sent = docs.sparkSession.sparkContext.broadcast((langs, b"".join(x for _, x in sample)))
    del sample

    def train(batches):
        known, blob = sent.value
        x = np.frombuffer(blob, np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
        for b in batches:
            done = [Hierarchy.fit_one(x, np.array(known, object), *pair) for pair in zip(b.column("yes").to_pylist(), b.column("no").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("yes"), b.column("no"), pa.array([w.tobytes() for w, _ in done], pa.binary()), pa.array([float(a) for _, a in done])], names=["yes", "no", "w", "slope"])

    todo = model.machines()
    if todo:
        tasks = docs.sparkSession.createDataFrame(todo, "yes string, no string").repartition(min(len(todo), 1000))
        fitted = tasks.mapInArrow(train, "yes string, no string, w binary, slope double").collect()  # 16 KB a machine
        model.take({(r["yes"], r["no"]): (np.frombuffer(r["w"], np.float32), r["slope"]) for r in fitted})
    sent.destroy()
    return model


def identify(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``docs`` with lang_pred and score."""
    Scratch(docs.sparkSession, "lang")
    model = fit(docs, max_sample)
    kept, read = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")], fresh(docs, "text")

    def run(batches):
        for b in batches:
            texts = b.column(read)
            lettered = _lettered(texts)
            pred, score = np.full(len(texts), "und", object), np.where(lettered, 0.0, 1.0)
            if model is not None:
                for row, x in _features(texts):
                    names, p = model.predict(x)
                    ok = lettered[row : row + len(x)]
                    pred[row : row + len(x)] = np.where(ok, np.array(names, object), "und")
                    score[row : row + len(x)] = np.where(ok, p, 1.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(list(pred), pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # The prediction reads this one column; the others pass through.
    return docs.select(*kept, F.col("text").cast("string").alias(read)).mapInArrow(run, schema)
