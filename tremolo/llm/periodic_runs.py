"""Periodic run detection by recursive frequency splitting.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of consecutive words with smallest period q (words
q apart are identical) and length >= max(min_words, repeats * q) that no neighbouring word extends keeping period q.

Each word of a run occurs at least ``repeats`` times in it.  So a word that occurs more rarely in its segment (at first
the document) belongs to no run and splits the segment; segments are split again until none of their words is
rare, and those shorter than ``min_words`` go.  No run crosses a split.  The lag scan then takes the segments that
survive, lag by lag: a run of lag q covers ``repeats`` places in a row that are multiples of q from the segment's
start, so only places with that many equal words are extended, to both sides until words q apart differ.  That is
sum(n / q) = n log n tests.  A place inside a run of a smaller period is passed over: the stretch has that period.

Defined results
* null, empty or blank text: no words, no runs, collapsed text ''.
* a word is dropped if any run contains it after that run's first q words.
* rows that repeat, or repeat a doc_id, and a null doc_id: each row on its own.  No rows give no rows; extra columns
  are not read.  Overlapping runs of several periods are all reported, by start, then period.
* a very long text is one step: about 40 bytes a byte of text for its words and their numbers.

Rows are judged one by one, so no key can be hot.  ``ROUNDS`` bounds the splitting of texts made to split word by
word; what isn't stable then is scanned as it is, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import _SEP, text_slices, word_spans

#: Text bytes of a step, and rounds of splitting.
STEP, ROUNDS = 1 << 20, 200
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SHAPE = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"


def stable_segments(ids: np.ndarray, first: np.ndarray, min_words: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (start, end) of what frequency splitting leaves of the documents that begin at ``first`` (plus the end)."""
    done = []
    segments = np.column_stack([first[:-1], first[1:]])
    for step in range(ROUNDS + 1):
        segments = segments[segments[:, 1] - segments[:, 0] >= min_words]
        if not len(segments) or step == ROUNDS:
            break
        size = segments[:, 1] - segments[:, 0]
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(segments)), size)
        at = np.arange(ends[-1]) + (segments[:, 0] - (ends - size))[which]
        key = which * (int(ids.max()) + 1) + ids[at]
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        count = np.diff(np.append(heads, len(key)))
        rare = np.zeros(len(key), bool)
        rare[order] = np.repeat(count < repeats, count)
        split = np.bincount(which[rare], minlength=len(segments)) > 0
        done.append(segments[~split])
        left = ~rare & split[which]
        at, which = at[left], which[left]
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1])])) if len(at) else np.zeros(0, np.int64)
        segments = np.column_stack([at[head], at[np.append(head[1:], len(at)) - 1] + 1]) if len(at) else segments[:0]
    return np.concatenate([*done, segments])


def _extent(ids: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around ``at`` inside [low, high) of which words ``lag`` apart are equal."""
    start, end, step = at, at + lag, 64
    while end < high:
        stop = min(end + step, high)
        off = ids[end:stop] != ids[end - lag : stop - lag]
        if off.any():
            end += int(off.argmax())
            break
        end, step = stop, 2 * step
    step = 64
    while start > low:
        stop = max(start - step, low)
        off = (ids[stop:start] != ids[stop + lag : start + lag])[::-1]
        if off.any():
            start -= int(off.argmax())
            break
        start, step = stop, 2 * step
    return start, end


def lag_scan(ids: np.ndarray, segments: np.ndarray, min_words: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs inside the segments, by period."""
    runs: list[tuple[int, int, int]] = []
    if not len(segments):
        return runs
    size = segments[:, 1] - segments[:, 0]
    order = np.argsort(-size, kind="stable")
    segments, size = segments[order], size[order]
    reach = np.zeros(len(ids) + 1, np.int64)  # for each word, the furthest end of a run that holds it
    for lag in range(1, int(size[0]) // repeats + 1):
        n = int(np.searchsorted(-size, -max(min_words, repeats * lag), "right"))
        if not n:
            break
        count = (size[:n] - 1) // lag - repeats + 2
        ends = np.cumsum(count)
        which = np.repeat(np.arange(n), count)
        at = (np.arange(ends[-1]) - (ends - count)[which]) * lag + segments[which, 0]
        ok = ids[at] == ids[at + lag]
        at, which = at[ok], which[ok]
        for j in range(1, repeats - 1):
            ok = ids[at + j * lag] == ids[at + (j + 1) * lag]
            at, which = at[ok], which[ok]
        for d in {1, lag // 2, lag - 1} - {0, lag}:  # places between, before words are compared one by one
            ok = ids[at + d] == ids[at + d + lag]
            at, which = at[ok], which[ok]
        ok = reach[at] <= at + (repeats - 1) * lag
        last, past = -1, 0
        for x, s in zip(at[ok].tolist(), which[ok].tolist(), strict=True):
            if s == last and x + lag <= past:  # inside the stretch before
                continue
            start, end = _extent(ids, x, lag, int(segments[s, 0]), int(segments[s, 1]))
            last, past = s, end
            if end > x + (repeats - 1) * lag and end - start >= max(min_words, repeats * lag):  # all places lie in it
                runs.append((start, end - start, lag))
                np.maximum(reach[start:end], end, out=reach[start:end])
    return runs


def _collapse(words: pa.Array, first: np.ndarray, runs: list[tuple[int, int, int]]) -> pa.Array:
    """The words that no run repeats, joined by one space."""
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    kept = np.cumsum(inside)[:-1] == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    rest = words.filter(pa.array(kept)) if runs else words
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(before[first]), rest), pa.scalar(b" ", pa.large_binary()))


def _detect(min_words: int, repeats: int):
    def run(batches):
        for b in batches:
            for row, raw, offsets in text_slices(b.column("text"), STEP):
                starts, ends, first = word_spans(raw, offsets)
                cuts = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=cuts[1:])
                words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[~_SEP[raw]])])
                ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found = lag_scan(ids, stable_segments(ids, first, min_words, repeats), min_words, repeats)
                text = _collapse(words, first, found)
                doc = np.searchsorted(first, [s for s, _, _ in found], "right") - 1
                rows: list[list] = [[] for _ in range(len(first) - 1)]
                for (start, length, period), d in sorted(zip(found, doc.tolist(), strict=True), key=lambda x: (x[0][0], x[0][2])):
                    rows[d].append({"start": start - int(first[d]), "length": length, "period": period})
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, len(rows)), pa.array(np.diff(first)), pa.array(rows, pa.list_(_RUN)), text.cast(pa.large_string()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed_text"],
                )

    return run


def periodic_runs(docs: DataFrame, min_words: int = 6, repeats: int = 4) -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_text."""
    if repeats < 3:
        raise ValueError("a run repeats its period three times at least")
    Scratch(docs.sparkSession, "runs")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(_detect(min_words, repeats), _SHAPE)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id and text; a tenth of the texts repeats some of its words to its end.

    With h = crc32(doc_id) and g = h / 10, and h % 10 = 0, each of the n words i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) / (3 + g % 8), in whole numbers.
    """
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.expr("crc32(cast(doc_id as string))")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("w", F.when((h % 10 == 0) & F.col("text").isNotNull(), words)).withColumn("n", F.size("w"))
    d = d.withColumn("g", F.call_function("div", h, F.lit(10))).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    d = d.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.flatten(F.expr("array_repeat(slice(w, a + 1, p), cast((n - a) div p + 1 as int))"))
    new = F.concat_ws(" ", F.slice(F.concat(F.expr("slice(w, 1, a)"), tail), F.lit(1), F.col("n")))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: least start, then period) and SHA-256 of the runs and of the collapsed text."""
    best = F.when(F.size("runs") > 0, F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.withColumn("best", best)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed_text", "UTF-8"), 256).alias("collapsed_sha256"),
    )
