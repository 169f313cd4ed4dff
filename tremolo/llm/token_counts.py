"""Token counts by count-only Viterbi over a unigram vocabulary.

Words (``[^\\x20\\x09-\\x0D]+``) are encoded one by one behind the word mark.  One Aho-Corasick automaton
lists every vocabulary match in a batch of distinct words; dynamic programming over positions carries the
best score and its number of pieces, nothing else.  Ties follow the tokenizer: of equal scores the path
whose last piece starts first stays; a character without a piece of its own may be unknown, at the least
score of the vocabulary less 10, and counts as its bytes (or, in a vocabulary without byte pieces, runs of
unknown characters count as one).

A vocabulary of a merge-based (BPE) model has merge ranks for scores: counts under it are those of the best-scored
segmentation, not of that model's own merges.  ``op9_token_counts`` uses such a file, as it is the public one at hand.

Defined results
* null text or no words: 0.  Null doc_id: an ordinary row.  Rows that repeat an id: one result row each.
* no rows: an empty result.  Extra columns are not read.

* very long texts: a task holds the text's words about three times; a word longer than ``STEP_CHARS`` is one program.

Each worker keeps the counts of the distinct words it has met, up to ``CACHE_WORDS``; no data is shuffled.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, kept

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a worker remembers (about 120 bytes each) from batch to batch and task to task.
CACHE_WORDS = 500_000
#: Characters that one dynamic program covers.
STEP_CHARS = 200_000


class Counter:
    """Counts of pieces by word, for one vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece and "\n" not in piece:
                scores[piece] = score
        self.scores = np.array(list(scores.values()) or [0.0])
        self.lengths = np.array([len(p) for p in scores] or [0])
        for i, piece in enumerate(scores):
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.known: dict[bytes, int] = {}

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each word (a word holds no line feed)."""
        if not words:
            return np.zeros(0, np.int64)
        text = "\n".join(MARK + w for w in words)
        size = np.array([len(w) + 1 for w in words])
        base = np.cumsum(size + 1) - size - 1
        owner = np.repeat(np.arange(len(words)), size + 1)[: len(text)]
        flat = np.fromiter((v for m in self.automaton.iter(text) for v in m), np.int64)
        end, piece = flat[0::2] + 1, flat[1::2]
        start, score = end - self.lengths[piece], self.scores[piece]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        single = points == 0x0A
        single[start[self.lengths[piece] == 1]] = True
        alone = np.flatnonzero(~single)
        width = np.array([len(text[i].encode("utf-8")) for i in alone], np.int64)
        start, end = np.concatenate([start, alone]), np.concatenate([end, alone + 1])
        score = np.concatenate([score, np.full(len(alone), self.unknown)])
        cost = np.concatenate([np.ones(len(piece), np.int64), width if self.bytes else np.full(len(alone), -1, np.int64)])
        # Position by position inside the words, all words at once; earlier starts first.
        depth = end - base[owner[start]]
        order = np.lexsort((start, end, depth))
        start, end, score, cost, depth = (x[order] for x in (start, end, score, cost, depth))
        best = np.zeros(len(text) + 2)
        pieces = np.zeros(len(text) + 2, np.int64)
        gap = np.zeros(len(text) + 2, bool)  # the best path ends with an unknown character
        edges = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if s == e:
                continue
            at, value = end[s:e], best[start[s:e]] + score[s:e]
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            top = np.maximum.reduceat(value, heads)
            first = np.where(value == np.repeat(top, np.diff(np.append(heads, e - s))), np.arange(e - s), e - s)
            pick = np.minimum.reduceat(first, heads)
            to, come, c = at[pick], start[s:e][pick], cost[s:e][pick]
            best[to] = top
            pieces[to] = pieces[come] + np.where(c >= 0, c, ~gap[come])
            gap[to] = c < 0
        return pieces[base + size]

    def learn(self, words: set[bytes]) -> None:
        part, chars = [], 0
        for w in sorted(words):
            part.append(w)
            chars += len(w)
            if chars > STEP_CHARS:
                self._add(part)
                part, chars = [], 0
        self._add(part)

    def _add(self, part: list[bytes]) -> None:
        self.known.update(zip(part, self.count([w.decode() for w in part]).tolist(), strict=True))


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    scratch = Scratch(docs.sparkSession, "tokens")
    shared = scratch.spark.sparkContext.broadcast(vocabulary)
    key = hashlib.sha256(repr(vocabulary).encode()).hexdigest()

    def run(batches):
        counter = kept(key, lambda: Counter(shared.value))
        for b in batches:
            texts = [(t or b"").split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            if len(counter.known) > CACHE_WORDS:
                counter.known.clear()
            known = counter.known
            counter.learn({w for words in texts for w in words if w not in known})
            n = [len(words) for words in texts]
            total = [sum([known[w] for w in words]) for words in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
