"""Substring dedup by repeated-phrase automata.

A window is ``width`` consecutive words of one document.  A word goes if a window that covers it also
starts in a document with a smaller doc_id; windows are judged on the input.

1. Documents with equal word sequences are found by digest: all but the first of a class repeat it wholly.
2. Of the rest, each window's least ``anchor``-word phrase (its minimiser) is counted over documents.
   Equal windows have equal minimisers, so only windows with a shared one can recur.
3. Those windows are hashed and counted: a window that occurs in two documents recurs.  Runs of them in
   the first document that holds them are the recurring passages, as words, not hashes.
4. Documents are dealt over shards.  A shard gets the passages that lead to it, compiles the phrases of
   them that its documents may repeat into Aho-Corasick automata over word numbers (``NODES`` words at a
   time) and streams its documents through them to locate every occurrence.  A hit is an exact equality
   of words, so a hash collision can't remove anything.  The passages of a shard go in parts of bounded size, each
   against all documents of the shard, and what parts mark in a document is put together afterwards.

Defined results
* null text: no words.  Fewer words than a window: nothing is removed.
* null doc_id: removes nothing and loses nothing.  Rows that repeat a doc_id don't remove from each other.
* no rows: an empty result.  Extra columns are not read.
* a very long text is one value of its shard: as text, and as word numbers of about 40 bytes a word.

Skew: a phrase that a third of all documents share is summed before the shuffle; its passage goes once to
each shard, not once to each document.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import gram_hashes, text_slices, word_hashes, word_spans

#: Words of a minimiser.
ANCHOR = 5
#: Text bytes of a shard.
SHARD_BYTES = 8 << 20
#: Passage bytes that a task takes at once: a shard with more of them is streamed once for each part.
PART_BYTES = 16 << 20
#: Words that one automaton holds, over all its phrases (about 100 bytes each).
NODES = 2_000_000
#: Rows (about 50 bytes each) up to which a list of ids is broadcast; beyond, it is joined by shuffle.
BROADCAST_IDS = 400_000


def _grams(raw: np.ndarray, offsets: np.ndarray, width: int):
    """Window hashes, the word each starts at, its document, and its minimiser."""
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    windows, at = gram_hashes(words, first, width)
    anchors, begins = gram_hashes(words, first, ANCHOR)
    if not len(at):
        return windows, at, np.zeros(0, np.int64), windows, first
    # A window that starts at word i holds the anchors that start at i .. i + width - ANCHOR.
    lookup = np.zeros(len(words) + 1, np.int64)
    lookup[begins] = np.arange(len(begins))
    base = lookup[at]
    least = anchors[base]
    for j in range(1, width - ANCHOR + 1):
        least = np.minimum(least, anchors[base + j])
    return windows, at, np.searchsorted(first, at, side="right") - 1, least, first


def _digest(batches):
    """n_words and SHA-256 of the words of each document."""
    for b in batches:
        n, sha = [], []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            words = (t or b"").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "th", "n_words", "sha"])


def _minimisers(width: int):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for row, raw, offsets in text_slices(b.column("text")):
                _, _, doc, least, _ = _grams(raw, offsets, width)
                new = np.ones(len(least), bool)  # neighbours mostly share theirs
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                least, doc = least[new], doc[new]
                order = np.lexsort((least, doc))
                least, doc = least[order], doc[order]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[row + doc[new]].astype(np.int64))], names=["phrase", "doc_id"])

    return run


def _windows(width: int):
    """Distinct windows of each document whose minimiser is shared."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            shared = b.column("phrases")
            for row, raw, offsets in text_slices(b.column("text")):
                windows, _, doc, least, _ = _grams(raw, offsets, width)
                edges = np.searchsorted(doc, np.arange(len(offsets)))
                for d in range(len(offsets) - 1):
                    s, e = edges[d], edges[d + 1]
                    mine = shared[row + d].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    got = np.unique(windows[s:e][np.isin(least[s:e], mine)])
                    yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(np.full(len(got), ids[row + d], np.int64))], names=["gram", "doc_id"])

    return run


def _passages(width: int):
    """Maximal runs of the windows that recur and are first met in this document."""

    def run(batches):
        for b in batches:
            ids, grams, texts = b.column("doc_id").to_pylist(), b.column("grams"), b.column("text").cast(pa.binary())
            for row, raw, offsets in text_slices(b.column("text")):
                windows, at, doc, _, first = _grams(raw, offsets, width)
                edges = np.searchsorted(doc, np.arange(len(offsets)))
                out: dict[str, list] = {"pid": [], "first": [], "words": [], "grams": []}
                for d in range(len(offsets) - 1):
                    s, e = edges[d], edges[d + 1]
                    mine = grams[row + d].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    hit = np.isin(windows[s:e], mine)
                    step = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    if not len(step):
                        continue
                    words = texts[row + d].as_py().split()
                    for i, j in zip(step[::2], step[1::2], strict=True):
                        out["pid"].append(f"{ids[row + d]}:{i}")
                        out["first"].append(ids[row + d])
                        out["words"].append(b" ".join(words[i : j + width - 1]).decode())
                        out["grams"].append(np.unique(windows[s + i : s + j]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["pid"], pa.string()), pa.array(out["first"], pa.int64()), pa.array(out["words"], pa.string()), pa.array(out["grams"], pa.list_(pa.int64()))], names=list(out)
                )

    return run


def _phrases(docs: pd.DataFrame, passages: pd.DataFrame, width: int) -> list[tuple[int, int, int]]:
    """(passage, first word, words) of the longest stretches of passages that the documents may repeat.

    Stretches are found by window hashes; whether a document really holds one is for the automata to say.
    """
    grams, owner, place = [], [], []
    for row, raw, offsets in text_slices(pa.array(passages["words"], pa.string())):
        starts, ends, first = word_spans(raw, offsets)
        g, at = gram_hashes(word_hashes(raw, starts, ends), first, width)
        d = np.searchsorted(first, at, side="right") - 1
        grams.append(g)
        owner.append(row + d)
        place.append(at - first[d])
    keys, where = np.unique(np.concatenate(grams), return_index=True)
    owner, place = np.concatenate(owner)[where], np.concatenate(place)[where]
    source, ids = passages["first"].to_numpy(np.int64), docs["doc_id"].to_numpy(np.int64)
    found: set[tuple[int, int, int]] = set()
    for row, raw, offsets in text_slices(pa.array(docs["text"], pa.string())):
        starts, ends, first = word_spans(raw, offsets)
        g, at = gram_hashes(word_hashes(raw, starts, ends), first, width)
        d = np.searchsorted(first, at, side="right") - 1
        j = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = np.flatnonzero((keys[j] == g) & (source[owner[j]] < ids[row + d]))
        if not len(hit):
            continue
        at, d, o, i = at[hit], d[hit], owner[j[hit]], place[j[hit]]
        cut = np.ones(len(hit), bool)
        cut[1:] = (np.diff(at) != 1) | (np.diff(d) != 0) | (np.diff(o) != 0) | (np.diff(i) != 1)
        s = np.flatnonzero(cut)
        n = np.diff(np.append(s, len(hit)))
        found.update(zip(o[s].tolist(), i[s].tolist(), (n + width - 1).tolist(), strict=True))
    return sorted(found)


def _locate(width: int):
    """Stream the shard's documents through the automata of its phrases."""

    def run(docs: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        phrases = _phrases(docs, passages, width) if len(docs) and len(passages) else []
        if phrases:
            number: dict[bytes, int] = {}
            used = {p for p, _, _ in phrases}
            words = passages["words"].to_numpy()
            texts = {p: [number.setdefault(w, len(number) + 1) for w in words[p].encode().split()] for p in used}
            streams = [tuple([number.get(w, 0) for w in (t or "").encode().split()]) for t in docs["text"]]
            ids, source = docs["doc_id"].to_numpy(), passages["first"].to_numpy()
            marks = [np.zeros(len(s) + 1, np.int64) for s in streams]

            def stream(automaton, held):
                automaton.make_automaton()
                for d, stream_words in enumerate(streams):
                    if len(stream_words) >= width:
                        own, mark = ids[d], marks[d]
                        for end, k in automaton.iter(stream_words):
                            first, n = held[k]
                            if first < own:
                                mark[end - n + 1] += 1
                                mark[end + 1] -= 1

            new = lambda: ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            automaton, held, size = new(), [], 0
            for p, i, n in phrases:
                automaton.add_word(tuple(texts[p][i : i + n]), len(held))
                held.append((source[p], n))
                size += n
                if size >= NODES:
                    stream(automaton, held)
                    automaton, held, size = new(), [], 0
            if held:
                stream(automaton, held)
            for d, mark in enumerate(marks):
                covered = np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]])
                step = np.flatnonzero(np.diff(covered.astype(np.int8)))
                if len(step):
                    rows.append((ids[d], docs["th"].iloc[d], step[::2].tolist(), step[1::2].tolist()))
        return pd.DataFrame(rows, columns=["doc_id", "th", "starts", "ends"])

    return run


def repeated_spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, th, starts, ends): the runs of words [start, end) that go, for documents that lose any; they may overlap.

    ``th`` is xxhash64 of the text: together with doc_id it tells rows that repeat an id apart.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null").withColumn("th", F.xxhash64("text"))
    digests = scratch.table(lean.mapInArrow(_digest, "doc_id long, th long, n_words long, sha binary"))
    classes = digests.filter(f"n_words >= {width}").groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    copies = scratch.table(digests.join(classes, "sha").filter("doc_id > least").select("doc_id", "th", "n_words"))

    def pick(ids: DataFrame, on, how: str, source: DataFrame = lean) -> DataFrame:
        return source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)

    single = pick(copies.select("doc_id", "th"), ["doc_id", "th"], "left_anti")
    # Phrases that two documents share, and who has them.
    phrases = single.select("doc_id", "text").mapInArrow(_minimisers(width), "phrase long, doc_id long")
    shared = scratch.table(phrases.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("phrase"), free=True)
    holders = scratch.table(phrases.join(shared, "phrase", "left_semi").groupBy("doc_id").agg(F.collect_list("phrase").alias("phrases")), free=True)
    # Windows that two documents share, and the first document of each.
    windows = scratch.table(lean.select("doc_id", "text").join(holders, "doc_id").mapInArrow(_windows(width), "gram long, doc_id long"), free=True)
    recurring = scratch.table(windows.groupBy("gram").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("gram", "first"), free=True)
    sources = recurring.groupBy("first").agg(F.collect_list("gram").alias("grams")).withColumnRenamed("first", "doc_id")
    passages = scratch.table(lean.select("doc_id", "text").join(sources, "doc_id").mapInArrow(_passages(width), "pid string, first long, words string, grams array<long>"), free=True)
    # Each passage to the shards whose documents it leads to.
    total = lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    parts = passages.select("pid", "first", F.explode("grams").alias("gram"))
    routes = windows.join(parts, "gram").filter("doc_id > first").select("pid", shard).distinct()
    sent = routes.join(passages.drop("grams"), "pid").select("shard", "pid", "first", "words")
    before = F.sum(F.octet_length("words")).over(Window.partitionBy("shard").orderBy("pid", "first")) - F.octet_length("words")
    sent = scratch.table(sent.withColumn("part", F.floor(before / PART_BYTES).cast("int")).drop("pid"), free=True)
    scratch.drop(windows, recurring)
    streamed = pick(holders.select("doc_id"), "doc_id", "left_semi").select("doc_id", "th", "text", shard)
    streamed = streamed.join(sent.select(F.col("shard").alias("shard"), F.col("part").alias("part")).distinct(), "shard").select("doc_id", "th", "text", "shard", "part")
    found = streamed.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInPandas(_locate(width), "doc_id long, th long, starts array<long>, ends array<long>")
    whole = copies.select("doc_id", "th", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_words").alias("ends"))
    found = scratch.table(found.unionByName(whole), free=True).groupBy("doc_id", "th").agg(F.collect_set(F.struct("starts", "ends")).alias("s"))
    return found.select("doc_id", "th", F.flatten("s.starts").alias("starts"), F.flatten("s.ends").alias("ends"))


def _cut(batches):
    for b in batches:
        starts, ends = b.column("starts").to_pylist(), b.column("ends").to_pylist()
        n, gone, kept = [], [], []
        for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            words = (t or b"").split()
            n.append(len(words))
            at = 0
            left: list[bytes] = []
            for s, e in sorted(zip(starts[i] or [], ends[i] or [], strict=True)):  # of several parts: they may overlap
                left += words[at:s]
                at = max(at, e)
            left += words[at:]
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    spans = repeated_spans(docs, width)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    return lean.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
