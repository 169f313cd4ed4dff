"""Source divergence audit over run-length columns.

Terms are maximal runs of letters and non-ASCII characters, A-Z in lower case.  Each language keeps the terms that
at least ``min_docs`` of its documents hold; a group is a source of a language, and a group's (or a language's) weight
of a kept term is p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)).  Two groups differ by f = floor((p - q)^2 / (p + q)),
summed over all kept terms.

The vocabulary is reordered: terms are sorted by their vectors of counts, so that terms with equal counts lie
together, and cut into blocks.  In a block each group is a run-length column (start, length, count).  A pair of
groups intersects the boundaries of its two columns, and f is computed once for each stretch and multiplied by the
stretch's length.  Sums over blocks are exact integers.

Defined results
* null text, lang or source: ''.  A text without a term still makes its group occur.
* no kept term (V = 0): pairs have value 0, there are no term rows.
* ties: the smaller item by UTF-8.  Rows that repeat, or repeat a doc_id, are documents of their own.
* a language with one source has no pair rows.  No rows give no rows; extra columns are not read.
* a very long text is one step of about 25 bytes of working memory a byte; a very long term is a term like any other.

Bounds: a task combines counts in tables of at most ``KEPT_ROWS`` rows before they are shuffled, a term's vector has
one entry a source of its language, and a pair task holds one block (``BLOCK_CELLS`` counts and one row a source).
A hot language is many blocks; a hot group adds to sums only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import lowered, text_slices, word_spans

#: Text bytes of a step, rows that a task combines before it hands them on, and counts of a block of the vocabulary.
STEP, KEPT_ROWS, BLOCK_CELLS = 1 << 20, 1 << 17, 1 << 18
_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
for _a in (ord("A"), ord("a")):
    _TERM[_a : _a + 26] = True
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_RUNS = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Ids of all terms, the distinct terms, and the document of each."""
    low = np.where(_TERM[raw], lowered(raw), np.uint8(0x20))
    starts, ends, first = word_spans(low, offsets)
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(low[low != 0x20])]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, np.repeat(np.arange(len(first) - 1), np.diff(first))


def _combined(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns(["lang", "source", "term", "n", "docs"]).cast(_COUNTS)


def _count(batches):
    """Occurrences and documents of each (lang, source, term); a null term for each (lang, source)."""
    held, rows = [], 0
    for b in batches:
        pairs = pa.table({"lang": b.column("lang"), "source": b.column("source")})
        groups = pairs.group_by(["lang", "source"]).aggregate([])
        code = {g: i for i, g in enumerate(zip(groups.column("lang").to_pylist(), groups.column("source").to_pylist(), strict=True))}
        group = np.array([code[g] for g in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
        none = pa.array([0] * len(code), pa.int64())
        parts = [pa.table([groups.column("lang"), groups.column("source"), pa.nulls(len(code), pa.string()), none, none], schema=_COUNTS)]
        for row, raw, offsets in text_slices(b.column("text"), STEP):
            ids, words, doc = _terms(raw, offsets)
            if not len(ids):
                continue
            each, n = np.unique(doc * len(words) + ids, return_counts=True)  # a term of a document
            key = group[row + each // len(words)] * len(words) + each % len(words)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            g, t = pa.array(key[at] // len(words)), pa.array(key[at] % len(words))
            docs = np.diff(np.append(at, len(key)))
            parts.append(pa.table([groups.column("lang").take(g), groups.column("source").take(g), words.take(t).cast(pa.large_string()).cast(pa.string()), pa.array(np.add.reduceat(n, at)), pa.array(docs)], schema=_COUNTS))
        held += parts
        rows += sum(p.num_rows for p in parts)
        if rows > KEPT_ROWS:
            held = [_combined(held)]
            rows = held[0].num_rows
            if rows > KEPT_ROWS // 2:
                yield from held[0].combine_chunks().to_batches()
                held, rows = [], 0
    if held:
        yield from _combined(held).combine_chunks().to_batches()


def term_vectors(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, n, cells): the counts of a kept term by source; a null term holds all sources of a language."""
    lean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = lean.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    cells = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = cells.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", F.col("n").alias("k")))).alias("cells"))
    return rows.filter((F.col("docs") >= min_docs) | F.col("term").isNull()).drop("docs")


def group_sizes(vectors: DataFrame) -> DataFrame:
    """(lang, source, terms, d, d_lang): the denominators N + 2 * V of every group and of its language."""
    kept = vectors.filter("term is not null")
    each = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.k").alias("n"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("n_lang"))
    every = vectors.filter("term is null").select("lang", F.explode("cells.source").alias("source"))
    out = every.join(each, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["n", "terms", "n_lang"])
    return out.select("lang", "source", "terms", *[(F.col(c) + 2 * F.col("terms")).alias(d) for c, d in (("n", "d"), ("n_lang", "d_lang"))])


def weight(count: str | Column, total: str) -> Column:
    """1 + floor(10^9 * (count + 2) / total), in decimals that hold every product."""
    c = F.col(count) if isinstance(count, str) else count
    up = (F.lit(1_000_000_000).cast("decimal(10,0)") * (c + 2).cast("decimal(19,0)")).cast("decimal(30,0)")
    return 1 + F.call_function("div", up, F.greatest(F.col(total), F.lit(1)).cast("decimal(19,0)"))


def _encode(batches):
    """Run-length columns of each block of consecutive rows; a row without a source states the block's length."""
    seq = TaskContext.get().partitionId() << 32
    lang, held, cells = None, [], 0

    def block():
        nonlocal seq, held, cells
        part = pa.concat_arrays(held)
        row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
        flat = part.flatten()
        names = flat.field("source").dictionary_encode()
        code, n = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("k").to_numpy()
        order = np.lexsort((row, code))
        code, n, row = code[order], n[order], row[order]
        fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1] + 1) | (n[1:] != n[:-1])])
        at = np.flatnonzero(fresh)
        length = np.diff(np.append(at, len(code)))
        source = pa.concat_arrays([pa.nulls(1, pa.string()), names.dictionary.take(pa.array(code[at])).cast(pa.string())])
        ends = [np.concatenate([[a], b]).astype(np.int64) for a, b in ((0, row[at]), (len(part), length), (0, n[at]))]
        out = pa.RecordBatch.from_arrays([pa.array([lang] * len(source), pa.string()), pa.array(np.full(len(source), seq)), source, *map(pa.array, ends)], schema=_RUNS)
        seq, held, cells = seq + 1, [], 0
        return out

    for b in batches:
        names, lists = b.column("lang").to_pylist(), b.column("cells")
        ends = lists.offsets.to_numpy()
        at = 0
        for i in range(1, len(names) + 1):
            last = i == len(names)
            if names[at] != lang and held:
                yield block()
            lang = names[at]
            if last or names[i] != lang or cells + int(ends[i] - ends[at]) >= BLOCK_CELLS:
                held.append(lists.slice(at, i - at))
                cells += int(ends[i] - ends[at])
                at = i
                if cells >= BLOCK_CELLS:
                    yield block()
    if held:
        yield block()


def run_columns(vectors: DataFrame) -> DataFrame:
    """(lang, block, source, start, length, n) of the reordered vocabulary: runs of equal counts above zero."""
    rows = vectors.filter("term is not null").select("lang", "cells", F.slice("cells", 1, 4).alias("first"), F.xxhash64("term").alias("h"))
    # Ranges are cut by the first counts: a sample of the keys goes to the driver, so they are short.
    ordered = rows.repartitionByRange("lang", "first", "h").sortWithinPartitions("lang", "cells").select("lang", "cells")
    return ordered.mapInArrow(_encode, "lang string, block long, source string, start long, length long, n long")


def _column(start: np.ndarray, length: np.ndarray, p: np.ndarray, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the weight changes, and the weight from there on: the runs, with zeros between them."""
    order = np.argsort(start)
    start, length, p = start[order], length[order], p[order]
    edges = np.concatenate([[0], np.column_stack([start, start + length]).ravel()])
    value = np.concatenate([[zero], np.column_stack([p, np.full(len(p), zero)]).ravel()])
    real = np.append(edges[1:] != edges[:-1], True)  # of equal edges the last one counts
    return edges[real], value[real]


def _pairs(table: pa.Table) -> pa.Table:
    """Sums of f over one block, for every pair of groups."""
    lang = table.column("lang")[0].as_py()
    names = table.column("source").to_numpy()
    start, length, p, base = (table.column(c).to_numpy() for c in ("start", "length", "p", "base"))
    zero = {names[i]: int(p[i]) for i in np.flatnonzero(base)}
    size = int(length[base][0])
    order = np.argsort(names, kind="stable")
    cuts = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
    columns, groups = [], []
    for rows in np.split(order, cuts[1:]):
        runs = rows[~base[rows]]
        columns.append(_column(start[runs], length[runs], p[runs], zero[names[rows[0]]]))
        groups.append(names[rows[0]])
    out: tuple[list, list, list] = ([], [], [])
    for i, (ea, va) in enumerate(columns):
        for j in range(i):
            eb, vb = columns[j]
            edges = np.union1d(ea, eb)
            a, b = va[np.searchsorted(ea, edges, "right") - 1], vb[np.searchsorted(eb, edges, "right") - 1]
            f = (a - b) ** 2 // (a + b)
            value = int((f * np.diff(np.minimum(np.append(edges, size), size))).sum())
            for x, y in zip(out, (groups[j], groups[i], value), strict=True):
                x.append(y)
    return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "a": pa.array(out[0], pa.string()), "b": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})


def pair_divergence(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of groups of a language."""
    shape = ["lang", "block", "source", "start", "length", "p", "base"]
    sizes = runs.filter("source is null").select("lang", "block", "length")
    sizes = sizes.unionByName(groups.filter("terms = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("length")).distinct())
    base = sizes.join(groups, "lang").select("lang", "block", "source", F.lit(0).cast("long").alias("start"), "length", weight(F.lit(0), "d").alias("p"), F.lit(True).alias("base"))
    cells = runs.filter("source is not null").join(groups, ["lang", "source"]).withColumns({"p": weight("n", "d"), "base": F.lit(False)}).select(*shape)
    part = base.unionByName(cells).groupBy("lang", "block").applyInArrow(_pairs, "lang string, a string, b string, value long")
    whole = part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def term_divergence(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more often than its language."""
    cells = vectors.filter("term is not null").select("lang", "term", "n", F.explode("cells").alias("c")).select("lang", "term", "n", "c.source", "c.k")
    w = cells.filter("k > 0").join(groups, ["lang", "source"]).withColumns({"p": weight("k", "d"), "q": weight("n", "d_lang")}).filter("p > q")
    return w.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of a language by divergence, and each group's ``top`` terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    vectors = scratch.table(term_vectors(docs, min_docs), free=True)
    groups = scratch.table(group_sizes(vectors))
    runs = scratch.table(run_columns(vectors))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_divergence(runs, groups).withColumn("rank", rank)
    terms = term_divergence(vectors, groups).withColumn("rank", rank).filter(F.col("rank") <= top)
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term"))
