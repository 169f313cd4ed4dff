"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

The weights share a budget of words.  A source that would need more than ``max_epochs`` repetitions is
clamped there and its excess is shared out again by weight, until no source is above its cap.  Inside a
source every document is taken the whole number of epochs; the fractional epoch takes documents in the
order of a seeded digest (md5 of seed and doc_id) until the target is reached, the last of them in part.

Defined results
* null text: size 0, nothing is taken.  Null source: a source of its own, after all others.
* null doc_id: an ordinary document (its digest is that of an empty id).  Repeated rows are documents of their own.
* a tie of the digest shares what is left in proportion to size.  No rows: an empty result.
* extra columns pass through unread; if one is called like a result column, the result column replaces it
  (``repeated`` keeps all columns as they are).
* very long texts: words are counted by two replacements in the JVM, which hold a character a word.

Skew: only sums leave a task (source x digest prefix), so a source with a third of all rows costs 4,096
partial rows.  Its cut-off is found among those sums, then among those of a longer prefix inside one of
them, then inside one of these: about a 16-millionth of the source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh
from .words import word_spans

#: Hexadecimal digits of the digest by which the cut-off is found, one prefix after the other.
PREFIXES = (3, 6)
#: Sources up to which their table (about 100 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def count_words(text: Column) -> Column:
    """Words of a text: each becomes one letter, what is between them goes."""
    letters = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "w"), r"[\x20\x09-\x0D]++", "")
    return F.coalesce(F.char_length(letters), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Rank of each source by code point, null last, without bringing all sources to one task."""
    ranged = scratch.table(sources.repartitionByRange(F.asc_nulls_last("_src")).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # one row a partition
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    first = F.broadcast(scratch.spark.createDataFrame(starts or [(0, 0)], "_part int, _first long"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last("_src")))
    return ranged.join(first, "_part").withColumn("_rank", F.col("_first") + row - 1).drop("_part", "_first")


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, scratch: Scratch) -> DataFrame:
    """(_src, source_size, target): clamp, share the excess out again, until none is above its cap."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    src = scratch.table(_ranked(sources, scratch).withColumn("_w", weight).withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size")))
    total = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        above = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, caps, free = src.agg(F.count_if(above), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_w")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (caps or 0.0)) / free
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_w")) if free else F.col("_cap")
    return src.select("_src", "source_size", target.alias("target"))


def _with(docs: DataFrame, small: DataFrame, n: int, on: Column) -> DataFrame:
    return docs.join(F.broadcast(small) if n <= BROADCAST_SOURCES else small, on, "left")


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with size, source_size, target and taken under names that it doesn't have, and those names."""
    scratch = Scratch(docs.sparkSession, "mix")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = count_words(F.col("text").cast("string"))
    lean = scratch.table(docs.select(F.col("source").cast("string").alias("_src"), digest.alias("_h"), size.alias("_n")))
    prefix = lambda k: F.substring("_h", 1, k)
    sums = scratch.table(lean.groupBy("_src", prefix(PREFIXES[0]).alias("_b")).agg(F.sum("_n").alias("_n")))
    plan = water_fill(sums.groupBy("_src").agg(F.sum("_n").alias("source_size")), weights, share, max_epochs, scratch)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    plan = scratch.table(plan.withColumn("_whole", whole).withColumn("_rest", F.floor("target").cast("long") - F.col("_whole") * F.col("source_size")))
    n = plan.count()
    # Where the fractional epoch ends: a prefix, a longer one inside it, then a digest.
    cut = plan.select(F.col("_src").alias("_p"), F.lit("").alias("_in"), F.col("_rest").alias("_left"))
    for k in (*PREFIXES, 32):
        inside = sums if k == PREFIXES[0] else lean
        same = F.col("_src").eqNullSafe(F.col("_p"))
        if k > PREFIXES[0]:
            same &= F.col("_in") == F.substring("_h", 1, F.char_length("_in"))
            inside = _with(inside, cut, n, same).filter("_in is not null").groupBy("_src", prefix(k).alias("_b")).agg(F.sum("_n").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_src").orderBy("_b")) - F.col("_n")
        placed = _with(inside.withColumn("_before", before), cut, n, F.col("_src").eqNullSafe(F.col("_p"))).filter("_before <= _left and _left < _before + _n")
        cut = scratch.table(placed.select(F.col("_src").alias("_p"), F.col("_b").alias("_in"), (F.col("_left") - F.col("_before")).alias("_left"), F.col("_n").alias("_tie")))
    plan = scratch.table(plan.join(cut, F.col("_src").eqNullSafe(F.col("_p")), "left").select("_src", "source_size", "target", "_whole", "_rest", F.col("_in").alias("_end"), F.col("_left").alias("_part"), "_tie"))
    taken_names: list[str] = []

    def name(x: str) -> str:
        taken_names.append(fresh(docs, x, *taken_names))
        return taken_names[-1]

    src, h, words = name("src"), name("digest"), name("words")
    keyed = docs.withColumns({src: F.col("source").cast("string"), h: digest, words: size})
    key, total, target, times, rest, end, part, tie = (name(x) for x in ("key", "total", "target", "times", "rest", "end", "part", "tie"))
    out = _with(keyed, plan.toDF(key, total, target, times, rest, end, part, tie), n, F.col(src).eqNullSafe(F.col(key)))
    # No end was found if the fractional epoch is empty or takes the whole source.
    extra = (
        F.when(F.col(end).isNull(), F.when(F.col(rest) >= F.col(total), F.col(words)).otherwise(0))
        .when(F.col(h) < F.col(end), F.col(words))
        .when(F.col(h) == F.col(end), F.floor(F.col(part) * F.col(words) / F.greatest(F.col(tie), F.lit(1))))
        .otherwise(0)
    )
    took = name("taken")
    names = [words, total, target, took]
    return out.withColumn(took, (F.col(times) * F.col(words) + extra).cast("long")).select(*docs.columns, *names), names


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target (of the source) and taken (words, repeats counted)."""
    out, names = _planned(docs, weights, share, max_epochs, seed)
    results = ("size", "source_size", "target", "taken")
    return out.select(*[c for c in docs.columns if c.lower() not in results], *[F.col(c).alias(r) for c, r in zip(names, results, strict=True)])


def _first_words(text: str, n: int) -> str:
    raw = text.encode()
    _, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return raw[: ends[n - 1]].decode() if n else ""


def repeated(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, a fractional repetition cut after its last word."""
    mixed, (size_name, _, _, taken_name) = _planned(docs, weights, share, max_epochs, seed)
    columns, text_at = docs.columns, docs.columns.index("text")

    def repeat(batches):
        for b in batches:
            size, taken = (np.asarray(b.column(c).fill_null(0)) for c in (size_name, taken_name))
            full = taken // np.maximum(size, 1)
            part = np.flatnonzero(taken - full * size)
            source = pa.RecordBatch.from_arrays([b.column(c) for c in columns], names=columns)
            for k in range(int(full.max(initial=0))):  # a repetition at a time, so a batch never grows
                yield source.take(pa.array(np.flatnonzero(full > k)))
            if len(part):
                out = source.take(pa.array(part))
                cut = [_first_words(t, int(taken[i] - full[i] * size[i])) for t, i in zip(out.column(text_at).to_pylist(), part, strict=True)]
                arrays = out.columns
                arrays[text_at] = pa.array(cut, out.column(text_at).type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return mixed.select(*columns, size_name, taken_name).mapInArrow(repeat, docs.schema)
