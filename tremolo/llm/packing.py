"""Mixture-controlled packing: deficit round-robin over source queues.

1. Every text becomes ids, closed by ``end_id``; the ids are written once.
2. Each source is a queue; a document's place in it comes from sums per input partition.  Blocks of
   ``QUANTUM`` ids of every queue are dealt over groups by the schedule of the target proportions: a queue
   of weight w has given w * t ids, or all it has, at time t.  Without weights each source weighs its own
   length, and all queues end at the same time.
3. Inside a group, windows are filled by deficit round-robin: each window adds its share to every
   source's deficit, a round serves every source the whole ids of its deficit, the next rounds one id each to those
   with the most left, and deficits carry to the next window.  So a source is less than two ids off its share in a
   full window, and at most ``QUANTUM`` more in the first of a group, while it has ids.  A group begins with the deficits that the groups before it leave: what the schedule owes a source by
   then, less what those groups hold of it.  Both follow from places in the queues, so groups don't wait
   for each other.  Ids that are left at the end of a group become sequences of powers of two, which need
   no padding.

Defined results
* null text: the empty text, one id (``end_id``).  Null source: a queue of its own.  Null doc_id: kept as null.
* repeated rows are documents of their own.  No rows: an empty result.  Extra columns are not read.
* a source that ``weights`` doesn't name: an error.  Ties between deficits: the first source by code point.
* very long texts are encoded in pieces (a text with characters outside Latin goes to the tokenizer whole),
  and a long document is cut over as many groups as its ids need; its ids are one value of the ids' table.

Skew: a source with a third of all rows fills a third of each group; no task holds a source.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .scratch import Scratch, kept

#: Ids of a group, which one task packs.
GROUP_IDS = 1 << 20
#: Ids of a block that is dealt to a group whole: what a group may owe a source.
QUANTUM = 32
#: Rows (about 60 bytes each) of the table of queues and input partitions up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_PARTS = 400_000

def _id_type(spec: str) -> str:
    """The smallest unsigned type that holds every id of the tokenizer."""
    t = json.loads(spec)
    most = max([0, *t["model"]["vocab"].values(), *(x["id"] for x in t.get("added_tokens", ()))])
    return "<u2" if most < 1 << 16 else "<u4"


def _tokenise(spec, key: str, end_id: int, kind: str):
    def run(batches):
        encoder = kept(key, lambda: Encoder(spec.value))
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            doc_id, queue = b.column("doc_id"), b.column("queue")
            names = queue.to_pylist()
            for row, ids, at in encoder.ids(b.column("text"), end_id):
                n, small = len(at) - 1, ids.astype(kind)
                length = np.diff(at)
                before = np.zeros(n, np.int64)
                for i in range(n):  # ids of the same queue before it in this partition
                    q = names[row + i]
                    before[i] = seen.get(q, 0)
                    seen[q] = before[i] + int(length[i])
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(row, n), queue.slice(row, n), pa.array(np.full(n, part)), pa.array(before), pa.array(length),
                     pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * small.itemsize).astype(np.int32)), pa.py_buffer(small)])],
                    names=["doc_id", "queue", "part", "before", "n", "ids"],
                )

    return run


class Schedule:
    """When each queue gives which of its ids: by time t a queue has given min(length, weight * t)."""

    def __init__(self, lengths: list[int], weights: list[float]):
        ends = np.array([n / w for n, w in zip(lengths, weights, strict=True)])
        self.times = np.unique(np.concatenate([[0.0], ends]))
        self.given = np.array([sum(min(n, w * t) for n, w in zip(lengths, weights, strict=True)) for t in self.times])

    def all_by(self, t: np.ndarray) -> np.ndarray:
        """Ids that all queues together have given by the times ``t``."""
        return np.interp(t, self.times, self.given)

    def time_of(self, ids: float) -> float:
        """When all queues together have given so many ids."""
        return float(np.interp(ids, self.given, self.times))


def _deal(schedule: Schedule, groups: int, width: int):
    """Cut each document where its blocks go to another group; ``owed``: what the schedule has the queue give before that group."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("grp", "queue", "pos", "owed", "doc_id", "start", "doc_tokens", "ids")}
            cols = [b.column(c).to_pylist() for c in ("doc_id", "queue", "before", "n", "ids", "base", "total", "weight")]
            size = schedule.given[-1] / groups
            for doc_id, queue, before, n, ids, base, total, weight in zip(*cols, strict=True):
                first = base + before
                phase = zlib.crc32(queue.encode()) / 2**32
                blocks = np.arange(first // QUANTUM, (first + n - 1) // QUANTUM + 1)
                group = np.minimum(schedule.all_by((blocks + phase) * QUANTUM / weight) / size, groups - 1).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
                starts = np.maximum(blocks[cuts] * QUANTUM - first, 0)
                for g, s, e in zip(group[cuts], starts, [*starts[1:], n], strict=True):
                    owed = min(total, weight * schedule.time_of(g * size))
                    for k, v in zip(out, (int(g), queue, int(first + s), owed, doc_id, int(s), n, ids[width * s : width * e]), strict=True):
                        out[k].append(v)
            kinds = {"queue": pa.string(), "owed": pa.float64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return run


def sequence_sizes(total: int, window: int) -> list[int]:
    """Full windows, then powers of two for what is left."""
    rest = total % window
    return [window] * (total // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def takes(amount: np.ndarray, deficit: np.ndarray, rooms: list[int]) -> np.ndarray:
    """(windows, queues): the ids that each window takes of each queue, whose ``amount`` and first ``deficit`` are given."""
    left, deficit = amount.astype(np.int64), deficit.astype(float)
    share = np.maximum(amount - deficit, 0)
    share = share / max(share.sum(), 1e-9)
    out = np.zeros((len(rooms), len(amount)), np.int64)
    for k, room in enumerate(rooms):
        deficit = deficit + share * room
        take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
        rest = room - int(take.sum())
        while rest:  # rounds of one id, the most owed first; more at once where queues have run out
            sign = 1 if rest > 0 else -1
            able = np.flatnonzero(left > take if sign > 0 else take > 0)
            able = able[np.argsort(sign * (take[able] - deficit[able]), kind="stable")][: abs(rest)]
            most = left[able] - take[able] if sign > 0 else take[able]
            step = np.minimum(most, max(1, abs(rest) // len(able)))
            take[able] += sign * step
            rest -= sign * int(step.sum())
        out[k] = take
        deficit, left = deficit - take, left - take
    return out


def _fill(window: int, kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["queue", "pos"], kind="stable")
        names, blobs = pdf["queue"].to_numpy(), pdf["ids"].to_list()
        size = np.array([len(x) for x in blobs]) // int(kind[-1])
        edges = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
        amount = np.add.reduceat(size, edges[:-1])
        owed = pdf["owed"].to_numpy(float)[edges[:-1]] - pdf["pos"].to_numpy(float)[edges[:-1]]  # by earlier groups
        rooms = sequence_sizes(int(size.sum()), window)
        taken = takes(amount, owed, rooms)
        cols: list[list[np.ndarray]] = [[], [], [], [], [], []]  # window, queue, slice, start in it, length, checksum
        for q in range(len(edges) - 1):
            ids = memoryview(np.frombuffer(b"".join(blobs[edges[q] : edges[q + 1]]), kind).astype("<u4").tobytes())
            windows = np.concatenate([[0], np.cumsum(taken[:, q])])
            slices = np.concatenate([[0], np.cumsum(size[edges[q] : edges[q + 1]])])
            cuts = np.union1d(windows, slices)
            a, b = cuts[:-1], cuts[1:]
            at = np.searchsorted(slices, a, "right") - 1
            crc = np.array([zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
            for c, v in zip(cols, (np.searchsorted(windows, a, "right") - 1, np.full(len(a), q), edges[q] + at, a - slices[at], b - a, crc), strict=True):
                c.append(v)
        k, q, row, inside, length, crc = (np.concatenate(c) for c in cols)
        order = np.lexsort((inside, row, q, k))
        k, row, inside, length, crc = (c[order] for c in (k, row, inside, length, crc))
        offset = np.cumsum(length) - length - np.concatenate([[0], np.cumsum(rooms)])[k]
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[row], "start": pdf["start"].to_numpy(np.int64)[row] + inside, "length": length, "ids_crc32": crc,
            "doc_tokens": pdf["doc_tokens"].to_numpy(np.int64)[row], "sequence_id": (int(pdf["grp"].iloc[0]) << 32) + k, "offset": offset,
        }).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, spec: str, window: int = 1024, end_id: int = 0, weights: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``spec`` is the JSON of a byte-level BPE tokenizer.  ``weights`` (above 0) has the target proportion of every
    source; a source that runs out leaves its share to the others.  Without it each source weighs what it holds.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    scratch, kind = Scratch(docs.sparkSession, "pack"), _id_type(spec)
    queue = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.col("text").cast("string").alias("text"))
    tokens = scratch.table(lean.mapInArrow(_tokenise(scratch.spark.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest(), end_id, kind), "doc_id long, queue string, part long, before long, n long, ids binary"))
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    w = Window.partitionBy("queue")  # a row for each input partition
    parts = parts.select("queue", "part", (F.sum("m").over(w.orderBy("part")) - F.col("m")).alias("base"), F.sum("m").over(w).alias("total"))
    weight = F.col("total").cast("double")
    if weights is not None:
        named = [("" if k is None else f"={k}", float(v)) for k, v in weights.items()]
        parts = parts.join(F.broadcast(scratch.spark.createDataFrame(named, "queue string, weight double")), "queue", "left")  # as many rows as the caller names
        weight = F.col("weight")
    parts = scratch.table(parts.withColumn("weight", weight))
    rows, all_ids, lacking = parts.agg(F.count(F.lit(1)), F.sum(F.when(F.col("base") == 0, F.col("total"))), F.count_if(F.expr("weight is null or weight <= 0"))).first()
    if lacking:
        raise ValueError("weights must name every source with a weight above 0")
    schedule = Schedule([all_ids or 1], [1.0])  # all queues in step: one queue of all ids
    if weights is not None and rows:
        ends = parts.filter("base = 0").select("queue", "total", "weight").distinct().collect()  # as many rows as the caller names
        schedule = Schedule([r["total"] for r in ends], [r["weight"] for r in ends])
    else:
        parts = parts.withColumn("weight", F.col("total") / F.lit(float(all_ids or 1)))
    groups = max(1, round((all_ids or 0) / GROUP_IDS))
    dealt = tokens.join(F.broadcast(parts) if rows <= BROADCAST_PARTS else parts, ["queue", "part"])
    slices = dealt.mapInArrow(_deal(schedule, groups, int(kind[-1])), "grp long, queue string, pos long, owed double, doc_id long, start long, doc_tokens long, ids binary")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return slices.groupBy("grp").applyInPandas(_fill(window, kind), schema)
