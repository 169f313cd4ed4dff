"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(scale * x), and a score is an integer inner product.  Queries and
candidates are packed into blocks; every pair of blocks is scored in one task.  A round adds up one
histogram per query over all tasks, finds the bin that holds the k-th score and refines that bin, until
bins have width 1 and the k-th score is known.  The last pass keeps scores above it, and of the scores
equal to it at most k per block with the least ids; ties go to the smaller id.

Defined results
* a vector that is null or holds a null or a non-finite component takes no part; nor does a null id.
* vectors of different lengths: missing components count as 0.  Components and scores saturate at 64 bits.
* fewer than k candidates: all of them.  A query's own row, and any row with its id, is no candidate.
* rows that repeat an id: each is a candidate; as queries they are one (the least vector).
* no rows or no queries: an empty result.  Extra columns are not read.

Bounds: a task holds one pair of blocks and the histograms of one query block.  A hot vector (many equal
rows) adds counts, not rows: at most k of its ids leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of a candidate block and of a query block, and bins of a histogram.
CANDIDATES, QUERIES, BINS = 1024, 256, 4096
_LOW, _HIGH = -(1 << 62), 1 << 62
_BLOCK = "ids binary, dim int, vectors binary"


def _quantise(scale: float):
    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.asarray(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    ids.append(i)
                    out.append(np.clip(np.floor(scale * x), _LOW, _HIGH).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "q"])

    return run


def _matrix(blobs: list[bytes]) -> np.ndarray:
    dim = max((len(x) // 8 for x in blobs), default=0)
    return np.frombuffer(b"".join(x.ljust(dim * 8, b"\0") for x in blobs), np.int64).reshape(len(blobs), dim)


def _pack(rows: int, extra: list[str]):
    """Rows to blocks; ``extra`` long columns are packed beside the vectors."""

    def run(batches):
        held: dict[str, list] = {k: [] for k in ("vec_id", "q", *extra)}

        def block(n):
            part = {k: v[:n] for k, v in held.items()}
            for v in held.values():
                del v[:n]
            m = _matrix(part["q"])
            longs = [pa.array([np.array(part[k], np.int64).tobytes()], pa.binary()) for k in ("vec_id", *extra)]
            return pa.RecordBatch.from_arrays([longs[0], pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary()), *longs[1:]], names=["ids", "dim", "vectors", *extra])

        for b in batches:
            for k, v in held.items():
                v += b.column(k).to_pylist()
            while len(held["q"]) >= rows:
                yield block(rows)
        if held["q"]:
            yield block(len(held["q"]))

    return run


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` (int64)."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (a, b))
    top = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (a, b)]
    if top[0] * top[1] * max(dim, 1) < 1 << 53:  # doubles are exact here
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.vectorize(lambda x: min(max(int(x), _LOW), _HIGH), otypes=[np.int64])(exact)


def _pairs(batches) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(query columns, query ids, candidate ids, scores) of each pair of blocks; a query's own rows score below all."""
    for b in batches:
        for i in range(b.num_rows):
            get = {k: b.column(k)[i].as_py() for k in b.schema.names}
            ids, qids = np.frombuffer(get["ids"], np.int64), np.frombuffer(get["q_ids"], np.int64)
            c = np.frombuffer(get["vectors"], np.int64).reshape(len(ids), get["dim"])
            q = np.frombuffer(get["q_vectors"], np.int64).reshape(len(qids), get["q_dim"])
            s = _scores(q, c)
            s[qids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            yield get, qids, ids, s


def _histogram(width: int):
    """Counts of scores in lo + [bin * width, (bin + 1) * width), added up over the task."""

    def run(batches):
        sums: dict[bytes, np.ndarray] = {}
        for get, qids, _, s in _pairs(batches):
            lo = np.frombuffer(get["lo"], np.int64)
            ok = s >= lo[:, None]
            bins = np.where(ok, s - lo[:, None], 0) // width
            ok &= bins < BINS
            row = np.broadcast_to(np.arange(len(qids))[:, None], s.shape)
            count = np.bincount((row * BINS + bins)[ok], minlength=len(qids) * BINS)
            key = get["q_ids"]
            sums[key] = sums[key] + count if key in sums else count
            if len(sums) >= 16:  # bounded: later blocks add to fresh histograms
                yield from flush(sums)
                sums = {}
        yield from flush(sums)

    def flush(sums):
        for key, count in sums.items():
            qids, at = np.frombuffer(key, np.int64), np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(qids[at // BINS]), pa.array(at % BINS), pa.array(count[at])], names=["query_id", "bin", "n"])

    return run


def _select(k: int):
    def run(batches):
        for get, qids, ids, s in _pairs(batches):
            t = np.frombuffer(get["lo"], np.int64)
            row, col = np.nonzero(s > t[:, None])
            rows, cols = [row], [col]
            order = np.argsort(ids, kind="stable")
            tie_row, tie = np.nonzero(s[:, order] == t[:, None])
            edges = np.searchsorted(tie_row, np.arange(len(qids) + 1))
            near = np.arange(len(tie)) - edges[tie_row] < k  # the least ids of each query
            rows.append(tie_row[near])
            cols.append(order[tie[near]])
            row, col = np.concatenate(rows), np.concatenate(cols)
            own = s[row, col] > np.iinfo(np.int64).min
            row, col = row[own], col[own]
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[col]), pa.array(s[row, col])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query.  ``is_query`` reads vec_id."""
    scratch = Scratch(vectors.sparkSession, "topk")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = scratch.spark.conf.get(setting)
    scratch.spark.conf.set(setting, "64")  # rows are whole blocks
    try:
        best = scratch.table(_best(vectors, is_query, k, scale, scratch))  # at most k rows a query and block, and a few more
    finally:
        scratch.spark.conf.set(setting, before)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(vectors: DataFrame, is_query: Column, k: int, scale: float, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score): all scores above each query's k-th, and the least ids of those equal to it."""
    lean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.table(lean.mapInArrow(_quantise(scale), "vec_id long, q binary"))
    blocks = scratch.table(rows.mapInArrow(_pack(CANDIDATES, []), _BLOCK))
    queries = scratch.table(rows.filter(is_query).groupBy("vec_id").agg(F.min("q").alias("q")))

    def square(batches):
        for b in batches:
            norms = [float((np.frombuffer(x, np.int64).astype(np.float64) ** 2).sum()) for x in b.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(norms, pa.float64())], names=["square"])

    largest = rows.mapInArrow(square, "square double").agg(F.max("square")).first()[0] or 0.0
    bound = int(min(float(1 << 61), largest * 1.000001 + 2))  # no score lies outside [-bound, bound]
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    width = max(1, width)
    state = queries.select(F.col("vec_id").alias("query_id"), F.lit(-bound).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open"))

    def against(run, schema):
        packed = queries.join(state, F.col("vec_id") == F.col("query_id")).select("vec_id", "q", "lo")
        packed = packed.mapInArrow(_pack(QUERIES, ["lo"]), _BLOCK + ", lo binary").withColumnsRenamed({"ids": "q_ids", "dim": "q_dim", "vectors": "q_vectors"})
        # The stated query set against all rows, block by block.
        return blocks.crossJoin(scratch.table(packed)).mapInArrow(run, schema)

    while True:
        counts = against(_histogram(width), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))) - F.col("n")
        found = counts.withColumn("above", above).join(state, "query_id").filter("above < need and need <= above + n")
        found = found.select(F.col("query_id").alias("f"), "bin", "above")
        moved = state.join(found, F.col("query_id") == F.col("f"), "left")
        # A query with fewer than k candidates stays below every score.
        hit = F.col("open") & F.col("f").isNotNull()
        state = scratch.table(moved.select(
            "query_id", F.when(hit, F.col("lo") + F.col("bin") * F.lit(width)).otherwise(F.lit(-bound - 1)).cast("long").alias("lo"),
            F.when(hit, F.col("need") - F.col("above")).otherwise(F.col("need")).alias("need"), hit.alias("open"),
        ))
        if width == 1:
            break
        width //= BINS
    return against(_select(k), "query_id long, vec_id long, score long")
