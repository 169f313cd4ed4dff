"""Feature extraction: windows meet their blocks by equi-join, one Arrow pass emits all four domains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.features import SIZES, window_features

#: Values that the kernels take at once (each costs about 60 bytes of working memory).
STACK = 1 << 21


def patches(manifest: DataFrame, blocks: DataFrame, channels: int, blocks_per_window: int = 4) -> DataFrame:
    """(sample_id, patch): per window its channels, each the samples of its consecutive blocks.

    ``manifest``: sample_id, recording_id, block, locus, n_loci.  ``blocks``: recording_id, block, locus,
    samples.  Near the ends the patch is moved inwards.  The block range becomes an equi-join key.
    """
    first = F.greatest(F.lit(0), F.least(F.col("locus") - channels // 2, F.col("n_loci") - channels))
    want = manifest.select("sample_id", "recording_id", first.alias("c0"), F.explode(F.sequence("block", F.col("block") + blocks_per_window - 1)).alias("block"))
    hit = want.join(blocks.withColumnRenamed("locus", "channel"), ["recording_id", "block"]).filter(F.col("channel").between(F.col("c0"), F.col("c0") + channels - 1))
    row = hit.groupBy("sample_id", "channel").agg(F.sort_array(F.collect_list(F.struct("block", "samples"))).alias("b"))
    row = row.filter(F.size("b") == blocks_per_window).select("sample_id", "channel", F.flatten(F.transform("b", lambda x: x["samples"])).alias("x"))
    patch = row.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("channel", "x"))).alias("rows"))
    return patch.select("sample_id", F.transform("rows", lambda r: r["x"]).alias("patch"))


def _stacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """(channels x samples of each patch, all values) where every patch of the column is a full rectangle."""
    rows = column.flatten()
    per_patch, per_row = column.value_lengths().to_numpy(zero_copy_only=False), rows.value_lengths().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(per_patch)[:-1]])
    samples = per_row[np.minimum(first, len(per_row) - 1)] if len(per_row) else per_patch
    if (per_row != np.repeat(samples, per_patch)).any():
        raise ValueError("the channels of a patch must have one length")
    return np.stack([per_patch, samples], axis=1), rows.flatten().to_numpy(zero_copy_only=False).astype(float)


def _batches(column: pa.Array):
    """(places, windows x channels x samples) of the patches of a column, by shape and at most STACK values at once."""
    shapes, values = _stacked(column)
    start = np.concatenate([[0], np.cumsum(shapes.prod(axis=1))])
    for c, n in np.unique(shapes, axis=0):
        at = np.flatnonzero((shapes == (c, n)).all(axis=1))
        step = max(1, STACK // max(1, int(c * n)))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            yield some, np.stack([values[start[k] : start[k + 1]] for k in some]).reshape(len(some), c, n)


def extract(windows: DataFrame, fs: float, reference: str = "centre", domains: tuple[str, ...] = tuple(SIZES), preprocess: bool = True) -> DataFrame:
    """(sample_id, one array<float> per domain) from (sample_id, patch); windows of one shape go through the kernels together.

    ``reference``: the channel for the one-dimensional domains, the centre or the one with most energy.
    """

    def run(batches):
        for b in batches:
            out = {d: [None] * b.num_rows for d in domains}
            for at, x in _batches(b.column("patch")):
                rows, channels, n = x.shape
                spread = x - x.mean(axis=2, keepdims=True)
                one = np.full(rows, channels // 2) if reference == "centre" else (spread * spread).sum(axis=2).argmax(axis=1)
                x = dsp.preprocess(x.reshape(-1, n), fs).reshape(x.shape) if preprocess else x
                with np.errstate(all="ignore"):
                    for d, v in window_features(x[np.arange(rows), one], x, fs, domains).items():
                        for k, row in zip(at, v, strict=True):
                            out[d][k] = row
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), *(pa.array(out[d], pa.list_(pa.float32())) for d in domains)], names=["sample_id", *domains])

    kind = windows.schema["sample_id"].dataType.simpleString()
    return windows.select("sample_id", "patch").mapInArrow(run, f"sample_id {kind}, " + ", ".join(f"{d} array<float>" for d in domains))


def resampled(windows: DataFrame, up: int, down: int) -> DataFrame:
    """(sample_id, patch) at ``up / down`` times the sampling rate."""

    def run(batches):
        for b in batches:
            out = [None] * b.num_rows
            for at, x in _batches(b.column("patch")):
                for k, row in zip(at, dsp.resample(x, up, down), strict=True):
                    out[k] = row.tolist()
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["sample_id", "patch"])

    kind = windows.schema["sample_id"].dataType.simpleString()
    return windows.select("sample_id", F.col("patch").cast("array<array<double>>").alias("patch")).mapInArrow(run, f"sample_id {kind}, patch array<array<double>>")


def pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: windows that no written shard holds."""
    return manifest.join(done.select("sample_id").distinct(), "sample_id", "left_anti")


def assemble(shards: DataFrame, expected: DataFrame, chunk: str = "chunk", rows: str | None = None, key: str = "sample_id") -> DataFrame:
    """The shards side by side; an error names the least chunk of ``expected`` that no shard holds.

    Also an error: a ``key`` that several rows hold, and a chunk with other than ``rows`` (a column of ``expected``) rows.
    """
    held = shards.groupBy(F.col(chunk).alias("_chunk")).agg(F.count(F.lit(1)).alias("_held"))
    asked = expected.select(chunk, (F.col(rows) if rows else F.lit(None)).cast("long").alias("_asked")).distinct()
    both = asked.join(held, asked[chunk] == held["_chunk"], "left")
    off = F.when(F.col("_held") != F.col("_asked"), F.struct(F.col(chunk).alias("c"), F.col("_held").alias("h"), F.col("_asked").alias("a")))
    missing, wrong = both.agg(F.min(F.when(F.col("_held").isNull(), F.col(chunk))), F.min(off)).first()
    if missing is not None:
        raise ValueError(f"no shard holds chunk {missing}")
    if wrong is not None:
        raise ValueError(f"chunk {wrong['c']} has {wrong['h']} rows, not {wrong['a']}")
    twice = shards.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.min(key)).first()[0]
    if twice is not None:
        raise ValueError(f"several rows hold {key} {twice}")
    return shards


def fuse(features: DataFrame, manifest: DataFrame, order: str) -> DataFrame:
    """Manifest rows (the first of an id by ``order``) with the four domains side by side in ``features``.

    A feature row whose id the manifest lacks is an error: it is raised by the row itself, in the same join.
    """
    first = manifest.groupBy("sample_id").agg(F.min_by(F.struct(*[c for c in manifest.columns if c != "sample_id"]), order).alias("m"))
    fused = features.join(first, "sample_id", "left")
    known = F.when(F.col("m").isNull(), F.raise_error(F.concat(F.lit("no manifest row for "), F.col("sample_id").cast("string")))).otherwise(F.col("m"))
    return fused.withColumn("m", known).select("sample_id", "m.*", *[d for d in SIZES if d in features.columns], F.concat(*[d for d in SIZES if d in features.columns]).alias("features"))


def _statistics(values: DataFrame, *keys: str) -> DataFrame:
    v = values.withColumn("v", F.col("v").cast("double"))
    odd = F.isnan("v") | (F.abs("v") == float("inf")) | F.col("v").isNull()
    s = v.groupBy(*keys).agg(F.var_pop("v").alias("variance"), F.max(F.abs("v")).alias("max_abs"), F.count_if(odd).alias("non_finite"))
    return s.withColumns({"constant": F.col("variance") == 0, "near_constant": F.col("variance") < 1e-12})


def column_statistics(features: DataFrame, column: str) -> DataFrame:
    """Per feature: variance, largest size, values that aren't finite; constant and near-constant flags."""
    return _statistics(features.select(F.posexplode(column).alias("idx", "v")), "idx")


def domain_statistics(features: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """The same by (domain, idx) for several columns of arrays, in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).alias("x")) for d in domains])).alias("d")
    return _statistics(features.select(each).select("d.domain", F.posexplode("d.x").alias("idx", "v")), "domain", "idx")
