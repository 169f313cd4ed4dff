"""File listings, recordings in foreign formats, shard writes and the environment."""

from __future__ import annotations

import importlib.metadata
import math
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A folder that the cluster shares: ``spark.checkpoint.dir``, or a temporary one for a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="tremolo-io-")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, folder, n_bytes of all files below a folder; the content column is pruned, so nothing is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    return f.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), F.col("length").alias("n_bytes"))


def by_kind(files: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_extract("name", r"\.(\w+)$", 1))
    return files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))


def pair(files: DataFrame, data: str = "h5") -> DataFrame:
    """(folder, stem, has_json) of recordings that have both data and mask, from (folder, stem, kind)."""
    g = files.groupBy("folder", "stem").agg(F.collect_set("kind").alias("kinds"))
    g = g.filter(F.array_contains("kinds", data) & F.array_contains("kinds", "npy"))
    return g.select("folder", "stem", F.array_contains("kinds", "json").alias("has_json"))


def recordings(spark: SparkSession, root: str, data: str = "npz", entry: str = "data", columns: tuple[str, ...] = ("data", "mask", "annotation")) -> DataFrame:
    """(folder, stem, has_json, then ``columns``) of all recordings below a folder that have a mask, by the data source."""
    from .recordings import scan

    return scan(spark, root, ("folder", "stem", "has_json", *columns), data=data, entry=entry)


def write_shards(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitioned Parquet; only the partitions that ``df`` holds are replaced."""
    df.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def decode_records(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(path, data) of binary files (path, content): ``decode`` gives channels x samples."""

    def run(batches):
        for b in batches:
            data = [np.asarray(decode(c), float).tolist() for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(data, pa.list_(pa.list_(pa.float64())))], names=["path", "data"])

    return files.select("path", "content").mapInArrow(run, "path string, data array<array<double>>")


def decode_npy(content: bytes) -> np.ndarray:
    import io

    return np.load(io.BytesIO(content), allow_pickle=False)


def attributes(files: DataFrame, text: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """(path, one column an attribute) of records (.npz): ``text`` attributes are held as bytes of UTF-8."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in (*text, *numbers)}
            for content in b.column("content").to_pylist():
                held = decode_npy(content)
                for k in out:
                    found = held[k] if k in held else None
                    out[k].append(None if found is None else bytes(found).decode() if k in text else int(found))
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array(v, pa.string() if k in text else pa.int64()) for k, v in out.items())], names=["path", *out])

    return files.select("path", "content").mapInArrow(run, "path string" + "".join(f", {k} string" for k in text) + "".join(f", {k} long" for k in numbers))


def centred(row: str, width: int) -> Column:
    """Centre crop of a longer array, reflection to the right of a shorter one."""
    x = F.col(row)
    n = F.size(x)
    crop = F.slice(x, F.floor((n - width) / 2).cast("int") + 1, F.lit(width))
    pad = F.concat(x, F.slice(F.reverse(x), F.lit(2), F.greatest(F.lit(width) - n, F.lit(0))))
    return F.when(n >= width, crop).otherwise(pad)


def noise(key: Column, i: Column) -> Column:
    """A standard normal number for each (key, i): Box-Muller over 52 bits of two digests."""
    def even(salt: int) -> Column:
        bits = F.substring(F.md5(F.concat_ws(":", F.lit(salt), key, i).cast("binary")), 1, 13)
        return (F.conv(bits, 16, 10).cast("long") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(even(1))) * F.cos(2 * math.pi * even(2))


def mask_cells(files: DataFrame, blocks_per_window: int = 4) -> DataFrame:
    """(path, block, locus) of the true cells of boolean masks (.npy) where a whole window fits."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = decode_npy(content)
                block, locus = np.nonzero(m[: max(0, len(m) - blocks_per_window + 1)])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(block), pa.string()), pa.array(block.astype(np.int32)), pa.array(locus.astype(np.int32))], names=["path", "block", "locus"])

    return files.select("path", "content").mapInArrow(run, "path string, block int, locus int")


def polygons(annotations: DataFrame) -> DataFrame:
    """(path, curve, x, y) of JSON annotations whose keys begin with ``curve``, from (path, json)."""
    m = F.from_json("json", "map<string,struct<x:array<double>,y:array<double>>>")
    e = annotations.select("path", F.explode(m).alias("curve", "p")).filter(F.col("curve").startswith("curve"))
    return e.select("path", "curve", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def environment(spark: SparkSession) -> DataFrame:
    rows = [("spark", spark.version)]
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        rows.append((name, importlib.metadata.version(name)))
    return spark.createDataFrame(rows, "component string, version string")
