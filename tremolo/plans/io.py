"""Queries of sources and sinks: listings, writes that are read again, descriptions of the environment."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources import recordings as rec
from .registry import query
from .tables import GRID, RECORDS, SAMPLES, WINDOWS, grid, read, records, signals, windows


def _scratch(spark: SparkSession) -> str:
    return f"{files.work_dir(spark)}/io-{uuid.uuid4().hex[:12]}"


@query()
def src_dirwalk(spark, sf):
    """Files below a folder by suffix, with their sizes; content isn't read."""
    return files.listing(spark, sf, "*.parquet").select("name", "n_bytes")


@query()
def src_artefacts(spark, sf):
    """Files by kind: how many, how large."""
    return files.by_kind(files.listing(spark, sf))


@query(f"WITH {WINDOWS} SELECT DISTINCT recording_id AS folder, 'rec' || k AS stem, k % 10 <> 5 AS has_json FROM w WHERE k % 10 <> 3")
def src_reclist(spark, sf):
    """Recordings with a mandatory mask and an optional annotation, paired by stem."""
    e = windows(spark, sf).select("recording_id", "k").distinct()
    names = e.select(F.col("recording_id").alias("folder"), F.concat(F.lit("rec"), F.col("k").cast("string")).alias("stem"))
    kinds = names.withColumn("kind", F.explode(F.array(F.lit("h5"), F.lit("npy"), F.lit("json")))).filter("not (kind = 'npy' and stem like '%3') and not (kind = 'json' and stem like '%5')")
    return files.pair(kinds)


@query("SELECT r_name AS recording, r_regionkey AS samples, 'array-' || r_regionkey AS vendor FROM region")
def src_h5attr(spark, sf):
    """Acquisition attributes of records (.npz): a text attribute in bytes and a number, decoded beside each other."""
    def pack(batches):
        for b in batches:
            out = []
            for k in b.column("r_regionkey").to_pylist():
                held = io.BytesIO()
                np.savez(held, vendor=np.frombuffer(f"array-{k}".encode(), np.uint8), samples=np.int64(k))
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("r_name"), pa.array(out, pa.binary())], names=["path", "content"])

    content = read(spark, sf, "region").select("r_name", "r_regionkey").mapInArrow(pack, "path string, content binary")
    return files.attributes(content, ("vendor",), ("samples",)).withColumnRenamed("path", "recording")


@query("SELECT vec_id, CAST(len(embedding[1:28]) AS INT) AS width, round(list_sum(list_transform(embedding[1:28], lambda v: v::DOUBLE)), 6) AS total FROM embeddings")
def src_loaddom(spark, sf):
    """One domain column of a written feature table: the scan reads that column only."""
    path = _scratch(spark)
    e = read(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 28).alias("time"), F.slice("embedding", 29, 36).alias("rest"))
    e.write.parquet(path)
    total = F.aggregate(F.col("time").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return spark.read.parquet(path).select("vec_id", F.size("time").alias("width"), F.round(total, 6).alias("total"))


@query(f"WITH {SAMPLES} SELECT vec_id, CAST(label AS INT) AS label, round(sum(v), 6) AS total FROM v GROUP BY 1, 2")
def src_fuseio(spark, sf):
    """A fused bundle, written and loaded."""
    path = _scratch(spark)
    read(spark, sf, "embeddings").select("vec_id", "label", "embedding").write.parquet(path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return spark.read.parquet(path).select("vec_id", F.col("label").cast("int").alias("label"), F.round(total, 6).alias("total"))


@query(f"WITH {WINDOWS} SELECT sample_id, recording_id, block FROM w")
def snk_parquet(spark, sf):
    """A manifest partitioned by dataset columns; a rerun replaces only the partitions it holds."""
    path = _scratch(spark)
    files.write_shards(windows(spark, sf).select("sample_id", "recording_id", "block"), path, ["recording_id"])
    return spark.read.parquet(path)


@query(f"WITH {GRID} SELECT model, strategy, f1, n FROM b")
def snk_csv(spark, sf):
    """A report as one CSV file with a header, read back with its schema."""
    path = _scratch(spark)
    g = grid(spark, sf)
    g.coalesce(1).write.csv(path, header=True)
    return spark.read.schema(g.schema).csv(path, header=True)


@query(f"WITH {GRID} SELECT model, strategy, f1 FROM b")
def snk_json(spark, sf):
    """Cards: nested structures as JSON lines."""
    path = _scratch(spark)
    c = grid(spark, sf).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("strategy", "f1"))).alias("arms"))
    c.write.json(path)
    return spark.read.schema(c.schema).json(path).select("model", F.inline("arms"))


@query(f"WITH {GRID} SELECT strategy AS method, model AS feature, f1 AS score FROM b")
def snk_sel(spark, sf):
    """A selection bundle as one long table."""
    path = _scratch(spark)
    grid(spark, sf).select(F.col("strategy").alias("method"), F.col("model").alias("feature"), F.col("f1").alias("score")).write.parquet(path)
    return spark.read.parquet(path)


@query()
def jn_container(spark, sf):
    """Model cards where there are any: a left join to the list of artefacts."""
    have = files.listing(spark, sf).select(F.regexp_extract("name", r"^(\w+)\.", 1).alias("table")).distinct().withColumn("there", F.lit(True))
    want = spark.createDataFrame([("events",), ("missing",)], "table string")
    return want.join(F.broadcast(have), "table", "left").na.fill(False, ["there"])


_EVEN = "((('0x' || substr(md5({salt} || ':' || vec_id || ':' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496)"


@query(f"WITH {SAMPLES} SELECT vec_id, i, round(sqrt(-2 * ln({_EVEN.format(salt=1)})) * cos(2 * pi() * {_EVEN.format(salt=2)}), 6) + 0.0 AS v FROM v")
def src_synth(spark, sf):
    """A synthetic patch of standard noise in the shape of each window, the same in every run: Box-Muller over digests."""
    x = F.transform("x", lambda v, i: files.noise(F.col("vec_id"), i))
    return signals(spark, sf).select("vec_id", F.posexplode(x).alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


def _npy(spark, sf, make):
    """(path, content): an .npy file of each window, ``make`` gives its array."""
    def pack(batches):
        for b in batches:
            out = []
            for x in b.column("x").to_pylist():
                held = io.BytesIO()
                np.save(held, make(np.array(x)))
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.string()), pa.array(out, pa.binary())], names=["path", "content"])

    return signals(spark, sf).select("vec_id", "x").mapInArrow(pack, "path string, content binary")


@query(f"WITH {SAMPLES} SELECT vec_id::VARCHAR AS path, CAST(i // 16 AS INT) AS channel, round(sum(v), 6) AS total FROM v WHERE i % 16 BETWEEN 2 AND 13 GROUP BY 1, 2")
def src_decode(spark, sf):
    """Binary records decoded into channels, cropped at the centre: from files to a patch table."""
    data = files.decode_records(_npy(spark, sf, lambda x: x.reshape(4, 16)), files.decode_npy).select("path", F.posexplode("data").alias("channel", "row"))
    total = F.aggregate(files.centred("row", 12), F.lit(0.0), lambda a, v: a + v)
    return data.select("path", "channel", F.round(total, 6).alias("total"))


@query(f"WITH {SAMPLES} SELECT vec_id::VARCHAR AS path, CAST(i // 4 AS INT) AS block, CAST(i % 4 AS INT) AS locus FROM v WHERE v > 0 AND i // 4 <= 12")
def src_maskfile(spark, sf):
    """True cells of boolean masks in files, where a whole window of four blocks fits."""
    return files.mask_cells(_npy(spark, sf, lambda x: x.reshape(16, 4) > 0))


@query("SELECT vec_id::VARCHAR AS path, 'curve1' AS curve, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[3]::DOUBLE, 6) AS y FROM embeddings UNION ALL SELECT vec_id::VARCHAR, 'curve1', round(embedding[2]::DOUBLE, 6), round(embedding[4]::DOUBLE, 6) FROM embeddings")
def src_curves(spark, sf):
    """Points of the annotated curves of JSON files; other keys are no curves."""
    curve = lambda n: F.struct(F.slice("x", 1, 2).alias("x"), F.slice("x", 3, 2).alias("y")).alias(n)
    text = signals(spark, sf).select(F.col("vec_id").cast("string").alias("path"), F.to_json(F.struct(curve("curve1"), curve("other"))).alias("json"))
    points = files.polygons(text).select("path", "curve", F.explode(F.arrays_zip("x", "y")).alias("p"))
    return points.select("path", "curve", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_RECORDINGS = SAMPLES + """, f AS (SELECT vec_id, 'c' || label AS folder, 'rec.' || vec_id AS stem, sum(v) AS total, count(*) FILTER (v > 0) AS cells FROM v WHERE vec_id % 10 <> 3 GROUP BY 1, 2, 3)"""


@query(f"""WITH {_RECORDINGS} SELECT folder, stem, vec_id % 2 = 1 AS has_json, round(total, 6) AS total, cells, CASE WHEN vec_id % 2 = 1 THEN '{{"id":' || vec_id || '}}' END AS annotation FROM f""")
def src_recordings(spark, sf):
    """Windows as files of recordings, some without a mask or an annotation, read by the data source of recordings."""
    row = lambda wide: F.transform(F.sequence(F.lit(0), F.lit(64 // wide - 1)), lambda k: F.slice("x", k * wide + 1, F.lit(wide)))
    r = signals(spark, sf).select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("folder"), F.concat(F.lit("rec."), F.col("vec_id").cast("string")).alias("stem"), row(16).alias("data"),
        F.when(F.col("vec_id") % 10 != 3, F.transform(row(4), lambda b: F.transform(b, lambda v: v > 0))).alias("mask"),
        F.when(F.col("vec_id") % 2 == 1, F.to_json(F.struct(F.col("vec_id").alias("id")))).alias("annotation"),
    )
    top = _scratch(spark)
    rec.store(r, top)
    total = F.aggregate(F.flatten("data"), F.lit(0.0), lambda a, v: a + v)
    cells = F.size(F.filter(F.flatten("mask"), lambda v: v)).cast("long")
    return rec.scan(spark, top).select("folder", "stem", "has_json", F.round(total, 6).alias("total"), cells.alias("cells"), "annotation")


@query(f"WITH {_RECORDINGS} SELECT folder, count(*) AS n, CAST(sum(cells) AS BIGINT) AS cells FROM f WHERE folder IN ('c1', 'c4') GROUP BY 1")
def src_recpruned(spark, sf):
    """True cells of the masks of two classes: other folders aren't listed, data and annotations not opened."""
    r = signals(spark, sf).select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("folder"), F.concat(F.lit("rec."), F.col("vec_id").cast("string")).alias("stem"), F.array("x").alias("data"),
        F.when(F.col("vec_id") % 10 != 3, F.array(F.transform("x", lambda v: v > 0))).alias("mask"), F.lit(None).cast("string").alias("annotation"),
    )
    top = _scratch(spark)
    rec.store(r, top)
    masks = rec.scan(spark, top, ("folder", "mask"), folders=["c1", "c4"])
    return masks.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter(F.flatten("mask"), lambda v: v))).alias("cells"))


@query()
def src_env(spark, sf):
    """The manifest of a run: versions of what runs, and rows and columns of each table that it reads."""
    out = files.environment(spark)
    table = F.regexp_extract("path", r"/([^/]+\.parquet)(/|$)", 1)  # a file, or a folder of parts
    for r in files.listing(spark, sf).select(table.alias("table")).filter("table <> ''").distinct().orderBy("table").collect():  # one row a table
        t = spark.read.parquet(f"{sf}/{r['table']}")
        out = out.unionByName(t.agg(F.concat_ws(" x ", F.count(F.lit(1)), F.lit(len(t.columns))).alias("version")).select(F.lit(r["table"]).alias("component"), "version"))
    return out


@query(f"WITH {RECORDS} SELECT official_split, count(*) AS count FROM r WHERE session_id IN (SELECT session_id FROM r GROUP BY 1 HAVING count(DISTINCT official_split) > 1) GROUP BY 1")
def src_official(spark, sf):
    """Records that the official split puts on both sides of a session."""
    r = records(spark, sf)
    both = r.groupBy("session_id").agg(F.countDistinct("official_split").alias("n")).filter("n > 1").select("session_id")
    return r.join(both, "session_id", "left_semi").groupBy("official_split").count()


@query("SELECT n_nationkey, n_name FROM nation")
def src_csv(spark, sf):
    """A CSV report, read with a given schema."""
    path = _scratch(spark)
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    n.write.csv(path, header=True)
    return spark.read.schema(n.schema).csv(path, header=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def srt_generic(spark, sf):
    """The head of a sorted report."""
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
