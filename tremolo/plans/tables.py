"""The driver's tables in the roles of sensing tables, for queries and (as common table expressions) for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window manifest: events as windows of a recording (event type), block = hour, locus = user."""
    k = F.get_json_object("props", "$.k").cast("int")
    block = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("ev::"), "event_id").alias("sample_id"), "event_id", F.col("event_type").alias("recording_id"), block.alias("block"), F.col("user_id").cast("int").alias("locus"), k.alias("k"), "value")
    return e.withColumns({
        "label": F.concat(F.lit("c"), (F.col("k") % 9).cast("string")), "zone": F.floor(F.col("block") / 21).cast("int"),
        "t0": F.col("block").cast("long") * 2048, "t1": F.col("block").cast("long") * 2048 + 8192,
    }).withColumn("zone_id", F.concat_ws("|", "recording_id", F.col("zone").cast("string")))


WINDOWS = """w0 AS (SELECT 'ev::' || event_id AS sample_id, event_id, event_type AS recording_id,
  CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS block, CAST(user_id AS INT) AS locus,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events),
w AS (SELECT *, 'c' || (k % 9) AS label, CAST(floor(block / 21) AS INT) AS zone, CAST(block AS BIGINT) * 2048 AS t0,
  CAST(block AS BIGINT) * 2048 + 8192 AS t1, recording_id || '|' || CAST(floor(block / 21) AS INT) AS zone_id FROM w0)"""


def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with segment and split; the offset of a recording is the length of its name."""
    from ..operators import splits

    return splits.rotate(splits.segments(windows(spark, sf_dir)), F.length("recording_id"))


SPLIT = WINDOWS + """,
s0 AS (SELECT *, CAST(least(floor((rank() OVER (PARTITION BY recording_id ORDER BY block) - 1) / count(*) OVER (PARTITION BY recording_id) * 10), 9) AS INT) AS segment FROM w),
s AS (SELECT *, CASE ((segment - length(recording_id)) % 10 + 10) % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM s0),
g0 AS (SELECT *, min(split) OVER f = max(split) OVER f AS keep FROM s WINDOW f AS (PARTITION BY recording_id ORDER BY block RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
g AS (SELECT * FROM g0 WHERE keep)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File manifest: line items as records of a session (supplier), with an official split and a date."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"), F.concat(F.lit("s"), "l_suppkey").alias("session_id"),
        F.col("l_returnflag").alias("label"), F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("official_split"),
        F.date_format("l_shipdate", "yyMMdd").alias("date"), F.col("l_quantity").alias("quantity"), (F.col("l_quantity").cast("long") - 1).alias("n_bytes"),
    )


RECORDS = """r AS (SELECT l_orderkey || '-' || l_linenumber AS sample_id, 's' || l_suppkey AS session_id, l_returnflag AS label,
  CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS official_split, strftime(l_shipdate, '%y%m%d') AS date, l_quantity AS quantity,
  CAST(l_quantity AS BIGINT) - 1 AS n_bytes FROM lineitem)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-sample windows: vec_id, x (array of doubles), label."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in blocks: five recordings of eight loci, 64 samples a block."""
    at = F.floor(F.col("vec_id") / 5)
    return signals(spark, sf_dir).select((F.col("vec_id") % 5).alias("recording_id"), F.floor(at / 8).alias("block"), (at % 8).alias("locus"), F.col("x").alias("samples"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: vec_id, label, i (from 0), v."""
    return signals(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("i", "v"))


SAMPLES = """x AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
v AS (SELECT vec_id, label, CAST(unnest(range(0, len(x))) AS INT) AS i, unnest(x) AS v FROM x)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, y_true and a deterministic y_pred that is right for about two thirds."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), F.col("label").cast("int").alias("y_true"), F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 10).otherwise(F.col("label")).cast("int").alias("y_pred"))


PREDICTIONS = """p AS (SELECT vec_id AS sample, CAST(label AS INT) AS y_true, CAST(CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 ELSE label END AS INT) AS y_pred FROM embeddings)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark table: model (part brand) x strategy (part size mod 6), with the mean price as its score."""
    p = read(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("model"), F.concat(F.lit("s"), F.col("p_size") % 6).alias("strategy")).agg(F.round(F.avg("p_retailprice"), 3).alias("f1"), F.count(F.lit(1)).alias("n"))


GRID = """b AS (SELECT p_brand AS model, 's' || (p_size % 6) AS strategy, round(avg(p_retailprice), 3) AS f1, count(*) AS n FROM part GROUP BY 1, 2)"""
