"""Structured Streaming forms of the windowed aggregates; each equals its batch form on the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_dir


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    g = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "4 hours", hop: str = "1 hour") -> DataFrame:
    g = events.groupBy(F.window("ts", width, hop)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), "user_id", "n")


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of rows that repeat an id within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def rings(events: DataFrame, blocks: int = 4) -> DataFrame:
    """Overlapping windows of the last ``blocks`` values per user: a ring buffer held as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for i, v in zip(rows["event_id"], rows["value"], strict=True):
            held = [*held, float(v)][-blocks:]
            if len(held) == blocks:
                out.append((key[0], int(i), round(sum(held), 4)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "total"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, total double", "held array<double>", "append", "NoTimeout")


def run(spark: SparkSession, folder: str, transform: Callable[[DataFrame], DataFrame], mode: str, watermark: str | None = "1 day") -> DataFrame:
    """All rows of a Parquet folder through a streaming query into Parquet files, to the end of the input."""
    schema = spark.read.parquet(folder).schema
    # A file source reads folders: the file's name is the filter.
    parent, _, name = folder.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent if name.endswith(".parquet") else folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        stream = stream.withWatermark("ts", watermark)
    result, top = transform(stream), f"{work_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, number: int) -> None:
        # A batch that runs again replaces what it wrote; a complete result replaces the one before it.
        batch.write.mode("overwrite").parquet(f"{top}/data/{'all' if mode == 'complete' else number}")

    result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{top}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", True).parquet(f"{top}/data")
