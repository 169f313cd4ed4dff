"""Audits of splits and tables: each returns its evidence as rows; ``require_empty`` turns evidence into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import BLOCKS_PER_WINDOW, SPLITS


def group_offenders(df: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(group).agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def duplicate_ids(df: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.agg((F.count(key) - F.countDistinct(key)).alias("n_duplicates"))


def shared_blocks(df: DataFrame, recording: str = "recording_id", block: str = "block") -> DataFrame:
    """Blocks of a recording that windows of several splits read, by pair of splits."""
    read = df.select(recording, "split", F.explode(F.sequence(F.col(block), F.col(block) + BLOCKS_PER_WINDOW - 1)).alias("read"))
    sets = read.groupBy(recording, "read").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    first = sets.select(recording, "read", "s", F.posexplode("s").alias("i", "split_a"))
    pairs = first.select(recording, "read", "split_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("split_b"))
    return pairs.groupBy(recording, "split_a", "split_b").agg(F.count(F.lit(1)).alias("n_blocks"))


def missing_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """(split, label) combinations without a row."""
    grid = df.select(label).distinct().crossJoin(df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string"))
    return grid.join(df.select(label, "split").distinct(), [label, "split"], "left_anti")


def scorecard(df: DataFrame, group: str, label: str = "label", block: str | None = "block", recording: str = "recording_id") -> DataFrame:
    """check, status, detail of all audits; the detail is a count of the evidence."""
    evidence = [
        ("groups in one split", group_offenders(df, group).agg(F.count(F.lit(1)).alias("n"))),
        ("unique sample ids", duplicate_ids(df).select(F.col("n_duplicates").alias("n"))),
        ("every class in every split", missing_classes(df, label).agg(F.count(F.lit(1)).alias("n"))),
    ]
    if block:
        evidence.append(("no block read by two splits", shared_blocks(df, recording, block).agg(F.count(F.lit(1)).alias("n"))))
    out = None
    for name, rows in evidence:
        row = rows.select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"), F.col("n").cast("string").alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out


def require_empty(evidence: DataFrame, message: str, show: int = 5) -> None:
    """Raise with the first rows of the evidence, if there is any."""
    rows = evidence.limit(show).collect()
    if rows:
        raise ValueError(f"{message}: {rows}")
