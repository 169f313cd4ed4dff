"""Metrics of predictions (y_true, y_pred) as aggregates over the confusion table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .statistics import average_rank


def confusion(df: DataFrame, normalise: bool = False) -> DataFrame:
    """Every pair of labels with its count, or its share of the true label."""
    labels = df.select(F.col("y_true").alias("l")).union(df.select("y_pred")).distinct()
    grid = labels.select(F.col("l").alias("y_true")).crossJoin(F.broadcast(labels.select(F.col("l").alias("y_pred"))))
    n = df.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, ["y_true", "y_pred"], "left").na.fill(0, ["n"])
    if normalise:
        total = F.sum("n").over(Window.partitionBy("y_true"))
        out = out.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)))
    return out


def per_class(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each label; 0 where a denominator is 0."""
    both = df.select(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("tp"))
    both = both.union(df.select(F.col("y_pred"), F.lit(0), F.lit(1), F.lit(0)))
    c = both.groupBy("label").agg(*[F.sum(x).cast("double").alias(x) for x in ("t", "p", "tp")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(
        "label", zero(F.col("tp"), F.col("p")).alias("precision"), zero(F.col("tp"), F.col("t")).alias("recall"),
        zero(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"), F.col("t").cast("long").alias("support"), F.col("tp").cast("long").alias("tp"),
    )


def scores(df: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro precision, recall and F1, weighted F1."""
    c = per_class(df)
    return c.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def report(df: DataFrame) -> DataFrame:
    """Classes, then accuracy, macro and weighted averages."""
    c = per_class(df)
    keys = ("precision", "recall", "f1")
    rows = c.select(F.col("label").cast("string").alias("class"), *keys, "support")
    accuracy = (F.sum("tp") / F.sum("support")).alias("a")
    acc = c.agg(accuracy, F.sum("support").alias("support")).select(F.lit("accuracy").alias("class"), *[F.col("a").alias(k) for k in keys], "support")
    macro = c.agg(*[F.avg(k).alias(k) for k in keys], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *keys, "support")
    weighted = c.agg(*[(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k) for k in keys], F.sum("support").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted.select(F.lit("weighted avg").alias("class"), *keys, "support"))


def auc_ovr(df: DataFrame, cls: str = "cls", score: str = "score") -> DataFrame:
    """Macro one-versus-rest AUC over rows (sample, cls, score, y_true), by average ranks; NULL if a class is absent."""
    r = df.withColumn("r", average_rank([cls], score, descending=False)).withColumn("pos", (F.col("y_true") == F.col(cls)).cast("int"))
    c = r.groupBy(cls).agg(F.sum("pos").cast("double").alias("p"), F.sum(1 - F.col("pos")).cast("double").alias("n"), F.sum(F.col("pos") * F.col("r")).alias("s"))
    one = c.withColumn("auc", F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")))
    return one.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("auc_ovr_macro"))


def error_modes(df: DataFrame) -> DataFrame:
    """Off-diagonal confusions by their share of the true label."""
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return confusion(df).withColumn("pct_of_true", F.try_divide(100.0 * F.col("n"), total)).filter("y_true <> y_pred and n > 0")


def nar_fnr(df: DataFrame, background) -> DataFrame:
    """Nuisance alarm rate (false alarms / alarms) and false negative rate (missed / events); NULL without a base."""
    alarm, event = F.col("y_pred") != background, F.col("y_true") != background
    return df.agg(
        F.try_divide(F.count_if(alarm & ~event).cast("double"), F.count_if(alarm)).alias("nar"),
        F.try_divide(F.count_if(event & ~alarm).cast("double"), F.count_if(event)).alias("fnr"),
    )
