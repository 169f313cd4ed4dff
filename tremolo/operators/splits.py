"""Leakage-safe splits of overlapping windows: window frames instead of interval joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import work_dir

#: Blocks that one window reads.
BLOCKS_PER_WINDOW = 4
SPLITS = ("train", "val", "test")


def _by_block(df: DataFrame, recording: str, block: str, found: Callable[[DataFrame], DataFrame], *aggs: Column) -> DataFrame:
    """``df`` with the columns that ``found`` adds to its table of blocks (recording, block, ``aggs``).

    Window frames run over that table, a row for each block, so a recording's windows never meet in one task.
    """
    at, then = "_at_recording", "_at_block"
    table = found(df.groupBy(F.col(recording).alias(at), F.col(block).alias(then)).agg(*aggs))
    new = [c for c in table.columns if c not in (at, then) and not c.startswith("_")]
    # Text and number, so that a missing recording is a recording like any other.
    joined = df.join(table, F.col(recording).eqNullSafe(F.col(at)) & F.col(block).eqNullSafe(F.col(then)))
    return joined.select(*[df[c] for c in df.columns if c not in new], *[table[c] for c in new])


def _frame(reach: int):
    return Window.partitionBy("_at_recording").orderBy("_at_block").rangeBetween(-reach, reach)


def _segment(table: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("_at_recording")
    first = F.sum("_n").over(by.orderBy("_at_block")) - F.col("_n")
    return table.withColumn("segment", F.least(F.floor(first / F.sum("_n").over(by) * n), F.lit(n - 1)).cast("int"))


def segments(df: DataFrame, recording: str = "recording_id", block: str = "block", n: int = 10) -> DataFrame:
    """Contiguous segments of equal mass per recording; a block is never cut, as its least rank counts."""
    return _by_block(df, recording, block, lambda t: _segment(t, n), F.count(F.lit(1)).alias("_n"))


def rotate(df: DataFrame, offset: Column, n: int = 10, n_val: int = 1, n_test: int = 1) -> DataFrame:
    """Split by segment: ``n_val`` segments from the recording's offset, the next ``n_test``, the rest train."""
    at = F.pmod(F.col("segment") - offset, F.lit(n))
    return df.withColumn("split", F.when(at < n_val, "val").when(at < n_val + n_test, "test").otherwise("train"))


def guard(df: DataFrame, recording: str = "recording_id", block: str = "block", guard_blocks: int = 4) -> DataFrame:
    """``keep``: no window of another split within the blocks that a window reads plus the guard."""
    near = _frame(BLOCKS_PER_WINDOW - 1 + guard_blocks)
    alone = lambda t: t.withColumn("keep", F.min("_lo").over(near) == F.max("_hi").over(near))
    return _by_block(df, recording, block, alone, F.min("split").alias("_lo"), F.max("split").alias("_hi"))


def contaminated(df: DataFrame, recording: str = "recording_id", block: str = "block") -> DataFrame:
    """Test windows, and whether a train window reads one of their blocks."""
    read = lambda t: t.withColumn("contaminated", F.max("_train").over(_frame(BLOCKS_PER_WINDOW - 1)))
    return _by_block(df, recording, block, read, F.max(F.col("split") == "train").alias("_train")).filter("split = 'test'")


def blocked_split(df: DataFrame, offset: Column) -> DataFrame:
    """Segments, rotation and guard; only windows that the guard keeps."""
    return guard(rotate(segments(df), offset)).filter("keep").drop("keep")


def per_group(df: DataFrame, by: Sequence[str], n: Column, order: Sequence[str | Column], most: int | None = None) -> DataFrame:
    """At most ``n`` rows of each group, the first by ``order``.

    ``most``: a number that no ``n`` exceeds.  Spark then drops what is behind it before the shuffle, so a large
    group is never sorted in one task.
    """
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return (ranked if most is None else ranked.filter(F.col("_k") <= most)).filter(F.col("_k") <= n).drop("_k")


def _counted(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with the size of each row's group: the sizes are summed first and joined, no group meets in a task."""
    sizes = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count(F.lit(1)).alias(name))
    on = [df[c].eqNullSafe(sizes[f"_by_{c}"]) for c in by]
    return df.join(sizes, on).drop(*[f"_by_{c}" for c in by])


def stratified(df: DataFrame, label: str, n_max: int, order: Sequence[str | Column]) -> DataFrame:
    """A proportional sample without replacement: max(1, round(n_max * share)) rows of each label."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    take = sizes.crossJoin(F.broadcast(total)).select("_label", F.greatest(F.lit(1), F.bround(n_max * (F.col("_c") / F.col("_t")))).alias("_n"))
    return per_group(df.join(take, df[label].eqNullSafe(take["_label"])).drop("_label"), [label], F.col("_n"), order, max(1, n_max)).drop("_n")


def seeded(key: str, seed: int = 42) -> list[Column | str]:
    """The order of a random sample that reruns agree on."""
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def decimate(df: DataFrame, caps: Mapping[str, int], order: Sequence[str | Column], label: str = "label", split: str = "split") -> DataFrame:
    """Cap large classes: the fraction cap / class total applied inside each (label, split), at least one row."""
    if not caps:
        return df
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(label)]
    sized = _counted(_counted(df, [label], "_total"), [label, split], "_sub").withColumn("_cap", cap)
    over = F.coalesce(F.col("_cap") < F.col("_total"), F.lit(False))
    n = F.greatest(F.lit(1), F.bround(F.col("_cap") / F.col("_total") * F.col("_sub")))
    cut = per_group(sized.filter(over), [label, split], n, order, max(1, *caps.values()))
    return sized.filter(~over).unionByName(cut).drop("_total", "_sub", "_cap")


def ranked(df: DataFrame, by: str, order: Sequence[str | Column]) -> DataFrame:
    """``df`` with rank and group_size of each row in its group by ``order``; equal rows share the least rank.

    Rows are cut into ranges of (group, order), which are written once: ranks run inside a range, and a row a group
    and range says how many rows lie before it.  So no group is sorted in one task.
    """
    spark, keys = df.sparkSession, [f"_key{i}" for i in range(len(order))]
    put = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, order, strict=True)}).repartitionByRange(by, *keys).withColumn("_range", F.spark_partition_id())
    path = f"{work_dir(spark)}/tremolo-ranks-{uuid.uuid4().hex[:12]}"
    put.write.parquet(path)
    rows = spark.read.schema(put.schema).parquet(path)
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_by")  # a row a range
    counts = counts.withColumns({"_before": F.sum("_n").over(w.orderBy("_in")) - F.col("_n"), "group_size": F.sum("_n").over(w)})
    inside = F.rank().over(Window.partitionBy(by, "_range").orderBy(*keys))
    rows = rows.withColumn("_rank", inside).join(counts, rows[by].eqNullSafe(counts["_by"]) & (F.col("_range") == F.col("_in")))
    return rows.withColumn("rank", F.col("_before") + F.col("_rank")).select(*df.columns, "rank", "group_size")


def random_split(df: DataFrame, label: str, order: Sequence[str | Column]) -> DataFrame:
    """The leaky counter-example: 80/10/10 at random inside each label."""
    p = (F.col("rank") - 1) / F.greatest(F.col("group_size") - 1, F.lit(1))
    return ranked(df, label, order).withColumn("split", F.when(p < 0.8, "train").when(p < 0.9, "val").otherwise("test")).drop("rank", "group_size")


#: Groups, the largest, that are dealt one by one on the driver; the others are dealt in strata, in tasks.
GREEDY = 10_000
#: Groups of a stratum that one task numbers.
STRATUM = 1000


def _dealt_greedily(rows: list, group: str, label: str, total: dict, n: int) -> tuple[list[tuple], list[dict]]:
    """(group, fold) of groups given by (group, label, count), and the label counts of the folds: the largest first, to the fold with the lowest cost of squared label shares."""
    labels = sorted(total, key=str)
    counts: dict = {}
    for r in rows:
        counts.setdefault(r[group], dict.fromkeys(labels, 0))[r[label]] = r["count"]
    load = [dict.fromkeys(labels, 0) for _ in range(n)]
    where = []
    for g in sorted(counts, key=lambda g: (-max(counts[g].values()), -sum(counts[g].values()), str(g))):
        def cost(f: int) -> tuple[float, int, int]:
            return (sum(((load[f][k] + counts[g][k]) / total[k]) ** 2 - (load[f][k] / total[k]) ** 2 for k in labels), sum(load[f].values()), f)

        best = min(range(n), key=cost)
        where.append((g, best))
        for k in labels:
            load[best][k] += counts[g][k]
    return where, load


def grouped_folds(df: DataFrame, group: str, label: str, n: int = 10) -> DataFrame:
    """``fold``: whole groups, dealt so that every fold's label counts stay near a share of 1 / n.

    The ``GREEDY`` largest groups are dealt on the driver, one by one.  The others, each no larger than any of those,
    are numbered inside strata of the same main label and about the same size, and are spread evenly over what the
    folds lack of that label.
    """
    rows = df.groupBy(group, label).count()
    total = {r[label]: r["sum(count)"] for r in rows.groupBy(label).sum("count").collect()}  # one row a label
    sizes = rows.groupBy(group).agg(F.max("count").alias("_top"), F.sum("count").alias("_all"), F.max_by(label, F.struct("count", F.xxhash64(label))).alias("_main"))
    large = sizes.orderBy(F.desc("_top"), F.desc("_all"), F.col(group).cast("string")).limit(GREEDY)
    kind = df.schema[group].dataType.simpleString()
    picked = rows.join(F.broadcast(large.select(F.col(group).alias("_g"))), F.col(group).eqNullSafe(F.col("_g")), "left_semi").collect()  # GREEDY groups
    where, load = _dealt_greedily(picked, group, label, total, n)
    dealt = df.sparkSession.createDataFrame(where, f"`{group}` {kind}, fold int")
    if sizes.count() > GREEDY:
        rest = sizes.join(F.broadcast(dealt.select(F.col(group).alias("_g"))), F.col(group).eqNullSafe(F.col("_g")), "left_anti")
        lacks = []
        for k, t in total.items():
            lack = [max(t / n - f[k], 0.0) for f in load]
            ends = [sum(lack[: i + 1]) / max(sum(lack), 1e-9) for i in range(n - 1)]
            lacks.append((k, ends))
        ends = df.sparkSession.createDataFrame(lacks, f"_label {df.schema[label].dataType.simpleString()}, _ends array<double>")  # one row a label
        rest = rest.join(F.broadcast(ends), F.col("_main").eqNullSafe(F.col("_label"))).withColumn("_size", F.floor(F.log(1.25, F.col("_all"))))
        many = rest.groupBy(F.col("_main").alias("_m"), F.col("_size").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / STRATUM).alias("_parts"))
        rest = rest.join(many, F.col("_main").eqNullSafe(F.col("_m")) & (F.col("_size") == F.col("_s"))).withColumn("_part", F.pmod(F.xxhash64(group), F.col("_parts")))
        stratum = Window.partitionBy("_main", "_size", "_part")
        place = (F.row_number().over(stratum.orderBy(F.xxhash64(F.lit(1), group), group)) - 0.5) / F.count(F.lit(1)).over(stratum)
        shift = F.pmod(F.xxhash64("_main", "_size", "_part"), F.lit(1 << 20)) / (1 << 20)
        rest = rest.withColumn("_u", F.pmod(place + shift, F.lit(1.0)))
        dealt = dealt.unionByName(rest.select(group, F.size(F.filter("_ends", lambda e: e <= F.col("_u"))).alias("fold")))
    return df.join(dealt, group)


def grouped_three_way(df: DataFrame, group: str, label: str, fractions: Sequence[float] = (0.8, 0.1, 0.1), n: int = 10) -> DataFrame:
    """Whole groups to train, val and test so that label counts stay near the fractions, which are whole numbers of folds."""
    tenths = [f * n for f in fractions]
    if any(abs(t - round(t)) > 1e-9 for t in tenths) or round(sum(tenths)) != n:
        raise ValueError("fractions must be multiples of 1/n and add up to 1")
    first, second = round(tenths[0]), round(tenths[0]) + round(tenths[1])
    split = F.when(F.col("fold") < first, "train").when(F.col("fold") < second, "val").otherwise("test")
    return grouped_folds(df, group, label, n).withColumn("split", split).drop("fold")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Every row once per held-out group, with its role."""
    held = df.select(F.col(group).alias("held_out")).distinct()
    return df.crossJoin(held).withColumn("role", F.when(F.col(group) == F.col("held_out"), "test").otherwise("train"))


def held_out_counts(df: DataFrame, group: str) -> DataFrame:
    """(held_out, role, n): the rows of ``leave_one_group_out`` counted, without making them: a group's own rows, and all others."""
    own = df.groupBy(F.col(group).alias("held_out")).agg(F.count(F.lit(1)).alias("own"))
    both = own.crossJoin(own.agg(F.sum("own").alias("total")))  # times one row
    roles = F.explode(F.array(F.struct(F.lit("test").alias("role"), F.col("own").alias("n")), F.struct(F.lit("train").alias("role"), (F.col("total") - F.col("own")).alias("n"))))
    return both.select("held_out", roles.alias("r")).select("held_out", "r.role", "r.n").filter("n > 0")


def split_report(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Windows and groups by label and split, with a TOTAL row: one aggregation over grouping sets."""
    named = df.select(F.col(label).cast("string").alias("label"), "split", group)
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    groups = [F.countDistinct(F.when(F.col("split") == s, F.col(group))).alias(f"{s}_groups") for s in SPLITS]
    rows = named.groupBy("label").agg(*counts, *groups)
    totals = rows.groupBy().agg(*[F.sum(c).alias(c) for c in rows.columns[1:]]).select(F.lit("TOTAL").alias("label"), *rows.columns[1:])
    return rows.unionByName(totals)
