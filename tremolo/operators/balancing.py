"""Class balancing of training rows (id, y, features); never applied to rows that are predicted."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import work_dir
from .splits import per_group, seeded

#: Rows of a block in the search for neighbours; blocks of rows that a task reads; distances that it takes at once.
BLOCK, HELD, TILE = 4096, 16, 1 << 18


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """``weight`` = n / (classes * class size)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = c.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(total).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(w), label)


def undersample(df: DataFrame, label: str = "y", order=None, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return per_group(df, [label], F.lit(least), order or seeded("id", seed), least)


def _blocks(df: DataFrame, part, prefix: str, partitions: int, n_blocks: int, *more: str) -> DataFrame:
    """(part, block, ids, ys, xs, then ``more``): rows in blocks of about BLOCK, by a hash of their id, dealt over ``partitions``."""
    rows = df.select(part.alias("part"), F.col("id").cast("long").alias("id"), F.col("y").cast("string").alias("y"), F.col("features").cast("array<double>").alias("x"), *more)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).repartition(partitions, "part", "block")
    held = rows.groupBy("part", "block").agg(F.collect_list(F.struct("id", "y", "x", *more)).alias("r"))
    return held.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("part", "block")], *[F.col(f"r.{c}").alias(f"{prefix}{c}") for c in ("id", "y", "x", *more)])


def crossed(queries: DataFrame, rows: DataFrame, within_class: bool = False, more: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """Every block of queries (columns q_, with ``more`` of them) beside every block of rows (r_; of its class), a query block's one after the other.

    The blocks are dealt once each; a task reads a part of both from there, so no pair of blocks is shuffled or
    written.  A task holds at most about ``HELD`` blocks of rows.
    ``counted``: a frame with the queries' rows that is cheaper to count.
    """
    part = F.col("y").cast("string") if within_class else F.lit("")

    def size(df: DataFrame) -> tuple[int, int]:
        """(blocks of a class, all blocks)"""
        per = df.groupBy(part.alias("part")).count().agg(F.max("count"), F.sum(F.ceil(F.col("count") / BLOCK))).first()
        return max(1, -(-(per[0] or 0) // BLOCK)), max(1, int(per[1] or 0))

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # a pair of blocks or few at a time
    (q_of, q_all), (r_of, r_all) = size(queries if counted is None else counted), size(rows)
    r_parts = -(-r_all // HELD)
    q_parts = min(q_all, max(-(-4 * rows.sparkSession.sparkContext.defaultParallelism // r_parts), -(-q_all // 4)))
    q, r = _blocks(queries, part, "q_", q_parts, q_of, *more), _blocks(rows, part, "r_", r_parts, r_of)
    # Two bounds and not an equality: a join by the class would put all of its blocks into one task.
    return q.join(r, (F.col("q_part") <= F.col("r_part")) & (F.col("q_part") >= F.col("r_part")))


def vectors(column: pa.Array, i: int) -> np.ndarray:
    """Row ``i`` of a column of lists of vectors."""
    held = column[i].values
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _rough(qx: np.ndarray, rx: np.ndarray, metric: str, step: int):
    """(first query, distances of ``step`` queries to all rows, how far each may be off), in single precision where numbers allow it."""
    centre = rx.mean(axis=0)
    qx, rx = qx - centre, rx - centre
    kind = np.float32 if max(np.abs(qx).max(), np.abs(rx).max()) < 1e15 else np.float64
    if metric == "manhattan":
        off = np.abs(qx).sum(axis=1) + np.abs(rx).sum(axis=1).max()
        q, r = qx.astype(kind), np.ascontiguousarray(rx.T, kind)
    else:
        q2, r2 = (qx * qx).sum(axis=1), (rx * rx).sum(axis=1)
        off, one = q2 + r2.max(), lambda x: np.ones((len(x), 1))
        q, r = np.hstack([qx, q2[:, None], one(qx)]).astype(kind), np.hstack([-2 * rx, one(rx), r2[:, None]]).astype(kind).T
    off *= 2 * (qx.shape[1] + 8) * np.finfo(kind).eps
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        if metric == "manhattan":
            far, gap = np.zeros((len(part), r.shape[1]), kind), np.empty((len(part), r.shape[1]), kind)
            for f, b in enumerate(r):
                np.subtract(part[:, f, None], b, out=gap)
                np.abs(gap, out=gap)
                far += gap
        else:
            far = part @ r
        yield lo, far, off[lo : lo + step]


class _Nearest:
    """The k nearest rows so far of each query of a block, in order of (distance, id)."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.worst = ids, k, np.full(len(ids), np.inf)
        self.q, self.d, self.id, self.y = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object)

    def wanted(self, far: np.ndarray, off: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) that may be among the nearest, of queries from ``lo`` on."""
        worst = self.worst[lo : lo + len(far)]
        if far.shape[1] > self.k + 1 and np.isinf(worst).any():  # the query itself may be one of the rows
            worst = np.minimum(worst, np.partition(far, self.k, axis=1)[:, self.k] + off)
            worst[np.isnan(worst)] = np.inf
        at, row = np.nonzero(far <= (worst + off)[:, None])
        return at + lo, row

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        ok = np.isfinite(d) & (ids != self.ids[q]) & (d <= self.worst[q])
        if not ok.any():
            return
        hit = np.zeros(len(self.ids), bool)
        hit[q[ok]] = True
        mine = hit[self.q]
        parts = [(self.q[mine], q[ok]), (self.d[mine], d[ok]), (self.id[mine], ids[ok]), (self.y[mine], y[ok])]
        q, d, ids, y = map(np.concatenate, parts)
        order = np.lexsort((ids, d, q))
        q, d, ids, y = q[order], d[order], ids[order], y[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last, stay = place == self.k - 1, place < self.k
        self.worst[q[last]] = d[last]
        self.q, self.d, self.id, self.y = (np.concatenate([a[~mine], b[stay]]) for a, b in ((self.q, q), (self.d, d), (self.id, ids), (self.y, y)))

    def batch(self, other: str) -> pa.RecordBatch:
        order = np.lexsort((self.id, self.d, self.q))
        ends = np.searchsorted(self.q[order], np.arange(len(self.ids) + 1))
        near = pa.StructArray.from_arrays([pa.array(self.d[order]), pa.array(self.id[order]), pa.array(self.y[order], pa.string())], names=["d", "id", "y"])
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array([other] * len(self.ids), pa.string()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), near)], names=["id", "other", "near"])


def neighbours(queries: DataFrame, rows: DataFrame, k: int, within_class: bool = False, each_class: bool = False, metric: str = "euclidean") -> DataFrame:
    """(id, near): the k nearest other rows of each query (d, id, y), exactly; ties by id.

    ``within_class``: of the query's class only.  ``each_class``: of every class, as rows (id, other, near).
    ``metric``: euclidean (d is squared) or manhattan.

    Every block of queries meets every block of rows (of its class); a task keeps the k best of all blocks of rows
    that it reads, and the best of the tasks' are the answer.  Distances are first taken roughly, with a bound of the
    error; those that may be among the nearest are then taken exactly.  The work grows with queries times rows, as
    an exact search's does; memory is two blocks and a task's rows, and what is shuffled is the rows once and the
    candidates of each task.
    """
    met = crossed(queries, rows, within_class).select("q_part", "q_block", "q_id", "q_x", "r_id", "r_y", "r_x")

    def best(batches):
        at, held = None, {}
        for b in batches:
            for n in range(b.num_rows):
                mark = b.column("q_part")[n].as_py(), b.column("q_block")[n].as_py()
                if mark != at:
                    yield from (h.batch(c) for c, h in held.items())
                    at, held = mark, {}
                    qi, qx = b.column("q_id")[n].values.to_numpy(), vectors(b.column("q_x"), n)
                ri, ry, rx = b.column("r_id")[n].values.to_numpy(), np.array(b.column("r_y")[n].values.to_pylist(), object), vectors(b.column("r_x"), n)
                for c in sorted(set(ry.tolist()), key=str) if each_class else [""]:
                    mine = np.flatnonzero(ry == c) if each_class else np.arange(len(ri))
                    near, z = held.setdefault(c, _Nearest(qi, k)), rx[mine]
                    for lo, far, off in _rough(qx, z, metric, max(1, TILE // len(mine))):
                        i, j = near.wanted(far, off, lo)
                        gap = z[j] - qx[i]
                        near.add(i, (np.abs(gap) if metric == "manhattan" else gap**2).sum(axis=1), ri[mine][j], ry[mine][j])
        yield from (h.batch(c) for c, h in held.items())

    found = met.mapInArrow(best, "id long, other string, near array<struct<d:double,id:long,y:string>>")
    found = found.groupBy("id", "other").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return found if each_class else found.drop("other")


def smote(df: DataFrame, k: int = 5, seed: int = 42, borderline: bool = False) -> DataFrame:
    """Synthetic rows on segments between a row and one of its k nearest of the class, up to the largest class.

    ``borderline`` starts only from rows of which at least half, but not all, of the k nearest rows are of another
    class (from all rows of a class without such a row).  Every row of a class starts about equally many segments.
    Synthetic rows have negative ids; an id must be below 2 ** 42.
    """
    base = df.select(F.col("id").cast("long").alias("id"), "y", F.col("features").cast("array<double>").alias("features"))
    sizes = {r["y"]: r["count"] for r in base.groupBy("y").count().collect()}  # one row a class
    need = {y: max(sizes.values()) - n for y, n in sizes.items() if 1 < n < max(sizes.values())}
    if not need:
        return base
    start = base.filter(F.col("y").isin(*need))
    near = neighbours(start, start, k, within_class=True)
    if borderline:
        around = start.select("id", "y").join(neighbours(start, base, k).select("id", F.explode("near.y").alias("other")), "id")
        share = around.groupBy("id", "y").agg(F.avg((F.col("other") != F.col("y").cast("string")).cast("int")).alias("share"))
        danger = share.filter("share >= 0.5 and share < 1").select("id", "y")
        without = [y for y in need if y not in {r["y"] for r in danger.select("y").distinct().collect()}]
        start = start.join(danger.select("id"), "id", "left_semi").unionByName(start.filter(F.col("y").isin(*without)))
    many = {r["y"]: r["count"] for r in start.groupBy("y").count().collect()}
    by = lambda f: F.element_at(F.create_map(*[F.lit(x) for y in need for x in (y, f(y))]), F.col("y"))
    more = per_group(start.select("id", "y"), ["y"], by(lambda y: need[y] % many[y]), seeded("id", seed), max(1, *(need[y] % many[y] for y in need))).select("id", F.lit(1).alias("_more"))
    times = by(lambda y: need[y] // many[y]) + F.coalesce("_more", F.lit(0))
    made = start.join(near, "id").join(more, "id", "left").withColumn("_j", F.explode(F.sequence(F.lit(0), times))).filter(F.col("_j") > 0)
    pick = F.pmod(F.xxhash64(F.lit(seed), "id", "_j"), F.size("near"))
    made = made.withColumn("_to", F.get("near", pick.cast("int"))["id"]).withColumn("_u", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "_j"), F.lit(1 << 30)) / (1 << 30))
    ends = base.select(F.col("id").alias("_to"), F.col("features").alias("_end"))
    between = F.transform(F.arrays_zip("features", "_end"), lambda v: v["features"] + F.col("_u") * (v["_end"] - v["features"]))
    made = made.join(ends, "_to").select((-(F.col("id") * F.lit(1 << 20) + F.col("_j"))).alias("id"), "y", between.alias("features"))
    return base.unionByName(made)


def tomek_links(df: DataFrame) -> DataFrame:
    """Ids of rows that are each other's nearest row and of different classes."""
    near = neighbours(df, df, 1).join(df.select(F.col("id").cast("long").alias("id"), F.col("y").cast("string").alias("mine")), "id")
    near = near.select("id", "mine", F.get("near", F.lit(0))["id"].alias("to"), F.get("near", F.lit(0))["y"].alias("other")).filter("mine <> other")
    back = near.select(F.col("id").alias("to"), F.col("to").alias("id"))
    return near.join(back, ["id", "to"], "left_semi").select("id")


def smote_tomek(df: DataFrame, seed: int = 42) -> DataFrame:
    """The new rows are written once: the search for links reads them several times."""
    path = f"{work_dir(df.sparkSession)}/smote-{uuid.uuid4().hex}"
    made = smote(df, seed=seed)
    made.write.parquet(path)
    more = df.sparkSession.read.schema(made.schema).parquet(path)
    return more.join(tomek_links(more), "id", "left_anti")


SAMPLERS = {
    "none": lambda d: d.select("id", "y", "features"), "class_weight": lambda d: class_weights(d), "undersample": lambda d: undersample(d),
    "smote": lambda d: smote(d), "borderline_smote": lambda d: smote(d, borderline=True), "smote_tomek": smote_tomek,
}


def describe(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts by class before and after, and their ratio."""
    a, b = (d.groupBy("y").agg(F.count(F.lit(1)).alias(n)) for d, n in ((before, "before"), (after, "after")))
    j = a.join(b, "y", "full").na.fill(0, ["before", "after"])
    return j.withColumn("ratio", F.try_divide(F.col("after").cast("double"), F.col("before")))


def effect(df: DataFrame) -> DataFrame:
    """Rows, smallest and largest class, imbalance."""
    c = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") / F.min("n")).alias("imbalance"))


def majority(df: DataFrame, label: str = "y") -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("chance"))


__all__ = ["SAMPLERS", "class_weights", "describe", "effect", "majority", "neighbours", "smote", "smote_tomek", "tomek_links", "undersample"]
