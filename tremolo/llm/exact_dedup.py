"""Exact dedup: a minimal perfect hash over the historical distinct digests.

Every row's digest is SHA-256 over its whole text with A-Z lower-cased (null: empty text).  The
historical digests are dealt over shards; each shard gets a minimal perfect hash whose slots hold the
full digest and the locator of the winner.  New rows are grouped by digest and look it up: a byte-for-byte
equal slot is a repeat of history and joins its group, everything else is a nonmember, a group apart.

Defined results
* null text: equal to the empty text.  Null doc_id: smaller than every number.
* rows that repeat a doc_id: one document each; all rows that carry the winning doc_id are kept.
* no rows: an empty result.  Extra columns are not read.  A task holds a very long text three times.

Skew: digests, old and new, are summed inside every Arrow batch and then in every map task before anything
is shuffled, so a group of copies, however large, is one row a map task there and one row at its shard.  Digests spread evenly over
shards; the number of shards follows the number of digests, which bounds a task's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Digests that one shard of the perfect hash is built for.
SHARD_KEYS = 50_000
#: Slots offered per key on each level of the perfect hash.
GAMMA = 1.5
_DIGESTS = "doc_id long, digest binary, old boolean"
_PARTIAL = "digest binary, winner long, n long"


# ---------------------------------------------------------------- the hash
def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slot of each key (n x 4 words of 64 bits) on one level."""
    h = keys[:, level % 4] ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(32))) % np.uint64(size)


class PerfectHash:
    """Levels of bitmaps: a key lands on the first level where it is alone; its rank among all set bits is its slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        base = 0
        for bits in levels:
            self.ranks.append(base + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(1, int(len(left) * GAMMA))
            at = _level_hash(left, len(levels), size)
            bits = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
            if len(levels) > 400:
                raise ValueError("the keys of a perfect hash must be distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if no level claims it; a foreign key may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _level_hash(keys[left], k, len(bits)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join(len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        levels, i = [], 0
        while i < len(blob):
            n = int.from_bytes(blob[i : i + 8], "little")
            size = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, i + 8))[:n].astype(bool))
            i += 8 + size
        return cls(levels)


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


# ---------------------------------------------------------------- steps
def _digest(batches):
    for b in batches:
        low = pc.ascii_lower(pc.fill_null(b.column("text"), ""))
        got = [hashlib.sha256(x).digest() for x in low.cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary()), b.column("old")], names=["doc_id", "digest", "old"])


def _combine(batches):
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("digest").aggregate([("winner", "max"), ("n", "sum")])
        yield from t.select(["digest", "winner_max", "n_sum"]).rename_columns(["digest", "winner", "n"]).combine_chunks().to_batches()


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _words(pdf["digest"])
    mph = PerfectHash.build(keys)
    order = np.argsort(mph.slots(keys))
    digests = pdf["digest"].to_numpy()[order]
    w = pdf["winner"].to_numpy()[order]
    null = pd.isna(w)
    return pd.DataFrame({
        "shard": [pdf["shard"].iloc[0]], "mph": [mph.dump()], "slots": [b"".join(digests)],
        "winners": [np.where(null, np.iinfo(np.int64).min, w).astype(np.int64).tobytes()], "counts": [pdf["n"].to_numpy(np.int64)[order].tobytes()],
    })


def _look_up(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Members raise their slot's count and winner; nonmembers go on as they are."""
    none = np.iinfo(np.int64).min
    w = new["winner"].fillna(none).astype("int64").to_numpy()
    n = new["n"].to_numpy(np.int64)
    parts = []
    member = np.zeros(len(new), bool)
    if len(index):
        row = index.iloc[0]
        mph = PerfectHash.load(row["mph"])
        slot_words = np.frombuffer(row["slots"], np.uint64).reshape(-1, 4)
        winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        if len(new):
            keys = _words(new["digest"])
            at = mph.slots(keys)
            member = at >= 0
            member[member] = (slot_words[at[member]] == keys[member]).all(axis=1)  # byte check
            np.maximum.at(winners, at[member], w[member])
            np.add.at(counts, at[member], n[member])
        blob = row["slots"]
        parts.append(pd.DataFrame({"digest": [blob[i : i + 32] for i in range(0, len(blob), 32)], "winner": winners, "n": counts, "member": True}))
    rest = ~member
    parts.append(pd.DataFrame({"digest": new["digest"].to_numpy()[rest], "winner": w[rest], "n": n[rest], "member": False}))
    out = pd.concat(parts, ignore_index=True)
    out["winner"] = out["winner"].astype("Int64").mask(out["winner"] == none)
    return out


def exact_groups(docs: DataFrame, old: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, old) of every row, and (digest, winner, n) of every distinct text.

    ``old`` says which rows are history: the perfect hash is built over their distinct digests.
    """
    digests = scratch.table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(old, F.lit(False)).alias("old")).mapInArrow(_digest, _DIGESTS)
    )
    partial = digests.select("old", "digest", F.col("doc_id").alias("winner"), F.lit(1).cast("long").alias("n"))
    seen = partial.filter("old").drop("old").mapInArrow(_combine, _PARTIAL)
    history = seen.groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))
    shards = max(1, -(-digests.count() // SHARD_KEYS))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    index = history.withColumn("shard", shard).groupBy("shard").applyInPandas(_build, "shard int, mph binary, slots binary, winners binary, counts binary")
    # One row a new digest before the cogroup, summed in the map tasks first: a hot digest never meets as rows.
    new = partial.filter("not old").drop("old").mapInArrow(_combine, _PARTIAL).groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n")).withColumn("shard", shard)
    looked = scratch.table(index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_look_up, "digest binary, winner long, n long, member boolean"))
    return digests, looked.select("digest", "winner", "n")


def exact_dedup(docs: DataFrame, old: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (binary)."""
    scratch = Scratch(docs.sparkSession, "exact")
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0 if old is None else old
    digests, groups = exact_groups(docs, old, scratch)
    # Only texts that occur more than once need the join; a hot digest is split there by the skew join.
    several = groups.filter("n > 1").withColumnRenamed("digest", "d")
    joined = digests.join(several, F.col("digest") == F.col("d"), "left")
    keep = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("winner"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest",
    )
