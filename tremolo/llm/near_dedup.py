"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. One pass over the texts gives each document its number of shingles, a 128-bit digest of its shingle
   set, and one 64-bit key per band of a one-permutation sketch (empty bins are densified by probing).
2. Documents with equal sets are one class from here on.  Each bucket links its members to its least
   member only, so a bucket of n classes costs n - 1 candidate edges.
3. Edges are confirmed on full sets.  Confirmed edges give components.
4. A star whose members are still in several components may hide links between members.  It is tested
   again around the member that is most like its centre, as that one tends to be what all are copies of.
5. What is left is exact by differences.  Of a member x with regard to the centre c only what x lacks of
   c and what it adds matters: two members share n_c - lack(x) - lack(y) shingles for sure, and one more
   for each element that their differences share.  So a link between members that aren't both linked to c
   needs a number of shared elements that follows from sizes alone.  Differences are matched by prefix
   (the rarest elements of the star first), only across components and where that number can be reached;
   the pairs are confirmed on full sets.  So no link that the buckets hold is lost.

A pair at the threshold misses all buckets with a probability below 1e-7 (see ``bands_for``).

Defined results
* null text, no words: n_shingles 0, a component of its own, kept.
* fewer words than a shingle has: the whole sequence is the one shingle.
* null doc_id: linked with nothing, component_id null, kept.
* rows that repeat a doc_id are judged one by one; of equal texts all rows with the least doc_id are kept.
* no rows: an empty result.  Extra columns are not read.

Skew: copies collapse by partial aggregation before anything else; a hot bucket is one row a class, and
its join with the centres is split by the skew join.  Sets travel only for candidate edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch
from .words import gram_hashes, lowered, mix64, text_slices, word_hashes, word_spans

BANDS = 32
#: Rows up to which the list of documents whose sets are needed is broadcast (about 50 bytes a row).
BROADCAST_NEEDED = 400_000
_NONE = np.iinfo(np.uint64).max
#: Texts in one step of sketching.
_STEP_ROWS = 512


def bands_for(percent: int) -> int:
    """Bins of a band: the most for which a pair at the threshold misses all bands with probability < 1e-7."""
    rows = 1
    while rows < 8 and (1 - (percent / 100) ** (rows + 1)) ** BANDS < 1e-7:
        rows += 1
    return rows


# ---------------------------------------------------------------- sets and sketches
def shingle_sets(column: pa.Array, k: int, seed: int = 0):
    """(first row, sorted distinct shingle hashes, offsets) of slices of the column."""
    for row, raw, offsets in text_slices(column):
        raw = lowered(raw)
        starts, ends, first = word_spans(raw, offsets)
        words = word_hashes(raw, starts, ends, seed=seed)
        grams, at = gram_hashes(words, first, k)
        doc = np.searchsorted(first, at, side="right") - 1
        n = np.diff(first)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = np.array([_sequence(words[first[d] : first[d + 1]]) for d in short], np.uint64)
            grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[new], doc[new]
        yield row, grams, np.searchsorted(doc, np.arange(len(n) + 1))


def _sequence(words: np.ndarray) -> np.uint64:
    h = np.array([len(words)], np.uint64)
    for w in words:
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + w)
    return h[0]


def _digests(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        v = mix64(grams ^ np.uint64(salt))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        out.append(mix64((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64)))
    return out[0], out[1]


_PROBES: dict[int, np.ndarray] = {}


def _probe(bins: int, attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at on this attempt."""
    have = _PROBES.get(bins)
    if have is None:
        cells = np.arange(bins * 512, dtype=np.uint64) + np.uint64(0x1F123BB5 * bins)
        have = _PROBES[bins] = (mix64(cells) % np.uint64(bins)).astype(np.int64).reshape(512, bins)
    if attempt < 512:
        return have[attempt]
    return (np.arange(bins) + attempt) % bins


def sketches(grams: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketches (documents x bins), densified; a document without shingles has none."""
    n = len(at) - 1
    v = mix64(grams + np.uint64(0xA0761D6478BD642F))
    cell = np.repeat(np.arange(n), np.diff(at)) * bins + ((v >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    out = np.full(n * bins, _NONE, np.uint64)
    np.minimum.at(out, cell, v)
    first = out.reshape(n, bins)
    out = first.copy()
    doc, bin_ = np.nonzero((first == _NONE) & (np.diff(at) > 0)[:, None])
    attempt = 0
    while len(doc):
        found = first[doc, _probe(bins, attempt)[bin_]]
        hit = found != _NONE
        out[doc[hit], bin_[hit]] = found[hit]
        doc, bin_ = doc[~hit], bin_[~hit]
        attempt += 1
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """64-bit key of each band (documents x BANDS)."""
    parts = sketch.reshape(len(sketch), BANDS, rows)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, j])
    return h


def _sketch(k: int, rows: int, seed: int):
    def run(batches):
        for b in batches:
            for row, grams, at in shingle_sets(b.column("text"), k, seed):
                for i in range(0, len(at) - 1, _STEP_ROWS):
                    part = at[i : i + _STEP_ROWS + 1]
                    g, part = grams[part[0] : part[-1]], part - part[0]
                    k1, k2 = _digests(g, part)
                    keys = band_keys(sketches(g, part, BANDS * rows), rows)
                    n = len(part) - 1
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").slice(row + i, n), pa.array(np.diff(part)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))],
                        names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                    )

    return run


def _sets(k: int, seed: int):
    def run(batches):
        for b in batches:
            for row, grams, at in shingle_sets(b.column("text"), k, seed):
                k1, _ = _digests(grams, at)
                n = len(at) - 1
                blobs = [grams[at[i] : at[i + 1]].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(np.diff(at)), pa.array(blobs, pa.binary())], names=["node", "n", "grams"])

    return run


# ---------------------------------------------------------------- confirmation
def _confirm(percent: int, differences: bool):
    """Exact similarity of (u, v); with ``differences``, what v adds to the centre u and what it lacks."""

    def run(batches):
        last, centre = None, None
        for b in batches:
            us, vs, cs, xs = (b.column(c) for c in ("u", "v", "u_grams", "v_grams"))
            un, vn, shared, linked, parts = [], [], [], [], []
            for i, u in enumerate(us.to_pylist()):
                if u != last or centre is None:
                    last, centre = u, np.frombuffer(cs[i].as_buffer(), np.uint64)
                x = np.frombuffer(xs[i].as_buffer(), np.uint64)
                where = np.searchsorted(centre, x)
                inside = centre[np.minimum(where, len(centre) - 1)] == x
                common = int(inside.sum())
                both = len(x) + len(centre)
                un.append(len(centre))
                vn.append(len(x))
                shared.append(common)
                linked.append(100 * common >= percent * (both - common))
                if differences:
                    lack = np.ones(len(centre), bool)
                    lack[where[inside]] = False
                    parts.append(np.concatenate([x[~inside], centre[lack]]).view(np.int64))
            out = [us, vs, *(pa.array(c, pa.int64()) for c in (un, vn, shared)), pa.array(linked, pa.bool_())]
            if differences:
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays(out, names=["u", "v", "un", "vn", "common", "linked", "diff"][: len(out)])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """The exact test over ``pairs`` (u, v)."""
    full = pairs.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("v_grams")), "v").join(sets.select(F.col("node").alias("u"), F.col("grams").alias("u_grams")), "u")
    schema = "u long, v long, un long, vn long, common long, linked boolean" + ", diff array<long>" * differences
    return full.select("u", "v", "u_grams", "v_grams").mapInArrow(_confirm(percent, differences), schema)


def _spanning(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The stars of ``edges`` (u, v, ...) whose members are in several components, with each member's label."""
    a, b = labels.select(F.col("node").alias("v"), F.col("label").alias("vl")), labels.select(F.col("node").alias("u"), F.col("label").alias("ul"))
    placed = edges.join(a, "v", "left").join(b, "u", "left").withColumns({"label": F.coalesce("vl", "v"), "centre": F.coalesce("ul", "u")}).drop("vl", "ul")
    several = placed.groupBy("u").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("u")  # the centre is tested with all
    return placed.join(several, "u", "left_semi")


def _across(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) across components whose differences may share enough elements."""
    # A partner shares at least this many elements of v's difference, however good it is.
    short = F.lit(percent) * (F.col("un") + F.col("vn")) - F.lit(100 + percent) * F.col("common")
    least = F.greatest(F.lit(1), F.ceil(short / 100))
    sides = stars.select(
        "u", "v", "label", "vn", (F.col("un") - F.col("common")).alias("lack"), (F.col("vn") - F.col("common")).alias("adds"), "un", least.alias("least"), F.explode("diff").alias("gram")
    ).withColumn("key", F.xxhash64("u", "gram")).drop("gram")
    seen = sides.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    order = F.row_number().over(Window.partitionBy("u", "v").orderBy("df", "key")) - 1
    sides = sides.join(seen, "key").withColumn("pos", order).filter((F.col("lo") < F.col("hi")) & (F.col("pos") <= F.col("lack") + F.col("adds") - F.col("least"))).drop("u")
    x, y = (sides.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("v", "label", "vn", "lack", "adds", "un", "pos")]) for k in "xy")
    # Elements that the two differences must share: a link needs percent / (100 + percent) of both sizes in common.
    need = F.ceil(F.lit(percent) * (F.col("vn_x") + F.col("vn_y")) / (100 + percent)) - (F.col("un_x") - F.col("lack_x") - F.col("lack_y"))
    reach = F.least("lack_x", "lack_y") + F.least("adds_x", "adds_y")
    can = (F.col("label_x") < F.col("label_y")) & (need <= reach)
    can &= (F.col("pos_x") <= F.col("lack_x") + F.col("adds_x") - need) & (F.col("pos_y") <= F.col("lack_y") + F.col("adds_y") - need)
    both = x.join(y, (x["key"] == y["key"]) & can)
    return both.select(F.least("v_x", "v_y").alias("u"), F.greatest("v_x", "v_y").alias("v")).distinct()


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |intersection| >= ``percent`` * |union| of their sets of ``shingle``-word
    shingles are linked; component_id is the least doc_id that links lead to.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = bands_for(percent)
    for seed in range(8):
        sketched = scratch.table(texts.mapInArrow(_sketch(shingle, rows, seed), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
        able = sketched.filter("doc_id is not null and n_shingles > 0")
        classes = able.groupBy("k1").agg(F.min("doc_id").alias("least"), (F.min("k2") != F.max("k2")).alias("clash"))
        classes = scratch.table(classes)
        if classes.filter("clash").isEmpty():
            break
        scratch.drop(sketched, classes)  # two different sets with one 64-bit digest: another seed
    classes = classes.select(F.col("k1").alias("node"), "least")

    # Star-shaped candidate edges: each bucket's members to its least member.
    reps = able.join(classes, (F.col("k1") == F.col("node")) & (F.col("doc_id") == F.col("least")), "left_semi")
    members = reps.select(F.col("k1").alias("v"), F.explode("bands").alias("band"))
    centres = members.groupBy("band").agg(F.min("v").alias("u"), F.max("v").alias("w")).filter("u < w").select("band", "u")
    stars = scratch.table(members.join(centres, "band").filter("u <> v").select("u", "v").distinct(), free=True)

    # Full sets of the classes that have a candidate edge.
    needed = stars.select(F.col("u").alias("node")).union(stars.select("v")).distinct().join(classes, "node").select(F.col("least").alias("i"))
    needed = scratch.table(needed)
    few = needed.count() <= BROADCAST_NEEDED
    sets = texts.join(F.broadcast(needed) if few else needed, F.col("doc_id") == F.col("i"), "left_semi").mapInArrow(_sets(shingle, seed), "node long, n long, grams binary")
    sets = scratch.table(sets, free=True)
    tested = scratch.table(_confirmed(stars, sets, percent), free=True)
    links = tested.filter("linked").select("u", "v")
    labels = connected(links, scratch)

    # Stars that span several components, once more around the member most like the centre.
    open_ = scratch.table(_spanning(tested, labels).select("u", "v", "common", "un", "vn"))
    like = F.struct(F.col("common") / (F.col("un") + F.col("vn") - F.col("common")), F.col("v"))
    hubs = open_.groupBy("u").agg(F.max_by("v", like).alias("hub"))
    around = open_.select("u", "v").union(hubs.select("u", F.col("u").alias("v"))).join(hubs, "u").filter("v <> hub")
    around = around.select(F.col("hub").alias("u"), "v").distinct()
    again = scratch.table(_confirmed(around, sets, percent, differences=True), free=True)
    links = scratch.table(links.union(again.filter("linked").select("u", "v")))
    labels = connected(links, scratch)

    # What is left: members across components, by the differences they share.
    across = _across(scratch.table(_spanning(again, labels)), percent)
    more = scratch.table(_confirmed(across, sets, percent).filter("linked").select("u", "v"), free=True)
    if not more.isEmpty():
        labels = connected(links.union(more), scratch)

    # The least doc_id of each component, and each class's place in it.
    named = labels.join(classes, "node").select("node", "label", "least")
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = named.join(lowest, "label").select("node", "component_id")
    final = classes.join(placed, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    key = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("k1"))
    out = sketched.select("doc_id", "n_shingles", key.alias("k")).join(final, F.col("k") == F.col("node"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
