"""Queries of the relational operators: scans, projections, joins, aggregates, windows, samples, sets, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audits, splits, statistics
from .registry import query
from .tables import GRID, RECORDS, SPLIT, WINDOWS, grid, read, records, split_windows, windows



def _n():
    """Rows."""
    return F.count(F.lit(1))



def _r(c, digits: int = 6):
    return F.round(c, digits)


# ---------------------------------------------------------------- sources
# Fixed value: how record files are named.
FILE_PATTERN = r"^(\d{6})_([^_]+)_(.+)_data_(\d+)\.mat$"
_FILES_SQL = RECORDS + """, f AS (SELECT sample_id, CASE WHEN quantity < 3 THEN 'broken_' || sample_id || '.mat'
  ELSE date || '_' || session_id || '_walk_' || label || '_data_' || CAST(quantity AS INT) || '.mat' END AS filename FROM r)"""


def _files(spark, sf):
    name = F.concat_ws("_", "date", "session_id", F.lit("walk"), "label", F.lit("data"), F.concat(F.col("quantity").cast("int").cast("string"), F.lit(".mat")))
    return records(spark, sf).select("sample_id", F.when(F.col("quantity") < 3, F.concat(F.lit("broken_"), "sample_id", F.lit(".mat"))).otherwise(name).alias("filename"))


@query(f"WITH {_FILES_SQL} SELECT sample_id, " + ", ".join(f"CASE WHEN m THEN regexp_extract(filename, '{FILE_PATTERN}', {i}) ELSE {d} END AS {n}" for i, n, d in ((1, "date", "'unknown'"), (2, "operator", "'unknown'"), (3, "rest", "filename"))) + f""",
  CASE WHEN m THEN CAST(regexp_extract(filename, '{FILE_PATTERN}', 4) AS INT) ELSE -1 END AS sample_idx FROM (SELECT *, regexp_matches(filename, '{FILE_PATTERN}') AS m FROM f)""")
def src_fname(spark: SparkSession, sf: str) -> DataFrame:
    """File names by pattern; a name that doesn't match is unknown."""
    f = _files(spark, sf)
    m = F.col("filename").rlike(FILE_PATTERN)
    part = lambda k: F.regexp_extract("filename", FILE_PATTERN, k)
    return f.select(
        "sample_id", F.when(m, part(1)).otherwise("unknown").alias("date"), F.when(m, part(2)).otherwise("unknown").alias("operator"),
        F.when(m, part(3)).otherwise(F.col("filename")).alias("rest"), F.when(m, F.try_to_number(part(4), F.lit("999999999")).cast("int")).otherwise(-1).alias("sample_idx"),
    )


@query(f"WITH {WINDOWS}, m AS (SELECT recording_id, locus, block, max(block) OVER (PARTITION BY recording_id) + 1 AS n_blocks FROM w) SELECT DISTINCT recording_id, block, locus FROM m WHERE block < n_blocks - 3")
def src_mask(spark, sf):
    """Annotated cells of a mask whose block fits a whole window."""
    last = F.max("block").over(Window.partitionBy("recording_id")) + 1
    return windows(spark, sf).withColumn("n_blocks", last).filter("block < n_blocks - 3").select("recording_id", "block", "locus").distinct()


@query(f"WITH {WINDOWS} SELECT sample_id, recording_id, block, locus, zone, t0, t1, zone_id FROM w")
def src_tommanifest(spark, sf):
    return windows(spark, sf).select("sample_id", "recording_id", "block", "locus", "zone", "t0", "t1", "zone_id")


@query("SELECT event_id, key, CAST(value AS INT) AS v FROM (SELECT event_id, unnest(map_entries(CAST(json(props) AS MAP(VARCHAR, VARCHAR)))) AS e FROM events), LATERAL (SELECT e.key AS key, e.value AS value) WHERE key LIKE 'k%'")
def src_poly(spark, sf):
    """Entries of a JSON map whose key has a prefix."""
    e = read(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.filter(F.col("key").startswith("k")).select("event_id", "key", F.col("value").cast("int").alias("v"))


def crop_or_reflect(x, width: int):
    """Centre crop of a longer array, right reflection of a shorter one."""
    n = F.size(x)
    crop = F.slice(x, F.floor((n - width) / 2).cast("int") + 1, F.lit(width))
    pad = F.concat(x, F.slice(F.reverse(x), F.lit(2), F.greatest(F.lit(width) - n, F.lit(0))))
    return F.when(n >= width, crop).otherwise(pad)


@query("WITH a AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings) SELECT vec_id, round(list_sum(x[17:48]), 6) AS crop_sum, round(list_sum(x[1:40]) + list_sum(list_reverse(x[16:39])), 6) AS pad_sum FROM a")
def src_mat(spark, sf):
    """A record cut to 32 samples, and its first 40 samples reflected to 64."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    x = F.col("embedding").cast("array<double>")
    return read(spark, sf, "embeddings").select("vec_id", _r(total(crop_or_reflect(x, 32))).alias("crop_sum"), _r(total(crop_or_reflect(F.slice(x, 1, 40), 64))).alias("pad_sum"))


@query(f"WITH {WINDOWS}, p AS (SELECT *, greatest(0, least(locus - 8, 134)) AS c0 FROM w) SELECT p.sample_id, count(*) AS n_cells, round(sum(b.value), 4) AS total FROM p JOIN w b ON p.recording_id = b.recording_id AND b.block BETWEEN p.block AND p.block + 3 AND b.locus BETWEEN p.c0 AND p.c0 + 15 GROUP BY 1")
def src_h5patch(spark, sf):
    """Patches of 4 blocks x 16 loci: the block range becomes an equi-join on each block it covers."""
    w = windows(spark, sf)
    p = w.select("sample_id", "recording_id", F.greatest(F.lit(0), F.least(F.col("locus") - 8, F.lit(134))).alias("c0"), F.explode(F.sequence(F.col("block"), F.col("block") + 3)).alias("block"))
    cells = p.join(w.select("recording_id", "block", "locus", "value"), ["recording_id", "block"]).filter("locus between c0 and c0 + 15")
    return cells.groupBy("sample_id").agg(_n().alias("n_cells"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT vec_id, CAST(embedding[33] AS DOUBLE) AS centre FROM embeddings")
def src_center(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.element_at("embedding", F.floor(F.size("embedding") / 2).cast("int") + 1).cast("double").alias("centre"))


@query("""WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT vec_id, i // 8 AS ch, v, avg(v) OVER (PARTITION BY vec_id, i // 8) AS m FROM v),
e AS (SELECT vec_id, ch, round(sum((v - m) * (v - m)), 9) AS energy FROM c GROUP BY 1, 2) SELECT vec_id, CAST(ch AS INT) AS channel FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY energy DESC, ch) AS k FROM e) WHERE k = 1""")
def src_refch(spark, sf):
    """The channel (of 8 x 8 samples) with the most energy about its mean; the first of equals."""
    v = read(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).withColumn("channel", F.floor(F.col("i") / 8).cast("int"))
    c = v.withColumn("m", F.avg("v").over(Window.partitionBy("vec_id", "channel"))).groupBy("vec_id", "channel").agg(F.round(F.sum((F.col("v") - F.col("m")) ** 2), 9).alias("energy"))
    return c.groupBy("vec_id").agg(F.min_by("channel", F.struct(-F.col("energy"), F.col("channel"))).alias("channel"))


@query(f"WITH {WINDOWS} SELECT sample_id FROM w WHERE event_id % 7 <> 0")
def src_shard(spark, sf):
    """Resume: windows that no shard holds yet."""
    w = windows(spark, sf)
    return w.select("sample_id").join(w.filter("event_id % 7 = 0").select("sample_id"), "sample_id", "left_anti")


@query(f"WITH {WINDOWS} SELECT recording_id, count(*) AS n_rows, count(DISTINCT sample_id) AS n_ids, count(*) - count(DISTINCT sample_id) AS n_duplicates FROM w GROUP BY 1")
def src_assemble(spark, sf):
    """Row and id counts of each shard, before shards are put together."""
    return windows(spark, sf).groupBy("recording_id").agg(_n().alias("n_rows"), F.countDistinct("sample_id").alias("n_ids"), (_n() - F.countDistinct("sample_id")).alias("n_duplicates"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_parquet(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


# ---------------------------------------------------------------- filters and projections
@query(f"WITH {RECORDS} SELECT sample_id, n_bytes FROM r WHERE n_bytes > 0")
def flt_nonempty(spark, sf):
    return records(spark, sf).filter("n_bytes > 0").select("sample_id", "n_bytes")


@query(f"WITH {WINDOWS} SELECT sample_id FROM w WHERE block < 717")
def flt_usable(spark, sf):
    return windows(spark, sf).filter("block < 717").select("sample_id")


@query(f"WITH {WINDOWS} SELECT sample_id, label FROM w WHERE label IN ('c1', 'c4') ")
def flt_labelset(spark, sf):
    return windows(spark, sf).filter(F.col("label").isin("c1", "c4")).select("sample_id", "label")


@query(f"WITH {SPLIT} SELECT sample_id FROM s WHERE split = 'train'")
def flt_split(spark, sf):
    return split_windows(spark, sf).filter("split = 'train'").select("sample_id")


@query(f"WITH {RECORDS} SELECT session_id, sum(CASE WHEN official_split = 'test' THEN 1 ELSE 0 END)::BIGINT AS n_test, count(DISTINCT label) AS n_labels FROM r GROUP BY 1 HAVING sum(CASE WHEN official_split = 'test' THEN 1 ELSE 0 END) >= 30 AND count(DISTINCT label) >= 2")
def flt_thresh(spark, sf):
    g = records(spark, sf).groupBy("session_id").agg(F.count_if(F.col("official_split") == "test").alias("n_test"), F.countDistinct("label").alias("n_labels"))
    return g.filter("n_test >= 30 and n_labels >= 2")


@query("SELECT l_suppkey, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT l_suppkey, round(l_discount, 2) AS l_discount FROM lineitem) GROUP BY 1 HAVING avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) > 0.4".replace("avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS share", "round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 9) AS share"))
def flt_topmin(spark, sf):
    """Groups whose share of a condition is above a threshold."""
    g = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg((F.round("l_discount", 2) > 0.05).cast("double")).alias("share"))
    return g.filter("share > 0.4").select("l_suppkey", F.round("share", 9).alias("share"))


DOMAIN_SLICES = (("time", 0, 28), ("freq", 28, 16), ("tf", 44, 16), ("spatial", 60, 4))


@query("WITH a AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings) SELECT vec_id, " + ", ".join(f"round(list_sum(x[{s + 1}:{s + n}]), 6) AS {d}" for d, s, n in DOMAIN_SLICES) + " FROM a")
def prj_slice(spark, sf):
    """Domains by position in the feature vector."""
    x = F.col("embedding").cast("array<double>")
    return read(spark, sf, "embeddings").select("vec_id", *[_r(F.aggregate(F.slice(x, s + 1, n), F.lit(0.0), lambda a, v: a + v)).alias(d) for d, s, n in DOMAIN_SLICES])


MASK = tuple(range(3, 64, 7))


@query("SELECT vec_id, unnest([%s]) AS idx, unnest([%s])::DOUBLE AS v FROM embeddings" % (", ".join(map(str, MASK)), ", ".join(f"embedding[{i + 1}]" for i in MASK)))
def prj_mask(spark, sf):
    """Selected features, in the order of the selection."""
    picked = F.transform(F.array(*map(F.lit, MASK)), lambda i: F.struct(i.alias("idx"), F.get("embedding", i).cast("double").alias("v")))
    return read(spark, sf, "embeddings").select("vec_id", F.inline(picked))


@query("SELECT p_partkey, p_type || ':' || p_name AS name, split_part(p_type || ':' || p_name, ':', 1) AS prefix FROM part")
def prj_prefix(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.concat_ws(":", "p_type", "p_name").alias("name")).withColumn("prefix", F.substring_index("name", ":", 1))


@query(f"WITH {WINDOWS} SELECT sample_id, CASE label WHEN 'c0' THEN 'quiet' WHEN 'c1' THEN 'quiet' WHEN 'c2' THEN 'walk' WHEN 'c3' THEN 'dig' END AS harmonised, CASE WHEN block <= 240 THEN 'first' ELSE 'second' END AS campaign FROM w WHERE label IN ('c0', 'c1', 'c2', 'c3')")
def prj_case(spark, sf):
    """Two taxonomies to one; labels without a place go."""
    names = {"c0": "quiet", "c1": "quiet", "c2": "walk", "c3": "dig"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return windows(spark, sf).withColumn("harmonised", m[F.col("label")]).filter("harmonised is not null").select("sample_id", "harmonised", F.when(F.col("block") <= 240, "first").otherwise("second").alias("campaign"))


@query(f"WITH {RECORDS} SELECT sample_id, date[1:4] AS month, session_id[1:3] AS short FROM r")
def prj_substr(spark, sf):
    return records(spark, sf).select("sample_id", F.substring("date", 1, 4).alias("month"), F.substring("session_id", 1, 3).alias("short"))


@query("SELECT p_partkey, round_even(p_retailprice / 8, 2) AS eighth FROM part")
def prj_round(spark, sf):
    """Half-even rounding of reports."""
    return read(spark, sf, "part").select("p_partkey", F.bround(F.col("p_retailprice") / 8, 2).alias("eighth"))


@query(f"WITH {WINDOWS} SELECT sample_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS y FROM w")
def prj_labelenc(spark, sf):
    """Labels to indexes by sorted name; the label table is small, the windows aren't ranked."""
    w = windows(spark, sf)
    labels = w.select("label").distinct().withColumn("y", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    return w.join(F.broadcast(labels), "label").select("sample_id", "label", "y")


# ---------------------------------------------------------------- joins
@query(f"WITH {WINDOWS}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, block ORDER BY event_id) AS j FROM w) WHERE j = 1) SELECT m.recording_id, m.block, m.label, round(f.total, 4) AS total FROM m JOIN (SELECT recording_id, block, sum(value) AS total FROM w GROUP BY 1, 2) f USING (recording_id, block)")
def jn_fuse(spark, sf):
    """Features with their manifest row (the first of repeated ids)."""
    w = windows(spark, sf)
    first = w.groupBy("recording_id", "block").agg(F.min_by("label", "event_id").alias("label"))
    return first.join(w.groupBy("recording_id", "block").agg(F.sum("value").alias("total")), ["recording_id", "block"]).select("recording_id", "block", "label", F.round("total", 4).alias("total"))


@query(f"WITH {WINDOWS} SELECT a.sample_id, a.k AS k_time, b.block AS block_freq, c.locus AS locus_tf FROM w a JOIN w b USING (sample_id) JOIN w c USING (sample_id)")
def jn_domains(spark, sf):
    """Domain tables side by side, by id."""
    w = windows(spark, sf)
    return w.select("sample_id", F.col("k").alias("k_time")).join(w.select("sample_id", F.col("block").alias("block_freq")), "sample_id").join(w.select("sample_id", F.col("locus").alias("locus_tf")), "sample_id")


_AUDIT = "a AS (SELECT session_id, sum(CASE WHEN official_split = 'train' THEN 1 ELSE 0 END)::BIGINT AS n_train, sum(CASE WHEN official_split = 'test' THEN 1 ELSE 0 END)::BIGINT AS n_test FROM r GROUP BY 1)"


def session_audit(df):
    g = df.groupBy("session_id").agg(F.count_if(F.col("official_split") == "train").alias("n_train"), F.count_if(F.col("official_split") == "test").alias("n_test"))
    return g.withColumn("in_both", (F.col("n_train") > 0) & (F.col("n_test") > 0))


@query(f"WITH {RECORDS}, {_AUDIT} SELECT *, n_train > 0 AND n_test > 0 AS in_both FROM a")
def agg_audit(spark, sf):
    return session_audit(records(spark, sf))


@query(f"WITH {RECORDS}, {_AUDIT} SELECT r.sample_id, r.label, a.n_train, a.n_test FROM r JOIN a USING (session_id)")
def jn_audit(spark, sf):
    r = records(spark, sf)
    return r.join(session_audit(r), "session_id").select("sample_id", "label", "n_train", "n_test")


@query(f"WITH {SPLIT} SELECT sample_id, segment, split FROM s")
def jn_assign(spark, sf):
    """Assigned splits beside their windows: window columns, no join."""
    return split_windows(spark, sf).select("sample_id", "segment", "split")


@query(f"WITH {SPLIT} SELECT c.*, n.n_groups FROM (SELECT label, " + ", ".join(f"count(*) FILTER (split = '{x}') AS {x}" for x in splits.SPLITS) + " FROM s GROUP BY 1) c LEFT JOIN (SELECT label, count(DISTINCT zone_id) AS n_groups FROM s GROUP BY 1) n USING (label)")
def jn_splitcount(spark, sf):
    s = split_windows(spark, sf)
    counts = s.groupBy("label").pivot("split", list(splits.SPLITS)).agg(_n()).na.fill(0)
    return counts.join(s.groupBy("label").agg(F.countDistinct("zone_id").alias("n_groups")), "label", "left")


@query("WITH a AS (SELECT l_suppkey, round(avg(l_extendedprice), 4) AS pipeline FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, round(avg(l_quantity) * 1700, 4) AS cnn FROM lineitem GROUP BY 1) SELECT l_suppkey, pipeline, cnn, round(cnn - pipeline, 4) AS diff, sum(CASE WHEN cnn > pipeline THEN 1 ELSE 0 END) OVER ()::BIGINT AS wins FROM a JOIN b USING (l_suppkey)")
def jn_lodocmp(spark, sf):
    """Two methods per held-out group, their difference and the number of wins."""
    li = read(spark, sf, "lineitem").groupBy("l_suppkey")
    a, b = li.agg(F.round(F.avg("l_extendedprice"), 4).alias("pipeline")), li.agg(F.round(F.avg("l_quantity") * 1700, 4).alias("cnn"))
    j = a.join(b, "l_suppkey").withColumn("diff", F.round(F.col("cnn") - F.col("pipeline"), 4))
    return j.crossJoin(F.broadcast(j.agg(F.count_if(F.col("cnn") > F.col("pipeline")).alias("wins"))))


@query("WITH a AS (SELECT p_brand AS feature, avg(p_size) AS pa FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_brand AS feature, avg(p_size) AS pb FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) SELECT feature, round(pa, 6) AS pa, round(pb, 6) AS pb FROM a FULL JOIN b USING (feature) WHERE pa IS NOT NULL AND pb IS NOT NULL")
def jn_selstab(spark, sf):
    p = read(spark, sf, "part").withColumnRenamed("p_brand", "feature")
    a = p.filter("p_partkey % 2 = 0").groupBy("feature").agg(_r(F.avg("p_size")).alias("pa"))
    b = p.filter("p_partkey % 2 = 1").groupBy("feature").agg(_r(F.avg("p_size")).alias("pb"))
    return a.join(b, "feature", "full").dropna()


@query(f"WITH {SPLIT} SELECT sample_id, split, keep FROM g0")
def jn_guard(spark, sf):
    """Windows near a foreign split, by a range frame in place of an interval self-join."""
    return splits.guard(split_windows(spark, sf)).select("sample_id", "split", "keep")


@query(f"WITH {SPLIT} SELECT sample_id, EXISTS (SELECT 1 FROM s t WHERE t.split = 'train' AND t.recording_id = s.recording_id AND t.block BETWEEN s.block - 3 AND s.block + 3) AS contaminated FROM s WHERE split = 'test'")
def jn_contam(spark, sf):
    """Test windows that read a block of a train window."""
    return splits.contaminated(split_windows(spark, sf)).select("sample_id", "contaminated")


@query(f"WITH {SPLIT} SELECT DISTINCT label FROM s WHERE split = 'train' AND label NOT IN (SELECT label FROM g WHERE split = 'test' AND locus < 20)")
def jn_setmiss(spark, sf):
    """Classes of one table that another lacks."""
    s = split_windows(spark, sf)
    return s.filter("split = 'train'").select("label").distinct().join(splits.guard(s).filter("keep and split = 'test' and locus < 20").select("label"), "label", "left_anti")


@query("SELECT r.r_name AS dataset, d.unnest AS domain, m.unnest AS model FROM region r, unnest(['time', 'freq', 'tf', 'spatial']) d, unnest(['lr', 'dt', 'rf']) m")
def jn_grid(spark, sf):
    """Every combination of dataset, domain and model (three small tables)."""
    r = read(spark, sf, "region").select(F.col("r_name").alias("dataset"))
    return r.select("dataset", F.explode(F.array(*map(F.lit, ("time", "freq", "tf", "spatial")))).alias("domain")).select("dataset", "domain", F.explode(F.array(*map(F.lit, ("lr", "dt", "rf")))).alias("model"))


# ---------------------------------------------------------------- aggregates
@query(f"WITH {WINDOWS} SELECT label, count(*) AS n_windows, count(DISTINCT zone_id) AS n_groups, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM w GROUP BY 1")
def agg_summary(spark, sf):
    g = windows(spark, sf).groupBy("label").agg(_n().alias("n_windows"), F.countDistinct("zone_id").alias("n_groups"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n_windows").alias("t")))).select("label", "n_windows", "n_groups", _r(100.0 * F.col("n_windows") / F.col("t")).alias("pct"))


@query(f"WITH {WINDOWS} SELECT label, recording_id, count(*) AS windows, count(DISTINCT block) AS blocks, count(DISTINCT locus) AS loci, count(DISTINCT zone) AS zones FROM w GROUP BY 1, 2")
def agg_recsum(spark, sf):
    return windows(spark, sf).groupBy("label", "recording_id").agg(_n().alias("windows"), *[F.countDistinct(c).alias(a) for c, a in (("block", "blocks"), ("locus", "loci"), ("zone", "zones"))])


@query(f"WITH {RECORDS} SELECT date, count(*) AS n, count(DISTINCT label) AS labels, count(DISTINCT session_id) AS sessions FROM r GROUP BY 1")
def agg_bydate(spark, sf):
    return records(spark, sf).groupBy("date").agg(_n().alias("n"), F.countDistinct("label").alias("labels"), F.countDistinct("session_id").alias("sessions"))


@query(f"WITH {WINDOWS}, c AS (SELECT count(*) AS n FROM w GROUP BY label) SELECT (SELECT count(DISTINCT label) FROM w) AS labels, (SELECT count(DISTINCT recording_id) FROM w) AS recordings, (SELECT count(DISTINCT zone_id) FROM w) AS zones, (SELECT count(DISTINCT locus) FROM w) AS loci, round((SELECT max(n) / min(n) FROM c), 6) AS imbalance")
def agg_globalnd(spark, sf):
    w = windows(spark, sf)
    d = w.agg(*[F.countDistinct(c).alias(a) for c, a in (("label", "labels"), ("recording_id", "recordings"), ("zone_id", "zones"), ("locus", "loci"))])
    return d.crossJoin(w.groupBy("label").agg(_n().alias("n")).agg(_r(F.max("n") / F.min("n")).alias("imbalance")))


@query(f"WITH {WINDOWS} SELECT label, zone, count(DISTINCT recording_id) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT recording_id) = 1")
def agg_singleton(spark, sf):
    return windows(spark, sf).groupBy("label", "zone").agg(F.countDistinct("recording_id").alias("n")).filter("n = 1")


@query(f"WITH {SPLIT} SELECT coalesce(label, 'All') AS label, coalesce(split, 'All') AS split, count(*) AS n FROM s GROUP BY CUBE (label, split)")
def agg_crosstab(spark, sf):
    """Class x split counts with margins."""
    return split_windows(spark, sf).cube("label", "split").agg(_n().alias("n")).na.fill("All", ["label", "split"])


@query(f"WITH {SPLIT} SELECT label, " + ", ".join(f"count(DISTINCT CASE WHEN split = '{x}' THEN zone_id END) AS {x}_groups" for x in splits.SPLITS) + " FROM s GROUP BY 1")
def agg_grouppivot(spark, sf):
    return split_windows(spark, sf).groupBy("label").agg(*[F.countDistinct(F.when(F.col("split") == x, F.col("zone_id"))).alias(f"{x}_groups") for x in splits.SPLITS])


@query(f"WITH {WINDOWS} SELECT coalesce(recording_id, 'TOTAL') AS recording_id, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ROLLUP (recording_id)")
def agg_total(spark, sf):
    return windows(spark, sf).rollup("recording_id").agg(_n().alias("n"), F.round(F.sum("value"), 4).alias("total")).na.fill("TOTAL", ["recording_id"])


@query(f"WITH {WINDOWS} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM w GROUP BY 1")
def agg_valuecounts(spark, sf):
    g = windows(spark, sf).groupBy("label").agg(_n().alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("label", "n", _r(F.col("n") / F.col("t")).alias("share"))


@query(f"WITH {WINDOWS}, c AS (SELECT recording_id, label, count(*) AS n FROM w GROUP BY 1, 2) SELECT recording_id, round(max(n) / sum(n), 6) AS chance FROM c GROUP BY 1")
def agg_majority(spark, sf):
    c = windows(spark, sf).groupBy("recording_id", "label").agg(_n().alias("n"))
    return c.groupBy("recording_id").agg(_r(F.max("n") / F.sum("n")).alias("chance"))


@query(f"WITH {SPLIT} SELECT zone_id, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def agg_disjoint(spark, sf):
    return audits.group_offenders(split_windows(spark, sf), "zone_id")


@query("SELECT count(l_orderkey) - count(DISTINCT l_orderkey) AS n_duplicates FROM lineitem")
def agg_dup(spark, sf):
    return audits.duplicate_ids(read(spark, sf, "lineitem"), "l_orderkey")


@query(f"WITH {SPLIT}, e AS (SELECT DISTINCT recording_id, split, unnest(range(block, block + 4)) AS read FROM s) SELECT a.recording_id, a.split AS split_a, b.split AS split_b, count(*) AS n_blocks FROM e a JOIN e b ON a.recording_id = b.recording_id AND a.read = b.read AND a.split < b.split GROUP BY 1, 2, 3")
def agg_cover(spark, sf):
    """Blocks that windows of two splits read (before the guard)."""
    return audits.shared_blocks(split_windows(spark, sf))


_CARD = """c AS (SELECT 'groups in one split' AS "check", (SELECT count(*) FROM (SELECT segment_id FROM {t} GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n
UNION ALL SELECT 'unique sample ids', count(sample_id) - count(DISTINCT sample_id) FROM {t}
UNION ALL SELECT 'every class in every split', (SELECT count(*) FROM (SELECT DISTINCT label FROM {t}) l, unnest(['train', 'val', 'test']) x WHERE (l.label, x.unnest) NOT IN (SELECT label, split FROM {t}))
UNION ALL SELECT 'no block read by two splits', (WITH e AS (SELECT DISTINCT recording_id, split, unnest(range(block, block + 4)) AS read FROM {t}) SELECT count(*) FROM (SELECT a.recording_id, a.split, b.split FROM e a JOIN e b ON a.recording_id = b.recording_id AND a.read = b.read AND a.split < b.split GROUP BY 1, 2, 3)))"""
_CARD_END = """ SELECT "check", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS VARCHAR) AS detail FROM c"""


def _with_segment_id(df):
    return df.withColumn("segment_id", F.concat_ws("|", "recording_id", F.col("segment").cast("string")))


@query(f"WITH {SPLIT}, h AS (SELECT *, recording_id || '|' || segment AS segment_id FROM g), " + _CARD.format(t="h") + _CARD_END)
def spl_card(spark, sf):
    """Scorecard of the guarded split."""
    return audits.scorecard(_with_segment_id(splits.guard(split_windows(spark, sf)).filter("keep")), "segment_id")


@query(f"WITH {SPLIT}, h AS (SELECT *, recording_id || '|' || zone AS segment_id FROM s), " + _CARD.format(t="h") + _CARD_END)
def agg_scorecard(spark, sf):
    """The negative control: without the guard, and by zone, the audits fail."""
    return audits.scorecard(split_windows(spark, sf).withColumn("segment_id", F.col("zone_id")), "segment_id")


@query(f"WITH {SPLIT}, c AS (SELECT label, " + ", ".join(f"count(*) FILTER (split = '{x}') AS {x}, count(DISTINCT CASE WHEN split = '{x}' THEN zone_id END) AS {x}_groups" for x in splits.SPLITS) + " FROM g GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'TOTAL', " + ", ".join(f"sum({x})::BIGINT, sum({x}_groups)::BIGINT" for x in splits.SPLITS) + " FROM c")
def spl_report(spark, sf):
    """Flagship: segments, rotation and guard over one shuffle, then the report."""
    return splits.split_report(splits.guard(split_windows(spark, sf)).filter("keep"), "zone_id")


@query(f"WITH {GRID} SELECT strategy, round(avg(f1), 6) AS f1, round(avg(n), 6) AS n FROM b GROUP BY 1")
def agg_stratmean(spark, sf):
    return grid(spark, sf).groupBy("strategy").agg(_r(F.avg("f1")).alias("f1"), _r(F.avg("n")).alias("n"))


@query(f"WITH {WINDOWS} SELECT recording_id, label, round(avg(value), 6) AS mean_value, round(avg(k), 6) AS mean_k FROM w GROUP BY 1, 2")
def agg_probesum(spark, sf):
    return windows(spark, sf).groupBy("recording_id", "label").agg(_r(F.avg("value")).alias("mean_value"), _r(F.avg("k")).alias("mean_k"))


@query("WITH i AS (SELECT p_type AS domain, p_size - 20 AS imp FROM part), d AS (SELECT domain, sum(greatest(imp, 0))::BIGINT AS mass FROM i GROUP BY 1) SELECT domain, mass, round(100.0 * mass / sum(mass) OVER (), 6) AS pct FROM d")
def agg_impmass(spark, sf):
    """Importance clipped at 0 and summed by domain."""
    d = read(spark, sf, "part").groupBy(F.col("p_type").alias("domain")).agg(F.sum(F.greatest(F.col("p_size") - 20, F.lit(0))).cast("long").alias("mass"))
    return d.crossJoin(F.broadcast(d.agg(F.sum("mass").alias("t")))).select("domain", "mass", _r(100.0 * F.col("mass") / F.col("t")).alias("pct"))


@query("SELECT o_orderpriority, " + ", ".join(f"arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{x}') AS {x.lower()}" for x in "FOP") + " FROM orders GROUP BY 1")
def agg_first(spark, sf):
    """The first value of each cell, by key."""
    p = read(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).agg(F.min_by("o_totalprice", "o_orderkey"))
    return p.select("o_orderpriority", *[F.col(x).alias(x.lower()) for x in "FOP"])


@query(f"WITH {WINDOWS} SELECT recording_id, count(*) FILTER (locus < 8 OR locus > 142) AS edge, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM w GROUP BY 1")
def agg_countif(spark, sf):
    return windows(spark, sf).groupBy("recording_id").agg(F.count_if((F.col("locus") < 8) | (F.col("locus") > 142)).alias("edge"), _r(F.avg((F.col("value") > 10).cast("double"))).alias("high_share"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS lo, round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS hi FROM lineitem GROUP BY 1")
def agg_ci95(spark, sf):
    c = statistics.ci95(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return c.select("l_returnflag", *[F.round(x, 4).alias(x) for x in ("mean", "lo", "hi")])


@query("SELECT p_type, count(p_retailprice) AS count, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std, min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.75), 4) AS p75, max(p_retailprice) AS max FROM part GROUP BY 1")
def agg_describe(spark, sf):
    d = statistics.describe(read(spark, sf, "part"), ["p_type"], "p_retailprice")
    return d.select("p_type", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", *[F.round(x, 4).alias(x) for x in ("p25", "p50", "p75")], "max")


# ---------------------------------------------------------------- windows, sorts, samples, sets, pivots
@query(f"WITH {SPLIT} SELECT recording_id, segment, count(*) AS n, min(block) AS first_block, max(block) AS last_block FROM s GROUP BY 1, 2")
def win_segment(spark, sf):
    return split_windows(spark, sf).groupBy("recording_id", "segment").agg(_n().alias("n"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))


@query(f"WITH {SPLIT} SELECT recording_id, split, count(*) AS n, count(DISTINCT segment) AS segments FROM s GROUP BY 1, 2")
def win_rotate(spark, sf):
    return split_windows(spark, sf).groupBy("recording_id", "split").agg(_n().alias("n"), F.countDistinct("segment").alias("segments"))


@query(f"WITH {SPLIT} SELECT recording_id, split, count(*) AS n, count(*) FILTER (keep) AS kept FROM g0 GROUP BY 1, 2")
def win_guard(spark, sf):
    return splits.guard(split_windows(spark, sf)).groupBy("recording_id", "split").agg(_n().alias("n"), F.count_if("keep").alias("kept"))


@query(f"WITH {SPLIT}, c AS (SELECT recording_id, EXISTS (SELECT 1 FROM s t WHERE t.split = 'train' AND t.recording_id = s.recording_id AND t.block BETWEEN s.block - 3 AND s.block + 3) AS hit FROM s WHERE split = 'test') SELECT recording_id, count(*) AS n, count(*) FILTER (hit) AS contaminated FROM c GROUP BY 1")
def win_contam(spark, sf):
    return splits.contaminated(split_windows(spark, sf)).groupBy("recording_id").agg(_n().alias("n"), F.count_if("contaminated").alias("contaminated"))


@query(f"WITH {SPLIT}, c AS (SELECT recording_id, EXISTS (SELECT 1 FROM s t WHERE t.split = 'train' AND t.recording_id = s.recording_id AND t.block BETWEEN s.block - 3 AND s.block + 3) AS hit FROM s WHERE split = 'test'), d AS (SELECT EXISTS (SELECT 1 FROM g t WHERE t.split = 'train' AND t.recording_id = g.recording_id AND t.block BETWEEN g.block - 3 AND g.block + 3) AS hit FROM g WHERE split = 'test') SELECT 'blocked' AS protocol, count(*) AS n_test, count(*) FILTER (hit) AS n_contaminated, round(100.0 * count(*) FILTER (hit) / count(*), 4) AS pct FROM c UNION ALL SELECT 'blocked with guard', count(*), count(*) FILTER (hit), round(100.0 * count(*) FILTER (hit) / count(*), 4) FROM d")
def met_leaktab(spark, sf):
    """Contaminated test windows by protocol."""
    s = split_windows(spark, sf)
    out = None
    for name, df in (("blocked", s), ("blocked with guard", splits.guard(s).filter("keep"))):
        row = splits.contaminated(df).agg(_n().alias("n_test"), F.count_if("contaminated").alias("n_contaminated"))
        row = row.select(F.lit(name).alias("protocol"), "n_test", "n_contaminated", F.round(100.0 * F.col("n_contaminated") / F.col("n_test"), 4).alias("pct"))
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {GRID} SELECT model, strategy, f1, rank() OVER (PARTITION BY model ORDER BY f1 DESC) + (count(*) OVER (PARTITION BY model, f1) - 1) / 2.0 AS r FROM b")
def win_avgrank(spark, sf):
    return grid(spark, sf).withColumn("r", statistics.average_rank(["model"], "f1")).select("model", "strategy", "f1", "r")


@query("WITH c AS (SELECT p_size AS votes, count(*) AS n FROM part GROUP BY 1) SELECT votes, n, sum(n) OVER (ORDER BY votes DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS kept, round(100.0 - 100.0 * sum(n) OVER (ORDER BY votes DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS reduction_pct FROM c")
def win_cumsum(spark, sf):
    """Features kept at each vote threshold (one row per threshold)."""
    c = read(spark, sf, "part").groupBy(F.col("p_size").alias("votes")).agg(_n().alias("n"))
    run = F.sum("n").over(Window.orderBy(F.desc("votes")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return c.select("votes", "n", run.alias("kept"), _r(100.0 - 100.0 * run / total).alias("reduction_pct"))


@query(f"WITH {GRID} SELECT model, strategy, round(f1 - first_value(f1) OVER (PARTITION BY model ORDER BY strategy), 6) AS delta FROM b")
def win_delta(spark, sf):
    """Difference to the reference arm."""
    first = F.first("f1").over(Window.partitionBy("model").orderBy("strategy"))
    return grid(spark, sf).select("model", "strategy", _r(F.col("f1") - first).alias("delta"))


@query("SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff FROM events")
def win_lagdiff(spark, sf):
    lag = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf, "events").select("user_id", "event_id", _r(F.col("value") - lag).alias("diff"))


@query("WITH f AS (SELECT user_id, event_id, value > 10 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r AS (SELECT user_id, flag, i - row_number() OVER (PARTITION BY user_id, flag ORDER BY i) AS island, i FROM f) SELECT user_id, min(i) AS start, count(*) AS length FROM r WHERE flag GROUP BY user_id, island")
def win_runs(spark, sf):
    """Islands of consecutive events above a level."""
    e = read(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 10).alias("flag"))
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    e = e.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("user_id", "flag").orderBy("i")))
    return e.filter("flag").groupBy("user_id", "island").agg(F.min("i").alias("start"), _n().alias("length")).drop("island")


@query("WITH o AS (SELECT value, unnest([0, 1, 2, 3]) AS j, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS h FROM events) SELECT h - j AS first_hour, count(*) AS n, round(sum(value), 4) AS total FROM o GROUP BY 1")
def win_hop(spark, sf):
    """Sliding windows of four hours every hour, each event in the four that hold it."""
    h = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    e = read(spark, sf, "events").select("value", F.explode(F.sequence(h - 3, h)).alias("first_hour"))
    return e.groupBy("first_hour").agg(_n().alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {WINDOWS} SELECT zone, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1")
def win_tumble(spark, sf):
    return windows(spark, sf).groupBy("zone").agg(_n().alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {GRID} SELECT model, strategy, f1, row_number() OVER (ORDER BY strategy DESC, f1, model) AS pos FROM b")
def srt_multi(spark, sf):
    return grid(spark, sf).select("model", "strategy", "f1", F.row_number().over(Window.orderBy(F.desc("strategy"), "f1", "model")).cast("long").alias("pos"))


@query(f"WITH {GRID} SELECT model, strategy, f1 FROM b ORDER BY f1 DESC, model, strategy LIMIT 10")
def top_k(spark, sf):
    return grid(spark, sf).select("model", "strategy", "f1").orderBy(F.desc("f1"), "model", "strategy").limit(10)


@query(f"WITH {GRID} SELECT model, strategy, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, strategy) AS k FROM b) WHERE k <= 2")
def top_k_group(spark, sf):
    return splits.per_group(grid(spark, sf), ["model"], F.lit(2), [F.desc("f1"), F.col("strategy")]).select("model", "strategy", "f1")


@query(f"WITH {WINDOWS}, n AS (SELECT *, greatest(1, round_even(500 * count(*) OVER (PARTITION BY label) / count(*) OVER (), 0)) AS take, row_number() OVER (PARTITION BY label ORDER BY event_id) AS j FROM w) SELECT sample_id, label FROM n WHERE j <= take")
def smp_strat(spark, sf):
    return splits.stratified(windows(spark, sf), "label", 500, ["event_id"]).select("sample_id", "label")


@query(f"WITH {SPLIT}, n AS (SELECT *, count(*) OVER (PARTITION BY label) AS total, count(*) OVER (PARTITION BY label, split) AS sub, row_number() OVER (PARTITION BY label, split ORDER BY event_id) AS j FROM g) SELECT sample_id FROM n WHERE j <= CASE WHEN label IN ('c0', 'c5') AND total > 300 THEN greatest(1, round_even(300 / total * sub, 0)) ELSE sub END")
def smp_decimate(spark, sf):
    return splits.decimate(splits.guard(split_windows(spark, sf)).filter("keep"), {"c0": 300, "c5": 300}, ["event_id"]).select("sample_id")


@query(f"WITH {SPLIT} SELECT sample_id, label, split FROM (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY event_id) AS j FROM s) WHERE j <= CASE split WHEN 'train' THEN 60 ELSE 15 END")
def smp_pergroup(spark, sf):
    return splits.per_group(split_windows(spark, sf), ["label", "split"], F.when(F.col("split") == "train", 60).otherwise(15), ["event_id"]).select("sample_id", "label", "split")


@query(f"WITH {WINDOWS}, p AS (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY event_id) AS p FROM w) SELECT sample_id, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'val' ELSE 'test' END AS split FROM p")
def smp_randomsplit(spark, sf):
    return splits.random_split(windows(spark, sf), "label", ["event_id"]).select("sample_id", "split")


@query("SELECT o_orderstatus AS s, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_union(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("k"), "o_orderpriority")
    return o.filter("s = 'F'").drop("o_orderpriority").unionByName(o.filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority"))


@query(f"WITH {WINDOWS} SELECT block FROM w WHERE recording_id = 'click' INTERSECT SELECT block FROM w WHERE recording_id = 'view'")
def set_intersect(spark, sf):
    w = windows(spark, sf)
    return w.filter("recording_id = 'click'").select("block").intersect(w.filter("recording_id = 'view'").select("block"))


@query(f"WITH {WINDOWS} SELECT block FROM w WHERE recording_id = 'click' EXCEPT SELECT block FROM w WHERE recording_id = 'error'")
def set_except(spark, sf):
    w = windows(spark, sf)
    return w.filter("recording_id = 'click'").select("block").subtract(w.filter("recording_id = 'error'").select("block"))


@query("SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY 1")
def set_distinct(spark, sf):
    """The first row of each key, by order rather than by chance."""
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("role", "turn").alias("role"))


@query(f"WITH {GRID}, f AS (SELECT model FROM b GROUP BY 1 HAVING count(*) = 6) SELECT model, " + ", ".join(f"max(f1) FILTER (strategy = 's{i}') AS s{i}" for i in range(6)) + " FROM b WHERE model IN (SELECT model FROM f) GROUP BY 1")
def pvt_wide(spark, sf):
    """Model x strategy; models with a gap go."""
    return grid(spark, sf).groupBy("model").pivot("strategy", [f"s{i}" for i in range(6)]).agg(F.max("f1")).dropna()


@query(f"WITH {GRID}, p AS (SELECT model, " + ", ".join(f"max(f1) FILTER (strategy = 's{i}') AS s{i}" for i in range(6)) + " FROM b GROUP BY 1) SELECT model, unnest(['s0','s1','s2','s3','s4','s5']) AS strategy, unnest([s0,s1,s2,s3,s4,s5]) AS f1 FROM p")
def pvt_long(spark, sf):
    names = [f"s{i}" for i in range(6)]
    return grid(spark, sf).groupBy("model").pivot("strategy", names).agg(F.max("f1")).unpivot(["model"], names, "strategy", "f1")


@query(f"WITH {WINDOWS}, h AS (SELECT DISTINCT recording_id AS held_out FROM w) SELECT held_out, CASE WHEN recording_id = held_out THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM w, h GROUP BY 1, 2")
def spl_logo(spark, sf):
    return splits.held_out_counts(windows(spark, sf), "recording_id")


# Sessions one by one, the largest first, each to the fold of ten where squared label shares grow least.
_DEALT = RECORDS + """, c AS (SELECT session_id AS g, [count(*) FILTER (label = 'A'), count(*) FILTER (label = 'N'), count(*) FILTER (label = 'R')] AS c FROM r GROUP BY 1),
o AS (SELECT g, c, row_number() OVER (ORDER BY list_max(c) DESC, list_sum(c) DESC, g) AS k FROM c), t AS (SELECT [sum(c[1]), sum(c[2]), sum(c[3])]::DOUBLE[] AS t FROM c),
s AS (SELECT 0::BIGINT AS k, '' AS g, -1::BIGINT AS fold, list_transform(range(0, 10), lambda f: [0, 0, 0]::BIGINT[]) AS load UNION ALL
 SELECT k, g, best - 1, list_transform(range(1, 11), lambda f: CASE WHEN f = best THEN [load[f][1] + c[1], load[f][2] + c[2], load[f][3] + c[3]] ELSE load[f] END) FROM (
  SELECT o.k, o.g, o.c, s.load, CAST(list_sort(list_transform(range(1, 11), lambda f: [list_sum(list_transform([1, 2, 3], lambda l: (s.load[f][l] + o.c[l]) / t.t[l] * ((s.load[f][l] + o.c[l]) / t.t[l]) - s.load[f][l] / t.t[l] * (s.load[f][l] / t.t[l]))),
   list_sum(s.load[f])::DOUBLE, f::DOUBLE]))[1][3] AS BIGINT) AS best FROM s JOIN o ON o.k = s.k + 1, t)),
z AS (SELECT CASE WHEN fold < 8 THEN 'train' WHEN fold < 9 THEN 'val' ELSE 'test' END AS split, g FROM s WHERE k > 0)"""


@query(f"WITH RECURSIVE {_DEALT} SELECT split, label, count(*) AS n, count(DISTINCT session_id) AS sessions FROM r JOIN z ON z.g = r.session_id GROUP BY 1, 2")
def spl_group3(spark, sf):
    """Whole sessions to train, val and test."""
    return splits.grouped_three_way(records(spark, sf), "session_id", "label").groupBy("split", "label").agg(_n().alias("n"), F.countDistinct("session_id").alias("sessions"))
