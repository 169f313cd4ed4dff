"""Queries of selection, balancing, models, metrics and rank statistics."""

from __future__ import annotations

import time
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import baselines
from ..operators import balancing, convolution, evaluation, extraction, models, selection, splits, statistics
from ..sources.files import work_dir
from .registry import query
from .tables import GRID, PREDICTIONS, SAMPLES, grid, predictions, read, windows



def _n():
    """Rows."""
    return F.count(F.lit(1))



def _r(c, digits=6):
    return F.round(c, digits)


def labelled(spark, sf) -> DataFrame:
    """(id, y, features of 64 values, group)."""
    e = read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("features"), (F.col("vec_id") % 20).alias("group"))


def divided(spark, sf) -> DataFrame:
    """All rows and features, with a split."""
    return labelled(spark, sf).withColumn("split", F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 8, "val").otherwise("test"))


# ---------------------------------------------------------------- selection
@query(f"WITH {SAMPLES} SELECT i AS feature, round(var_pop(v), 8) AS score FROM v GROUP BY 1")
def fs_var(spark, sf):
    return selection.variance(labelled(spark, sf)).select("feature", _r("score", 8).alias("score"))


_PEARSON = SAMPLES + """, c AS (SELECT DISTINCT label AS c FROM v), r AS (SELECT i, c, (avg(v * CASE WHEN label = c THEN 1 ELSE 0 END) - avg(v) * avg(CASE WHEN label = c THEN 1 ELSE 0 END))
  / ((stddev_pop(v) + 1e-12) * (stddev_pop(CASE WHEN label = c THEN 1 ELSE 0 END) + 1e-12)) AS r FROM v, c GROUP BY 1, 2)"""


@query(f"WITH {_PEARSON} SELECT i AS feature, round(avg(abs(r)), 6) AS score FROM r GROUP BY 1")
def fs_pearson(spark, sf):
    return selection.pearson(labelled(spark, sf)).select("feature", _r("score").alias("score"))


_MI = SAMPLES + """, b AS (SELECT i, label, CAST(least(floor((v - min(v) OVER w) / (max(v) OVER w + 1e-12 - min(v) OVER w) * 8), 7) AS INT) AS b FROM v WINDOW w AS (PARTITION BY i)),
c AS (SELECT i, b, label, count(*) AS c FROM b GROUP BY 1, 2, 3), p AS (SELECT i, c::DOUBLE AS c, sum(c) OVER (PARTITION BY i) AS n, sum(c) OVER (PARTITION BY i, b) AS x, sum(c) OVER (PARTITION BY i, label) AS y FROM c)"""


@query(f"WITH {_MI} SELECT i AS feature, round(sum(c / n * ln(c * n / (x * y))), 6) AS score FROM p GROUP BY 1")
def fs_mi(spark, sf):
    return selection.mutual_information(labelled(spark, sf)).select("feature", _r("score").alias("score"))


# Distances to all rows of each class by window functions, then differences of the ten nearest; features count by their range.
_RELIEFF = """sp AS (SELECT i, max(v) - min(v) + 1e-12 AS span FROM v GROUP BY 1), sv AS (SELECT vec_id AS id, label AS y, list(v / span ORDER BY i) AS s FROM v JOIN sp USING (i) GROUP BY 1, 2),
sh AS (SELECT y, count(*) / (SELECT count(*) FROM sv) AS share FROM sv GROUP BY 1), pd AS (SELECT a.id, a.y, b.id AS other, b.y AS oy, list_transform(range(1, 65), lambda k: abs(a.s[k] - b.s[k])) AS g FROM sv a JOIN sv b ON a.id <> b.id),
nr AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY id, oy ORDER BY list_sum(g), other) <= 10),
nw AS (SELECT g, CASE WHEN n.y = n.oy THEN -1 ELSE o.share / (1 - m.share) END / count(*) OVER (PARTITION BY n.id, n.oy) AS w FROM nr n JOIN sh o ON o.y = n.oy JOIN sh m ON m.y = n.y),
nu AS (SELECT w, unnest(g) AS d, unnest(range(0, 64)) AS i FROM nw), relieff AS (SELECT CAST(i AS INT) AS feature, sum(w * d) / (SELECT count(*) FROM sv) AS score FROM nu GROUP BY 1)"""

# Greedy choice as a recursion over (rank, chosen, sums of |correlation| with those chosen).
_MRMR = """av AS (SELECT i, avg(v) AS m, count(*) AS n FROM v GROUP BY 1), cl AS (SELECT i, label, count(*) AS k, avg(v) AS m, var_pop(v) * count(*) AS s FROM v GROUP BY 1, 2),
fs AS (SELECT i, sum(k * pow(cl.m - av.m, 2)) / greatest(count(*) - 1, 1) / (sum(s) / greatest(any_value(n) - count(*), 1) + 1e-12) AS f FROM cl JOIN av USING (i) GROUP BY 1),
dv AS (SELECT vec_id, i, v - m AS d FROM v JOIN av USING (i)), cm AS (SELECT a.i, b.i AS j, sum(a.d * b.d) AS c FROM dv a JOIN dv b USING (vec_id) GROUP BY 1, 2),
sd AS (SELECT i, sqrt(c) + 1e-12 AS s FROM cm WHERE i = j), cr AS (SELECT cm.i, list(abs(c / (a.s * b.s)) ORDER BY cm.j) AS r FROM cm JOIN sd a ON a.i = cm.i JOIN sd b ON b.i = cm.j GROUP BY 1),
al AS (SELECT list(f ORDER BY i) AS f, list(r ORDER BY i) AS r FROM fs JOIN cr USING (i)),
gr AS (SELECT 0 AS rank, [list_position(f, list_max(f)) - 1] AS chosen, r[list_position(f, list_max(f))] AS red FROM al UNION ALL
 SELECT rank + 1, list_append(chosen, b), list_transform(range(1, 65), lambda k: red[k] + r[b + 1][k]) FROM (SELECT rank, chosen, red, r, list_position(sc, list_max(sc)) - 1 AS b FROM (SELECT gr.*, al.r,
  list_transform(range(0, 64), lambda k: CASE WHEN list_contains(chosen, k) THEN -1 ELSE f[k + 1] / greatest(red[k + 1] / (rank + 1), 1e-3) END) AS sc FROM gr, al WHERE rank < 63))),
mrmr AS (SELECT CAST(chosen[rank + 1] AS INT) AS feature, (64 - rank)::DOUBLE AS score FROM gr)"""

# Digamma of whole numbers by sums of 1 / j; reach of the third other row of the class.
_NEAR = """dg AS (SELECT n, -0.57721566490153286 + coalesce(sum(1.0 / (n - 1)) FILTER (n > 1) OVER (ORDER BY n), 0) AS psi FROM range(1, (SELECT count(*) + 2 FROM embeddings)) t(n)),
sz AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1), re AS (SELECT a.i, a.vec_id, a.v, size, abs(a.v - b.v) * (1 - 1e-9) AS d FROM v a JOIN v b ON a.i = b.i AND a.label = b.label AND a.vec_id <> b.vec_id JOIN sz ON sz.label = a.label
 QUALIFY row_number() OVER (PARTITION BY a.i, a.vec_id ORDER BY abs(a.v - b.v)) = least(3, size - 1)),
me AS (SELECT re.i, re.vec_id, any_value(re.size) AS size, count(*) AS m FROM re JOIN v ON v.i = re.i AND v.v BETWEEN re.v - d AND re.v + d JOIN sz ON sz.label = v.label AND sz.size > 1 GROUP BY 1, 2),
te AS (SELECT i, count(*) AS n, avg(k.psi - s.psi - m.psi) AS t FROM me JOIN dg k ON k.n = least(3, size - 1) JOIN dg s ON s.n = size JOIN dg m ON m.n = me.m GROUP BY 1),
mutual_info AS (SELECT i AS feature, greatest(0, psi + t) AS score FROM te JOIN dg USING (n))"""

#: Methods whose scores SQL restates; ``fs_votes`` has all eight.
_FIVE = ("variance", "pearson", "mutual_info", "relieff", "mrmr")


def _scores(spark, sf) -> DataFrame:
    e, out = labelled(spark, sf), None
    for m in _FIVE:
        s = selection.SCORERS[m](e.select("id", "y", "features")).select("feature", "score", F.lit(m).alias("method"))
        out = s if out is None else out.unionByName(s)
    return out


_ENSEMBLE = _PEARSON + f""", {_RELIEFF}, {_MRMR}, {_NEAR}, s AS (SELECT 'variance' AS method, i AS feature, round(var_pop(v), 9) AS score FROM v GROUP BY 2 UNION ALL SELECT 'pearson', i, round(avg(abs(r)), 9) FROM r GROUP BY 2
 UNION ALL SELECT 'mutual_info', feature, round(score, 9) FROM mutual_info UNION ALL SELECT 'relieff', feature, round(score, 9) FROM relieff UNION ALL SELECT 'mrmr', feature, score FROM mrmr),
k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) <= 32 AS selected, rank() OVER (PARTITION BY method ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS rnk FROM s),
t AS (SELECT feature, count(*) FILTER (selected) AS votes, avg(rnk) AS avg_rank, 100.0 * avg(CASE WHEN selected THEN 1 ELSE 0 END) AS selection_pct FROM k GROUP BY 1)"""


@query(f"WITH RECURSIVE {_ENSEMBLE} SELECT feature, votes, round(avg_rank, 4) AS avg_rank, round(selection_pct, 4) AS selection_pct FROM t")
def fs_ensemble(spark, sf):
    return selection.votes(_scores(spark, sf)).select("feature", "votes", F.round("avg_rank", 4).alias("avg_rank"), F.round("selection_pct", 4).alias("selection_pct"))


@query(f"WITH RECURSIVE {_ENSEMBLE} SELECT feature FROM t WHERE votes >= 3")
def fs_consensus(spark, sf):
    return selection.consensus(selection.votes(_scores(spark, sf)), 3).select("feature")


@query(f"WITH RECURSIVE {_ENSEMBLE} SELECT feature, row_number() OVER (ORDER BY votes DESC, avg_rank, feature) AS pos FROM t")
def fs_order(spark, sf):
    from pyspark.sql import Window

    return selection.votes(_scores(spark, sf)).select("feature", F.row_number().over(Window.orderBy(F.desc("votes"), "avg_rank", "feature")).cast("long").alias("pos"))


@query(f"WITH RECURSIVE {_ENSEMBLE} SELECT a.method AS a, b.method AS b, round(count(*) FILTER (a.selected AND b.selected) / count(*) FILTER (a.selected OR b.selected), 6) AS jaccard FROM k a JOIN k b USING (feature) GROUP BY 1, 2")
def fs_jaccard(spark, sf):
    from pyspark.sql import Window

    s = _scores(spark, sf)
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc(F.round("score", 9)), "feature"))
    return selection.jaccard(s.select("method", "feature", (place <= 32).alias("selected"))).select("a", "b", _r("jaccard").alias("jaccard"))


def _register(name: str, f, doc: str, sql: str | None = None) -> None:
    f.__name__, f.__doc__ = name, doc
    query(sql)(f)


_RESTATED = {"relieff": _RELIEFF, "mrmr": _MRMR, "mutual_info": _NEAR}

for _m in ("relieff", "mrmr", "rfe", "shap", "mutual_info"):
    _register(
        {"mutual_info": "fs_mi_near"}.get(_m, f"fs_{_m}"),
        lambda spark, sf, m=_m: selection.SCORERS[m](divided(spark, sf).select("id", "y", "features")).select("feature", _r("score", 9 if m in _RESTATED else 12).alias("score")), f"Scores of {_m} over all features.",
        f"WITH RECURSIVE {SAMPLES}, {_RESTATED[_m]} SELECT feature, round(score, 9) AS score FROM {_m}" if _m in _RESTATED else None,
    )


@query()
def fs_boruta(spark, sf):
    """Hits over the best shadow, and what the coin's tail says of them."""
    return selection.boruta(divided(spark, sf).select("id", "y", "features"), rounds=14, trees=30)


@query()
def fs_votes(spark, sf):
    """Votes of all eight methods: who selected a feature, by how many, its average rank."""
    few = {"boruta": {"rounds": 14, "trees": 30}}
    return selection.ensemble(divided(spark, sf).select("id", "y", "features"), selection.METHODS, settings=few)


@query()
def fs_curve(spark, sf):
    """Scores of growing prefixes of the ranking."""
    rows = divided(spark, sf)
    rank = [r["feature"] for r in selection.pearson(rows).orderBy(F.desc(F.round("score", 9)), "feature").collect()]
    out = None
    for k in (2, 6, 12, len(rank)):
        pick = F.array(*map(F.lit, rank[:k]))
        r = rows.withColumn("features", F.transform(pick, lambda i: F.get("features", i)))
        pred, _ = models.fit_predict(r.filter("split = 'train'"), r.filter("split = 'test'"), "tree")
        row = evaluation.scores(pred).select(F.lit(k).alias("k"), "accuracy", "balanced_accuracy", "f1_macro")
        out = row if out is None else out.union(row)
    return out


@query()
def fs_bias(spark, sf):
    """Grouped folds with features picked once on all rows, and anew inside each fold."""
    rows = divided(spark, sf).select("id", "y", "features", "group")

    def pick(d):
        return [r["feature"] for r in selection.pearson(d).orderBy(F.desc(F.round("score", 9)), "feature").limit(6).collect()]

    everywhere = pick(rows)
    out = models.grouped_cv(rows, "group", "tree", n=3, selector=lambda d: everywhere).withColumn("selected", F.lit("outside"))
    return out.unionByName(models.grouped_cv(rows, "group", "tree", n=3, selector=pick).withColumn("selected", F.lit("inside")))


# ---------------------------------------------------------------- balancing
_UNEVEN = "u AS (SELECT vec_id AS id, least(CAST(label AS INT), 4) AS y FROM embeddings), c AS (SELECT y, count(*) AS n FROM u GROUP BY 1)"


def _uneven(spark, sf):
    """All rows; the labels from 4 on are one large class."""
    return labelled(spark, sf).withColumn("y", F.least("y", F.lit(4)))


@query(f"WITH {_UNEVEN} SELECT y, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def bal_cw(spark, sf):
    return balancing.class_weights(_uneven(spark, sf)).select("y", _r("weight").alias("weight")).distinct()


@query(f"WITH {_UNEVEN} SELECT id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY id) AS k FROM u) WHERE k <= (SELECT min(n) FROM c)")
def bal_under(spark, sf):
    return balancing.undersample(_uneven(spark, sf), order=["id"]).select("id", "y")


@query(f"WITH {_UNEVEN} SELECT y, n AS before, (SELECT min(n) FROM c)::BIGINT AS after, round((SELECT min(n) FROM c) / n, 6) AS ratio FROM c")
def bal_desc(spark, sf):
    u = _uneven(spark, sf)
    return balancing.describe(u, balancing.undersample(u, order=["id"])).select("y", "before", "after", _r("ratio").alias("ratio"))


@query(f"WITH {_UNEVEN} SELECT sum(n)::BIGINT AS n, min(n) AS least, max(n) AS most, round(max(n) / min(n), 6) AS imbalance FROM c")
def bal_effect(spark, sf):
    return balancing.effect(_uneven(spark, sf)).select("n", "least", "most", _r("imbalance").alias("imbalance"))


_LEVEL = f"WITH {_UNEVEN} SELECT y, (SELECT max(n) FROM c) AS n FROM c"
for _name, _s, _sql in (("bal_none", "none", f"WITH {_UNEVEN} SELECT y, n FROM c"), ("bal_smote", "smote", _LEVEL), ("bal_bsmote", "borderline_smote", _LEVEL), ("bal_smotetomek", "smote_tomek", None)):
    _register(_name, lambda spark, sf, s=_s: balancing.SAMPLERS[s](_uneven(spark, sf)).groupBy("y").agg(_n().alias("n")), f"Class sizes after {_s}.", _sql)


# ---------------------------------------------------------------- models
#: Growth of boosted trees in the queries: fewer and larger steps than the published 500 of 0.05.
SHORT = {"rounds": 5, "rate": 0.3}

for _m, _name, _more in (
    ("logistic", "mdl_lr", {}), ("tree", "mdl_dt", {}), ("forest", "mdl_rf", {}), ("extra_trees", "mdl_et", {"trees": 60}), ("boosting", "mdl_gbt", {}), ("perceptron", "mdl_mlp", {}),
    ("leafwise", "mdl_lgbm", SHORT), ("regularised", "mdl_xgb", SHORT), ("histogram", "mdl_hgb", SHORT),
):
    def _model(spark, sf, m=_m, more=_more):
        r = divided(spark, sf)
        return models.fit_predict(r.filter("split = 'train'"), r.filter("split = 'test'"), m, **more)[0].select("id", "y_true", "y_pred")

    _register(_name, _model, f"Predictions of the {_m} model.")


@query()
def mdl_weight(spark, sf):
    """A model with inverse-frequency weights."""
    r = divided(spark, sf)
    return evaluation.scores(models.fit_predict(r.filter("split = 'train'"), r.filter("split = 'test'"), "logistic", "class_weight")[0])


@query()
def mdl_bench(spark, sf):
    """All seven models x three strategies, scored on val and test; few trees each."""
    few = {m: {"rounds": 1, "rate": 0.3, "depth": 4} for m in ("leafwise", "regularised", "histogram")} | {"extra_trees": {"trees": 5, "depth": 5}}
    names = ("leafwise", "regularised", "histogram", "forest", "extra_trees", "logistic", "tree")
    return models.benchmark(divided(spark, sf).drop("group"), names, ("none", "class_weight", "undersample"), settings=few).drop("seconds")


@query()
def mdl_cv(spark, sf):
    return models.grouped_cv(divided(spark, sf).drop("split"), "group", "tree", n=3)


@query()
def mdl_imp(spark, sf):
    """Importances of a tree and a boosted model (native), a logistic one (coefficients) and a perceptron (permutation)."""
    r, out = divided(spark, sf), None
    test = r.filter("split = 'test'").select("id", "y", "features")
    for name, more in (("tree", {}), ("leafwise", {"rounds": 2}), ("logistic", {}), ("perceptron", {})):
        model, labels = models.fit(r.filter("split = 'train'"), name, **more)
        one = models.importances(model, labels, test).select(F.lit(name).alias("model"), "kind", "feature", "importance")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def mdl_ablate(spark, sf):
    """Leave one domain (of three blocks of features) out."""
    rows, out = divided(spark, sf), None
    for d, (lo, hi) in {"none": (64, 64), "first": (0, 21), "second": (21, 42), "third": (42, 64)}.items():
        keep = F.array(*[F.lit(i) for i in range(64) if not lo <= i < hi])
        r = rows.withColumn("features", F.transform(keep, lambda i: F.get("features", i)))
        row = evaluation.scores(models.fit_predict(r.filter("split = 'train'"), r.filter("split = 'test'"), "logistic")[0]).select(F.lit(d).alias("left_out"), "*")
        out = row if out is None else out.union(row)
    return out


@query()
def mdl_transfer(spark, sf):
    """Each half of the groups to the other; the quantile scaler knows the half that is trained on."""
    r = divided(spark, sf).select("id", "y", "features", "group")
    a, b = r.filter("group < 10").drop("group"), r.filter("group >= 10").drop("group")
    there, back = (models.transfer(x, y).select(F.lit(n).alias("direction"), "*") for n, x, y in (("a to b", a, b), ("b to a", b, a)))
    return there.unionByName(back)


@query()
def mdl_probe(spark, sf):
    """How well each block of features, and all of them, tell the groups of a class apart, above chance."""
    domains = {d: list(range(16 * k, 16 * k + 16)) for k, d in enumerate(("time", "freq", "tf", "spatial"))} | {"all": list(range(64))}
    return models.probe(divided(spark, sf), "group", domains, least_test=10)


_PROBE = """pr AS (SELECT r_name AS dataset, s_nationkey AS class, d.unnest AS domain, 1 + s_nationkey % 5 AS n_groups, 40.0 + s_nationkey AS majority_chance,
  round(avg(s_acctbal) / CASE d.unnest WHEN 'spatial' THEN 150 ELSE 400 END, 4) AS above_chance_pp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, unnest(['time', 'freq', 'spatial']) d GROUP BY 1, 2, 3, 4, 5),
co AS (SELECT r_name AS dataset, r_regionkey * 1.5 AS spatial_cost FROM region),
e AS (SELECT dataset, class, max(above_chance_pp) FILTER (domain = 'spatial') AS s, max(above_chance_pp) FILTER (domain <> 'spatial') AS o FROM pr WHERE n_groups >= 3 AND majority_chance <= 70 GROUP BY 1, 2),
m AS (SELECT dataset, count(*) AS usable, avg(s) AS spatial, avg(o) AS best_other, avg(s - o) AS differential FROM e GROUP BY 1)"""


@query(f"WITH {_PROBE} SELECT dataset, spatial_cost::DOUBLE AS spatial_cost, coalesce(usable, 0) AS usable, round(spatial, 2) AS spatial, round(best_other, 2) AS best_other, round(differential, 2) AS differential, CASE WHEN spatial_cost < 2 THEN 'CLEAN' WHEN best_other > 15 THEN 'DATASET-WIDE CONFOUND' WHEN differential > 10 THEN 'MIXED' WHEN differential IS NULL THEN 'UNDETERMINED' ELSE 'GENUINE' END AS verdict FROM co LEFT JOIN m USING (dataset)")
def mdl_verdict(spark, sf):
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = s.select(F.col("r_name").alias("dataset"), F.col("s_nationkey").alias("class"), "s_acctbal", F.explode(F.array(F.lit("time"), F.lit("freq"), F.lit("spatial"))).alias("domain"))
    p = p.groupBy("dataset", "class", "domain").agg(F.round(F.avg("s_acctbal") / F.when(F.col("domain") == "spatial", 150).otherwise(400), 4).alias("above_chance_pp"))
    p = p.withColumns({"n_groups": 1 + F.col("class") % 5, "majority_chance": 40.0 + F.col("class")})
    return models.verdict(p, read(spark, sf, "region").select(F.col("r_name").alias("dataset"), (F.col("r_regionkey") * 1.5).cast("double").alias("spatial_cost")))


# ---------------------------------------------------------------- metrics
_CLASSES = PREDICTIONS + """, l AS (SELECT y_true AS label FROM p UNION SELECT y_pred FROM p), c AS (SELECT label, (SELECT count(*) FROM p WHERE y_true = label) AS t, (SELECT count(*) FROM p WHERE y_pred = label) AS q, (SELECT count(*) FROM p WHERE y_true = label AND y_pred = label) AS tp FROM l),
k AS (SELECT label, CASE WHEN q = 0 THEN 0 ELSE tp / q END AS precision, CASE WHEN t = 0 THEN 0 ELSE tp / t END AS recall, CASE WHEN t + q = 0 THEN 0 ELSE 2 * tp / (t + q) END AS f1, t AS support, tp FROM c)"""


@query(f"WITH {PREDICTIONS}, l AS (SELECT y_true AS l FROM p UNION SELECT y_pred FROM p) SELECT a.l AS y_true, b.l AS y_pred, (SELECT count(*) FROM p WHERE y_true = a.l AND y_pred = b.l) AS n FROM l a, l b")
def met_conf(spark, sf):
    return evaluation.confusion(predictions(spark, sf))


@query(f"WITH {_CLASSES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM k")
def met_prf(spark, sf):
    s = evaluation.scores(predictions(spark, sf))
    return s.select(*[_r(c).alias(c) for c in s.columns])


@query(f"""WITH {_CLASSES} SELECT CAST(label AS VARCHAR) AS "class", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM k
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM k
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM k
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM k""")
def met_report(spark, sf):
    return evaluation.report(predictions(spark, sf)).select("class", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {PREDICTIONS}, c AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY 1, 2) SELECT y_true, y_pred, n, round(100.0 * n / sum(n) OVER (PARTITION BY y_true), 6) AS pct_of_true FROM c QUALIFY y_true <> y_pred")
def met_err(spark, sf):
    return evaluation.error_modes(predictions(spark, sf)).select("y_true", "y_pred", "n", _r("pct_of_true").alias("pct_of_true"))


@query(f"WITH {PREDICTIONS} SELECT round(count(*) FILTER (y_pred <> 0 AND y_true = 0) / count(*) FILTER (y_pred <> 0), 6) AS nar, round(count(*) FILTER (y_true <> 0 AND y_pred = 0) / count(*) FILTER (y_true <> 0), 6) AS fnr FROM p")
def met_narfnr(spark, sf):
    return evaluation.nar_fnr(predictions(spark, sf), 0).select(_r("nar").alias("nar"), _r("fnr").alias("fnr"))


@query("""WITH s AS (SELECT vec_id AS sample, CAST(label AS INT) AS y_true, c, round(embedding[c + 1]::DOUBLE, 3) AS score FROM embeddings, range(0, 10) t(c)),
r AS (SELECT c, CASE WHEN y_true = c THEN 1 ELSE 0 END AS pos, rank() OVER (PARTITION BY c ORDER BY score) + (count(*) OVER (PARTITION BY c, score) - 1) / 2.0 AS r FROM s),
a AS (SELECT c, (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(1 - pos)) AS auc FROM r GROUP BY 1) SELECT round(avg(auc), 6) AS auc_ovr_macro FROM a""")
def met_auc(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("int").alias("y_true"), F.posexplode(F.slice("embedding", 1, 10)).alias("cls", "score"))
    return evaluation.auc_ovr(e.withColumn("score", F.round(F.col("score").cast("double"), 3))).select(_r("auc_ovr_macro").alias("auc_ovr_macro"))


_FRIED = GRID + """, t AS (SELECT * FROM b WHERE model IN (SELECT model FROM b GROUP BY 1 HAVING count(*) = 6)), r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY f1 DESC) + (count(*) OVER (PARTITION BY model, f1) - 1) / 2.0 AS r FROM t),
s AS (SELECT strategy, sum(r) AS s, count(*) AS n FROM r GROUP BY 1), o AS (SELECT max(n) AS n, count(*) AS k, sum(s * s) AS ss FROM s),
tie AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT count(*) AS c FROM t GROUP BY model, f1)), x AS (SELECT n, k, (12.0 / (n * k * (k + 1)) * ss - 3.0 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi2 FROM o, tie)"""


# The tail of chi-square with five degrees of freedom by Simpson's rule over u, where the variable is chi2 * u * u.
_TAIL = "1 - (SELECT sum((CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * pow(j / 2000.0, 4) * exp(-chi2 * pow(j / 2000.0, 2) / 2)) FROM range(0, 2001) t(j)) / 6000 * 2 * pow(chi2, 2.5) / (pow(2, 2.5) * 1.329340388179137)"


@query(f"""WITH {_FRIED}, g AS (SELECT string_agg(strategy || ':' || round(s / n, 6)::VARCHAR, ',' ORDER BY s / n, strategy) AS ranking FROM s)
SELECT n, k, k - 1 AS df1, (k - 1) * (n - 1) AS df2, round(chi2, 6) AS chi2, round({_TAIL}, 6) AS p, round((n - 1) * chi2 / (n * (k - 1) - chi2), 6) AS iman_davenport, round(2.850 * sqrt(k * (k + 1) / (6.0 * n)), 6) AS critical_difference, ranking FROM x, g""")
def met_fried(spark, sf):
    f = statistics.friedman(grid(spark, sf), "model", "strategy", "f1")
    ranking = F.array_join(F.transform("ranking", lambda r: F.concat_ws(":", r["method"], F.round(r["avg_rank"], 6).cast("string"))), ",")
    whole = [F.col(c).cast("long").alias(c) for c in ("n", "k", "df1", "df2")]
    return f.select(*whole, *[_r(c).alias(c) for c in ("chi2", "p", "iman_davenport", "critical_difference")], ranking.alias("ranking"))


@query(f"WITH {GRID}, r AS (SELECT strategy, avg(f1) / 60 AS rk FROM b GROUP BY 1), s AS (SELECT a.strategy AS m, string_agg(c.strategy, ',' ORDER BY c.rk, c.strategy) AS members FROM r a JOIN r c ON abs(c.rk - a.rk) <= 0.25 GROUP BY 1) SELECT DISTINCT members FROM s")
def met_cdgroups(spark, sf):
    r = grid(spark, sf).groupBy("strategy").agg((F.avg("f1") / 60).alias("rk"))
    return statistics.cliques(r, "strategy", "rk", 0.25)


@query("SELECT p_partkey, round(1000.0 * 2048 / (10000 + p_size), 6) AS arrival_ms, CAST(ceil(p_retailprice / (1000.0 * 2048 / (10000 + p_size))) AS BIGINT) AS cores, round(p_retailprice * 100000 / 3600000, 6) AS hours_per_100k FROM part")
def met_budget(spark, sf):
    """Arrival of windows against the time they take."""
    arrival = 1000.0 * 2048 / (10000 + F.col("p_size"))
    return read(spark, sf, "part").select("p_partkey", _r(arrival).alias("arrival_ms"), F.ceil(F.col("p_retailprice") / arrival).alias("cores"), _r(F.col("p_retailprice") * 100000 / 3600000).alias("hours_per_100k"))


@query("WITH f AS (SELECT l_linenumber AS fold, l_linestatus AS s, avg(l_quantity) AS f1 FROM lineitem GROUP BY 1, 2) SELECT round(avg(f1) FILTER (s = 'F') - avg(f1) FILTER (s = 'O'), 6) AS optimism FROM f")
def met_optimism(spark, sf):
    f = read(spark, sf, "lineitem").groupBy("l_linenumber", "l_linestatus").agg(F.avg("l_quantity").alias("f1"))
    return f.agg(_r(F.avg(F.when(F.col("l_linestatus") == "F", F.col("f1"))) - F.avg(F.when(F.col("l_linestatus") == "O", F.col("f1")))).alias("optimism"))


@query(f"WITH {SAMPLES}, f AS (SELECT i, abs(corr(v, vec_id % 20)) AS r FROM v GROUP BY 1) SELECT i AS feature, round(coalesce(r, 0), 6) AS r FROM f")
def agg_corr(spark, sf):
    """|Correlation| of each feature with the group number."""
    v = selection.long(labelled(spark, sf)).withColumn("g", (F.col("id") % 20).cast("double"))
    return v.groupBy("feature").agg(_r(F.coalesce(F.abs(F.corr("v", "g")), F.lit(0.0))).alias("r"))


@query(f"WITH {GRID}, a AS (SELECT strategy, model, f1, n FROM b), r AS (SELECT strategy, rank() OVER (PARTITION BY strategy ORDER BY f1 DESC) + (count(*) OVER (PARTITION BY strategy, f1) - 1) / 2.0 AS x, rank() OVER (PARTITION BY strategy ORDER BY n DESC) + (count(*) OVER (PARTITION BY strategy, n) - 1) / 2.0 AS y FROM a) SELECT strategy, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def agg_spearman(spark, sf):
    g = grid(spark, sf).withColumns({"x": statistics.average_rank(["strategy"], "f1"), "y": statistics.average_rank(["strategy"], "n")})
    return g.groupBy("strategy").agg(_r(F.corr("x", "y")).alias("rho"))


@query(f"WITH {SAMPLES}, z AS (SELECT vec_id, label, i, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-12) AS z FROM v WINDOW w AS (PARTITION BY i)) SELECT CAST(label AS INT) AS label, i AS feature, round(avg(z), 6) AS z FROM z GROUP BY 1, 2")
def agg_classmean(spark, sf):
    """Mean profile of each class over standardised features."""
    v = selection.long(labelled(spark, sf))
    s = v.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = v.join(s, "feature").withColumn("z", (F.col("v") - F.col("m")) / (F.col("sd") + 1e-12))
    return z.groupBy(F.col("y").alias("label"), "feature").agg(_r(F.avg("z")).alias("z"))


@query()
def smp_seeded(spark, sf):
    """A seeded sample of 40 windows per label: reruns agree."""
    return splits.per_group(windows(spark, sf), ["label"], F.lit(40), splits.seeded("sample_id")).select("sample_id", "label")


@query()
def bal_pipe(spark, sf):
    """Scaler, sampler and classifier: the sampler sees training rows only, so every test row is predicted once."""
    r = divided(spark, sf)
    pred, _ = models.fit_predict(r.filter("split = 'train'"), r.filter("split = 'test'"), "logistic", "smote")
    return pred.select("id", "y_true", "y_pred")


@query()
def mdl_fitpred(spark, sf):
    """Metrics, AUC and timings of one fit on val and test."""
    r, began, out = divided(spark, sf), time.time(), None
    model, labels = models.fit(r.filter("split = 'train'"), "tree")
    took = time.time() - began
    for s in ("val", "test"):
        row = models.assess(model, labels, r.filter(F.col("split") == s)).select(F.lit(s).alias("split"), "*", F.lit(took).alias("fit_seconds"))
        out = row if out is None else out.union(row)
    return out


@query()
def mdl_fssens(spark, sf):
    """Scores under three sampling rates: windows are resampled and their features taken anew at each rate."""
    out, fs = None, 1000.0
    for up, down in ((1, 1), (4, 5), (5, 4)):
        windows = divided(spark, sf).select("id", "y", "split", F.array("features").alias("patch"))
        patches = extraction.resampled(windows.select(F.col("id").alias("sample_id"), "patch"), up, down)
        found = extraction.extract(patches, fs * up / down, domains=("time", "freq"))
        rows = found.select(F.col("sample_id").alias("id"), F.transform(F.concat("time", "freq"), lambda v: v.cast("double")).alias("features")).join(windows.drop("patch"), "id")
        rows = rows.cache()
        row = evaluation.scores(models.fit_predict(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "tree")[0]).select(F.lit(fs * up / down).alias("rate"), "*")
        out = row if out is None else out.union(row)
    return out


def _network(name: str, layers: tuple, make, shape: tuple, epochs: int, doc: str) -> None:
    def run(spark, sf):
        r = labelled(spark, sf).select("id", "y", "features")
        return convolution.fit_predict(r.filter("id % 10 < 8"), r.filter("id % 10 >= 8"), layers, shape, epochs, state=f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", make=make)

    _register(name, run, doc)


#: Samples that a window is repeated to before its cepstra: four hops and a frame.
_LONG = 4096
_spectrum = lambda x: baselines.redundant_spectrum(x, 10_000.0)
_wavelet = lambda x: baselines.wavelet_coefficients(np.tile(x, 512 // x.shape[1]), 10_000.0)
_cepstra = lambda x: baselines.mel_cepstrum(np.tile(x, _LONG // x.shape[1]), 10_000.0)
_network("mdl_cnn1d", convolution.DAS_CNN, _spectrum, (1, 2048, 1), 2, "The one-dimensional network over redundant spectra; two passes over the rows.")
_network("mdl_cnn_tom", convolution.TOMASOV_CNN, _spectrum, (1, 2048, 1), 2, "Its form with 256 dense units; two passes.")
_network("mdl_cnn_dwt", convolution.TOMASOV_CNN, _wavelet, (1, _wavelet(np.zeros((1, 64))).size, 1), 2, "The same over wavelet coefficients of windows repeated to 512 samples; two passes.")
_network("mdl_cnn_mel", convolution.TOMASOV_CNN, _cepstra, (1, _cepstra(np.zeros((1, 64))).size, 1), 2, "The same over mel cepstra of windows repeated to 4,096 samples; two passes.")
_network("mdl_cnn_cao", convolution.CAO_CNN, lambda x: baselines.record_image(np.tile(x, 120_000 // x.shape[1])), (1, 10_000, 12), 3, "The image network over scaled records of 10,000 samples x 12 channels; three passes.")
