"""Queries of the signal functions: the batch kernels over 64-sample windows, each beside SQL that restates it.

A window stays one row: a kernel takes all windows of an Arrow batch, so nothing is exploded to samples and shuffled back.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import baselines, dsp
from ..functions import features as ft
from ..functions.features import SIZES
from ..operators import extraction
from ..sources.files import work_dir
from .registry import query
from .tables import SAMPLES, blocks, read, samples, signals

EPS = 1e-12


def _r(c, digits=6):
    return F.round(c, digits)


def _kernel(spark, sf, columns: str, f):
    """``f`` (windows x samples to one array a column) over every window; ``columns``: their names and types."""
    fields = [c.split(" ") for c in columns.split(", ")]
    kinds = [pa.float64() if kind == "double" else pa.list_(pa.float64()) for _, kind in fields]

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            with np.errstate(all="ignore"):
                out = f(x) if b.num_rows else [[] for _ in kinds]
            arrays = [pa.array([np.asarray(r, float) for r in v] if pa.types.is_list(k) else np.asarray(v, float), k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *arrays], names=["vec_id", *(name for name, _ in fields)])

    return signals(spark, sf).select("vec_id", "x").mapInArrow(run, "vec_id long, " + columns)


def _values(spark, sf, names: str, f, digits: int = 6):
    """Several rounded numbers a window."""
    out = _kernel(spark, sf, ", ".join(f"{n} double" for n in names.split()), f)
    return out.select("vec_id", *[(_r(n, digits) + 0.0).alias(n) for n in names.split()])  # no negative zero


def _each(spark, sf, index: str, value: str, f, digits: int = 6):
    """A rounded number for each place of an array."""
    return _kernel(spark, sf, "y array<double>", lambda x: [f(x)]).select("vec_id", F.posexplode("y").alias(index, "y")).select("vec_id", index, _r("y", digits).alias(value))


@query(f"WITH {SAMPLES} SELECT vec_id, i, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-12), 6) AS z FROM v WINDOW w AS (PARTITION BY vec_id)")
def f_zscore(spark, sf):
    """Unit spread about the mean (arrays, no shuffle)."""
    x = F.col("x")
    n = F.size(x)
    s = signals(spark, sf).withColumn("m", F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n)
    s = s.withColumn("sd", F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / n))
    return s.select("vec_id", F.posexplode("x").alias("i", "v"), "m", "sd").select("vec_id", "i", _r((F.col("v") - F.col("m")) / (F.col("sd") + EPS)).alias("z"))


_SHARES = SAMPLES + ", p AS (SELECT vec_id, v * v / (sum(v * v) OVER (PARTITION BY vec_id) + 1e-12) AS p FROM v)"


@query(f"WITH {_SHARES} SELECT vec_id, round(-sum(p * log2(p)), 6) AS entropy FROM p WHERE p > 0 GROUP BY 1")
def f_ent(spark, sf):
    return _values(spark, sf, "entropy", lambda x: [dsp.entropy(x * x)])


@query(f"WITH {_SHARES} SELECT vec_id, round(-log2(sum(p * p)), 6) AS renyi FROM p WHERE p > 0 GROUP BY 1")
def f_renyi(spark, sf):
    return _values(spark, sf, "renyi", lambda x: [dsp.collision_entropy(x * x)])


@query(f"WITH {SAMPLES}, o AS (SELECT vec_id, abs(v) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v), i) AS k FROM v) SELECT vec_id, round(sum((2 * k - 65) * a) / (64 * sum(a)), 6) AS gini FROM o GROUP BY 1")
def f_gini(spark, sf):
    return _values(spark, sf, "gini", lambda x: [dsp.gini(x)])


_DFT = SAMPLES + """, f AS (SELECT vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)) AS mag FROM v, range(0, 33) t(k) GROUP BY 1, 2)"""


def _mag(x):
    return np.abs(np.fft.rfft(x))


@query(f"WITH {_DFT} SELECT vec_id, CAST(k AS INT) AS k, round(mag, 6) AS mag FROM f")
def f_rfft(spark, sf):
    return _each(spark, sf, "k", "mag", _mag)


@query(f"WITH {_DFT}, c AS (SELECT vec_id, k, sum(mag) OVER (PARTITION BY vec_id ORDER BY k) AS run, sum(mag) OVER (PARTITION BY vec_id) AS total FROM f) SELECT vec_id, CAST(min(k) FILTER (run >= 0.85 * total) AS DOUBLE) AS rolloff85 FROM c GROUP BY 1")
def f_rolloff(spark, sf):
    return _values(spark, sf, "rolloff85", lambda x: dsp.rolloff(_mag(x), np.arange(33.0), (0.85,)))


@query(f"WITH {_DFT}, s AS (SELECT *, sum(mag) OVER (PARTITION BY vec_id) + 1e-12 AS t FROM f), c AS (SELECT vec_id, sum(k * mag / t) AS centroid FROM s GROUP BY 1) SELECT s.vec_id, round(any_value(centroid), 6) AS centroid, round(sqrt(sum(pow(k - centroid, 2) * mag / t)), 6) AS spread, round(exp(avg(ln(mag + 1e-12))) / (avg(mag) + 1e-12), 6) AS flatness FROM s JOIN c USING (vec_id) GROUP BY 1")
def f_shape(spark, sf):
    """Centroid, spread and flatness of the spectrum."""
    return _values(spark, sf, "centroid spread flatness", lambda x: [*dsp.centre_spread(dsp.share(_mag(x))), dsp.flatness(_mag(x))])


@query(f"WITH {SAMPLES}, t AS (SELECT vec_id, v * v - lag(v) OVER w * lead(v) OVER w AS t FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, round(avg(t), 6) AS tkeo_mean, round(stddev_pop(t), 6) AS tkeo_std FROM t WHERE t IS NOT NULL GROUP BY 1")
def f_tkeo(spark, sf):
    return _values(spark, sf, "tkeo_mean tkeo_std", lambda x: [dsp.energy_operator(x).mean(axis=1), dsp.energy_operator(x).std(axis=1)])


@query(f"WITH {SAMPLES}, d AS (SELECT vec_id, abs(v - lag(v) OVER w) AS d, abs(v - first_value(v) OVER w) AS r FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, round(log10(63) / (log10(63) + log10(max(r) / sum(d))), 6) AS katz FROM d GROUP BY 1")
def f_katz(spark, sf):
    return _values(spark, sf, "katz", lambda x: [dsp.katz(x)])


@query(f"WITH {SAMPLES}, l AS (SELECT a.vec_id, k, a.i % k AS m, sum(abs(b.v - a.v)) AS s, count(*) AS c FROM v a, range(1, 9) t(k), v b WHERE b.vec_id = a.vec_id AND b.i = a.i + k GROUP BY 1, 2, 3), h AS (SELECT vec_id, k, ln(avg(s * 63 / (c * k)) + 1e-12) AS y, ln(1.0 / k) AS x FROM l GROUP BY 1, 2) SELECT vec_id, round(regr_slope(y, x), 6) AS higuchi FROM h GROUP BY 1")
def f_higuchi(spark, sf):
    """Curve lengths at eight strides."""
    return _values(spark, sf, "higuchi", lambda x: [dsp.higuchi(x)])


@query(f"""WITH {SAMPLES}, m AS (SELECT vec_id, median(v) AS md, avg(v) AS mu, sum(v * v) AS e FROM v GROUP BY 1),
u AS (SELECT v.*, md, e, v - mu AS d, v * v / (e + 1e-12) AS p, sign(v) <> sign(lag(v) OVER w) AS turn, v * v - lag(v) OVER w * lead(v) OVER w AS tk FROM v JOIN m USING (vec_id) WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(var_pop(v), 6) AS var, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 6) AS kurt,
  round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range, round(any_value(md), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(median(abs(v - md)), 6) AS mad,
  round(sum(v * v), 6) AS energy, round(log10(sum(v * v) + 1e-12), 6) + 0.0 AS log_energy, round(sqrt(avg(v * v)), 6) AS rms, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy,
  round(count(*) FILTER (turn) / 63.0, 6) AS zcr, round(max(v) - min(v), 6) AS p2p, round(avg(tk), 6) AS tk_mean, round(stddev_pop(tk), 6) AS tk_std, round(max(abs(tk)), 6) AS tk_max FROM u GROUP BY 1""")
def f_coef20(spark, sf):
    """The twenty statistics of a coefficient vector."""
    return _values(spark, sf, " ".join(ft.COEFFICIENT), lambda x: ft.coefficient_statistics(x).T)


@query(f"WITH {SAMPLES} SELECT vec_id, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99 FROM v GROUP BY 1")
def f_pctl(spark, sf):
    return _values(spark, sf, "p1 p10 p90 p99", lambda x: dsp.quantiles(np.sort(x, axis=1), (0.01, 0.1, 0.9, 0.99)))


_CENTRED = f"WITH {SAMPLES}, d AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY vec_id) AS d FROM v)"


@query(f"{_CENTRED} SELECT vec_id, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew FROM d GROUP BY 1")
def f_skew(spark, sf):
    return _values(spark, sf, "skew", lambda x: dsp.moments(x)[:1])


@query(f"{_CENTRED} SELECT vec_id, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 6) AS kurt FROM d GROUP BY 1")
def f_kurt(spark, sf):
    return _values(spark, sf, "kurt", lambda x: dsp.moments(x)[1:])


@query(f"WITH {SAMPLES}, m AS (SELECT vec_id, median(v) AS md FROM v GROUP BY 1) SELECT vec_id, round(median(abs(v - md)), 6) AS mad FROM v JOIN m USING (vec_id) GROUP BY 1")
def f_mad(spark, sf):
    return _values(spark, sf, "mad", lambda x: [np.median(np.abs(x - np.median(x, axis=1, keepdims=True)), axis=1)])


@query(f"WITH {SAMPLES}, b AS (SELECT vec_id, CAST(least(floor((v - min(v) OVER w) / (max(v) OVER w + 1e-12 - min(v) OVER w) * 16), 15) AS INT) AS bin FROM v WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, bin, round(count(*) / 64.0, 6) AS share FROM b GROUP BY 1, 2")
def f_hist(spark, sf):
    """Bins that hold a sample, and their shares."""
    return _each(spark, sf, "bin", "share", lambda x: dsp.histogram(x, 16, hi=x.max(axis=1) + EPS)).filter("share > 0")


@query(f"WITH {SAMPLES}, p AS (SELECT vec_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b, stddev_pop(v) OVER (PARTITION BY vec_id) AS sd FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, i FROM p WHERE v > a AND v > b AND v >= sd")
def f_peaks(spark, sf):
    def found(x):
        row, at = dsp.peaks(x, x.std(axis=1))
        return [np.split(at, np.cumsum(np.bincount(row, minlength=len(x)))[:-1])]

    return _kernel(spark, sf, "at array<double>", found).select("vec_id", F.explode(F.col("at").cast("array<int>")).alias("i"))


@query(f"WITH {SAMPLES} SELECT a.vec_id, CAST(l AS INT) AS lag, round(sum(a.v * b.v) / (any_value(e) + 1e-12), 6) AS ac FROM v a, range(1, 11) t(l), v b, (SELECT vec_id AS id, sum(v * v) AS e FROM v GROUP BY 1) n WHERE b.vec_id = a.vec_id AND b.i = a.i + l AND id = a.vec_id GROUP BY 1, 2")
def f_acf(spark, sf):
    """Ten lags."""
    ac = _each(spark, sf, "lag", "ac", lambda x: dsp.autocorrelation(x)[:, 1:11])
    return ac.select("vec_id", (F.col("lag") + 1).alias("lag"), "ac")


# ---------------------------------------------------------------- short-time spectra and their images
#: Short frames, so that a window of 64 samples has an image of 9 bins x 7 frames.
FRAME, STEP = 16, 8


def _view(x):
    return ft.TimeFrequencyView(x, 1000.0, FRAME, STEP)


_STFT = SAMPLES + """, z AS (SELECT vec_id, CAST(f AS INT) AS f, CAST(k AS INT) AS k,
  sqrt(pow(sum(v * h * cos(2 * pi() * k * j / 16)), 2) + pow(sum(v * h * sin(2 * pi() * k * j / 16)), 2)) AS mag
  FROM (SELECT vec_id, f, i - 8 * f AS j, v, (0.5 - 0.5 * cos(2 * pi() * (i - 8 * f) / 16)) / 8 AS h FROM v, range(0, 7) t(f) WHERE i BETWEEN 8 * f AND 8 * f + 15), range(0, 9) u(k) GROUP BY 1, 2, 3)"""
_IMAGE = _STFT + """, g AS (SELECT vec_id, k AS r, f AS c, log10(mag * mag + 1e-12) AS l FROM z),
q AS (SELECT vec_id, r, c, l, CAST(floor((l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w + 1e-12) * 31) AS INT) AS g FROM g WINDOW w AS (PARTITION BY vec_id)),
a AS (SELECT vec_id, list(g ORDER BY r, c) AS qs, list(l ORDER BY r, c) AS ls FROM q GROUP BY 1)"""


@query(f"WITH {_STFT} SELECT vec_id, f * 9 + k AS cell, round(mag, 6) AS mag FROM z")
def f_stft(spark, sf):
    """Magnitudes of all frames and bins."""
    return _each(spark, sf, "cell", "mag", lambda x: _view(x).mag.reshape(len(x), -1))


@query(f"WITH {_IMAGE} SELECT vec_id, r * 7 + c AS cell, CAST(g AS DOUBLE) AS g FROM q")
def f_quant(spark, sf):
    """Grey levels (32) of log power."""
    return _each(spark, sf, "cell", "g", lambda x: _view(x).grey.reshape(len(x), -1))


_OFFSETS = ", ".join(f"({i}, {round(np.sin(a * np.pi / 4) * d)}, {round(np.cos(a * np.pi / 4) * d)})" for i, (d, a) in enumerate(ft._GLCM))


@query(f"""WITH {_IMAGE}, o AS (SELECT * FROM (VALUES {_OFFSETS}) o(o, dr, dc)), n AS (SELECT x.vec_id, o, x.g AS a, y.g AS b FROM q x, o JOIN q y ON y.vec_id = x.vec_id AND y.r = x.r + dr AND y.c = x.c + dc),
s AS (SELECT vec_id, o, a, b FROM n UNION ALL SELECT vec_id, o, b, a FROM n), p0 AS (SELECT vec_id, o, a, b, count(*) AS n FROM s GROUP BY 1, 2, 3, 4), p AS (SELECT *, n / sum(n) OVER (PARTITION BY vec_id, o) AS p, CAST(a AS BIGINT) AS ia, CAST(b AS BIGINT) AS ib FROM p0)
SELECT vec_id, o AS offset_, round(sum(p * (a - b) * (a - b)), 9) AS contrast, round(sqrt(sum(p * p)), 9) AS energy, round(sum(p / (1 + (a - b) * (a - b))), 9) AS homogeneity,
  round(coalesce(CAST(sum(n) * sum(n * ia * ib) - sum(n * ia) * sum(n * ia) AS DOUBLE) / nullif(CAST(sum(n) * sum(n * ia * ia) - sum(n * ia) * sum(n * ia) AS DOUBLE), 0), 1), 9) + 0.0 AS correlation, round(-sum(p * log2(p + 1e-12)), 9) AS entropy FROM p GROUP BY 1, 2""")
def f_glcm(spark, sf):
    """Five properties of the co-occurrence of grey levels at sixteen offsets."""
    def run(x):
        grey = _view(x).grey
        found = [dsp.texture(dsp.glcm(grey, d, a * np.pi / 4, ft.GREY, counts=True)) for d, a in ft._GLCM]
        return [np.stack([t[p] for t in found], axis=1) for p in ft.GLCM_PROPS]

    out = _kernel(spark, sf, ", ".join(f"{p} array<double>" for p in ft.GLCM_PROPS), run)
    return out.select("vec_id", F.posexplode(F.arrays_zip(*ft.GLCM_PROPS)).alias("offset_", "t")).select("vec_id", "offset_", *[(_r(f"t.{p}", 9) + 0.0).alias(p) for p in ft.GLCM_PROPS])


def _pixel(values: str, y, x) -> str:
    return f"(CASE WHEN r + ({y}) BETWEEN 0 AND 8 AND c + ({x}) BETWEEN 0 AND 6 THEN {values}[(r + ({y})) * 7 + c + ({x}) + 1] ELSE 0 END)::DOUBLE"


def _ring() -> str:
    """SQL of a pixel's byte: eight neighbours on a circle, between pixels by two linear steps."""
    out = []
    for k in range(8):
        r, c = (float(np.round(v, 5)) for v in (-np.sin(2 * np.pi * k / 8), np.cos(2 * np.pi * k / 8)))
        r0, c0 = int(np.floor(r)), int(np.floor(c))
        r1, c1 = int(np.ceil(r)), int(np.ceil(c))
        row = lambda y: f"({1 - (c - c0)!r}::DOUBLE * {_pixel('qs', y, c0)} + {c - c0!r}::DOUBLE * {_pixel('qs', y, c1)})"  # noqa: B023, E731
        out.append(f"CASE WHEN {1 - (r - r0)!r}::DOUBLE * {row(r0)} + {r - r0!r}::DOUBLE * {row(r1)} >= g THEN {1 << k} ELSE 0 END")
    return " + ".join(out)


@query(f"WITH {_IMAGE}, b AS (SELECT vec_id, CAST(floor(({_ring()}) / 8) AS INT) AS bin FROM q JOIN a USING (vec_id)) SELECT vec_id, bin, round(count(*) / 63.0, 6) AS share FROM b GROUP BY 1, 2")
def f_lbp(spark, sf):
    """Shares of local binary patterns of the image."""
    return _each(spark, sf, "bin", "share", lambda x: dsp.histogram(dsp.local_binary(_view(x).grey).reshape(len(x), -1), 32, 0, 256)).filter("share > 0")


_DOWN = f"(CASE r WHEN 0 THEN {_pixel('ls', 1, 0)} - l WHEN 8 THEN l - {_pixel('ls', -1, 0)} ELSE ({_pixel('ls', 1, 0)} - {_pixel('ls', -1, 0)}) / 2 END)"
_RIGHT = f"(CASE c WHEN 0 THEN {_pixel('ls', 0, 1)} - l WHEN 6 THEN l - {_pixel('ls', 0, -1)} ELSE ({_pixel('ls', 0, 1)} - {_pixel('ls', 0, -1)}) / 2 END)"


@query(f"""WITH {_IMAGE}, d AS (SELECT vec_id, {_DOWN} AS dy, {_RIGHT} AS dx FROM q JOIN a USING (vec_id)), b AS (SELECT vec_id, CAST(least(floor(((atan2(dy, dx) + pi()) % pi()) * 16 / pi()), 15) AS INT) AS bin, sqrt(dx * dx + dy * dy) AS w FROM d)
SELECT * FROM (SELECT vec_id, bin, round(sum(w) / (sum(sum(w)) OVER (PARTITION BY vec_id) + 1e-12), 6) AS share FROM b GROUP BY 1, 2) WHERE share > 0""")
def f_hog(spark, sf):
    """Orientations of the image's gradients, weighted by their lengths."""
    def run(x):
        down, right = np.gradient(_view(x).image, axis=(1, 2))
        flat = lambda v: v.reshape(len(x), -1)
        return dsp.histogram(flat((np.arctan2(down, right) + np.pi) % np.pi), 16, 0, np.pi, flat(np.hypot(down, right)))

    return _each(spark, sf, "bin", "share", run).filter("share > 0")


@query(f"WITH {SAMPLES} SELECT vec_id, round(regr_slope(v, i), 8) AS slope, round(regr_r2(v, i), 8) AS r2 FROM v GROUP BY 1")
def f_polyfit1(spark, sf):
    def line(x):
        t = np.arange(x.shape[1], dtype=float)
        rate = dsp.slope(x, t)
        return [rate, rate**2 * t.var() / x.var(axis=1)]

    return _values(spark, sf, "slope r2", line, 8)


@query(f"WITH {SAMPLES}, n AS (SELECT *, ntile(10) OVER (PARTITION BY vec_id ORDER BY i) AS part FROM v) SELECT vec_id, CAST(part - 1 AS INT) AS part, round(sum(v * v), 6) AS energy FROM n GROUP BY 1, 2")
def f_split(spark, sf):
    """Energy of ten near-equal parts."""
    return _each(spark, sf, "part", "energy", lambda x: ft.TimeView(x, 1000.0).parts)


@query(f"WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) AS k FROM v) SELECT vec_id, round(avg(v), 6) AS trimmed FROM k WHERE k > 6 AND k <= 58 GROUP BY 1")
def f_trim(spark, sf):
    s = F.array_sort("x")
    return signals(spark, sf).select("vec_id", _r(F.aggregate(F.slice(s, 7, 52), F.lit(0.0), lambda a, v: a + v) / 52).alias("trimmed"))


@query(f"WITH {SAMPLES} SELECT vec_id, i, round(CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN 1e9 ELSE least(greatest(v * 1e10, -1e9), 1e9) END, 3) AS safe FROM v")
def f_san(spark, sf):
    """Values that aren't finite become 0, others are bounded."""
    raw = F.when(F.col("i") == 0, F.lit(float("nan"))).when(F.col("i") == 1, F.lit(2e10)).otherwise(F.col("v") * 1e10)
    safe = F.when(F.isnan(raw) | (F.abs(raw) == float("inf")), 0.0).otherwise(F.greatest(F.least(raw, F.lit(1e9)), F.lit(-1e9)))
    return samples(spark, sf).select("vec_id", "i", F.round(safe, 3).alias("safe"))


@query(f"WITH {SAMPLES} SELECT vec_id, i, round(sum(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM v")
def f_conv5(spark, sf):
    """Mean of five samples, zeros beyond the ends."""
    return _each(spark, sf, "i", "smooth", lambda x: np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (2, 2))), 5, axis=1).mean(axis=2))


@query(f"WITH {SAMPLES} SELECT vec_id, i, round_even((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255, 0) AS g FROM v WINDOW w AS (PARTITION BY vec_id)")
def f_minmax255(spark, sf):
    lo, hi = F.array_min("x"), F.array_max("x")
    s = signals(spark, sf).select("vec_id", F.posexplode("x").alias("i", "v"), lo.alias("lo"), hi.alias("hi"))
    return s.select("vec_id", "i", F.coalesce(F.bround(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 255, 0), F.lit(0.0)).alias("g"))


@query(f"WITH {SAMPLES} SELECT vec_id, CAST(i / 4 AS INT) AS i, v FROM v WHERE i % 4 = 0")
def f_decim(spark, sf):
    """Every fourth sample."""
    return signals(spark, sf).select("vec_id", F.posexplode(F.filter("x", lambda v, i: i % 4 == 0)).alias("i", "v"))


# ---------------------------------------------------------------- wavelets
_TAPS = "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for j, (lo, hi) in enumerate(zip(dsp._LOW.tolist(), dsp._HIGH.tolist(), strict=True))) + ") t(j, lo, hi))"


def _level(name: str, source: str, n: int) -> str:
    """SQL of one wavelet level of all nodes of ``source`` (vec_id, node, i, v; n samples each): approximation 'a', detail 'd'."""
    at = f"CASE WHEN p < 0 THEN -1 - p WHEN p > {n - 1} THEN {2 * n - 1} - p ELSE p END"
    o = f"{name}o AS (SELECT vec_id, node, k, lo, hi, 2 * k + 1 - j AS p FROM (SELECT DISTINCT vec_id, node FROM {source}), range(0, {(n + 7) // 2}) r(k), taps)"
    return o + f", {name}w AS (SELECT o.vec_id, o.node, CAST(k AS INT) AS i, sum(lo * v) AS a, sum(hi * v) AS d FROM {name}o o JOIN {source} s ON s.vec_id = o.vec_id AND s.node = o.node AND s.i = {at} GROUP BY 1, 2, 3)" \
        f", {name} AS (SELECT vec_id, node || 'a' AS node, i, a AS v FROM {name}w UNION ALL SELECT vec_id, node || 'd', i, d FROM {name}w)"


_START = SAMPLES + ", n0 AS (SELECT vec_id, '' AS node, i, v FROM v), " + _TAPS


@query(f"""WITH {_START}, {_level('l1', 'n0', 64)}, k1 AS (SELECT * FROM l1 WHERE node = 'a'), {_level('l2', 'k1', 35)}, k2 AS (SELECT * FROM l2 WHERE node = 'aa'), {_level('l3', 'k2', 21)}
SELECT vec_id, 'd1' AS band, i, round(v, 6) AS v FROM l1 WHERE node = 'd' UNION ALL SELECT vec_id, 'd2', i, round(v, 6) FROM l2 WHERE node = 'ad' UNION ALL SELECT vec_id, CASE node WHEN 'aaa' THEN 'a3' ELSE 'd3' END, i, round(v, 6) FROM l3""")
def f_dwt(spark, sf):
    """Three wavelet levels: the last approximation and all details."""
    names = ("a3", "d3", "d2", "d1")
    out = _kernel(spark, sf, ", ".join(f"{n} array<double>" for n in names), lambda x: dsp.wavedec(x, 3))
    bands = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(n).alias("y")) for n in names])).alias("b")
    return out.select("vec_id", bands).select("vec_id", "b.band", F.posexplode("b.y").alias("i", "y")).select("vec_id", "band", "i", _r("y").alias("v"))


@query(f"WITH {_START}, {_level('l1', 'n0', 64)}, {_level('l2', 'l1', 35)}, {_level('l3', 'l2', 21)}, {_level('l4', 'l3', 14)}, e AS (SELECT vec_id, node, sum(v * v) AS e FROM l4 GROUP BY 1, 2) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY node) - 1 AS INT) AS node, round(e, 6) AS energy FROM e")
def f_wpt(spark, sf):
    """Energies of the sixteen wavelet packet nodes."""
    return _each(spark, sf, "node", "energy", lambda x: (dsp.packet(x, 4) ** 2).sum(axis=2))


@query(f"WITH {SAMPLES}, c AS (SELECT vec_id, i // 8 AS c, sum(v * v) AS e FROM v GROUP BY 1, 2), w AS (SELECT *, e / (sum(e) OVER (PARTITION BY vec_id) + 1e-12) AS w FROM c), m AS (SELECT vec_id, sum(c * w) AS m FROM w GROUP BY 1) SELECT vec_id, round(any_value(m), 6) AS centroid, round(sqrt(sum(pow(c - m, 2) * w)), 6) AS spread, round(max(w), 6) AS max_frac, CAST(count(*) FILTER (e >= 0.1 * mx) AS DOUBLE) AS active10 FROM (SELECT w.*, m, max(e) OVER (PARTITION BY vec_id) AS mx FROM w JOIN m USING (vec_id)) GROUP BY 1")
def f_spatial(spark, sf):
    """Localisation of the energy of a patch of 8 channels x 8 samples."""
    def place(x):
        v = ft.PatchView(x.reshape(len(x), 8, -1))
        return [*dsp.centre_spread(v.w), v.w.max(axis=1), v.active(0.1).sum(axis=1)]

    return _values(spark, sf, "centroid spread max_frac active10", place)


@query(f"WITH {SAMPLES}, h AS (SELECT a.vec_id, a.i, any_value(a.v) AS v, sum(b.v / tan(pi() * (a.i - b.i) / 64)) / 32 AS h FROM v a JOIN v b ON a.vec_id = b.vec_id AND abs(a.i - b.i) % 2 = 1 GROUP BY 1, 2) SELECT vec_id, i, round(sqrt(v * v + h * h), 6) AS env FROM h")
def f_hilbert(spark, sf):
    """Envelope: the signal and its quadrature, which SQL sums with cotangents."""
    return _each(spark, sf, "i", "env", dsp.envelope)


@query(f"WITH {_DFT} SELECT vec_id, CAST(m - 1 AS INT) AS m, round(sum(ln(mag + 1e-12) * cos(2 * pi() * k * m / 64) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / 64, 6) AS cepstral FROM f, range(1, 9) t(m) GROUP BY 1, 2")
def f_irfft(spark, sf):
    """First cepstral coefficients."""
    return _each(spark, sf, "m", "cepstral", lambda x: np.fft.irfft(np.log(_mag(x) + EPS), x.shape[1])[:, 1:9])


@query("WITH k AS (SELECT vec_id, len(embedding) AS n, unnest(range(0, len(embedding) // 2 + 1)) AS k FROM embeddings) SELECT vec_id, CAST(k AS INT) AS k, round(k * 1000.0 / n, 6) AS hz FROM k")
def f_freqs(spark, sf):
    """Frequencies of the bins of each window at 1 kHz."""
    n = F.size("x")
    bins = signals(spark, sf).select("vec_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor(n / 2).cast("int"))).alias("k"))
    return bins.select("vec_id", "k", _r(F.col("k") * 1000.0 / F.col("n")).alias("hz"))


# ---------------------------------------------------------------- filters and baseline transforms
def _recursion(name: str, source: str, fs: float) -> str:
    """SQL of the filter's run over ``source`` (id, t from 0, v), from the steady state of the first sample: id, t, y."""
    sections = dsp.bandpass(fs).tolist()
    states = [f"{s}{k}" for k in range(len(sections)) for s in "pq"]
    begin = [f"{-sections[0][0]!r} * v" if k < 2 else "0.0::DOUBLE" for k in range(len(states))]
    step, v = [], "i.v"
    for k, (g, a1, a2) in enumerate(sections):
        step += [f"{g!r} * {v} + {{p{k}}} AS y{k}", f"{{q{k}}} - {a1!r} * y{k} AS p{k}_", f"{-g!r} * {v} - {a2!r} * y{k} AS q{k}_"]
        v = f"y{k}"
    step = ", ".join(step)
    here = lambda text, values: text.format(**dict(zip(states, values, strict=True)))
    out = ", ".join(f"{s}_" for s in states)
    first = f"SELECT id, t, {v} AS y, {out} FROM (SELECT i.id, i.t, {here(step, [f'b.{s}' for s in states])} FROM {source} i JOIN (SELECT id, {', '.join(f'{e} AS {s}' for e, s in zip(begin, states, strict=True))} FROM {source} WHERE t = 0) b ON b.id = i.id WHERE i.t = 0)"
    more = f"SELECT id, t, {v} AS y, {out} FROM (SELECT i.id, i.t, {here(step, [f'r.{s}_' for s in states])} FROM {name} r JOIN {source} i ON i.id = r.id AND i.t = r.t + 1)"
    return f"{name} AS ({first} UNION ALL {more})"


def _prepared(source: str, n: int, fs: float) -> str:
    """SQL of rows without mean, band-passed forwards and backwards from odd extensions, with unit spread: z (id, i, y)."""
    edge = 27
    return f"""c AS (SELECT id, i, v - avg(v) OVER (PARTITION BY id) AS v FROM {source}), ends AS (SELECT id, max(v) FILTER (i = 0) AS a, max(v) FILTER (i = {n - 1}) AS b FROM c GROUP BY 1),
e AS (SELECT id, i + {edge} AS t, v FROM c UNION ALL SELECT id, {edge} - i, 2 * a - v FROM c JOIN ends USING (id) WHERE i BETWEEN 1 AND {edge} UNION ALL SELECT id, {edge + 2 * (n - 1)} - i, 2 * b - v FROM c JOIN ends USING (id) WHERE i BETWEEN {n - 1 - edge} AND {n - 2}),
{_recursion("fw", "e", fs)}, back AS (SELECT id, {n + 2 * edge - 1} - t AS t, y AS v FROM fw), {_recursion("bw", "back", fs)},
y AS (SELECT id, {n + edge - 1} - t AS i, y FROM bw WHERE t BETWEEN {edge} AND {n + edge - 1}),
z AS (SELECT id, CAST(i AS INT) AS i, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-12) AS y FROM y WINDOW w AS (PARTITION BY id))"""


@query(f"WITH RECURSIVE {SAMPLES}, s AS (SELECT vec_id AS id, i, v FROM v), {_prepared('s', 64, 10_000.0)} SELECT id AS vec_id, i, round(y, 6) + 0.0 AS y FROM z")
def f_pre(spark, sf):
    """Band-passed, scaled windows."""
    out = _kernel(spark, sf, "y array<double>", lambda x: [dsp.preprocess(x, 10_000.0)])
    return out.select("vec_id", F.posexplode("y").alias("i", "y")).select("vec_id", "i", (_r("y") + 0.0).alias("y"))


@query(f"WITH RECURSIVE {SAMPLES}, s AS (SELECT vec_id * 2 + i // 32 AS id, i % 32 AS i, v FROM v), {_prepared('s', 32, 10_000.0)} SELECT id // 2 AS vec_id, CAST(id % 2 AS INT) AS channel, i, round(y, 6) + 0.0 AS y FROM z")
def f_prep(spark, sf):
    """Channels of patches of 2 x 32 samples, each without mean, band-passed and scaled."""
    out = _kernel(spark, sf, "y array<double>", lambda x: [dsp.preprocess(x.reshape(-1, 32), 10_000.0).reshape(len(x), -1)])
    at = out.select("vec_id", F.posexplode("y").alias("at", "y"))
    return at.select("vec_id", F.floor(F.col("at") / 32).cast("int").alias("channel"), (F.col("at") % 32).alias("i"), (_r("y") + 0.0).alias("y"))


@query(f"""WITH {SAMPLES}, f AS (SELECT vec_id, k, log10(sqrt(pow(sum(v * cos(2 * pi() * k * i / 384)), 2) + pow(sum(v * sin(2 * pi() * k * i / 384)), 2)) + 1e-12) AS m FROM v, range(0, 193) t(k) GROUP BY 1, 2),
d AS (SELECT vec_id, k, m - avg(m) OVER (PARTITION BY vec_id) AS d FROM f) SELECT vec_id, CAST(k AS INT) AS k, round(d::FLOAT::DOUBLE, 4) + 0.0 AS level FROM d""")
def f_rdft(spark, sf):
    """Redundant spectrum of the baseline network: the bins that a window of 64 samples fills."""
    levels = _each(spark, sf, "k", "level", lambda x: baselines.redundant_spectrum(x, 10_000.0)[:, : 3 * x.shape[1] + 1], 4)
    return levels.withColumn("level", F.col("level") + 0.0)


@query(f"""WITH {_START}, {_level('l1', 'n0', 64)}, k1 AS (SELECT * FROM l1 WHERE node = 'a'), {_level('l2', 'k1', 35)}, k2 AS (SELECT * FROM l2 WHERE node = 'aa'), {_level('l3', 'k2', 21)},
o AS (SELECT vec_id, i + CASE node WHEN 'aaa' THEN 0 ELSE 14 END AS i, v FROM l3 UNION ALL SELECT vec_id, i + 28, v FROM l2 WHERE node = 'ad' UNION ALL SELECT vec_id, i + 49, v FROM l1 WHERE node = 'd')
SELECT vec_id, CAST(i AS INT) AS i, round(v::FLOAT::DOUBLE, 4) + 0.0 AS v FROM o""")
def f_dwt3(spark, sf):
    """Three wavelet levels, concatenated: the last approximation, then details from the last level on."""
    return _each(spark, sf, "i", "v", lambda x: baselines.wavelet_coefficients(x, 10_000.0), 4).withColumn("v", F.col("v") + 0.0)


# The mel scale of the oracle: linear below 1 kHz (mel 15), then equal ratios.
_MEL = """m AS (SELECT j, (15 + ln(5) / (ln(6.4) / 27)) * j / 81 AS mel FROM range(0, 82) t(j)), h AS (SELECT j, CASE WHEN mel < 15 THEN mel * 200.0 / 3 ELSE 1000 * exp(ln(6.4) / 27 * (mel - 15)) END AS hz FROM m),
tri AS (SELECT l.j AS f, k, greatest(0, least((k * 156.25 - l.hz) / greatest(c.hz - l.hz, 1e-9), (r.hz - k * 156.25) / greatest(r.hz - c.hz, 1e-9))) AS t FROM h l JOIN h c ON c.j = l.j + 1 JOIN h r ON r.j = l.j + 2, range(0, 33) b(k)),
bank AS (SELECT f, k, t / CASE WHEN sum(t) OVER (PARTITION BY f) > 0 THEN sum(t) OVER (PARTITION BY f) ELSE 1 END AS t FROM tri)"""


@query(f"""WITH {SAMPLES}, {_MEL}, u AS (SELECT vec_id, i, v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) / 32 AS v FROM v),
p AS (SELECT vec_id, k, pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2) AS p FROM u, range(0, 33) t(k) GROUP BY 1, 2),
g AS (SELECT vec_id, f, ln(sum(t * p) + 1e-10) AS g FROM p JOIN bank USING (k) GROUP BY 1, 2), o AS (SELECT vec_id, c, sum(cos(pi() * c * (2 * f + 1) / 160) * g) * sqrt(2.0 / 80) / CASE c WHEN 0 THEN sqrt(2) ELSE 1 END AS y FROM g, range(0, 40) t(c) GROUP BY 1, 2)
SELECT vec_id, CAST(c AS INT) AS c, round(y::FLOAT::DOUBLE, 3) + 0.0 AS y FROM o""")
def f_mfcc(spark, sf):
    """Mel cepstra of windows of one frame: 80 triangles, 40 coefficients."""
    return _each(spark, sf, "c", "y", lambda x: baselines.mel_cepstrum(x, 10_000.0), 3).withColumn("y", F.col("y") + 0.0)


# Poles of the analog prototype, to a band, through z = (4 + s) / (4 - s); one row a section, by distance from the origin.
@query("""WITH r AS (SELECT DISTINCT CAST(10000 + p_size AS DOUBLE) AS fs FROM part), e AS (SELECT fs, 4 * tan(pi() * 20 / fs) AS lo, 4 * tan(pi() * least(2000, 0.495 * fs) / fs) AS hi FROM r),
p AS (SELECT fs, hi - lo AS w, lo * hi AS c, cos(pi() * (2 * m + 5) / 8) * (hi - lo) / 2 AS x, sin(pi() * (2 * m + 5) / 8) * (hi - lo) / 2 AS y FROM e, range(0, 4) t(m)),
q AS (SELECT *, x * x - y * y - c AS u, 2 * x * y AS v FROM p), s AS (SELECT *, sqrt((sqrt(u * u + v * v) + u) / 2) AS a, CASE WHEN v < 0 THEN -1 ELSE 1 END * sqrt((sqrt(u * u + v * v) - u) / 2) AS b FROM q),
z AS (SELECT fs, w, x + k * a AS x, y + k * b AS y FROM s, (VALUES (1), (-1)) t(k)), d AS (SELECT *, pow(4 - x, 2) + y * y AS n FROM z), g AS (SELECT fs, 4 * any_value(w) * exp(-sum(ln(n)) / 8) AS gain FROM d GROUP BY 1),
o AS (SELECT fs, (16 - x * x - y * y) / n AS re, 8 * y / n AS im FROM d WHERE y > 0)
SELECT fs, CAST(row_number() OVER (PARTITION BY fs ORDER BY re * re + im * im) - 1 AS INT) AS section, round(gain, 9) AS gain, round(-2 * re, 9) AS a1, round(re * re + im * im, 9) AS a2 FROM o JOIN g USING (fs)""")
def f_sos(spark, sf):
    """Sections of the band-pass at each sampling rate that the table has."""
    def design(batches):
        for b in batches:
            rows = [(fs, i, *map(float, s)) for fs in b.column("fs").to_pylist() for i, s in enumerate(dsp.bandpass(fs))]
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], schema=shape)

    shape = pa.schema([("fs", pa.float64()), ("section", pa.int32()), ("gain", pa.float64()), ("a1", pa.float64()), ("a2", pa.float64())])
    rates = read(spark, sf, "part").select((10_000 + F.col("p_size")).cast("double").alias("fs")).distinct()
    out = rates.mapInArrow(design, "fs double, section int, gain double, a1 double, a2 double")
    return out.select("fs", "section", *[_r(c, 9).alias(c) for c in ("gain", "a1", "a2")])


# ---------------------------------------------------------------- extraction
def _windows(spark, sf):
    """(manifest, patches of 4 channels x 256 samples): each window reads four consecutive blocks."""
    b = blocks(spark, sf)
    known = b.groupBy("recording_id").agg(F.max("block").alias("last"))
    manifest = b.filter("locus = 0").select("recording_id", "block").join(F.broadcast(known), "recording_id").filter("block + 3 < last")  # the last block may lack channels
    manifest = manifest.select(F.concat_ws("-", "recording_id", "block").alias("sample_id"), "recording_id", "block", F.pmod("block", F.lit(8)).alias("locus"), F.lit(8).alias("n_loci"))
    return manifest, extraction.patches(manifest, b, 4)


@query()
def x_window(spark, sf):
    """All 1,002 features of every window, one pass, four arrays."""
    return extraction.extract(_windows(spark, sf)[1], 1000.0)


@query()
def x_pipeline(spark, sf):
    """From manifest to fused table: patches, shards by recording (half of them, then the ones that lack), assembly and fusion with their checks."""
    manifest, patches = _windows(spark, sf)
    top = f"{work_dir(spark)}/x-{uuid.uuid4().hex}"
    chunks = manifest.select("sample_id", F.col("recording_id").alias("chunk"))
    done = lambda: spark.read.parquet(top)
    named = lambda df: extraction.extract(df, 1000.0).join(chunks, "sample_id")
    some = patches.join(chunks.filter("chunk % 2 = 0"), "sample_id", "left_semi")  # a run that was cut off
    named(some).write.mode("append").partitionBy("chunk").parquet(top)
    named(extraction.pending(patches, done())).write.mode("append").partitionBy("chunk").parquet(top)
    shards = extraction.assemble(done(), manifest.groupBy(F.col("recording_id").alias("chunk")).agg(F.count(F.lit(1)).alias("n")), rows="n")
    return extraction.fuse(shards.drop("chunk"), manifest, "block")


@query()
def agg_colstats(spark, sf):
    """Statistics of each time feature over all windows."""
    return extraction.column_statistics(extraction.extract(_windows(spark, sf)[1], 1000.0, domains=("time",)), "time")


@query()
def x_domcomp(spark, sf):
    """Features by domain, and those that vary: one extraction, one pass."""
    e = extraction.extract(_windows(spark, sf)[1], 1000.0)
    return extraction.domain_statistics(e, tuple(SIZES)).groupBy("domain").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(~F.col("near_constant")).alias("varying"))
