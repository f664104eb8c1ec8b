"""Queries of the feature processors and of the mixture models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framespark.operators import mixtures as M
from framespark.operators.spectral import Processor, extract, packed, pitch_post, resampled
from framespark.plans.cuts import cut
from framespark.plans.registry import Registry
from framespark.sources import views
from framespark.sources.views import FEA, SIG

R = Registry()

_PREP = f"""WITH {SIG},
par AS (SELECT sample_rate, l, s, CAST(pow(2, ceil(log2(l))) AS INT) AS n FROM (SELECT DISTINCT sample_rate, CAST(trunc(sample_rate * 0.025 + 1e-9) AS INT) AS l, CAST(trunc(sample_rate * 0.01 + 1e-9) AS INT) AS s FROM sig)),
int_ AS (SELECT signal_id, sample_rate, CASE WHEN dtype = 'int16' THEN samples ELSE list_transform(samples, lambda v: trunc(greatest(least(v * 32768::DOUBLE, 32767::DOUBLE), -32768::DOUBLE))) END AS y FROM sig),
cut_ AS (SELECT signal_id, sample_rate, l, n, CAST(i AS INT) AS frame, y[i * s + 1 : i * s + l] AS x FROM (SELECT int_.*, l, s, n, unnest(range(0, CASE WHEN len(y) < l THEN 0 ELSE 1 + (len(y) - l) // s END)) AS i FROM int_ JOIN par USING (sample_rate))),
mean AS (SELECT *, list_sum(x) / l AS m FROM cut_),
dc AS (SELECT signal_id, sample_rate, l, n, frame, list_transform(x, lambda v: v - m) AS x FROM mean),
en AS (SELECT *, ln(greatest(list_sum(list_transform(x, lambda v: v * v)), 1.1920928955078125e-07)) AS e FROM dc),
win AS (SELECT signal_id, sample_rate, l, n, frame, e, list_transform(range(1, l + 1), lambda i: (x[i] - 0.97::DOUBLE * x[greatest(i - 1, 1)]) * pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - 1) / (l - 1)), 0.85::DOUBLE)) AS x FROM en),
pow_ AS (SELECT signal_id, sample_rate, n, frame, e, list_transform(range(0, n // 2 + 1), lambda k: pow(list_sum(list_transform(range(1, l + 1), lambda i: x[i] * cos(2 * pi() * (i - 1) * k / n))), 2) + pow(list_sum(list_transform(range(1, l + 1), lambda i: x[i] * sin(2 * pi() * (i - 1) * k / n))), 2)) AS p FROM win)"""
_MEL = """,
pts AS (SELECT sample_rate, n, b, 1127 * ln(1 + 20 / 700.0::DOUBLE) + b * (1127 * ln(1 + sample_rate / 2.0::DOUBLE / 700) - 1127 * ln(1 + 20 / 700.0::DOUBLE)) / 7 AS m FROM par, range(0, 8) t(b)),
tri AS (SELECT a.sample_rate, a.n, a.b, a.m AS lo, c.m AS mid, h.m AS hi FROM pts a JOIN pts c ON c.sample_rate = a.sample_rate AND c.b = a.b + 1 JOIN pts h ON h.sample_rate = a.sample_rate AND h.b = a.b + 2),
wts AS (SELECT sample_rate, b, list(CASE WHEN f > lo AND f < hi THEN CASE WHEN f <= mid THEN (f - lo) / (mid - lo) ELSE (hi - f) / (hi - mid) END ELSE 0.0 END ORDER BY k) AS w FROM (SELECT *, 1127 * ln(1 + k * sample_rate / n::DOUBLE / 700) AS f FROM (SELECT *, unnest(range(0, n // 2)) AS k FROM tri)) GROUP BY sample_rate, b),
bank AS (SELECT sample_rate, list(w ORDER BY b) AS w FROM wts GROUP BY sample_rate),
fb AS (SELECT signal_id, frame, e, list_transform(w, lambda r: ln(greatest(list_sum(list_transform(range(1, n // 2 + 1), lambda k: r[k] * p[k])), 1.1920928955078125e-07))) AS f FROM pow_ JOIN bank USING (sample_rate))"""
_OUT = "list_transform({0}, lambda v: round(v, 3) + 0.0) AS vec"
_MELS = {"num_bins": 6, "dither": 0.0}
_DCT = "list_transform(range(0, 5), lambda k: (CASE WHEN k = 0 THEN sqrt(1 / 6.0::DOUBLE) ELSE sqrt(2 / 6.0::DOUBLE) END) * list_sum(list_transform(range(1, 7), lambda i: f[i] * cos(pi() / 6 * (i - 0.5::DOUBLE) * k))) * (1 + 11 * sin(pi() * k / 22)))"


def _features(spark, d, name, **params):
    out = extract(views.signals(spark, d), Processor(name, **params), precision="double")
    return out.select("signal_id", "frame", F.transform("vec", lambda v: F.round(v, 3) + 0.0).alias("vec"))


@R.query(_PREP + " SELECT signal_id, frame, " + _OUT.format("list_concat([e], list_transform(p[2:], lambda v: ln(greatest(v, 1.1920928955078125e-07))))") + " FROM pow_")
def spectrogram(spark, d):
    return _features(spark, d, "spectrogram", dither=0.0)


@R.query(_PREP + _MEL + " SELECT signal_id, frame, " + _OUT.format("f") + " FROM fb")
def filterbank(spark, d):
    return _features(spark, d, "filterbank", **_MELS)


@R.query(_PREP + _MEL + f", c AS (SELECT signal_id, frame, e, {_DCT} AS c FROM fb) SELECT signal_id, frame, " + _OUT.format("list_concat([e], c[2:])") + " FROM c")
def mfcc(spark, d):
    return _features(spark, d, "mfcc", num_ceps=5, **_MELS)


@R.query(_PREP + _MEL + f", c AS (SELECT signal_id, frame, {_DCT} AS c FROM fb) SELECT signal_id, frame, " + _OUT.format("list_concat(c[2:], [c[1] * sqrt(2)])") + " FROM c")
def mfcc_htk(spark, d):
    return _features(spark, d, "mfcc", num_ceps=5, htk_compat=True, use_energy=False, **_MELS)


@R.query("SELECT CAST(k AS INT) AS k, round(1 + 11 * sin(pi() * k / 22), 8) AS w FROM range(0, 22) t(k)")
def lifter(spark, d):
    from framespark.functions.kernels import lifter as w

    return spark.createDataFrame([(k, round(float(v), 8)) for k, v in enumerate(w(22, 22.0))], "k int, w double")


@R.query(_PREP.split("win AS")[0].replace("int_ AS (SELECT signal_id, sample_rate, CASE WHEN dtype = 'int16' THEN samples ELSE list_transform(samples, lambda v: trunc(greatest(least(v * 32768::DOUBLE, 32767::DOUBLE), -32768::DOUBLE))) END AS y FROM sig)", "int_ AS (SELECT signal_id, sample_rate, samples AS y FROM sig)").rstrip().rstrip(",")
  + " SELECT signal_id, frame, [round(ln(greatest(list_sum(list_transform(x, lambda v: v * v)), 2.2250738585072014e-308)), 3) + 0.0] AS vec FROM en")
def energy(spark, d):
    """Raw log energy; what is left of a silent frame's samples when their mean is off counts as nothing."""
    return _features(spark, d, "energy", dither=0.0)


_EPS = "1.1920928955078125e-07::DOUBLE"
#: The bands of perceptual linear prediction, linear; the loudness of their centres.
_BANDS = _PREP + _MEL.split("fb AS")[0] + f"""loud AS (SELECT sample_rate, list(pow(s / (s + 1.6e5::DOUBLE), 2) * (s + 1.44e6::DOUBLE) / (s + 9.61e6::DOUBLE) ORDER BY b) AS q FROM (SELECT sample_rate, b, pow(700 * (exp(mid / 1127::DOUBLE) - 1), 2) AS s FROM (SELECT DISTINCT sample_rate, b, mid FROM tri WHERE b < 6)) GROUP BY sample_rate),
bands AS (SELECT signal_id, sample_rate, frame, e, list_transform(w, lambda r: greatest(list_sum(list_transform(range(1, n // 2 + 1), lambda k: r[k] * p[k])), {_EPS})) AS f FROM pow_ JOIN bank USING (sample_rate))"""


def _predicted(source: str) -> str:
    """Cepstra of an all-pole model of order 4 over 6 bands: autocorrelations, the recursion of prediction written out, its cepstrum, lifted."""
    out = [f", ld AS (SELECT signal_id, frame, e, list_transform(range(1, 7), lambda i: pow(f[i] * q[i], 1 / 3.0::DOUBLE)) AS g FROM {source} JOIN loud USING (sample_rate)), au AS (SELECT signal_id, frame, e"]
    for k in range(5):
        terms = " + ".join(f"{2.0 if 0 < i < 7 else 1.0}::DOUBLE * cos(pi() / 7 * {k} * {i}) * g[{min(max(i, 1), 6)}]" for i in range(8))
        out.append(f", ({terms}) / 14 AS r{k}")
    out.append(f" FROM ld), s0 AS (SELECT *, greatest(r0, {_EPS}) AS v FROM au)")
    for i in range(1, 5):
        mirror = "".join(f" - a{j} * r{i - j}" for j in range(1, i))
        out.append(f", k{i}_ AS (SELECT *, (r{i}{mirror}) / v AS k FROM s{i - 1})")
        news = ", ".join([f"a{j} - k * a{i - j} AS a{j}" for j in range(1, i)] + [f"k AS a{i}"])
        out.append(f", s{i} AS (SELECT signal_id, frame, e, r0, r1, r2, r3, r4, greatest(v * (1 - k * k), {_EPS}) AS v, {news} FROM k{i}_)")
    out.append(", c1_ AS (SELECT *, a1 AS c1 FROM s4)")
    for i in range(2, 5):
        out.append(f", c{i}_ AS (SELECT *, a{i} + " + " + ".join(f"{j} / {i}.0::DOUBLE * c{j} * a{i - j}" for j in range(1, i)) + f" AS c{i} FROM c{i - 1}_)")
    lifted = ", ".join(f"c{k} * (1 + 11 * sin(pi() * {k} / 22))" for k in range(1, 5))
    return "".join(out) + " SELECT signal_id, frame, " + _OUT.format(f"[e, {lifted}]") + " FROM c4_"


@R.query(_BANDS + _predicted("bands"))
def plp(spark, d):
    return _features(spark, d, "plp", lpc_order=4, num_ceps=5, **_MELS)


@R.query(_BANDS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", lg AS (SELECT signal_id, sample_rate, frame, e, list_transform(f, lambda v: ln(v + {_EPS})) AS f FROM bands),
feed AS (SELECT *, CASE WHEN frame < 4 THEN list_transform(f, lambda v: 0.0::DOUBLE) ELSE list_transform(range(1, 7), lambda i: 0.2::DOUBLE * f[i] + 0.1::DOUBLE * f1[i] - 0.1::DOUBLE * f3[i] - 0.2::DOUBLE * f4[i]) END AS x FROM (SELECT *, lag(f, 1) OVER o AS f1, lag(f, 3) OVER o AS f3, lag(f, 4) OVER o AS f4 FROM lg WINDOW o AS (PARTITION BY signal_id ORDER BY frame))),
ra AS (SELECT signal_id, frame, x AS y FROM feed WHERE frame = 0 UNION ALL SELECT f.signal_id, f.frame, list_transform(range(1, 7), lambda i: f.x[i] + 0.94::DOUBLE * ra.y[i]) FROM ra JOIN feed f ON f.signal_id = ra.signal_id AND f.frame = ra.frame + 1),
out_ AS (SELECT signal_id, sample_rate, frame, e, list_transform(y, lambda v: exp(v)) AS f FROM ra JOIN lg USING (signal_id, frame))""" + _predicted("out_"))  # fmt: skip
def rasta_plp(spark, d):
    return _features(spark, d, "plp", with_rasta=True, lpc_order=4, num_ceps=5, **_MELS)


_WARPED = (
    _PREP
    + """,
hz AS (SELECT sample_rate, n, q, b, 0.85::DOUBLE + q * 0.01::DOUBLE AS a, sample_rate / 2.0::DOUBLE AS top, 700 * (exp((1127 * ln(1 + 20 / 700.0::DOUBLE) + b * (1127 * ln(1 + sample_rate / 2.0::DOUBLE / 700) - 1127 * ln(1 + 20 / 700.0::DOUBLE)) / 7) / 1127) - 1) AS f FROM par, range(0, 8) t(b), range(0, 41) u(q)),
ends AS (SELECT *, 60 * greatest(1.0::DOUBLE, a) AS l, (top - 20) * least(1.0::DOUBLE, a) AS r FROM hz),
pts AS (SELECT sample_rate, n, q, b, 1127 * ln(1 + (CASE WHEN abs(a - 1) < 1e-9 OR f < 20 OR f > top THEN f WHEN f < l THEN 20 + (l / a - 20) / (l - 20) * (f - 20) WHEN f < r THEN f / a ELSE top + (top - r / a) / (top - r) * (f - top) END) / 700) AS m FROM ends),
tri AS (SELECT a.sample_rate, a.n, a.q, a.b, a.m AS lo, c.m AS mid, h.m AS hi FROM pts a JOIN pts c ON c.sample_rate = a.sample_rate AND c.q = a.q AND c.b = a.b + 1 JOIN pts h ON h.sample_rate = a.sample_rate AND h.q = a.q AND h.b = a.b + 2),
wts AS (SELECT sample_rate, q, b, list(CASE WHEN f > lo AND f < hi THEN CASE WHEN f <= mid THEN (f - lo) / (mid - lo) ELSE (hi - f) / (hi - mid) END ELSE 0.0 END ORDER BY k) AS w FROM (SELECT *, 1127 * ln(1 + k * sample_rate / n::DOUBLE / 700) AS f FROM (SELECT *, unnest(range(0, n // 2)) AS k FROM tri)) GROUP BY sample_rate, q, b),
bank AS (SELECT sample_rate, q, list(w ORDER BY b) AS w FROM wts GROUP BY sample_rate, q),
fb AS (SELECT signal_id, frame, list_transform(w, lambda r: ln(greatest(list_sum(list_transform(range(1, n // 2 + 1), lambda k: r[k] * p[k])), 1.1920928955078125e-07))) AS f FROM pow_ JOIN bank ON bank.sample_rate = pow_.sample_rate AND bank.q = signal_id % 41)"""
)


@R.query(_WARPED + " SELECT signal_id, frame, " + _OUT.format("f") + " FROM fb")
def filterbank_warped(spark, d):
    """With a warp per signal from its number."""
    s = views.signals(spark, d).withColumn("warp", 0.85 + (F.col("signal_id") % 41) * 0.01)
    out = extract(s, Processor("filterbank", vtln_low=60.0, vtln_high=-20.0, **_MELS), warp="warp", precision="double")
    return out.select("signal_id", "frame", F.transform("vec", lambda v: F.round(v, 3) + 0.0).alias("vec"))


_PITCH = {"min_f0": 20.0, "max_f0": 100.0, "resample_freq": 0.0, "delta_pitch": 0.02, "dither": 0.0, "frame_length": 0.1, "frame_shift": 0.02, "soft_min_f0": 5.0}


@R.query()
def kaldi_pitch(spark, d):
    return extract(views.signals(spark, d), Processor("kaldi_pitch", **_PITCH))


@R.query()
def kaldi_pitch_post(spark, d):
    p = extract(views.signals(spark, d), Processor("kaldi_pitch", **_PITCH))
    return pitch_post(p.withColumnRenamed("signal_id", "item"))


_V = "v AS (SELECT item, frame, vec[2]::DOUBLE AS c, ln(vec[3]::DOUBLE) AS lg FROM fea WHERE vec[3] > 0 AND vec[3] <= 1500 AND vec[2] BETWEEN 0 AND 1)"
_W = "1 / (1 + exp(-(-5.2::DOUBLE + 5.4::DOUBLE * exp(7.5::DOUBLE * (c - 1)) + 4.8::DOUBLE * c - 2 * exp(-10 * c) + 4.2::DOUBLE * exp(20 * (c - 1)))))"


@R.query(f"WITH {FEA}, {_V}, w AS (SELECT *, {_W} AS w FROM v), o AS (SELECT item, frame, 2 * (pow(1.0001::DOUBLE - c, 0.15::DOUBLE) - 1) AS a, (lg - sum(w * lg) OVER k / sum(w) OVER k) * 2 AS b, lg FROM w WINDOW k AS (PARTITION BY item ORDER BY frame ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING)), e AS (SELECT item, frame, a, b, lg, coalesce(lag(lg, 2) OVER o, first_value(lg) OVER o) AS m2, lag(lg, 1, lg) OVER o AS m1, lead(lg, 1, lg) OVER o AS p1, coalesce(lead(lg, 2) OVER o, last_value(lg) OVER o) AS p2 FROM o WINDOW o AS (PARTITION BY item ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
  " SELECT item, frame, list_transform([a, b, (-0.2::DOUBLE * m2 - 0.1::DOUBLE * m1 + 0.1::DOUBLE * p1 + 0.2::DOUBLE * p2) * 10, lg], lambda x: round(x + 1e-7::DOUBLE, 4) + 0.0) AS vec FROM e")  # fmt: skip
def pitch_post_columns(spark, d):
    f = views.features(spark, d).select("item", "frame", F.slice("vec", 2, 2).alias("vec")).where("vec[1] > 0 and vec[1] <= 1500 and vec[0] between 0 and 1")
    out = pitch_post(f, add_raw=True)
    return out.select("item", "frame", F.transform("vec", lambda v: F.round(v + 1e-7, 4) + 0.0).alias("vec"))


@R.query()
def resample_signals(spark, d):
    return resampled(views.signals(spark, d), 600)


def _weights(seed: int = 0) -> dict:
    r = np.random.default_rng(seed)
    dense = lambda a, b, kind: (r.standard_normal((a, b)) / np.sqrt(a), np.zeros(b), kind)
    return {"first": [dense(144, 64, "sigmoid"), dense(64, 32, "linear")], "second": [dense(160, 64, "sigmoid"), dense(64, 80, "linear")]}


def _convolutions(seed: int = 0) -> dict:
    r = np.random.default_rng(seed)
    blocks, channels = [], 1
    for out, width, stride in ((8, 64, 4), (4, 16, 1), (4, 16, 1)):
        blocks.append((r.standard_normal((width, channels, out)) / np.sqrt(width * channels), np.zeros(out), stride, np.ones(out), np.zeros(out)))
        channels = out
    return {"blocks": blocks, "dense": (r.standard_normal((32 * 4, 360)) / 10, np.zeros(360))}


@R.query()
def bottleneck(spark, d):
    """The layout with small layers (64 and 32 units) of random weights: trained ones are the caller's."""
    return extract(views.signals(spark, d), Processor("bottleneck", weights=_weights()))


@R.query()
def crepe_pitch(spark, d):
    """Three small blocks (8, 4 and 4 channels) of random weights in place of the full net, 0.1 s a frame."""
    return extract(views.signals(spark, d), Processor("crepe_pitch", weights=_convolutions(), frame_shift=0.1, frame_length=0.1))


# mixtures: a fixed model of three Gaussians over the eight components
_MEAN, _VAR, _WT = (-5.0, 0.0, 5.0), 60.0, (0.2, 0.5, 0.3)
_SIX = "[vec[1]::DOUBLE, vec[4]::DOUBLE, vec[5]::DOUBLE, vec[6]::DOUBLE, vec[7]::DOUBLE, vec[8]::DOUBLE]"
_GMM = f"""WITH {FEA}, x AS (SELECT item, frame, {_SIX} AS x FROM fea),
g AS (SELECT * FROM (VALUES (0, -5.0::DOUBLE, 0.2::DOUBLE), (1, 0.0::DOUBLE, 0.5::DOUBLE), (2, 5.0::DOUBLE, 0.3::DOUBLE)) t(g, m, w)),
ll AS (SELECT item, frame, g, x, ln(w) - 0.5::DOUBLE * list_sum(list_transform(x, lambda v: pow(v - m, 2) / 60 + ln(2 * pi() * 60))) AS ll FROM x, g),
mx AS (SELECT *, max(ll) OVER (PARTITION BY item, frame) AS top FROM ll),
po AS (SELECT item, frame, g, x, ll, exp(ll - top) / sum(exp(ll - top)) OVER (PARTITION BY item, frame) AS p FROM mx)"""


def _fixed() -> M.Mixture:
    return M.Mixture(np.array(_WT), np.tile(np.array(_MEAN)[:, None], (1, 6)), np.full((3, 6), _VAR))


def _six(spark, d):
    return views.features(spark, d).select("item", "frame", F.array(*(F.get("vec", F.lit(i)).cast("double") for i in (0, 3, 4, 5, 6, 7))).alias("vec"))


@R.query(_GMM + " SELECT item, frame, list(CAST(g AS INT) ORDER BY ll DESC)[1:2] AS gselect FROM po GROUP BY item, frame")
def gselect_topk(spark, d):
    return M.select(_six(spark, d), _fixed(), 2)


@R.query(_GMM + " SELECT item, frame, list(round(p, 6) ORDER BY ll DESC) AS p FROM po GROUP BY item, frame")
def posteriors(spark, d):
    p = M.posteriors(_six(spark, d), _fixed(), 3, 0.0)
    return p.select("item", "frame", F.transform("post", lambda v: F.round(v["p"], 6)).alias("p"))


@R.query(_GMM + ", lng AS (SELECT g, p, unnest(range(0, 6)) AS i, unnest(x) AS v FROM po), s AS (SELECT g, i, sum(p) AS n, sum(p * v) AS a, sum(p * v * v) AS b FROM lng GROUP BY g, i) SELECT CAST(g AS INT) AS g, round(max(n), 3) AS n, list(round(a, 2) + 0.0 ORDER BY i) AS s1, list(round(b, 1) + 0.0 ORDER BY i) AS s2 FROM s GROUP BY g")
def gmm_accumulate(spark, d):
    s = M.accumulate(_six(spark, d), _fixed())
    r = lambda c, k: F.transform(c, lambda v: F.round(v, k) + 0.0).alias(c)
    return s.select("g", F.round("n", 3).alias("n"), r("s1", 2), r("s2", 1))


@R.query(_GMM + ", lng AS (SELECT g, p, unnest(range(0, 6)) AS i, unnest(x) AS v FROM po), s AS (SELECT g, i, sum(p) AS n, sum(p * v) / sum(p) AS m, sum(p * v * v) / sum(p) AS b FROM lng GROUP BY g, i) SELECT CAST(g AS INT) AS g, round(max(n) / (SELECT count(*) FROM x), 6) AS weight, list(round(m, 4) + 0.0 ORDER BY i) AS mean, list(round(b - m * m, 3) ORDER BY i) AS var FROM s GROUP BY g")
def gmm_estimate(spark, d):
    model, _ = M.estimate(M.accumulate(_six(spark, d), _fixed()), _fixed())
    rows = [(g, round(float(model.weight[g]), 6), [round(float(v), 4) + 0.0 for v in model.mean[g]], [round(float(v), 3) for v in model.var[g]]) for g in range(3)]
    return spark.createDataFrame(rows, "g int, weight double, mean array<double>, var array<double>")


@R.query(f"WITH {FEA}, x AS (SELECT {_SIX} AS x FROM fea), c AS (SELECT list_concat(x, [1.0::DOUBLE]) AS x, list_concat(list_transform(range(1, 7), lambda i: x[i] * (1 + i / 10::DOUBLE) + 1), [0.0::DOUBLE]) AS y FROM x), k AS (SELECT i, j FROM range(0, 7) a(i), range(0, 7) b(j))"
  " SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(x[i + 1] * x[j + 1]), 1) + 0.0 AS q, round(sum(x[i + 1] * y[j + 1]), 1) + 0.0 AS l FROM c, k GROUP BY i, j")  # fmt: skip
def mapping_normal_eq(spark, d):
    plain = _six(spark, d)
    warped = plain.withColumn("vec", F.transform("vec", lambda v, i: v * (1 + (i + 1) / 10) + 1))
    return M.normal_equations(plain, warped, 6).select("i", "j", (F.round("q", 1) + 0.0).alias("q"), (F.round("l", 1) + 0.0).alias("l"))


@R.query()
def ubm_train(spark, d):
    """A mixture of eight Gaussians over all frames."""
    model, _ = M.train(cut(_six(spark, d), "frames"), 8, num_iters=2, num_iters_init=6)
    return model.frame(spark)


@R.query()
def vtln(spark, d):
    """A warp per speaker: features of the signals under 41 warps, maps between them, mixture and warps in turn."""
    speakers = views.utterances(spark, d).where("speaker is not null").select(F.col("name").alias("_name"), "speaker").distinct()
    s = views.signals(spark, d).join(speakers, F.col("item") == F.col("_name"))
    s = s.select(F.col("signal_id").cast("string").alias("item"), "speaker", "sample_rate", "dtype", "samples")
    p = Processor("mfcc", num_ceps=5, num_bins=6, dither=0.0, vtln_low=60.0, vtln_high=-20.0)
    factors = tuple(round(0.85 + 0.01 * i, 6) for i in range(41))
    return M.train_warps(cut(packed(s, p, "item", ("speaker",), 5, factors), "packed"), factors, "speaker")[0].select("speaker", "warp")


QUERIES, ORACLE = R.queries, R.sql
