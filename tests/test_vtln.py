"""Training of warps on packed frames: one pass makes what it needs, with the results of the frames one by one."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import mixtures as M
from framespark.operators import spectral as S
from framespark.plans import spectral_queries


def signals(spark):
    r = np.random.default_rng(3)
    rows = [(f"s{i}", "ab"[i % 2], rate, "float64", (0.3 * r.standard_normal(n)).tolist()) for i, (rate, n) in enumerate([(1000, 900), (500, 400), (1000, 333), (400, 5), (800, 700)])]
    return spark.createDataFrame(rows, "item string, speaker string, sample_rate int, dtype string, samples array<double>")


@pytest.mark.parametrize("name, more", [("mfcc", {"num_ceps": 5, "num_bins": 6}), ("plp", {"num_bins": 6, "lpc_order": 4, "num_ceps": 4, "with_rasta": True})])
def test_packed_is_extracted(spark, name, more):
    p, factors, d = S.Processor(name, dither=0.0, vtln_low=60.0, vtln_high=-20.0, **more), (0.9, 1.0, 1.13), signals(spark)
    rows = S.packed(d, p, "item", ("speaker",), 5, factors).collect()
    frames = {f: {(r.item, r.frame): r.vec for r in S.extract(d.withColumn("w", F.lit(f)), p, "item", "w").collect()} for f in factors}
    width, got = len(next(iter(frames[1.0].values()))), {}
    for r in (r for r in rows if r.sums is None):
        thin, rest = (np.frombuffer(v, np.float32).reshape(-1, width) for v in (r.thin, r.rest))
        assert r.speaker == "ab"[int(r.item[1]) % 2]
        got |= {(r.item, f): rest[f - f // 5 - 1] if f % 5 else thin[f // 5] for f in range(r.n)}
    assert got.keys() == frames[1.0].keys() and all(np.allclose(v, frames[1.0][k], atol=1e-5) for k, v in got.items())
    at = [k for k in frames[1.0] if k[1] % 5 == 0]
    x, *ys = (np.array([frames[f][k] for k in at], float) for f in (1.0, *factors))
    x = np.hstack([x, np.ones((len(x), 1))])
    total = sum(np.frombuffer(r.sums).reshape(width + 1, -1) for r in rows if r.sums is not None)
    assert np.allclose(total, x.T @ np.hstack([x, *ys]), rtol=1e-5, atol=1e-3)


def test_pruned_is_posterior():
    """Also where equals lie at the edge."""
    r = np.random.default_rng(0)
    ll = np.vstack([r.normal(size=(400, 20)) * 3, np.zeros((1, 20)), np.round(r.normal(size=(400, 20)))])
    for k, least in ((15, 0.025), (3, 0.025), (20, 0.2), (7, 0.0)):
        got = M._pruned(ll, k, least)
        order = np.argsort(-ll, axis=1, kind="stable")[:, :k]
        want = np.zeros_like(ll)
        np.put_along_axis(want, order, M.posterior(np.take_along_axis(ll, order, axis=1), least), axis=1)
        clear = [i for i in range(len(ll)) if len(set(ll[i])) == ll.shape[1]]
        assert len(clear) >= 400 and np.allclose(got[clear], want[clear])
        assert ((got > 0).sum(axis=1) <= k).all() and np.allclose(got.sum(axis=1), 1)


def test_iteration_of_packed(spark):
    """One iteration far from zero, in single precision, and the one of frames in double."""
    p, d = S.Processor("mfcc", dither=0.0, num_ceps=5, num_bins=6), signals(spark)
    frames = S.extract(d, p, "item").withColumn("vec", F.transform("vec", lambda v: (v + 100).cast("float")))
    x = [r.vec for r in frames.collect()]
    model = M.Mixture(np.full(4, 0.25), np.array(x[:160:40], float), np.full((4, 5), 9.0))
    want, ll = M.estimate(M.accumulate(frames, model), model)
    packed = spark.createDataFrame([(bytearray(np.array(x, np.float32).tobytes()),), (bytearray(),)], "x binary")
    got, other = M._better(packed, lambda batches: (M._block(b.column(0), 5)[0] for b in batches), model)
    assert np.isclose(ll, other, rtol=1e-5) and all(np.allclose(getattr(got, n), getattr(want, n), rtol=1e-3) for n in ("weight", "mean", "var"))


def test_query_in_few_jobs(spark, data, monkeypatch):
    """41 warps need no job each: the maps come with the frames."""
    monkeypatch.setattr(M, "train_warps", functools.partial(M.train_warps, num_gauss=8, num_iters=1))
    spark.sparkContext.setJobGroup("vtln", "")
    rows = spectral_queries.vtln(spark, data).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("vtln"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    grid = {round(0.85 + 0.01 * i, 6) for i in range(41)}
    assert rows and len({r.speaker for r in rows}) == len(rows) and {round(r.warp, 6) for r in rows} <= grid
    assert jobs < 100, jobs


@pytest.mark.parametrize("by_speaker", [True, False])
def test_pipeline_trains(spark, by_speaker):
    from framespark.plans.pipeline import extract_features

    d = signals(spark).where("sample_rate > 400")
    utterances = d.select(F.col("item").alias("name"), F.col("item").alias("audio_file"), "speaker", F.lit(None).cast("double").alias("tstart"), F.lit(None).cast("double").alias("tstop"))
    config = {"mfcc": {"num_ceps": 5, "num_bins": 6, "dither": 0.0, "vtln_low": 60.0, "vtln_high": -20.0}, "vtln": {"num_gauss": 2, "num_iters": 1, "warp_step": 0.2, "by_speaker": by_speaker, "subsample": 2}}
    rows = extract_features(spark, config, utterances, d.select(F.col("item").alias("file"), "sample_rate", "dtype", "samples")).collect()
    want = S.extract(d, S.Processor("mfcc", **config["mfcc"]), "item").count()
    assert len(rows) == want and np.isfinite([r.vec for r in rows]).all()
