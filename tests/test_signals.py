import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.functions import kernels as K
from framespark.operators import signals as S
from framespark.operators.spectral import Processor, extract, resampled


def tone(n=22713, rate=16000, f=440.0, seed=42):
    r = np.random.default_rng(seed)
    t = np.arange(n) / rate
    return np.trunc(8000 * np.sin(2 * np.pi * f * t) + 2000 * np.sin(2 * np.pi * 3 * f * t) + 50 * r.normal(size=n))


@pytest.mark.parametrize("shift,length,snip,want", [(0.01, 0.025, True, 140), (0.02, 0.025, True, 70), (0.02, 0.05, True, 69), (0.01, 0.025, False, 142)])
def test_frame_counts(shift, length, snip, want):
    o = K.FrameOptions(frame_shift=shift, frame_length=length, snip_edges=snip)
    assert len(K.cut_frames(tone(), o)) == want


def test_frames_of_small_arrays(spark):
    df = spark.createDataFrame([(1, 1, [float(i) for i in range(10)]), (2, 1, []), (3, 1, [1.0])], "signal_id int, sample_rate int, samples array<double>")
    got = {(r.signal_id, r.frame): r.x for r in S.make_frames(df, shift_s=2.0, length_s=4.0).collect()}
    assert got == {(1, i): [float(v) for v in range(2 * i, 2 * i + 4)] for i in range(4)}
    mirrored = {(r.signal_id, r.frame): r.x for r in S.make_frames(df, shift_s=2.0, length_s=4.0, snip_edges=False).collect() if r.signal_id == 1}
    assert len(mirrored) == 5 and mirrored[1, 4] == [8.0, 9.0, 8.0, 7.0]


def test_windows():
    assert [round(w, 2) for w in S.window(5, "hamming")] == [0.08, 0.54, 1.0, 0.54, 0.08]
    assert S.window(1) == [1.0] and S.window(2, "hanning") == [1.0, 1.0]
    with pytest.raises(ValueError):
        S.window(5, "other")


def test_conversion_is_held_in_range(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5, 2.0],)], "x array<double>")
    assert df.select(S.convert(F.col("x"), "float32", "int16").alias("y")).first().y == [32767, -32768, 16384, 32767]
    back = spark.createDataFrame([([32767, -32768],)], "x array<smallint>").select(S.convert(F.col("x"), "int16", "int32").alias("y")).first().y
    assert back == [32767 * 32768, -(2**30)]
    with pytest.raises(Exception, match="not enough channels"):
        df.select(S.channel(F.array("x"), 1)).collect()


def test_spectra_by_definition():
    o = K.FrameOptions(dither=0.0)
    x = tone(2000)
    f, e = K.prepare(x, o)
    assert np.allclose(e, np.log(((K.cut_frames(x, o) - K.cut_frames(x, o).mean(1, keepdims=True)) ** 2).sum(1)))
    n = np.arange(o.length)
    direct = np.array([[abs((g * np.exp(-2j * np.pi * k * n / 512)).sum()) ** 2 for k in range(257)] for g in f[:2]])
    assert np.allclose(K.power(f, o)[:2], direct)
    assert K.spectrogram(x, o).shape[1] == 257
    m, b, p = K.mfcc(x, o), K.filterbank(x, o), K.plp(x, o)
    assert m.shape[1] == 13 and b.shape[1] == 23 and p.shape[1] == 13
    assert np.allclose(m[:, 0], p[:, 0]) and np.allclose(m[:, 0], K.energy(x, o, True)[:, 0])
    h = K.mfcc(x, o, htk_compat=True)
    assert np.allclose(h[:, -1], m[:, 0]) and np.allclose(h[:, :-1], m[:, 1:])
    assert np.allclose(K.dct(23, 23) @ K.dct(23, 23).T, np.eye(23))


def test_silence_and_short():
    o = K.FrameOptions(dither=0.0)
    assert np.isfinite(K.mfcc(np.zeros(2000), o)).all() and np.isfinite(K.plp(np.zeros(2000), o, with_rasta=True)).all()
    assert K.mfcc(np.zeros(10), o).shape[0] == 0


def test_rasta_is_its_recursion():
    x = np.random.default_rng(0).normal(size=(30, 4))
    y = K.rasta(x)
    assert (y[:4] == 0).all()
    for t in range(4, 30):
        want = 0.2 * x[t] + 0.1 * x[t - 1] - 0.1 * x[t - 3] - 0.2 * x[t - 4] + 0.94 * (y[t - 1] if t > 4 else 0)
        assert np.allclose(y[t], want)


def test_levinson_solves():
    r = np.array([[3.0, 2.0, 1.0, 0.5]])
    a, e = K.levinson(r, 3)
    toeplitz = np.array([[r[0, abs(i - j)] for j in range(3)] for i in range(3)])
    assert np.allclose(toeplitz @ a[0], r[0, 1:]) and e[0] > 0


@pytest.mark.parametrize("f0", [120.0, 200.0])
def test_pitch_of_a_tone(f0):
    t = np.arange(16000) / 16000
    x = 5000 * sum(np.sin(2 * np.pi * f0 * h * t) / h for h in (1, 2, 3))
    p = K.pitch(x, K.FrameOptions(dither=0.0))
    assert abs(np.median(p[:, 1]) - f0) / f0 < 0.02 and np.median(p[:, 0]) > 0.9


def test_warp_moves_bands():
    m = K.MelOptions()
    plain, _ = K.mel_bank(m, 16000, 512)
    assert np.allclose(plain, K.mel_bank(m, 16000, 512, 1.0)[0]) and not np.allclose(plain, K.mel_bank(m, 16000, 512, 1.1)[0])


def test_resampling_keeps_a_tone():
    t = np.arange(1600) / 1600
    assert np.allclose(K.resample(np.sin(2 * np.pi * 50 * t), 800), np.sin(2 * np.pi * 50 * np.arange(800) / 800), atol=1e-9)


def test_extract(spark):
    x = tone(8000)
    df = spark.createDataFrame([("a", 16000, "int16", x.tolist()), ("b", 16000, "int16", []), ("c", 16000, "int16", None), ("d", 8000, "float32", (x / 32768).tolist())], "item string, sample_rate int, dtype string, samples array<double>")
    p = Processor("mfcc", dither=0.0)
    rows = extract(df, p, "item").orderBy("item", "frame").collect()
    assert {r.item for r in rows} == {"a", "d"}
    assert np.allclose([r.vec for r in rows if r.item == "a"], K.mfcc(x, K.FrameOptions(dither=0.0)), atol=1e-3)
    with pytest.raises(Exception, match="sample rate mismatch"):
        extract(df, p, "item", any_rate=False).collect()
    noisy = Processor("mfcc")
    assert extract(df, noisy, "item").orderBy("item", "frame").collect() == extract(df.repartition(3), noisy, "item").orderBy("item", "frame").collect()
    with pytest.raises(ValueError, match="invalid parameter"):
        Processor("mfcc", nope=1)
    assert {len(r.samples) for r in resampled(df.where("item != 'c'"), 8000, "item").collect()} == {0, 4000, 8000}


def test_networks():
    r = np.random.default_rng(0)
    w = {"first": [(r.normal(size=(144, 8)), np.zeros(8), "sigmoid")], "second": [(r.normal(size=(40, 80)), np.zeros(80), "linear")]}
    assert K.bottleneck(tone(8000), K.FrameOptions(), w).shape == (48, 80)
    assert K.voicing(np.array([0.0, 0.1, 0.9, 1.0, 0.9, 0.1, 0.0] + [0.0] * 5)).sum() >= 0


def test_lowpass():
    """A slow tone passes a wide filter as it is, a fast one doesn't; the tracker takes the filter's parameters and checks them."""
    t, u = np.arange(16000) / 16000, np.arange(4000) / 4000
    slow, fast = (K.lowpass_resample(np.sin(2 * np.pi * f * t), 16000, 4000, 1000, 12) for f in (200, 1700))
    assert np.abs(slow - np.sin(2 * np.pi * 200 * u))[100:-100].max() < 0.01 and np.abs(fast)[100:-100].max() < 0.01
    assert len(K.lowpass_resample(np.zeros(3), 16000, 4000, 1000, 1)) == 0
    x = 4000 * np.sin(2 * np.pi * 150 * t)
    p = K.pitch(x, K.FrameOptions(dither=0.0), lowpass_cutoff=1500.0, lowpass_filter_width=2, upsample_filter_width=7)
    assert abs(np.median(p[:, 1]) - 150) < 1
    with pytest.raises(ValueError, match="lowpass_cutoff"):
        K.pitch(x, K.FrameOptions(dither=0.0), lowpass_cutoff=2500.0)
    assert {"lowpass_cutoff", "lowpass_filter_width", "upsample_filter_width"} <= set(Processor("kaldi_pitch").get_params())
