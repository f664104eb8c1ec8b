"""Queries at signal level."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.operators import signals as S
from framespark.plans.registry import Registry
from framespark.sources import views
from framespark.sources.views import META, SIG, UTT

R = Registry()
_LS = "CAST(trunc(sample_rate * 0.025 + 1e-9) AS INT) AS l, CAST(trunc(sample_rate * 0.01 + 1e-9) AS INT) AS s"
_N = f"n AS (SELECT signal_id, samples, len(samples) AS n, {_LS} FROM sig), c AS (SELECT *, CASE WHEN n < l THEN 0 ELSE 1 + (n - l) // s END AS k, (n + s // 2) // s AS m FROM n)"
_WITH = f"WITH {SIG}, {_N}"


@R.query(_WITH + " SELECT signal_id, CAST(k AS INT) AS n_snip, CAST(m AS INT) AS n_full FROM c")
def frame_counts(spark, d):
    rate = F.col("sample_rate")
    s, n = S.samples_of(0.01, rate), S.samples_of(0.025, rate)
    return views.signals(spark, d).select("signal_id", S.nframes(F.size("samples"), n, s).alias("n_snip"), S.nframes(F.size("samples"), n, s, False).alias("n_full"))


_INDEX = _WITH + ", f AS (SELECT signal_id, l, s, unnest(range(0, k)) AS frame FROM c) SELECT signal_id, CAST(frame AS INT) AS frame, "


@R.query(_INDEX + "CAST(frame * s AS INT) AS first, CAST(frame * s + l AS INT) AS last FROM f")
def frame_boundaries(spark, d):
    return S.frame_index(views.signals(spark, d)).select("signal_id", "frame", "first", "last")


@R.query(_INDEX + "round(frame * 0.01::DOUBLE, 6) AS t0, round(frame * 0.01::DOUBLE + 0.025::DOUBLE, 6) AS t1 FROM f")
def frame_times(spark, d):
    return S.frame_index(views.signals(spark, d)).select("signal_id", "frame", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


_FRAMES = _WITH + ", x AS (SELECT signal_id, CAST(i AS INT) AS frame, samples[i * s + 1 : i * s + l] AS x FROM (SELECT *, unnest(range(0, k)) AS i FROM c))"


@R.query(_FRAMES + " SELECT signal_id, frame, list_transform(x, lambda v: round(v, 6)) AS x FROM x")
def make_frames_snip(spark, d):
    return S.make_frames(views.signals(spark, d)).select("signal_id", "frame", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


_MIRROR = (
    f"WITH {SIG}, n AS (SELECT signal_id, CASE WHEN len(samples) > 1 THEN list_concat(samples, list_reverse(samples[greatest(len(samples) - least(l + s, len(samples) - 1), 1) : len(samples) - 1])) ELSE samples END AS y, (len(samples) + s // 2) // s AS m, l, s"
    f" FROM (SELECT *, {_LS} FROM sig)), x AS (SELECT signal_id, CAST(i AS INT) AS frame, y[i * s + 1 : i * s + l] AS x FROM (SELECT *, unnest(range(0, m)) AS i FROM n))"
)


@R.query(_MIRROR + " SELECT signal_id, frame, list_transform(x, lambda v: round(v, 6)) AS x FROM x")
def make_frames_mirror(spark, d):
    return S.make_frames(views.signals(spark, d), snip_edges=False).select("signal_id", "frame", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


def _window(kind: str, sql: str) -> None:
    @R.query(f"SELECT CAST(i AS INT) AS i, round({sql}, 6) AS w FROM (SELECT i, 2 * pi() * i / 399 AS a FROM range(0, 400) t(i))", f"window_{kind}")
    def build(spark, d):
        return S.window_table(spark, 400, kind).select("i", F.round("w", 6).alias("w"))


for _kind, _sql in {"povey": "pow(0.5 - 0.5 * cos(a), 0.85)", "hanning": "0.5 - 0.5 * cos(a)", "hamming": "0.54 - 0.46 * cos(a)", "blackman": "0.42 - 0.5 * cos(a) + 0.08 * cos(2 * a) + 0.0", "rectangular": "1.0::DOUBLE"}.items():
    _window(_kind, _sql)


def _energy(kind: str, sql: str) -> None:
    @R.query(_FRAMES + f", e AS (SELECT signal_id, frame, list_sum(list_transform(x, lambda v: v * v)) AS e FROM x) SELECT signal_id, frame, round({sql}, 4) AS energy FROM e", f"frame_energy_{kind}")
    def build(spark, d):
        return S.frame_energy(S.make_frames(views.signals(spark, d)), kind).select("signal_id", "frame", F.round("energy", 4).alias("energy"))


for _kind, _sql in {"log": "ln(greatest(e, 2.2250738585072014e-308))", "sqrt": "sqrt(greatest(e, 2.2250738585072014e-308))", "off": "e"}.items():
    _energy(_kind, _sql)


@R.query(f"WITH {SIG} SELECT signal_id, list_transform(samples, lambda v: round(-v, 6) + 0.0) AS right_channel FROM sig")
def channel_select(spark, d):
    """The second of two channels, of signals made stereo by a channel of opposite phase."""
    both = views.signals(spark, d).withColumn("channels", F.array("samples", F.transform("samples", lambda v: -v)))
    return both.select("signal_id", F.transform(S.channel(F.col("channels"), 1), lambda v: F.round(v, 6) + 0.0).alias("right_channel"))


@R.query(f"WITH {SIG} SELECT signal_id, CASE WHEN dtype = 'int16' THEN list_transform(samples, lambda v: CAST(v / 32768.0 AS DOUBLE)) ELSE list_transform(samples, lambda v: CAST(trunc(greatest(least(v * 32768.0, 32767.0), -32768.0)) AS DOUBLE)) END AS y FROM sig")
def cast_scale(spark, d):
    """int16 as float32 and float32 as int16, shown as DOUBLE."""
    x = F.col("samples")
    y = F.when(F.col("dtype") == "int16", S.convert(x, "int16", "float32").cast("array<double>")).otherwise(S.convert(x, "float32", "int16").cast("array<double>"))
    return views.signals(spark, d).select("signal_id", y.alias("y"))


@R.query(f"WITH {SIG} SELECT signal_id, samples[CAST(trunc(0.5 * sample_rate + 1e-9) AS INT) + 1 : least(CAST(trunc(1.25 * sample_rate + 1e-9) AS INT), len(samples))] AS x FROM sig")
def segment_slice(spark, d):
    return views.signals(spark, d).select("signal_id", S.segment(F.col("samples"), F.col("sample_rate"), F.lit(0.5), F.lit(1.25)).alias("x"))


@R.query(_FRAMES + " SELECT signal_id, frame, list_transform(x, lambda v: round(v - list_sum(x) / len(x), 4) + 0.0) AS x FROM x")
def dc_removal(spark, d):
    return S.make_frames(views.signals(spark, d)).select("signal_id", "frame", F.transform(S.without_mean(F.col("x")), lambda v: F.round(v, 4) + 0.0).alias("x"))


@R.query(_FRAMES + " SELECT signal_id, frame, list_transform(range(1, len(x) + 1), lambda i: round(x[i] - 0.97::DOUBLE * x[greatest(i - 1, 1)] + 1e-9::DOUBLE, 7) + 0.0) AS x FROM x")
def preemphasis(spark, d):
    return S.make_frames(views.signals(spark, d)).select("signal_id", "frame", F.transform(S.preemphasis(F.col("x")), lambda v: F.round(v + 1e-9, 7) + 0.0).alias("x"))


@R.query(f"WITH {SIG} SELECT signal_id, CASE WHEN dtype = 'int16' THEN list_min(samples) >= -32768 AND list_max(samples) <= 32767 ELSE list_min(samples) >= -1 AND list_max(samples) <= 1 END AS valid, len(samples) / sample_rate AS duration, CAST(CASE WHEN dtype = 'int16' THEN 16 ELSE 32 END AS INT) AS precision_bits FROM sig")
def audio_valid(spark, d):
    bits = F.when(F.col("dtype") == "int16", 16).otherwise(32)
    return views.signals(spark, d).select("signal_id", S.valid_samples(F.col("samples"), F.col("dtype")).alias("valid"), (F.size("samples") / F.col("sample_rate")).alias("duration"), bits.alias("precision_bits"))


@R.query(f"WITH {META} SELECT file, nchannels, sample_rate, nsamples, duration FROM meta")
def audio_scan(spark, d):
    return views.audio_meta(spark, d)


@R.query(f"WITH {META}, {UTT} SELECT utt_id, name, audio_file, tstart, CASE WHEN tstop IS NOT NULL THEN least(tstop, m.duration) END AS tstop, CASE WHEN tstart IS NULL THEN m.duration ELSE least(tstop, m.duration) - tstart END AS duration FROM utt JOIN meta m ON audio_file = m.file WHERE tstart IS NULL OR (tstart >= 0 AND tstart < least(tstop, m.duration))")
def utterance_bounds(spark, d):
    """Utterances with their file's end as the limit; those whose times are no interval within it are left out."""
    meta = views.audio_meta(spark, d).select(F.col("file").alias("audio_file"), F.col("duration").alias("whole"))
    u = views.utterances(spark, d).join(meta, "audio_file").withColumn("tstop", F.when(F.col("tstop").isNotNull(), F.least("tstop", "whole")))
    u = u.where("tstart is null or (tstart >= 0 and tstart < tstop)")
    return u.select("utt_id", "name", "audio_file", "tstart", "tstop", F.when(F.col("tstart").isNull(), F.col("whole")).otherwise(F.col("tstop") - F.col("tstart")).alias("duration"))


@R.query(f"WITH {SIG}, p AS (SELECT a.signal_id, a.samples AS x, b.samples AS y, least(len(a.samples), len(b.samples)) AS n FROM sig a JOIN sig b ON b.signal_id = a.signal_id + 1), g AS (SELECT *, sqrt(list_sum(list_transform(x[1:n], lambda v: v * v)) / list_sum(list_transform(y[1:n], lambda v: v * v)) / 10) AS g FROM p) SELECT signal_id, list_transform(range(1, n + 1), lambda i: round(x[i] + g * y[i], 3) + 0.0) AS mixed FROM g")
def snr_mix(spark, d):
    """Each signal with the next as noise, at 10 dB."""
    s = views.signals(spark, d).select("signal_id", "samples")
    noise = s.select((F.col("signal_id") - 1).alias("signal_id"), F.col("samples").alias("noise"))
    return s.join(noise, "signal_id").select("signal_id", F.transform(S.mix(F.col("samples"), F.col("noise"), 10.0), lambda v: F.round(v, 3) + 0.0).alias("mixed"))


@R.query("SELECT audio_id, round(1127 * ln(1 + sample_rate / 2 / 700), 6) AS mel, round((exp(1127 * ln(1 + sample_rate / 2 / 700) / 1127) - 1) * 700, 4) AS hz FROM audio_meta")
def mel_scale(spark, d):
    from framespark.functions.scalars import hz_of_mel, mel_of_hz
    from framespark.sources.tables import table

    m = mel_of_hz(F.col("sample_rate") / 2)
    return table(spark, d, "audio_meta").select("audio_id", F.round(m, 6).alias("mel"), F.round(hz_of_mel(m), 4).alias("hz"))


QUERIES, ORACLE = R.queries, R.sql
