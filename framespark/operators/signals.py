"""Signal level: frames, windows, levels, segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT_S, LENGTH_S = 0.01, 0.025
WINDOWS = ("hamming", "hanning", "povey", "rectangular", "blackman")
#: Factors between sample types.
SCALES = {
    ("int16", "int32"): 2.0**15, ("int16", "float32"): 2.0**-15, ("int16", "float64"): 2.0**-15,
    ("int32", "int16"): 2.0**-15, ("int32", "float32"): 2.0**-30, ("int32", "float64"): 2.0**-30,
    ("float32", "int16"): 2.0**15, ("float64", "int16"): 2.0**15, ("float32", "int32"): 2.0**30, ("float64", "int32"): 2.0**30,
}
RANGES = {"int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1)}


def samples_of(seconds: float, rate: Column) -> Column:
    return F.floor(rate * F.lit(seconds) + 1e-9).cast("int")


def nframes(n: Column, length: Column, shift: Column, snip_edges: bool = True) -> Column:
    """Number of frames of ``n`` samples; without snipping, frames are as many as shifts, rounded."""
    if snip_edges:
        return F.when(n < length, F.lit(0)).otherwise(F.lit(1) + F.floor((n - length) / shift)).cast("int")
    return F.floor((n + F.floor(shift / 2)) / shift).cast("int")


def frame_index(signals: DataFrame, key: str = "signal_id", shift_s: float = SHIFT_S, length_s: float = LENGTH_S, snip_edges: bool = True) -> DataFrame:
    """``key, frame, first, last, t0, t1``: samples ``first`` to ``last`` (exclusive) of each frame, and its times. The samples are not read beyond their number."""
    rate = F.col("sample_rate")
    s, n = samples_of(shift_s, rate), samples_of(length_s, rate)
    d = signals.select(key, s.alias("_s"), n.alias("_l"), nframes(F.size("samples"), n, s, snip_edges).alias("_n"))
    d = d.where("_n > 0 and _s > 0").withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.select(key, "frame", (F.col("frame") * F.col("_s")).alias("first"), (F.col("frame") * F.col("_s") + F.col("_l")).alias("last"), (F.col("frame") * shift_s).alias("t0"), (F.col("frame") * shift_s + length_s).alias("t1"))


def make_frames(signals: DataFrame, key: str = "signal_id", shift_s: float = SHIFT_S, length_s: float = LENGTH_S, snip_edges: bool = True) -> DataFrame:
    """``key, frame, x``: the samples of each frame. Without snipping, the end is continued by its mirror image (the last sample not repeated)."""
    rate = F.col("sample_rate")
    s, n = samples_of(shift_s, rate), samples_of(length_s, rate)
    x = F.col("samples").cast("array<double>")
    if not snip_edges:
        size = F.size(x)
        back = F.reverse(F.slice(x, F.greatest(size - F.least(n + s, size - 1), F.lit(1)), F.least(n + s, size - 1)))
        x = F.when(size > 1, F.concat(x, back)).otherwise(x)
    d = signals.select(key, s.alias("_s"), n.alias("_l"), nframes(F.size("samples"), n, s, snip_edges).alias("_n"), x.alias("_x"))
    d = d.where("_n > 0 and _s > 0").withColumn("_all", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.slice("_x", i * F.col("_s") + 1, F.col("_l"))))
    return d.select(key, F.posexplode("_all").alias("frame", "x"))


def window(length: int, kind: str = "povey", blackman_coeff: float = 0.42) -> list[float]:
    """The taper of ``length`` points by name."""
    if kind not in WINDOWS:
        raise ValueError(f'window type must be in {list(WINDOWS)}, it is "{kind}"')
    if length <= 0:
        raise ValueError("length must be strictly positive")
    if length == 1:
        return [1.0]
    out = []
    for i in range(length):
        a = 2 * math.pi * i / (length - 1)
        if kind == "rectangular":
            w = 1.0
        elif kind == "hamming":
            w = 0.54 - 0.46 * math.cos(a)
        elif kind == "hanning":
            w = 0.5 - 0.5 * math.cos(a)
        elif kind == "povey":
            w = (0.5 - 0.5 * math.cos(a)) ** 0.85
        else:
            w = blackman_coeff - 0.5 * math.cos(a) + (0.5 - blackman_coeff) * math.cos(2 * a)
        out.append(w)
    if length == 2 and kind in ("povey", "blackman", "hanning"):
        return [1.0, 1.0]
    return out


def window_table(spark, length: int, kind: str, blackman_coeff: float = 0.42) -> DataFrame:
    return spark.createDataFrame(list(enumerate(window(length, kind, blackman_coeff))), "i int, w double")


def frame_energy(frames: DataFrame, compression: str = "log", x: str = "x") -> DataFrame:
    """Adds ``energy``: the sum of squares, as it is, or its logarithm or root; floored at the least normal double before these."""
    if compression not in ("off", "log", "sqrt"):
        raise ValueError(f"compression must be off, log or sqrt, it is {compression}")
    e = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    if compression != "off":
        e = F.greatest(e, F.lit(2.2250738585072014e-308))
    return frames.withColumn("energy", {"off": lambda v: v, "log": F.log, "sqrt": F.sqrt}[compression](e))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not once for each element of a lambda inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_mean(x: Column) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
    return F.when(F.size(x) > 0, let(mean, lambda m: F.transform(x, lambda v: v - m))).otherwise(x)


def preemphasis(x: Column, coeff: float = 0.97) -> Column:
    """``x[i] - c x[i-1]``, and ``x[0] - c x[0]`` for the first."""
    return F.transform(x, lambda v, i: v - coeff * F.get(x, F.greatest(i - 1, F.lit(0))))


def convert(x: Column, source: str, target: str) -> Column:
    """Samples of one type as another: scaled, cut towards zero, and held in range (a cast would wrap)."""
    scaled = F.transform(x, lambda v: v.cast("double") * SCALES.get((source, target), 1.0))
    if target in RANGES:
        low, high = RANGES[target]
        kind = "array<smallint>" if target == "int16" else "array<int>"
        return F.transform(scaled, lambda v: F.greatest(F.least(v, F.lit(float(high))), F.lit(float(low)))).cast(kind)
    return scaled.cast("array<float>" if target == "float32" else "array<double>")


def channel(channels: Column, index: int) -> Column:
    """One channel of an array of channels; an error beyond the last."""
    return F.when(F.size(channels) > index, F.get(channels, F.lit(index))).otherwise(F.raise_error(F.concat(F.lit(f"not enough channels: {index} asked for, "), F.size(channels).cast("string"), F.lit(" there"))))


def segment(x: Column, rate: Column, start: Column, stop: Column) -> Column:
    """Samples from ``start`` to ``stop`` seconds, places cut towards zero, half open, clamped at the end; null bounds are the signal's own."""
    a = F.coalesce(F.floor(start * rate + 1e-9).cast("int"), F.lit(0))
    b = F.least(F.coalesce(F.floor(stop * rate + 1e-9).cast("int"), F.size(x)), F.size(x))
    return F.slice(x, F.least(a, F.size(x)) + 1, F.greatest(b - a, F.lit(0)))


def valid_samples(x: Column, dtype: Column) -> Column:
    """Whether all samples are in their type's range: the integers' own, and -1 to 1 for the others."""
    low = F.when(dtype == "int16", -32768.0).when(dtype == "int32", -2147483648.0).otherwise(-1.0)
    high = F.when(dtype == "int16", 32767.0).when(dtype == "int32", 2147483647.0).otherwise(1.0)
    return (F.array_min(x) >= low) & (F.array_max(x) <= high)


def mix(signal: Column, noise: Column, snr_db: float) -> Column:
    """Signal plus noise scaled to a signal-to-noise ratio; the longer is cut."""
    n = F.least(F.size(signal), F.size(noise))
    power = lambda x: F.aggregate(F.slice(x, 1, n), F.lit(0.0), lambda a, v: a + v * v)
    g = F.sqrt(power(signal) / power(noise) / F.lit(10 ** (snr_db / 10)))
    return let(g, lambda k: F.transform(F.slice(signal, 1, n), lambda v, i: v + k * F.get(noise, i)))
