"""Feature processors over signals: one signal in, its frames out, in Arrow batches and without a shuffle."""

from __future__ import annotations

import inspect
import math
from dataclasses import fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.functions import kernels as K
from framespark.operators.blocks import vectors

#: Processors that take the signal as 16-bit integers.
INTEGER = ("spectrogram", "filterbank", "mfcc", "plp", "kaldi_pitch", "bottleneck")


class Processor:
    """A named kernel with its parameters, checked by name."""

    def __init__(self, name: str, **params):
        if name not in K.KERNELS:
            raise ValueError(f'invalid features "{name}", must be in {sorted(K.KERNELS)}')
        self.name, self.params = name, {}
        self.set_params(**params)

    def defaults(self) -> dict:
        out = {f.name: f.default for f in fields(K.FrameOptions)}
        if self.name == "bottleneck":
            out["dither"] = 0.1
        signature = inspect.signature(K.KERNELS[self.name]).parameters
        if "m" in signature:
            out |= {f.name: f.default for f in fields(K.MelOptions)}
        return out | {n: p.default for n, p in signature.items() if n not in ("x", "o", "m", "factor", "seed", "spectrum", "_") and p.kind is not p.VAR_KEYWORD}

    def get_params(self) -> dict:
        return self.defaults() | self.params

    def set_params(self, **params) -> Processor:
        known = self.defaults()
        for n in params:
            if n not in known:
                raise ValueError(f"invalid parameter {n} for processor {self.name}")
        self.params |= params
        return self

    def kernel(self, x: np.ndarray | None, rate: int, dtype: str | None, warp: float = 1.0, seed: int = 0, spectrum: tuple | None = None) -> np.ndarray:
        """Frames of ``x``, or of the ``spectrum`` that ``spectra`` made of it."""
        own = self.get_params()
        o = K.FrameOptions(**{f.name: own.pop(f.name) for f in fields(K.FrameOptions)})
        o = replace(o, sample_rate=rate)
        signature = inspect.signature(K.KERNELS[self.name]).parameters
        if "m" in signature:
            own["m"] = K.MelOptions(**{f.name: own.pop(f.name) for f in fields(K.MelOptions)})
            own["factor"] = warp
        if "seed" in signature:
            own["seed"] = seed
        if spectrum is not None:
            return K.KERNELS[self.name](None, o, spectrum=spectrum, **own)
        y = K.as_int16(x, dtype) if self.name in INTEGER else np.asarray(x, np.float64)
        return K.KERNELS[self.name](y, o, **own)

    def spectra(self, x: np.ndarray, rate: int, dtype: str | None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(power, log energy) of the frames of ``x``, the same for all warps."""
        own = self.get_params()
        o = replace(K.FrameOptions(**{f.name: own[f.name] for f in fields(K.FrameOptions)}), sample_rate=rate)
        return K.spectra(K.as_int16(x, dtype) if self.name in INTEGER else np.asarray(x, np.float64), o, seed, own["raw_energy"])


def extract(signals: DataFrame, processor: Processor, key: str = "signal_id", warp: str | None = None, any_rate: bool = True, precision: str = "float") -> DataFrame:
    """``key, frame, t0, t1, vec`` (of ``precision``) of every signal with samples; ``warp`` names a column with its warp factor.

    Dither is drawn with a seed from the signal's key, so a lost task gives the same again. With ``any_rate`` false another rate than
    the processor's is an error.
    """
    rate = processor.get_params()["sample_rate"]
    d = signals.where("samples is not null and size(samples) > 0")
    if not any_rate:
        wrong = F.raise_error(F.concat(F.lit("sample rate mismatch: "), F.col("sample_rate").cast("string"), F.lit(f", expected {rate}"))).cast("int")
        d = d.withColumn("sample_rate", F.when(F.col("sample_rate") == rate, F.col("sample_rate")).otherwise(wrong))
    kind = d.schema[key].dataType.simpleString()
    d = d.select(key, F.xxhash64(key).alias("_s"), "sample_rate", "dtype", F.col("samples").cast("array<double>").alias("_x"), (F.col(warp) if warp else F.lit(1.0)).cast("double").alias("_w"))
    shift, length = processor.get_params()["frame_shift"], processor.get_params()["frame_length"]

    def run(batches):
        for b in batches:
            lists = b.column(4)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            seeds, rates, kinds, warps = (b.column(i).to_pylist() for i in (1, 2, 3, 5))
            for i in range(b.num_rows):
                v = processor.kernel(flat[at[i] : at[i + 1]], rates[i], kinds[i], warps[i], seeds[i] & 0x7FFFFFFF)
                n = len(v)
                if n:
                    t0 = np.arange(n) * shift
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(np.full(n, i))), pa.array(np.arange(n, dtype=np.int32)), pa.array(t0), pa.array(t0 + length), vectors(v, "float32" if precision == "float" else "float64")], [key, "frame", "t0", "t1", "vec"],
                    )

    return d.mapInArrow(run, f"`{key}` {kind}, frame int, t0 double, t1 double, vec array<{precision}>")


def packed(signals: DataFrame, processor: Processor, key: str = "signal_id", keep: tuple[str, ...] = (), every: int = 1, factors: tuple[float, ...] = ()) -> DataFrame:
    """``key, *keep, n, thin, rest, sums`` in one pass: a row per signal with its ``n`` frames as float32 bytes, those whose number ``every`` divides in ``thin`` and the others in ``rest``.

    Each task adds a row with ``sums`` alone (float64 bytes): over the thin frames, with x the frame and 1 and y the frame under each warp of ``factors``,
    the sums of x x' and of x y', side by side. The spectrum of a frame is made once for all warps.
    """
    d = signals.where("samples is not null and size(samples) > 0")
    kinds = {c: d.schema[c].dataType.simpleString() for c in (key, *keep)}
    d = d.select(*kinds, F.xxhash64(key).alias("_s"), "sample_rate", "dtype", F.col("samples").cast("array<double>").alias("_x"))
    k, alone = len(kinds), not processor.get_params().get("with_rasta")  # RASTA filtering goes over the frames in turn

    def equations(x, ys):
        x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
        return x.T @ np.hstack([x, *(y.astype(np.float32).astype(np.float64) for y in ys)])

    def run(batches):
        total, schema = 0.0, None
        for b in batches:
            lists = b.column(k + 3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            seeds, rates, types = (b.column(k + i).to_pylist() for i in range(3))
            rows, sizes, thin, rest, stacks = [], [], [], [], {}
            for i in range(b.num_rows):
                spectrum = processor.spectra(flat[at[i] : at[i + 1]], rates[i], types[i], seeds[i] & 0x7FFFFFFF)
                n = len(spectrum[0])
                if not n:
                    continue
                v = processor.kernel(None, rates[i], None, spectrum=spectrum).astype(np.float32)
                rows.append(i), sizes.append(n)
                thin.append(v[::every].tobytes()), rest.append(v[np.arange(n) % every > 0].tobytes())
                if alone:
                    stacks.setdefault(rates[i], []).append((v[::every], *(s[::every] for s in spectrum)))
                elif factors:
                    total = total + equations(v[::every], (processor.kernel(None, rates[i], None, f, spectrum=spectrum)[::every] for f in factors))
            for rate, parts in stacks.items() if factors else ():
                v, p, e = (np.concatenate(s) for s in zip(*parts))
                for a in range(0, len(v), 4096):
                    total = total + equations(v[a : a + 4096], (processor.kernel(None, rate, None, f, spectrum=(p[a : a + 4096], e[a : a + 4096])) for f in factors))
            out = pa.RecordBatch.from_arrays(
                [*(b.column(i).take(pa.array(rows, pa.int32())) for i in range(k)), pa.array(sizes, pa.int32()), pa.array(thin, pa.binary()), pa.array(rest, pa.binary()), pa.nulls(len(rows), pa.binary())], [*kinds, "n", "thin", "rest", "sums"],
            )
            schema = out.schema
            yield out
        if np.ndim(total):
            yield pa.RecordBatch.from_pylist([{"sums": np.ascontiguousarray(total).tobytes()}], schema)

    return d.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", n int, thin binary, rest binary, sums binary")


def resampled(signals: DataFrame, rate: int, key: str = "signal_id") -> DataFrame:
    """``key, sample_rate, dtype, samples`` at another rate, by Fourier series, as many as ``int(n * rate / old)``; integers are cut towards zero."""
    kind = signals.schema[key].dataType.simpleString()
    d = signals.where("samples is not null").select(key, "sample_rate", "dtype", F.col("samples").cast("array<double>").alias("samples"))

    def run(batches):
        for b in batches:
            out = []
            for x, r, t in zip(b.column(3), b.column(1).to_pylist(), b.column(2).to_pylist()):
                y = np.asarray(x.values)
                y = y if r == rate else K.resample(y, int(len(y) * rate / r))
                out.append(np.trunc(y) if (t or "").startswith("int") else y)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rate] * b.num_rows, pa.int32()), b.column(2), pa.array(out, pa.list_(pa.float64()))], [key, "sample_rate", "dtype", "samples"])

    return d.mapInArrow(run, f"`{key}` {kind}, sample_rate int, dtype string, samples array<double>")


def pitch_post(pitch: DataFrame, pitch_scale: float = 2.0, pov_scale: float = 2.0, pov_offset: float = 0.0, delta_pitch_scale: float = 10.0, left: int = 75, right: int = 75, delta_window: int = 2, delay: int = 0,
               add_pov: bool = True, add_normalized: bool = True, add_delta: bool = True, add_raw: bool = False, delta_noise: float = 0.0) -> DataFrame:
    """``item, frame, vec`` of ``item, frame, vec = [nccf, pitch]``: voicing, log pitch less its weighted mean around, its derivative, log pitch; those asked for, in this order."""
    from framespark.functions.scalars import pov_of_nccf, probability_of_nccf
    from framespark.operators.blocks import windowed
    from framespark.operators.frames import delta_taps

    if not (add_pov or add_normalized or add_delta or add_raw):
        raise ValueError("at least one of add_pov, add_normalized, add_delta and add_raw must be true")
    nccf, p = F.get("vec", F.lit(0)).cast("double"), F.get("vec", F.lit(1)).cast("double")
    noise = F.lit(0.0)
    if delta_noise:  # normal, drawn by item and frame, so a task run again draws the same
        u = [(F.pmod(F.xxhash64("item", "frame", F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in (1, 2)]
        noise = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1]) * delta_noise
    d = pitch.withColumns({"_pov": pov_of_nccf(nccf) * pov_scale / 2 + pov_offset, "_w": probability_of_nccf(nccf), "_log": F.log(F.greatest(p, F.lit(1e-10)))})
    cols = [c for c, on in (("_pov", add_pov), ("_norm", add_normalized), ("_delta", add_delta), ("_log", add_raw)) if on]

    def build(d, w):
        near, whole = w.rowsBetween(-left, right), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        total, first, last = F.lit(0.0), F.first("_log").over(whole), F.last("_log").over(whole)
        for k, c in zip(range(-delta_window, delta_window + 1), delta_taps(1, delta_window)[1]):
            if c:
                total = total + F.lit(c) * (F.coalesce(F.lag("_log", -k).over(w), first) if k < 0 else F.coalesce(F.lead("_log", k).over(w), last))
        d = d.withColumns({"_norm": (F.col("_log") - F.sum(F.col("_w") * F.col("_log")).over(near) / F.sum("_w").over(near)) * pitch_scale, "_delta": total * delta_pitch_scale + noise})
        vec = F.array(*(F.coalesce(F.lag(c, delay).over(w), F.first(c).over(whole)) if delay else F.col(c) for c in cols))
        return d.withColumn("_out", vec)

    reach = max(left, right, delta_window) + abs(delay)
    return windowed(d, max(reach, 1), build).select("item", "frame", F.col("_out").alias("vec"))


def crepe_post(pitch: DataFrame, pitch_scale: float = 2.0, delta_pitch_scale: float = 10.0, **more) -> DataFrame:
    """``item, frame, vec`` of ``vec = [voicing, pitch]``: pitch on the line between voiced neighbours, voicing as a cross-correlation, then ``pitch_post``.

    Whether a frame is voiced is a path through two states over the whole item; an item without voiced frames is an error.
    """
    from framespark.operators.blocks import groups, matrix

    kind = pitch.schema["item"].dataType.simpleString()
    grid = np.linspace(0.0, 1.0, 4097)
    curve = -5.2 + 5.4 * np.exp(7.5 * (grid - 1)) + 4.8 * grid - 2 * np.exp(-10 * grid) + 4.2 * np.exp(20 * (grid - 1))
    curve = 1 / (1 + np.exp(-curve))

    def run(batches):
        for t in groups(batches, ("item",)):
            x, frame = matrix(t.column("vec")), t.column("frame").to_numpy()
            voiced = K.voicing(x[:, 0])
            if not voiced.any():
                raise ValueError(f"no voiced frames: {t.column('item')[0].as_py()}")
            hz = np.interp(frame, frame[voiced], x[voiced, 1])
            if not (hz > 0).all():
                raise ValueError(f"pitch that is not positive: {t.column('item')[0].as_py()}")
            nccf = np.interp(x[:, 0], curve, grid)  # the curve rises, so its inverse is an interpolation
            yield pa.RecordBatch.from_arrays([t.column("item").combine_chunks(), t.column("frame").combine_chunks(), vectors(np.stack([nccf, hz], axis=1))], ["item", "frame", "vec"])

    d = pitch.select("item", "frame", F.col("vec").cast("array<double>")).repartition("item").sortWithinPartitions("item", "frame")
    return pitch_post(d.mapInArrow(run, f"item {kind}, frame int, vec array<double>"), pitch_scale=pitch_scale, delta_pitch_scale=delta_pitch_scale, **more)
