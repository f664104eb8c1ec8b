"""Numeric kernels over whole signals: frames to spectra, cepstra, energies and pitch. NumPy only; no Spark here.

Formulas are those of the public descriptions of the methods (mel cepstra, perceptual linear prediction,
RASTA filtering, pitch by normalised cross-correlation); no parity to the last digit with any other program is claimed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

from framespark.operators.signals import window

EPS = float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class FrameOptions:
    sample_rate: int = 16000
    frame_shift: float = 0.01
    frame_length: float = 0.025
    dither: float = 1.0
    preemph_coeff: float = 0.97
    remove_dc_offset: bool = True
    window_type: str = "povey"
    round_to_power_of_two: bool = True
    blackman_coeff: float = 0.42
    snip_edges: bool = True

    @property
    def shift(self) -> int:
        return int(self.sample_rate * self.frame_shift + 1e-9)

    @property
    def length(self) -> int:
        return int(self.sample_rate * self.frame_length + 1e-9)

    @property
    def padded(self) -> int:
        return 1 << (self.length - 1).bit_length() if self.round_to_power_of_two else self.length


@dataclass(frozen=True)
class MelOptions:
    num_bins: int = 23
    low_freq: float = 20.0
    high_freq: float = 0.0
    vtln_low: float = 100.0
    vtln_high: float = -500.0


def cut_frames(x: np.ndarray, o: FrameOptions) -> np.ndarray:
    """[frames, length]; without snipping frames are centred and the signal is mirrored at both ends (-1 is 0, n is n - 1)."""
    n, length, shift = len(x), o.length, o.shift
    if shift < 1 or length < 2:
        raise ValueError("frames of no samples: frame_shift or frame_length is too small for the sample rate")
    if o.snip_edges:
        if n < length:
            return np.zeros((0, length))
        return np.lib.stride_tricks.sliding_window_view(x, length)[::shift].astype(np.float64)
    count = (n + shift // 2) // shift
    if not count or not n:
        return np.zeros((0, length))
    at = np.arange(count)[:, None] * shift + shift // 2 - length // 2 + np.arange(length)[None, :]
    at = np.mod(at, 2 * n)
    return x[np.where(at >= n, 2 * n - 1 - at, at)].astype(np.float64)


def prepare(x: np.ndarray, o: FrameOptions, seed: int = 0, raw: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(windowed frames, log energy of each): dither, mean off, energy (if raw), pre-emphasis, window, energy (if not raw)."""
    f = cut_frames(np.asarray(x, np.float64), o)
    if o.dither:
        f = f + o.dither * np.random.default_rng(seed).standard_normal(f.shape)
    if o.remove_dc_offset:
        f = f - f.mean(axis=1, keepdims=True) if len(f) else f
    energy = lambda v: np.log(np.maximum((v * v).sum(axis=1), EPS))
    e = energy(f)
    if o.preemph_coeff:
        f = f - o.preemph_coeff * np.concatenate([f[:, :1], f[:, :-1]], axis=1)
    f = f * np.array(window(o.length, o.window_type, o.blackman_coeff))
    return f, e if raw else energy(f)


def power(f: np.ndarray, o: FrameOptions) -> np.ndarray:
    return np.abs(np.fft.rfft(f, o.padded, axis=1)) ** 2


def spectra(x: np.ndarray, o: FrameOptions, seed: int = 0, raw: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(power, log energy) of each frame: what the kernels with mel bands start from, whatever the warp."""
    f, e = prepare(x, o, seed, raw)
    return power(f, o), e


def mel(f):
    return 1127.0 * np.log1p(np.asarray(f, np.float64) / 700.0)


def hz(m):
    return 700.0 * np.expm1(np.asarray(m, np.float64) / 1127.0)


def warp(f: np.ndarray, factor: float, low: float, high: float, vtln_low: float, vtln_high: float) -> np.ndarray:
    """Frequencies under a piecewise linear warp: slope 1/factor in the middle, joined to the unwarped ends."""
    if factor == 1.0:
        return f
    left, right, slope = vtln_low * max(1.0, factor), vtln_high * min(1.0, factor), 1.0 / factor
    return np.where(
        (f < low) | (f > high), f,
        np.where(f < left, low + (slope * left - low) / (left - low) * (f - low), np.where(f < right, slope * f, high + (high - slope * right) / (high - right) * (f - high))),
    )


@lru_cache(maxsize=256)
def mel_bank(m: MelOptions, rate: int, padded: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(triangular weights [bins, padded/2], centre frequencies)."""
    nyquist = rate / 2
    high = m.high_freq if m.high_freq > 0 else nyquist + m.high_freq
    if m.num_bins < 3:
        raise ValueError("must have at least 3 mel bins")
    if not 0 <= m.low_freq < high <= nyquist:
        raise ValueError(f"bad frequencies: low {m.low_freq}, high {high}, nyquist {nyquist}")
    upper = m.vtln_high if m.vtln_high > 0 else nyquist + m.vtln_high
    points = np.linspace(mel(m.low_freq), mel(high), m.num_bins + 2)
    if factor != 1.0:
        points = mel(warp(hz(points), factor, m.low_freq, high, m.vtln_low, upper))
    bins = mel(np.arange(padded // 2) * rate / padded)
    a, b, c = points[:-2, None], points[1:-1, None], points[2:, None]
    w = np.where((bins > a) & (bins < c), np.where(bins <= b, (bins - a) / (b - a), (c - bins) / (c - b)), 0.0)
    return w, hz(points[1:-1])


def as_int16(x: np.ndarray, dtype: str | None) -> np.ndarray:
    if dtype == "int16":
        return np.asarray(x, np.float64)
    if dtype == "int32":
        return np.trunc(np.asarray(x, np.float64) * 2.0**-15)
    return np.clip(np.trunc(np.asarray(x, np.float64) * 2.0**15), -32768, 32767)


def spectrogram(x, o: FrameOptions, energy_floor: float = 0.0, raw_energy: bool = True, seed: int = 0, **_) -> np.ndarray:
    f, e = prepare(x, o, seed, raw_energy)
    out = np.log(np.maximum(power(f, o), EPS))
    out[:, 0] = np.maximum(e, np.log(energy_floor)) if energy_floor > 0 else e
    return out


def filterbank(x, o: FrameOptions, m: MelOptions = MelOptions(), factor: float = 1.0, use_energy: bool = False, energy_floor: float = 0.0, raw_energy: bool = True, htk_compat: bool = False, use_log_fbank: bool = True, use_power: bool = True, seed: int = 0, spectrum: tuple | None = None) -> np.ndarray:
    p, e = spectra(x, o, seed, raw_energy) if spectrum is None else spectrum
    out = (p if use_power else np.sqrt(p))[:, : o.padded // 2] @ mel_bank(m, o.sample_rate, o.padded, factor)[0].T
    if use_log_fbank:
        out = np.log(np.maximum(out, EPS))
    if use_energy:
        e = np.maximum(e, np.log(energy_floor)) if energy_floor > 0 else e
        out = np.hstack([out, e[:, None]] if htk_compat else [e[:, None], out])
    return out


def dct(n: int, k: int) -> np.ndarray:
    """Orthonormal DCT-II, the first ``k`` rows for ``n`` points."""
    d = np.sqrt(2.0 / n) * np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(k)[:, None])
    d[0] = np.sqrt(1.0 / n)
    return d


def lifter(k: int, q: float) -> np.ndarray:
    return 1.0 + 0.5 * q * np.sin(np.pi * np.arange(k) / q) if q else np.ones(k)


def mfcc(x, o: FrameOptions, m: MelOptions = MelOptions(), factor: float = 1.0, num_ceps: int = 13, use_energy: bool = True, energy_floor: float = 0.0, raw_energy: bool = True, cepstral_lifter: float = 22.0, htk_compat: bool = False, seed: int = 0, spectrum: tuple | None = None) -> np.ndarray:
    if num_ceps > m.num_bins:
        raise ValueError("num_ceps must be at most num_bins")
    p, e = spectra(x, o, seed, raw_energy) if spectrum is None else spectrum
    fb = np.log(np.maximum(p[:, : o.padded // 2] @ mel_bank(m, o.sample_rate, o.padded, factor)[0].T, EPS))
    out = fb @ dct(m.num_bins, num_ceps).T * lifter(num_ceps, cepstral_lifter)
    if use_energy:
        out[:, 0] = np.maximum(e, np.log(energy_floor)) if energy_floor > 0 else e
    if htk_compat:
        first = out[:, :1] * (1.0 if use_energy else np.sqrt(2.0))
        out = np.hstack([out[:, 1:], first])
    return out


def rasta(logs: np.ndarray) -> np.ndarray:
    """Band-pass over frames of log energies: numerator (2, 1, 0, -1, -2) / 10, pole 0.94; the first four frames are 0."""
    taps = np.array([0.2, 0.1, 0.0, -0.1, -0.2])
    out = np.zeros_like(logs)
    if len(logs) < 5:
        return out
    feed = sum(t * logs[4 - k : len(logs) - k] for k, t in enumerate(taps))
    last = np.zeros(logs.shape[1])
    for i in range(len(feed)):
        last = out[i + 4] = feed[i] + 0.94 * last
    return out


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(prediction coefficients [n, order], residual energies) of autocorrelations ``r`` [n, order + 1]."""
    n = len(r)
    a, error = np.zeros((n, order)), np.maximum(r[:, 0].copy(), EPS)
    for i in range(order):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[:, i - j]
        k /= error
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a = new
        error = np.maximum(error * (1 - k * k), EPS)
    return a, error


def cepstrum(a: np.ndarray) -> np.ndarray:
    """Cepstral coefficients 1.. of the all-pole model with prediction coefficients ``a``."""
    n, order = a.shape
    c = np.zeros((n, order))
    for i in range(order):
        c[:, i] = a[:, i]
        for j in range(i):
            c[:, i] += (j + 1) / (i + 1) * c[:, j] * a[:, i - 1 - j]
    return c


def equal_loudness(f: np.ndarray) -> np.ndarray:
    s = f * f
    return (s / (s + 1.6e5)) ** 2 * (s + 1.44e6) / (s + 9.61e6)


def plp(x, o: FrameOptions, m: MelOptions = MelOptions(), factor: float = 1.0, with_rasta: bool = False, lpc_order: int = 12, num_ceps: int = 13, use_energy: bool = True, energy_floor: float = 0.0, raw_energy: bool = True, compress_factor: float = 1 / 3, cepstral_lifter: float = 22.0, cepstral_scale: float = 1.0, htk_compat: bool = False, seed: int = 0, spectrum: tuple | None = None) -> np.ndarray:
    if not 1 <= num_ceps <= lpc_order + 1:
        raise ValueError("num_ceps must be in 1 to lpc_order + 1")
    p, e = spectra(x, o, seed, raw_energy) if spectrum is None else spectrum
    w, centre = mel_bank(m, o.sample_rate, o.padded, factor)
    bands = np.maximum(p[:, : o.padded // 2] @ w.T, EPS)
    if with_rasta:
        bands = np.exp(rasta(np.log(bands + EPS)))
    bands = (bands * equal_loudness(centre)) ** compress_factor
    bands = np.hstack([bands[:, :1], bands, bands[:, -1:]])
    n = bands.shape[1]
    basis = np.cos(np.pi / (n - 1) * np.arange(lpc_order + 1)[:, None] * np.arange(n)[None, :]) / (2.0 * (n - 1))
    basis[:, 1:-1] *= 2.0
    a, error = levinson(bands @ basis.T, lpc_order)
    out = np.hstack([np.log(np.maximum(error, EPS))[:, None], cepstrum(a)])[:, :num_ceps]
    out = out * lifter(num_ceps, cepstral_lifter) * cepstral_scale
    if use_energy:
        out[:, 0] = np.maximum(e, np.log(energy_floor)) if energy_floor > 0 else e
    return np.hstack([out[:, 1:], out[:, :1]]) if htk_compat else out


def energy(x, o: FrameOptions, raw_energy: bool = True, compression: str = "log", seed: int = 0) -> np.ndarray:
    if compression not in ("off", "log", "sqrt"):
        raise ValueError(f"compression must be off, log or sqrt, it is {compression}")
    f, _ = prepare(x, replace(o, preemph_coeff=0.0, window_type="rectangular") if raw_energy else o, seed)
    e = (f * f).sum(axis=1)
    tiny = np.finfo(np.float64).tiny
    return {"off": lambda v: v, "log": lambda v: np.log(np.maximum(v, tiny)), "sqrt": lambda v: np.sqrt(np.maximum(v, tiny))}[compression](e)[:, None]


def resample(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` samples for those of ``x``, by their Fourier series."""
    n = len(x)
    if count == n or not n or not count:
        return np.array(x[:count], np.float64)
    spectrum = np.fft.rfft(x)
    new = np.zeros(count // 2 + 1, complex)
    k = min(n, count)
    new[: k // 2 + 1] = spectrum[: k // 2 + 1]
    if k % 2 == 0:
        new[k // 2] *= 2.0 if count < n else 0.5
    return np.fft.irfft(new, count) * (count / n)


def viterbi(cost: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The cheapest path through ``cost`` [frames, states] with transition costs ``step``."""
    frames, states = cost.shape
    total, back = cost[0].copy(), np.zeros((frames, states), np.int64)
    for t in range(1, frames):
        ways = total[:, None] + step
        back[t] = ways.argmin(axis=0)
        total = ways[back[t], np.arange(states)] + cost[t]
    path = np.zeros(frames, np.int64)
    path[-1] = total.argmin()
    for t in range(frames - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def sinc_weights(times: np.ndarray, rate: float, cutoff: float, zeros: float) -> tuple[np.ndarray, np.ndarray]:
    """(samples, weights) [times, span] of a low-pass at ``cutoff`` Hz: a sinc of ``zeros`` zero crossings under a raised cosine."""
    half = zeros / (2.0 * cutoff)
    at = np.ceil((times - half) * rate).astype(np.int64)[:, None] + np.arange(int(2 * half * rate) + 1)[None, :]
    d = times[:, None] - at / rate
    return at, np.where(np.abs(d) < half, 0.5 * (1 + np.cos(2 * np.pi * cutoff / zeros * d)) * 2 * cutoff * np.sinc(2 * cutoff * d), 0.0) / rate


def lowpass_resample(x: np.ndarray, old: float, new: float, cutoff: float, zeros: float) -> np.ndarray:
    """Samples at another rate without what lies above ``cutoff`` Hz; silence is taken beyond the ends."""
    count = int(len(x) * new / old)
    if not count:
        return np.zeros(0)
    at, w = sinc_weights(np.arange(count) / new, old, cutoff, zeros)
    return (np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, len(x) - 1)], 0.0) * w).sum(axis=1)


def pitch(x, o: FrameOptions, min_f0: float = 50.0, max_f0: float = 400.0, soft_min_f0: float = 10.0, penalty_factor: float = 0.1, resample_freq: float = 4000.0, delta_pitch: float = 0.005, nccf_ballast: float = 7000.0, lowpass_cutoff: float = 1000.0, lowpass_filter_width: int = 1, upsample_filter_width: int = 5, **_) -> np.ndarray:
    """[frames, 2]: cross-correlation at the chosen lag, and pitch; the lags lie on a logarithmic scale, the path through them is the cheapest.

    A signal of another rate than ``resample_freq`` is brought to it under a low-pass; with ``resample_freq`` 0 it is taken as it is.
    """
    x = np.asarray(x, np.float64)
    if resample_freq and resample_freq != o.sample_rate:
        if not 0 < lowpass_cutoff <= min(resample_freq, o.sample_rate) / 2:
            raise ValueError(f"lowpass_cutoff must be above 0 and at most half of either rate, it is {lowpass_cutoff}")
        x = lowpass_resample(x, o.sample_rate, resample_freq, lowpass_cutoff, lowpass_filter_width)
    rate = resample_freq or o.sample_rate
    more = int(np.ceil(upsample_filter_width / 2))  # whole lags on either side that finer ones are made of
    length, shift = int(rate * o.frame_length + 1e-9), int(rate * o.frame_shift + 1e-9)
    lags = 1.0 / min_f0 * (1 + delta_pitch) ** -np.arange(int(np.log(max_f0 / min_f0) / np.log(1 + delta_pitch)) + 1)
    most = int(np.ceil(rate / min_f0)) + 1 + more
    count = 1 + (len(x) - length) // shift if len(x) >= length else 0
    if count < 1:
        return np.zeros((0, 2))
    x = np.concatenate([x - x.mean(), np.zeros(most + length)])
    at = np.arange(count)[:, None] * shift + np.arange(length)[None, :]
    base = x[at]
    base = base - base.mean(axis=1, keepdims=True)
    ballast = ((x * x).mean() * length) ** 2 / max(nccf_ballast, 1.0) + 1e-10
    e0 = (base * base).sum(axis=1)
    first = max(1, int(np.floor(rate / max_f0)) - 1 - more)
    whole = np.arange(first, most + 1)
    nccf = np.zeros((count, len(whole)))
    for i, lag in enumerate(whole):
        other = x[at + lag]
        other = other - other.mean(axis=1, keepdims=True)
        nccf[:, i] = (base * other).sum(axis=1) / np.sqrt(e0 * (other * other).sum(axis=1) + ballast)
    near, w = sinc_weights(lags - first / rate, rate, rate / 2, upsample_filter_width)
    w = np.where((near >= 0) & (near < len(whole)), w, 0.0)
    spread = np.zeros((len(whole), len(lags)))
    np.add.at(spread, (np.clip(near, 0, len(whole) - 1), np.arange(len(lags))[:, None]), w)
    fine = nccf @ spread
    step = penalty_factor * (np.log(lags)[:, None] - np.log(lags)[None, :]) ** 2 / np.log(1 + delta_pitch) ** 2 * delta_pitch
    path = viterbi(1.0 - fine * (1.0 - soft_min_f0 * lags), step)
    return np.stack([fine[np.arange(count), path], 1.0 / lags[path]], axis=1)


def stack(x: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Frames side by side with those at ``offsets``; the ends repeat."""
    at = np.clip(np.arange(len(x))[:, None] + np.array(offsets)[None, :], 0, max(len(x) - 1, 0))
    return x[at].reshape(len(x), -1)


def bottleneck(x, o: FrameOptions, weights: dict, seed: int = 0, **_) -> np.ndarray:
    """Two networks over log mel energies: ``weights['first']`` and ``['second']`` are lists of (matrix, bias, activation).

    24 mel bands of an 8 kHz signal, mean off over voiced frames (those whose energy isn't of the lowest of three classes), contexts of
    11 frames under a window and six cosines, then the first net's output at -10, -5, 0, 5 and 10 frames; the first and last frame are repeated 15 times before either.
    Energies are sums of squares that wrap around in 16 bits, as the trained networks have them. Dither is uniform. A signal without voiced frames has the mean of all taken off. Trained weights are the caller's.
    """
    rate = 8000
    y = as_int16(resample(np.asarray(x, np.float64), int(len(x) * rate / o.sample_rate)), "int16")
    own = FrameOptions(rate, 0.01, 0.025, 0.0, 0.0, False, "hamming", True, snip_edges=True)
    if len(y) < own.length:
        return np.zeros((0, 80))
    noisy = y + o.dither * np.random.default_rng(seed).uniform(-1.0, 1.0, len(y)) if o.dither else y
    fb = np.log(np.maximum(1.0, np.sqrt(power(prepare(noisy, own)[0], own))[:, : own.padded // 2] @ mel_bank(MelOptions(24, 64.0, 3800.0), rate, own.padded)[0].T))
    short = y.astype(np.int16)
    voiced = energy_classes(cut_frames(short * short, own).sum(axis=1)) < 0.3
    fb = fb - (fb[voiced].mean(axis=0) if voiced.any() else fb.mean(axis=0))
    count, fb = len(fb), np.pad(fb, ((15, 15), (0, 0)), mode="edge")
    context = stack(fb, tuple(range(-5, 6)))[5:-5].reshape(-1, 11, 24)
    cosines = np.cos(np.pi / 11 * np.arange(6)[:, None] * (np.arange(11)[None, :] + 0.5)) * np.hamming(11)
    h = np.einsum("tcb,kc->tbk", context, cosines).reshape(len(context), -1)
    h = network(h, weights["first"])
    return network(stack(h, (-10, -5, 0, 5, 10))[10 : 10 + count], weights["second"])


def energy_classes(e: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Posterior of the lowest of three normal classes of energies, after a few rounds of expectation-maximisation; 1 where all are equal."""
    z = np.asarray(e, np.float64)
    if z.std() == 0:
        return np.ones(len(z))
    z = (z - z.mean()) / z.std()
    mean, var, w = np.array([-1.0, 0.0, 1.0]), np.ones(3), np.full(3, 1 / 3)
    for _ in range(rounds):
        logs = np.log(w) - 0.5 * (np.log(2 * np.pi * var) + (z[:, None] - mean) ** 2 / var)
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        n = post.sum(axis=0) + 1e-10
        mean = (post * z[:, None]).sum(axis=0) / n
        var = np.maximum((post * (z[:, None] - mean) ** 2).sum(axis=0) / n, 1e-3)
        w = n / n.sum()
    return post[:, 0]


def network(x: np.ndarray, layers) -> np.ndarray:
    for w, b, kind in layers:
        x = x @ np.asarray(w) + np.asarray(b)
        if kind == "sigmoid":
            x = 1.0 / (1.0 + np.exp(-x))
        elif kind == "relu":
            x = np.maximum(x, 0.0)
    return x


def crepe(x, o: FrameOptions, weights: dict, center: bool = True, smooth: bool = True, **_) -> np.ndarray:
    """[frames, 2]: voicing and pitch in Hz by a convolutional network over 1,024 samples at 16 kHz, brought to as many frames as other processors have.

    ``weights``: 'blocks', a list of (kernel [width, in, out], bias, stride, scale, shift), and 'dense' (matrix, bias) to 360 pitch classes.
    """
    rate, size = 16000, 1024
    y = resample(np.asarray(x, np.float64), int(len(x) * rate / o.sample_rate))
    if center:
        y = np.pad(y, size // 2)
    hop = int(rate * o.frame_shift)
    if len(y) < size:
        return np.zeros((0, 2))
    f = np.lib.stride_tricks.sliding_window_view(y, size)[::hop].astype(np.float64)
    f = (f - f.mean(axis=1, keepdims=True)) / np.maximum(f.std(axis=1, keepdims=True), 1e-8)
    h = f[:, :, None]
    for kernel, bias, stride, gain, shift in weights["blocks"]:
        width = kernel.shape[0]
        need = max((-(-h.shape[1] // stride) - 1) * stride + width - h.shape[1], 0)
        p = np.pad(h, ((0, 0), (need // 2, need - need // 2), (0, 0)))
        view = np.lib.stride_tricks.sliding_window_view(p, width, axis=1)[:, ::stride]
        h = np.maximum(np.einsum("ntcw,wco->nto", view, kernel, optimize=True) + bias, 0.0) * gain + shift
        h = h[:, : h.shape[1] // 2 * 2].reshape(len(h), -1, 2, h.shape[2]).max(axis=2)
    act = 1.0 / (1.0 + np.exp(-(h.reshape(len(h), -1) @ weights["dense"][0] + weights["dense"][1])))
    cents = np.linspace(0, 7180, 360) + 1997.3794084376191
    best = act.argmax(axis=1)
    if smooth and len(act):
        near = np.maximum(12 - np.abs(np.arange(360)[:, None] - np.arange(360)[None, :]), 0).astype(float)
        step = -np.log(np.maximum(near / near.sum(axis=1, keepdims=True), 1e-300))
        seen = np.full((360, 360), 0.9 / 360) + 0.1 * np.eye(360)
        best = viterbi(-np.log(seen[:, best].T), step)
    out = np.zeros((len(act), 2))
    for t, c in enumerate(best):
        a, b = max(0, c - 4), min(360, c + 5)
        s = act[t, a:b].sum()
        out[t] = act[t].max(), 10.0 * 2 ** (((act[t, a:b] * cents[a:b]).sum() / s if s else cents[c]) / 1200)
    n = len(y) - (size // 2 * 2 if center else 0)
    count = 1 + int((n - o.frame_length * rate) / hop) if n >= o.frame_length * rate else 0
    out = np.stack([resample(out[:, i], count) for i in range(2)], axis=1)
    out[:, 0] = np.clip(np.where(out[:, 0] < 0.01, 0.0, out[:, 0]), 0.0, 1.0)
    return out


def voicing(pov: np.ndarray, stay: float = 0.99) -> np.ndarray:
    """Voiced or not, by a model of two normal states (0 and 1, variance 1/4) that tend to stay."""
    cost = np.stack([(pov - m) ** 2 / (2 * 0.25) for m in (0.0, 1.0)], axis=1)
    step = -np.log(np.array([[stay, 1 - stay], [1 - stay, stay]]))
    return viterbi(cost, step).astype(bool) if len(pov) else np.zeros(0, bool)


KERNELS = {"spectrogram": spectrogram, "filterbank": filterbank, "mfcc": mfcc, "plp": plp, "energy": energy, "kaldi_pitch": pitch, "bottleneck": bottleneck, "crepe_pitch": crepe}
