"""Diagonal Gaussian mixtures trained by expectation-maximisation, and warps of vocal tract length.

A model is small (its size is its parameters' own, never the data's) and lives on the driver; each iteration is one pass over the frames:
Arrow batches are reduced to sufficient statistics per task, which Spark adds up by Gaussian.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespark.operators.blocks import matrix, vectors
from framespark.plans.cuts import cut, discard

NORM_TYPES = ("offset", "none", "diag")


@dataclass(frozen=True)
class Mixture:
    weight: np.ndarray  # [g]
    mean: np.ndarray  # [g, d]
    var: np.ndarray  # [g, d]

    def loglik(self, x: np.ndarray) -> np.ndarray:
        """[n, g]: log of weight times density."""
        iv = 1.0 / self.var
        const = np.log(self.weight) - 0.5 * (np.log(2 * np.pi * self.var).sum(axis=1) + (self.mean**2 * iv).sum(axis=1))
        return const + x @ (self.mean * iv).T - 0.5 * (x * x) @ iv.T

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(g, float(self.weight[g]), self.mean[g].tolist(), (1 / self.var[g]).tolist()) for g in range(len(self.weight))], "g int, weight double, mean array<double>, inv_var array<double>")

    @staticmethod
    def read(df: DataFrame) -> Mixture:
        rows = df.orderBy("g").collect()
        return Mixture(np.array([r.weight for r in rows]), np.array([r.mean for r in rows]), 1.0 / np.array([r.inv_var for r in rows]))


def _selected(x: np.ndarray, model: Mixture, k: int) -> tuple[np.ndarray, np.ndarray]:
    ll = model.loglik(x)
    order = np.argsort(-ll, axis=1, kind="stable")[:, : min(k, ll.shape[1])]
    return order, np.take_along_axis(ll, order, axis=1)


def posterior(ll: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Normalised; entries below ``least`` are dropped one after another from the smallest, what is left normalised each time."""
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for _ in range(p.shape[1] - 1 if least > 0 else 0):
        low = np.where(p > 0, p, np.inf)
        at = low.argmin(axis=1)
        drop = (low[np.arange(len(p)), at] < least) & ((p > 0).sum(axis=1) > 1)
        if not drop.any():
            break
        p[np.flatnonzero(drop), at[drop]] = 0.0
        p /= p.sum(axis=1, keepdims=True)
    return p


def full_loglik(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """[n, g]: log of weight times density of Gaussians with full covariances, by their Cholesky factors; a covariance that isn't positive definite is an error."""
    out = np.empty((len(x), len(weight)))
    for g, (w, m, c) in enumerate(zip(weight, mean, covariance)):
        try:
            factor = np.linalg.cholesky(np.asarray(c, float))
        except np.linalg.LinAlgError:
            raise ValueError(f"the covariance of Gaussian {g} is not positive definite") from None
        z = np.linalg.solve(factor, (x - m).T)
        out[:, g] = np.log(w) - 0.5 * ((z * z).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(factor)).sum()
    return out


def warp_statistics(warps: DataFrame) -> DataFrame:
    """One row: ``n, mean, std`` of the warps."""
    return warps.agg(F.count("warp").alias("n"), F.avg("warp").alias("mean"), F.stddev_pop("warp").alias("std"))


def reselect(frames: DataFrame, model: Mixture, earlier: DataFrame, k: int = 15) -> DataFrame:
    """``item, frame, gselect``: the best ``k`` of the Gaussians that ``earlier(item, frame, gselect)`` has for a frame; frames without any are left out."""
    kind = frames.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ll = model.loglik(matrix(pa.chunked_array([b.column(2)])))
            out = [np.array(g)[np.argsort(-ll[i, g], kind="stable")[:k]].tolist() for i, g in enumerate(b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["item", "frame", "gselect"])

    both = frames.select("item", "frame", F.col("vec").cast("array<double>")).join(earlier.select("item", "frame", "gselect").where("size(gselect) > 0"), ["item", "frame"])
    return both.mapInArrow(run, f"item {kind}, frame int, gselect array<int>")


def select(frames: DataFrame, model: Mixture, k: int = 15) -> DataFrame:
    """``item, frame, gselect``: the best ``k`` Gaussians of each frame, best first."""
    kind = frames.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            order, _ = _selected(matrix(pa.chunked_array([b.column(2)])), model, k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vectors(order, "int32")], ["item", "frame", "gselect"])

    return frames.select("item", "frame", F.col("vec").cast("array<double>")).mapInArrow(run, f"item {kind}, frame int, gselect array<int>")


def posteriors(frames: DataFrame, model: Mixture, k: int = 15, least: float = 0.025) -> DataFrame:
    """``item, frame, post ARRAY<STRUCT<g, p>>`` over the best ``k`` Gaussians, best first, without those pruned."""
    kind = frames.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            order, ll = _selected(matrix(pa.chunked_array([b.column(2)])), model, k)
            p = posterior(ll, least)
            post = [[{"g": int(g), "p": float(v)} for g, v in zip(gs, ps) if v > 0 or least <= 0] for gs, ps in zip(order, p)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(post, pa.list_(pa.struct([("g", pa.int32()), ("p", pa.float64())])))], ["item", "frame", "post"])

    return frames.select("item", "frame", F.col("vec").cast("array<double>")).mapInArrow(run, f"item {kind}, frame int, post array<struct<g:int,p:double>>")


def accumulate(frames: DataFrame, model: Mixture, weight: str | None = None) -> DataFrame:
    """``g, n, s1, s2, ll``: sufficient statistics; each task sends one row per Gaussian."""

    def run(batches):
        n, s1, s2, total = 0.0, 0.0, 0.0, 0.0
        some = False
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(pa.chunked_array([b.column(0)]))
            w = b.column(1).to_numpy(zero_copy_only=False)
            ll = model.loglik(x)
            p = posterior(ll) * w[:, None]
            top = ll.max(axis=1)
            total += float(((top + np.log(np.exp(ll - top[:, None]).sum(axis=1))) * w).sum())
            n, s1, s2, some = n + p.sum(axis=0), s1 + p.T @ x, s2 + p.T @ (x * x), True
        if some:
            g = len(model.weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(g, dtype=np.int32)), pa.array(n), vectors(s1), vectors(s2), pa.array(np.full(g, total / g))], ["g", "n", "s1", "s2", "ll"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = frames.select(F.col("vec").cast("array<double>"), w.alias("_w")).mapInArrow(run, "g int, n double, s1 array<double>, s2 array<double>, ll double")
    d = model.mean.shape[1]
    added = lambda c: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(d)))
    return parts.groupBy("g").agg(F.sum("n").alias("n"), added("s1").alias("s1"), added("s2").alias("s2"), F.sum("ll").alias("ll"))


def estimate(stats: DataFrame, model: Mixture, min_weight: float = 1e-4, min_var: float = 1e-3, drop_low: bool = False) -> tuple[Mixture, float]:
    """(new model, log-likelihood of the old): a Gaussian with too little keeps its parameters, or is dropped."""
    found = stats.collect()
    return _estimated({r.g: (r.n, np.array(r.s1), np.array(r.s2)) for r in found}, sum(r.ll for r in found), model, min_weight, min_var, drop_low)


def _estimated(rows: dict, ll: float, model: Mixture, min_weight: float = 1e-4, min_var: float = 1e-3, drop_low: bool = False) -> tuple[Mixture, float]:
    total = sum(n for n, _, _ in rows.values())
    weight, mean, var = [], [], []
    for g in range(len(model.weight)):
        n, s1, s2 = rows.get(g, (0.0, None, None))
        if n > max(min_weight * total, 1e-8):
            m = s1 / n
            weight.append(n / total), mean.append(m), var.append(np.maximum(s2 / n - m * m, min_var))
        elif not drop_low:
            weight.append(max(n / max(total, 1e-300), min_weight)), mean.append(model.mean[g]), var.append(model.var[g])
    w = np.array(weight)
    return Mixture(w / w.sum(), np.array(mean), np.array(var)), ll


def initial(frames: DataFrame, num_gauss: int, seed: int = 0) -> Mixture:
    """Means at frames drawn by hash (not in order of arrival), the variance of all."""
    d = len(frames.select("vec").first()[0])
    x = [F.get("vec", F.lit(i)).cast("double") for i in range(d)]
    r = frames.agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, x)).alias("m"), F.array(*map(F.var_pop, x)).alias("v")).first()
    if r.n < 10 * num_gauss:
        raise ValueError(f"too few frames ({r.n}) to train {num_gauss} Gaussians")
    v = np.array(r.v)
    if not (v > 0).all():
        raise ValueError("features have components of zero variance")
    drawn = frames.orderBy(F.xxhash64("item", "frame", F.lit(seed)), "item", "frame").select("vec").limit(num_gauss).collect()
    return Mixture(np.full(num_gauss, 1 / num_gauss), np.array([s.vec for s in drawn], float), np.tile(v, (num_gauss, 1)))


def split(model: Mixture, target: int, perturb: float = 0.1, seed: int = 0) -> Mixture:
    """The heaviest Gaussians in two, moved apart, until there are ``target``."""
    rng = np.random.default_rng(seed)
    w, m, v = list(model.weight), list(model.mean), list(model.var)
    while len(w) < target:
        g = int(np.argmax(w))
        step = rng.standard_normal(len(m[g])) * np.sqrt(v[g]) * perturb
        w[g] /= 2
        w.append(w[g]), m.append(m[g] + step), v.append(v[g].copy())
        m[g] = m[g] - step
    return Mixture(np.array(w), np.array(m), np.array(v))


def train(frames: DataFrame, num_gauss: int, num_iters: int = 4, num_iters_init: int = 20, initial_proportion: float = 0.5, subsample: int = 5, seed: int = 0, min_weight: float = 1e-4) -> tuple[Mixture, list[float]]:
    """(model, log-likelihood at each iteration): few Gaussians first, split as it goes, then iterations on subsampled frames."""
    thin = frames.where(F.col("frame") % subsample == 0)
    start = initial(frames, max(1, int(initial_proportion * num_gauss)), seed)
    return _grown(start, lambda m, whole: estimate(accumulate(frames if whole else thin, m), m, min_weight), num_gauss, num_iters, num_iters_init, seed)


def _grown(model: Mixture, better, num_gauss: int, num_iters: int, num_iters_init: int, seed: int) -> tuple[Mixture, list[float]]:
    """``better(model, whole)``: (the model after an iteration over all or the subsampled frames, log-likelihood of the one before)."""
    history, step = [], max(1, int((num_gauss - len(model.weight)) / max(num_iters_init / 2, 1)))
    for i in range(num_iters_init):
        model, ll = better(model, True)
        history.append(ll)
        if len(model.weight) < num_gauss:
            model = split(model, min(num_gauss, len(model.weight) + step), seed=seed + i)
    for i in range(num_iters):
        model, ll = better(model, False)
        history.append(ll)
    return model, history


def normal_equations(plain: DataFrame, warped: DataFrame, dims: int, weights: DataFrame | None = None) -> DataFrame:
    """``i, j, q, l``: sums of x[i] x[j] (x with a 1 appended) and of y[j] x[i], over frames that both have, by ``weights(item, frame, weight)`` if given. Long form of the least squares of y on x."""
    y = warped.select("item", "frame", F.col("vec").alias("_y"))
    x = F.concat(F.col("vec").cast("array<double>"), F.array(F.lit(1.0)))
    d = plain.join(y, ["item", "frame"])
    d = d.join(weights.select("item", "frame", F.col("weight").cast("double").alias("w")), ["item", "frame"]) if weights is not None else d.withColumn("w", F.lit(1.0))
    d = d.select(x.alias("x"), F.concat(F.col("_y").cast("array<double>"), F.array(F.lit(0.0))).alias("y"), "w")
    sums = [F.sum(F.col("w") * F.get("x", F.lit(i)) * F.get(v, F.lit(j))).alias(f"{v}_{i}_{j}") for i in range(dims + 1) for j in range(dims + 1) for v in "xy"]
    wide = d.agg(*sums)
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"x_{i}_{j}").alias("q"), F.col(f"y_{i}_{j}").alias("l")) for i in range(dims + 1) for j in range(dims + 1)))
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def mapping_transform(plain: DataFrame, warped: DataFrame, dims: int, renormalise: bool = False, weights: DataFrame | None = None) -> np.ndarray:
    """[dims, dims + 1]: the affine map that takes plain features nearest to warped ones. Renormalised, it has no offset and its rows are scaled to leave each component's variance as it was."""
    q, right = np.zeros((dims + 1, dims + 1)), np.zeros((dims + 1, dims + 1))
    for r in normal_equations(plain, warped, dims, weights).collect():
        q[r.i, r.j], right[r.i, r.j] = r.q or 0.0, r.l or 0.0
    return _map(q, right[:, :dims], renormalise)


def _map(q: np.ndarray, right: np.ndarray, renormalise: bool) -> np.ndarray:
    dims = right.shape[1]
    a = np.linalg.lstsq(q, right, rcond=None)[0].T
    if not renormalise:
        return a
    if not q[dims, dims]:
        raise ValueError("no frames to find maps between warps from")
    n, mean = q[dims, dims], q[dims] / q[dims, dims]
    before = np.diag(q)[:dims] / n - mean[:dims] ** 2
    after = np.einsum("ij,jk,ik->i", a, q, a) / n - (a @ mean) ** 2
    return np.hstack([a[:, :dims] * np.sqrt(before / after)[:, None], np.zeros((dims, 1))])


def _fitted(n: np.ndarray, s: np.ndarray, norm_type: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, offset, objective) of each row: the best ``scale * y + offset`` by component, of the sums of c, k, c y, c y y, k y."""
    sc, sk, scy, scyy, sky = (s[:, i] for i in range(5))
    scale, offset = np.ones_like(sc), np.zeros_like(sc)
    if norm_type == "diag":
        p, r = np.maximum(scyy - scy**2 / sc, 1e-10), sky - sk * scy / sc
        scale = (r + np.sqrt(r * r + 4 * p * n[:, None])) / (2 * p)
    if norm_type != "none":
        offset = (sk - scale * scy) / sc
    parts = n[:, None] * np.log(scale) - 0.5 * (scale**2 * scyy + 2 * scale * offset * scy + offset**2 * sc) + scale * sky + offset * sk
    return scale, offset, parts.sum(axis=1)


#: Frames at a time, so that what is made of them stays near the processor; bytes of sums by key that a task holds before it sends them.
CHUNK, HELD = 2048, 32 << 20


def _linear(model: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """(centre, [g, 2 d + 1]): by the second a centred frame, its squares and 1 become log-likelihoods. Single precision is enough for those, the centre being the model's own."""
    c, iv = model.weight @ model.mean, 1.0 / model.var
    m = model.mean - c
    const = np.log(model.weight) - 0.5 * (np.log(2 * np.pi * model.var) + m * m * iv).sum(axis=1)
    return c, np.hstack([m * iv, -0.5 * iv, const[:, None]]).astype(np.float32)


def _chunks(x: np.ndarray, centre: np.ndarray, buffer: np.ndarray):
    """(place, centred frames, their squares and 1, one row each) of each chunk."""
    d = len(centre)
    for a in range(0, len(x), CHUNK):
        v = buffer[:, : len(x[a : a + CHUNK])]
        v[:d] = (x[a : a + CHUNK] - centre).T
        np.multiply(v[:d], v[:d], out=v[d : 2 * d])
        v[2 * d] = 1.0
        yield a, v


def _summed(blocks, model: Mixture) -> np.ndarray | None:
    """[g, 2 d + 2]: of all frames the sums of posterior, posterior times frame and times squares, the log-likelihood in the last column of the first row."""
    (c, w), total, ll = _linear(model), None, 0.0
    g, d = model.mean.shape
    buffer, one = np.empty((2 * d + 1, CHUNK), np.float32), np.ones(g, np.float32)
    for x in blocks:
        for _, v in _chunks(x, c, buffer):
            p = w @ v
            top = p.max(axis=0)
            p -= top
            np.exp(p, out=p)
            s = one @ p
            part = (p @ (v / s).T).astype(np.float64)
            total = part if total is None else total + part
            ll += float((top + np.log(s)).sum(dtype=np.float64))
    if total is None:
        return None
    n, s1, s2 = total[:, -1:], total[:, :d], total[:, d : 2 * d]
    return np.hstack([n, s1 + n * c, s2 + 2 * c * s1 + n * c * c, np.r_[ll, np.zeros(g - 1)][:, None]])


def _pruned(ll: np.ndarray, k: int, least: float) -> np.ndarray:
    """``posterior`` over the best ``k`` columns of each row, 0 elsewhere. Of sorted weights a prefix survives: as far as each is ``least`` or more of the sum down to it."""
    n, g = ll.shape
    e = np.exp(ll - ll.max(axis=1, keepdims=True))
    q = np.sort(np.partition(e, g - k, axis=1)[:, g - k :] if k < g else e, axis=1)[:, ::-1]
    s = np.cumsum(q, axis=1)
    kept = np.maximum((q >= least * s).sum(axis=1), 1)
    last, whole = (v[np.arange(n), kept - 1][:, None] for v in (q, s))
    inside = e >= last
    p = np.where(inside, e, 0) / whole
    for i in np.flatnonzero(inside.sum(axis=1) != kept):  # equals at the edge: the first of them
        order = np.argsort(-e[i], kind="stable")[: kept[i]]
        p[i] = 0
        p[i, order] = e[i, order] / whole[i]
    return p


def _pairs(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d + 1)


def _key_sums(pieces, model: Mixture, k: int, least: float):
    """(key, n, sums) of pieces (keys, frames of each, x, z): of the frames x of each key, with posteriors at z, the sums of c and m times products of (x, 1), as much as any map needs.

    With posteriors p, c is p / var and m is p mean / var, by component. A key comes again if what is held grew too large.
    """
    (c, w), d = _linear(model), model.mean.shape[1]
    iv = 1.0 / model.var
    both = np.hstack([iv, iv * model.mean]).astype(np.float32)
    i, j = _pairs(d)
    last = np.flatnonzero(j == d)
    buffer, held, size = np.empty((2 * d + 1, CHUNK), np.float32), {}, 8 * (d * len(i) + d * (d + 1))
    for keys, counts, x, z in pieces:
        cm = np.empty((len(x), 2 * d))
        for a, v in _chunks(z, c, buffer):
            cm[a : a + v.shape[1]] = _pruned(v.T @ w.T, k, least) @ both
        at = 0
        for name, n in zip(keys, counts):
            if not n:
                continue
            v = np.hstack([x[at : at + n], np.ones((n, 1))])
            s = cm[at : at + n].T @ (v[:, i] * v[:, j])
            s = np.concatenate([s[:d].ravel(), s[d:, last].ravel()])
            before = held.get(name)
            held[name] = (n, s) if before is None else (before[0] + n, before[1] + s)
            at += n
        if len(held) * size > HELD:
            yield from ((name, *v) for name, v in held.items())
            held = {}
    yield from ((name, *v) for name, v in held.items())


def _best(n: np.ndarray, s: np.ndarray, maps: np.ndarray, factors: np.ndarray, logdet: np.ndarray, norm_type: str):
    """(warp, score, scale, offset) of each key: of warps that are as good as each other the one nearest 1."""
    many, d = len(n), maps.shape[1]
    i, j = _pairs(d)
    squares, linear = s[:, : d * len(i)].reshape(many, d, -1), s[:, d * len(i) :].reshape(many, d, d + 1)
    last = np.flatnonzero(j == d)
    by = np.argsort(np.abs(factors - 1.0), kind="stable")
    a = maps[by]
    sums = np.empty((many, len(by), 5, d))
    sums[:, :, 0], sums[:, :, 1] = squares[:, None, :, -1], linear[:, None, :, -1]
    sums[:, :, 2] = np.einsum("kde,wde->kwd", squares[:, :, last], a)
    sums[:, :, 3] = np.einsum("kdp,wdp->kwd", squares, a[:, :, i] * a[:, :, j] * np.where(i == j, 1.0, 2.0))
    sums[:, :, 4] = np.einsum("kde,wde->kwd", linear, a)
    scale, offset, score = _fitted(np.repeat(n, len(by)), sums.reshape(-1, 5, d), norm_type)
    score = score.reshape(many, -1) + logdet[by] * n[:, None]
    at = (np.arange(many), score.argmax(axis=1))
    return factors[by][at[1]], score[at], scale.reshape(many, -1, d)[at], offset.reshape(many, -1, d)[at]


def _chosen(frames: DataFrame, pieces, model: Mixture, transforms: dict[float, np.ndarray], key: str, logdet_scale: float, norm_type: str, k: int, least: float) -> DataFrame:
    """``key, warp, score, scale, offset``. ``pieces``: what makes batches of ``frames`` those of ``_key_sums``. Sums go by key, a row of bytes for each task that has it."""
    if norm_type not in NORM_TYPES:
        raise ValueError(f"norm_type must be in {list(NORM_TYPES)}, it is {norm_type}")
    kind = frames.schema[key].dataType.simpleString()
    factors = np.array(sorted(transforms))
    maps = np.array([transforms[f] for f in factors])
    logdet = logdet_scale * np.linalg.slogdet(maps[:, :, :-1])[1]

    def run(batches):
        for some in _lots(_key_sums(pieces(batches), model, k, least), 1024):
            names, n, s = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64()), pa.array([v.tobytes() for v in s], pa.binary())], [key, "n", "s"])

    def whole(batches):
        name, n, s = None, 0, 0.0
        for b in batches:
            for other, m, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if n and other != name:
                    yield name, n, s
                    n, s = 0, 0.0
                name, n, s = other, n + m, s + np.frombuffer(t)
        if n:
            yield name, n, s

    def fit(batches):
        for some in _lots(whole(batches), 256):
            names, n, s = zip(*some)
            warp, score, scale, offset = _best(np.array(n, float), np.array(s), maps, factors, logdet, norm_type)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(warp), pa.array(score), vectors(scale), vectors(offset)], [key, "warp", "score", "scale", "offset"])

    parts = frames.mapInArrow(run, f"`{key}` {kind}, n long, s binary")
    return parts.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(fit, f"`{key}` {kind}, warp double, score double, scale array<double>, offset array<double>")


def _lots(rows, size: int):
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield some


def choose_warps(frames: DataFrame, model: Mixture, transforms: dict[float, np.ndarray], key: str, logdet_scale: float = 0.0, norm_type: str = "offset", now: str = "vec", k: int = 15, least: float = 0.025) -> DataFrame:
    """``key, warp, score, scale, offset``: for each key the warp whose map, followed by an offset (``offset``), a scale and an offset (``diag``) or neither (``none``), has the best auxiliary function.

    Posteriors are those of the column ``now``, pruned. Each task sends a row per key.
    """

    def pieces(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, z = matrix(pa.chunked_array([b.column(1)])), matrix(pa.chunked_array([b.column(2)]))
            keys = b.column(0).dictionary_encode()
            codes = keys.indices.to_numpy()
            by = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[by]) > 0])
            yield [keys.dictionary[int(c)].as_py() for c in codes[by][starts]], np.diff(np.r_[starts, len(by)]), x[by], z[by]

    arrays = [F.col(v).cast("array<double>").alias(f"_{i}") for i, v in enumerate(("vec", now))]
    return _chosen(frames.where(F.col(key).isNotNull()).select(key, *arrays), pieces, model, transforms, key, logdet_scale, norm_type, k, least)


def apply_transform(frames: DataFrame, warps: DataFrame, transforms: dict[float, np.ndarray], key: str) -> DataFrame:
    """Frames under the map of their key's warp, with its scale and offset if ``warps`` has them; keys without one are left as they are."""
    table = frames.sparkSession.createDataFrame([(float(f), a.tolist()) for f, a in transforms.items()], "warp double, _a array<array<double>>")
    more = [c for c in ("scale", "offset") if c in warps.columns]
    maps = warps.select(key, "warp", *(F.col(c).alias(f"_{c}") for c in more)).join(F.broadcast(table), "warp").drop("warp")
    x = F.concat(F.col("vec").cast("array<double>"), F.array(F.lit(1.0)))
    moved = F.transform("_a", lambda row: F.aggregate(F.zip_with(row, x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
    for c, f in (("scale", lambda p, q: p * q), ("offset", lambda p, q: p + q)):
        if c in more:
            moved = F.zip_with(moved, f"_{c}", f)
    return frames.join(maps, key, "left").withColumn("vec", F.coalesce(moved, F.col("vec").cast("array<double>"))).drop("_a", *(f"_{c}" for c in more))


def _block(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(all frames of a column of float32 bytes, how many each row has)."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    values = column.buffers()[2]
    x = np.frombuffer(values, np.float32, (ends[-1] - ends[0]) // 4, int(ends[0])) if values is not None and ends[-1] > ends[0] else np.zeros(0, np.float32)
    return x.reshape(-1, d), np.diff(ends) // (4 * d)


def _moved(b, maps: np.ndarray, factors: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frames, how many each row has, frames under the map of their row) of a batch of ``key, thin, warp, scale, offset``; rows without a warp are left as they are."""
    x, counts = _block(b.column(1), d)
    has = np.asarray(b.column(2).is_valid())
    a, offset = np.tile(np.eye(d), (len(has), 1, 1)), np.zeros((len(has), d))
    if has.any():
        m = maps[np.searchsorted(factors, b.column(2).drop_null().to_numpy() - 1e-9)]
        scale, more = (matrix(pa.chunked_array([b.column(i).drop_null()])) for i in (3, 4))
        a[has], offset[has] = m[:, :, :-1] * scale[:, :, None], m[:, :, -1] * scale + more
    z, at = np.empty(x.shape), np.r_[0, np.cumsum(counts)]
    for i in range(len(has)):
        z[at[i] : at[i + 1]] = x[at[i] : at[i + 1]] @ a[i].T
    return x, counts, z + np.repeat(offset, counts, axis=0)


def _added(frames: DataFrame, of) -> np.ndarray | None:
    """The sum of the vectors that ``of`` makes of batches. The driver gets one for each task, of which there are four a core at most."""

    def run(batches):
        total = None
        for v in of(batches):
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = frames.coalesce(4 * frames.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "s binary").collect()
    return sum((np.frombuffer(r.s) for r in parts[1:]), np.frombuffer(parts[0].s)) if parts else None


def _better(frames: DataFrame, blocks, model: Mixture, min_weight: float = 1e-4) -> tuple[Mixture, float]:
    """(model after an iteration over ``frames``, log-likelihood of the old). ``blocks``: what makes batches matrices of frames."""
    g, d = model.mean.shape

    s = _added(frames, lambda batches: (v.ravel() for v in [_summed(blocks(batches), model)] if v is not None)).reshape(g, -1)
    return _estimated({i: (r[0], r[1 : d + 1], r[d + 1 : 2 * d + 1]) for i, r in enumerate(s)}, float(s[0, -1]), model, min_weight)


def _start(frames: DataFrame, num_gauss: int, dims: int, seed: int, subsample: int) -> Mixture:
    """``initial`` of packed frames."""

    def moments(batches):
        for x in (_block(b.column(i), dims)[0].astype(np.float64) for b in batches for i in (0, 1)):
            yield np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]

    sums = _added(frames.select("thin", "rest"), moments)
    n = 0 if sums is None else int(sums[0])
    if n < 10 * num_gauss:
        raise ValueError(f"too few frames ({n}) to train {num_gauss} Gaussians")
    var = sums[dims + 1 :] / n - (sums[1 : dims + 1] / n) ** 2
    if not (var > 0).all():
        raise ValueError("features have components of zero variance")
    each = frames.select("item", "n").distinct().select("item", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"))
    drawn = [(r.item, r.frame) for r in each.orderBy(F.xxhash64("item", "frame", F.lit(seed)), "item", "frame").limit(num_gauss).collect()]
    wanted: dict = {}
    for item, frame in drawn:
        wanted.setdefault(item, []).append(frame)
    kind = frames.schema["item"].dataType.simpleString()

    def pick(batches):
        for b in batches:
            for item, thin, rest in zip(*(b.column(i).to_pylist() for i in range(3))):
                if item not in wanted:
                    continue
                first, others = (np.frombuffer(v, np.float32).reshape(-1, dims) for v in (thin, rest))
                rows = [others[f - f // subsample - 1] if f % subsample else first[f // subsample] for f in wanted[item]]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows)), pa.array(wanted[item], pa.int32()), vectors(np.array(rows, np.float64))], ["item", "frame", "vec"])

    found = {(r.item, r.frame): r.vec for r in frames.where(F.col("item").isin(*wanted)).select("item", "thin", "rest").mapInArrow(pick, f"item {kind}, frame int, vec array<double>").collect()}
    return Mixture(np.full(num_gauss, 1 / num_gauss), np.array([found[f] for f in drawn]), np.tile(var, (num_gauss, 1)))


def train_warps(frames: DataFrame, factors: tuple[float, ...], key: str, num_gauss: int = 64, num_iters: int = 15, logdet_scale: float = 0.0, seed: int = 0, norm_type: str = "offset", subsample: int = 5) -> tuple[DataFrame, dict[float, np.ndarray], Mixture]:
    """(``key, warp, score, scale, offset``; maps by warp; model) of ``spectral.packed`` frames under ``factors``, every ``subsample``-th frame thin: the mixture and the warps in turn, each iteration two passes over the thin frames."""
    if norm_type not in NORM_TYPES:
        raise ValueError(f"norm_type must be in {list(NORM_TYPES)}, it is {norm_type}")
    total = _added(frames.where("sums is not null").select("sums"), lambda batches: (np.frombuffer(v) for b in batches for v in b.column(0).to_pylist()))
    if total is None:
        raise ValueError("no frames to find maps between warps from")
    dims = next(d for d in range(1, len(total)) if (d + 1) * (d + 1 + d * len(factors)) >= len(total))
    q, right = np.split(total.reshape(dims + 1, -1), [dims + 1], axis=1)
    maps = {f: np.hstack([np.eye(dims), np.zeros((dims, 1))]) if f == 1.0 else _map(q, y, True) for f, y in zip(factors, np.split(right, len(factors), axis=1))}
    rows = frames.where("sums is null").drop("sums")
    thin = rows.select(key, "thin")
    names = np.array(sorted(maps))
    by_name = np.array([maps[f] for f in names])

    def whole(batches):
        return (_block(b.column(i), dims)[0] for b in batches for i in range(b.num_columns))

    def now(batches):
        for b in batches:
            x, counts, z = _moved(b, by_name, names, dims)
            yield b.column(0).to_pylist(), counts, x.astype(np.float64), z

    columns = [key, "thin", "warp", "scale", "offset"]
    first = thin.selectExpr(f"`{key}`", "thin", "cast(null as double) as warp", "cast(null as array<double>) as scale", "cast(null as array<double>) as offset")
    start = _start(rows, max(1, num_gauss // 2), dims, seed, subsample)
    model, _ = _grown(start, lambda m, every: _better(rows.select("thin", "rest") if every else rows.select("thin"), whole, m), num_gauss, 4, 20, seed)
    choose = lambda d: cut(_chosen(d.where(F.col(key).isNotNull()), now, model, maps, key, logdet_scale, norm_type, 15, 0.025), "warps")
    warps = choose(first)
    for _ in range(num_iters):
        moved = thin.join(warps.drop("score"), key, "left").select(*columns)
        model, _ = _better(moved, lambda batches: (z for _, _, _, z in now(batches)), model)
        last, warps = warps, choose(moved)
        discard(last)
    return warps, maps, model
