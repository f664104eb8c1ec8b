"""Implausible readings per source, by state-space forecasting.

Each component of a source follows a local-level model whose two variances come from the whole source's own
differences. A Kalman filter forecasts every reading; one whose standardised innovation is beyond
a threshold is withheld from the update. Withheld readings that go on for more than three frames are
a new level, to which the filter moves; shorter ones are candidates, which an exact check holds
against the course of the frames around them and the source's scatter about it. Stuck values are where the innovations of the
filter without measurement noise vanish: their variance over eight frames is nothing beside the source's own; an exact
check keeps runs that are equal to the bit. Ranges of the components and the source's time grid, which say what is
impossible whatever came before, are checked beside the filter.

Sources are cut into blocks of frames with a margin on either side, so that no source, however large,
is one task; blocks are filtered together, as rows of a matrix. What is a source's own (variances, scatter, grid) does not depend
on blocks: quantiles are of counts by bins of a sixteenth of an octave, which add up over blocks, and a source of several
blocks has them added up in a pass of its own and sent to its blocks in a row of theirs. The filter's gain is
never under a fifth, so what it knew before the margin has no weight left (0.8 ** 64) where a block's own frames begin.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.operators.blocks import groups
from framespark.plans.cuts import cut

BLOCK, MARGIN = 2048, 64
#: Standardised innovation that withholds a reading; scatters off the course that make a spike; its longest run.
WITHHOLD, OFF, LONGEST = 4.0, 8.0, 3
#: Frames on either side that make the course; equal readings that make a stuck run; innovations that count as none, in the source's own.
COURSE, STUCK, VANISHED = 9, 8, 1e-6
#: Bounds of the components, and what a pitch of 0 means (unvoiced).
VOICING, PITCH, MAX_PITCH, UNVOICED = 1, 2, 1500.0, 0.0
OFF_GRID_S = 1.0
#: Matrix cells a component that are filtered together: a bound of memory.
CELLS = 1 << 16
#: Bins an octave, the bin of 0, and the kinds of statistics: differences over one and two frames, distance from the course, size.
BINS, NOTHING, KINDS = 16, -32768, 4


def binned(x: np.ndarray) -> np.ndarray:
    """Bins of absolute values; NaN has none and must be left out."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x == 0, NOTHING, np.floor(BINS * np.log2(np.abs(x)))).astype(np.int64)


def of_bin(b: np.ndarray) -> np.ndarray:
    """The value a bin stands for."""
    return np.where(b == NOTHING, 0.0, np.exp2((np.asarray(b, float) + 0.5) / BINS)).astype(np.float32).astype(np.float64)


def quantiles(x: np.ndarray, *shares: float) -> list[np.ndarray]:
    """Quantiles of rows without their NaN (the lower reading where one falls between two); NaN of a row without readings."""
    rows, steps = x.shape
    if not steps:
        return [np.full(rows, np.nan) for _ in shares]
    ordered = np.sort(x, axis=1)  # NaN last
    last = np.maximum((~np.isnan(x)).sum(axis=1) - 1, 0)
    return [ordered[np.arange(rows), (last * q + 0.5).astype(np.int64)] for q in shares]


#: The quantiles that are kept of each kind.
SHARES = ((0.5, 0.9), (0.5, 0.9), (0.5, 0.8), (0.5, 0.5))


def filled(x: np.ndarray) -> np.ndarray:
    """Rows with the gaps at the reading before, or at the first; 0 of a row without readings."""
    there = ~np.isnan(x)
    at = np.where(there, np.arange(x.shape[1])[None, :], -1)
    np.maximum.accumulate(at, axis=1, out=at)
    at = np.where(at < 0, there.argmax(axis=1)[:, None], at)
    return np.nan_to_num(np.take_along_axis(x, at, axis=1))


def middle(x: np.ndarray) -> np.ndarray:
    """The moving median of rows, gaps filled."""
    padded = np.pad(filled(x), ((0, 0), (COURSE, COURSE)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * COURSE + 1, axis=1), axis=-1)


def measures(x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Per kind the absolute values, at the frames that are a block's own, NaN elsewhere. Every pair of frames of a source is one block's."""
    inner = np.where(own, 0.0, np.nan)
    return [np.abs(x[:, 1:] - x[:, :-1]) + inner[:, :-1], np.abs(x[:, 2:] - x[:, :-2]) + inner[:, :-2], np.abs(x - middle(x)) + inner, np.abs(x) + inner]


def statistics(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """[rows, 8]: two quantiles of each kind, as binned."""
    out = []
    for m, shares in zip(measures(x, own), SHARES):
        for q in quantiles(m, *shares):
            out.append(np.where(np.isnan(q), np.nan, of_bin(binned(np.nan_to_num(q)))))
    return np.stack(out, axis=1)


def deviations(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Robust deviations of differences over one and two frames, the scatter about the course, and the size.

    By the half and a higher share, the larger: the half alone would be too small where values are held over a few frames and most differences vanish.
    """
    s = np.nan_to_num(stats)
    near, far = np.maximum(s[:, 0] / 0.6745, s[:, 1] / 1.645), np.maximum(s[:, 2] / 0.6745, s[:, 3] / 1.645)
    # on a slope a moving median is the reading itself; what the reading differs from the next by is scatter too
    return near, far, np.maximum.reduce([s[:, 4] / 0.6745, s[:, 5] / 1.2816, near / np.sqrt(2)]), s[:, 6]


def kalman(x: np.ndarray, stats: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(innovations standardised, withheld) of rows ``x`` (NaN: no reading), by a local-level filter with rejection; ``stats`` are the sources' own."""
    n, steps = x.shape
    near, far, _, size = deviations(statistics(x, np.ones(x.shape, bool)) if stats is None else stats)
    one, two = near**2, far**2
    floor = np.maximum(1e-12, 1e-12 * size**2)
    state = np.clip(two - one, 0.05 * one, one) + floor  # Var d1 = q + 2r, Var d2 = 2q + 2r
    noise = np.maximum(one - two / 2, 0.05 * one) + floor
    seen = np.cumsum(~np.isnan(x), axis=1)
    level = np.nan_to_num(quantiles(np.where(seen <= 2 * COURSE, x, np.nan), 0.5)[0])
    spread = noise + state
    zs, held = np.zeros_like(x), np.zeros(x.shape, bool)
    run = np.zeros(n, np.int32)
    for t in range(steps):
        now = x[:, t]
        there = ~np.isnan(now)
        spread = spread + state
        total = spread + noise
        inn = np.where(there, now - level, 0.0)
        z = inn / np.sqrt(total)
        zs[:, t] = z
        far_off = there & (np.abs(z) > WITHHOLD)
        run = np.where(far_off, run + 1, np.where(there, 0, run))
        moved = run > LONGEST
        held[:, t] = far_off & ~moved
        gain = np.where(there & ~far_off, spread / total, 0.0)
        level = level + gain * inn
        spread = spread * (1 - gain)
        if moved.any():
            rows = np.flatnonzero(moved)
            for back in range(1, LONGEST + 1):
                if t - back >= 0:
                    held[rows, t - back] = False
            recent = x[rows, max(0, t - LONGEST) : t + 1]
            level[rows] = np.nanmedian(recent, axis=1)
            spread[rows] = noise[rows]
            run[rows] = 0
    return zs, held


def spikes(x: np.ndarray, stats: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(withheld, confirmed) readings of rows ``x``: candidates of the filter run both ways, and those that the exact check keeps.

    The filter also runs backwards, because a step of level shortly after a spike shows only from the other side.
    """
    rows, steps = x.shape
    if steps < 4:
        return np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        stats = statistics(x, np.ones(x.shape, bool)) if stats is None else stats
        _, ahead = kalman(x, stats)
        _, back = kalman(x[:, ::-1], stats)
        candidate = ahead | back[:, ::-1]
        clean = np.where(candidate, np.nan, x)
        scatter = deviations(stats)[2]
        off = np.zeros(x.shape, bool)
        r, t = np.nonzero(candidate)
        if not len(r):
            return candidate, off
        around = np.arange(-COURSE - LONGEST, COURSE + LONGEST + 1)
        place = t[:, None] + around[None, :]
        inside = (place >= 0) & (place < steps)
        values = np.where(inside, clean[r[:, None], np.clip(place, 0, steps - 1)], np.nan)
        # the course at t: the medians of either side's nearest clean readings, and of both; the nearest of them counts
        half = len(around) // 2
        left = np.nanmedian(values[:, half - 6 : half], axis=1)
        right = np.nanmedian(values[:, half + 1 : half + 7], axis=1)
        both = np.nanmedian(values, axis=1)
        # at a source's ends, where there is one side only, also the line through that side's nearer and farther readings
        near, far = (np.nanmedian(np.concatenate([values[:, half - k - 2 : half - k + 1], values[:, half + k : half + k + 3]], axis=1), axis=1) for k in (1, 4))
        alone = np.isnan(left) | np.isnan(right)
        onward = np.where(alone, near + (near - far) * 2 / 3, np.nan)
        v = x[r, t]
        least = np.minimum.reduce([np.where(np.isnan(c), np.inf, np.abs(v - c)) for c in (left, right, both, onward)])
        off[r, t] = np.isfinite(least) & (least > OFF * scatter[r])
    return candidate, off


def vanished(x: np.ndarray, scale: np.ndarray, least: int = STUCK) -> np.ndarray:
    """Readings of rows ``x`` where the innovations of the filter without measurement noise vanish: their mean square over ``least`` readings is nothing beside ``scale``."""
    rows, steps = x.shape
    out = np.zeros(x.shape, bool)
    if steps < least:
        return out
    with np.errstate(invalid="ignore", over="ignore"):
        square = (x[:, 1:] - x[:, :-1]) ** 2  # without noise the gain is one: the forecast is the reading before
        total = sum(square[:, k : steps - least + 1 + k] for k in range(least - 1))
        quiet = total <= (least - 1) * (VANISHED * scale[:, None]) ** 2
    for k in range(least):
        out[:, k : k + quiet.shape[1]] |= quiet
    return out


def equal_runs(x: np.ndarray, least: int) -> np.ndarray:
    """Readings of rows ``x`` in runs of ``least`` or more that are equal to the bit; NaN ends a run."""
    rows, steps = x.shape
    out = np.zeros(x.shape, bool)
    if steps < least:
        return out
    same = x[:, 1:] == x[:, :-1]
    count = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    full = count[:, least - 1 :] - count[:, : steps - least + 1] == least - 1
    for k in range(least):
        out[:, k : k + full.shape[1]] |= full
    return out


def line(frame: np.ndarray, t0: np.ndarray) -> tuple[float, float] | None:
    """(step, start) of the even grid of frames: the median of the steps from one to the next, then of those over half the length if they agree; none of fewer than three."""
    fine = np.isfinite(t0)
    f, t = frame[fine].astype(float), t0[fine]
    if len(f) < 3:
        return None
    step = np.median(np.diff(t) / np.maximum(np.diff(f), 1))
    half = len(f) // 2
    long = np.median((t[half:] - t[: len(t) - half]) / (f[half:] - f[: len(f) - half]))
    if abs(long - step) * (f[-1] - f[0]) < OFF_GRID_S / 2:
        step = long
    return float(step), float(np.median(t - step * f))


@dataclass
class Part:
    """The readings of one block of one source: ``vec`` is [frames, width], NaN where there is none; ``has`` says where there is one."""

    item: object
    number: int
    frame: np.ndarray
    t0: np.ndarray
    t1: np.ndarray
    has1: np.ndarray
    vec: np.ndarray
    has: np.ndarray
    stats: np.ndarray | None = None  # of a source of several blocks: [width, 8], and (step, start)
    grid: tuple[float, float] | None = None
    whole: bool = True

    @property
    def own(self) -> np.ndarray:
        return self.frame // BLOCK == self.number

    @property
    def steps(self) -> int:
        return int(self.frame[-1] - self.frame[0]) + 1


def part(table: pa.Table) -> Part | None:
    """The block in an Arrow table sorted by frame, latest first; a row without frame, if any, comes first and has the source's statistics. None: no frame is its own."""
    item, number = table.column("item")[0].as_py(), int(table.column("_block")[0].as_py())
    head = None
    if table.column("frame")[0].as_py() is None:
        head, table = table.slice(0, 1), table.slice(1)
    frame = table.column("frame").to_numpy()
    keep = np.append(True, frame[1:] != frame[:-1]) if len(frame) else np.zeros(0, bool)
    frame = frame[keep].astype(np.int64)
    if not (frame // BLOCK == number).any():
        return None
    table = table.filter(pa.array(keep))
    real = lambda c: np.asarray(table.column(c).to_numpy(zero_copy_only=False), np.float64)
    lists = table.column("vec").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    values = lists.flatten()
    vec, has = np.full((len(frame), int(sizes.max(initial=0))), np.nan), np.zeros((len(frame), int(sizes.max(initial=0))), bool)
    inside = np.arange(vec.shape[1])[None, :] < sizes[:, None]
    vec[inside], has[inside] = values.to_numpy(zero_copy_only=False), ~np.asarray(values.is_null())
    out = Part(item, number, frame, real("t0"), real("t1"), ~np.asarray(table.column("t1").is_null()), vec, has)
    if head is not None:
        out.whole = False
        out.stats = np.asarray(head.column("vec")[0].as_py(), np.float64).reshape(-1, 2 * KINDS)
        step, start = head.column("t0")[0].as_py(), head.column("t1")[0].as_py()
        out.grid = None if step is None or start is None else (step, start)
    return out


@dataclass
class Matrix:
    """Blocks together: a row per block and component, a column per frame number from the block's first."""

    parts: list[Part]
    width: int
    raw: np.ndarray
    moving: np.ndarray
    own: np.ndarray
    vanish: np.ndarray
    equal: np.ndarray
    stats: np.ndarray


def assemble(parts: list[Part]) -> Matrix:
    width, steps = max(p.vec.shape[1] for p in parts), max(p.steps for p in parts)
    raw, own = np.full((len(parts), width, steps), np.nan), np.zeros((len(parts), width, steps), bool)
    for i, p in enumerate(parts):
        at = p.frame - p.frame[0]
        raw[i][: p.vec.shape[1], at] = np.where(p.has, p.vec, np.nan).T
        own[i][:, at[p.own]] = True
    still = raw.copy()
    if width > PITCH:
        still[:, PITCH][still[:, PITCH] == UNVOICED] = np.nan
    flat = lambda a: a.reshape(-1, steps)
    raw, own, still = flat(raw), flat(own), flat(still)
    equal = equal_runs(still, STUCK)
    with warnings.catch_warnings(), np.errstate(all="ignore"):
        warnings.simplefilter("ignore", RuntimeWarning)
        moving = np.where(equal | ~np.isfinite(still), np.nan, still)  # what is stuck says nothing of the scatter
        stats = statistics(moving, own) if steps > 2 else np.full((len(raw), 2 * KINDS), np.nan)
    for i, p in enumerate(parts):
        if p.stats is not None:
            k = min(len(p.stats), width)
            stats[i * width : i * width + k] = p.stats[:k]
    vanish = vanished(still, deviations(stats)[0])
    return Matrix(parts, width, raw, moving, own, vanish, equal & vanish, stats)


REASONS = ("not_finite", "out_of_range", "spike", "stuck", "time")
SIGNS = ("withheld", "vanishing")


def judge(parts: list[Part], method: bool) -> list[dict[str, np.ndarray]]:
    """Per block its marks by frame: the reasons, or with ``method`` what the filter alone says."""
    m = assemble(parts)
    width = m.width
    spiky = [c for c in range(width) if c not in (VOICING, PITCH)]
    rows = (np.arange(len(parts))[:, None] * width + np.array(spiky, np.int64)[None, :]).ravel()
    held, sure = spikes(m.moving[rows], m.stats[rows]) if len(rows) else (np.zeros((0, m.raw.shape[1]), bool),) * 2
    by = lambda a, k: a.reshape(len(parts), k, -1).any(axis=1)
    held, sure = by(held, len(spiky)), by(sure, len(spiky))
    vanish, stuck = by(m.vanish, width), by(m.equal, width)
    out = []
    for i, p in enumerate(parts):
        col = p.frame - p.frame[0]
        if method:
            out.append({"withheld": held[i, col], "vanishing": vanish[i, col]})
            continue
        grid = line(p.frame, p.t0) if p.whole else p.grid
        ranged = np.zeros(len(col), bool)
        with np.errstate(invalid="ignore"):
            if p.vec.shape[1] > VOICING:
                ranged |= p.has[:, VOICING] & ((p.vec[:, VOICING] < 0) | (p.vec[:, VOICING] > 1))
            if p.vec.shape[1] > PITCH:
                ranged |= p.has[:, PITCH] & ((p.vec[:, PITCH] < 0) | (p.vec[:, PITCH] > MAX_PITCH))
            time = (p.t0 < 0) | (p.has1 & ~(p.t1 > p.t0))
            if grid:
                time |= np.isfinite(p.t0) & (np.abs(p.t0 - grid[0] * p.frame - grid[1]) > OFF_GRID_S)
            out.append({"not_finite": (p.has & ~np.isfinite(p.vec)).any(axis=1), "out_of_range": ranged, "spike": sure[i, col], "stuck": stuck[i, col], "time": time})
    return out


def counted(parts: list[Part]) -> tuple[list, ...]:
    """Counts of the measures of blocks: lists of item, statistic (component times kinds plus kind), bin, count."""
    m = assemble(parts)
    items, stats, bins, counts = [], [], [], []
    names = list({p.item: 0 for p in parts})
    code = {k: i for i, k in enumerate(names)}
    row = np.array([code[p.item] * m.width + c for p in parts for c in range(m.width)], np.int64)
    with np.errstate(all="ignore"):
        for kind, x in enumerate(measures(m.moving, m.own)):
            r, t = np.nonzero(~np.isnan(x))
            keys, n = np.unique((row[r] << 16) + binned(x[r, t]) + (1 << 15), return_counts=True)
            of = keys >> 16
            items += [names[i] for i in (of // m.width).tolist()]
            stats += ((of % m.width) * KINDS + kind).tolist()
            bins += ((keys & 0xFFFF) - (1 << 15)).tolist()
            counts += n.tolist()
    return items, stats, bins, counts


def together(batches, use):
    """Yields ``use(parts)`` of blocks of about equal length, ``CELLS`` cells at a time."""
    waiting: dict[int, list[Part]] = {}
    for table in groups(batches, ("item", "_block")):
        p = part(table)
        if p is None:
            continue
        size = p.steps.bit_length()
        own = waiting.setdefault(size, [])
        own.append(p)
        if len(own) << size >= CELLS:
            yield use(waiting.pop(size))
    for own in waiting.values():
        yield use(own)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows by block; a frame belongs to its block, and as margin to a neighbour's."""
    low = F.floor((F.col("frame") - MARGIN) / BLOCK)
    low = F.when(F.col("frame") >= 0, F.greatest(low, F.lit(0))).otherwise(low)  # there is nothing before frame 0 that a margin could serve
    return rows.withColumn("_block", F.explode(F.sequence(low, F.floor((F.col("frame") + MARGIN) / BLOCK))))


def _sorted(placed: DataFrame) -> DataFrame:
    return placed.repartition("item", "_block").sortWithinPartitions("item", "_block", "frame", F.col("_at").desc_nulls_last()).drop("_at")


def _heads(rows: DataFrame) -> DataFrame:
    """``item, frame, t0, t1, vec, _at, _block``: for each block of a source of several blocks a row with the source's statistics and grid."""
    at = F.floor(F.col("frame") / BLOCK)
    several = cut(rows.groupBy("item").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo < hi").select("item", "lo", "hi"), "several")
    long = rows.join(several.select("item"), "item", "left_semi")

    def use(parts):
        items, stats, bins, counts = counted(parts)
        k = len(items)
        f, t, step = [0.0] * k, [None] * k, [None] * k
        for p in parts:
            own = p.own
            g = line(p.frame[own], p.t0[own])
            mid = float(np.median(p.frame[own]))
            items.append(p.item), stats.append(-1), bins.append(p.number), counts.append(int(own.sum()))
            f.append(mid), t.append(g[0] * mid + g[1] if g else None), step.append(g[0] if g else None)
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(stats, pa.int32()), pa.array(bins, pa.int64()), pa.array(counts, pa.int64()), pa.array(f, pa.float64()), pa.array(t, pa.float64()), pa.array(step, pa.float64())], ["item", "stat", "bin", "n", "f", "t", "step"])

    seen = cut(_sorted(_placed(long)).mapInArrow(lambda b: together(b, use), "item string, stat int, bin bigint, n bigint, f double, t double, step double"), "measures")
    # quantiles: the least bin whose running count passes the rank; a source has a few thousand bins a statistic at most
    hist = seen.where("stat >= 0").groupBy("item", "stat", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("item", "stat")
    hist = hist.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "last": F.sum("n").over(w) - 1})
    kind = F.col("stat") % KINDS
    rank = lambda k: F.floor(F.col("last") * F.element_at(F.array(*(F.lit(s[k]) for s in SHARES)), kind + 1) + 0.5)
    value = lambda k: F.min(F.when(F.col("upto") > rank(k), F.col("bin")))
    both = hist.groupBy("item", "stat").agg(value(0).alias("a"), value(1).alias("b"))
    of = lambda c: F.when(F.col(c) == NOTHING, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (F.col(c) + 0.5) / BINS)).cast("float")
    entries = both.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("stat", F.array(of("a"), of("b"))))).alias("m"), F.max("stat").alias("top"))
    every = F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.coalesce(F.element_at("m", i), F.array(F.lit(float("nan")).cast("float"), F.lit(float("nan")).cast("float"))))
    entries = entries.select("item", F.flatten(every).alias("vec"))
    # the grid: steps within blocks, made finer by the steps from each block to one half the source's length further on
    blocks = seen.where("stat = -1").select("item", F.col("bin").alias("_block"), "n", "f", "t", "step")
    most = blocks.where("step is not null").groupBy("item").agg(F.max("n").alias("most"))
    full = blocks.join(most, "item").join(several, "item").where("step is not null and 2 * n >= most").select("item", "_block", "f", "t", "step", F.expr("greatest(1, (hi - lo + 1) div 2)").alias("apart"))
    first = full.groupBy("item").agg(F.percentile_approx("step", 0.5, 10000).alias("s0"))
    later = full.select("item", (F.col("_block") - F.col("apart")).alias("_block"), F.col("f").alias("f2"), F.col("t").alias("t2"))
    pairs = full.join(later, ["item", "_block"]).groupBy("item").agg(F.percentile_approx((F.col("t2") - F.col("t")) / (F.col("f2") - F.col("f")), 0.5, 10000).alias("s1"), F.count(F.lit(1)).alias("pairs"))
    finer = (F.col("pairs") >= 3) & (F.abs(F.col("s1") - F.col("s0")) * BLOCK < OFF_GRID_S / 2)
    steps = first.join(pairs, "item", "left").select("item", F.when(finer, F.col("s1")).otherwise(F.col("s0")).alias("step"))
    grid = full.drop("step").join(steps, "item").groupBy("item").agg(F.first("step").alias("t0"), F.percentile_approx(F.col("t") - F.col("step") * F.col("f"), 0.5, 10000).alias("t1"))
    own = cut(entries.join(grid, "item", "full_outer"), "sources")
    return blocks.select("item", "_block").join(own, "item").select("item", F.lit(None).cast("int").alias("frame"), "t0", "t1", F.coalesce("vec", F.array().cast("array<float>")).alias("vec"), F.lit(None).cast("timestamp_ntz").alias("_at"), "_block")


def _run(features: DataFrame, names: tuple[str, ...], method: bool) -> DataFrame:
    rows = features.where("item is not null and frame is not null").select(
        F.col("item").cast("string").alias("item"), F.col("frame").cast("int").alias("frame"), F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), F.col("vec").cast("array<float>").alias("vec"), F.col("ingested_at").cast("timestamp_ntz").alias("_at"),
    )

    def use(parts):
        items, frames, marks = [], [], {r: [] for r in names}
        for p, f in zip(parts, judge(parts, method)):
            some = p.own & np.logical_or.reduce([f[r] for r in names])
            items += [p.item] * int(some.sum())
            frames.append(p.frame[some])
            for r in names:
                marks[r].append(f[r][some])
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(np.concatenate(frames), pa.int32()), *(pa.array(np.concatenate(marks[r]), pa.bool_()) for r in names)], ["item", "frame", *names])

    every = _placed(rows).unionByName(_heads(rows))
    return _sorted(every).mapInArrow(lambda b: together(b, use), "item string, frame int, " + ", ".join(f"{r} boolean" for r in names))


def flags(features: DataFrame) -> DataFrame:
    """``item, frame`` and a BOOLEAN per reason, of every frame with a reason.

    Of several rows of one (item, frame) the one ingested last counts. Null readings, times and vectors are no
    reason by themselves; vectors may have any width, and items of several widths have the greatest; rows without item or frame are left out. Items of
    fewer than four frames can't have spikes, and of fewer than three no grid. Extra columns are ignored; an empty table gives no rows.
    """
    return _run(features, REASONS, False)


def innovations(features: DataFrame) -> DataFrame:
    """``item, frame, withheld, vanishing`` of every frame that the filter alone marks, without exact checks, ranges and grid: a reading withheld from
    the update by its standardised innovation, or innovations whose variance vanishes. Rows and cases as in ``flags``."""
    return _run(features, SIGNS, True)


def implausible(features: DataFrame) -> DataFrame:
    """``item, frame`` of every frame with a reason."""
    return flags(features).select("item", "frame")
