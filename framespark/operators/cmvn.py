"""Mean and variance normalisation: global, per group, weighted, and sliding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespark.operators.blocks import blocked, groups, matrix, vectors

FLOOR = 1e-20


def accumulate(features: DataFrame, by: list[str] | None = None, weight: str | None = None, vec: str = "vec") -> DataFrame:
    """``by..., dim, count, s1, s2``: weighted count, sum and sum of squares of each component. Partial sums, so the shuffle has a row per group, component and task."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = features.select(*(by or []), w.alias("_w"), F.posexplode(vec).alias("dim", "_x"))
    x = F.col("_x").cast("double")
    return d.groupBy(*(by or []), "dim").agg(F.sum("_w").alias("count"), F.sum(F.col("_w") * x).alias("s1"), F.sum(F.col("_w") * x * x).alias("s2"))


def merge(*stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of the union of what several sets of statistics are of."""
    both = stats[0]
    for s in stats[1:]:
        both = both.unionByName(s)
    return both.groupBy(*(by or []), "dim").agg(*(F.sum(c).alias(c) for c in ("count", "s1", "s2")))


def arrays(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by..., count, mean, std``: arrays in the order of components, population deviations with a floor on the variance. An error for less than one frame."""
    group = F.concat_ws(", ", *(F.col(c).cast("string") for c in by)) if by else F.lit("all")
    few = F.raise_error(F.concat(F.lit("no statistics to normalise "), group, F.lit(" by: weights add up to "), F.col("count").cast("string"), F.lit(", under 1"))).cast("double")
    n = F.when(F.col("count") >= 1.0, F.col("count")).otherwise(few)
    mean = F.col("s1") / n
    var = F.greatest(F.col("s2") / n - mean * mean, F.lit(FLOOR))
    rows = stats.select(*(by or []), "count", F.struct("dim", mean.alias("m"), F.sqrt(var).alias("s")).alias("_v"))
    d = rows.groupBy(*(by or [])).agg(F.max("count").alias("count"), F.sort_array(F.collect_list("_v")).alias("_all"))
    return d.select(*(by or []), "count", F.transform("_all", lambda v: v["m"]).alias("mean"), F.transform("_all", lambda v: v["s"]).alias("std"))


def _apply(vec: str, norm_vars: bool, reverse: bool, skip: tuple[int, ...]) -> Column:
    def one(x: Column, i: Column) -> Column:
        m, s = F.get("mean", i), F.get("std", i)
        x = x.cast("double")
        y = (x * s + m if norm_vars else x + m) if reverse else ((x - m) / s if norm_vars else x - m)
        return F.when(i.isin(*skip), x).otherwise(y) if skip else y

    return F.transform(vec, one)


def normalise(features: DataFrame, stats: DataFrame, by: list[str] | None = None, norm_vars: bool = True, skip_dims: tuple[int, ...] = (), reverse: bool = False, vec: str = "vec") -> DataFrame:
    """Features less the mean, by the deviation, of their group; or the way back."""
    table = arrays(stats, by)
    if by:
        joined = features.join(table, by)
    else:  # one row of statistics, broadcast
        joined = features.withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return joined.withColumn(vec, _apply(vec, norm_vars, reverse, skip_dims)).drop("count", "mean", "std")


def cmvn(features: DataFrame, by: list[str] | None = None, norm_vars: bool = True, skip_dims: tuple[int, ...] = (), weight: str | None = None) -> DataFrame:
    return normalise(features, accumulate(features, by, weight), by, norm_vars, skip_dims)


def windows(frame: np.ndarray, low: np.ndarray, high: np.ndarray, center: bool, window: int, min_window: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the window of frame numbers for each frame of an item whose frames are in ``low`` to ``high`` (exclusive)."""
    if center:
        begin = frame - window // 2
        end = begin + window
        short = begin < low
        begin, end = np.where(short, low, begin), np.where(short, low + window, end)
        over_ = end > high
        begin = np.where(over_, np.maximum(begin - (end - high), low), begin)
        return begin, np.minimum(end, high)
    begin = np.maximum(frame + 1 - window, low)
    end = frame + 1
    few = end - low < min_window
    return np.where(few, low, begin), np.where(few, np.minimum(low + min_window, high), end)


def sliding(features: DataFrame, center: bool = True, window: int = 600, min_window: int = 100, norm_vars: bool = False) -> DataFrame:
    """``item, frame, vec``: less the mean (by the deviation) of a window of frames around each, or of those up to it.

    Windows are of frame numbers and have their full length wherever an item is long enough: at its ends they are shifted
    inward; a causal window starts with ``min_window`` frames. Items are cut into blocks with a margin of two windows; in a block
    any window's sum is a difference of two running sums.
    """
    if window < 1:
        raise ValueError("window must be positive")
    kind = features.schema["item"].dataType.simpleString()
    ends = features.groupBy("item").agg(F.min("frame").alias("_lo"), (F.max("frame") + 1).alias("_hi"))
    d = blocked(features.select("item", "frame", "vec").join(ends, "item"), 2 * max(window, min_window) + 1)
    d = d.repartition("item", "_block").sortWithinPartitions("item", "_block", "frame")

    def run(batches):
        for t in groups(batches, ("item", "_block")):
            x, frame = matrix(t.column("vec")), t.column("frame").to_numpy()
            mine = t.column("_own").to_numpy(zero_copy_only=False)
            if not mine.any():
                continue
            base = x.mean(axis=0)  # sums about the block's mean keep their digits
            y = x - base
            one = np.vstack([np.zeros(x.shape[1]), np.cumsum(y, axis=0)])
            begin, end = windows(frame, t.column("_lo").to_numpy(), t.column("_hi").to_numpy(), center, window, min_window)
            a, b = np.searchsorted(frame, begin), np.searchsorted(frame, end)
            n = np.maximum(b - a, 1)[:, None]
            mean = (one[b] - one[a]) / n
            out = y - mean
            if norm_vars:
                two = np.vstack([np.zeros(x.shape[1]), np.cumsum(y * y, axis=0)])
                out = out / np.sqrt(np.maximum((two[b] - two[a]) / n - mean * mean, 1e-10))
            rows = t.filter(pa.array(mine))
            yield pa.RecordBatch.from_arrays([rows.column("item").combine_chunks(), rows.column("frame").combine_chunks(), vectors(out[mine])], ["item", "frame", "vec"])

    return d.mapInArrow(run, f"item {kind}, frame int, vec array<double>")
