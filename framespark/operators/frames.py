"""Feature tables: one row per (item, frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.operators.blocks import windowed

KEYS = ["item", "frame"]


def subsample(features: DataFrame, every: int) -> DataFrame:
    """Frames 0, k, 2k, ..., numbered anew."""
    if not isinstance(every, int) or every < 1:
        raise ValueError(f"every must be a whole number from 1, not {every!r}")
    return features.where(F.col("frame") % every == 0).withColumn("frame", (F.col("frame") / every).cast("int"))


def cast(features: DataFrame, kind: str) -> DataFrame:
    return features.withColumns({"vec": F.col("vec").cast(f"array<{kind}>"), "t0": F.col("t0").cast(kind), "t1": F.col("t1").cast(kind)})


def validate(features: DataFrame) -> DataFrame:
    """Per item: ``frames, one_width, finite, sorted, valid``. Times must not decrease, those with an end by the end first."""


    def falling(d, w):
        t0, t1 = F.lag("t0").over(w), F.lag("t1").over(w)
        falls = F.when(F.col("t1").isNotNull(), (F.col("t1") < t1) | ((F.col("t1") == t1) & (F.col("t0") < t0))).otherwise(F.col("t0") < t0)
        return d.withColumn("_falls", F.coalesce(falls, F.lit(False)))

    d = windowed(features, 1, falling)
    finite = ~F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    out = d.groupBy("item").agg(
        F.count(F.lit(1)).alias("frames"), (F.min(F.size("vec")) == F.max(F.size("vec"))).alias("one_width"), F.bool_and(finite).alias("finite"), (~F.bool_or("_falls")).alias("sorted"),
    )
    return out.withColumn("valid", F.col("one_width") & F.col("finite") & F.col("sorted"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per item of either: whether both have the same frames, times and values."""
    return _compare(a, b, lambda x, y: x == y)


def is_close(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per item of either: ``close``: same frames, exactly the same times, values within ``atol + rtol |b|``."""
    return _compare(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y))


def _compare(a: DataFrame, b: DataFrame, same) -> DataFrame:
    y = b.select(*KEYS, F.col("t0").alias("_t0"), F.col("t1").alias("_t1"), F.col("vec").alias("_vec"))
    j = a.select(*KEYS, "t0", "t1", "vec").join(y, KEYS, "full_outer")
    values = (F.size("vec") == F.size("_vec")) & F.forall(F.zip_with("vec", "_vec", lambda p, q: F.coalesce(same(p, q), F.lit(False))), lambda v: v)
    ok = F.coalesce(values & F.col("t0").eqNullSafe(F.col("_t0")) & F.col("t1").eqNullSafe(F.col("_t1")), F.lit(False))
    return j.groupBy("item").agg(F.bool_and(ok).alias("close"))


def concatenate(a: DataFrame, b: DataFrame, tolerance: int = 0) -> DataFrame:
    """Columns of ``b`` pasted to those of ``a`` frame by frame. Items whose numbers of frames differ by more than ``tolerance`` are an error; the longer is cut at its end."""
    n = a.groupBy("item").agg(F.count(F.lit(1)).alias("_na")).join(b.groupBy("item").agg(F.count(F.lit(1)).alias("_nb")), "item", "full_outer")
    wrong = (F.abs(F.coalesce("_na", F.lit(0)) - F.coalesce("_nb", F.lit(0))) > tolerance) | F.col("_na").isNull() | F.col("_nb").isNull()
    # one row, broadcast: frames are not shuffled by item, where one may have a tenth of all
    n = n.where(wrong).agg(F.min("item").cast("string").alias("_wrong"))
    n = n.select(F.when(F.col("_wrong").isNotNull(), F.raise_error(F.concat(F.lit("too many frames on one side only, item "), F.col("_wrong"))).cast("boolean")).otherwise(F.lit(True)).alias("_fine"))
    y = b.select(*KEYS, F.col("vec").alias("_vec"))
    return a.join(y, KEYS).crossJoin(F.broadcast(n)).where("_fine").withColumn("vec", F.concat("vec", "_vec")).drop("_vec", "_fine")


def trim(features: DataFrame, voiced: DataFrame) -> DataFrame:
    """The frames marked in ``voiced(item, frame, voiced BOOLEAN)``."""
    if dict(voiced.dtypes)["voiced"] != "boolean":
        raise ValueError("voiced must be boolean")
    return features.join(voiced.select(*KEYS, "voiced"), KEYS).where("voiced").drop("voiced")


def partition(features: DataFrame, index: DataFrame) -> DataFrame:
    """Features with the ``part`` that ``index(item, part)`` gives each item; see ``undefined`` for items it doesn't."""
    return features.join(index, "item")


def undefined(features: DataFrame, index: DataFrame) -> DataFrame:
    """Items without a row in ``index``."""
    return features.select("item").distinct().join(index.select("item"), "item", "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: str = "item") -> DataFrame:
    """``key, side``: keys of one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def delta_taps(order: int, window: int) -> list[list[float]]:
    """Taps of derivatives 0 to ``order``: each is the one before convolved with ``j / sum j^2`` over ``-window..window``."""
    base = [j / sum(k * k for k in range(-window, window + 1)) for j in range(-window, window + 1)]
    taps = [[1.0]]
    for _ in range(order):
        last, new = taps[-1], [0.0] * (len(taps[-1]) + 2 * window)
        for i, a in enumerate(last):
            for j, b in enumerate(base):
                new[i + j] += a * b
        taps.append(new)
    return taps


def delta(features: DataFrame, order: int = 2, window: int = 2) -> DataFrame:
    """``vec`` followed by its derivatives; beyond an item's ends its first and last frames are repeated.

    The taps are applied to neighbouring rows: frames that are missing are no neighbours.
    """
    taps = delta_taps(order, window)
    reach = order * window
    names = {k: f"_n{k + reach}" for k in range(-reach, reach + 1)}

    def neighbours(d, w):
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first("vec").over(whole), F.last("vec").over(whole)
        return d.withColumns({n: F.col("vec") if not k else F.coalesce(F.lag("vec", -k).over(w), first) if k < 0 else F.coalesce(F.lead("vec", k).over(w), last) for k, n in names.items()})

    if not reach:
        return features.withColumn("vec", F.col("vec").cast("array<double>"))
    d = windowed(features, reach, neighbours)
    parts = [F.col("vec").cast("array<double>")]
    for t in taps[1:]:
        half = len(t) // 2
        parts.append(_weighted([(c, names[i - half]) for i, c in enumerate(t) if c]))
    return d.withColumn("vec", F.concat(*parts)).drop(*names.values())


def _weighted(terms: list[tuple[float, str]]) -> Column:
    """Sum of array columns with weights, element by element."""

    def one(i: Column) -> Column:
        total = F.lit(0.0)
        for c, n in terms:
            total = total + F.get(F.col(n), i).cast("double") * F.lit(c)
        return total

    return F.transform(F.sequence(F.lit(0), F.size("vec") - 1), one)


def vad(features: DataFrame, energy_threshold: float = 5.0, energy_mean_scale: float = 0.5, frames_context: int = 0, proportion_threshold: float = 0.6) -> DataFrame:
    """``item, frame, voiced`` (0 or 1): whether the share of frames within the context whose energy (column 0) is above the cut reaches the proportion.

    The cut is the threshold plus the scaled mean of the item's energy; near the ends the context is as long as there are frames.
    """
    mean = features.groupBy("item").agg(F.avg(F.get("vec", F.lit(0)).cast("double")).alias("_mean"))
    d = features.join(mean, "item").select("item", "frame", (F.get("vec", F.lit(0)).cast("double") > energy_threshold + energy_mean_scale * F.col("_mean")).cast("double").alias("_above"))
    if frames_context:
        c = frames_context
        d = windowed(d, c, lambda x, w: x.withColumn("_share", F.avg("_above").over(w.rowsBetween(-c, c)))).withColumn("_above", F.col("_share"))
    return d.select("item", "frame", (F.col("_above") >= proportion_threshold).cast("tinyint").alias("voiced"))


def interpolate_unvoiced(features: DataFrame, column: Column, voiced: Column, name: str = "filled") -> DataFrame:
    """``column`` at frames that are not voiced, on the line between the voiced neighbours; the ends hold the nearest."""
    w = Window.partitionBy("item").orderBy("frame")
    at = F.when(voiced, F.struct(F.col("frame").alias("f"), column.alias("v")))
    a = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = features.withColumn("_a", a).withColumn("_b", b)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("frame") - F.col("_a.f")) / F.greatest(F.col("_b.f") - F.col("_a.f"), F.lit(1))
    return d.withColumn(name, F.coalesce(line, "_a.v", "_b.v")).drop("_a", "_b")


def both_voiced(a: DataFrame, b: DataFrame) -> DataFrame:
    """``item, frame, voiced``: the frames that both masks mark; a frame of one mask only is marked by neither."""
    return a.select(*KEYS, "voiced").join(b.select(*KEYS, F.col("voiced").alias("_b")), KEYS).select(*KEYS, (F.col("voiced") & F.col("_b")).alias("voiced"))


def voiced_share(voiced: DataFrame) -> DataFrame:
    """``item, frames, share`` of the frames that ``voiced(item, frame, voiced)`` marks; null marks nothing."""
    return voiced.groupBy("item").agg(F.count(F.lit(1)).alias("frames"), F.avg(F.coalesce(F.col("voiced").cast("double"), F.lit(0.0))).alias("share"))


def voiced_segments(voiced: DataFrame) -> DataFrame:
    """``item, first, last, frames``: the runs of marked frames; a frame that isn't marked, or is missing, ends a run.

    Where a run begins is told by the row before, so only the beginnings are numbered by item, not the frames.
    """
    on = voiced.where("voiced").select(*KEYS)
    edges = windowed(on, 1, lambda d, w: d.withColumns({"_new": F.coalesce(F.lag("frame").over(w) != F.col("frame") - 1, F.lit(True)), "_end": F.coalesce(F.lead("frame").over(w) != F.col("frame") + 1, F.lit(True))}))
    ends = edges.where("_new or _end")
    # of beginnings and ends in order, an end follows its beginning at once
    paired = windowed(ends, 1, lambda d, w: d.withColumn("_last", F.when(F.col("_end"), F.col("frame")).otherwise(F.lead("frame").over(w))))
    return paired.where("_new").select("item", F.col("frame").alias("first"), F.col("_last").alias("last"), (F.col("_last") - F.col("frame") + 1).cast("int").alias("frames"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both collections' frames; an item of both is an error, raised when rows are read."""
    twice = a.select("item").distinct().join(b.select("item").distinct(), "item", "left_semi").agg(F.min("item").alias("_twice"))
    fine = twice.select(F.when(F.col("_twice").isNotNull(), F.raise_error(F.concat(F.lit("an item of both collections: "), F.col("_twice").cast("string"))).cast("boolean")).otherwise(F.lit(True)).alias("_fine"))
    return a.unionByName(b).crossJoin(F.broadcast(fine)).where("_fine").drop("_fine")


def shuffled(features: DataFrame, seed: int = 0) -> DataFrame:
    """Whole items in an order drawn by hash: ``place`` by item, the same on every run with one ``seed``. Frames stay in order within items."""
    return features.withColumn("place", F.xxhash64("item", F.lit(seed)))


def sample(features: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` frames without replacement: those with the least hashes, so tasks send ``n`` each and a run again draws the same. All frames if there are fewer."""
    if n < 1:
        raise ValueError(f"n must be at least 1, not {n}")
    return features.withColumn("_h", F.xxhash64("item", "frame", F.lit(seed))).orderBy("_h", "item", "frame").limit(n).drop("_h")


def collection_valid(features: DataFrame) -> DataFrame:
    """One row: ``items, valid, invalid`` (an item that isn't, if any): whether all items are and have one width."""
    each = validate(features)
    width = features.agg(F.min(F.size("vec")).alias("_lo"), F.max(F.size("vec")).alias("_hi"))
    every = each.agg(F.count(F.lit(1)).alias("items"), F.bool_and("valid").alias("_all"), F.min_by("item", F.col("valid").cast("int")).alias("_one"))
    return every.crossJoin(F.broadcast(width)).select("items", (F.col("_all") & (F.col("_lo") == F.col("_hi"))).alias("valid"), F.when(~F.col("_all"), F.col("_one")).alias("invalid"))


def collection_close(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: ``items, close``: whether both have the same items and all are close."""
    return is_close(a, b, rtol, atol).agg(F.count(F.lit(1)).alias("items"), F.bool_and("close").alias("close"))
