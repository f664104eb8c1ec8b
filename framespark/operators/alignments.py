"""Alignments: labelled intervals of an item, ``item, onset, offset_s, token``; and one-hot features of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.operators.signals import nframes, window


def validate(ali: DataFrame) -> DataFrame:
    """Per item: ``tokens, ordered, contiguous, valid``: onsets before offsets, and each offset the next onset exactly. An alignment is an item's; its window is the item."""
    w = Window.partitionBy("item").orderBy("onset", "offset_s", "token")
    d = ali.withColumn("_next", F.lead("onset").over(w))
    out = d.groupBy("item").agg(
        F.count(F.lit(1)).alias("tokens"), F.bool_and(F.col("onset") < F.col("offset_s")).alias("ordered"), F.bool_and(F.coalesce(F.col("_next") == F.col("offset_s"), F.lit(True))).alias("contiguous"),
    )
    return out.withColumn("valid", F.col("ordered") & F.col("contiguous"))


def clip(ali: DataFrame, start: float, stop: float) -> DataFrame:
    """Tokens that overlap ``start`` to ``stop`` seconds, cut to it."""
    d = ali.where((F.col("offset_s") > start) & (F.col("onset") < stop) & F.lit(start < stop))
    return d.withColumns({"onset": F.greatest("onset", F.lit(start)), "offset_s": F.least("offset_s", F.lit(stop))})


def at_rate(ali: DataFrame, rate: float) -> DataFrame:
    """``item, i, token``: the token active at ``first onset + i / rate``; the interval is half open, and where several overlap the least token counts.

    Each interval yields its own instants: no join of instants with intervals.
    """
    first = ali.groupBy("item").agg(F.min("onset").alias("_t0"))
    d = ali.join(first, "item")
    a, b = F.ceil((F.col("onset") - F.col("_t0")) * rate - 1e-6), F.ceil((F.col("offset_s") - F.col("_t0")) * rate - 1e-6)
    d = d.where(b > a).withColumn("i", F.explode(F.sequence(a, b - 1)))
    return d.groupBy("item", "i").agg(F.min("token").alias("token"))


def durations(ali: DataFrame) -> DataFrame:
    """``item, duration``: last offset less first onset."""
    return ali.groupBy("item").agg((F.max("offset_s") - F.min("onset")).alias("duration"))


def inventory(ali: DataFrame) -> DataFrame:
    """``token, idx``: all tokens in order, numbered densely. Tokens are an inventory of symbols, hence few."""
    tokens = ali.select("token").where("token is not null").distinct()
    return tokens.withColumn("idx", F.row_number().over(Window.orderBy("token")) - 1)


def undefined_tokens(ali: DataFrame, tokens: list[str]) -> DataFrame:
    known = ali.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    return ali.select("token").distinct().join(known, "token", "left_anti")


def one_hot(ali: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """``item, frame, t0, t1, vec``: a row per token with a BOOLEAN for each of the inventory. A token that is not in it is an error."""
    inv = tokens if tokens is not None else inventory(ali)
    size = inv.count()
    if size > 100_000:
        raise ValueError("one-hot vectors of more than 100,000 tokens")
    w = Window.partitionBy("item").orderBy("onset", "offset_s", "token")
    d = ali.select("item", "onset", "offset_s", "token").join(F.broadcast(inv), "token", "left").withColumn("frame", F.row_number().over(w) - 1)
    at = F.coalesce("idx", F.raise_error(F.concat(F.lit("some tokens are undefined: "), "token")).cast("int"))
    return d.select("item", "frame", F.col("onset").alias("t0"), F.col("offset_s").alias("t1"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i == at).alias("vec"))


def framed_one_hot(ali: DataFrame, rate: int = 16000, shift_s: float = 0.01, length_s: float = 0.025, kind: str = "povey", tokens: DataFrame | None = None) -> DataFrame:
    """``item, frame, token, idx``: of each frame of the alignment sampled at ``rate`` the token with the greatest weight under a window; of equals the one met first.

    An interval makes a row per frame it touches, not per sample: its weight there is a difference of two entries of the window's running sum. Where intervals
    overlap, a frame is cut at their ends and the least token of each part counts. One shuffle, by (item, frame).
    """
    inv = tokens if tokens is not None else inventory(ali)
    shift, length = int(rate * shift_s + 1e-9), int(rate * length_s + 1e-9)
    running = F.array(*(F.lit(float(v)) for v in np.concatenate([[0.0], np.cumsum(window(length, kind))])))
    first = ali.groupBy("item").agg(F.min("onset").alias("_t0"))
    sample = lambda c: F.ceil((F.col(c) - F.col("_t0")) * float(rate) - 1e-6)
    d = ali.join(first, "item").select("item", "token", sample("onset").alias("_a"), sample("offset_s").alias("_b")).where("_b > _a")
    n = d.groupBy("item").agg(nframes(F.max("_b").cast("int"), F.lit(length), F.lit(shift)).alias("_n"))
    lo = F.greatest(F.ceil((F.col("_a") - length + 1) / shift), F.lit(0))
    hi = F.least(F.floor((F.col("_b") - 1) / shift), F.col("_n") - 1)
    d = d.join(n, "item").where(hi >= lo).withColumn("frame", F.explode(F.sequence(lo, hi)))
    inside = lambda c: F.least(F.greatest(F.col(c) - F.col("frame") * shift, F.lit(0)), F.lit(length)).cast("int")
    d = d.groupBy("item", "frame").agg(F.collect_list(F.struct(inside("_a").alias("a"), inside("_b").alias("b"), F.col("token").alias("t"))).alias("_in"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform("_in", lambda x: x["a"]), F.transform("_in", lambda x: x["b"]))))
    d = d.withColumn("_cuts", cuts)
    here = lambda i: F.array_min(F.transform(F.filter("_in", lambda x: (x["a"] <= F.get("_cuts", i)) & (x["b"] > F.get("_cuts", i))), lambda x: x["t"]))
    parts = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), lambda i: F.struct(F.get("_cuts", i).alias("a"), F.get("_cuts", i + 1).alias("b"), here(i).alias("t")))
    d = d.where(F.size("_cuts") > 1).select("item", "frame", F.explode(parts).alias("_p")).where("_p.t is not null")
    w = F.element_at(running, F.col("_p.b") + 1) - F.element_at(running, F.col("_p.a") + 1)
    votes = d.groupBy("item", "frame", F.col("_p.t").alias("token")).agg(F.sum(w).alias("w"), F.min("_p.a").alias("i"))
    best = votes.groupBy("item", "frame").agg(F.max_by("token", F.struct(F.round("w", 9).alias("w"), (-F.col("i")).alias("i"))).alias("token"))
    return best.join(F.broadcast(inv), "token").select("item", F.col("frame").cast("int").alias("frame"), "token", "idx")
