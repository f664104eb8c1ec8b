"""Streams of frames: running normalisation and band-pass filtering with state per item, and windows over event time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "last_frame bigint, count double, s1 array<double>, s2 array<double>"


def running_cmvn(frames: DataFrame, norm_vars: bool = True, timeout_s: int = 3600) -> DataFrame:
    """``item, frame, vec`` of a stream of frames: each less the mean (by the deviation) of the item's frames so far.

    Frames of an item come in order within and between batches; one that isn't after the last seen is a repeat and is left out. State that has been idle
    for ``timeout_s`` is dropped.
    """

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, n, s1, s2 = state.get if state.exists else (-1, 0.0, None, None)
        rows = pd.concat(list(pdfs)).sort_values("frame")
        out = []
        for frame, vec in zip(rows["frame"], rows["vec"]):
            if frame <= last:
                continue
            x = np.asarray(vec, float)
            s1 = x.copy() if s1 is None else np.asarray(s1) + x
            s2 = x * x if s2 is None else np.asarray(s2) + x * x
            n, last = n + 1, int(frame)
            mean = s1 / n
            y = x - mean
            if norm_vars:
                y = y / np.sqrt(np.maximum(s2 / n - mean * mean, 1e-10))
            out.append((key[0], last, y.tolist()))
        if s1 is not None:
            state.update((last, float(n), list(map(float, s1)), list(map(float, s2))))
            state.setTimeoutDuration(timeout_s * 1000)
        yield pd.DataFrame(out, columns=["item", "frame", "vec"])

    kind = frames.schema["item"].dataType.simpleString()
    d = frames.select("item", F.col("frame").cast("bigint").alias("frame"), F.col("vec").cast("array<double>").alias("vec"))
    return d.groupBy("item").applyInPandasWithState(step, f"item {kind}, frame bigint, vec array<double>", STATE, "append", "ProcessingTimeTimeout")


def running_rasta(frames: DataFrame, timeout_s: int = 3600) -> DataFrame:
    """``item, frame, vec``: the band-pass filter over log energies, its state (four frames, and the last output) kept between batches."""

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, past, out_ = state.get if state.exists else (-1, 0, [], [])
        past = [np.asarray(p) for p in past]
        rows = pd.concat(list(pdfs)).sort_values("frame")
        out, prior = [], np.asarray(out_) if len(out_) else None
        for frame, vec in zip(rows["frame"], rows["vec"]):
            if frame <= last:
                continue
            x = np.asarray(vec, float)
            last, seen = int(frame), seen + 1
            if seen <= 4:
                y = np.zeros_like(x)
            else:
                y = 0.2 * x + 0.1 * past[-1] - 0.1 * past[-3] - 0.2 * past[-4] + 0.94 * (prior if prior is not None else 0.0)
                prior = y
            past = [*past, x][-4:]
            out.append((key[0], last, y.tolist()))
        state.update((last, seen, [p.tolist() for p in past], prior.tolist() if prior is not None else []))
        state.setTimeoutDuration(timeout_s * 1000)
        yield pd.DataFrame(out, columns=["item", "frame", "vec"])

    kind = frames.schema["item"].dataType.simpleString()
    d = frames.select("item", F.col("frame").cast("bigint").alias("frame"), F.col("vec").cast("array<double>").alias("vec"))
    return d.groupBy("item").applyInPandasWithState(step, f"item {kind}, frame bigint, vec array<double>", "last_frame bigint, seen bigint, past array<array<double>>, out array<double>", "append", "ProcessingTimeTimeout")


def event_frames(events: DataFrame, time: str = "ts", key: str = "user_id", value: str = "value", length: str = "60 minutes", shift: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Frames of an event stream: count, mean and energy by key and sliding window, with a watermark for late events."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    v = F.col(value).cast("double")
    g = d.groupBy(key, F.window(time, length, shift))
    return g.agg(F.count(value).alias("n"), F.avg(v).alias("mean"), F.sum(v * v).alias("energy")).select(key, F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), "n", "mean", "energy")
