"""Oversized signals cut into pieces at natural boundaries, by bounded-quantifier regular expressions.

A signal becomes a text with a letter per hop (a millisecond, or a sample where those are longer):
``q`` where it stays at its own background, ``s`` elsewhere. Expressions over that text find quiet stretches,
in which a click of a few letters changes nothing, and mark pauses: ``M`` in their middle, ``P`` elsewhere.
One expression then cuts: its alternatives, ordered by the strength of the boundary, consume up to the
limit with single letters as the last resort. Array functions turn lengths into places and look
back for the overlap. Only the letters need Python; they are made in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespark.sources.views import once

LIMIT_S, OVERLAP_S, PAUSE_S = 4.0, 0.2, 0.25
#: Letters: the longest click, and the shortest quiet on either side of one, in seconds.
CLICK_LETTERS, CALM_S = 5, 0.02
#: Background: the window in which its scatter is sought; how many scatters it may reach.
WINDOW_S, REACH = 0.06, 5.0
#: A background is there if the loud (all but a fiftieth of the windows are below it) exceeds the least scatter so many times.
CONTRAST = 13.0
#: One step of the samples by dtype.
STEP = {"int16": 1.0, "int32": 1.0, "float32": 2.0**-15, "float64": 2.0**-15}


def letters(x: np.ndarray, rate: int, dtype: str | None) -> str:
    """The text of one signal; '' for an empty one. Samples that are not finite are loud."""
    n = len(x)
    if not n:
        return ""
    hop = max(1, rate // 1000)
    fine = np.isfinite(x)
    x = np.where(fine, x, 0.0)
    k = max(2, min(n, int(rate * WINDOW_S)))
    if n < k:
        return "s" * -(-n // hop)
    y = x - x[fine].mean() if fine.any() else x
    one = np.concatenate([[0.0], np.cumsum(y)])
    two = np.concatenate([[0.0], np.cumsum(y * y)])
    mean = (one[k:] - one[:-k]) / k
    scatter = np.sqrt(np.maximum((two[k:] - two[:-k]) / k - mean * mean, 0.0))
    least = scatter.min()
    loud = np.percentile(scatter, 98)
    if loud < CONTRAST * least:  # speech throughout, or no speech
        return "s" * -(-n // hop)
    step = STEP.get(dtype or "", 2.0**-15)
    near = np.flatnonzero(scatter <= max(2.2 * least, 0.5 * step))
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, near, 1)
    np.add.at(inside, near + k, -1)
    calm = y[np.cumsum(inside[:-1]) > 0]
    rest = np.median(calm)
    sigma = max(np.median(np.abs(calm - rest)) / 0.6745, least)
    bound = max(REACH * sigma, min(2.5 * step, 0.07 * loud))
    high = (np.abs(y - rest) > bound) | ~fine
    if hop > 1:
        high = np.logical_or.reduceat(high, np.arange(0, n, hop))
    return np.where(high, ord("s"), ord("q")).astype(np.uint8).tobytes().decode("ascii")


def lettered(signals: DataFrame, key: str, keep: tuple[str, ...] = (), longer_than: float | None = None) -> DataFrame:
    """``key, keep..., rate (letters a second), hop, n, text`` of each signal with samples and a positive rate, of those longer than ``longer_than`` s."""
    rows = signals.where("samples is not null and size(samples) > 0 and sample_rate > 0")
    if longer_than is not None:
        rows = rows.where(F.size("samples") > F.lit(longer_than) * F.col("sample_rate"))
    rows = rows.select(key, *keep, F.col("sample_rate").cast("int").alias("_r"), F.col("dtype").alias("_d"), F.col("samples").cast("array<double>").alias("_x"))
    lead = 1 + len(keep)

    def run(batches):
        for batch in batches:
            lists = batch.column(lead + 2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            rates, kinds = batch.column(lead).to_pylist(), batch.column(lead + 1).to_pylist()
            texts = [letters(flat[a:b], r, k) for a, b, r, k in zip(at, at[1:], rates, kinds)]
            hops = [max(1, r // 1000) for r in rates]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(lead)), pa.array([r / h for r, h in zip(rates, hops)], pa.float64()), pa.array(hops, pa.int32()), pa.array(np.diff(at), pa.int64()), pa.array(texts, pa.string())],
                [*names, "rate", "hop", "n", "text"],
            )

    names = [key, *keep]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, rate double, hop int, n bigint, text string")


def _calm(rate: Column) -> Column:
    least = F.greatest(F.ceil(rate * CALM_S), F.lit(2)).cast("int").cast("string")
    # a single letter or two may be the background's own tail, so little quiet is asked for after those
    return F.concat(F.lit("q{"), least, F.lit(f",}}+(?:s{{1,2}}+q{{3,}}+|s{{1,{CLICK_LETTERS}}}+q{{"), least, F.lit(",}+)*+"))


def quiet(text: DataFrame) -> DataFrame:
    """Adds ``rest`` (the stretches between quiet ones, one more than those) and ``runs``: array of (len, pause)."""
    d = text.withColumn("_q", _calm(F.col("rate")))
    d = d.withColumn("_runs", F.regexp_extract_all("text", "_q", F.lit(0))).withColumn("rest", F.expr("split(text, _q, -1)"))
    d = d.withColumn("_lens", F.transform("_runs", F.length))
    voiced = lambda x: F.length(F.replace(x, F.lit("q"), F.lit(""))) > CLICK_LETTERS
    d = d.withColumn("_first", voiced(F.element_at("rest", 1))).withColumn("_last", voiced(F.element_at("rest", -1)))
    count = F.size("_runs")
    run = lambda n, i: F.struct(n.alias("len"), ((n >= F.col("rate") * PAUSE_S) & (F.col("_first") | (i > 0)) & (F.col("_last") | (i < count - 1))).alias("pause"))
    return d.withColumn("runs", F.transform("_lens", run)).drop("_q", "_runs", "_lens", "_first", "_last")


def found_pauses(signals: DataFrame, key: str = "signal_id") -> DataFrame:
    """``key, pause_no`` of signals longer than the limit: 0, and 1, 2, ... for their pauses in time. Repeated rows repeat."""
    d = quiet(lettered(signals, key, longer_than=LIMIT_S))
    pauses = F.size(F.filter("runs", lambda r: r["pause"]))
    return d.select(key, F.explode(F.sequence(F.lit(0), pauses)).alias("pause_no"))


def cutting(limit: int | Column, least: int | Column) -> Column:
    """The expression that cuts: the rest if it fits; else up to ``limit`` letters ending in a pause's middle, a pause, a calm; else ``limit`` letters."""
    most, few = limit.cast("string"), least.cast("string")
    before = (limit - 1).cast("string")
    parts = [F.lit(".{1,"), most, F.lit(r"}\z")]
    for letter in ("M", "P", "q"):
        parts += [F.lit("|.{"), few, F.lit(","), before, F.lit(f"}}{letter}")]
    return F.concat(*parts, F.lit("|.{1,"), most, F.lit("}"))


#: Numbers whose running sum is one step of ``running``.
STRIDE = 256


def running(d: DataFrame, lengths: str, name: str) -> DataFrame:
    """Adds ``name``: the running sums of an array of numbers, by stretches of ``STRIDE`` and then over these, for an array is copied each time it grows."""
    grown = lambda a: F.aggregate(a, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_within", F.transform(starts, lambda i: grown(F.slice(lengths, i, STRIDE))))
    d = d.withColumn("_before", grown(F.transform("_within", lambda w: F.element_at(w, -1))))
    return d.withColumn(name, F.flatten(F.transform("_within", lambda w, i: F.transform(w, lambda n: n + F.when(i > 0, F.get("_before", i - 1)).otherwise(F.lit(0)))))).drop("_within", "_before")


def pieces(signals: DataFrame, key: str = "signal_id", keep: tuple[str, ...] = (), limit_s: float = LIMIT_S, overlap_s: float = OVERLAP_S) -> DataFrame:
    """``key, keep..., piece_no, start, stop, boundary`` (samples, ``stop`` exclusive) of every signal with samples.

    A signal within the limit is one piece. Each later piece starts ``overlap_s`` before the end of the one before it, and none is
    longer than ``limit_s``. ``boundary`` says where a piece ends: pause, calm, forced or end. Null and empty samples give no piece;
    repeated rows give their pieces once per row.
    """
    d = quiet(lettered(signals, key, keep)).withColumn("_pauses", F.filter("runs", lambda r: r["pause"] | (r["len"] >= F.col("rate") * PAUSE_S)))
    shown = lambda r: F.when(r["len"] >= F.col("rate") * PAUSE_S, F.concat(F.repeat(F.lit("P"), F.floor(r["len"] / 2).cast("int")), F.lit("M"), F.repeat(F.lit("P"), (r["len"] - F.floor(r["len"] / 2) - 1).cast("int")))).otherwise(F.repeat(F.lit("q"), r["len"]))
    # speech is written with s alone, so that q marks calm stretches only
    marked = F.concat(
        F.array_join(F.transform("runs", lambda r, i: F.concat(F.repeat(F.lit("s"), F.length(F.element_at("rest", i + 1))), shown(r))), ""),
        F.repeat(F.lit("s"), F.length(F.element_at("rest", -1))),
    )
    d = d.withColumn("_marked", marked)
    most = F.floor(F.col("rate") * F.lit(limit_s)).cast("int")
    back = F.floor(F.col("rate") * F.lit(overlap_s)).cast("int")
    room = F.greatest(most - back, F.lit(1))
    cut_ = F.regexp_extract_all("_marked", cutting(room, F.greatest(F.floor(room / 4).cast("int"), F.lit(1))), F.lit(0))
    d = d.withColumn("_cut", F.when(F.length("_marked") <= most, F.array("_marked")).otherwise(cut_))
    d = d.select(key, *keep, "n", "hop", back.alias("_back"), F.transform("_cut", F.length).alias("_len"), F.transform("_cut", lambda t: F.substring(t, -1, 1)).alias("_by"))
    d = running(d, "_len", "_end")
    at = F.posexplode(F.arrays_zip(F.col("_end").alias("e"), F.col("_len").alias("l"), F.col("_by").alias("b")))
    d = d.select(key, *keep, "n", "hop", "_back", F.size("_end").alias("_count"), at.alias("piece_no", "_p"))
    start = F.greatest(F.col("_p.e") - F.col("_p.l") - F.when(F.col("piece_no") > 0, F.col("_back")).otherwise(0), F.lit(0)).cast("bigint") * F.col("hop")
    boundary = F.when(F.col("piece_no") == F.col("_count") - 1, "end").when(F.col("_p.b").isin("M", "P"), "pause").when(F.col("_p.b") == "q", "calm").otherwise("forced")
    return d.select(key, *keep, "piece_no", start.alias("start"), F.least(F.col("_p.e").cast("bigint") * F.col("hop"), F.col("n")).alias("stop"), boundary.alias("boundary"))


def piece_samples(signals: DataFrame, key: str = "signal_id") -> DataFrame:
    """Pieces with their samples: ``key, audio_file, sample_rate, piece_no, start, stop, boundary, samples``. Equal rows count once."""
    rows = once(signals.select(key, "audio_file", "sample_rate", "dtype", "samples"), key).where("samples is not null and size(samples) > 0")
    plan = pieces(rows.withColumn("_keep", F.struct("audio_file", F.col("sample_rate").alias("sample_rate"), F.col("samples").alias("samples"))), key, ("_keep",))
    return plan.select(key, "_keep.audio_file", "_keep.sample_rate", "piece_no", "start", "stop", "boundary", F.slice("_keep.samples", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("samples"))
