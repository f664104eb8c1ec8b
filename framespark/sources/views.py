"""The domain tables without repeats and unusable rows, as the operators take them; and the same as SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.functions.identity import file_key, holding_rows, speaker_key
from framespark.plans.cuts import cut
from framespark.sources.tables import table


def once(df: DataFrame, key: str) -> DataFrame:
    """``df``, read from files, with one row of each ``key`` (of rows alike in it the first by file and place); null is a key.

    Only keys and places of rows are shuffled, not the rows: the places of the repeats, which are few, are written and joined against.
    """
    try:
        placed = df.withColumn("_place", F.struct("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:  # not read from files
        return df.dropDuplicates([key])
    first = placed.select(key, "_place").groupBy(key).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    keys = first.select(F.col(key).alias("_key"), "_first")
    again = placed.select(key, "_place").join(keys, F.col(key).eqNullSafe(F.col("_key"))).where("_place != _first").select("_place")
    return placed.join(cut(again, "repeats"), "_place", "left_anti").drop("_place")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """``signal_id, item, audio_file, sample_rate, dtype, samples``: one row per signal that has samples."""
    rows = once(table(spark, d, "signals"), "signal_id").where("samples is not null and size(samples) > 0")
    return rows.select("signal_id", "item", "audio_file", "sample_rate", "dtype", "samples")


def latest(spark: SparkSession, d: str) -> DataFrame:
    """``item, frame, t0, t1, vec``: the row of each frame ingested last."""
    best = F.max_by(F.struct("t0", "t1", "vec"), "ingested_at").alias("b")
    return table(spark, d, "features").groupBy("item", "frame").agg(best).select("item", "frame", "b.t0", "b.t1", "b.vec")


def features(spark: SparkSession, d: str) -> DataFrame:
    """``latest``, of frames whose values are all finite."""
    return latest(spark, d).where(~F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """``item, idx, onset, offset_s, token``, each row once."""
    return table(spark, d, "alignments").select("item", "idx", "onset", "offset_s", "token").distinct()


def utterances(spark: SparkSession, d: str) -> DataFrame:
    """``utt_id, name, audio_file, speaker, tstart, tstop, duration`` of the holding rows, keys made alike."""
    rows = holding_rows(table(spark, d, "utterances"), "name", "audio_file", "speaker", "tstart", "tstop", "duration")
    return rows.withColumns({"audio_file": file_key(F.col("audio_file")), "speaker": speaker_key(F.col("speaker"))})


def audio_meta(spark: SparkSession, d: str) -> DataFrame:
    """``file, nchannels, sample_rate, nsamples, duration``: of rows for one file the one with the greatest ``audio_id``; a wrong or missing duration from the samples."""
    cols = ["nchannels", "sample_rate", "nsamples"]
    best = F.max_by(F.struct(*cols), "audio_id").alias("b")
    rows = table(spark, d, "audio_meta").groupBy("file").agg(best).select("file", *(F.col(f"b.{c}").alias(c) for c in cols))
    return rows.withColumn("duration", F.col("nsamples") / F.col("sample_rate"))


SIG = "sig AS (SELECT signal_id, any_value(item) AS item, any_value(audio_file) AS audio_file, any_value(sample_rate) AS sample_rate, any_value(dtype) AS dtype, any_value(samples) AS samples FROM signals WHERE samples IS NOT NULL AND len(samples) > 0 GROUP BY signal_id)"
ALL = "fea AS (SELECT item, frame, t0, t1, vec FROM (SELECT *, row_number() OVER (PARTITION BY item, frame ORDER BY ingested_at DESC) AS r FROM features) WHERE r = 1)"
FEA = "fea AS (SELECT item, frame, t0, t1, vec FROM (SELECT *, row_number() OVER (PARTITION BY item, frame ORDER BY ingested_at DESC) AS r FROM features) WHERE r = 1 AND len(list_filter(vec, lambda x: NOT isfinite(x))) = 0)"
ALI = "ali AS (SELECT DISTINCT item, idx, onset, offset_s, token FROM alignments)"
META = "meta AS (SELECT file, max_by(nchannels, audio_id) AS nchannels, max_by(sample_rate, audio_id) AS sample_rate, max_by(nsamples, audio_id) AS nsamples, max_by(nsamples, audio_id) / max_by(sample_rate, audio_id) AS duration FROM audio_meta GROUP BY file)"
_NOBODY = "('', 'anonymous', 'na', 'nan', 'nil', 'nobody', 'none', 'null', 'speaker', 'undefined', 'unk', 'unknown', 'unknownspeaker')"
#: The oracle's paths are made alike by as many passes over ``x/..`` as these tables need.
UTT = rf"""held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY ingested_at DESC) AS r FROM utterances) WHERE r = 1),
keyed AS (SELECT utt_id, name, tstart, tstop, duration, regexp_replace(lower(speaker), '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g') AS s,
  regexp_replace(regexp_replace(replace(trim(audio_file), '\', '/'), '/(\./|/)+', '/', 'g'), '^\./', '') AS f FROM held),
utt AS (SELECT utt_id, name, regexp_replace(f, '[^/]+/\.\./', '', 'g') AS audio_file, CASE WHEN s NOT IN {_NOBODY} THEN s END AS speaker, tstart, tstop, duration FROM keyed)"""
