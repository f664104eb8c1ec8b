"""The index of utterances: groups, totals, checks, and a fixed duration per speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_speaker(utts: DataFrame) -> DataFrame:
    """Per speaker: ``utterances, files, duration``. Utterances without a speaker are left out; see ``without_speaker``."""
    d = utts.where("speaker is not null")
    return d.groupBy("speaker").agg(F.count(F.lit(1)).alias("utterances"), F.count_distinct("audio_file").alias("files"), F.sum(F.col("duration").cast("decimal(20,6)")).cast("double").alias("duration"))


def without_speaker(utts: DataFrame) -> DataFrame:
    return utts.where("speaker is null")


def total_duration(utts: DataFrame) -> DataFrame:
    return utts.agg(F.sum(F.col("duration").cast("decimal(20,6)")).cast("double").alias("duration"), F.count(F.lit(1)).alias("utterances"))


def duplicate_names(utts: DataFrame, name: str = "name") -> DataFrame:
    return utts.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fit_to_duration(utts: DataFrame, duration: float, truncate: bool = False, order: tuple[str, ...] = ("audio_file", "name")) -> DataFrame:
    """Utterances of each speaker up to ``duration`` seconds, in order; the one that crosses the limit is cut.

    A speaker with less is an error, or with ``truncate`` is left as is. Sums run within (speaker, slice of the
    order): a speaker's slices are summed first, so a speaker with a third of all rows is many tasks.
    """
    key = F.concat_ws("\x00", *order)
    slices = 64
    d = utts.where("speaker is not null").select("speaker", "name", "audio_file", "tstart", F.col("duration").cast("decimal(20,6)").alias("_d"), key.alias("_key"))
    # 512 keys drawn by hash give the bounds, which need not be even
    bounds = sorted(r["_key"] for r in d.select("_key").distinct().orderBy(F.xxhash64("_key")).limit(2 * slices).collect())[::2]
    at = F.lit(0)
    if bounds:
        edges = F.split(F.lit("\x01".join(bounds)), "\x01", -1)  # folds to one literal
        at = F.size(F.filter(edges, lambda e: e <= F.col("_key")))
    d = d.withColumn("_slice", at)
    sums = d.groupBy("speaker", "_slice").agg(F.sum("_d").alias("_sum"))
    w = Window.partitionBy("speaker").orderBy("_slice")
    sums = sums.select("speaker", "_slice", F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy("speaker")).alias("_total"))
    d = d.join(sums, ["speaker", "_slice"])
    inner = F.sum("_d").over(Window.partitionBy("speaker", "_slice").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = (F.col("_before") + inner - F.col("_d")).cast("double")
    d = d.withColumn("_from", before)
    if not truncate:
        short = F.when(F.col("_total").cast("double") < duration, F.raise_error(F.concat(F.lit("not enough utterances for speaker "), "speaker")).cast("boolean")).otherwise(F.lit(True))
        d = d.where(short)
    d = d.where(F.col("_from") < duration)
    kept = F.least(F.col("_d").cast("double"), F.round(F.lit(float(duration)) - F.col("_from"), 6))
    return d.select("name", "audio_file", "speaker", "tstart", kept.alias("duration"))
