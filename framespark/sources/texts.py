"""Text formats of utterance indexes and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_utterances(spark: SparkSession, path: str) -> DataFrame:
    """``name, audio_file, speaker, tstart, tstop`` of lines of 2 to 5 fields set off by single blanks; blank lines are skipped.

    2: name file; 3: name file speaker; 4: name file start stop; 5: name file speaker start stop. All lines have one format; other lines,
    names that come twice and times that are no interval are errors.
    """
    f = F.split(F.trim("value"), " ")
    d = spark.read.text(path).where(F.trim("value") != "").select(f.alias("f"), F.size(f).alias("n"))
    kinds = [r.n for r in d.groupBy("n").count().collect()]
    if len(kinds) > 1 or (kinds and not 2 <= kinds[0] <= 5):
        raise ValueError(f"lines must all have the same number of fields, from 2 to 5; there are {sorted(kinds)}")
    n = kinds[0] if kinds else 2
    field = lambda i: F.get("f", F.lit(i))
    speaker = field(2) if n in (3, 5) else F.lit(None).cast("string")
    start, stop = (field(n - 2).cast("double"), field(n - 1).cast("double")) if n >= 4 else (F.lit(None).cast("double"),) * 2
    out = d.select(field(0).alias("name"), field(1).alias("audio_file"), speaker.alias("speaker"), start.alias("tstart"), stop.alias("tstop"))
    twice = [r.name for r in out.groupBy("name").count().where("count > 1").limit(10).collect()]
    if twice:
        raise ValueError(f"names that come twice: {sorted(twice)}")
    if n >= 4:
        fine = (F.col("tstart") >= 0) & (F.col("tstop") > F.col("tstart"))
        out = out.withColumn("tstop", F.when(fine, F.col("tstop")).otherwise(F.raise_error(F.concat(F.lit("no interval of time, name "), "name")).cast("double")))
    return out


def save_utterances(utts: DataFrame, path: str) -> None:
    fields = [c for c in ("name", "audio_file", "speaker", "tstart", "tstop") if c in utts.columns]
    utts.orderBy("audio_file", "name").select(F.concat_ws(" ", *(F.col(c).cast("string") for c in fields)).alias("value")).write.mode("errorifexists").text(path)


def load_alignments(spark: SparkSession, path: str) -> DataFrame:
    """``item, idx, onset, offset_s, token`` of lines of four fields, plain or gzipped; a line of other fields is an error."""
    from pyspark.sql.window import Window

    f = F.split(F.trim("value"), r"\s+")
    bad = F.raise_error(F.concat(F.lit("line must have 4 fields: "), "value")).cast("array<string>")
    d = spark.read.text(path).where(F.trim("value") != "").select(F.when(F.size(f) == 4, f).otherwise(bad).alias("f"))
    d = d.select(F.col("f")[0].alias("item"), F.col("f")[1].cast("double").alias("onset"), F.col("f")[2].cast("double").alias("offset_s"), F.col("f")[3].alias("token"))
    return d.withColumn("idx", F.row_number().over(Window.partitionBy("item").orderBy("onset", "offset_s")) - 1).select("item", "idx", "onset", "offset_s", "token")


def save_alignments(ali: DataFrame, path: str, sort: bool = False, compress: bool = False) -> None:
    d = ali.orderBy("item", "onset") if sort else ali.repartitionByRange("item").sortWithinPartitions("item", "onset")
    out = d.select(F.concat_ws(" ", "item", F.col("onset").cast("string"), F.col("offset_s").cast("string"), "token").alias("value")).write.mode("errorifexists")
    (out.option("compression", "gzip") if compress else out).text(path)
