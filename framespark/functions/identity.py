"""Keys of speakers and files from labels and paths that are not always written alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels, without case and separators, that name nobody.
NOBODY = ("", "anonymous", "na", "nan", "nil", "nobody", "none", "null", "speaker", "undefined", "unk", "unknown", "unknownspeaker")


def speaker_key(label: Column) -> Column:
    """Lower case without blanks, separators and other signs; null for a label that names nobody."""
    key = F.regexp_replace(F.lower(label), r"[^\p{L}\p{M}\p{N}]", "")
    return F.when(~key.isin(*NOBODY), key)


def file_key(path: Column) -> Column:
    """The clean path: outer blanks off, ``/`` for ``\\``, no empty, ``.`` or ``x/..`` steps; null if nothing is left."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    rooted = plain.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((part == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    walked = F.aggregate(F.split(plain, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(walked, "/"))
    clean = F.when(plain.rlike(r"(^|/)\.{0,2}(/|$)"), joined).otherwise(plain)
    return F.when(clean != "", clean)


def holding_rows(utterances: DataFrame, *keep: str) -> DataFrame:
    """One row per ``utt_id``: the one ingested last (of equals, the greatest by the other kept columns).

    Rows without ``utt_id`` are no utterances and are left out. A partial aggregate, so repeats
    shrink before the shuffle and no utterance can skew it.
    """
    best = F.max(F.struct("ingested_at", *keep)).alias("best")
    rows = utterances.where(F.col("utt_id").isNotNull()).groupBy("utt_id").agg(best)
    return rows.select("utt_id", *(F.col(f"best.{c}").alias(c) for c in keep))
