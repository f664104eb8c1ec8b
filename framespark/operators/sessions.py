"""Sessions and totals per speaker in balanced time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framespark.functions.identity import holding_rows, speaker_key
from framespark.operators.balance import place_ordered, plan_load, shard_bounds
from framespark.plans.cuts import cut

EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def spoken(utterances: DataFrame, *more: str) -> DataFrame:
    """Holding rows of somebody: ``utt_id, spk, t`` (microseconds of ``recorded_at``) and ``more``."""
    held = holding_rows(utterances, "speaker", "recorded_at", *more)
    rows = held.select("utt_id", speaker_key(F.col("speaker")).alias("spk"), F.expr(EPOCH.format("cast(recorded_at as timestamp_ntz)")).alias("t"), *more)
    return rows.where(F.col("spk").isNotNull())


def sessions(rows: DataFrame, key: str = "spk", order: str = "t", id_: str = "utt_id", gap: int = 30 * 60 * 1_000_000, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``opens``: true on a key's first row and on one more than ``gap`` after the key's previous row.

    Heavy keys are cut into consecutive runs of ``order``. The end of the runs before a run goes to that run's shard, and to no other, as a row of its own, which
    the run's first row follows. Rows with a null ``order`` or key open nothing and follow no row. Ties in ``order`` go by ``id_``.
    """
    known = F.col(order).isNotNull() & F.col(key).isNotNull()
    whole = rows.where(known)
    plan = plan_load(whole, key, tasks)
    bounds = shard_bounds(whole, plan, key, order)
    on = (whole[key] == bounds["_k"]) & (whole[order] >= bounds["_lo"]) & (whole[order] < bounds["_hi"])
    ends = whole.join(F.broadcast(bounds), on).groupBy("_k", "_shard", "_slot").agg(F.max(order).alias("_end")).collect()
    last, carried = {}, []
    for r in sorted(ends, key=lambda r: (str(r["_k"]), r["_shard"])):
        if r["_k"] in last:
            carried.append((r["_k"], last[r["_k"]], r["_shard"], r["_slot"], True))
        last[r["_k"]] = r["_end"]
    kinds = dict(rows.dtypes)
    before = rows.sparkSession.createDataFrame(carried, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, _shard int, _slot bigint, _carried boolean")
    d = place_ordered(whole.withColumn("_carried", F.lit(False)), plan, key, order, bounds, before)
    prev = F.lag(order).over(Window.partitionBy("_slot", key, "_shard").orderBy(order, F.col("_carried").desc(), id_))
    d = d.withColumn("opens", prev.isNull() | (F.col(order) - prev > gap)).where("not _carried").drop("_carried", "_slot", "_shard")
    return d.unionByName(rows.where(~known).withColumn("opens", F.lit(False)))


def session_openers(utterances: DataFrame, gap_minutes: int = 30, tasks: int | None = None) -> DataFrame:
    """``utt_id`` of the utterances that open a session of their speaker.

    An empty table gives no rows; utterances without a time or a speaker are left out; equal times never
    open twice; columns besides those named are ignored.
    """
    rows = cut(spoken(utterances), "spoken")
    return sessions(rows, gap=gap_minutes * 60 * 1_000_000, tasks=tasks).where("opens").select(F.col("utt_id").cast(T.LongType()))


def speaker_totals(utterances: DataFrame, gap_minutes: int = 30, tasks: int | None = None) -> DataFrame:
    """Per speaker: ``first_utt, n_utts, n_sessions, total_s, longest_s``; partial sums per run, then one row per key."""
    rows = cut(spoken(utterances, "duration"), "spoken")
    d = sessions(rows, gap=gap_minutes * 60 * 1_000_000, tasks=tasks)
    return d.groupBy(F.col("spk").alias("speaker_key")).agg(
        F.min("utt_id").alias("first_utt"), F.count(F.lit(1)).alias("n_utts"), F.sum(F.col("opens").cast("bigint")).alias("n_sessions"),
        F.round(F.sum(F.col("duration").cast("decimal(18,4)")), 2).cast("double").alias("total_s"), F.max("duration").alias("longest_s"),
    )
