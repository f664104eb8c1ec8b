"""Frames of the event table by windows of time, as batch; the same operator takes a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.plans.registry import Registry
from framespark.sources.tables import table
from framespark.streaming.stateful import event_frames

R = Registry()


@R.query("WITH w AS (SELECT user_id, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS t0 FROM events)"
  " SELECT user_id, CAST(epoch(t0) AS BIGINT) AS t0, CAST(epoch(t0) AS BIGINT) + 3600 AS t1, count(value) AS n, round(avg(value) + 1e-7::DOUBLE, 4) AS mean, round(sum(value * value) + 1e-7::DOUBLE, 3) AS energy FROM w GROUP BY user_id, t0")  # fmt: skip
def event_windows(spark, d):
    out = event_frames(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.unix_timestamp("t0").alias("t0"), F.unix_timestamp("t1").alias("t1"), "n", F.round(F.col("mean") + 1e-7, 4).alias("mean"), F.round(F.col("energy") + 1e-7, 3).alias("energy"))


QUERIES, ORACLE = R.queries, R.sql
