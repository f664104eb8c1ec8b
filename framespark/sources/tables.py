"""Tables by name from a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framespark.plans.ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
