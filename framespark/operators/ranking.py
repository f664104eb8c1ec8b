"""Ranks within groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART_ROWS = 50_000


def hash_rank(df: DataFrame, group: list[str], id_: str, part_rows: int = PART_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """``df`` with ``rank`` (BIGINT from 0, dense and unique within ``group``) in the order of a hash of ``id_``, then ``id_``.

    A group is cut by hash into parts of about ``part_rows``; rows are numbered within parts, and the parts' counts
    give the offsets. Read ``df`` from files: it is read three times. ``id_`` should be unique in a group; rows
    that share it are numbered in any order. Null groups are groups.
    """
    hashed = df.withColumn("_h", F.xxhash64(id_))
    n = sizes if sizes is not None else df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    n = n.select(*group, F.ceil(F.col("_n") / part_rows).cast("bigint").alias("_parts"))
    named = n.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_parts")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    parted = hashed.join(named, on, "left").drop(*(f"_g{i}" for i in range(len(group)))).withColumn("_part", F.pmod("_h", "_parts")).drop("_parts")
    counts = parted.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_off"))
    numbered = parted.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_h", id_)))
    out = numbered.join(offsets, on & (F.col("_part") == F.col("_p")))
    return out.withColumn("rank", F.col("_off") + F.col("_r") - 1).drop("_h", "_part", "_r", "_p", "_off", *(f"_g{i}" for i in range(len(group))))
