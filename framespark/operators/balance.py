"""Per-key work without the imbalance of a few keys that hold most rows.

Fragment-replicate by estimated load. Loads are counted per key with partial aggregation. Keys
above a quarter of a task's fair share are few (at most ``4 * tasks``, for their loads add up to no more
than the total); each is cut into shards in proportion to its load. All other keys are counted
together by hash bucket, of which there are ``32 * tasks``. Shards and buckets are then bin-packed
onto tasks, longest first. What reaches the driver is bounded by ``tasks``, whatever the data.
The matching side of a join is replicated only to the shards of its key.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.plans.cuts import cut

FINE = 4
BUCKETS = 32


@dataclass(frozen=True)
class Shard:
    key: object
    shard: int
    shards: int
    load: int
    task: int = -1


@dataclass(frozen=True)
class LoadPlan:
    tasks: int
    shards: tuple[Shard, ...]
    buckets: tuple[tuple[int, int, int], ...]  # bucket, load, task
    key_type: str

    def task_loads(self) -> list[int]:
        loads = [0] * self.tasks
        for s in self.shards:
            loads[s.task] += s.load
        for _, load, task in self.buckets:
            loads[task] += load
        return loads


def pack(loads: list[int], tasks: int) -> list[int]:
    """Longest first, each to the task with the least so far."""
    heap = [(0, t) for t in range(tasks)]
    where = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, task = heapq.heappop(heap)
        where[i] = task
        heapq.heappush(heap, (load + loads[i], task))
    return where


def bucket_of(key: Column, tasks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS * tasks)).cast("int")


def plan_load(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Counts loads and packs them. Rows with a null key count as one more key, which no join matches."""
    spark = df.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    loads = cut(df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("load")), "loads")
    by_bucket = loads.groupBy(bucket_of(F.col("key"), tasks).alias("b")).agg(F.sum("load").alias("load")).collect()
    total = sum(r.load for r in by_bucket)
    fair = max(1.0, total / (FINE * tasks))
    heavy = sorted(loads.where(F.col("key").isNotNull() & (F.col("load") > fair)).withColumn("b", bucket_of(F.col("key"), tasks)).collect(), key=lambda r: (-r.load, str(r.key)))
    light = {r.b: r.load for r in by_bucket}
    shards = []
    for r in heavy:
        light[r.b] -= r.load
        n = math.ceil(r.load / fair)
        shards += [Shard(r.key, i, n, (r.load * (i + 1)) // n - (r.load * i) // n) for i in range(n)]
    buckets = sorted(light.items())
    where = pack([s.load for s in shards] + [n for _, n in buckets], tasks)
    return LoadPlan(
        tasks,
        tuple(Shard(s.key, s.shard, s.shards, s.load, t) for s, t in zip(shards, where)),
        tuple((b, n, t) for (b, n), t in zip(buckets, where[len(shards) :])),
        df.schema[key].dataType.simpleString(),
    )


_SLOTS: dict[int, list[int]] = {}


def slots(spark: SparkSession, tasks: int) -> list[int]:
    """For each task a number that hash partitioning into ``tasks`` sends to a partition of its own."""
    if tasks in _SLOTS:
        return _SLOTS[tasks]
    found: dict[int, int] = {}
    start = 0
    while len(found) < tasks:
        step = 16 * tasks + 64
        for r in spark.range(start, start + step).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).collect():
            found.setdefault(r.p, r.id)
        start += step
    _SLOTS[tasks] = [found[t] for t in range(tasks)]
    return _SLOTS[tasks]


def _tables(spark: SparkSession, plan: LoadPlan) -> tuple[DataFrame, DataFrame]:
    slot = slots(spark, plan.tasks)
    heavy = spark.createDataFrame([(s.key, s.shard, s.shards, slot[s.task]) for s in plan.shards], f"_k {plan.key_type}, _shard int, _shards int, _slot bigint")
    buckets = spark.createDataFrame([(b, slot[t]) for b, _, t in plan.buckets], "_b int, _bslot bigint")
    return heavy, buckets


def shard_bounds(df: DataFrame, plan: LoadPlan, key: str, order: str) -> DataFrame:
    """Where the shards of the heavy keys begin in ``order`` (a BIGINT): ``_k, _shard, _lo, _hi, _slot``.

    Approximate percentiles of the heavy keys only, by a mergeable sketch; the bounds need not be exact, for
    each shard takes all rows between its two.
    """
    spark = df.sparkSession
    heavy, _ = _tables(spark, plan)
    most = max((s.shards for s in plan.shards), default=1)
    grid = [i / most for i in range(1, most)] or [0.5]
    keys = heavy.select("_k", "_shards").distinct()
    marks = df.join(F.broadcast(keys), df[key].eqNullSafe(keys["_k"])).groupBy("_k", "_shards").agg(F.percentile_approx(order, grid, 2000).alias("q"))
    at = lambda i: F.element_at("q", F.greatest(F.round(i * most / F.col("_shards")).cast("int"), F.lit(1)))
    cuts = marks.select("_k", F.posexplode(F.array_distinct(F.when(F.col("_shards") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("_shards") - 1, F.lit(1))), at)).otherwise(F.array().cast("array<bigint>")))).alias("i", "at")).collect()
    by: dict = {}
    for r in cuts:
        by.setdefault(r["_k"], []).append(r["at"])
    slot, rows, seen = slots(spark, plan.tasks), [], set()
    low, high = -(2**63), 2**63 - 1
    for s in plan.shards:
        if s.key in seen:
            continue
        seen.add(s.key)
        own = [x for x in plan.shards if x.key == s.key]
        marks_ = sorted(set(by.get(s.key, [])))[: len(own) - 1]
        edges = [low, *marks_, high]
        rows += [(s.key, i, a, b, slot[own[i].task]) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, f"_k {plan.key_type}, _shard int, _lo bigint, _hi bigint, _slot bigint")


def place_ordered(df: DataFrame, plan: LoadPlan, key: str, order: str, bounds: DataFrame, matching: DataFrame | None = None) -> DataFrame:
    """``df`` on its tasks, with ``_slot`` and ``_shard``; a heavy key's shards are consecutive runs of ``order``.

    Rows of ``matching``, which have ``_slot`` and ``_shard`` already, go to these shards with them; the columns they lack are null.
    """
    _, buckets = _tables(df.sparkSession, plan)
    d = df.withColumn("_b", bucket_of(F.col(key), plan.tasks))
    on = (d[key] == bounds["_k"]) & (d[order] >= bounds["_lo"]) & (d[order] < bounds["_hi"])
    d = d.join(F.broadcast(bounds), on, "left").join(F.broadcast(buckets), "_b", "left")
    d = d.withColumn("_slot", F.coalesce("_slot", "_bslot")).withColumn("_shard", F.coalesce("_shard", F.lit(0)))
    d = d.drop("_b", "_bslot", "_k", "_lo", "_hi")
    if matching is not None:
        d = d.unionByName(matching, allowMissingColumns=True)
    return d.repartition(plan.tasks, "_slot")


def balanced_join(left: DataFrame, right: DataFrame, key: str, plan: LoadPlan | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``; the heavy keys of ``left`` are cut into shards and the rows of ``right`` replicated to the shards of their key.

    ``how`` is ``inner`` or ``left``. Null keys match nothing. Column names other than ``key`` must not clash. A join that sorts both sides hashes
    (slot, shard, key) anew, which spreads shards and keys evenly but not as packed; windows over what ``place_ordered`` gives stay as packed.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left: other joins would repeat replicated rows")
    plan = plan or plan_load(left, key)
    heavy, buckets = _tables(left.sparkSession, plan)
    keys = heavy.select("_k", "_shards").distinct()
    per_key = heavy.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_shard", "_slot"))).alias("_map"))
    spread = F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.col("_shards")).cast("int")

    a = left.withColumn("_b", bucket_of(F.col(key), plan.tasks))
    a = a.join(F.broadcast(keys), a[key] == keys["_k"], "left").drop("_k").withColumn("_shard", F.coalesce(spread, F.lit(0))).drop("_shards")
    a = a.join(F.broadcast(heavy.select("_k", F.col("_shard").alias("_s"), "_slot")), (a[key] == F.col("_k")) & (a["_shard"] == F.col("_s")), "left")
    a = a.join(F.broadcast(buckets), "_b", "left").withColumn("_slot", F.coalesce("_slot", "_bslot")).drop("_b", "_bslot", "_k", "_s")

    b = right.withColumn("_b", bucket_of(F.col(key), plan.tasks))
    b = b.join(F.broadcast(per_key), b[key] == per_key["_k"], "left").join(F.broadcast(buckets), "_b", "left")
    entries = F.coalesce(F.map_entries("_map"), F.array(F.struct(F.lit(0).alias("key"), F.col("_bslot").alias("value"))))
    b = b.withColumn("_e", F.explode(entries)).withColumn("_shard", F.col("_e.key")).withColumn("_slot", F.col("_e.value")).drop("_e", "_b", "_bslot", "_k", "_map")
    a, b = a.repartition(plan.tasks, "_slot"), b.repartition(plan.tasks, "_slot")
    return a.join(b, ["_slot", "_shard", key], how).drop("_slot", "_shard")
