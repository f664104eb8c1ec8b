"""Fixed-capacity containers filled with items of varying length, by shortest-pack-first over the length histogram.

The histogram has at most as many entries as a container has units, whatever the data, so packing it is
driver work of constant size: lengths are placed longest first, each into the open packs with the most room,
as counts of packing patterns. Patterns go back to the items by rank: the items of one length are
numbered in hash order, and each pattern owns a range of ranks of each of its lengths.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespark.operators.ranking import hash_rank
from framespark.plans.cuts import cut

CAPACITY = 2048


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern, number of containers)]; a pattern is ((length, times), ...), longest first. Lengths are 1 to ``capacity``."""
    room: dict[int, dict[tuple, int]] = defaultdict(dict)
    rooms: list[int] = []

    def add(left: int, pattern: tuple, count: int) -> None:
        if not room[left]:
            heapq.heappush(rooms, -left)
        room[left][pattern] = room[left].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1 to {capacity}")
        while n:
            while rooms and not room[-rooms[0]]:
                heapq.heappop(rooms)
            if rooms and -rooms[0] >= length:
                left = -rooms[0]
                pattern, open_ = room[left].popitem()
                fit = left // length
                if n >= fit * open_:  # all these packs take all they can
                    add(left - fit * length, (*pattern, (length, fit)), open_)
                    n -= fit * open_
                else:
                    full, rest = divmod(n, fit)
                    if full:
                        add(left - fit * length, (*pattern, (length, fit)), full)
                    if rest:
                        add(left - rest * length, (*pattern, (length, rest)), 1)
                    if open_ - full - bool(rest):
                        add(left, pattern, open_ - full - bool(rest))
                    n = 0
            else:
                fit = capacity // length
                full, rest = divmod(n, fit)
                if full:
                    add(capacity - fit * length, ((length, fit),), full)
                if rest:
                    add(capacity - rest * length, ((length, rest),), 1)
                n = 0
    return sorted(((p, c) for packs in room.values() for p, c in packs.items()), reverse=True)


def ranges(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(rows of length, first rank, rank after the last, first container, times, offset in the container; number of containers)."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, taken[length], taken[length] + times * count, base, times, offset))
            taken[length] += times * count
            offset += times * length
        base += count
    return rows, base


def fill_containers(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece_no, start, length, container, offset`` of every row of ``sizes``.

    An item longer than a container becomes full pieces and a rest; no other is split. Items of size 0 or null take no
    room and share the containers there are, by hash. Equal rows are items of their own. Containers are numbered
    from 0; an empty table has none. ``sizes`` is read several times: pass a written table.
    """
    spark = sizes.sparkSession
    some = sizes.where(F.col(size) > 0).select(key, F.col(size).cast("bigint").alias("_n"))
    last = F.floor((F.col("_n") - 1) / capacity)
    items = some.select(key, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    items = items.select(key, "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("_n") - start).cast("int").alias("length"))
    counts = items.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))
    counts = spark.createDataFrame(counts.collect(), "length int, _n bigint")  # at most `capacity` rows
    rows, containers = ranges(pack_histogram({r["length"]: r["_n"] for r in counts.collect()}, capacity))
    where = F.broadcast(spark.createDataFrame(rows, "_l int, _lo bigint, _hi bigint, _base bigint, _times int, _off int"))
    ranked = hash_rank(items.withColumn("_id", F.struct(key, "piece_no")), ["length"], "_id", sizes=F.broadcast(counts))
    on = (F.col("length") == F.col("_l")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi"))
    nth = F.col("rank") - F.col("_lo")
    placed = ranked.join(where, on).select(
        key, F.col("piece_no").cast("int").alias("piece_no"), "start", "length",
        (F.col("_base") + F.floor(nth / F.col("_times"))).alias("container"), (F.col("_off") + F.pmod(nth, F.col("_times").cast("bigint")) * F.col("length")).cast("int").alias("offset"),
    )
    none = sizes.where(F.coalesce(F.col(size), F.lit(0)) <= 0)
    anywhere = F.pmod(F.xxhash64(key), F.lit(max(1, containers)).cast("bigint"))
    empty = none.select(key, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("length"), anywhere.alias("container"), F.lit(0).alias("offset"))
    return placed.unionByName(empty)


def container_use(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``used, containers``: how many containers hold how many units."""
    used = placed.groupBy("container").agg(F.sum("length").alias("used"))
    return used.groupBy("used").agg(F.count(F.lit(1)).alias("containers"), F.first(F.lit(capacity) - F.col("used")).alias("unused"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    from framespark.llm.bpe import count_tokens

    return fill_containers(cut(count_tokens(documents, path=path), "tokens"), capacity=capacity)
