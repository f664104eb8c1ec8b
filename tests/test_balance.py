import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.functions.identity import file_key, speaker_key
from framespark.operators.balance import balanced_join, pack, plan_load
from framespark.operators.blocks import blocked
from framespark.operators.components import components
from framespark.operators.ranking import hash_rank
from framespark.operators.sessions import session_openers, sessions

UTTS = "utt_id bigint, name string, speaker string, audio_file string, tstart double, tstop double, duration double, recorded_at timestamp_ntz, ingested_at timestamp_ntz, spk string, _slot int, t int"
T0 = dt.datetime(2001, 1, 1)


def utt(i, speaker="a", minutes=0, file="f", ingested=0, tstart=None):
    at = None if minutes is None else T0 + dt.timedelta(minutes=minutes)
    return (i, f"u{i}", speaker, file, tstart, None, 1.0, at, T0 + dt.timedelta(minutes=ingested), "clash", 1, 2)


def test_pack_is_even():
    loads = [random.Random(0).randint(1, 50) for _ in range(300)]
    where = pack(loads, 7)
    sums = [sum(n for n, w in zip(loads, where) if w == t) for t in range(7)]
    assert max(sums) - min(sums) <= 50


def test_hot_key_is_spread(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    plan = plan_load(df, "k", 6)
    loads = plan.task_loads()
    assert sum(loads) == 30_000 and max(loads) < 1.3 * 5_000
    assert {s.key for s in plan.shards} == {"hot"}
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), (None, 4)], "k string, v int")
    got = balanced_join(df, right, "k", plan)
    assert got.count() == 2 * 10_000 + 1
    assert balanced_join(df, right, "k", plan, "left").count() == 2 * 10_000 + 20_000
    # no task holds more than its share of the hot key
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 0.5 * sum(sizes)


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, id bigint")
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    assert balanced_join(empty, right, "k").count() == 0


def brute(rows):
    held = {}
    for r in rows:
        if r[0] not in held or r[8] > held[r[0]][8]:
            held[r[0]] = r
    by = {}
    for r in held.values():
        k = "".join(c for c in (r[2] or "").lower() if c.isalnum())
        if k and k not in ("unknown", "na") and r[7] is not None:
            by.setdefault(k, []).append((r[7], r[0]))
    out = set()
    for v in by.values():
        v.sort()
        out |= {i for n, (t, i) in enumerate(v) if not n or t - v[n - 1][0] > dt.timedelta(minutes=30)}
    return out


def test_sessions_against_brute_force(spark):
    r = random.Random(3)
    rows = [utt(i, r.choice(["Hot 1", "hot_1", "hot1", "hot-1", "b", "c", None, "unknown", "n/a", ""]), r.randint(0, 4000)) for i in range(900)]
    rows += [utt(i, "hot1", r.randint(0, 4000), ingested=9) for i in range(50)] + rows[:60]
    rows += [utt(1000, "z", 5), utt(1001, "z", 5), utt(1002, "z", 35), utt(1003, "z", 66), utt(1004, "z", None)]
    df = spark.createDataFrame(rows, UTTS)
    for tasks in (1, 4, 16):
        got = [x.utt_id for x in session_openers(df, tasks=tasks).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_rows_without_a_time_are_kept(spark):
    rows = [("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 4, None), (None, 5, 7)]
    got = {r.i: r.opens for r in sessions(spark.createDataFrame(rows, "k string, i bigint, t bigint"), "k", "t", "i", gap=10, tasks=3).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_sessions_of_nothing(spark):
    assert session_openers(spark.createDataFrame([], UTTS)).count() == 0
    assert session_openers(spark.createDataFrame([utt(1, None), utt(2, "?"), (None,) + utt(3)[1:]], UTTS)).count() == 0


def test_keys(spark):
    paths = {"a/b.wav": "a/b.wav", " ./a//b.wav ": "a/b.wav", "a\\b.wav": "a/b.wav", "a/x/../b.wav": "a/b.wav", "./a/t/u/../../b.wav": "a/b.wav", "/a/../../b": "/b", "../a": "../a", "": None, "  ": None, ".": None, "a/b.WAV": "a/b.WAV"}
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string").select("p", file_key(F.col("p")).alias("k"))
    assert {r.p: r.k for r in df.collect()} == paths | {None: None}
    labels = {"Ann 1": "ann1", "ann_1": "ann1", "ann 1\t": "ann1", "N/A": None, "<unk>": None, "-": None, "": None, "Speaker": None}
    df = spark.createDataFrame([(p,) for p in labels], "p string").select("p", speaker_key(F.col("p")).alias("k"))
    assert {r.p: r.k for r in df.collect()} == labels


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, b) for b in range(101, 160)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(500, 500)] + [(3, 4)] * 3
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hash_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id").unionByName(spark.createDataFrame([(None, 1), (None, 2)], "g bigint, id bigint"))
    got = hash_rank(df, ["g"], "id", part_rows=100).collect()
    by = {}
    for x in got:
        by.setdefault(x.g, []).append(x["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 5002


def test_blocks_cover_once(spark):
    df = spark.range(1000).select(F.lit("a").alias("item"), F.col("id").cast("int").alias("frame"))
    got = blocked(df, 5, block=64).withColumn("p", F.lag("frame").over(Window.partitionBy("item", "_block").orderBy("frame"))).where("_own").collect()
    assert len(got) == 1000 and all(x.p == (x.frame - 1 if x.frame else None) for x in got)
