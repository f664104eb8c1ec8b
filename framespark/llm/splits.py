"""Splits that keep related records together, by min-cost flow over bundles of components.

Records that share a speaker or a file, directly or through others, form a component. Components of
equal size and label profile are interchangeable and make a bundle. Bundles with the same profile that fit
into the same splits are one source of a flow network of constant size: sources -> (profile, split) ->
split -> sink, where exceeding a split's share of a profile, or its quota, costs per record. Successive shortest
paths solve it; the flow is rounded to whole components, largest first, the remainders carried
over; within a bundle, components go to splits by the rank of their hash. Which speakers must share a split follows from the components alone.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespark.functions.identity import file_key, holding_rows, speaker_key
from framespark.operators.balance import balanced_join
from framespark.operators.components import components
from framespark.operators.ranking import hash_rank
from framespark.plans.cuts import cut

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Cost of a record beyond a split's share of a profile, and beyond a split's quota.
PROFILE_COST, QUOTA_COST = 1, 10


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each of ``arcs`` (from, to, capacity, cost) of a maximum flow of least cost; successive shortest paths."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        graph[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        graph[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    while True:
        far, via = [None] * n, [-1] * n
        far[source] = 0
        for _ in range(n):
            moved = False
            for u in range(n):
                if far[u] is None:
                    continue
                for e in graph[u]:
                    if cap[e] and (far[to[e]] is None or far[u] + cost[e] < far[to[e]]):
                        far[to[e]], via[to[e]], moved = far[u] + cost[e], e, True
            if not moved:
                break
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def allocate(bundles: list[tuple[int, int, int]], shares: dict[str, float]) -> dict[tuple[int, int], list[int]]:
    """For each bundle (size, profile, number of components): how many of its components each split gets.

    A component larger than every quota goes to the split with the largest. The work depends on the number of
    bundles, which N records keep below ``5 * sqrt(2 N)`` with five profiles.
    """
    names = list(shares)
    total = sum(size * count for size, _, count in bundles)
    quota = [shares[s] * total / sum(shares.values()) for s in names]
    largest = max(range(len(names)), key=lambda i: quota[i])
    fits = lambda size: tuple(i for i in range(len(names)) if size <= quota[i]) or (largest,)
    groups: dict = defaultdict(int)
    of_profile: dict = defaultdict(int)
    for size, profile, count in bundles:
        groups[profile, fits(size)] += size * count
        of_profile[profile] += size * count
    keys, profiles, k = sorted(groups), sorted(of_profile), len(names)
    first = 2 + len(keys)
    at = {p: first + k * i for i, p in enumerate(profiles)}
    split = first + k * len(profiles)
    arcs = [(0, 2 + i, groups[g], 0) for i, g in enumerate(keys)]
    routes = len(arcs)
    arcs += [(2 + i, at[p] + s, groups[p, ok], 0) for i, (p, ok) in enumerate(keys) for s in ok]
    for p in profiles:
        for s in range(k):
            arcs += [(at[p] + s, split + s, int(of_profile[p] * quota[s] / max(total, 1)), 0), (at[p] + s, split + s, total, PROFILE_COST)]
    for s in range(k):
        arcs += [(split + s, 1, int(quota[s]), 0), (split + s, 1, total, QUOTA_COST)]
    flow = min_cost_flow(split + k, arcs, 0, 1)
    planned, i = {}, routes
    for p, ok in keys:
        planned[p, ok] = [0] * k
        for s in ok:
            planned[p, ok][s] = flow[i]
            i += 1

    out: dict[tuple[int, int], list[int]] = {}
    filled, carry = [0.0] * k, {g: [0.0] * k for g in keys}
    for size, profile, count in sorted(bundles, key=lambda b: (-b[0], b[1])):
        g = (profile, fits(size))
        whole = max(1, groups[g])
        ideal = [count * planned[g][s] / whole + carry[g][s] / size for s in range(k)]
        given = [max(0, int(x)) for x in ideal]
        while sum(given) > count:
            s = max((s for s in range(k) if given[s]), key=lambda s: (given[s] - ideal[s], given[s]))
            given[s] -= 1
        ok = [s for s in g[1]]
        for _ in range(count - sum(given)):
            room = lambda s: quota[s] - filled[s] - given[s] * size
            s = max(ok, key=lambda s: (room(s) >= size, ideal[s] - given[s], room(s)))
            given[s] += 1
        for s in range(k):
            carry[g][s] = (ideal[s] - given[s]) * size
            filled[s] += given[s] * size
        out[size, profile] = given
    return out


def speakers(utterances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(speakers, files): ``sid, spk, component`` of each speaker, ``file, component`` of each file with a speaker.

    A speaker's number is their least ``utt_id``. Each file links its speakers to the least of them, so a
    file of any number of speakers costs as many links.
    """
    held = holding_rows(utterances, "speaker", "audio_file").select("utt_id", speaker_key(F.col("speaker")).alias("spk"), file_key(F.col("audio_file")).alias("file"))
    both = cut(held.where("spk is not null").groupBy("spk", "file").agg(F.min("utt_id").alias("u")), "pairs")
    least_of = both.groupBy("spk").agg(F.min("u").alias("sid"))
    pairs = cut(both.where("file is not null").select("spk", "file").join(least_of, "spk").select("file", "sid"), "linked")
    least = pairs.groupBy("file").agg(F.min("sid").alias("b"))
    edges = pairs.join(least, "file").select(F.col("sid").alias("a"), "b")
    comps = cut(components(edges), "components")
    found = least_of.join(comps, least_of["sid"] == comps["node"], "left").select("sid", "spk", F.coalesce("component", "sid").alias("component"))
    files = least.join(comps, least["b"] == comps["node"]).select("file", "component")
    return found, files


def grouped_splits(utterances: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``utt_id, component, split``, one per utterance.

    A component is named after its least speaker's
    number; one without a speaker after its file (``file:``), and a record with neither stands alone (``utt:``). Null
    labels and paths link nothing. An empty table gives no rows; extra columns are ignored.
    """
    shares = shares or SHARES
    held = holding_rows(utterances, "speaker", "audio_file", "tstart")
    rows = cut(held.select("utt_id", speaker_key(F.col("speaker")).alias("spk"), file_key(F.col("audio_file")).alias("file"), F.col("tstart").isNotNull().alias("timed")), "related")
    people, files = speakers(utterances)
    of_speaker = people.select("spk", F.col("component").cast("string").alias("c1"))
    of_file = files.select("file", F.col("component").cast("string").alias("c2"))
    named = balanced_join(rows.where("spk is not null"), of_speaker, "spk").select("utt_id", "timed", F.col("c1").alias("component"))
    nobody = rows.where("spk is null")
    filed = balanced_join(nobody.where("file is not null"), of_file, "file", how="left").select("utt_id", "timed", F.coalesce("c2", F.concat(F.lit("file:"), "file")).alias("component"))
    alone = nobody.where("file is null").select("utt_id", "timed", F.concat(F.lit("utt:"), F.col("utt_id").cast("string")).alias("component"))
    records = cut(reduce(DataFrame.unionByName, [named, filed, alone]), "records")

    comps = records.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.avg(F.col("timed").cast("int")).alias("share"))
    comps = cut(comps.select("component", "size", F.round(F.col("share") * 4).cast("int").alias("profile")), "comps")
    counted = comps.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("_n"))
    bundles = [(r["size"], r["profile"], r["_n"]) for r in counted.collect()]
    names = list(shares)
    given = [(size, profile, *[sum(g[: i + 1]) for i in range(len(names))]) for (size, profile), g in allocate(bundles, shares).items()]
    until = utterances.sparkSession.createDataFrame(given, "size bigint, profile int, " + ", ".join(f"_u{i} bigint" for i in range(len(names))))
    ranked = hash_rank(comps, ["size", "profile"], "component", sizes=counted)
    chosen = reduce(lambda c, i: c.when(F.col("rank") < F.col(f"_u{i}"), names[i]), range(len(names)), F)
    placed = cut(ranked.join(until, ["size", "profile"]).select("component", chosen.alias("split")), "placed")
    return balanced_join(records.select("utt_id", "component"), placed, "component").select("utt_id", "component", "split")


def membership(utterances: DataFrame) -> DataFrame:
    """``sid, component`` of every speaker: speakers of one component must share a split. One row per speaker, however many they share it with."""
    return speakers(utterances)[0].select("sid", "component")


#: Speakers of a component that one task pairs with all others of it.
TOGETHER = 256


def shared_pairs(members: DataFrame) -> DataFrame:
    """``utt_a, utt_b``: every two speakers of one component, ``members`` being ``sid, component``.

    The pairs are what is asked for, so their number is the result's; ``membership`` says the same in a row per speaker. A component of many speakers is
    cut into shards of about ``TOGETHER``, each of which meets all its speakers in a task of its own.
    """
    members = cut(members, "members")
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_shards"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    m = members.join(sizes, "component")
    a = m.select(F.col("sid").alias("utt_a"), "component", F.pmod(F.xxhash64("sid"), "_shards").alias("_shard"))
    b = m.select(F.col("sid").alias("utt_b"), "component", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard"))
    return a.join(b, ["component", "_shard"]).where("utt_a < utt_b").select("utt_a", "utt_b")
