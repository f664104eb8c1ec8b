import datetime as dt

import numpy as np

from framespark.operators import plausible as P

SCHEMA = "item string, frame int, t0 double, t1 double, vec array<float>, ingested_at timestamp_ntz, _block string"
T = dt.datetime(2001, 1, 1)


def item(name, n, seed, edit=None, one_d=False):
    r = np.random.default_rng(seed)
    v = np.cumsum(r.normal(size=(n, 8)), axis=0) * 0.2 + r.normal(size=(n, 8)) + np.arange(8) * 5
    v[:, 1], v[:, 2] = r.uniform(0.1, 0.9, n), np.where(np.arange(n) % 20 < 5, 0.0, r.uniform(100, 200, n))
    t0 = 3.0 + np.arange(n) * 0.01
    t1 = t0 + 0.025
    if edit:
        edit(v, t0, t1)
    return [(name, i, float(t0[i]), None if one_d else float(t1[i]), [float(x) for x in v[i]], T, "clash") for i in range(n)]


def flagged(spark, rows):
    return {(r.item, r.frame): {k for k in P.REASONS if r[k]} for r in P.flags(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_planted(spark):
    def edit(v, t0, t1):
        v[50, 3] += 60  # spike of one frame
        v[80:83, 0] -= 60  # of three
        v[100:, 4] += 60  # a step for good
        v[120:124, 5] += 60  # four frames: a level
        v[130:138, 6] = v[130, 6]  # stuck for eight
        v[140:147, 7] = v[140, 7]  # for seven only
        v[150, 1], v[151, 2], v[152, 2] = 1.5, -1.0, 1501.0
        v[153, 0] = np.nan
        t1[160], t0[161], t0[162] = t0[160], -1.0, t0[162] + 5

    got = flagged(spark, item("a", 200, 1, edit) + item("b", 150, 2))
    want = {50: "spike", 80: "spike", 81: "spike", 82: "spike", 150: "out_of_range", 151: "out_of_range", 152: "out_of_range", 153: "not_finite", 160: "time", 161: "time", 162: "time"} | {f: "stuck" for f in range(130, 138)}
    assert {f: next(iter(r)) for (i, f), r in got.items() if i == "a" and len(r) == 1} == {f: w for f, w in want.items() if f not in (162,)} | ({162: "time"} if got["a", 162] == {"time"} else {})
    assert "time" in got["a", 162] and not [k for k in got if k[0] == "b"]


def lengthy(n=6000):
    def edit(v, t0, t1):
        for f in range(40, n, 97):
            v[f, 3] += 80
        v[2044:2052, 4] = v[2044, 4]
        v[:, 6] *= np.where(np.arange(n) < 1000, 0.01, 1.0)  # quiet at first: the scatter is the whole item's
        v[500, 6] += 2
        t0[2048:2560] += 5
        t1[2048:2560] += 5
        t0[n - 10], t1[n - 10] = t0[n - 10] - 2, t1[n - 10] - 2

    return item("long", n, 5, edit)


def test_blocks_agree_with_the_whole(spark, monkeypatch):
    """An item of three blocks is judged as it is when it is one block: same variances, scatter and grid, and nothing lost at seams."""
    rows = lengthy()
    got = flagged(spark, rows + item("short", 100, 9))
    frame, t0, t1, vec = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
    monkeypatch.setattr(P, "BLOCK", 1 << 20)
    vec = vec.astype(np.float32).astype(float)
    (want,) = P.judge([P.Part("long", 0, frame, t0, t1, np.ones(len(rows), bool), vec, np.ones(vec.shape, bool))], False)
    assert {k for k in P.REASONS if want[k].any()} == {"spike", "stuck", "time"}
    assert got == {("long", f): r for f in range(len(rows)) if (r := {k for k in P.REASONS if want[k][f]})}
    assert {f for (_, f), r in got.items() if "time" in r} == set(range(2048, 2560)) | {5990}
    assert {f for (_, f), r in got.items() if "stuck" in r} == set(range(2044, 2052))
    assert {f for (_, f), r in got.items() if "spike" in r} == set(range(40, 6000, 97))


def test_any_width(spark):
    rows = [(i, f, t0, t1, v + [float(np.sin(f * 1.7)) + (40.0 if f == 60 else 0.0)] if i == "w" else v[:k], at, x) for i, k in (("w", 8), ("one", 1), ("two", 2), ("none", 0)) for _, f, t0, t1, v, at, x in item(i, 120, 11)]
    assert flagged(spark, rows) == {("w", 60): {"spike"}}


def test_the_filter_alone(spark):
    """What the filter marks by itself: every spike and stuck run, besides what only it takes for one."""
    rows = lengthy(3000)
    sure = {k: r for k, r in flagged(spark, rows).items()}
    alone = {(r.item, r.frame): r for r in P.innovations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(alone[k].withheld for k, r in sure.items() if "spike" in r) and all(alone[k].vanishing for k, r in sure.items() if "stuck" in r)


def test_repeats_order_and_nulls(spark):
    rows = item("a", 120, 7, lambda v, t0, t1: v.__setitem__((60, 3), 900.0), one_d=True)
    wrong = ("a", 30, 3.3, None, [float("nan")] * 8, T - dt.timedelta(days=1), "x")
    rows = rows[::-1] + rows[:40] + [wrong, (None, 1, 0.0, None, None, None, None), ("c", None, None, None, None, None, None), ("d", 0, None, None, None, None, None), ("d", 1, None, None, [None] * 3, T, "")]
    assert flagged(spark, rows) == {("a", 60): {"spike"}}
    assert flagged(spark, []) == {}
    assert flagged(spark, item("s", 2, 1)) == {}


def test_kernels():
    r = np.random.default_rng(0)
    x = r.normal(size=(3, 200))
    x[0, 100] += 50
    z, held = P.kalman(x)
    assert held[0, 100] and held.sum() < 6 and abs(z).mean() < 1.5
    x = np.ones((1, 9))
    assert P.equal_runs(x, 8).all() and not P.equal_runs(x, 10).any()
    assert not any(a.any() for v in (3.0, np.nan) for a in P.spikes(np.full((2, 50), v)))
    assert P.vanished(x, np.ones(1)).all() and not P.vanished(np.arange(20.0)[None, :], np.ones(1)).any()
    assert P.of_bin(P.binned(np.array([0.0])))[0] == 0 and abs(np.log2(P.of_bin(P.binned(np.array([3.0, 1e-30, 1e30]))) / [3.0, 1e-30, 1e30])).max() <= 0.5 / P.BINS + 1e-6
