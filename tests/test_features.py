import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import cmvn as C
from framespark.operators import frames as X
from framespark.operators import mixtures as M
from framespark.operators import utterances as U
from framespark.operators import alignments as A

SCHEMA = "item string, frame int, t0 double, t1 double, vec array<double>"


def make(spark, n=60, items=("a", "b"), seed=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, f, f * 0.01, None, r.normal(size=3).tolist()) for i in items for f in range(n)], SCHEMA)


def mat(df, item="a"):
    return np.array([r.vec for r in df.where(F.col("item") == item).orderBy("frame").collect()])


def test_cmvn_there_and_back(spark):
    f = make(spark)
    s = C.accumulate(f, ["item"])
    y = C.normalise(f, s, ["item"])
    assert np.allclose(mat(y).mean(0), 0) and np.allclose(mat(y).var(0), 1)
    assert np.allclose(mat(C.normalise(y, s, ["item"], reverse=True)), mat(f))
    with pytest.raises(Exception, match="no statistics"):
        C.normalise(f, C.accumulate(f.withColumn("w", F.lit(0.0)), ["item"], "w"), ["item"]).collect()


@pytest.mark.parametrize("center", [True, False])
def test_sliding_by_definition(spark, center):
    f = make(spark, 50)
    got, x = mat(C.sliding(f, center, 20, 5, True)), mat(f)
    for t in range(50):
        if center:
            b = min(max(t - 10, 0), 30)
            e = b + 20
        else:
            b, e = (0, 5) if t + 1 < 5 else (max(t - 19, 0), t + 1)
        w = x[b:e]
        assert np.allclose(got[t], (x[t] - w.mean(0)) / np.sqrt(np.maximum(w.var(0), 1e-10)))


def test_delta(spark):
    f = make(spark, 30)
    got, x = mat(X.delta(f, 2, 2)), mat(f)
    assert got.shape == (30, 9) and np.allclose(got[:, :3], x)
    at = lambda i: x[np.clip(i, 0, 29)]
    taps = X.delta_taps(2, 2)[2]
    assert np.allclose(got[:, 6:], [sum(c * at(t + k - 4) for k, c in enumerate(taps)) for t in range(30)])


def test_vad_extremes(spark):
    f = make(spark)
    assert X.vad(f, -1e10, 0.0).where("voiced = 0").count() == 0 and X.vad(f, 1e10, 0.0).where("voiced = 1").count() == 0


def test_concatenate_tolerance(spark):
    a, b = make(spark, 12), make(spark, 10, seed=1)
    with pytest.raises(Exception, match="one side only"):
        X.concatenate(a, b).collect()
    got = X.concatenate(a, b, 2)
    assert got.count() == 20 and np.allclose(mat(got), np.hstack([mat(a)[:10], mat(b)]))
    assert X.subsample(a, 5).count() == 6
    with pytest.raises(ValueError):
        X.subsample(a, 0)


def test_interpolation(spark):
    rows = [("a", i, 0.0, None, [float(v)]) for i, v in enumerate([0, 10, 0, 0, 40, 0])]
    d = X.interpolate_unvoiced(spark.createDataFrame(rows, SCHEMA), F.get("vec", F.lit(0)), F.get("vec", F.lit(0)) > 0)
    assert [r.filled for r in d.orderBy("frame").collect()] == [10, 10, 20, 30, 40, 40]


def test_mixture(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(size=(300, 3)) - 4, r.normal(size=(300, 3)) + 4])
    f = spark.createDataFrame([("a", i, 0.0, None, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    model, history = M.train(f, 2, num_iters=1, num_iters_init=5, subsample=1)
    assert np.allclose(sorted(model.mean[:, 0]), [-4, 4], atol=0.4) and history[4] >= history[1] - 1e-6
    p = M.posteriors(f, model, 2, 0.0).collect()
    assert all(abs(sum(q.p for q in row.post) - 1) < 1e-9 for row in p)
    assert all(sorted(row.gselect) == [0, 1] for row in M.select(f, model, 9).collect())
    with pytest.raises(ValueError, match="too few frames"):
        M.initial(f.limit(5), 3)
    with pytest.raises(ValueError, match="zero variance"):
        M.initial(f.withColumn("vec", F.array(F.lit(1.0), F.lit(2.0))), 2)
    a = np.hstack([np.diag([2.0, 1, 1]), np.ones((3, 1))])
    y = f.withColumn("vec", F.array(F.get("vec", F.lit(0)) * 2 + 1, F.get("vec", F.lit(1)) + 1, F.get("vec", F.lit(2)) + 1))
    assert np.allclose(M.mapping_transform(f, y, 3), a, atol=1e-6)
    same = {1.0: np.hstack([np.eye(3), np.zeros((3, 1))]), 1.1: a}
    assert M.choose_warps(f, model, same, "item").first().warp == 1.0


def test_alignment_and_one_hot(spark):
    toy = spark.createDataFrame([("x", 0.0, 1.0, "a"), ("x", 1.0, 2.0, "b"), ("x", 2.0, 3.001, "c")], "item string, onset double, offset_s double, token string")
    assert A.validate(toy).first().valid
    assert [(r.onset, r.offset_s, r.token) for r in A.clip(toy, 0.5, 2.5).orderBy("onset").collect()] == [(0.5, 1.0, "a"), (1.0, 2.0, "b"), (2.0, 2.5, "c")]
    assert A.clip(toy, 2.0, 2.0).count() == 0
    assert [r.token for r in A.at_rate(toy, 2.0).orderBy("i").collect()] == list("aabbccc")
    assert [r.vec for r in A.one_hot(toy).orderBy("frame").collect()] == [[i == j for j in range(3)] for i in range(3)]
    with pytest.raises(Exception, match="undefined"):
        A.one_hot(toy, spark.createDataFrame([("a", 0)], "token string, idx int")).collect()
    assert A.framed_one_hot(toy, 100, 0.5, 1.0).count() == 5


def test_fit_to_duration(spark):
    rows = [("u1", "f", "s1", None, 0.5), ("u2", "f", "s1", None, 1.0), ("u3", "f", "s2", None, 1.2), ("u4", "f", None, None, 9.0)]
    d = spark.createDataFrame(rows, "name string, audio_file string, speaker string, tstart double, duration double")
    assert {r.name: r.duration for r in U.fit_to_duration(d, 1.0).collect()} == {"u1": 0.5, "u2": 0.5, "u3": 1.0}
    with pytest.raises(Exception, match="not enough utterances"):
        U.fit_to_duration(d, 1.3).collect()
    assert {r.name: r.duration for r in U.fit_to_duration(d, 1.3, truncate=True).collect()} == {"u1": 0.5, "u2": 0.8, "u3": 1.2}


def test_union_sample_and_shuffle(spark):
    rows = [(i, f, [float(f)]) for i in ("a", "b", "c") for f in range(40)]
    df = spark.createDataFrame(rows, "item string, frame int, vec array<double>")
    with pytest.raises(Exception, match="both collections: b"):
        X.union(df.where("item < 'c'"), df.where("item > 'a'")).collect()
    for n in (1, 17, 500):
        got = [(r.item, r.frame) for r in X.sample(df, n, 3).collect()]
        assert len(got) == len(set(got)) == min(n, 120) and got == [(r.item, r.frame) for r in X.sample(df.repartition(5), n, 3).collect()]
    with pytest.raises(ValueError):
        X.sample(df, 0)
    places = {s: {r.item: r.place for r in X.shuffled(df, s).collect()} for s in (0, 1)}
    assert all(len(set(p.values())) == 3 for p in places.values()) and places[0] != places[1]
    timed = lambda d: d.withColumns({"t0": F.col("frame") * 0.01, "t1": F.lit(None).cast("double")})
    assert tuple(X.collection_valid(timed(df)).first()) == (3, True, None)
    assert not X.collection_valid(timed(df.unionByName(spark.createDataFrame([("d", 0, [1.0, 2.0])], df.schema)))).first().valid


def test_gaussians(spark):
    """Full covariances against the density written out; a choice within an earlier one; weighted normal equations."""
    from framespark.operators import mixtures as M

    r = np.random.default_rng(1)
    x, c = r.normal(size=(9, 3)), np.array([[2.0, 0.5, 0.1], [0.5, 1.0, 0.2], [0.1, 0.2, 1.5]])
    m = np.array([0.3, -1.0, 2.0])
    want = np.log(0.4) - 0.5 * (np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) + 3 * np.log(2 * np.pi) + np.log(np.linalg.det(c)))
    assert np.allclose(M.full_loglik(x, [0.4], [m], [c])[:, 0], want)
    with pytest.raises(ValueError, match="Gaussian 0"):
        M.full_loglik(x, [1.0], [m], [-c])
    model = M.Mixture(np.full(4, 0.25), np.arange(4.0)[:, None] * np.ones((4, 3)), np.ones((4, 3)))
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "item string, frame int, vec array<double>")
    earlier = spark.createDataFrame([("a", i, [3, 0, 2]) for i in range(8)] + [("a", 8, [])], "item string, frame int, gselect array<int>")
    got = {g.frame: g.gselect for g in M.reselect(df, model, earlier, 2).collect()}
    ll = model.loglik(x)
    assert got == {i: sorted([0, 2, 3], key=lambda g: -ll[i, g])[:2] for i in range(8)}
    w = spark.createDataFrame([("a", i, 0.5 * (i % 3)) for i in range(9)], "item string, frame int, weight double")
    y = df.withColumn("vec", F.transform("vec", lambda v: v * 2 + 1))
    cells = {(q.i, q.j): (q.q, q.l) for q in M.normal_equations(df, y, 3, w).collect()}
    k, xp = 0.5 * (np.arange(9) % 3), np.hstack([x, np.ones((9, 1))])
    assert all(np.isclose(cells[i, j][0], (k * xp[:, i] * xp[:, j]).sum()) for i in range(4) for j in range(4))
    assert all(np.isclose(cells[i, j][1], (k * xp[:, i] * (2 * x[:, j] + 1)).sum()) for i in range(4) for j in range(3))
