"""Maps between warps and the choice of a warp, against direct definitions."""

import numpy as np
import pytest

from framespark.operators import mixtures as M
from framespark.plans.pipeline import default_config

SCHEMA = "item string, frame int, spk string, vec array<double>"


def frames(spark, x, speakers):
    return spark.createDataFrame([(s, i, s, v.tolist()) for i, (s, v) in enumerate(zip(speakers, x))], SCHEMA)


def test_rows_keep_the_variance(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 2)) * [1.0, 3.0] + 2
    y = x @ np.array([[2.0, 0.3], [-0.4, 0.5]]).T + r.normal(size=x.shape) + 1
    who = ["a"] * len(x)
    plain, warped = frames(spark, x, who), frames(spark, y, who)
    a, b = M.mapping_transform(plain, warped, 2), M.mapping_transform(plain, warped, 2, True)
    assert np.allclose((x @ b[:, :2].T).var(0), x.var(0)) and not b[:, 2].any()
    assert np.allclose(b[:, :2] / np.linalg.norm(b[:, :2], axis=1)[:, None], a[:, :2] / np.linalg.norm(a[:, :2], axis=1)[:, None])


@pytest.mark.parametrize("norm_type", ["none", "offset", "diag"])
def test_warp_offset_and_scale(spark, norm_type):
    """Speakers whose frames are the model's, turned back by 0.87 and by 1.2 and then moved."""
    r = np.random.default_rng(1)
    model = M.Mixture(np.array([0.5, 0.5]), np.array([[-6.0, 0.0], [6.0, 1.0]]), np.full((2, 2), 0.3))
    turn = lambda w: np.array([[np.cos(w), -np.sin(w)], [np.sin(w), np.cos(w)]])
    maps = {w: np.hstack([turn(w - 1), np.zeros((2, 1))]) for w in (round(0.85 + 0.01 * i, 6) for i in range(41))}
    move, stretch = (0.0 if norm_type == "none" else 0.4), (1.25 if norm_type == "diag" else 1.0)
    x, who = [], []
    for spk, w in (("a", 0.87), ("b", 1.2)):
        g = r.integers(0, 2, 3000)
        z = model.mean[g] + r.normal(size=(3000, 2)) * np.sqrt(0.3)
        x.append(((z - move) / stretch) @ turn(w - 1))
        who += [spk] * 3000
    f = frames(spark, np.vstack(x), who)
    got = {q.spk: q for q in M.choose_warps(f, model, maps, "spk", norm_type=norm_type).collect()}
    assert abs(got["a"].warp - 0.87) < 0.021 and abs(got["b"].warp - 1.2) < 0.021
    for q in got.values():
        assert np.allclose(q.offset, move, atol=0.15) and np.allclose(q.scale, stretch, atol=0.05)


def test_defaults():
    c = default_config("mfcc", vtln=True)["vtln"]
    assert (c["warp_step"], c["num_gauss"], c["num_iters"], c["norm_type"], c["subsample"]) == (0.01, 64, 15, "offset", 5)


def test_unknown_norm_type(spark):
    f = frames(spark, np.zeros((2, 2)), ["a", "a"])
    with pytest.raises(ValueError, match="norm_type"):
        M.choose_warps(f, None, {1.0: np.eye(2, 3)}, "spk", norm_type="full")
