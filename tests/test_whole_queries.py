"""The queries over all items, against NumPy on a table whose monitor is longer than two blocks and lacks frames."""

import datetime

import numpy as np
import pytest

import __spark_entry__ as entry
from framespark.operators.blocks import BLOCK
from framespark.operators.frames import delta_taps

SCHEMA = "item string, frame int, t0 double, t1 double, vec array<float>, ingested_at timestamp_ntz"
GONE = (7, BLOCK - 1, BLOCK, 2 * BLOCK + 3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(0)
    at = datetime.datetime(2020, 1, 1)
    rows = [(i, f, f * 0.01, None, r.normal(size=8).astype(np.float32).tolist(), at) for i, n in (("mon-a", 2 * BLOCK + 50), ("u1", 30), ("u2", 1)) for f in range(n) if i != "mon-a" or f not in GONE]
    out = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{out}/features.parquet")
    items = {}
    for i, f, _, _, v, _ in rows:
        items.setdefault(i, []).append((f, v))
    return out, {i: ([f for f, _ in v], np.array([x for _, x in v])) for i, v in items.items()}


def derived(x, order):
    parts = [x]
    for t in delta_taps(order, 2)[1:]:
        half = len(t) // 2
        parts.append(sum(c * x[np.clip(np.arange(len(x)) + j - half, 0, len(x) - 1)] for j, c in enumerate(t)))
    return np.hstack(parts)


def normal(x, items):
    every = np.vstack([v for _, v in items.values()])
    return (x - every.mean(0)) / every.std(0)


WHOLE = {
    "concat_positional": lambda x, items: x,
    "delta_1": lambda x, items: derived(x, 1),
    "delta_2": lambda x, items: derived(x, 2),
    "pipeline_cmvn_delta": lambda x, items: derived(normal(x, items), 1),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_items(spark, folder, name):
    path, items = folder
    got = {}
    for r in entry.queries()[name](spark, path).orderBy("item", "frame").collect():
        got.setdefault(r.item, []).append((r.frame, r.vec))
    assert set(got) == set(items)
    for item, (frames, x) in items.items():
        assert [f for f, _ in got[item]] == frames
        assert np.abs(np.array([v for _, v in got[item]]) - WHOLE[name](x, items)).max() < 1e-4


def test_entry_has_the_monitor(spark, data):
    assert entry.entry(spark).where("item like 'mon%'").count() > 0
