"""Windows over rows, with blocks so short that every seam and level is crossed, also where frames are missing."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import ALL, SQL, flat

from framespark.operators import blocks
from framespark.operators.frames import delta, delta_taps

SEAMS = ("delta_1", "delta_2", "validate_features", "vad_context", "sliding_cmvn_center", "sliding_cmvn_causal", "pitch_post_columns", "pitch_mae_ger", "pipeline_cmvn_delta")


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "SPAN", 4)


@pytest.mark.parametrize("name", SEAMS)
def test_short_blocks_match_sql(spark, data, short, name):
    con = duckdb.connect()
    con.execute(f"create view features as select * from read_parquet('{data}/features.parquet')")
    df = ALL[name](spark, data)
    cols = sorted(df.columns)
    r = con.execute(SQL[name])
    at = [[x[0] for x in r.description].index(c) for c in cols]
    assert sorted("|".join(flat(x[c]) for c in cols) for x in df.collect()) == sorted("|".join(flat(x[i]) for i in at) for x in r.fetchall())


def test_gaps_are_no_neighbours(spark, short):
    frames = [*range(100), *range(300, 340), 345, 500, *range(900, 903), *range(5000, 5100)]
    rows = [("a", f, [float(i)]) for i, f in enumerate(frames)] + [("b", 3, [1.0])]
    got = {(r.item, r.frame): r.vec for r in delta(spark.createDataFrame(rows, "item string, frame int, vec array<double>"), 2).collect()}
    x = np.arange(len(frames), dtype=float)
    for i, t in enumerate(delta_taps(2, 2)):
        half = len(t) // 2
        want = sum(c * x[np.clip(np.arange(len(x)) + j - half, 0, len(x) - 1)] for j, c in enumerate(t))
        assert np.allclose([got["a", f][i] for f in frames], want)
    assert np.allclose(got["b", 3], [1.0, 0.0, 0.0])


def test_levels_keep_every_row(spark, short):
    rows = [(i, f) for i, n in (("a", 1000), ("b", 1), ("c", 40)) for f in range(0, 3 * n, 3)]
    df = spark.createDataFrame(rows, "item string, frame int")
    for reach in (1, 5, 40):
        got = blocks.windowed(df, reach, lambda d, w, r=reach: d.withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(-r, r)))).collect()
        size = {"a": 1000, "b": 1, "c": 40}
        assert sorted((r.item, r.frame) for r in got) == sorted(rows)
        assert all(r.n == min(r.frame // 3, reach) + min(size[r.item] - 1 - r.frame // 3, reach) + 1 for r in got)
