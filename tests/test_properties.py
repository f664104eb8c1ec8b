import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import properties as P
from framespark.operators.mixtures import Mixture
from framespark.operators.spectral import crepe_post

SCHEMA = "item string, frame int, t0 double, t1 double, vec array<double>"


def test_pipeline_of_columns(spark):
    f = spark.createDataFrame([("a", 0, 0.0, None, [1.0] * 13), ("a", 1, 0.1, None, [1.0] * 13)], SCHEMA)
    p = P.then(P.then(P.start(f, "mfcc", {"num_ceps": 13}), "cmvn", {}), "delta", {"order": 2}, 3)
    q = P.start(f.withColumn("vec", F.slice("vec", 1, 3)), "pitch", {})
    r = P.paste(p, q).first()
    assert [(s.name, s.columns) for s in r.pipeline] == [("mfcc", [0, 12]), ("cmvn", [0, 12]), ("delta", [0, 38]), ("pitch", [39, 41])]
    assert set(r.params) == {"mfcc", "cmvn", "delta", "pitch"}
    assert P.from_json(P.as_json(P.paste(p, q))).first() == r


def test_models_on_disk(spark, tmp_path):
    w = spark.createDataFrame([("s1", 0.9), ("s2", 1.1)], "speaker string, warp double")
    P.save_warps(w, str(tmp_path / "w.yaml"), "speaker")
    assert sorted(P.load_warps(spark, str(tmp_path / "w.yaml"), "speaker").collect()) == sorted(w.collect())
    with pytest.raises(FileExistsError):
        P.save_warps(w, str(tmp_path / "w.yaml"), "speaker")
    m = Mixture(np.array([0.4, 0.6]), np.array([[1.0, 2], [3, 4]]), np.array([[1.0, 4], [0.5, 2]]))
    m.frame(spark).write.parquet(str(tmp_path / "m"))
    n = Mixture.read(spark.read.parquet(str(tmp_path / "m")))
    assert np.allclose(n.mean, m.mean) and np.allclose(n.var, m.var) and np.allclose(n.weight, m.weight)


def test_crepe_post(spark):
    pov = [0.0] * 5 + [0.95] * 10 + [0.05] * 12 + [0.95] * 10
    rows = [("a", i, 0.0, None, [p, 100.0 + i if p > 0.5 else 5000.0]) for i, p in enumerate(pov)]
    out = crepe_post(spark.createDataFrame(rows, SCHEMA), add_raw=True, add_pov=False, add_normalized=False, add_delta=False).orderBy("frame").collect()
    assert np.allclose([np.exp(r.vec[0]) for r in out], [105.0] * 5 + [100.0 + i for i in range(5, 37)])
    with pytest.raises(Exception, match="no voiced frames"):
        crepe_post(spark.createDataFrame([("a", i, 0.0, None, [0.0, 1.0]) for i in range(9)], SCHEMA)).collect()
