"""The flat tables of steps' columns and of Gaussians have every field of the records."""

import datetime
import json

import __spark_entry__ as entry

PROPS = {"pipeline": [{"name": "mfcc", "columns": [0, 12]}, None, {"name": "pitch", "columns": [13, None, "x"]}, {"name": "delta", "columns": [[1, 2], 5]}], "columns": [7], "other": [{"columns": [8]}], "gaussians": [{"g": 3, "weight": 0.5}, {"g": 4}]}


def test_columns_and_g(spark, tmp_path):
    rows = [(1, json.dumps(PROPS), datetime.datetime(2020, 1, 1))]
    spark.createDataFrame(rows, "props_id bigint, properties string, written_at timestamp_ntz").write.parquet(f"{tmp_path}/feature_props.parquet")
    steps = {r.path: r.name for r in entry.queries()["p3_steps"](spark, str(tmp_path)).collect()}
    got = sorted((steps[r.path], r.place, r.value) for r in entry.queries()["p3_step_columns"](spark, str(tmp_path)).collect())
    assert got == [("delta", 1, 5), ("mfcc", 0, 0), ("mfcc", 1, 12), ("pitch", 0, 13), ("pitch", 1, None), ("pitch", 2, None)]
    assert sorted((r.g, r.weight) for r in entry.queries()["p3_gaussians"](spark, str(tmp_path)).collect()) == [(3, 0.5), (4, None)]
