"""Properties of features: which processors made which columns, with their parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "item string, pipeline array<struct<name:string,columns:array<int>>>, params map<string,string>"


def start(features: DataFrame, name: str, params: dict) -> DataFrame:
    """``item, pipeline, params`` after the first processor: its name, its first and last column, and its parameters as JSON."""
    width = features.groupBy("item").agg(F.max(F.size("vec")).alias("_n"))
    step = F.struct(F.lit(name).alias("name"), F.array(F.lit(0), F.col("_n") - 1).alias("columns"))
    return width.select("item", F.array(step).alias("pipeline"), F.create_map(F.lit(name), F.lit(json.dumps(params, sort_keys=True, default=str))).alias("params"))


def then(props: DataFrame, name: str, params: dict, factor: int = 1) -> DataFrame:
    """After a post-processor over all columns; ``factor``: how many columns it makes of each."""
    last = F.array_max(F.transform("pipeline", lambda s: F.element_at(s["columns"], -1)))
    step = F.struct(F.lit(name).alias("name"), F.array(F.lit(0), (last + 1) * factor - 1).alias("columns"))
    added = F.create_map(F.lit(name), F.lit(json.dumps(params, sort_keys=True, default=str)))
    return props.withColumns({"pipeline": F.concat("pipeline", F.array(step)), "params": F.map_concat(F.map_filter("params", lambda k, v: k != name), added)})


def paste(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of features whose columns are pasted together: the right ones' columns move by the left ones' width."""
    r = right.select("item", F.col("pipeline").alias("_p"), F.col("params").alias("_m"))
    width = F.array_max(F.transform("pipeline", lambda s: F.element_at(s["columns"], -1))) + 1
    moved = F.transform("_p", lambda s: F.struct(s["name"].alias("name"), F.transform(s["columns"], lambda c: c + width).alias("columns")))
    own = F.map_filter("params", lambda k, v: ~F.array_contains(F.map_keys("_m"), k))
    return left.join(r, "item").select("item", F.concat("pipeline", moved).alias("pipeline"), F.map_concat(own, "_m").alias("params"))


def as_json(props: DataFrame) -> DataFrame:
    return props.select("item", F.to_json(F.struct("pipeline", "params")).alias("properties"))


def from_json(props: DataFrame) -> DataFrame:
    inner = SCHEMA.removeprefix("item string, ")
    return props.select("item", F.from_json("properties", inner).alias("p")).select("item", "p.*")


def save_warps(warps: DataFrame, path: str, key: str) -> None:
    """``key: warp`` lines of YAML; an existing file is an error. Warps are one number a key: a large table goes to Parquet instead."""
    import yaml

    if warps.count() > 1_000_000:
        raise ValueError("too many warps for a YAML file; write Parquet")
    with open(path, "x", encoding="utf-8") as f:
        yaml.safe_dump({r[0]: float(r[1]) for r in warps.select(key, "warp").orderBy(key).collect()}, f, allow_unicode=True, sort_keys=False)


def load_warps(spark: SparkSession, path: str, key: str) -> DataFrame:
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f) or {}
    return spark.createDataFrame([(str(k), float(v)) for k, v in rows.items()], f"{key} string, warp double")
