"""Feature collections on disk: Parquet (the native one), CSV folders, NumPy archives, and binary archives of matrices (ark)."""

from __future__ import annotations

import io
import json
import os
import re
import struct
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.operators.blocks import groups, matrix, vectors
from framespark.plans.ship import ship

SCHEMA = "item string, frame int, t0 double, t1 double, vec array<double>"


def _batch(item: str, times: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    n = len(data)
    t1 = pa.array(times[:, 1]) if times.ndim == 2 and times.shape[1] == 2 else pa.nulls(n, pa.float64())
    t0 = times[:, 0] if times.ndim == 2 else times
    return pa.RecordBatch.from_arrays([pa.array([item] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(t0.astype(np.float64)), t1, vectors(data)], ["item", "frame", "t0", "t1", "vec"])


def _whole(features: DataFrame, properties: DataFrame | None) -> DataFrame:
    """Frames by item; an item's properties, if any, are a row before its frames."""
    rows = features.select("item", "frame", F.col("t0").cast("double"), F.col("t1").cast("double"), F.col("vec").cast("array<double>"), F.lit(None).cast("string").alias("properties"))
    if properties is not None:
        rows = rows.unionByName(properties.select("item", F.lit(None).cast("int").alias("frame"), F.col("properties").cast("string").alias("properties")), allowMissingColumns=True)
    return rows.repartition("item").sortWithinPartitions("item", "frame")


def _times(t: pa.Table) -> np.ndarray:
    t0 = t.column("t0").to_numpy()
    return t0 if t.column("t1").null_count else np.stack([t0, t.column("t1").to_numpy()], axis=1)


def _name(item: str) -> str:
    """A file's name for an item: as it is, but for signs that names of files can't have."""
    return "".join(c if c.isprintable() and c not in "/\\%:*?\"<>|" and not (i == 0 and c in "._") else "".join(f"%{b:02X}" for b in c.encode()) for i, c in enumerate(item))


def _system(target: str):
    """(file system, path in it) of a folder: the cluster's by its scheme, else the local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(target))


def _put(target: str, name: str, content: bytes) -> None:
    """A file appears whole or not at all, so a task that is run again does no harm."""
    system, folder = _system(target)
    part = f"{folder}/.{name}.{os.getpid()}.part"
    with system.open_output_stream(part) as f:
        f.write(content)
    system.move(part, f"{folder}/{name}")


def _items(batches):
    """(item, times, matrix, properties) of each item of sorted rows."""
    for t in groups(batches, ("item",)):
        props = None
        if t.column("frame")[0].as_py() is None:
            props, t = t.column("properties")[0].as_py(), t.slice(1)
        if t.num_rows:
            yield t.column("item")[0].as_py(), _times(t), matrix(t.column("vec")), props


def _write(features: DataFrame, target: str, properties: DataFrame | None, save) -> int:
    """Runs ``save(target, items)`` in each task, into a ``target`` that all executors share; it must not exist. The number of items."""
    from pyarrow import fs

    ship(features.sparkSession)
    system, folder = _system(target)
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        raise OSError(f"{target} already exists")
    system.create_dir(folder, recursive=True)

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([save(target, _items(batches))], pa.int64())], ["n"])

    return _whole(features, properties).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def save_csv(features: DataFrame, folder: str, properties: DataFrame | None = None) -> int:
    """One file per item: a header line with the types and the width, then rows of times and values; a JSON file of the same name with its properties, if any."""

    def save(where, items):
        n = 0
        for item, times, data, props in items:
            rows = np.hstack([times if times.ndim == 2 else times[:, None], data])
            text = io.StringIO()
            np.savetxt(text, rows, fmt="%.18e", header=f"data_dtype = {data.dtype}, times_dtype = {times.dtype}, features_ndims = {data.shape[1]}", comments="# ")
            _put(where, _name(item) + ".csv", text.getvalue().encode())
            if props:
                _put(where, _name(item) + ".json", props.encode())
            n += 1
        return n

    return _write(features, folder, properties, save)


_HEADER = re.compile(r"#\s*data_dtype = (\w+), times_dtype = (\w+), features_ndims = (\d+)\s*$")


def load_csv(spark: SparkSession, folder: str) -> DataFrame:
    def parse(path: str, content: bytes):
        head, _, body = content.decode().partition("\n")
        h = _HEADER.match(head)
        if not h:
            raise ValueError(f"no header in {path}")
        rows = np.loadtxt(io.StringIO(body), ndmin=2)
        width = rows.shape[1] - int(h[3])
        return [_batch(_item(path, ".csv"), rows[:, :width].astype(h[2]), rows[:, width:].astype(h[1]))]

    return _read(spark, folder, "csv", parse)


def _item(path: str, suffix: str) -> str:
    """The item of a file."""
    return unquote(path.rsplit("/", 1)[-1].removesuffix(suffix))


def save_npz(features: DataFrame, folder: str, properties: DataFrame | None = None) -> int:
    """One archive per item with ``item``, ``data``, ``times`` and ``properties``; nothing in it is pickled."""

    def save(where, items):
        n = 0
        for item, times, data, props in items:
            buffer = io.BytesIO()
            np.savez_compressed(buffer, item=np.array(item), data=data, times=times, properties=np.array(props or ""))
            _put(where, _name(item) + ".npz", buffer.getvalue())
            n += 1
        return n

    return _write(features, folder, properties, save)


def load_npz(spark: SparkSession, folder: str) -> DataFrame:
    def parse(path: str, content: bytes):
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            return [_batch(str(z["item"]), z["times"], z["data"])]

    return _read(spark, folder, "npz", parse)


def ark_entry(key: str, x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x, np.float64 if x.dtype == np.float64 else np.float32)
    kind = b"DM " if x.dtype == np.float64 else b"FM "
    return key.encode() + b" \0B" + kind + b"\x04" + struct.pack("<i", x.shape[0]) + b"\x04" + struct.pack("<i", x.shape[1]) + x.tobytes()


def ark_entries(content: bytes):
    """(key, matrix) of a binary archive of float or double matrices."""
    at = 0
    while at < len(content):
        blank = content.index(b" ", at)
        key = content[at:blank].decode()
        if content[blank + 1 : blank + 3] != b"\0B":
            raise ValueError("not a binary archive")
        kind = content[blank + 3 : blank + 6]
        if kind not in (b"DM ", b"FM "):
            raise ValueError(f"unsupported matrix type {kind!r}")
        rows, cols = struct.unpack("<xixi", content[blank + 6 : blank + 16])
        dtype = "<f8" if kind == b"DM " else "<f4"
        start = blank + 16
        at = start + rows * cols * int(dtype[-1])
        yield key, np.frombuffer(content, dtype, rows * cols, start).reshape(rows, cols)


def _key(item: str) -> str:
    """A key of an archive: an item without blanks."""
    return "".join(f"%{ord(c):02X}" if c in " %\t\n\r" else c for c in item)


def save_ark(features: DataFrame, folder: str, properties: DataFrame | None = None, scp: bool = False) -> int:
    """Each task writes an archive of its items' matrices, ``part-N.ark``, one of their times, ``.times.ark`` (those of one dimension as one row), and
    their properties and types, ``.properties.json``; with ``scp`` also tables of where in the archives a key's matrix is. Each such set is a collection by itself."""

    def save(where, items):
        from pyspark import TaskContext

        root = f"part-{TaskContext.get().partitionId():05d}"
        data_, times_, places, told = io.BytesIO(), io.BytesIO(), {"": [], ".times": []}, {}
        for item, times, data, props in items:
            key = _key(item)
            for suffix, out, x in (("", data_, data), (".times", times_, np.atleast_2d(times))):
                places[suffix].append(f"{key} {where.rstrip('/')}/{root}{suffix}.ark:{out.tell() + len(key.encode()) + 1}\n")
                out.write(ark_entry(key, x.astype(np.float64)))
            told[key] = (json.loads(props) if props else {}) | {"__dtype_data__": str(data.dtype), "__dtype_times__": str(times.dtype)}
        if told:
            for suffix, out in (("", data_), (".times", times_)):
                _put(where, f"{root}{suffix}.ark", out.getvalue())
                if scp:
                    _put(where, f"{root}{suffix}.scp", "".join(places[suffix]).encode())
            _put(where, f"{root}.properties.json", json.dumps(told, indent=4).encode())
        return len(told)

    return _write(features, folder, properties, save)


def load_ark(spark: SparkSession, folder: str) -> DataFrame:
    """Of an archive's three files; one that lacks another, or has other keys than it, is an error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ark,json}").load(folder).select("path", "content")
    kind = F.when(F.col("path").endswith(".times.ark"), "times").when(F.col("path").endswith(".ark"), "data").when(F.col("path").endswith(".properties.json"), "told")
    sets = files.select(F.regexp_replace("path", r"(\.times\.ark|\.properties\.json|\.ark)$", "").alias("root"), kind.alias("kind"), "content").where("kind is not null")
    sets = sets.groupBy("root").agg(*(F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("data", "times", "told")))

    def run(batches):
        for b in batches:
            for root, *contents in zip(*(c.to_pylist() for c in b.columns)):
                lacks = [n for n, c in zip((".ark", ".times.ark", ".properties.json"), contents) if c is None]
                if lacks:
                    raise ValueError(f"{root} has no {lacks[0]}")
                data, times, told = dict(ark_entries(contents[0])), dict(ark_entries(contents[1])), json.loads(contents[2])
                for name, keys in (("times", times), ("properties", told)):
                    if set(keys) != set(data):
                        raise ValueError(f"{root}: the items of data and {name} are not the same: {sorted(set(keys) ^ set(data))[:3]}")
                for key, x in data.items():
                    t = times[key].astype(told[key]["__dtype_times__"])
                    yield _batch(unquote(key), t[0] if len(t) == 1 and (t.shape[1] != 2 or len(x) != 1) else t, x.astype(told[key]["__dtype_data__"]))

    return sets.mapInArrow(run, SCHEMA)


def _read(spark: SparkSession, folder: str, suffix: str, parse) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                yield from parse(p, c.as_buffer().to_pybytes())

    return files.mapInArrow(run, SCHEMA)


def save_parquet(features: DataFrame, folder: str, properties: DataFrame | None = None) -> None:
    """Frames by ranges of items; properties in the folder ``_properties`` within, which readers of the frames leave out."""
    features.repartitionByRange("item").sortWithinPartitions("item", "frame").write.mode("errorifexists").parquet(folder)
    if properties is not None:
        properties.select("item", "properties").write.parquet(f"{folder}/_properties")


def load_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def load_properties(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """``item, properties`` (JSON) of the items that were saved with some."""
    kind = _kind(folder, kind)
    if kind == "parquet":
        return spark.read.schema("item string, properties string").parquet(f"{folder}/_properties")
    ship(spark)
    glob = {"csv": "*.json", "npz": "*.npz", "ark": "*.properties.json"}[kind]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            out = []
            for path, c in zip(b.column(0).to_pylist(), b.column(1)):
                c = c.as_buffer().to_pybytes()
                if kind == "csv":
                    out.append((_item(path, ".json"), c.decode()))
                elif kind == "npz":
                    with np.load(io.BytesIO(c), allow_pickle=False) as z:
                        out.append((str(z["item"]), str(z["properties"]) if "properties" in z else ""))
                else:
                    told = {k: {n: x for n, x in v.items() if not n.startswith("__dtype_")} for k, v in json.loads(c).items()}
                    out += [(unquote(k), json.dumps(v) if v else "") for k, v in told.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["item", "properties"])

    return files.mapInArrow(run, "item string, properties string").where("properties != ''")


SAVE = {"parquet": save_parquet, "csv": save_csv, "npz": save_npz, "ark": save_ark}
LOAD = {"parquet": load_parquet, "csv": load_csv, "npz": load_npz, "ark": load_ark}
UNSUPPORTED = {"pickle": "it would run code of the file's author", "matlab": "it needs scipy", "h5features": "it needs h5py"}
#: Kinds by the end of a folder's name.
EXTENSIONS = {"": "parquet", ".parquet": "parquet", ".csv": "csv", ".npz": "npz", ".ark": "ark", ".pkl": "pickle", ".mat": "matlab", ".h5f": "h5features"}


def _kind(folder: str, kind: str | None) -> str:
    """The kind given, or that of the folder's extension; an unknown one is an error."""
    if kind is None:
        extension = os.path.splitext(folder.rstrip("/"))[1]
        if extension not in EXTENSIONS:
            raise ValueError(f"unknown extension {extension}, must be in {sorted(EXTENSIONS)}")
        kind = EXTENSIONS[extension]
    if kind in UNSUPPORTED:
        raise ValueError(f"{kind} is not supported: {UNSUPPORTED[kind]}; use parquet")
    if kind not in SAVE:
        raise ValueError(f"unknown kind {kind}, must be in {sorted(SAVE)}")
    return kind


def save(features: DataFrame, folder: str, kind: str | None = None, properties: DataFrame | None = None, **more):
    """Writes features, and with ``properties`` (``item, properties``) these, as ``kind`` or by the folder's extension."""
    return SAVE[_kind(folder, kind)](features, folder, properties, **more)


def load(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    return LOAD[_kind(folder, kind)](spark, folder)
