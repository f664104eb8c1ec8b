"""Audio files: headers and samples of WAV, read in parallel; WAV written one file per row."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framespark.plans.ship import ship


def wav_header(data: bytes, whole: int | None = None) -> dict:
    """Of the bytes of a RIFF file, or the first of ``whole``: nchannels, sample_rate, nsamples, duration, and how the samples are stored."""
    length = len(data) if whole is None else whole
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("unsupported codec: only WAV is read")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = at + 8
        if name == b"fmt ":
            kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", data[body : body + 16])
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack("<H", data[body + 24 : body + 26])[0]
            fmt = (kind, channels, rate, align, bits)
        elif name == b"data":
            if fmt is None:
                raise ValueError("cannot scan audio file: data before format")
            kind, channels, rate, align, bits = fmt
            n = min(size, length - body) // max(align, 1) if size != 0xFFFFFFFF else (length - body) // max(align, 1)
            return {"nchannels": channels, "sample_rate": rate, "nsamples": n, "duration": n / rate, "kind": kind, "bits": bits, "at": body}
        at = body + size + (size & 1)
    raise ValueError("cannot scan audio file: no samples")


def wav_samples(data: bytes) -> tuple[np.ndarray, int, str]:
    """([samples, channels], rate, dtype)."""
    h = wav_header(data)
    kinds = {(1, 16): ("<i2", "int16"), (1, 32): ("<i4", "int32"), (3, 32): ("<f4", "float32"), (3, 64): ("<f8", "float64")}
    if (h["kind"], h["bits"]) not in kinds:
        raise ValueError(f"unsupported codec: format {h['kind']} of {h['bits']} bits")
    raw, name = kinds[h["kind"], h["bits"]]
    x = np.frombuffer(data, raw, h["nsamples"] * h["nchannels"], h["at"])
    return x.reshape(-1, h["nchannels"]), h["sample_rate"], name


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    x = np.ascontiguousarray(x)
    x = x[:, None] if x.ndim == 1 else x
    kind = {"int16": (1, 16), "int32": (1, 32), "float32": (3, 32), "float64": (3, 64)}[str(x.dtype)]
    body = x.tobytes()
    align = x.shape[1] * kind[1] // 8
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind[0], x.shape[1], rate, rate * align, align, kind[1]) + b"data" + struct.pack("<I", len(body)) + body


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path)


HEAD = 1 << 16


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``file, nchannels, sample_rate, nsamples, duration`` of the WAV files under ``path``.

    Where workers can open a file its first ``HEAD`` bytes are read, and more only if the samples begin later; a file of another file system
    is read whole by Spark.
    """

    def headers(batches):
        for b in batches:
            rows = [_head(name, size) for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in _SCANNED)], ["file", *(k for k, _ in _SCANNED)])

    def whole(batches):
        for b in batches:
            rows = [wav_header(x.as_buffer().to_pybytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in _SCANNED)], ["file", *(k for k, _ in _SCANNED)])

    files = _files(spark, path, "wav")
    schema = "file string, nchannels int, sample_rate int, nsamples bigint, duration double"
    if "://" not in path or path.startswith("file:"):
        return files.select("path", "length").mapInArrow(headers, schema)
    return files.select("path", "content").mapInArrow(whole, schema)


_SCANNED = (("nchannels", pa.int32()), ("sample_rate", pa.int32()), ("nsamples", pa.int64()), ("duration", pa.float64()))


def _head(name: str, size: int) -> dict:
    with open("/" + name.removeprefix("file:").lstrip("/"), "rb") as f:
        read = HEAD
        while True:
            f.seek(0)
            try:
                return wav_header(f.read(read), size)
            except ValueError:
                if read >= size:
                    raise
                read = min(size, 16 * read)


def load(spark: SparkSession, path: str) -> DataFrame:
    """``file, channel, sample_rate, dtype, samples``: a row per channel of the WAV files under ``path``."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                x, rate, kind = wav_samples(content.as_buffer().to_pybytes())
                for c in range(x.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c], pa.int32()), pa.array([rate], pa.int32()), pa.array([kind]), pa.array([x[:, c].astype(np.float64)], pa.list_(pa.float64()))], ["file", "channel", "sample_rate", "dtype", "samples"])

    return _files(spark, path, "wav").select("path", "content").mapInArrow(run, "file string, channel int, sample_rate int, dtype string, samples array<double>")


def list_files(spark: SparkSession, path: str, suffix: str, recursive: bool = True) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return d.select("path", "length", "modificationTime")


def save(row_samples: np.ndarray, rate: int, target: str) -> None:
    """Writes one signal; an existing file is an error."""
    with open(target, "xb") as f:
        f.write(wav_bytes(row_samples, rate))
