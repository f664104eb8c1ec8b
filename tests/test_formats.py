import json
import time

import numpy as np
import pytest

from framespark import __main__ as cli
from framespark.plans import pipeline
from framespark.sources import audio_files, collections, texts
from framespark.streaming.stateful import running_cmvn, running_rasta

SCHEMA = "item string, frame int, t0 double, t1 double, vec array<double>"


def feats(spark):
    r = np.random.default_rng(0)
    return spark.createDataFrame([(i, f, f * 0.01, None if i == "b" else f * 0.01 + 0.025, r.normal(size=4).tolist()) for i in ("æðÐ 1", "b") for f in range(7)], SCHEMA)


@pytest.mark.parametrize("kind", ["parquet", "csv", "npz", "ark"])
def test_round_trip(spark, tmp_path, kind):
    f, where = feats(spark), str(tmp_path / kind)
    collections.save(f, where, kind)
    assert sorted(map(tuple, collections.load(spark, where, kind).select(*f.columns).collect())) == sorted(map(tuple, f.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        collections.save(f, where, kind)


@pytest.mark.parametrize("kind", ["parquet", "csv", "npz", "ark"])
def test_properties_and_extensions(spark, tmp_path, kind):
    """By the extension alone, with properties of one item of two."""
    f, where = feats(spark), str(tmp_path / f"feats.{kind}")
    props = spark.createDataFrame([("æðÐ 1", json.dumps({"mfcc": {"名前": [1, 2.5]}}))], "item string, properties string")
    collections.save(f, where, properties=props)
    assert sorted(map(tuple, collections.load(spark, where).select(*f.columns).collect())) == sorted(map(tuple, f.collect()))
    assert [(r.item, json.loads(r.properties)) for r in collections.load_properties(spark, where).collect()] == [("æðÐ 1", {"mfcc": {"名前": [1, 2.5]}})]
    with pytest.raises(ValueError, match="extension"):
        collections.save(f, str(tmp_path / "feats.other"))


def test_archives(spark, tmp_path):
    """The three files of an archive, tables of places, and what is wrong with a part of them."""
    f, where = feats(spark).coalesce(1), tmp_path / "a.ark"
    collections.save(f, str(where), scp=True)
    for scp in where.glob("*.scp"):
        for line in scp.read_text().splitlines():
            key, place = line.split()
            path, at = place.rsplit(":", 1)
            content = open(path, "rb").read()[int(at) - len(key.encode()) - 1 :]
            assert next(collections.ark_entries(content))[0] == key
    told = next(where.glob("*.properties.json"))
    text = told.read_text()
    told.write_text(json.dumps({"x": {}}))
    with pytest.raises(Exception, match="not the same"):
        collections.load(spark, str(where)).collect()
    told.unlink()
    with pytest.raises(Exception, match="has no .properties.json"):
        collections.load(spark, str(where)).collect()
    told.write_text(text)
    next(where.glob("*.times.ark")).unlink()
    with pytest.raises(Exception, match="has no .times.ark"):
        collections.load(spark, str(where)).collect()


def test_names_of_files(spark, tmp_path):
    names = ["a/b", "a%2Fb", ".hidden", "_x", "q\"?*", "plain"]
    f = spark.createDataFrame([(n, 0, 0.0, None, [1.0]) for n in names], SCHEMA)
    collections.save(f, str(tmp_path / "n.csv"))
    assert sorted(r.item for r in collections.load(spark, str(tmp_path / "n.csv")).collect()) == sorted(names)


def test_unsupported(spark):
    for kind in ("pickle", "matlab", "h5features", "other"):
        with pytest.raises(ValueError):
            collections.load(spark, "x", kind)


@pytest.mark.parametrize("kind", ["int16", "int32", "float32"])
def test_wav(spark, tmp_path, kind):
    x = (np.arange(-50, 50) * (1 if kind != "float32" else 0.01)).astype(kind)
    audio_files.save(np.stack([x, x[::-1]], 1), 8000, str(tmp_path / "a.wav"))
    s = audio_files.scan(spark, str(tmp_path)).first()
    assert (s.nchannels, s.sample_rate, s.nsamples, s.duration) == (2, 8000, 100, 100 / 8000)
    got = {r.channel: r for r in audio_files.load(spark, str(tmp_path)).collect()}
    assert got[0].dtype == kind and np.allclose(got[0].samples, x) and np.allclose(got[1].samples, x[::-1])
    with pytest.raises(FileExistsError):
        audio_files.save(x, 8000, str(tmp_path / "a.wav"))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    with pytest.raises(Exception, match="unsupported codec"):
        audio_files.scan(spark, str(tmp_path)).collect()


def test_texts(spark, tmp_path):
    p = tmp_path / "u.txt"
    p.write_text("u1 a.wav s1 0 1.5\n\n u2 b.wav s2 1 2 \n")
    rows = texts.load_utterances(spark, str(p)).orderBy("name").collect()
    assert [(r.name, r.speaker, r.tstop) for r in rows] == [("u1", "s1", 1.5), ("u2", "s2", 2.0)]
    for bad in ("u1 a.wav\nu2 a.wav s\n", "u1 a.wav\nu1 b.wav\n", "u1\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            texts.load_utterances(spark, str(p))
    p.write_text("u1 a.wav 2 1\n")
    with pytest.raises(Exception, match="no interval of time"):
        texts.load_utterances(spark, str(p)).collect()
    p.write_text("i 0 0.5 a\ni 0.5 1 b\n")
    a = texts.load_alignments(spark, str(p))
    texts.save_alignments(a, str(tmp_path / "al"), sort=True, compress=True)
    assert texts.load_alignments(spark, str(tmp_path / "al")).collect() == a.collect()
    p.write_text("i 0 0.5\n")
    with pytest.raises(Exception, match="4 fields"):
        texts.load_alignments(spark, str(p)).collect()


def test_config():
    c = pipeline.default_config("mfcc", "kaldi", True, True, True)
    assert pipeline.read_config(pipeline.to_yaml(c)) == pipeline.read_config(c)
    for bad in ({}, {"mfcc": {}, "plp": {}}, {"mfcc": {}, "other": {}}, {"spectrogram": {}, "vtln": {}}, {"mfcc": {}, "delta": {"x": 1}}, {"mfcc": {}, "pitch": {"processor": "no"}}):
        with pytest.raises(ValueError):
            pipeline.read_config(bad)
    assert cli.main(["config", "other"]) == 1 and cli.main(["config", "mfcc", "--delta"]) == 0


def test_end_to_end(spark, tmp_path):
    r = np.random.default_rng(0)
    (tmp_path / "audio").mkdir()
    for n, k in (("a", 1), ("b", 1.3)):
        t = np.arange(16000) / 16000
        x = 4000 * np.sin(2 * np.pi * 150 * k * t) * (1 + np.sin(2 * np.pi * 3 * t)) + 30 * r.normal(size=16000)
        audio_files.save(x.astype(np.int16), 16000, str(tmp_path / "audio" / f"{n}.wav"))
    (tmp_path / "u.txt").write_text("u1 a.wav s1 0 1\nu2 a.wav s1 0.2 0.4\nu3 b.wav s2 0 1\n")
    c = pipeline.default_config("mfcc", "kaldi", True, True)
    c["mfcc"]["dither"] = 0.0
    (tmp_path / "c.yaml").write_text(pipeline.to_yaml(c))
    out = str(tmp_path / "out")
    assert cli.main(["extract", str(tmp_path / "c.yaml"), str(tmp_path / "u.txt"), str(tmp_path / "audio"), out]) == 0
    d = collections.load(spark, out)
    n = {r.item: r["count"] for r in d.groupBy("item").count().collect()}
    assert n == {"u1": 98, "u2": 18, "u3": 98} and {len(r.vec) for r in d.collect()} == {42}
    props = {r.item: json.loads(r.properties) for r in collections.load_properties(spark, out).collect()}
    assert set(props) == set(n) and [(p["name"], p["columns"]) for p in props["u1"]["pipeline"]] == [("mfcc", [0, 12]), ("cmvn", [0, 12]), ("delta", [0, 38]), ("pitch", [39, 41])]
    assert cli.main(["extract", "nowhere", "x", "y", "z"]) == 1


def test_crepe_in_the_pipeline(spark):
    """As many frames as the cepstra have, voicing turned into a correlation; one warp for all utterances."""
    from framespark.plans.spectral_queries import _convolutions

    r = np.random.default_rng(0)
    rows = [(f"{n}.wav", 16000, "int16", [float(int(v)) for v in 3000 * np.sin(np.arange(int(16000 * s)) * 0.06) + 20 * r.normal(size=int(16000 * s))]) for n, s in (("a", 1.0), ("b", 0.53))]
    signals = spark.createDataFrame(rows, "file string, sample_rate int, dtype string, samples array<double>")
    utts = spark.createDataFrame([("a", "a.wav"), ("b", "b.wav")], "name string, audio_file string")
    c = pipeline.default_config("mfcc", "crepe")
    c["mfcc"]["dither"] = 0.0
    got = pipeline.extract_features(spark, c, utts, signals, weights={"crepe": _convolutions()})
    counts = {x.item: (x.n, x.w) for x in got.selectExpr("item", "size(vec) w").groupBy("item", "w").count().selectExpr("item", "count n", "w").collect()}
    assert counts == {"a": (98, 16), "b": (51, 16)}
    assert all(np.isfinite(x.vec).all() for x in got.collect())
    plain = pipeline.extract_features(spark, {"mfcc": c["mfcc"]}, utts, signals)
    same, other = (pipeline.extract_warped(spark, {"mfcc": c["mfcc"]}, utts, signals, w) for w in (1.0, 1.1))
    key = lambda d: sorted(map(tuple, d.select("item", "frame", "vec").collect()))
    assert key(same) == key(plain) != key(other)


def test_streams(spark, tmp_path):
    from framespark.functions.kernels import rasta

    r = np.random.default_rng(0)
    x = r.normal(size=(20, 2))
    src = tmp_path / "in"
    for k in range(2):
        rows = [("a", f, x[f].tolist()) for f in range(10 * k, 10 * k + 10)] + ([("a", 3, x[3].tolist())] if k else [])
        spark.createDataFrame(rows, "item string, frame int, vec array<double>").coalesce(1).write.mode("append").parquet(str(src / f"k{k}"))
    for op, want in ((running_rasta, rasta(x)), (running_cmvn, np.array([x[t] - x[: t + 1].mean(0) for t in range(20)]))):
        s = spark.readStream.schema("item string, frame int, vec array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
        more = {"norm_vars": False} if op is running_cmvn else {}
        q = op(s, **more).writeStream.format("memory").queryName(op.__name__).outputMode("append").option("checkpointLocation", str(tmp_path / op.__name__)).trigger(availableNow=True).start()
        for _ in range(200):  # a query with timeouts goes on to look for state that is idle, so its rows are waited for, not its end
            if not q.isActive or spark.table(op.__name__).count() >= 20:
                break
            time.sleep(0.3)
        q.stop()
        got = sorted((t.frame, t.vec) for t in spark.table(op.__name__).collect())
        assert [f for f, _ in got] == list(range(20)) and np.allclose([v for _, v in got], want)
