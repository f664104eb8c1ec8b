"""A configured pipeline from utterances and signals to features, as one lazy plan.

utterances with signals -> segments -> features under warps -> normalisation (statistics by speaker or utterance,
of voiced frames if asked for) -> derivatives -> pitch pasted on. Everything before the paste is one Arrow kernel and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.operators import cmvn as C
from framespark.operators import frames as X
from framespark.operators import signals as S
from framespark.operators.balance import balanced_join
from framespark.operators import properties as P
from framespark.operators.spectral import Processor, crepe_post, extract, packed, pitch_post
from framespark.plans.cuts import cut

MAIN = ("bottleneck", "filterbank", "mfcc", "plp", "spectrogram")
PITCH = {"kaldi": "kaldi_pitch", "crepe": "crepe_pitch"}
EXTRA = ("pitch", "cmvn", "delta", "vtln")
_DELTA = {"order": 2, "window": 2}
_VAD = {"energy_threshold": 5.0, "energy_mean_scale": 0.5, "frames_context": 0, "proportion_threshold": 0.6}
_POST = {"pitch_scale": 2.0, "pov_scale": 2.0, "pov_offset": 0.0, "delta_pitch_scale": 10.0, "left": 75, "right": 75, "delta_window": 2, "delay": 0, "add_pov": True, "add_normalized": True, "add_delta": True, "add_raw": False}
_VTLN = {"min_warp": 0.85, "max_warp": 1.25, "warp_step": 0.01, "num_gauss": 64, "num_iters": 15, "logdet_scale": 0.0, "norm_type": "offset", "subsample": 5, "by_speaker": True}


def valid_features() -> list[str]:
    return list(MAIN)


def default_config(features: str, pitch: str | bool = False, cmvn: bool = False, delta: bool = False, vtln: bool = False) -> dict:
    """A configuration with every parameter at its default."""
    if features not in MAIN:
        raise ValueError(f'invalid features "{features}", must be in {list(MAIN)}')
    if vtln and features in ("spectrogram", "bottleneck"):
        raise ValueError(f"{features} features are not compatible with VTLN")
    config = {features: {k: v for k, v in Processor(features, **({"weights": None} if features == "bottleneck" else {})).get_params().items() if k != "weights"}}
    if pitch:
        kind = "kaldi" if pitch is True else pitch
        if kind not in PITCH:
            raise ValueError(f"pitch must be in {sorted(PITCH)}")
        config["pitch"] = {"processor": kind, "postprocessing": dict(_POST)}
    if cmvn:
        config["cmvn"] = {"by_speaker": True, "with_vad": True, "vad": dict(_VAD)}
    if delta:
        config["delta"] = dict(_DELTA)
    if vtln:
        config["vtln"] = dict(_VTLN)
    return config


def to_yaml(config: dict, comments: bool = True) -> str:
    import yaml

    text = yaml.safe_dump(config, sort_keys=False, allow_unicode=True)
    return ("# Exactly one of " + ", ".join(MAIN) + ";\n# pitch, cmvn, delta and vtln as wanted.\n" if comments else "") + text


def read_config(config: dict | str) -> dict:
    """A configuration from a dictionary, a file or YAML text, checked, with defaults filled in."""
    if isinstance(config, str):
        import os

        import yaml

        if "\n" not in config and os.path.exists(config):
            with open(config, encoding="utf-8") as f:
                config = f.read()
        config = yaml.safe_load(config)
    if not isinstance(config, dict):
        raise ValueError("the configuration must be a mapping")
    unknown = sorted(set(config) - {*MAIN, *EXTRA})
    if unknown:
        raise ValueError(f"invalid keys in configuration: {unknown}")
    main = [k for k in config if k in MAIN]
    if len(main) != 1:
        raise ValueError(f"the configuration must define one and only one features processor, it defines {main}")
    if "vtln" in config and main[0] in ("spectrogram", "bottleneck"):
        raise ValueError(f"{main[0]} features are not compatible with VTLN")
    out = {main[0]: dict(config[main[0]] or {})}
    defaults = {"delta": _DELTA, "vtln": _VTLN}
    for k in EXTRA:
        if k not in config:
            continue
        given = dict(config[k] or {})
        if k == "pitch":
            kind = given.pop("processor", "kaldi")
            if kind not in PITCH:
                raise ValueError(f"pitch must be in {sorted(PITCH)}")
            post = _POST | dict(given.pop("postprocessing", None) or {})
            _only(post, _POST, "pitch postprocessing")
            out[k] = {"processor": kind, "postprocessing": post} | given
        elif k == "cmvn":
            vad = _VAD | dict(given.pop("vad", None) or {})
            _only(vad, _VAD, "vad")
            out[k] = {"by_speaker": True, "with_vad": True} | given | {"vad": vad}
            _only(out[k], {"by_speaker", "with_vad", "vad"}, k)
        else:
            out[k] = defaults[k] | given
            _only(out[k], defaults[k], k)
    return out


def _only(given, known, where: str) -> None:
    wrong = sorted(set(given) - set(known))
    if wrong:
        raise ValueError(f"invalid parameters of {where}: {wrong}")


def segments(utterances: DataFrame, signals: DataFrame) -> DataFrame:
    """``item, speaker, sample_rate, dtype, samples``: each utterance's part of its file. More than one channel is an error; a file with most of the utterances is spread over tasks."""
    u = utterances.select(F.col("name").alias("item"), "audio_file", *(F.col(c) if c in utterances.columns else F.lit(None).cast(t).alias(c) for c, t in (("speaker", "string"), ("tstart", "double"), ("tstop", "double"))))
    s = signals.select(F.col("file").alias("audio_file"), "sample_rate", "dtype", F.col("samples").alias("_all"), *([F.col("channel")] if "channel" in signals.columns else []))
    if "channel" in s.columns:
        s = s.withColumn("sample_rate", F.when(F.col("channel") > 0, F.raise_error(F.concat(F.lit("all audio files are not mono: "), "audio_file")).cast("int")).otherwise(F.col("sample_rate"))).drop("channel")
    d = balanced_join(cut(u, "utterances"), s, "audio_file")
    return d.select("item", "speaker", "sample_rate", "dtype", S.segment(F.col("_all"), F.col("sample_rate"), F.col("tstart"), F.col("tstop")).alias("samples"))


def extract_features(spark: SparkSession, config: dict | str, utterances: DataFrame, signals: DataFrame, warps: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """``item, frame, t0, t1, vec`` of every utterance. ``signals``: ``file, sample_rate, dtype, samples``; ``warps``: ``item`` or ``speaker``, and ``warp``."""
    c = read_config(config)
    main = next(iter(c))
    needs = "cmvn" in c and c["cmvn"]["by_speaker"] or "vtln" in c and c["vtln"]["by_speaker"]
    if needs and ("speaker" not in utterances.columns or utterances.where("speaker is null").take(1)):
        raise ValueError("the requested configuration uses speakers, but there are utterances without speaker information")
    seg = cut(segments(utterances, signals), "segments")
    params = dict(c[main]) | ({"weights": (weights or {}).get("bottleneck", weights)} if main == "bottleneck" else {})
    p = Processor(main, **params)
    if "vtln" in c and warps is None:
        warps = _train(seg, p, c["vtln"])
    on = None
    if warps is not None:
        on = "item" if "item" in warps.columns else "speaker"
        if seg.select(on).distinct().join(warps.select(on), on, "left_anti").take(1):
            raise ValueError(f"no warp for some {on} of the utterances")
        seg = balanced_join(seg, warps.select(on, "warp"), on)
    feats = extract(seg, p, "item", "warp" if on else None)
    if "cmvn" in c:
        feats = _normalise(cut(feats, "features"), seg, p, c["cmvn"])
    if "delta" in c:
        feats = X.delta(feats, **c["delta"])
    if "pitch" in c:
        own = {k: v for k, v in p.get_params().items() if k in ("frame_shift", "frame_length", "sample_rate", "snip_edges")}
        more = {k: v for k, v in c["pitch"].items() if k not in ("processor", "postprocessing")}
        crepe = c["pitch"]["processor"] == "crepe"
        if crepe:
            more["weights"] = (weights or {}).get("crepe", weights)
            own.pop("snip_edges")
        raw = extract(seg, Processor(PITCH[c["pitch"]["processor"]], **own, **more), "item")
        post = crepe_post if crepe else pitch_post  # voicing has to become a correlation first, or is one
        feats = X.concatenate(cut(feats, "features"), cut(post(raw, **c["pitch"]["postprocessing"]), "pitch"), tolerance=2)
    return feats.select("item", "frame", "t0", "t1", F.col("vec").cast("array<float>").alias("vec"))


def properties_of(config: dict | str, features: DataFrame) -> DataFrame:
    """``item, properties`` (JSON) of what ``extract_features`` gave by ``config``: the steps with the columns they made, and each step's parameters."""
    c = read_config(config)
    main = next(iter(c))
    post = c.get("pitch", {}).get("postprocessing", {})
    pasted = sum(bool(post.get(k)) for k in ("add_pov", "add_normalized", "add_delta", "add_raw")) if "pitch" in c else 0
    factor = 1 + c["delta"]["order"] if "delta" in c else 1
    known = Processor(main, **({} if main == "bottleneck" else c[main])).get_params() if main != "bottleneck" else dict(c[main])
    own = features.groupBy("item").agg(F.max(F.size("vec")).alias("_n"))
    # a row of one vector as wide as the first step made it
    first = own.select("item", F.array_repeat(F.lit(0.0), ((F.col("_n") - pasted) / factor).cast("int")).alias("vec"))
    out = P.start(first, main, known)
    for k in ("vtln", "cmvn", "delta"):
        if k in c:
            out = P.then(out, k, c[k], factor if k == "delta" else 1)
    if "pitch" in c:
        out = P.paste(out, P.start(own.select("item", F.array_repeat(F.lit(0.0), pasted).alias("vec")), "pitch", c["pitch"]))
    return P.as_json(out)


def extract_warped(spark: SparkSession, config: dict | str, utterances: DataFrame, signals: DataFrame, warp: float, weights: dict | None = None) -> DataFrame:
    """``extract_features`` with one warp for every utterance; the configuration must not train warps itself."""
    c = read_config(config)
    if "vtln" in c:
        raise ValueError("the configuration trains warps, so none can be given")
    return extract_features(spark, c, utterances, signals, utterances.select(F.col("name").alias("item"), F.lit(float(warp)).alias("warp")).distinct(), weights)


def _normalise(feats: DataFrame, seg: DataFrame, p: Processor, c: dict) -> DataFrame:
    by = "speaker" if c["by_speaker"] else "item"
    weight = None
    whole = feats if by == "item" else balanced_join(feats, seg.select("item", "speaker").distinct(), "item")
    counted = whole
    if c["with_vad"]:
        own = {k: p.get_params()[k] for k in ("sample_rate", "frame_shift", "frame_length", "snip_edges")}
        energy = extract(seg, Processor("energy", dither=0.0, **own), "item")
        counted = whole.join(X.vad(energy, **c["vad"]), ["item", "frame"])
        weight = "voiced"
    stats = C.accumulate(counted, [by], weight)
    return C.normalise(whole, stats, [by]).select("item", "frame", "t0", "t1", "vec")


def _train(seg: DataFrame, p: Processor, c: dict) -> DataFrame:
    from framespark.operators.mixtures import train_warps

    count = int(1.5 + (c["max_warp"] - c["min_warp"]) / c["warp_step"])
    factors = sorted({round(c["min_warp"] + i * c["warp_step"], 6) for i in range(count)} | {1.0})
    key = "speaker" if c["by_speaker"] else "item"
    frames = cut(packed(seg, p, "item", ("speaker",), c["subsample"], tuple(factors)), "packed")
    return train_warps(frames, tuple(factors), key, c["num_gauss"], c["num_iters"], c["logdet_scale"], norm_type=c["norm_type"], subsample=c["subsample"])[0].select(key, "warp")
