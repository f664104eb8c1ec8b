"""The configured pipeline over the signals of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.plans.pipeline import extract_features
from framespark.plans.registry import Registry
from framespark.sources import views

R = Registry()
CONFIG = {
    "mfcc": {"num_bins": 6, "num_ceps": 5, "dither": 0.0},
    "cmvn": {"by_speaker": True, "with_vad": True, "vad": {"energy_threshold": -3.0, "energy_mean_scale": 1.0}},
    "delta": {"order": 1},
}


@R.query()
def pipeline(spark, d):
    """Cepstra of every signal of a known speaker, normalised by speaker over voiced frames, with derivatives; an item's signals are utterances each."""
    return extract_features(spark, CONFIG, *_spoken(spark, d))


def _spoken(spark, d):
    s = views.signals(spark, d)
    speakers = views.utterances(spark, d).where("speaker is not null").select(F.col("name").alias("item"), "speaker")
    file = F.col("signal_id").cast("string")
    u = s.select("item", file.alias("name"), file.alias("audio_file")).join(speakers, "item").drop("item")
    return u, s.select(file.alias("file"), "sample_rate", "dtype", "samples")


QUERIES, ORACLE = R.queries, R.sql
