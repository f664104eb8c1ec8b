"""Queries over features, alignments and the utterance index."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.operators import alignments as A
from framespark.operators import cmvn as C
from framespark.operators import frames as X
from framespark.operators import utterances as U
from framespark.plans.registry import Registry
from framespark.sources import views
from framespark.sources.tables import table
from framespark.sources.views import ALI, ALL, FEA, META, UTT

R = Registry()
_F = f"WITH {FEA}"
_LONG = f"{_F}, lng AS (SELECT item, frame, unnest(range(0, len(vec))) AS dim, unnest(vec)::DOUBLE AS x FROM fea)"
_BACK = "SELECT item, frame, list(round(y + 1e-7::DOUBLE, {0}) + 0.0 ORDER BY dim) AS vec FROM y GROUP BY item, frame"


def _vec(df, digits=4, *more):
    return df.select("item", "frame", *more, F.transform("vec", lambda v: F.round(v.cast("double") + 1e-7, digits) + 0.0).alias("vec"))


@R.query(_F + " SELECT item, CAST(frame // 5 AS INT) AS frame, list_transform(vec, lambda v: round(v::DOUBLE + 1e-7::DOUBLE, 4) + 0.0) AS vec FROM fea WHERE frame % 5 = 0")
def subsample(spark, d):
    return _vec(X.subsample(views.features(spark, d), 5))


@R.query(f"WITH {ALL}, w AS (SELECT *, lag(t0) OVER (PARTITION BY item ORDER BY frame) AS p0, lag(t1) OVER (PARTITION BY item ORDER BY frame) AS p1, len(list_filter(vec, lambda x: NOT isfinite(x))) = 0 AS fine FROM fea)"
  " SELECT item, count(*) AS frames, min(len(vec)) = max(len(vec)) AS one_width, bool_and(fine) AS finite, NOT bool_or(coalesce(CASE WHEN t1 IS NOT NULL THEN t1 < p1 OR (t1 = p1 AND t0 < p0) ELSE t0 < p0 END, false)) AS sorted,"
  " bool_and(fine) AND min(len(vec)) = max(len(vec)) AND NOT bool_or(coalesce(CASE WHEN t1 IS NOT NULL THEN t1 < p1 OR (t1 = p1 AND t0 < p0) ELSE t0 < p0 END, false)) AS valid FROM w GROUP BY item")  # fmt: skip
def validate_features(spark, d):
    return X.validate(views.latest(spark, d))


@R.query("SELECT item, bool_and(len(list_filter(vec, lambda x: NOT isfinite(x))) = 0) AS finite FROM features GROUP BY item")
def validate_finite(spark, d):
    finite = ~F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, d, "features").groupBy("item").agg(F.bool_and(finite).alias("finite"))


@R.query(_F + ", lng AS (SELECT item, frame, unnest(vec)::DOUBLE AS x FROM fea), two AS (SELECT item, x, CASE WHEN frame % 50 = 7 AND item LIKE '%7' THEN x + 1 + abs(x) ELSE x * 1.000001::DOUBLE END AS y FROM lng) SELECT item, bool_and(abs(x - y) <= 1e-8 + 1e-5 * abs(y)) AS close FROM two GROUP BY item")
def is_close(spark, d):
    """Features against themselves, with a small difference everywhere and a large one in some frames."""
    a = views.features(spark, d)
    off = (F.col("frame") % 50 == 7) & F.col("item").like("%7")
    b = a.withColumn("vec", F.when(off, F.transform("vec", lambda v: v.cast("double") + F.lit(1.0) + F.abs(v.cast("double")))).otherwise(F.transform("vec", lambda v: v.cast("double") * 1.000001)))
    return X.is_close(a, b)


_CONCAT = _F + ", a AS (SELECT item, frame, vec[1:3] AS u FROM fea), b AS (SELECT item, frame, vec[4:8] AS v FROM fea) SELECT a.item, a.frame, list_transform(list_concat(u, v), lambda x: round(x::DOUBLE + 1e-7::DOUBLE, 4) + 0.0) AS vec FROM a JOIN b USING (item, frame)"


@R.query(_CONCAT)
def concat_positional(spark, d):
    f = views.features(spark, d)
    return _vec(X.concatenate(f.withColumn("vec", F.slice("vec", 1, 3)), f.withColumn("vec", F.slice("vec", 4, 5))))


@R.query(_F + ", m AS (SELECT item, max(frame) AS last FROM fea GROUP BY item) SELECT item, frame, list_transform(list_concat(vec, vec), lambda x: round(x::DOUBLE + 1e-7::DOUBLE, 4) + 0.0) AS vec FROM fea JOIN m USING (item) WHERE frame < last")
def concat_tolerance(spark, d):
    """Pasted to features that lack their last frame."""
    f = views.features(spark, d)
    last = f.groupBy("item").agg(F.max("frame").alias("last"))
    return _vec(X.concatenate(f, f.join(last, "item").where("frame < last").drop("last"), tolerance=2))


@R.query(_F + " SELECT item, frame, list_transform(vec, lambda v: round(v::DOUBLE + 1e-7::DOUBLE, 4) + 0.0) AS vec FROM fea WHERE vec[2] > 0.5")
def trim_vad(spark, d):
    f = views.features(spark, d)
    return _vec(X.trim(f, f.select("item", "frame", (F.get("vec", F.lit(1)) > 0.5).alias("voiced"))))


def _mask(spark, d, component, least):
    return views.features(spark, d).select("item", "frame", (F.get("vec", F.lit(component)) > least).alias("voiced"))


@R.query(_F + " SELECT item, frame, vec[2] > 0.5 AND vec[1] > 0 AS voiced FROM fea")
def mask_intersection(spark, d):
    return X.both_voiced(_mask(spark, d, 1, 0.5), _mask(spark, d, 0, 0.0))


@R.query(_F + " SELECT item, count(*) AS frames, round(avg(CASE WHEN vec[2] > 0.5 THEN 1.0 ELSE 0.0 END), 9) AS share FROM fea GROUP BY item")
def voiced_share(spark, d):
    return X.voiced_share(_mask(spark, d, 1, 0.5)).withColumn("share", F.round("share", 9))


@R.query(_F + ", v AS (SELECT item, frame, frame - row_number() OVER (PARTITION BY item ORDER BY frame) AS g FROM fea WHERE vec[2] > 0.5) SELECT item, min(frame) AS first, max(frame) AS last, CAST(count(*) AS INT) AS frames FROM v GROUP BY item, g")
def voiced_segments(spark, d):
    return X.voiced_segments(_mask(spark, d, 1, 0.5))


@R.query(_F + " SELECT item, frame, list_transform(vec, lambda v: round(v::DOUBLE + 1e-7::DOUBLE, 4) + 0.0) AS vec FROM fea")
def collection_union(spark, d):
    """Two halves by item, put together again."""
    f = views.features(spark, d)
    odd = F.length("item") % 2 == 1
    return _vec(X.union(f.where(odd), f.where(~odd)))


@R.query(_F + ", w AS (SELECT *, lag(t0) OVER (PARTITION BY item ORDER BY frame) AS p0, lag(t1) OVER (PARTITION BY item ORDER BY frame) AS p1 FROM fea) SELECT count(DISTINCT item) AS items, min(len(vec)) = max(len(vec)) AND NOT bool_or(coalesce(CASE WHEN t1 IS NOT NULL THEN t1 < p1 OR (t1 = p1 AND t0 < p0) ELSE t0 < p0 END, false)) AS valid FROM w")
def collection_valid(spark, d):
    return X.collection_valid(views.features(spark, d)).drop("invalid")


@R.query(_F + " SELECT count(DISTINCT item) AS items, true AS close FROM fea")
def collection_close(spark, d):
    """Features against themselves written with less precision."""
    f = views.features(spark, d)
    return X.collection_close(f, f.withColumn("vec", F.transform("vec", lambda v: v.cast("double") * (1 + 1e-7))))


@R.query(f"WITH {FEA}, {UTT} SELECT u.speaker AS part, count(*) AS frames, count(DISTINCT item) AS items FROM fea JOIN utt u ON item = u.name WHERE u.speaker IS NOT NULL GROUP BY 1")
def partition_by_index(spark, d):
    """Frames and items of each speaker's part."""
    index = views.utterances(spark, d).where("speaker is not null").select(F.col("name").alias("item"), F.col("speaker").alias("part"))
    return X.partition(views.features(spark, d), index).groupBy("part").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("item").alias("items"))


@R.query(f"WITH {FEA}, {UTT} SELECT DISTINCT item FROM fea WHERE item NOT IN (SELECT name FROM utt)")
def undefined_items_anti(spark, d):
    return X.undefined(views.features(spark, d), views.utterances(spark, d).select(F.col("name").alias("item")))


@R.query("SELECT item, 'left' AS side FROM (SELECT DISTINCT item FROM features EXCEPT SELECT DISTINCT item FROM alignments) UNION ALL SELECT item, 'right' AS side FROM (SELECT DISTINCT item FROM alignments EXCEPT SELECT DISTINCT item FROM features)")
def keyset_diff(spark, d):
    return X.key_difference(table(spark, d, "features"), table(spark, d, "alignments"))


@R.query(f"WITH {UTT} SELECT speaker, count(*) AS utterances, count(DISTINCT audio_file) AS files, CAST(sum(CAST(duration AS DECIMAL(20,6))) AS DOUBLE) AS duration FROM utt WHERE speaker IS NOT NULL GROUP BY speaker")
def by_speaker(spark, d):
    return U.by_speaker(views.utterances(spark, d))


@R.query(f"WITH {UTT} SELECT CAST(sum(CAST(duration AS DECIMAL(20,6))) AS DOUBLE) AS duration, count(*) AS utterances FROM utt")
def total_duration(spark, d):
    return U.total_duration(views.utterances(spark, d))


@R.query("SELECT name, count(*) AS n FROM utterances GROUP BY name HAVING count(*) > 1")
def duplicate_names(spark, d):
    return U.duplicate_names(table(spark, d, "utterances"))


@R.query(f"WITH {UTT}, s AS (SELECT *, CAST(sum(CAST(duration AS DECIMAL(20,6))) OVER (PARTITION BY speaker ORDER BY coalesce(audio_file || chr(1), '') || name ROWS UNBOUNDED PRECEDING) - CAST(duration AS DECIMAL(20,6)) AS DOUBLE) AS b FROM utt WHERE speaker IS NOT NULL)"
  " SELECT name, audio_file, speaker, tstart, least(duration, round(60.0 - b, 6)) AS duration FROM s WHERE b < 60")  # fmt: skip
def fit_to_duration(spark, d):
    return U.fit_to_duration(views.utterances(spark, d), 60.0, truncate=True)


@R.query(f"WITH {ALI}, w AS (SELECT *, lead(onset) OVER (PARTITION BY item ORDER BY onset, offset_s, token) AS nxt FROM ali) SELECT item, count(*) AS tokens, bool_and(onset < offset_s) AS ordered, bool_and(coalesce(nxt = offset_s, true)) AS contiguous, bool_and(onset < offset_s) AND bool_and(coalesce(nxt = offset_s, true)) AS valid FROM w GROUP BY item")
def align_validate(spark, d):
    return A.validate(views.alignments(spark, d))


@R.query(f"WITH {ALI} SELECT item, greatest(onset, 0.5) AS onset, least(offset_s, 1.25) AS offset_s, token FROM ali WHERE offset_s > 0.5 AND onset < 1.25")
def align_slice(spark, d):
    return A.clip(views.alignments(spark, d), 0.5, 1.25).select("item", "onset", "offset_s", "token")


_RATE = f"WITH {ALI}, f AS (SELECT item, min(onset) AS t FROM ali GROUP BY item), s AS (SELECT item, token, unnest(range(CAST(ceil((onset - t) * {{0}} - 1e-6) AS BIGINT), CAST(ceil((offset_s - t) * {{0}} - 1e-6) AS BIGINT))) AS i FROM ali JOIN f USING (item)), one AS (SELECT item, i, min(token) AS token FROM s GROUP BY item, i)"


@R.query(_RATE.format("100.0::DOUBLE") + " SELECT item, i, token FROM one")
def align_sample_rate(spark, d):
    return A.at_rate(views.alignments(spark, d), 100.0)


@R.query(f"WITH {ALI} SELECT item, round(max(offset_s) - min(onset), 6) AS duration FROM ali GROUP BY item")
def align_duration(spark, d):
    return A.durations(views.alignments(spark, d)).withColumn("duration", F.round("duration", 6))


@R.query("SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS idx FROM (SELECT DISTINCT token FROM alignments WHERE token IS NOT NULL)")
def token_inventory(spark, d):
    return A.inventory(table(spark, d, "alignments"))


@R.query(f"WITH {ALI}, inv AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT token FROM alignments)), n AS (SELECT max(idx) AS top FROM inv)"
  " SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY onset, offset_s, token) - 1 AS INT) AS frame, onset AS t0, offset_s AS t1, list_transform(range(0, top + 1), lambda i: i = inv.idx) AS vec FROM ali JOIN inv USING (token), n")  # fmt: skip
def onehot(spark, d):
    return A.one_hot(views.alignments(spark, d))


_TAPER = "list_transform(range(0, 400), lambda i: pow(0.5 - 0.5 * cos(2 * pi() * i / 399), 0.85))"


@R.query(_RATE.format("16000.0::DOUBLE") + f", k AS (SELECT item, CASE WHEN max(i) + 1 < 400 THEN 0 ELSE 1 + (max(i) + 1 - 400) // 160 END AS k FROM one GROUP BY item), t AS (SELECT {_TAPER} AS w),"
  " v AS (SELECT item, f AS frame, token, sum(w[i - f * 160 + 1]) AS w, min(i) AS i FROM (SELECT one.*, k, unnest(range(CAST(greatest(ceil((i - 399) / 160.0), 0) AS BIGINT), least(i // 160, k - 1) + 1)) AS f FROM one JOIN k USING (item)), t GROUP BY item, f, token),"
  " inv AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INT) AS idx FROM (SELECT DISTINCT token FROM alignments))"
  " SELECT item, CAST(frame AS INT) AS frame, token, idx FROM (SELECT *, row_number() OVER (PARTITION BY item, frame ORDER BY round(w, 9) DESC, i) AS r FROM v) JOIN inv USING (token) WHERE r = 1")  # fmt: skip
def onehot_framed(spark, d):
    return A.framed_one_hot(views.alignments(spark, d))


_STATS = "SELECT {0}CAST(dim AS INT) AS dim, CAST({1} AS DOUBLE) AS count, round(sum({2}x), 2) AS s1, round(sum({2}x * x), 1) AS s2 FROM lng {3} GROUP BY {0}dim"


def _rounded(stats, *by):
    return stats.select(*by, "dim", "count", F.round("s1", 2).alias("s1"), F.round("s2", 1).alias("s2"))


@R.query(_LONG + " " + _STATS.format("", "count(*)", "", ""))
def cmvn_stats(spark, d):
    return _rounded(C.accumulate(views.features(spark, d)))


@R.query(_LONG + " " + _STATS.format("", "count(*)", "", ""))
def cmvn_merge(spark, d):
    """Statistics of even and of odd frames, merged."""
    f = views.features(spark, d)
    return _rounded(C.merge(C.accumulate(f.where("frame % 2 = 0")), C.accumulate(f.where("frame % 2 = 1"))))


_NORM = _LONG + ", st AS (SELECT {0}dim, avg(x) AS m, sqrt(greatest(sum(x * x) / count(*) - pow(sum(x) / count(*), 2), 1e-20)) AS s FROM lng GROUP BY {0}dim), y AS (SELECT lng.item, frame, lng.dim, {1} AS y FROM lng JOIN st USING ({0}dim)) " + _BACK.format(4)


@R.query(_NORM.format("item, ", "(x - m) / s"))
def cmvn_by_item(spark, d):
    return _vec(C.cmvn(views.features(spark, d), ["item"]))


@R.query(_NORM.format("", "(x - m) / s"))
def cmvn_by_collection(spark, d):
    return _vec(C.cmvn(views.features(spark, d)))


@R.query(_NORM.format("", "x - m"))
def cmvn_no_vars(spark, d):
    return _vec(C.cmvn(views.features(spark, d), norm_vars=False))


@R.query(_NORM.format("", "CASE WHEN lng.dim IN (1, 2) THEN x ELSE (x - m) / s END"))
def cmvn_skip_dims(spark, d):
    return _vec(C.cmvn(views.features(spark, d), skip_dims=(1, 2)))


@R.query(_F + " SELECT item, frame, list_transform(vec, lambda v: round(v::DOUBLE + 1e-7::DOUBLE, 4) + 0.0) AS vec FROM fea")
def cmvn_reverse(spark, d):
    """There and back."""
    f = views.features(spark, d)
    stats = C.accumulate(f)
    return _vec(C.normalise(C.normalise(f, stats), stats, reverse=True))


@R.query(_F + ", lng AS (SELECT item, frame, vec[2]::DOUBLE AS w, unnest(range(0, len(vec))) AS dim, unnest(vec)::DOUBLE AS x FROM fea WHERE vec[2] BETWEEN 0 AND 1) SELECT CAST(dim AS INT) AS dim, round(sum(w), 2) AS count, round(sum(w * x), 2) AS s1, round(sum(w * x * x), 1) AS s2 FROM lng GROUP BY dim")
def cmvn_weighted(spark, d):
    f = views.features(spark, d).withColumn("w", F.get("vec", F.lit(1)).cast("double")).where("w between 0 and 1")
    return _rounded(C.accumulate(f, weight="w").withColumn("count", F.round("count", 2)))


def _sliding(center: bool, norm: bool = False):
    if center:
        bounds = "CASE WHEN frame - 30 < lo THEN lo WHEN frame + 30 > hi THEN greatest(hi - 60, lo) ELSE frame - 30 END AS a, CASE WHEN frame - 30 < lo THEN least(lo + 60, hi) WHEN frame + 30 > hi THEN hi ELSE frame + 30 END AS b"
    else:
        bounds = "CASE WHEN frame + 1 - lo < 20 THEN lo ELSE greatest(frame - 59, lo) END AS a, CASE WHEN frame + 1 - lo < 20 THEN least(lo + 20, hi) ELSE frame + 1 END AS b"
    return (
        _LONG + f", e AS (SELECT item, min(frame) AS lo, max(frame) + 1 AS hi FROM fea GROUP BY item), p AS (SELECT item, frame, {bounds} FROM fea JOIN e USING (item)),"
        f" y AS (SELECT p.item, p.frame, l.dim, {'(any_value(o.x) - avg(l.x)) / sqrt(greatest(var_pop(l.x), 1e-10))' if norm else 'any_value(o.x) - avg(l.x)'} AS y FROM p JOIN lng l ON p.item = l.item AND l.frame >= p.a AND l.frame < p.b JOIN lng o ON o.item = p.item AND o.frame = p.frame AND o.dim = l.dim GROUP BY p.item, p.frame, l.dim) " + _BACK.format(3)
    )


@R.query(_sliding(True))
def sliding_cmvn_center(spark, d):
    return _vec(C.sliding(views.features(spark, d), True, 60, 20), 3)


@R.query(_sliding(False))
def sliding_cmvn_causal(spark, d):
    return _vec(C.sliding(views.features(spark, d), False, 60, 20), 3)


@R.query(_sliding(True, True))
def sliding_cmvn_vars(spark, d):
    """By the deviation too, where a window has any."""
    return _vec(C.sliding(views.features(spark, d), True, 60, 20, norm_vars=True), 3)


def _delta(order: int, source: str = "fea") -> str:
    taps = X.delta_taps(order, 2)
    reach = 2 * order
    near = [f"vec AS v{reach}" if not k else f"coalesce(lag(vec, {-k}) OVER w, first_value(vec) OVER w) AS v{k + reach}" if k < 0 else f"coalesce(lead(vec, {k}) OVER w, last_value(vec) OVER w) AS v{k + reach}" for k in range(-reach, reach + 1)]
    outs = []
    for t in taps:
        half = len(t) // 2
        outs.append("list_transform(range(1, len(vec) + 1), lambda i: round(" + " + ".join(f"({c!r}::DOUBLE) * v{j - half + reach}[i]::DOUBLE" for j, c in enumerate(t)) + " + 1e-7::DOUBLE, 4) + 0.0)")
    joined = outs[0]
    for o in outs[1:]:
        joined = f"list_concat({joined}, {o})"
    return f", n AS (SELECT item, frame, vec, {', '.join(near)} FROM {source} WINDOW w AS (PARTITION BY item ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT item, frame, {joined} AS vec FROM n"


@R.query(_F + _delta(1))
def delta_1(spark, d):
    return _vec(X.delta(views.features(spark, d), 1))


@R.query(_F + _delta(2))
def delta_2(spark, d):
    return _vec(X.delta(views.features(spark, d), 2))


@R.query(_F + ", m AS (SELECT *, avg(vec[1]::DOUBLE) OVER (PARTITION BY item) AS m FROM fea) SELECT item, frame, CAST(CASE WHEN vec[1]::DOUBLE > 0.5 + 0.9 * m THEN 1 ELSE 0 END AS TINYINT) AS voiced FROM m")
def vad(spark, d):
    return X.vad(views.features(spark, d), 0.5, 0.9)


@R.query(_F + ", m AS (SELECT *, avg(vec[1]::DOUBLE) OVER (PARTITION BY item) AS m FROM fea), a AS (SELECT item, frame, avg(CASE WHEN vec[1]::DOUBLE > 0.5 + 0.9 * m THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY item ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM m) SELECT item, frame, CAST(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS TINYINT) AS voiced FROM a")
def vad_context(spark, d):
    return X.vad(views.features(spark, d), 0.5, 0.9, frames_context=2, proportion_threshold=0.6)


@R.query(_F + " SELECT item, frame, round(2 * (pow(1.0001 - least(abs(vec[2]::DOUBLE), 1.0), 0.15) - 1), 6) AS pov FROM fea")
def pov_from_nccf(spark, d):
    from framespark.functions.scalars import pov_of_nccf

    return views.features(spark, d).select("item", "frame", F.round(pov_of_nccf(F.get("vec", F.lit(1)).cast("double")), 6).alias("pov"))


@R.query(_F + " SELECT item, frame, round(10 * pow(2.0, vec[3]::DOUBLE * 10 / 1200), 5) AS hz FROM fea WHERE vec[3] BETWEEN 0 AND 1500")
def cents_to_hz(spark, d):
    from framespark.functions.scalars import cents_to_hz as hz

    f = views.features(spark, d).where("vec[2] between 0 and 1500")
    return f.select("item", "frame", F.round(hz(F.get("vec", F.lit(2)).cast("double") * 10), 5).alias("hz"))


@R.query(f"WITH {FEA}, {UTT}, w AS (SELECT speaker, 0.85 + 0.01 * (hash_ % 41) AS warp FROM (SELECT DISTINCT speaker, length(speaker) + ascii(right(speaker, 1)) AS hash_ FROM utt WHERE speaker IS NOT NULL)) SELECT u.name, u.speaker, round(w.warp::DOUBLE, 6) AS warp FROM utt u JOIN w USING (speaker)")
def warp_join(spark, d):
    """A warp per speaker, for each of their utterances."""
    from framespark.operators.balance import balanced_join

    u = views.utterances(spark, d).where("speaker is not null").select("name", "speaker")
    w = u.select("speaker").distinct().withColumn("warp", F.round(0.85 + 0.01 * ((F.length("speaker") + F.ascii(F.right("speaker", F.lit(1)))) % 41), 6))
    return balanced_join(u, w, "speaker").select("name", "speaker", "warp")


@R.query(f"WITH {UTT}, w AS (SELECT DISTINCT speaker, 0.85 + 0.01 * ((length(speaker) + ascii(right(speaker, 1))) % 41) AS warp FROM utt WHERE speaker IS NOT NULL) SELECT count(*) AS n, round(avg(warp::DOUBLE), 9) AS mean, round(stddev_pop(warp::DOUBLE), 9) AS std FROM w")
def warp_statistics(spark, d):
    from framespark.operators.mixtures import warp_statistics as of

    w = views.utterances(spark, d).where("speaker is not null").select("speaker").distinct()
    w = of(w.withColumn("warp", 0.85 + 0.01 * ((F.length("speaker") + F.ascii(F.right("speaker", F.lit(1)))) % 41)))
    return w.select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@R.query(f"WITH {ALI}, a AS (SELECT token, CAST(idx % 3 AS INT) AS c, offset_s - onset AS len FROM ali), b AS (SELECT token, c, avg(len) AS m FROM a GROUP BY token, c), t AS (SELECT token, avg(m) AS m FROM b GROUP BY token) SELECT round((1 - avg(m)) * 100, 4) AS score FROM t")
def abx_mean_of_means(spark, d):
    a = views.alignments(spark, d).select("token", (F.col("idx") % 3).alias("c"), (F.col("offset_s") - F.col("onset")).alias("len"))
    b = a.groupBy("token", "c").agg(F.avg("len").alias("m")).groupBy("token").agg(F.avg("m").alias("m"))
    return b.agg(F.round((1 - F.avg("m")) * 100, 4).alias("score"))


@R.query(_F + ", p AS (SELECT item, vec[3]::DOUBLE AS p, lag(vec[3]::DOUBLE) OVER (PARTITION BY item ORDER BY frame) AS t FROM fea) SELECT item, round(avg(abs(p - t)), 4) AS mae, round(100 * avg(CASE WHEN abs(p - t) > 0.05 * t THEN 1.0 ELSE 0.0 END), 4) AS ger FROM p WHERE p > 0 AND t > 0 GROUP BY item")
def pitch_mae_ger(spark, d):
    """Error of pitch against the frame before: mean, and share beyond 5 %."""
    from framespark.operators.blocks import windowed

    f = views.features(spark, d).select("item", "frame", F.get("vec", F.lit(2)).cast("double").alias("p"))
    f = windowed(f, 1, lambda x, w: x.withColumn("t", F.lag("p").over(w))).where("p > 0 and t > 0")
    off = F.abs(F.col("p") - F.col("t"))
    return f.groupBy("item").agg(F.round(F.avg(off), 4).alias("mae"), F.round(100 * F.avg((off > 0.05 * F.col("t")).cast("double")), 4).alias("ger"))


@R.query(_NORM.format("", "(x - m) / s").replace(_BACK.format(4), ", v AS (SELECT item, frame, list(y ORDER BY dim) AS vec FROM y GROUP BY item, frame)") + _delta(1, "v"))
def pipeline_cmvn_delta(spark, d):
    """Normalised over the collection, then with first derivatives."""
    f = views.features(spark, d)
    return _vec(X.delta(C.cmvn(f), 1))


@R.query(f"WITH {META} SELECT sample_rate, nchannels, count(*) AS files, count(*) FILTER (WHERE nchannels <> 1) AS not_mono FROM meta GROUP BY sample_rate, nchannels")
def rates_and_channels(spark, d):
    m = views.audio_meta(spark, d)
    return m.groupBy("sample_rate", "nchannels").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("nchannels") != 1).alias("not_mono"))


QUERIES, ORACLE = R.queries, R.sql
