"""Queries of the sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from frametide.operators import sampling
from frametide.plans.registry import query
from frametide.sources import tables as t

_FPS = "fps AS (SELECT *, CASE media_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 25 ELSE 30000 END AS num, CASE media_id % 3 WHEN 2 THEN 1001 ELSE 1 END AS den FROM shots)"


def _fps(spark, d):
    k = F.col("media_id") % 3
    return t.shots(spark, d).withColumn("num", F.when(k == 0, 30).when(k == 1, 25).otherwise(30000)).withColumn("den", F.when(k == 2, 1001).otherwise(1))


def _frames(shots, frames):
    return shots.select("media_id", "shot_index", F.explode(frames).alias("frame"))


def _gap(ms):
    return f"greatest(1, round_even({ms} * num / (1000 * den), 0))::BIGINT"


@query(f"WITH {t.SHOTS}, {_FPS} SELECT media_id, shot_index, unnest(list_distinct(list_append(range(start_frame, end_frame, {_gap(200)}), end_frame - 1))) AS frame FROM fps")
def sampler_by_rate(spark, d):
    return _frames(_fps(spark, d), sampling.periodic(F.col("start_frame"), F.col("end_frame"), sampling.gap_frames(F.col("num"), F.col("den"))))


def _even(lo, hi, most):
    return f"CASE WHEN {hi} - {lo} <= {most} THEN range({lo}, {hi}) ELSE list_distinct(list_transform(range(0, {most}), lambda i: {lo} + round_even(({hi} - {lo} - 1) / {most - 1}.0::DOUBLE * i, 0)::BIGINT)) END"


@query(f"WITH {t.SHOTS} SELECT media_id, shot_index, unnest({_even('start_frame', 'end_frame', 5)}) AS frame FROM shots")
def sampler_representatives(spark, d):
    return _frames(t.shots(spark, d), sampling.even_frames(F.col("start_frame"), F.col("end_frame"), sampling.REPRESENTATIVES))


_THIRD = "third AS (SELECT media_id, shot_index, CASE WHEN n <= 2 THEN s ELSE s + n // 3 END AS lo, CASE WHEN n <= 2 THEN e ELSE least(greatest(s + (2 * n + 2) // 3, s + n // 3 + 1), e) END AS hi FROM (SELECT media_id, shot_index, start_frame AS s, end_frame AS e, end_frame - start_frame AS n FROM shots))"


@query(f"WITH {t.SHOTS}, {_THIRD} SELECT media_id, shot_index, unnest({_even('lo', 'hi', 7)}) AS frame FROM third")
def sampler_middle_third_frames(spark, d):
    low, high = sampling.middle_third(F.col("start_frame"), F.col("end_frame"))
    rows = t.shots(spark, d).select("media_id", "shot_index", low.alias("lo"), high.alias("hi"))
    return _frames(rows, sampling.even_frames(F.col("lo"), F.col("hi"), sampling.THIRD_SAMPLES))


_COUNTS = "counts AS (SELECT media_id, max(end_frame) AS n, any_value(num) AS num, any_value(den) AS den FROM fps GROUP BY 1)"


def _counts(spark, d):
    return _fps(spark, d).groupBy("media_id").agg(F.max("end_frame").alias("n"), F.first("num").alias("num"), F.first("den").alias("den"))


@query(f"WITH {t.SHOTS}, {_FPS}, {_COUNTS} SELECT media_id, unnest(list_distinct(list_append(range(0, n, {_gap(1000)}), n - 1))) AS frame FROM counts")
def sampler_text_by_time(spark, d):
    return _counts(spark, d).select("media_id", F.explode(sampling.text_frames_by_time(F.col("n"), F.col("num"), F.col("den"))).alias("frame"))


@query(f"WITH {t.SHOTS}, {_FPS}, {_COUNTS}, p AS (SELECT media_id, n, unnest(range(0, n - 1, 2)) AS a FROM counts), q AS (SELECT media_id, a AS first, least(a + 2, n - 1) AS second FROM p), ok AS (SELECT * FROM q WHERE first % 11 <> 4 AND second % 11 <> 4 AND media_id % 6 <> 0) SELECT c.media_id, first, second, first IS NOT NULL AS decoded FROM counts c LEFT JOIN ok USING (media_id)")
def motion_pair_sampler(spark, d):
    media = _counts(spark, d).withColumn("pairs", sampling.motion_pairs(F.col("n")))
    frames = media.where("media_id % 6 <> 0").select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame")).where("frame % 11 <> 4")
    return sampling.decodable_pairs(media, frames)


@query(f"WITH {t.PIXELS} SELECT media_id, frame_index, i, r FROM pixels WHERE (i // 8) % 3 = 0 AND i % 8 % 3 = 0")
def spatial_stride_sampler(spark, d):
    step = sampling.stride(F.lit(8), F.lit(8), 10)
    return sampling.decimate(t.pixels(spark, d), step, 8).select("media_id", "frame_index", "i", "r")


@query(f"WITH {t.SHOTS}, {_FPS}, {_COUNTS} SELECT media_id, unnest(list_distinct(list_append(range(0, n, 13), n - 1))) AS frame FROM counts")
def benchmark_stride_sampler(spark, d):
    return _counts(spark, d).select("media_id", F.explode(sampling.stride_with_last(F.col("n"), 13)).alias("frame"))


@query(f"WITH {t.SHOTS} SELECT media_id, shot_index, unnest(range(start_frame, end_frame, 5)) AS frame FROM shots")
def frames_of_shots(spark, d):
    s = t.shots(spark, d)
    return _frames(s, F.sequence("start_frame", F.col("end_frame") - 1, F.lit(5).cast("long")))


@query(f"WITH {t.SHOTS}, {_FPS} SELECT media_id, shot_index, round(start_frame * den / num, 6) AS start_sec, round(end_frame * den / num, 6) AS end_sec, round((end_frame - start_frame) * den / num, 6) AS duration_sec, coalesce(lead(start_frame) OVER (PARTITION BY media_id ORDER BY shot_index) = end_frame, false) AS meets_next FROM fps")
def presentation_times(spark, d):
    from frametide.functions import rates

    return rates.shot_times(_fps(spark, d)).withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec", "duration_sec")})
