"""Queries of media files, shot boundaries, constant rates, keyframes, thumbnails and shot documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from frametide.operators import frames as ops
from frametide.operators import images, shots
from frametide.operators.folds import by_group
from frametide.plans.registry import _SHARP, _sharpness, query, r6
from frametide.sources import media_files
from frametide.sources import tables as t


def _wav_files(spark, d):
    """One WAV file of each signal, some of them spoiled."""

    def write(rows):
        x = np.array([r["x"] for r in rows], dtype=float)
        media = rows[0]["media_id"]
        content = b"RIFX" if media % 5 == 3 else media_files.wav(np.stack([x, x], axis=1) if media % 2 else x, 16000)
        return [(f"{media}.wav", content)]

    return by_group(t.signal(spark, d).select("media_id", "sample_index", "x"), ["media_id"], ["sample_index"], write, "path string, content binary")


@query(f"WITH {t.SIG}, n AS (SELECT media_id, count(*) AS n FROM sig GROUP BY 1) SELECT media_id || '.wav' AS path, CASE WHEN media_id % 5 = 3 THEN 'UNSUPPORTED_MEDIA' ELSE 'ok' END AS status, CASE WHEN media_id % 5 <> 3 THEN 'pcm_s16le' END AS codec, CASE WHEN media_id % 5 <> 3 THEN 16000 END AS rate, CASE WHEN media_id % 5 <> 3 THEN 1 + media_id % 2 END AS channels, CASE WHEN media_id % 5 <> 3 THEN round(n / 16000, 6) END AS duration_sec FROM n")
def audio_probe(spark, d):
    return r6(media_files.probe_audio(_wav_files(spark, d)), "duration_sec")


@query(f"WITH {t.SIG} SELECT media_id || '.wav' AS path, sample_index AS i, round(round_even(x * 32767, 0) / 32768, 6) AS x FROM sig WHERE media_id % 5 <> 3")
def pcm_extraction(spark, d):
    rows = media_files.pcm(_wav_files(spark, d)).select("path", "chunk_index", F.posexplode("samples").alias("i", "x"))
    return rows.select("path", (F.col("chunk_index") * media_files.CHUNK + F.col("i")).cast("long").alias("i"), F.round("x", 6).alias("x"))


def _png_files(spark, d):
    def write(rows):
        r = rows[0]
        content = media_files.png(np.array(r["patch"]).reshape(8, 8))
        return [(f"{r['media_id']}-{r['frame_index']}.png", content[:20] if r["frame_index"] % 9 == 4 else content)]

    return by_group(t.patches(spark, d).select("media_id", "frame_index", "patch"), ["media_id", "frame_index"], [], write, "path string, content binary")


@query(f"WITH {t.PATCH} SELECT media_id || '-' || frame_index || '.png' AS path, CASE WHEN frame_index % 9 = 4 THEN 'UNSUPPORTED_MEDIA' ELSE 'ok' END AS status, CASE WHEN frame_index % 9 <> 4 THEN 8 END AS width, CASE WHEN frame_index % 9 <> 4 THEN list_sum(patch)::BIGINT END AS total, CASE WHEN frame_index % 9 <> 4 THEN patch[64] END AS last FROM patches")
def image_decode(spark, d):
    rows = media_files.decode_images(_png_files(spark, d))
    total = F.aggregate("g", F.lit(0).cast("long"), lambda s, v: s + v)
    return rows.select("path", "status", "width", total.alias("total"), F.element_at("b", -1).alias("last"))


@query(f"WITH {t.PATCH} SELECT media_id || '-' || frame_index || '.png' AS path, CASE WHEN frame_index % 9 = 4 THEN 'UNSUPPORTED_MEDIA' ELSE 'ok' END AS status, CASE WHEN frame_index % 9 <> 4 THEN 'png' END AS format, CASE WHEN frame_index % 9 <> 4 THEN 8 END AS width, CASE WHEN frame_index % 9 <> 4 THEN 8 END AS height, CASE WHEN frame_index % 9 <> 4 THEN 1 END AS channels, CASE WHEN frame_index % 9 <> 4 THEN 8 END AS bit_depth FROM patches")
def image_probe(spark, d):
    return media_files.probe_images(_png_files(spark, d))


_CONTENT = f"{t.PATCH}, nb AS (SELECT *, lag(patch) OVER (PARTITION BY media_id ORDER BY frame_index) AS p FROM patches), cs AS (SELECT media_id, frame_index AS frame, CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(patch, p), lambda z: abs(z[1] - z[2]) + abs(z[1] // 2 - z[2] // 2) + abs(z[1] % 16 - z[2] % 16))) / 64 / 3 END AS content FROM nb)"


def _scores(spark, d):
    rows = t.patches(spark, d).select("media_id", F.col("frame_index").alias("frame"), F.col("patch").alias("h"), F.transform("patch", lambda v: F.floor(v / 2)).alias("s"), F.transform("patch", lambda v: v % 16).alias("v"))
    return shots.content_scores(rows)


@query(f"WITH {_CONTENT} SELECT media_id, frame, round(content, 6) AS content FROM cs")
def frame_content_scores(spark, d):
    return r6(_scores(spark, d), "content")


_CUTS = f"{_CONTENT}, ar AS (SELECT *, (lag(content, 1) OVER w + lag(content, 2) OVER w + lead(content, 1) OVER w + lead(content, 2) OVER w) / 4 AS m FROM cs WINDOW w AS (PARTITION BY media_id ORDER BY frame)), ca AS (SELECT media_id, frame, row_number() OVER (PARTITION BY media_id ORDER BY frame) AS k FROM ar WHERE m IS NOT NULL AND content >= 8 AND round(CASE WHEN abs(m) < 1e-5 THEN 255 ELSE least(content / m, 255) END, 9) >= 1.05), fo AS (SELECT media_id, k, frame, CASE WHEN frame < 3 THEN 0 ELSE frame END AS last FROM ca WHERE k = 1 UNION ALL SELECT c.media_id, c.k, c.frame, CASE WHEN c.frame - f.last < 3 THEN f.last ELSE c.frame END FROM fo f JOIN ca c ON c.media_id = f.media_id AND c.k = f.k + 1), cu AS (SELECT media_id, frame FROM fo WHERE last = frame)"


def _cuts(spark, d):
    return shots.adaptive_cuts(_scores(spark, d), 1.05, 8.0, 2, 3)


_FOUND = f"{_CUTS}, me AS (SELECT media_id, count(*) AS n FROM patches GROUP BY 1), st AS (SELECT media_id, n, 0 AS s FROM me UNION ALL SELECT media_id, n, frame FROM cu JOIN me USING (media_id) WHERE media_id % 4 <> 1), fs AS (SELECT media_id, row_number() OVER w - 1 AS shot_index, s AS start_frame, coalesce(lead(s) OVER w, n)::BIGINT AS end_frame, count(*) OVER (PARTITION BY media_id) AS c FROM st WINDOW w AS (PARTITION BY media_id ORDER BY s))"


def _found(spark, d):
    media = t.patches(spark, d).groupBy("media_id").agg(F.count("*").alias("frame_count"))
    return shots.shots_from_cuts(_cuts(spark, d).where("media_id % 4 <> 1"), media)


@query(f"WITH RECURSIVE {_FOUND} SELECT media_id, shot_index, start_frame::BIGINT AS start_frame, end_frame, CASE WHEN c = 1 THEN 'end' WHEN shot_index = 0 THEN 'start' ELSE 'hard_cut' END AS boundary, CASE WHEN c = 1 THEN 1.0 ELSE 0.8 END AS score, round(start_frame * 1001 / 30000, 6) AS start_sec, round(end_frame * 1001 / 30000, 6) AS end_sec, CASE shot_index % 3 WHEN 0 THEN 'no_person' WHEN 1 THEN 'other' END AS label FROM fs")
def shot_detection(spark, d):
    found = _found(spark, d)
    labels = found.where("shot_index % 3 < 2").select("media_id", "shot_index", F.when(F.col("shot_index") % 3 == 0, "no_person").otherwise("other").alias("label"), F.lit(1.0).alias("score"))
    return r6(shots.shot_document(found, labels, 30000, 1001).drop("label_score"), "start_sec", "end_sec")


@query(f"WITH {t.SIG}, f AS (SELECT media_id, sample_index AS frame, sample_index * 0.041::DOUBLE + (event_id % 5) * 0.003::DOUBLE AS sec FROM sig), k AS (SELECT media_id, unnest(range(0, 60)) AS tick FROM (SELECT DISTINCT media_id FROM sig)), c AS (SELECT k.media_id, tick, frame, row_number() OVER (PARTITION BY k.media_id, tick ORDER BY round(abs(sec - tick / 30), 9), sec) AS r FROM k JOIN f ON f.media_id = k.media_id) SELECT media_id, tick, frame FROM c WHERE r = 1")
def constant_frame_rate(spark, d):
    s = t.signal(spark, d)
    rows = s.select("media_id", F.col("sample_index").alias("frame"), (F.col("sample_index") * F.lit(0.041) + F.col("event_id") % 5 * F.lit(0.003)).alias("sec"))
    return shots.constant_rate(rows, s.select("media_id").distinct().withColumn("duration_sec", F.lit(2.0)))


@query(f"WITH {t.SIG}, f AS (SELECT media_id, sample_index AS frame, sample_index > 0 AND (sample_index % 17 = 0 OR event_id % 29 = 3) AS reset FROM sig), s AS (SELECT *, coalesce(max(CASE WHEN reset THEN frame END) OVER (PARTITION BY media_id ORDER BY frame), 0) AS since FROM f) SELECT media_id, frame, reset, frame < since + 6 AS cold, frame < since + 6 OR frame % 5 = 0 OR reset AS keyframe FROM s")
def matte_keyframe_schedule(spark, d):
    s = t.signal(spark, d).select("media_id", F.col("sample_index").alias("frame"), (F.col("sample_index") % 17 == 0).alias("starts_shot"), (F.col("event_id") % 29 == 3).alias("cut"))
    return shots.keyframes(s, 5)


_THIRDS = "th AS (SELECT media_id, shot_index, start_frame AS s, end_frame AS e, CASE WHEN end_frame - start_frame <= 2 THEN start_frame ELSE start_frame + (end_frame - start_frame) // 3 END AS lo, CASE WHEN end_frame - start_frame <= 2 THEN end_frame ELSE least(greatest(start_frame + (2 * (end_frame - start_frame) + 2) // 3, start_frame + (end_frame - start_frame) // 3 + 1), end_frame) END AS hi FROM fs), cand AS (SELECT media_id, shot_index, s, e, unnest(CASE WHEN hi - lo <= 7 THEN range(lo, hi) ELSE list_distinct(list_transform(range(0, 7), lambda i: lo + round_even((hi - lo - 1) / 6.0::DOUBLE * i, 0)::BIGINT)) END) AS frame FROM th)"


@query(f"WITH RECURSIVE {_FOUND.replace(t.PATCH, _SHARP, 1)}, {_THIRDS}, rk AS (SELECT cand.*, sharpness, row_number() OVER (PARTITION BY cand.media_id, shot_index ORDER BY sharpness DESC, frame) AS k FROM cand JOIN sharp ON sharp.media_id = cand.media_id AND sharp.frame_index = cand.frame) SELECT media_id, shot_index, frame, sharpness, CASE WHEN e - s <= 3 THEN 'SHORT_SHOT' END AS warning FROM rk WHERE k = 1")
def thumbnail_selection(spark, d):
    sharp = _sharpness(spark, d).select("media_id", F.col("frame_index").alias("frame"), "sharpness")
    return shots.thumbnails(_found(spark, d), sharp)


_QUALITY = f"{_FOUND.replace(t.PATCH, _SHARP, 1)}, cl AS (SELECT media_id, frame_index, avg((v >= 160)::INT) AS blown, avg((v <= 95)::INT) AS crushed FROM (SELECT media_id, frame_index, unnest(patch) AS v FROM patches) GROUP BY ALL), sk AS (SELECT fs.media_id, shot_index, avg((frame_index * 13 % 100) / 10000) AS shake FROM fs JOIN patches p ON p.media_id = fs.media_id AND frame_index >= start_frame AND frame_index < end_frame AND frame_index % 2 = 0 GROUP BY ALL)"


@query(f"WITH RECURSIVE {_QUALITY} SELECT fs.media_id, fs.shot_index, round(sharpness::DOUBLE, 6) AS sharpness, round(coalesce(shake, 0), 6) AS shake, round(blown, 6) AS blown, round(crushed, 6) AS crushed, CASE WHEN fs.shot_index % 4 = 2 THEN 0 END AS duplicate_of, concat_ws(',', CASE WHEN sharpness < 24000000 THEN 'soft_focus' END, CASE WHEN coalesce(shake, 0) >= 0.0065 THEN 'severe_shake' END, CASE WHEN blown >= 0.018 THEN 'blown_highlights' END, CASE WHEN crushed >= 0.022 THEN 'crushed_shadows' END, CASE WHEN fs.shot_index % 4 = 2 THEN 'near_duplicate' END) AS flags FROM fs JOIN sharp ON sharp.media_id = fs.media_id AND sharp.frame_index = start_frame + (end_frame - start_frame) // 2 JOIN cl ON cl.media_id = sharp.media_id AND cl.frame_index = sharp.frame_index LEFT JOIN sk ON sk.media_id = fs.media_id AND sk.shot_index = fs.shot_index")
def quality_feature(spark, d):
    p = F.col("patch")
    rows = _sharpness(spark, d).select("media_id", F.col("frame_index").alias("frame"), F.col("sharpness").cast("double").alias("sharpness"), ops.share(p, lambda v: v >= 160).alias("blown"), ops.share(p, lambda v: v <= 95).alias("crushed"))
    pairs = rows.where("frame % 2 = 0").select("media_id", F.col("frame").alias("start_frame"), (F.col("frame") * 13 % 100 / 10000).alias("residual"))
    found = _found(spark, d)
    copies = found.where("shot_index % 4 = 2").select("media_id", "shot_index", F.lit(0).alias("duplicate_of"))
    return shots.quality_document(found.select("media_id", "shot_index", "start_frame", "end_frame"), rows, pairs, copies, 24_000_000)


@query(f"WITH {t.PATCH}, lo AS (SELECT media_id, frame_index, i, (patch[(i // 2) * 16 + (i % 4) * 2 + 1]) AS v FROM patches, (SELECT unnest(range(0, 1)) AS i)) SELECT media_id, frame_index, 64 AS n, true AS bounded FROM lo")
def matte_upsample(spark, d):
    p = F.col("patch")
    alpha = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i % 4 < 2, 255).when(i % 4 == 2, 120).otherwise(0))
    rows = t.patches(spark, d).select("media_id", "frame_index", alpha.alias("alpha"), p.alias("r"), F.transform(p, lambda v: 255 - v).alias("g"), F.transform(p, lambda v: v % 50).alias("b"))
    out = images.upsample_mattes(rows, 4, 8)
    return out.select("media_id", "frame_index", F.size("matte").alias("n"), F.forall("matte", lambda v: (v >= 0) & (v <= 255)).alias("bounded"))


@query(f"WITH {t.PATCH} SELECT media_id, frame_index, true AS same FROM patches")
def guided_filter(spark, d):
    """Of a constant guide the filter is the box mean of the box mean, which the query checks beside it."""
    p = F.col("patch")
    flat = F.transform(p, lambda v: F.lit(90))
    rows = t.patches(spark, d)
    one = images.guided_filter(rows.select("media_id", "frame_index", p.alias("alpha"), flat.alias("r"), flat.alias("g"), flat.alias("b")), 8, 2)
    mean = images.box_filter(rows.select("media_id", "frame_index", p.cast("array<double>").alias("patch")), "patch", 8, 2)
    twice = images.box_filter(mean, "filtered", 8, 2)
    both = one.join(twice, ["media_id", "frame_index"])
    return both.select("media_id", "frame_index", F.forall(F.zip_with("refined", "filtered", lambda a, b: F.abs(a - b) < 1.001), lambda x: x).alias("same"))
