"""Queries of the composed features and of models; their SQL joins the SQL of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from frametide.operators import features, models
from frametide.plans import images as _images_plans  # noqa: F401 - registers the parts
from frametide.plans import spectral as _spectral_plans  # noqa: F401
from frametide.plans.registry import ORACLES, _crowded, query, r6
from frametide.sources import tables as t

_part = lambda name: "(" + ORACLES[name] + ")"


def _pcm(spark, d):
    return t.signal(spark, d).select("media_id", "sample_index", "x")


@query(f"""WITH m AS (SELECT DISTINCT user_id AS media_id FROM events UNION SELECT DISTINCT -user_id - 1 FROM events), r AS (SELECT media_id, count(*) AS n, round(sum(rms) + 1e-9, 4) AS s FROM {_part('audio_rms_hops')} GROUP BY 1), o AS (SELECT media_id, count(*) AS n FROM {_part('onset_refractory')} GROUP BY 1), s AS (SELECT media_id, count(*) AS n, round(sum(end_sec - start_sec) + 1e-9, 4) AS sec FROM {_part('speech_segments')} GROUP BY 1)
SELECT m.media_id, CASE WHEN r.n IS NULL THEN 'absent' ELSE 'present' END AS presence, coalesce(r.n, 0)::INT AS n_rms, coalesce(r.s, 0) AS rms_sum, coalesce(o.n, 0)::INT AS n_onsets, coalesce(s.n, 0)::INT AS n_speech, coalesce(s.sec, 0) AS speech_sec, lufs, bpm FROM m LEFT JOIN r USING (media_id) LEFT JOIN o USING (media_id) LEFT JOIN s USING (media_id) LEFT JOIN {_part('gated_loudness')} g USING (media_id) LEFT JOIN {_part('tempo_estimate')} b USING (media_id)""")
def audio_feature(spark, d):
    ids = t.table(spark, d, "events").select(F.col("user_id").alias("media_id")).distinct()
    out = features.audio_feature(_pcm(spark, d), t.vad(spark, d), ids.union(ids.select(-F.col("media_id") - 1)), 10, 0.1, 0.02, 31.25, 8, 2)
    total = lambda c, f: F.round(F.aggregate(c, F.lit(1e-9), lambda s, r: s + f(r)), 4)
    return out.select("media_id", "presence", F.size("rms").alias("n_rms"), total("rms", lambda r: F.round(r["rms"], 6)).alias("rms_sum"), F.size("onsets").alias("n_onsets"), F.size("speech").alias("n_speech"), total("speech", lambda r: r["end_sec"] - r["start_sec"]).alias("speech_sec"), F.round("lufs", 6).alias("lufs"), "bpm")


@query(f"WITH m AS (SELECT DISTINCT user_id AS media_id FROM events UNION SELECT DISTINCT -user_id - 1 FROM events), e AS (SELECT media_id, count(*) AS n, round(sum(low) + 1e-9, 4) AS low, round(sum(high) + 1e-9, 4) AS high FROM {_part('audio_waveform_envelope')} GROUP BY 1) SELECT m.media_id, coalesce(n, 0)::INT AS n, coalesce(low, 0) AS low, coalesce(high, 0) AS high, CASE WHEN n IS NULL THEN 'AUDIO_ABSENT' END AS reason FROM m LEFT JOIN e USING (media_id)")
def waveform_feature(spark, d):
    ids = t.table(spark, d, "events").select(F.col("user_id").alias("media_id")).distinct()
    out = features.waveform_feature(_pcm(spark, d), ids.union(ids.select(-F.col("media_id") - 1)), 2)
    total = lambda c: F.round(F.aggregate(c, F.lit(1e-9), lambda s, v: s + F.round(v, 6)), 4).alias(c)
    return out.select("media_id", F.size("low").alias("n"), total("low"), total("high"), "reason")


@query(f"WITH w AS (SELECT media_id, count(*) AS n, round(sum(magnitude) + 1e-9, 5) AS magnitude FROM {_part('motion_windows_circular_mean')} GROUP BY 1), r AS (SELECT media_id, count(*) AS n, string_agg(kind, ',' ORDER BY start_frame) AS kinds FROM {_part('camera_move_rle')} GROUP BY 1) SELECT media_id, w.n::INT AS n_windows, magnitude, r.n::INT AS n_moves, kinds FROM w LEFT JOIN r USING (media_id)")
def motion_feature(spark, d):
    out = features.motion_feature(t.motion_pairs(spark, d))
    return out.select("media_id", F.size("windows").alias("n_windows"), F.round(F.aggregate("windows", F.lit(1e-9), lambda s, w: s + w["magnitude"]), 5).alias("magnitude"), F.size("moves").alias("n_moves"), F.array_join(F.transform("moves", lambda m: m["kind"]), ",").alias("kinds"))


_LIN = lambda c: f"CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END"


@query(f"WITH {t.PIXELS}, y AS (SELECT media_id, frame_index // 10 AS shot, 0.2126729 * {_LIN('r')} + 0.7151522 * {_LIN('g')} + 0.0721750 * {_LIN('b')} AS y, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s FROM pixels), e AS (SELECT media_id, shot, round(avg(y), 4) AS mean_luma, round(quantile_cont(y, 0.05), 4) AS p05_luma, round(quantile_cont(y, 0.95), 4) AS p95_luma, round(quantile_cont(y, 0.95) - quantile_cont(y, 0.05), 4) AS contrast, round(avg(s), 4) AS saturation FROM y GROUP BY ALL), c AS (SELECT media_id, shot, string_agg(hex, ',' ORDER BY rank) AS colours FROM {_part('palette_topk')} GROUP BY ALL) SELECT e.*, coalesce(colours, '') AS colours FROM e LEFT JOIN c USING (media_id, shot)")
def exposure_feature(spark, d):
    rows = t.pixels(spark, d).withColumn("shot", F.floor(F.col("frame_index") / 10))
    out = features.exposure_feature(rows, ["media_id", "shot"])
    return out.select("media_id", "shot", "mean_luma", "p05_luma", "p95_luma", "contrast", "saturation", F.array_join(F.transform("colours", lambda c: c["hex"]), ",").alias("colours"))


@query(f"WITH s AS (SELECT media_id, frame_index, count(*) AS n, round(sum(px) + 1e-9, 4) AS px FROM {_part('saliency_regions')} GROUP BY ALL), {t.PATCH} SELECT media_id, frame_index, coalesce(n, 0)::INT AS n_regions, coalesce(n, 0)::INT AS n_candidates, coalesce(px, 0) AS px, CASE WHEN n IS NULL THEN 'insufficient-contrast' ELSE 'contrast-evidence' END AS validity FROM patches LEFT JOIN s USING (media_id, frame_index)")
def image_focus_feature(spark, d):
    rows = t.patches(spark, d).select("media_id", "frame_index", F.transform("patch", lambda v: (v % 60 + F.when(F.col("frame_index") % 7 == 0, -60).otherwise(0)).cast("double")).alias("contrast"))
    out = features.image_feature(rows, 8)
    return out.select("media_id", "frame_index", F.size("regions").alias("n_regions"), F.size("candidates").alias("n_candidates"), F.round(F.aggregate("candidates", F.lit(1e-9), lambda s, c: s + F.round(c["px"], 6)), 4).alias("px"), "validity")


@query()
def subjects_feature(spark, d):
    out = features.subjects_feature(_crowded(spark, d), 4, F.col("frame") % 20 == 0)
    return r6(out.select("media_id", "track", "aggregate_score", "n_samples"), "aggregate_score")


@query()
def text_feature(spark, d):
    rows = _crowded(spark, d)
    return features.text_feature(rows, rows.groupBy("media_id").agg((F.max("frame") + 1).alias("n_frames")))


@query("WITH asked AS (SELECT user_id AS media_id, list(DISTINCT CASE event_type WHEN 'view' THEN 'waveform' WHEN 'click' THEN 'motion' WHEN 'error' THEN 'rhythm' ELSE 'person_matte' END) AS f FROM events GROUP BY 1) SELECT media_id, len(f)::INT AS features, (list_contains(f, 'waveform')::INT + list_contains(f, 'motion')::INT) AS completed, CASE WHEN len(f) = list_contains(f, 'waveform')::INT + list_contains(f, 'motion')::INT THEN 'completed' WHEN list_contains(f, 'rhythm') AND NOT (list_contains(f, 'waveform') OR list_contains(f, 'motion')) THEN 'failed' ELSE 'partial' END AS status, concat_ws(',', CASE WHEN list_contains(f, 'person_matte') THEN 'FEATURE_UNAVAILABLE' END, CASE WHEN list_contains(f, 'rhythm') THEN 'RuntimeError' END) AS warnings FROM asked")
def analyze_requests(spark, d):
    """Two features that run, one that fails when planned, one that is not served."""
    kind = F.col("event_type")
    asked = t.table(spark, d, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.collect_set(F.when(kind == "view", "waveform").when(kind == "click", "motion").when(kind == "error", "rhythm").otherwise("person_matte")).alias("features"))
    ids = t.table(spark, d, "events").select(F.col("user_id").alias("media_id")).distinct()

    def broken():
        raise RuntimeError("no tempo today")

    plans = {
        "waveform": lambda: features.waveform_feature(_pcm(spark, d), ids, 2).select("media_id", F.to_json(F.struct("low", "high")).alias("body")),
        "motion": lambda: features.motion_feature(t.motion_pairs(spark, d)).select("media_id", F.to_json(F.struct("windows", "moves")).alias("body")),
        "rhythm": broken,
    }
    out = features.analyze(asked, plans, ["waveform", "motion", "rhythm"])
    return out.select("media_id", "features", "completed", "status", F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {t.PATCH}, m AS (SELECT media_id, frame_index, patch, list_avg(patch) AS mean FROM patches) SELECT media_id, frame_index, 'ok' AS status, len(list_filter(patch, lambda v: v > mean))::INT AS foreground FROM m")
def stub_matte_inference(spark, d):
    rows = t.patches(spark, d).select("media_id", "frame_index", F.col("patch").alias("grey"))
    out = models.infer(rows, models.threshold_matte(), ["media_id", "frame_index"])
    return out.select("media_id", "frame_index", "status", F.size(F.filter("alpha", lambda v: v == 255)).alias("foreground"))


@query(f"WITH {t.VAD} SELECT media_id, window_index, 'ok' AS status, 0.05::DOUBLE AS score FROM vad")
def stub_vad_inference(spark, d):
    rows = t.vad(spark, d).select("media_id", "window_index", F.array(F.col("score")).alias("samples"))
    return models.infer(rows, models.silent_vad(), ["media_id", "window_index"])


@query(f"WITH RECURSIVE {t.PATCH}, m AS (SELECT media_id, frame_index, i, patch[i + 1] AS v FROM patches, (SELECT unnest(range(0, 64)) AS i) WHERE patch[i + 1] >= 150), e AS (SELECT a.media_id, a.frame_index, a.i AS u, b.i AS v FROM m a JOIN m b ON a.media_id = b.media_id AND a.frame_index = b.frame_index AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1), r AS (SELECT media_id, frame_index, i AS root, i AS v FROM m UNION SELECT r.media_id, r.frame_index, r.root, e.v FROM r JOIN e ON e.media_id = r.media_id AND e.frame_index = r.frame_index AND e.u = r.v), lab AS (SELECT media_id, frame_index, v AS i, min(root) AS label FROM r GROUP BY ALL) SELECT media_id, frame_index, 'bright' AS label, round(min(i % 8) / 8, 6) AS x, round(min(i // 8) / 8, 6) AS y, round((max(i % 8) - min(i % 8) + 1) / 8, 6) AS w, round((max(i // 8) - min(i // 8) + 1) / 8, 6) AS h, round(avg(m.v) / 255, 6) AS score FROM lab JOIN m USING (media_id, frame_index, i) GROUP BY media_id, frame_index, lab.label")
def stub_detector_regions(spark, d):
    rows = t.patches(spark, d).select("media_id", "frame_index", F.col("patch").alias("grey"))
    found = models.untracked(models.infer(rows, models.bright_boxes(8, 150), ["media_id", "frame_index"]), ["media_id", "frame_index"], "bright")
    return r6(found.select("media_id", "frame_index", "label", "box.x", "box.y", "box.w", "box.h", "score"), "x", "y", "w", "h", "score")


@query("SELECT n_name AS model, 'input' AS tensor, CASE WHEN n_nationkey % 4 = 1 THEN 'missing' WHEN n_nationkey % 5 = 2 THEN 'rank' WHEN n_nationkey % 3 = 2 THEN 'dtype' END AS fault FROM nation")
def model_io_compatibility(spark, d):
    n = t.table(spark, d, "nation")
    k, tensor = F.col("n_nationkey"), F.lit("input").alias("tensor")
    found = n.where("n_nationkey % 4 <> 1").select(F.col("n_name").alias("model"), tensor, F.when(k % 5 == 2, 3).otherwise(4).alias("rank"), F.when(k % 3 == 2, "float64").otherwise("float32").alias("dtype"))
    return models.compatible(found, n.select(F.col("n_name").alias("model"), tensor, F.lit(4).alias("rank"), F.lit("float32").alias("dtype")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not_requested' WHEN event_id % 5 = 0 THEN 'unavailable' WHEN value > 60 THEN 'limit_exceeded' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status FROM events")
def beat_outcomes(spark, d):
    e = F.col("event_id")
    return t.table(spark, d, "events").select("event_id", models.beat_outcome(e % 3 != 0, e % 5 != 0, F.col("value"), 60.0, F.when(F.col("event_type") == "error", "INVALID")).alias("status"))


@query("WITH b AS (SELECT CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 = 1 THEN 'not loaded: ' || p_partkey WHEN p_partkey % 7 <> 1 AND p_partkey % 11 = 3 THEN 'stub: ' || p_partkey END AS b FROM part) SELECT count(b) = 0 AS ready, list_aggregate(list_sort(list(b)), 'string_agg', ';') AS blockers FROM b WHERE b IS NOT NULL")
def runtime_readiness(spark, d):
    k = F.col("p_partkey")
    rows = t.table(spark, d, "part").select(k.cast("string").alias("name"), (k % 2 == 0).alias("required"), (k % 7 != 1).alias("loaded"), (k % 11 == 3).alias("stub"))
    return models.readiness(rows, False).withColumn("blockers", F.array_join("blockers", ";"))
