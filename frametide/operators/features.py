"""The features a caller asks for, each a composition of the operators, and the plan that runs a set of them.

A feature gives one row for each media (or shot) with a JSON body; ``analyze`` validates and routes requests, runs what is asked
for, and assembles one document per request. A feature that cannot be planned or run fails alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametide.operators import audio, colour, frames, images, requests, service, spectral, tracks


def listed(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """(key, name): the rows of each key as an ordered array of structs."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_row")))), lambda r: r["_row"]).alias(name))


def audio_feature(pcm: DataFrame, vad: DataFrame, media: DataFrame, hop: int, onset_gap: float, onset_floor: float, rate: float, block: int, step: int) -> DataFrame:
    """(media_id, presence, rms, onsets, speech, lufs, bpm): levels, merged onsets, speech segments, gated loudness and tempo of each media; without samples it is absent and all else empty."""
    rms = listed(audio.rms_hops(pcm, hop), "media_id", ["hop"], ["hop", "rms"], "rms")
    peaks = audio.local_maxima(pcm.select("media_id", "sample_index", "x"), "x", onset_floor).select("media_id", F.round(F.col("sample_index") / rate, 6).alias("sec"), F.col("x").alias("strength"))
    onsets = listed(audio.merge_onsets(peaks, onset_gap), "media_id", ["sec"], ["sec", "strength"], "onsets")
    speech = listed(audio.speech_segments(vad), "media_id", ["start_sec"], ["start_sec", "end_sec", "score"], "speech")
    out = audio.presence(pcm, media, 1e-4)
    for part in (rms, onsets, speech, spectral.gated_loudness(pcm.select("media_id", "sample_index", "x"), block, step), spectral.tempo(pcm.select("media_id", "sample_index", "x"), 16000.0).select("media_id", "bpm")):
        out = out.join(part, "media_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in ("rms", "onsets", "speech")})


def waveform_feature(pcm: DataFrame, media: DataFrame, hop: int) -> DataFrame:
    """(media_id, low, high, reason): the envelope as two arrays; empty, with AUDIO_ABSENT, for a media without samples."""
    out = listed(audio.envelope(pcm, hop), "media_id", ["bucket"], ["low", "high"], "e")
    rows = media.join(out, "media_id", "left")
    column = lambda c: F.coalesce(F.transform("e", lambda r: r[c]), F.array().cast("array<double>")).alias(c)
    return rows.select("media_id", column("low"), column("high"), F.when(F.col("e").isNull(), "AUDIO_ABSENT").alias("reason"))


def motion_feature(pairs: DataFrame) -> DataFrame:
    """(media_id, windows, moves): motion windows and the camera moves merged from them."""
    windows = frames.motion_windows(pairs)
    one = listed(windows, "media_id", ["start_frame"], ["start_frame", "end_frame", "magnitude", "direction", "coherence"], "windows")
    two = listed(frames.camera_runs(frames.camera_moves(windows)), "media_id", ["start_frame"], ["start_frame", "end_frame", "kind", "magnitude", "score"], "moves")
    return one.join(two, "media_id", "left")


def exposure_feature(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, ends and contrast of the linear luma, mean saturation, colour temperature and palette of each group of pixels; four digits."""
    weights = colour.TO_XYZ[1]
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0))
    luma = sum((colour.linear(F.col(c)) * w for c, w in zip("rgb", weights, strict=True)), F.lit(0.0))
    rows = pixels.withColumn("_y", luma).withColumn("_s", saturation)
    out = rows.groupBy(*keys).agg(F.avg("_y").alias("mean_luma"), F.percentile("_y", F.lit(0.05)).alias("p05_luma"), F.percentile("_y", F.lit(0.95)).alias("p95_luma"), F.avg("_s").alias("saturation"))
    out = out.withColumn("contrast", F.col("p95_luma") - F.col("p05_luma")).withColumns({c: F.round(c, 4) for c in ("mean_luma", "p05_luma", "p95_luma", "contrast", "saturation")})
    colours = colour.palette(pixels, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hex", "fraction"))), lambda r: F.struct(r["hex"].alias("hex"), r["fraction"].alias("fraction"))).alias("colours"))
    return out.join(colour.temperature(pixels, keys), keys, "left").join(colours, keys, "left").withColumn("colours", F.coalesce("colours", F.array().cast("array<struct<hex:string,fraction:double>>")))


def image_feature(maps: DataFrame, width: int) -> DataFrame:
    """Salient regions of contrast maps, the focus candidates they give, and whether there is any evidence."""
    rows = images.salient_regions(maps, width)
    return rows.withColumn("candidates", images.focus_candidates(F.col("regions"))).withColumn("validity", F.when(F.size("regions") > 0, "contrast-evidence").otherwise("insufficient-contrast"))


def subjects_feature(detections: DataFrame, max_gap: int, mandatory: Column) -> DataFrame:
    """(media_id, track, aggregate_score, n_samples, samples): detections of the sampled frames, tracked shot by shot, gaps filled, one row a track; ``track`` is SHOT-NUMBER."""
    tracked = tracks.track_boxes(detections)
    rows = tracked.join(detections.select("media_id", "shot_index", "frame", "det", *"xywh"), ["media_id", "shot_index", "frame", "det"])
    name = F.concat_ws("-", "shot_index", "track")
    rows = rows.select("media_id", name.alias("track"), "frame", *"xywh", "score")
    keyed = rows.select(F.struct("media_id", "track").alias("media_id"), "frame", *"xywh")
    filled = frames.gap_fill(keyed, max_gap, mandatory).select("media_id.media_id", "media_id.track", "frame", *"xywh", "kind")
    return tracks.serialise(filled.join(rows.select("media_id", "track", "frame", "score"), ["media_id", "track", "frame"], "left"))


def text_feature(boxes: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, region, span, kind): overlaid text, merged over time within shots. ``media``: (media_id, n_frames)."""
    kept = frames.text_bands(boxes)
    regions = tracks.merge_text(kept).join(kept.select("media_id", "shot_index", "frame", "det", *"xywh"), ["media_id", "shot_index", "frame", "det"])
    return tracks.region_kind(regions.select("media_id", "region", "frame", *"xywh"), media)


def empty_results(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """Parts (media_id, feature, status, body): what was asked for and completed without a result has an empty body, what was not completed none, what was not asked for no row."""
    rows = asked.join(parts, ["media_id", "feature"], "left")
    return rows.select("media_id", "feature", F.coalesce("status", F.lit("failed")).alias("status"), F.when(F.col("status").isin("completed", "partial"), F.coalesce("body", F.lit("[]"))).alias("body"))


def analyze(asked: DataFrame, features: dict[str, Callable[[], DataFrame]], served: list[str]) -> DataFrame:
    """(media_id, features, completed, warnings, document, status): the documents of requests (media_id, features array, kind).

    A feature is (media_id, body); those that no request asks for are never planned. One that raises while it is planned is failed, with the name of the error as its warning, in every request that asks for it.
    """
    wanted = asked.select("media_id", F.explode("features").alias("feature"))
    names = [r["feature"] for r in wanted.select("feature").distinct().collect()]  # at most as many as there are features
    parts = None
    for name in sorted(names):
        own = wanted.where(F.col("feature") == name)
        try:
            if name not in served or name not in features:
                raise LookupError("FEATURE_UNAVAILABLE")
            part = own.join(features[name]().select("media_id", "body"), "media_id", "left").select("media_id", "feature", F.lit("completed").alias("status"), "body", F.array().cast("array<string>").alias("warnings"))
        except Exception as error:  # noqa: BLE001 - one feature must not end the others
            part = own.select("media_id", "feature", F.lit("unavailable" if isinstance(error, LookupError) else "failed").alias("status"), F.lit(None).cast("string").alias("body"), F.array(F.lit(str(error.args[0]) if isinstance(error, LookupError) else type(error).__name__)).alias("warnings"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = wanted.select("media_id", "feature", F.lit("").alias("status"), F.lit(None).cast("string").alias("body"), F.array().cast("array<string>").alias("warnings"))
    from frametide.operators.control import overall_status

    return service.assemble(parts).join(overall_status(parts, "media_id").select("media_id", "status"), "media_id")


FEATURES_BY_KIND = {"video": requests.VIDEO, "image": requests.IMAGE, "audio": requests.AUDIO}
