"""Shot boundaries from frame differences, constant frame rates, keyframes of mattes, and thumbnails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.functions.rates import seconds
from frametide.operators.folds import fold
from frametide.operators.sampling import THIRD_SAMPLES, even_frames, middle_third

#: Adaptive content detector (ratio, least content, neighbours on each side), least length of a shot, score of a cut; frames a matte stays cold; shots too short for a choice of thumbnails.
RATIO, LEAST_CONTENT, NEIGHBOURS, LEAST_FRAMES, CUT_SCORE, COLD_FRAMES, SHORT_SHOT = 3.0, 15.0, 2, 15, 0.8, 6, 3


def content_scores(frames: DataFrame) -> DataFrame:
    """(media_id, frame, content): mean of the mean absolute differences of the channels h, s, v (arrays) to the frame before; 0 for the first."""
    w = Window.partitionBy("media_id").orderBy("frame")
    rows = frames.withColumns({f"_{c}": F.lag(c).over(w) for c in "hsv"})
    change = lambda c: F.aggregate(F.zip_with(c, f"_{c}", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return rows.select("media_id", "frame", F.coalesce((change("h") + change("s") + change("v")) / 3, F.lit(0.0)).alias("content"))


def adaptive_cuts(scores: DataFrame, ratio: float = RATIO, least: float = LEAST_CONTENT, side: int = NEIGHBOURS, length: int = LEAST_FRAMES) -> DataFrame:
    """(media_id, frame): frames whose content is ``least`` at least and ``ratio`` times the mean of ``side`` frames before and behind, ``length`` frames or more behind the cut before. Frames without all neighbours are none."""
    w = Window.partitionBy("media_id").orderBy("frame")
    around = [F.lag("content", k).over(w) for k in range(1, side + 1)] + [F.lead("content", k).over(w) for k in range(1, side + 1)]
    rows = scores.withColumn("_near", F.array(*around)).where(~F.exists("_near", lambda v: v.isNull()))
    mean = F.aggregate("_near", F.lit(0.0), lambda s, v: s + v) / (2 * side)
    value = F.when(F.abs(mean) < 1e-5, F.when(F.col("content") >= least, 255.0).otherwise(0.0)).otherwise(F.least(F.col("content") / mean, F.lit(255.0)))
    rows = rows.where((F.col("content") >= least) & (F.round(value, 9) >= ratio)).select("media_id", "frame")

    def step(state: dict, row: dict) -> list[tuple]:
        if row["frame"] - state["last"] < length:
            return []
        state["last"] = row["frame"]
        return [(row["media_id"], row["frame"])]

    return fold(rows, ["media_id"], ["frame"], lambda row: {"last": 0}, step, "media_id long, frame long")


def shots_from_cuts(cuts: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, shot_index, start_frame, end_frame, boundary, score) over each media's frame_count; a media without cuts is one shot of score 1, ended by its end."""
    starts = media.select("media_id", "frame_count", F.lit(0).cast("long").alias("start_frame")).union(cuts.join(media, "media_id").where("frame > 0 AND frame < frame_count").select("media_id", "frame_count", "frame"))
    w = Window.partitionBy("media_id").orderBy("start_frame")
    alone = F.count("*").over(Window.partitionBy("media_id")) == 1
    rows = starts.withColumn("shot_index", (F.row_number().over(w) - 1).cast("long")).withColumn("end_frame", F.coalesce(F.lead("start_frame").over(w), F.col("frame_count")))
    boundary = F.when(alone, "end").when(F.col("shot_index") == 0, "start").otherwise("hard_cut")
    return rows.where("end_frame > start_frame").select("media_id", "shot_index", "start_frame", "end_frame", boundary.alias("boundary"), F.when(alone, 1.0).otherwise(CUT_SCORE).alias("score"))


def shot_document(shots: DataFrame, labels: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Shots with their times and labels (media_id, shot_index, label, score)."""
    at = lambda c: seconds(F.col(c), F.lit(numerator), F.lit(denominator))
    return shots.withColumn("start_sec", at("start_frame")).withColumn("end_sec", at("end_frame")).join(labels.select("media_id", "shot_index", "label", F.col("score").alias("label_score")), ["media_id", "shot_index"], "left")


def constant_rate(frames: DataFrame, media: DataFrame, rate: int = 30) -> DataFrame:
    """(media_id, tick, frame): for each tick of 1 / ``rate`` seconds up to a media's duration the frame nearest in time, the earlier one on ties.

    Frames and ticks are merged in one order of time, so no tick meets all frames of its media. ``frames``: (media_id, frame, sec), ``media``: (media_id, duration_sec).
    """
    ticks = media.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration_sec") * rate) - 1)).alias("tick")).withColumn("sec", F.col("tick") / rate)
    both = frames.select("media_id", "sec", F.lit(0).alias("side"), F.struct("sec", "frame").alias("_f"), F.lit(None).cast("long").alias("tick"))
    both = both.union(ticks.select("media_id", "sec", F.lit(1), F.lit(None).cast(both.schema["_f"].dataType), "tick"))
    order = Window.partitionBy("media_id").orderBy("sec", "side")
    before = F.last("_f", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first("_f", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("_b", before).withColumn("_a", behind).where("side = 1")
    near = F.when(F.col("_b").isNull(), F.col("_a.frame")).when(F.col("_a").isNull(), F.col("_b.frame")).when(F.round(F.col("sec") - F.col("_b.sec"), 9) <= F.round(F.col("_a.sec") - F.col("sec"), 9), F.col("_b.frame")).otherwise(F.col("_a.frame"))
    return rows.select("media_id", "tick", near.alias("frame"))


def keyframes(frames: DataFrame, every: int, cold: int = COLD_FRAMES) -> DataFrame:
    """(media_id, frame, reset, cold, keyframe): the state starts anew at shot starts (not the first) and cuts; it is cold for ``cold`` frames from there and from the first; cold frames, every ``every``-th frame and resets are inferred anew.

    ``frames``: (media_id, frame, starts_shot, cut).
    """
    reset = F.col("frame").cast("long") > 0
    reset = reset & (F.col("starts_shot") | F.col("cut"))
    w = Window.partitionBy("media_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("reset", reset).withColumn("_since", F.coalesce(F.last(F.when(F.col("reset"), F.col("frame")), True).over(w), F.lit(0)))
    rows = rows.withColumn("cold", F.col("frame") < F.col("_since") + cold)
    return rows.select("media_id", "frame", "reset", "cold", (F.col("cold") | (F.col("frame") % every == 0) | F.col("reset")).alias("keyframe"))


def thumbnails(shots: DataFrame, sharpness: DataFrame) -> DataFrame:
    """(media_id, shot_index, frame, sharpness, warning): the sharpest of up to seven frames of each shot's middle third, the earliest on ties; very short shots carry a warning.

    ``sharpness``: (media_id, frame, sharpness).
    """
    low, high = middle_third(F.col("start_frame"), F.col("end_frame"))
    rows = shots.withColumn("_lo", low).withColumn("_hi", high).withColumn("frame", F.explode(even_frames(F.col("_lo"), F.col("_hi"), THIRD_SAMPLES))).join(sharpness, ["media_id", "frame"])
    w = Window.partitionBy("media_id", "shot_index").orderBy(F.desc("sharpness"), "frame")
    best = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select("media_id", "shot_index", "frame", "sharpness", F.when(F.col("end_frame") - F.col("start_frame") <= SHORT_SHOT, "SHORT_SHOT").alias("warning"))


def quality_document(shots: DataFrame, frames: DataFrame, pairs: DataFrame, copies: DataFrame, soft: float) -> DataFrame:
    """One row for each shot: sharpness, blown and crushed of its middle frame, shake (mean residual of its motion pairs), duplicate_of and flags; six digits.

    ``frames``: (media_id, frame, sharpness, blown, crushed), ``pairs``: (media_id, start_frame, residual), ``copies``: (media_id, shot_index, duplicate_of).
    """
    from frametide.operators.frames import frames_to_shots, quality_flags

    middle = shots.withColumn("frame", F.col("start_frame") + F.floor((F.col("end_frame") - F.col("start_frame")) / 2)).join(frames, ["media_id", "frame"])
    shake = frames_to_shots(pairs.select("media_id", F.col("start_frame").alias("frame"), "residual"), shots).groupBy("media_id", "shot_index").agg(F.avg("residual").alias("shake"))
    rows = middle.join(shake, ["media_id", "shot_index"], "left").join(copies.select("media_id", "shot_index", "duplicate_of"), ["media_id", "shot_index"], "left").withColumn("shake", F.coalesce("shake", F.lit(0.0)))
    flags = quality_flags(F.col("sharpness"), F.col("shake"), F.col("blown"), F.col("crushed"), F.col("duplicate_of"), soft)
    return rows.select("media_id", "shot_index", *[F.round(c, 6).alias(c) for c in ("sharpness", "shake", "blown", "crushed")], "duplicate_of", flags.alias("flags"))


def policy_version(name: str, values: dict[str, object]) -> Column:
    """The name of a policy with the thresholds it was run with, as a literal."""
    return F.lit(name + "".join(f"-{k}{v}" for k, v in values.items()))
