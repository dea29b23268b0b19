"""Frame patches, shots, detections, tracks and camera motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.functions.geometry import iou
from frametide.operators.folds import by_group, fold

#: Hash side and distance, clip levels, windows of motion pairs, suppression overlap and count, smoothing weight of the past.
NEAR_DUPLICATE_BITS, CLIP_LOW, CLIP_HIGH, MOTION_WINDOW, NMS_IOU, NMS_MOST, EMA_WEIGHT = 6, 5, 250, 15, 0.45, 100, 0.65
#: Bands of overlaid text, least score of a detection, quality flags.
TEXT_TOP, TEXT_BOTTOM, MIN_SCORE, SHAKE, BLOWN, CRUSHED = 0.20, 0.85, 0.25, 0.0065, 0.018, 0.022
#: Thresholds of the camera moves.
STATIC, MOVING, HANDHELD, WHIP = 0.0018, 0.0025, 0.0020, 0.028
PUSH, PULL, DIRECTED, STEADY = 1.004, 0.996, 0.52, 0.48
WHIP_COHERENCE, HANDHELD_COHERENCE, HANDHELD_RESIDUAL = 0.42, 0.54, 0.0035


def frames_to_shots(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """Each frame with the half-open shot that holds it; frames outside every shot go.

    Shots of a media do not overlap, so the shot is the last one that begins at or before the frame: frames and shot
    starts are merged in one order, and no frame meets the other shots of its media.
    """
    begins = shots.select("media_id", F.col("start_frame").alias("_at"), F.lit(0).alias("_side"), F.struct("shot_index", "start_frame", "end_frame").alias("_shot"))
    others = [c for c in frames.columns if c != "media_id"]
    both = begins.withColumn("_row", F.lit(None).cast(frames.select(F.struct(*others)).schema[0].dataType)).unionByName(frames.select("media_id", F.col("frame").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("struct<shot_index:bigint,start_frame:bigint,end_frame:bigint>").alias("_shot"), F.struct(*others).alias("_row")))
    w = Window.partitionBy("media_id").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_shot", F.last("_shot", True).over(w)).where("_side = 1 AND _shot IS NOT NULL AND _at < _shot.end_frame")
    return held.select("media_id", "_row.*", "_shot.*")


def timeline_faults(shots: DataFrame) -> DataFrame:
    """Per media: shots, empty shots, gaps and overlaps between neighbours, and whether the timeline is valid."""
    w = Window.partitionBy("media_id").orderBy("shot_index")
    rows = shots.withColumn("_end", F.lag("end_frame").over(w))
    out = rows.groupBy("media_id").agg(
        F.count("*").alias("n_shots"),
        F.sum((F.col("end_frame") <= F.col("start_frame")).cast("long")).alias("n_empty"),
        F.sum(F.coalesce(F.col("start_frame") > F.col("_end"), F.lit(False)).cast("long")).alias("n_gaps"),
        F.sum(F.coalesce(F.col("start_frame") < F.col("_end"), F.lit(False)).cast("long")).alias("n_overlaps"),
    )
    return out.withColumn("valid", ((F.col("n_empty") + F.col("n_gaps") + F.col("n_overlaps")) == 0).cast("int"))


def sample_periodic(shots: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th frame of each shot, from its first."""
    return shots.where("end_frame > start_frame").select("media_id", "shot_index", F.explode(F.sequence("start_frame", F.col("end_frame") - 1, F.lit(step).cast("long"))).alias("frame"))


def sample_periodic_with_last(shots: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th frame of each shot, and its last."""
    every = F.concat(F.sequence("start_frame", F.col("end_frame") - 1, F.lit(step).cast("long")), F.array(F.col("end_frame") - 1))
    return shots.where("end_frame > start_frame").select("media_id", "shot_index", F.explode(F.array_distinct(every)).alias("frame"))


def sample_text_frames(shots: DataFrame, burst: int = 2) -> DataFrame:
    """Each shot's middle frame, the frames within ``burst`` of its first and last, and the media's first and last; distinct."""
    rows = shots.where("end_frame > start_frame").withColumn("_last", F.max(F.col("end_frame") - 1).over(Window.partitionBy("media_id")))
    around = lambda c: F.sequence(F.greatest(c - burst, F.lit(0)), F.least(c + burst, F.col("_last")))
    ends = F.array(F.lit(0).cast("long"), F.col("_last"), F.floor((F.col("start_frame") + F.col("end_frame")) / 2))
    return rows.select("media_id", F.explode(F.concat(ends, around(F.col("start_frame")), around(F.col("end_frame") - 1))).alias("frame")).distinct()


def sample_middle_third(shots: DataFrame) -> DataFrame:
    n = F.col("end_frame") - F.col("start_frame")
    return shots.select("media_id", "shot_index", (F.col("start_frame") + F.floor(n / 3)).alias("from_frame"), (F.col("start_frame") + F.ceil(n * 2 / 3)).alias("to_frame"))


def sample_representative(shots: DataFrame) -> DataFrame:
    return shots.select("media_id", "shot_index", F.floor((F.col("start_frame") + F.col("end_frame")) / 2).alias("frame"))


def iou_pairs(boxes: DataFrame, least: float) -> DataFrame:
    """Pairs of detections of one frame that overlap by at least ``least``."""
    cols = ("x", "y", "w", "h")
    a = boxes.select("media_id", "frame", F.col("det").alias("det_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = boxes.select("media_id", "frame", F.col("det").alias("det_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    overlap = iou({c: F.col(f"a_{c}") for c in cols}, {c: F.col(f"b_{c}") for c in cols})
    return a.join(b, ["media_id", "frame"]).where("det_a < det_b").select("media_id", "frame", "det_a", "det_b", overlap.alias("iou")).where(F.col("iou") >= least)


def text_bands(boxes: DataFrame) -> DataFrame:
    """Boxes whose centre lies in the top or bottom band, where overlaid text stands (bounds included)."""
    centre = F.round(F.col("y") + F.col("h") / 2, 6)
    return boxes.where((centre <= TEXT_TOP) | (centre >= TEXT_BOTTOM))


def confident(boxes: DataFrame, wanted: int, least: float = MIN_SCORE) -> DataFrame:
    """Detections of the wanted class at or above the least score."""
    return boxes.where((F.col("score") >= least) & (F.col("class") == wanted))


def between(left: str, right: str, part: Column) -> Column:
    return F.col(left) + (F.col(right) - F.col(left)) * part


def gap_fill(track: DataFrame, max_gap: int, mandatory: Column) -> DataFrame:
    """Samples of each track, and a box between two of them at every ``max_gap``-th frame from the left one: ``tracked`` where ``mandatory`` holds for its frame, else ``interpolated``."""
    w = Window.partitionBy("media_id").orderBy("frame")
    rows = track.withColumns({f"_{c}": F.lead(c).over(w) for c in ("frame", *"xywh")})
    steps = F.when(F.col("_frame") - F.col("frame") > max_gap, F.sequence(F.col("frame") + max_gap, F.col("_frame") - 1, F.lit(max_gap).cast("long"))).otherwise(F.array().cast("array<long>"))
    filled = rows.withColumn("_at", F.explode(steps)).withColumn("_part", (F.col("_at") - F.col("frame")) / (F.col("_frame") - F.col("frame")))
    filled = filled.select("media_id", F.col("_at").alias("frame"), *[between(c, f"_{c}", F.col("_part")).alias(c) for c in "xywh"])
    kind = F.when(mandatory, "tracked").otherwise("interpolated")
    return track.select("media_id", "frame", *"xywh", F.lit("detected").alias("kind")).union(filled.withColumn("kind", kind))


def six_digits(value: Column) -> Column:
    """``value`` to six digits, halves away from zero, decided on the double itself, where ``round`` decides on its shortest decimal form."""
    return F.round(value * 1e6) / 1e6 + F.lit(0.0)


def motion_windows(pairs: DataFrame, window: int = MOTION_WINDOW) -> DataFrame:
    """All windows of ``window`` frames up to each media's last pair: mean magnitude, coherence, scale and residual, and the circular mean of the direction (null below ``STATIC``).

    Windows without pairs are still. Magnitude, coherence and direction come rounded to six digits, as the classifier reads them.
    Pairs are summed in their order, as means of few decimals often end in a five, whose rounding depends on that order.
    """
    ends = pairs.groupBy("media_id").agg((F.max("start_frame") + 3).alias("_n"))  # a pair spans two frames behind its first
    spans = ends.withColumn("start_frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(window).cast("long"))))
    order = Window.partitionBy("media_id", "_window").orderBy("start_frame", "magnitude", "coherence", "scale", "residual", "direction")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.avg(c).over(so_far) for c in ("magnitude", "coherence", "scale", "residual")} | {"direction": F.atan2(F.sum(F.sin("direction")).over(so_far), F.sum(F.cos("direction")).over(so_far))}
    rows = pairs.withColumn("_window", F.floor(F.col("start_frame") / window) * window)
    means = rows.select("media_id", "_window", F.lead(F.lit(1)).over(order).alias("_more"), *[v.alias(c) for c, v in sums.items()]).where("_more is null").drop("_more").withColumnRenamed("_window", "start_frame")
    out = spans.join(means, ["media_id", "start_frame"], "left")
    known = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    direction = F.when(F.col("magnitude") >= STATIC, six_digits(F.col("direction")))
    return out.select("media_id", "start_frame", F.least(F.col("start_frame") + window, F.col("_n")).alias("end_frame"), six_digits(known("magnitude", 0.0)).alias("magnitude"), direction.alias("direction"), six_digits(known("coherence", 0.0)).alias("coherence"), known("scale", 1.0).alias("scale"), known("residual", 0.0).alias("residual"))


def camera_moves(windows: DataFrame) -> DataFrame:
    """kind and score (0 to 1) of each motion window: the first rule that holds."""
    m, c, s, e, a = (F.col(x) for x in ("magnitude", "coherence", "scale", "residual", "direction"))
    way = F.when(F.abs(F.cos(a)) >= F.abs(F.sin(a)), "pan").otherwise("tilt")
    steady = (c >= STEADY) & (m >= MOVING)
    rules = [
        ((m >= WHIP) & (c <= WHIP_COHERENCE), F.lit("whip"), m / WHIP * 0.7),
        (steady & (s >= PUSH), F.lit("push_in"), (s - 1) * 120 + 0.35),
        (steady & (s <= PULL), F.lit("pull_out"), (1 - s) * 120 + 0.35),
        (m < STATIC, F.lit("static"), 1 - m / STATIC),
        (a.isNotNull() & (c >= DIRECTED) & (m >= MOVING), way, m / WHIP + c * 0.2),
        ((m >= HANDHELD) & (c <= HANDHELD_COHERENCE) & (e >= HANDHELD_RESIDUAL), F.lit("handheld"), (1 - c) * 0.8 + e * 40),
        (steady & a.isNotNull(), way, m / WHIP + 0.15),
        (m >= HANDHELD, F.lit("handheld"), m / WHIP),
    ]
    kind = score = None
    for holds, name, value in rules:
        kind = F.when(holds, name) if kind is None else kind.when(holds, name)
        score = F.when(holds, value) if score is None else score.when(holds, value)
    return windows.withColumn("kind", kind.otherwise("static")).withColumn("score", F.least(F.lit(1.0), score.otherwise(0.5)))


def camera_runs(moves: DataFrame) -> DataFrame:
    """Neighbouring windows of one kind that touch become one move, with the mean magnitude and score."""
    w = Window.partitionBy("media_id").orderBy("start_frame")
    fresh = F.coalesce((F.lag("kind").over(w) != F.col("kind")) | (F.lag("end_frame").over(w) != F.col("start_frame")), F.lit(True))
    rows = moves.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(w))
    out = rows.groupBy("media_id", "_run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.first("kind").alias("kind"), F.avg("magnitude").alias("magnitude"), F.least(F.greatest(F.avg("score"), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.drop("_run")


def average_hash(patch: Column) -> Column:
    """Bits (0/1) of the pixels at or above the patch's mean."""
    mean = F.aggregate(patch, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(patch)
    return F.transform(patch, lambda x: (x >= mean).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def laplacian_variance(patch: Column, side: int = 8) -> Column:
    """Variance of the four-neighbour Laplacian with mirrored borders (the edge pixel not repeated)."""

    def at(r: int, c: int) -> Column:
        r, c = (abs(r) if r < side else 2 * side - 2 - r), (abs(c) if c < side else 2 * side - 2 - c)
        return patch[r * side + c]

    cells = F.array(*[at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c) for r in range(side) for c in range(side)])
    n = side * side
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)
    square = F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return square / n - (total / n) * (total / n)


def share(patch: Column, holds) -> Column:
    """Share of the patch's pixels for which ``holds`` is true."""
    return F.size(F.filter(patch, holds)) / F.size(patch)


def sharpest(frames: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The frame of the greatest score of each group; the lowest on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "frame_index")
    return frames.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def quality_flags(sharpness: Column, shake: Column, blown: Column, crushed: Column, duplicate_of: Column, soft: float = 120.0) -> Column:
    """Flags that apply, in a fixed order, joined by commas."""
    return F.concat_ws(",", F.when(sharpness < soft, "soft_focus"), F.when(shake >= SHAKE, "severe_shake"), F.when(blown >= BLOWN, "blown_highlights"), F.when(crushed >= CRUSHED, "crushed_shadows"), F.when(duplicate_of.isNotNull(), "near_duplicate"))


def nms(boxes: DataFrame, least: float = NMS_IOU, most: int | None = NMS_MOST) -> DataFrame:
    """Greedy suppression in each frame, by score, then by index, both descending; at most ``most`` boxes are kept, as the detector defines (None: all). Groups are single frames.

    Intersections are compared with ``least`` times the union, as a quotient would be rounded once more.
    """

    def keep(rows: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for r in rows:
            if len(kept) == most:
                break
            if not any(beyond(k, r) for k in kept):
                kept.append(r)
        return [(r["media_id"], r["frame"], r["det"], r["score"]) for r in kept]

    def beyond(a: dict, b: dict) -> bool:
        wide = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
        high = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
        both = max(wide, 0.0) * max(high, 0.0)
        union = a["w"] * a["h"] + b["w"] * b["h"] - both
        return union > 0 and both > least * union

    ranked = boxes.select("media_id", "frame", "det", "score", "x", "y", "w", "h", (-F.col("score")).alias("_s"), (-F.col("det")).alias("_d"))
    return by_group(ranked, ["media_id", "frame"], ["_s", "_d"], keep, "media_id long, frame long, det int, score double")


def ema(series: DataFrame, value: str, weight: float = EMA_WEIGHT) -> DataFrame:
    """Exponential smoothing of each shot's series: the first value, then weight * smoothed + (1 - weight) * new; it begins anew in every shot."""

    def step(state: dict, row: dict) -> list[tuple]:
        new = row[value]
        state["now"] = new if state["now"] is None else weight * state["now"] + (1 - weight) * new
        return [(row["media_id"], row["shot_index"], row["sample_index"], state["now"])]

    return fold(series.select("media_id", "shot_index", "sample_index", value), ["media_id", "shot_index"], ["sample_index"], lambda row: {"now": None}, step, "media_id long, shot_index long, sample_index long, smoothed double")
