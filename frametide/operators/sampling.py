"""Which frames, pairs and pixels are measured: functions of a range, a rate and a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gap of subject and face samples in milliseconds, representatives of a shot, samples of a middle third, stride of motion pairs, pixels of a decimated frame.
GAP_MS, REPRESENTATIVES, THIRD_SAMPLES, PAIR_STRIDE, MAX_PIXELS = 200, 5, 7, 2, 65536


def gap_frames(numerator: Column, denominator: Column, milliseconds: int = GAP_MS) -> Column:
    """Frames in ``milliseconds`` at a rational rate, halves to even, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.bround(milliseconds * numerator / (1000 * denominator)).cast("long"))


def _range(start: Column, end: Column) -> Column:
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<long>"))


def periodic(start: Column, end: Column, gap: Column) -> Column:
    """Every ``gap``-th frame of the half-open range, and its last."""
    every = F.concat(F.sequence(start, end - 1, gap), F.array(end - 1))
    return F.when(end > start, F.array_distinct(every)).otherwise(F.array().cast("array<long>"))


def even_frames(start: Column, end: Column, most: int) -> Column:
    """All frames of a range of up to ``most``, else that many evenly spaced ones with both ends; halves to even."""
    n = end - start
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: start + F.bround((n - 1) / F.lit(float(most - 1)) * i).cast("long"))
    return F.when(n <= most, _range(start, end)).otherwise(F.array_sort(F.array_distinct(spaced)))


def middle_third(start: Column, end: Column) -> tuple[Column, Column]:
    """Half-open middle third of a range; of one or two frames all, of none none."""
    n = end - start
    low = start + F.floor(n / 3)
    high = F.least(F.greatest(start + F.floor((2 * n + 2) / 3), low + 1), end)
    return F.when(n <= 2, start).otherwise(low), F.when(n <= 0, start).when(n <= 2, end).otherwise(high)


def text_frames_by_time(frame_count: Column, numerator: Column, denominator: Column, milliseconds: int = 1000) -> Column:
    """Without shots: a frame at every cadence, and the last."""
    return periodic(F.lit(0).cast("long"), frame_count, gap_frames(numerator, denominator, milliseconds))


def motion_pairs(frame_count: Column, stride: int = PAIR_STRIDE) -> Column:
    """array<struct<first, second>> of the frames compared for motion; a media of one frame has none."""
    last = frame_count - 1
    starts = F.sequence(F.lit(0).cast("long"), last - 1, F.lit(stride).cast("long"))
    pairs = F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + stride, last).alias("second")))
    return F.when(last > 0, pairs)


def decodable_pairs(media: DataFrame, frames: DataFrame) -> DataFrame:
    """(media_id, first, second, decoded): pairs both of whose frames are there; a media none of whose pairs are is left with one row of nulls and decoded false.

    All joins are merged: runs of numbers shrink so far in a shuffle that Spark would take millions of rows for small enough to broadcast from the driver.
    """
    wanted = media.select("media_id", F.explode("pairs").alias("p")).select("media_id", "p.*")
    have = frames.select("media_id", "frame").distinct()
    one = wanted.join(have.withColumnRenamed("frame", "first").hint("merge"), ["media_id", "first"], "left_semi")
    two = one.join(have.withColumnRenamed("frame", "second").hint("merge"), ["media_id", "second"], "left_semi").select("media_id", "first", "second")
    return media.select("media_id").join(two.hint("merge"), "media_id", "left").withColumn("decoded", F.col("first").isNotNull())


def stride(width: Column, height: Column, most: int = MAX_PIXELS) -> Column:
    """Step of both axes that leaves at most about ``most`` pixels."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(width * height / F.lit(float(most)))).cast("int"))


def decimate(pixels: DataFrame, step: Column, width: int) -> DataFrame:
    """Every ``step``-th pixel of every ``step``-th row; ``i`` counts pixels in reading order."""
    return pixels.where((F.floor(F.col("i") / width) % step == 0) & (F.col("i") % width % step == 0))


def stride_with_last(count: Column, step: int) -> Column:
    """0, step, 2 * step and the last index."""
    return periodic(F.lit(0).cast("long"), count, F.lit(step).cast("long"))
