"""Rational rates and times; integers until the last division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_float(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return numerator / F.nullif(denominator, F.lit(0))


def seconds(frames: Column, numerator: Column, denominator: Column) -> Column:
    """Duration, or presentation time, of a number of frames; null at a rate of 0."""
    return frames * denominator / F.nullif(numerator, F.lit(0))


def sample_seconds(samples: Column, rate: Column) -> Column:
    return F.when(samples > 0, samples / rate).otherwise(F.lit(0.0))


def shot_times(shots: DataFrame) -> DataFrame:
    """Times of half-open shots at the rate num / den, and whether a shot meets the next one."""
    at = lambda c: seconds(c, F.col("num"), F.col("den"))
    following = F.lead("start_frame").over(Window.partitionBy("media_id").orderBy("shot_index"))
    return shots.select("media_id", "shot_index", at(F.col("start_frame")).alias("start_sec"), at(F.col("end_frame")).alias("end_sec"), at(F.col("end_frame") - F.col("start_frame")).alias("duration_sec"), F.coalesce(following == F.col("end_frame"), F.lit(False)).alias("meets_next"))
