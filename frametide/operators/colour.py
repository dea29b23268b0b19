"""Colour temperature and the comparison of measured maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: BT.709 linear RGB to XYZ (the second row weighs luma), the gates of the estimate, the least spread of channels.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
MIN_SATURATION, MIN_LUMA, MAX_LUMA, MIN_SPREAD = 0.08, 0.05, 0.95, 0.02
MIN_KELVIN, MAX_KELVIN = 1000, 25000


def linear(v: Column) -> Column:
    """sRGB 0..255 to linear light 0..1."""
    s = v / 255
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def temperature(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Kelvin (McCamy's cubic over the mean chromaticity) of each group of pixels r, g, b; null where the colour says too little."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0))
    m = pixels.groupBy(*keys).agg(*[F.avg(linear(F.col(c))).alias(f"_{c}") for c in "rgb"], F.avg(saturation).alias("_s"))
    x, y, z = (sum((F.col(f"_{c}") * w for c, w in zip("rgb", row, strict=True)), F.lit(0.0)) for row in TO_XYZ)
    m = m.withColumn("_x", F.try_divide(x, x + y + z)).withColumn("_y", F.try_divide(y, x + y + z)).withColumn("_luma", y)
    n = (F.col("_x") - 0.3320) / (0.1858 - F.col("_y") + 1e-9)
    kelvin = F.bround(449.0 * n * n * n + 3525.0 * n * n + 6813.5 * n + 5527.0).cast("long")
    fit = (F.round("_s", 6) >= MIN_SATURATION) & F.round("_luma", 6).between(MIN_LUMA, MAX_LUMA) & (F.round(F.greatest("_r", "_g", "_b") - F.least("_r", "_g", "_b"), 6) >= MIN_SPREAD) & (F.col("_y") > 1e-6)
    return m.select(*keys, F.when(fit & kelvin.between(MIN_KELVIN, MAX_KELVIN), kelvin).alias("kelvin"))


def largest_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest absolute difference of the values that two maps have under equal keys; null if they share none."""
    both = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys)
    return both.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs"), F.count("*").alias("n"))


def palette(pixels: DataFrame, keys: list[str], least: float = 0.02, most: int = 5) -> DataFrame:
    """The most frequent colours of each group, quantised to five bits: hex of the bin's centre and its share (four digits), by count, then colour."""
    level = lambda c: F.floor(F.col(c) / 8).cast("int").alias(c)
    counts = pixels.groupBy(*keys, level("r"), level("g"), level("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    rows = counts.withColumn("_share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "r", "g", "b")).cast("long"))
    centre = lambda c: F.least(F.lit(255), F.col(c) * 8 + 4)
    return rows.where((F.col("_share") >= least) & (F.col("rank") <= most)).select(*keys, "rank", F.format_string("#%02x%02x%02x", centre("r"), centre("g"), centre("b")).alias("hex"), F.round("_share", 4).alias("fraction"))
