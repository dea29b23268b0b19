"""Relative depth maps: normalised, encoded samples and the checks before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a step between neighbours that counts as an edge, widest aspect, and the sides of a map and of its input.
EDGE, MAX_ASPECT, MAP_SIDE, FAR, NEAR = 0.15, 8, 512, 0, 65535


def percentile_of(ranked: Column, q: float) -> Column:
    """Linearly interpolated percentile of a sorted array."""
    place = (F.size(ranked) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a = F.element_at(ranked, low + 1)
    b = F.element_at(ranked, F.least(low + 2, F.size(ranked)))
    return a + (b - a) * (place - low)


def encode(maps: DataFrame, raw: Column, width: int) -> DataFrame:
    """verdict, low, high, samples (0 far to 65535 near) and edge_fraction of each map (array<double>, row by row); a constant or non-finite map is rejected.

    Everything is an expression over the map's own array: no shuffle.
    """
    bad = F.exists(raw, lambda v: F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))) | (F.size(raw) == 0)
    out = maps.withColumn("_ranked", F.sort_array(raw)).withColumn("low", percentile_of(F.col("_ranked"), 0.01)).withColumn("high", percentile_of(F.col("_ranked"), 0.99))
    flat = F.col("high") - F.col("low") <= F.greatest(F.lit(1e-6), F.abs("high") * 1e-6)
    out = out.withColumn("verdict", F.when(bad, "DEPTH_INVALID_VALUES").when(flat, "DEPTH_DEGENERATE").otherwise("ok"))
    scaled = F.transform(raw, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col("low")) / (F.col("high") - F.col("low")))))
    out = out.withColumn("_z", F.when(F.col("verdict") == "ok", scaled))
    z, n = F.col("_z"), F.size("_z")
    height = (n / width).cast("int")
    right = F.filter(F.sequence(F.lit(0), n - 2), lambda i: ((i + 1) % width != 0) & (F.abs(z[i + 1] - z[i]) > EDGE))
    down = F.filter(F.sequence(F.lit(0), F.greatest(n - width - 1, F.lit(0))), lambda i: (i + width < n) & (F.abs(F.get(z, i + width) - z[i]) > EDGE))
    edges = (F.size(right) + F.size(down)) / F.greatest(F.lit(1), (width - 1) * height + (height - 1) * width)
    return out.withColumn("samples", F.transform(z, lambda v: F.bround(F.round(v * NEAR, 6)).cast("int"))).withColumn("edge_fraction", F.when(z.isNotNull(), edges)).drop("_ranked", "_z")


def suitability(width: Column, height: Column, channels: list[tuple[Column, Column]]) -> Column:
    """Verdict of an image before it is measured: ``channels`` are each channel's least and greatest value."""
    constant = None
    for low, high in channels:
        constant = low == high if constant is None else constant & (low == high)
    return F.when(F.greatest(width, height) / F.least(width, height) > MAX_ASPECT, "DEPTH_ASPECT_UNSUPPORTED").when(constant, "DEPTH_NO_IMAGE_VARIATION").otherwise("ok")


def map_size(width: Column, height: Column, side: int = MAP_SIDE) -> tuple[Column, Column]:
    """Size of the encoded map of an image: at most ``side``, never enlarged, halves to even."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.bround(x * scale).cast("int")) for x in (width, height))


def payload_fault(payload: Column) -> Column:
    """First fault of a cached map (struct width, height, samples, sha256, near, far, low, high), or null.

    The digest is that of the samples as little-endian 16-bit words.
    """
    word = lambda v: F.concat(F.substring(F.lpad(F.hex(v.cast("long")), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(v.cast("long")), 4, "0"), 1, 2))
    digest = F.sha2(F.unhex(F.array_join(F.transform(payload["samples"], word), "")), 256)
    n = F.size(payload["samples"])
    return (
        F.when(payload["width"].isNull() | payload["height"].isNull() | (payload["width"] < 1) | (payload["height"] < 1), "DIMENSIONS")
        .when(payload["samples"].isNull() | (n != payload["width"] * payload["height"]), "LENGTH")
        .when((payload["near"] != NEAR) | (payload["far"] != FAR), "ENCODING")
        .when(~(payload["high"] > payload["low"]) | F.isnan(payload["low"]) | F.isnan(payload["high"]), "RANGE")
        .when((F.array_min(payload["samples"]) != FAR) | (F.array_max(payload["samples"]) != NEAR), "EXTREMES")
        .when(F.lower(payload["sha256"]) != digest, "CHECKSUM")
    )
