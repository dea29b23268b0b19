"""Column helpers for boxes (x, y, width, height), normalised to 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 where the union is empty."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def clip(low: Column, size: Column) -> tuple[Column, Column]:
    """A span cut to 0..1: its new start and size."""
    start = F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))
    end = F.least(F.greatest(low + size, F.lit(0.0)), F.lit(1.0))
    return start, end - start


def contained(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of ``a`` that lies in ``b``; null for a box without an area."""
    wide = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    high = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    return F.try_divide(wide * high, a["w"] * a["h"])


def map_box(value: Column, analysis_width: Column, analysis_height: Column, width: Column, height: Column) -> Column:
    """A normalised coordinate of the analysed frame in the canonical frame: the same if the one is a uniform scale of the other, else null."""
    positive = (F.least(analysis_width, analysis_height, width, height)) > 0
    return F.when(positive & (F.abs(analysis_width / width - analysis_height / height) <= 1e-6), value)
