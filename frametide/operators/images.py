"""Images as pixel arrays in reading order: exposure, clipping, signatures, filters, mattes, saliency and detector geometry.

Measures over one image are expressions over its own arrays; kernels that need a stencil run in one Arrow pass, row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from frametide.operators.colour import TO_XYZ, linear
from frametide.operators.depth import percentile_of

#: Gamma-space luma, its clip levels, grey clip levels, cut test, guided filter, saliency.
LUMA, BLOWN_LUMA, CRUSHED_LUMA, DARK, BRIGHT = (0.2126, 0.7152, 0.0722), 0.985, 0.015, 5, 250
CUT, SAME, HISTOGRAM_CUT, HISTOGRAM_BINS = 0.22, 0.08, 0.6, 32
GUIDED_RADIUS, GUIDED_EPS = 8, 1e-3
SALIENT, SALIENT_PART, SALIENT_AREA, SALIENT_MOST = 3.0, 0.45, 0.001, 8


def average(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def part(a: Column, holds: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, holds)) / F.size(a)


# ---------------------------------------------------------------- measures of one image


def linear_luma(r: Column, g: Column, b: Column) -> Column:
    """array<double> of BT.709 luma on linear light, of three channel arrays."""
    weights = TO_XYZ[1]
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: linear(p["r"]) * weights[0] + linear(p["g"]) * weights[1] + linear(p["b"]) * weights[2])


def exposure(images: DataFrame) -> DataFrame:
    """mean_luma, luma_std, luma_p05, luma_p50, luma_p95 (linear light) and mean_r, mean_g, mean_b (sRGB, 0 to 1) of images with channels r, g, b."""
    rows = images.withColumn("_y", linear_luma(F.col("r"), F.col("g"), F.col("b"))).withColumn("mean_luma", average(F.col("_y"))).withColumn("_s", F.sort_array("_y"))
    spread = F.sqrt(F.aggregate("_y", F.lit(0.0), lambda s, y: s + (y - F.col("mean_luma")) ** 2) / F.size("_y"))
    rows = rows.withColumn("luma_std", spread).withColumns({f"luma_p{q:02d}": percentile_of(F.col("_s"), q / 100) for q in (5, 50, 95)})
    return rows.withColumns({f"mean_{c}": average(F.col(c)) / 255 for c in "rgb"}).drop("_y", "_s")


def clip_shares(images: DataFrame) -> DataFrame:
    """blown and crushed: shares of the pixels whose gamma-space luma is at the ends of its range."""
    rows = images.withColumn("_y", F.transform(F.arrays_zip("r", "g", "b"), lambda p: (p["r"] * LUMA[0] + p["g"] * LUMA[1] + p["b"] * LUMA[2]) / 255))
    return rows.withColumn("blown", part(F.col("_y"), lambda y: y >= BLOWN_LUMA)).withColumn("crushed", part(F.col("_y"), lambda y: y <= CRUSHED_LUMA)).drop("_y")


def grey_quality(grey: Column) -> tuple[Column, Column]:
    """Shares of dark and of bright pixels (0..255, bounds included)."""
    return part(grey, lambda v: v <= DARK), part(grey, lambda v: v >= BRIGHT)


def signature(images: DataFrame) -> DataFrame:
    """bits (at or above the mean grey), luma and mean r, g, b (0 to 1): what near-duplicate shots are compared by. ``grey`` has been reduced to 8 x 8."""
    rows = images.withColumn("_m", average(F.col("grey")))
    return rows.withColumn("bits", F.transform("grey", lambda v: (v >= F.col("_m")).cast("int"))).withColumn("luma", F.col("_m") / 255).withColumns({f"mean_{c}": average(F.col(c)) / 255 for c in "rgb"}).drop("_m")


def appearance_cut(previous: Column, current: Column) -> Column:
    """Whether two grey images of one size look like a hard cut: a large mean difference, or a middling one with unlike histograms (Bhattacharyya)."""
    difference = F.aggregate(F.zip_with(previous, current, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(current) / 255
    difference = F.round(difference, 9)
    bins = F.sequence(F.lit(0), F.lit(HISTOGRAM_BINS - 1))
    counts = lambda a: F.transform(bins, lambda k: F.size(F.filter(a, lambda v: F.floor(v * HISTOGRAM_BINS / 256) == k)).cast("double"))
    shared = F.aggregate(F.zip_with(counts(previous), counts(current), lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, x: s + x)
    distance = F.sqrt(F.greatest(F.lit(0.0), 1 - shared / F.sqrt(F.size(previous).cast("double") * F.size(current))))
    return F.when(difference > CUT, True).when(difference <= SAME, False).otherwise(F.round(distance, 9) > HISTOGRAM_CUT)


# ---------------------------------------------------------------- stencil kernels


def per_row(df: DataFrame, kernel: Callable[..., tuple], inputs: list[str], schema: str) -> DataFrame:
    """``kernel(*numpy arrays of the inputs)`` for each row: its results, under ``schema``, beside the other columns."""
    added = StructType.fromDDL(schema)
    kind = StructType([f for f in df.schema if f.name not in inputs] + added.fields)
    arrow, kept = to_arrow_schema(kind), [c for c in df.columns if c not in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            out = [kernel(*[np.array(c[i].as_py()) for c in columns]) for i in range(batch.num_rows)]
            made = [pa.array([o[k] for o in out], arrow.field(len(kept) + k).type) for k in range(len(added))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + made, schema=arrow)

    return df.mapInArrow(run, kind)


def box_mean(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the (2 * radius + 1)-square around each pixel; borders are mirrored without the edge pixel."""
    out = a.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        period = max(1, 2 * n - 2)
        at = np.abs(np.arange(-radius, n + radius)) % period
        at = np.where(at >= n, period - at, at)
        padded = np.take(out, at, axis=axis)
        sums = np.cumsum(np.insert(padded, 0, 0, axis=axis), axis=axis)
        width = 2 * radius + 1
        out = (np.take(sums, np.arange(width, width + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)) / width
    return out


def box_filter(images: DataFrame, column: str, width: int, radius: int) -> DataFrame:
    """``filtered``: the box mean of an array column of images ``width`` pixels wide."""
    return per_row(images, lambda a: (box_mean(a.reshape(-1, width), radius).ravel().tolist(),), [column], "filtered array<double>")


def guided_filter(images: DataFrame, width: int, radius: int = GUIDED_RADIUS, eps: float = GUIDED_EPS) -> DataFrame:
    """``refined`` (0..255): the matte ``alpha`` filtered under the guidance of the image's grey (r, g, b, 0..255)."""

    def kernel(alpha: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple:
        guide = ((0.299 * r + 0.587 * g + 0.114 * b) / 255).reshape(-1, width)
        matte = (alpha / 255).reshape(-1, width)
        mean_g, mean_m = box_mean(guide, radius), box_mean(matte, radius)
        slope = (box_mean(guide * matte, radius) - mean_g * mean_m) / (box_mean(guide * guide, radius) - mean_g * mean_g + eps)
        refined = box_mean(slope, radius) * guide + box_mean(mean_m - slope * mean_g, radius)
        return (np.clip(refined * 255, 0, 255).astype(int).ravel().tolist(),)

    return per_row(images, kernel, ["alpha", "r", "g", "b"], "refined array<int>")


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, edges repeated; shrinking by whole factors takes area means."""
    h, w = a.shape[:2]
    if (h, w) == (height, width):
        return a.astype(float)
    if h % height == 0 and w % width == 0:
        return a.reshape(height, h // height, width, w // width, *a.shape[2:]).mean(axis=(1, 3))
    out = a.astype(float)
    for axis, (n, m) in enumerate(((h, height), (w, width))):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(x).astype(int)
        hi, t = np.minimum(lo + 1, n - 1), x - lo
        t = t.reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        out = np.take(out, lo, axis=axis) * (1 - t) + np.take(out, hi, axis=axis) * t
    return out


def upsample_alpha(alpha: np.ndarray, image: np.ndarray) -> np.ndarray:
    """The matte at the image's size (0..255): where local foreground and background colours are known and differ, uncertain pixels take the share that explains their own colour."""
    height, width = image.shape[:2]
    prior = alpha / 255.0
    sure = np.clip((prior - 0.8) / 0.2, 0, 1), np.clip((0.2 - prior) / 0.2, 0, 1)
    up = resize(prior, height, width)
    if not sure[0].any() or not sure[1].any():
        return np.rint(up * 255).astype(int)
    source = image / 255.0
    low = resize(source, *alpha.shape)

    def anchor(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        support = box_mean(weight, 16)
        colour = np.stack([box_mean(low[..., c] * weight, 16) for c in range(3)], axis=-1) / np.maximum(support, 1e-6)[..., None]
        return resize(colour, height, width), resize(support, height, width)

    (fore, fore_support), (back, back_support) = anchor(sure[0]), anchor(sure[1])
    at = (up > 0.02) & (up < 0.98) & (fore_support > 0.01) & (back_support > 0.01)
    delta = fore[at] - back[at]
    contrast = (delta**2).sum(axis=1)
    share = np.clip(((source[at] - back[at]) * delta).sum(axis=1) / np.maximum(contrast, 1e-6), 0, 1)
    residual = ((source[at] - back[at] - share[:, None] * delta) ** 2).sum(axis=1)
    strength = np.clip((contrast - 0.0004) / 0.0021, 0, 1) * ((contrast > 0.0004) & (residual < np.maximum(0.001, contrast * 0.1)))
    up[at] += strength * (share - up[at])
    return np.rint(np.clip(up, 0, 1) * 255).astype(int)


def upsample_mattes(images: DataFrame, low_width: int, width: int) -> DataFrame:
    """``matte``: ``alpha`` (``low_width`` wide) at the size of the image r, g, b (``width`` wide)."""
    return per_row(images, lambda alpha, r, g, b: (upsample_alpha(alpha.reshape(-1, low_width), np.stack([r, g, b], axis=-1).reshape(-1, width, 3)).ravel().tolist(),), ["alpha", "r", "g", "b"], "matte array<int>")


def regions_of(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the regions of a mask, neighbours over corners included, in reading order of their first pixels; 0 outside."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(np.where(label > 0, label, h * w + 1), 1, constant_values=h * w + 1)
        least = np.min([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, least, 0)
        # A region's least pixel number spreads; following it twice halves the number of rounds.
        jump = np.concatenate([[0], new.ravel()])
        new = np.where(mask, np.minimum(new, jump[new]), 0)
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1].reshape(h, w) + (0 if (label == 0).any() else 1)


def salient_regions(maps: DataFrame, width: int, most: int = SALIENT_MOST) -> DataFrame:
    """``regions`` of contrast maps: box and weighted centre (0 to 1), score (mean over peak) and mass, by mass, at most ``most``; none in a map without contrast."""

    def kernel(contrast: np.ndarray) -> tuple:
        grid = contrast.reshape(-1, width).astype(float)
        h, peak = len(grid), float(grid.max())
        if peak <= SALIENT:
            return ([],)
        labels, found = regions_of(grid >= max(SALIENT, peak * SALIENT_PART)), []
        for k in range(1, labels.max() + 1):
            ys, xs = np.nonzero(labels == k)
            if len(ys) < max(2, h * width * SALIENT_AREA):
                continue
            v = grid[ys, xs]
            found.append({"x": xs.min() / width, "y": ys.min() / h, "w": (xs.max() - xs.min() + 1) / width, "h": (ys.max() - ys.min() + 1) / h, "px": float(((xs + 0.5) * v).sum() / v.sum() / width), "py": float(((ys + 0.5) * v).sum() / v.sum() / h), "score": float(v.mean() / peak), "mass": float(v.sum())})
        return (sorted(found, key=lambda r: -r["mass"])[:most],)

    return per_row(maps, kernel, ["contrast"], "regions array<struct<x:double,y:double,w:double,h:double,px:double,py:double,score:double,mass:double>>")


def focus_candidates(regions: Column) -> Column:
    """Salient regions as candidates for the focus: centre, box and the index of the region that is the evidence."""
    return F.transform(regions, lambda r, i: F.struct(r["px"].alias("px"), r["py"].alias("py"), F.struct(r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")).alias("box"), i.alias("region_index")))


# ---------------------------------------------------------------- geometry of detectors


def letterbox(width: Column, height: Column, side: int = 416) -> tuple[Column, Column, Column]:
    """Scale and truncated size of an image fitted into a square canvas, top left."""
    scale = F.least(F.lit(float(side)) / height, F.lit(float(side)) / width)
    return scale, F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")


def grid_cells(side: int = 416, strides: tuple[int, ...] = (8, 16, 32)) -> list[tuple[int, int, int, int]]:
    """(anchor, column, row, stride) of the detector's cells, in its order."""
    cells = [(x, y, s) for s in strides for y in range(side // s) for x in range(side // s)]
    return [(i, *c) for i, c in enumerate(cells)]


def decode_grid(raw: DataFrame, wanted: int, side: int = 416, strides: tuple[int, ...] = (8, 16, 32)) -> DataFrame:
    """x1, y1, x2, y2 and score of the cells whose best class is ``wanted``. ``raw``: (anchor, cx, cy, w, h, objectness, classes array)."""
    cells = F.broadcast(raw.sparkSession.createDataFrame(grid_cells(side, strides), "anchor long, column int, row int, stride int"))  # a few thousand cells
    best = F.array_max("classes")
    rows = raw.join(cells, "anchor").where(F.array_position("classes", best) == wanted + 1)
    cx, cy = (F.col("cx") + F.col("column")) * F.col("stride"), (F.col("cy") + F.col("row")) * F.col("stride")
    w, h = F.exp("w") * F.col("stride"), F.exp("h") * F.col("stride")
    return rows.select(*[c for c in raw.columns if c not in ("cx", "cy", "w", "h", "objectness", "classes")], (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"), (F.col("objectness") * best).alias("score"))


def unletterbox(boxes: DataFrame, scale: Column, width: Column, height: Column) -> DataFrame:
    """x, y, w, h (0 to 1 of the image) of corners in canvas pixels: scaled back and clipped to the image."""
    inside = lambda c, most: F.least(F.greatest(F.col(c) / scale, F.lit(0.0)), most)
    x1, x2, y1, y2 = inside("x1", width), inside("x2", width), inside("y1", height), inside("y2", height)
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return boxes.withColumns({"x": unit(x1 / width), "y": unit(y1 / height), "w": unit(F.greatest(F.lit(0.0), x2 - x1) / width), "h": unit(F.greatest(F.lit(0.0), y2 - y1) / height)}).drop("x1", "y1", "x2", "y2")


def valid_regions(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """x, y, w, h (0 to 1) of corners that are finite, ordered and inside the image; others are dropped, not repaired."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    finite = ~(F.isnan(x1) | F.isnan(y1) | F.isnan(x2) | F.isnan(y2))
    rows = boxes.where(finite & (x1 >= 0) & (x1 < x2) & (x2 <= width) & (y1 >= 0) & (y1 < y2) & (y2 <= height))
    return rows.withColumns({"x": x1 / width, "y": y1 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}).drop("x1", "y1", "x2", "y2")


def top_regions(boxes: DataFrame, keys: list[str], order: list[str], most: int = 64) -> DataFrame:
    """The ``most`` best-scored boxes of each group with their ids region-0, region-1 and so on; equal scores keep their ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *order)
    rows = boxes.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < most)
    return rows.withColumn("region", F.concat(F.lit("region-"), F.col("_r").cast("string"))).drop("_r")


def polygon_box(points: Column) -> dict[str, Column]:
    """The box around a polygon (array<struct<x, y>>), cut to the unit square."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    axis = lambda c: F.transform(points, lambda p: p[c])
    ends = {c: (unit(F.array_min(axis(c))), unit(F.array_max(axis(c)))) for c in "xy"}
    return {"x": ends["x"][0], "y": ends["y"][0], "w": ends["x"][1] - ends["x"][0], "h": ends["y"][1] - ends["y"][0]}


def ordered_quad(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left of four points: least and greatest sum, least and greatest difference of y and x; the first of equals."""

    def pick(of: Callable[[Column], Column], sign: int) -> Column:
        ranked = F.array_sort(F.transform(points, lambda p, i: F.struct(F.round(sign * of(p), 9).alias("v"), i.alias("i"), p.alias("p"))))
        return F.element_at(ranked, 1)["p"]

    add, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(add, 1), pick(diff, 1), pick(add, -1), pick(diff, -1))


def polygon_size(points: Column) -> tuple[Column, Column]:
    """Area (shoelace) and perimeter of a closed polygon."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    length = F.zip_with(points, following, lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.abs(total(cross)) / 2, total(length)


def unclip_distance(points: Column, ratio: float = 1.5) -> Column:
    """How far a text outline is offset: area * ratio / perimeter, 0 where there is no perimeter."""
    area, length = polygon_size(points)
    return F.when(length > 0, area * ratio / length).otherwise(F.lit(0.0))


def text_input_size(width: Column, height: Column, limit: int = 960) -> tuple[Column, Column]:
    """Input size of the text detector: the longer side at most ``limit``, both rounded (halves to even) to multiples of 32, 32 at least."""
    ratio = F.when(F.greatest(width, height) > limit, F.lit(float(limit)) / F.greatest(width, height)).otherwise(F.lit(1.0))
    return tuple(F.greatest(F.bround(x * ratio / 32) * 32, F.lit(32)).cast("int") for x in (width, height))


def matte_input_size(width: Column, height: Column, reference: int = 512, least: int = 32, most: int = 2048, aspect: float = 32.0) -> tuple[Column, Column, Column]:
    """Input width and height of the matting model, in steps of 32, and a fault where the aspect is beyond what it takes."""
    align = lambda v: F.greatest(v - v % 32, F.lit(least))
    scaled = (F.greatest(width, height) < reference) | (F.least(width, height) > reference)
    rh = F.when(scaled & (width >= height), reference).when(scaled, F.floor(height / width * reference)).otherwise(height).cast("int")
    rw = F.when(scaled & (width >= height), F.floor(width / height * reference)).when(scaled, reference).otherwise(width).cast("int")
    rw, rh = align(rw), align(rh)
    over = F.greatest(rw / most, rh / most, F.lit(1.0))
    rw, rh = (F.when(over > 1, align(F.floor(v / over).cast("int"))).otherwise(v) for v in (rw, rh))
    return rw, rh, F.when(F.greatest(rw / rh, rh / rw) > aspect, "INVALID_REQUEST")


def measure_size(width: Column, height: Column, analysis_width: Column, analysis_height: Column) -> tuple[Column, Column, Column]:
    """Width and height that features are measured at, and a fault: both or neither must be given, positive, and a uniform scale."""
    neither = analysis_width.isNull() & analysis_height.isNull()
    fault = F.when(~neither & (analysis_width.isNull() | analysis_height.isNull()), "one dimension").when((analysis_width <= 0) | (analysis_height <= 0), "not positive").when(F.abs(analysis_width / width - analysis_height / height) > 1e-6, "not uniform")
    return F.when(fault.isNull(), F.coalesce(analysis_width, width)), F.when(fault.isNull(), F.coalesce(analysis_height, height)), fault


# ---------------------------------------------------------------- motion points


def consistent_points(points: DataFrame, most: float = 3.0) -> DataFrame:
    """Points tracked forward and back to within ``most`` pixels of where they began. ``points``: (x, y, bx, by, found, found_back)."""
    return points.where((F.col("found") == 1) & (F.col("found_back") == 1) & (F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= most))


def affine_motion(width: Column, height: Column, a: dict[str, Column], still: float = 0.0018) -> dict[str, Column]:
    """tx, ty (of the frame), scale, rotation, magnitude and direction (null when still) of an affine map: a00, a01, a02, a10, a11, a12."""
    tx, ty = a["a02"] / F.greatest(width, F.lit(1)), a["a12"] / F.greatest(height, F.lit(1))
    scale = F.sqrt(a["a00"] ** 2 + a["a01"] ** 2)
    magnitude = F.sqrt(tx * tx + ty * ty) + F.abs(scale - 1)
    return {"tx": tx, "ty": ty, "scale": scale, "rotation": F.atan2(a["a10"], a["a00"]), "magnitude": magnitude, "direction": F.when(magnitude >= still, F.atan2(ty, tx))}


def affine_residual(points: DataFrame, keys: list[str], width: Column, height: Column, a: dict[str, Column]) -> DataFrame:
    """Root mean square distance of the mapped points from their targets (u, v), over all points, as a part of the longer side."""
    x, y = F.col("x"), F.col("y")
    dx, dy = F.col("u") - (a["a00"] * x + a["a01"] * y + a["a02"]), F.col("v") - (a["a10"] * x + a["a11"] * y + a["a12"])
    return points.withColumn("_d", dx * dx + dy * dy).withColumn("_m", F.greatest(width, height)).groupBy(*keys).agg((F.sqrt(F.avg("_d")) / F.max("_m")).alias("residual"))


def outside_boxes(points: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Points inside the safe border (a twelfth, 4 pixels at least) and outside every padded box of their frame. ``points``: (media_id, frame, px, py), ``boxes``: x, y, w, h of 0 to 1."""
    mx, my, pad_x, pad_y = max(4, width // 12), max(4, height // 12), max(2, width // 40), max(2, height // 40)
    inner = points.where((F.col("px") >= mx) & (F.col("px") < width - mx) & (F.col("py") >= my) & (F.col("py") < height - my))
    b = boxes.select(
        "media_id", "frame", (F.floor(F.col("x") * width) - pad_x).alias("x0"), (F.floor(F.col("y") * height) - pad_y).alias("y0"), (F.floor((F.col("x") + F.col("w")) * width) + pad_x).alias("x1"), (F.floor((F.col("y") + F.col("h")) * height) + pad_y).alias("y1")
    )
    p, q = inner.alias("p"), b.alias("b")
    hit = (F.col("p.media_id") == F.col("b.media_id")) & (F.col("p.frame") == F.col("b.frame")) & (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1"))
    return p.join(q, hit, "left_anti")


def warp(values: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """``values`` read at each pixel's place plus its displacement: bilinear, edges repeated."""
    h, w = values.shape
    x = np.clip(np.arange(w)[None, :] + dx, 0, w - 1)
    y = np.clip(np.arange(h)[:, None] + dy, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = x - x0, y - y0
    return (values[y0, x0] * (1 - tx) + values[y0, x1] * tx) * (1 - ty) + (values[y1, x0] * (1 - tx) + values[y1, x1] * tx) * ty


def warp_mattes(images: DataFrame, width: int, flow_width: int) -> DataFrame:
    """``aligned``: the matte ``alpha`` of the frame before (``width`` wide) moved by a backward flow (``dx``, ``dy``, ``flow_width`` wide, in pixels of its own size)."""

    def kernel(alpha: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> tuple:
        matte = alpha.reshape(-1, width).astype(float)
        height = len(matte)
        flow = [resize(f.reshape(-1, flow_width).astype(float), height, width) for f in (dx, dy)]
        scale = width / flow_width, height / (len(dx) // flow_width)
        return (np.rint(warp(matte, flow[0] * scale[0], flow[1] * scale[1])).astype(int).ravel().tolist(),)

    return per_row(images, kernel, ["alpha", "dx", "dy"], "aligned array<int>")


def reduced(images: DataFrame, column: str, width: int, to_height: int, to_width: int) -> DataFrame:
    """``reduced``: an array column of images ``width`` pixels wide at a smaller size (area means where the factor is whole)."""
    return per_row(images, lambda a: (resize(a.reshape(-1, width).astype(float), to_height, to_width).ravel().tolist(),), [column], "reduced array<double>")
