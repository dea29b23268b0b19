"""Queries of the image operators, on the 8 x 8 frames made from embeddings and on boxes made from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from frametide.operators import depth, images, tracks
from frametide.plans.registry import query, r6
from frametide.sources import tables as t

_LIN = lambda c: f"CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END"


def _images(spark, d):
    p = F.col("patch")
    ahead = lambda k: F.transform(p, lambda v, i: F.coalesce(F.get(p, i + k), v))
    return t.patches(spark, d).select("media_id", "frame_index", p.alias("r"), ahead(1).alias("g"), ahead(2).alias("b"), p.alias("grey"))


@query(f"WITH {t.PIXELS}, y AS (SELECT *, 0.2126729 * {_LIN('r')} + 0.7151522 * {_LIN('g')} + 0.0721750 * {_LIN('b')} AS y FROM pixels) SELECT media_id, frame_index, round(avg(y), 6) AS mean_luma, round(stddev_pop(y), 6) AS luma_std, round(quantile_cont(y, 0.05), 6) AS luma_p05, round(quantile_cont(y, 0.5), 6) AS luma_p50, round(quantile_cont(y, 0.95), 6) AS luma_p95, round(avg(r) / 255, 6) AS mean_r, round(avg(g) / 255, 6) AS mean_g, round(avg(b) / 255, 6) AS mean_b FROM y GROUP BY ALL")
def image_exposure(spark, d):
    names = ["mean_luma", "luma_std", "luma_p05", "luma_p50", "luma_p95", "mean_r", "mean_g", "mean_b"]
    return r6(images.exposure(_images(spark, d)).select("media_id", "frame_index", *names), *names)


_WIDE = f"{t.PIXELS}, wide AS (SELECT media_id, frame_index, i, CASE WHEN r >= 150 THEN 255 WHEN r <= 100 THEN 0 ELSE r END AS r, CASE WHEN g >= 150 THEN 255 WHEN g <= 100 THEN 0 ELSE g END AS g, CASE WHEN b >= 150 THEN 255 WHEN b <= 100 THEN 0 ELSE b END AS b FROM pixels)"


def _wide(spark, d):
    hard = lambda c: F.transform(c, lambda v: F.when(v >= 150, 255).when(v <= 100, 0).otherwise(v)).alias(c)
    return _images(spark, d).select("media_id", "frame_index", hard("r"), hard("g"), hard("b"))


@query(f"WITH {_WIDE}, y AS (SELECT media_id, frame_index, round((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255, 9) AS y FROM wide) SELECT media_id, frame_index, round(avg((y >= 0.985)::INT), 6) AS blown, round(avg((y <= 0.015)::INT), 6) AS crushed FROM y GROUP BY ALL")
def luma_clip_fractions(spark, d):
    return r6(images.clip_shares(_wide(spark, d)).select("media_id", "frame_index", "blown", "crushed"), "blown", "crushed")


@query(f"WITH {_WIDE} SELECT media_id, frame_index, round(avg((r <= 5)::INT), 6) AS dark, round(avg((r >= 250)::INT), 6) AS bright FROM wide GROUP BY ALL")
def image_grey_quality(spark, d):
    dark, bright = images.grey_quality(F.col("r"))
    return r6(_wide(spark, d).select("media_id", "frame_index", dark.alias("dark"), bright.alias("bright")), "dark", "bright")


_SIGNATURE = f"{t.PIXELS}, m AS (SELECT media_id, frame_index, avg(r) AS m, avg(g) / 255 AS g, avg(b) / 255 AS b FROM pixels GROUP BY ALL), sg AS (SELECT p.media_id, p.frame_index, list((p.r >= m.m)::INT ORDER BY i) AS bits, any_value(m.m) / 255 AS luma, any_value(m.m) / 255 AS r, any_value(m.g) AS g, any_value(m.b) AS b FROM pixels p JOIN m ON m.media_id = p.media_id AND m.frame_index = p.frame_index GROUP BY ALL)"


@query(f"WITH {_SIGNATURE} SELECT media_id, frame_index, list_aggregate(bits, 'string_agg', '') AS bits, round(luma, 6) AS luma, round(r, 6) AS mean_r, round(g, 6) AS mean_g, round(b, 6) AS mean_b FROM sg")
def shot_signature(spark, d):
    rows = images.signature(_images(spark, d)).select("media_id", "frame_index", F.array_join(F.col("bits").cast("array<string>"), "").alias("bits"), "luma", "mean_r", "mean_g", "mean_b")
    return r6(rows, "luma", "mean_r", "mean_g", "mean_b")


#: Every fourth frame repeats the frame three before it but for a few flipped bits, so that there are copies to find.
_COPIED = f"{_SIGNATURE}, cp AS (SELECT media_id, frame_index, CASE WHEN frame_index % 4 = 3 THEN frame_index - 3 ELSE frame_index END AS source FROM sg), sh AS (SELECT cp.media_id, cp.frame_index AS shot_index, list_transform(range(0, 64), lambda i: CASE WHEN cp.source <> cp.frame_index AND (cp.frame_index * 7 + i) % 23 = 0 THEN 1 - sg.bits[i + 1] ELSE sg.bits[i + 1] END) AS bits, luma + (cp.frame_index - cp.source) * 0.001::DOUBLE AS luma, r, g + (cp.frame_index - cp.source) * 0.002::DOUBLE AS g, b FROM cp JOIN sg ON sg.media_id = cp.media_id AND sg.frame_index = cp.source)"


@query(f"WITH {_COPIED}, pr AS (SELECT b.media_id, b.shot_index, a.shot_index AS earlier, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: abs(z[1] - z[2]))) AS h, abs(a.luma - b.luma) AS l, sqrt(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) AS c FROM sh a JOIN sh b ON a.media_id = b.media_id AND a.shot_index < b.shot_index), s AS (SELECT *, ((1 - h / 64) + (1 - least(1, l / 0.08 + c / 0.12 / 2))) / 2 AS score FROM pr WHERE h <= 6 AND l <= 0.08 AND c <= 0.12), k AS (SELECT *, row_number() OVER (PARTITION BY media_id, shot_index ORDER BY round(score, 9) DESC, earlier) AS k FROM s) SELECT sh.media_id, sh.shot_index, earlier AS duplicate_of, round(score, 6) AS score FROM sh LEFT JOIN k ON k.media_id = sh.media_id AND k.shot_index = sh.shot_index AND k.k = 1")
def duplicate_shots(spark, d):
    return r6(tracks.earlier_copy(_copied(spark, d)), "score")


def _copied(spark, d):
    s = images.signature(_images(spark, d)).select("media_id", F.col("frame_index").alias("source"), "bits", "luma", F.col("mean_r").alias("r"), F.col("mean_g").alias("g"), F.col("mean_b").alias("b"))
    rows = t.patches(spark, d).select("media_id", F.col("frame_index").alias("shot_index")).withColumn("source", F.when(F.col("shot_index") % 4 == 3, F.col("shot_index") - 3).otherwise(F.col("shot_index")))
    gap = F.col("shot_index") - F.col("source")
    rows = rows.join(s, ["media_id", "source"]).withColumn("bits", F.transform("bits", lambda v, i: F.when((gap > 0) & ((F.col("shot_index") * 7 + i) % 23 == 0), 1 - v).otherwise(v)))
    return rows.withColumn("luma", F.col("luma") + gap * F.lit(0.001)).withColumn("g", F.col("g") + gap * F.lit(0.002)).drop("source")


@query(f"WITH {_COPIED} SELECT a.media_id, a.shot_index AS frame_a, b.shot_index AS frame_b, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: abs(z[1] - z[2])))::BIGINT AS distance FROM sh a JOIN sh b ON a.media_id = b.media_id AND a.shot_index < b.shot_index WHERE list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: abs(z[1] - z[2]))) <= 6")
def hamming_pairs(spark, d):
    return tracks.near_hashes(_copied(spark, d).select("media_id", F.col("shot_index").alias("frame_index"), "bits"), 6, 7)


@query(f"WITH {_WIDE}, w AS (SELECT media_id, frame_index, i, CASE WHEN frame_index % 3 = 0 THEN r ELSE 64 + r // 2 END AS v FROM wide), n AS (SELECT b.media_id, b.frame_index, avg(abs(b.v - a.v)) / 255 AS diff FROM w a JOIN w b ON a.media_id = b.media_id AND b.frame_index = a.frame_index + 1 AND a.i = b.i GROUP BY ALL), bins AS (SELECT media_id, frame_index, v * 32 // 256 AS bin, count(*) AS n FROM w GROUP BY ALL), h AS (SELECT b.media_id, b.frame_index, sum(sqrt(a.n * b.n)) AS shared FROM bins a JOIN bins b ON a.media_id = b.media_id AND b.frame_index = a.frame_index + 1 AND a.bin = b.bin GROUP BY ALL) SELECT media_id, frame_index, CASE WHEN round(diff, 9) > 0.22 THEN true WHEN round(diff, 9) <= 0.08 THEN false ELSE round(sqrt(greatest(0, 1 - coalesce(shared, 0) / 64)), 9) > 0.6 END AS cut FROM n LEFT JOIN h USING (media_id, frame_index)")
def appearance_cuts(spark, d):
    w = t.Window.partitionBy("media_id").orderBy("frame_index")
    rows = _wide(spark, d).select("media_id", "frame_index", F.transform("r", lambda v: F.when(F.col("frame_index") % 3 == 0, v).otherwise((64 + F.floor(v / 2)).cast("int"))).alias("v"))
    rows = rows.withColumn("before", F.lag("v").over(w)).where("before is not null")
    return rows.select("media_id", "frame_index", images.appearance_cut(F.col("before"), F.col("v")).alias("cut"))


_MIRROR = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"
_BOX = f"{t.PATCH}, off AS (SELECT unnest(range(-2, 3)) AS o), nb AS (SELECT r.o AS dr, c.o AS dc FROM off r, off c)"


@query(f"WITH {_BOX}, f AS (SELECT media_id, frame_index, i, avg(patch[({_MIRROR('i // 8 + dr')}) * 8 + ({_MIRROR('i % 8 + dc')}) + 1]) AS v FROM patches, (SELECT unnest(range(0, 64)) AS i), nb GROUP BY ALL) SELECT media_id, frame_index, i, round(v, 5) AS v FROM f")
def box_filtered(spark, d):
    rows = images.box_filter(t.patches(spark, d).select("media_id", "frame_index", F.col("patch").cast("array<double>").alias("patch")), "patch", 8, 2)
    return rows.select("media_id", "frame_index", F.posexplode("filtered").alias("i", "v")).withColumn("i", F.col("i").cast("long")).withColumn("v", F.round("v", 5))


@query(f"""WITH RECURSIVE {t.PATCH}, con AS (SELECT media_id, frame_index, i, patch[i + 1] % 60 + CASE WHEN frame_index % 7 = 0 THEN -60 ELSE 0 END AS c FROM patches, (SELECT unnest(range(0, 64)) AS i)),
pk AS (SELECT media_id, frame_index, max(c) AS peak FROM con GROUP BY ALL), m AS (SELECT con.media_id, con.frame_index, i, c, peak FROM con JOIN pk USING (media_id, frame_index) WHERE peak > 3 AND c >= greatest(3, peak * 0.45::DOUBLE)),
e AS (SELECT a.media_id, a.frame_index, a.i AS u, b.i AS v FROM m a JOIN m b ON a.media_id = b.media_id AND a.frame_index = b.frame_index AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1),
r AS (SELECT media_id, frame_index, i AS root, i AS v FROM m UNION SELECT r.media_id, r.frame_index, r.root, e.v FROM r JOIN e ON e.media_id = r.media_id AND e.frame_index = r.frame_index AND e.u = r.v),
lab AS (SELECT media_id, frame_index, v AS i, min(root) AS label FROM r GROUP BY ALL), reg AS (SELECT media_id, frame_index, label, min(i % 8) / 8 AS x, min(i // 8) / 8 AS y, (max(i % 8) - min(i % 8) + 1) / 8 AS w, (max(i // 8) - min(i // 8) + 1) / 8 AS h, sum((i % 8 + 0.5) * c) / sum(c) / 8 AS px, sum((i // 8 + 0.5) * c) / sum(c) / 8 AS py, avg(c) / any_value(peak) AS score, sum(c) AS mass, count(*) AS area FROM lab JOIN m USING (media_id, frame_index, i) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame_index ORDER BY mass DESC, label) AS k FROM reg WHERE area >= 2) SELECT media_id, frame_index, k - 1 AS region_index, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, round(px, 6) AS px, round(py, 6) AS py, round(score, 6) AS score, round(mass, 6) AS mass FROM k WHERE k <= 8""")
def saliency_regions(spark, d):
    rows = t.patches(spark, d).select("media_id", "frame_index", F.transform("patch", lambda v: (v % 60 + F.when(F.col("frame_index") % 7 == 0, -60).otherwise(0)).cast("double")).alias("contrast"))
    rows = images.salient_regions(rows, 8).select("media_id", "frame_index", F.posexplode("regions").alias("region_index", "r")).select("media_id", "frame_index", F.col("region_index").cast("long").alias("region_index"), "r.*")
    return r6(rows, "x", "y", "w", "h", "px", "py", "score", "mass")


@query("SELECT o_orderkey::BIGINT AS image, round(least(416.0 / h, 416.0 / w), 6) AS scale, floor(w * least(416.0::DOUBLE / h, 416.0::DOUBLE / w))::INT AS new_w, floor(h * least(416.0::DOUBLE / h, 416.0::DOUBLE / w))::INT AS new_h FROM (SELECT o_orderkey, (o_orderkey % 1900 + 20)::INT AS w, (o_custkey % 1000 + 20)::INT AS h FROM orders)")
def letterbox_sizes(spark, d):
    rows = t.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("image"), (F.col("o_orderkey") % 1900 + 20).cast("int").alias("w"), (F.col("o_custkey") % 1000 + 20).cast("int").alias("h"))
    scale, w, h = images.letterbox(F.col("w"), F.col("h"))
    return rows.select("image", F.round(scale, 6).alias("scale"), w.alias("new_w"), h.alias("new_h"))


@query("WITH raw AS (SELECT l_orderkey::BIGINT AS media_id, (l_partkey % 84)::BIGINT AS anchor, (l_suppkey % 10) / 10 AS cx, (l_linenumber % 10) / 10 AS cy, l_discount::DOUBLE AS w, l_tax::DOUBLE AS h, l_quantity::DOUBLE / 50 AS o, [(l_partkey % 7) / 10, (l_suppkey % 5) / 10, 0.25] AS cls, l_linenumber::BIGINT AS line FROM lineitem), c AS (SELECT *, CASE WHEN anchor < 64 THEN 8 WHEN anchor < 80 THEN 16 ELSE 32 END AS s, CASE WHEN anchor < 64 THEN anchor WHEN anchor < 80 THEN anchor - 64 ELSE anchor - 80 END AS k, list_max(cls) AS best FROM raw), q AS (SELECT *, (cx + k % (64 // s)) * s AS x, (cy + k // (64 // s)) * s AS y, exp(w) * s AS bw, exp(h) * s AS bh FROM c WHERE list_position(cls, best) = 1) SELECT media_id, line, anchor, round(least(greatest((x - bw / 2) / 0.5, 0), 128) / 128, 6) AS x, round(least(greatest((y - bh / 2) / 0.5, 0), 128) / 128, 6) AS y, round((least(greatest((x + bw / 2) / 0.5, 0), 128) - least(greatest((x - bw / 2) / 0.5, 0), 128)) / 128, 6) AS w, round((least(greatest((y + bh / 2) / 0.5, 0), 128) - least(greatest((y - bh / 2) / 0.5, 0), 128)) / 128, 6) AS h, round(o * best, 6) AS score FROM q")
def detector_grid_boxes(spark, d):
    num = lambda c: F.col(c).cast("double")
    raw = t.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("media_id"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_partkey") % 84).cast("long").alias("anchor"), (F.col("l_suppkey") % 10 / 10).alias("cx"), (F.col("l_linenumber") % 10 / 10).alias("cy"),
        num("l_discount").alias("w"), num("l_tax").alias("h"), (num("l_quantity") / 50).alias("objectness"), F.array(F.col("l_partkey") % 7 / 10, F.col("l_suppkey") % 5 / 10, F.lit(0.25).cast("double")).alias("classes"),
    )
    return r6(images.unletterbox(images.decode_grid(raw, 0, 64), F.lit(0.5), F.lit(128), F.lit(128)), "x", "y", "w", "h", "score")


_CORNERS = f"{t.BOXES}, corners AS (SELECT media_id, frame, det, score, CASE WHEN det % 9 = 4 THEN 'nan'::DOUBLE ELSE x * 100 - 5 END AS x1, y * 100 AS y1, (x + w) * 100 - 10 AS x2, (y + h) * 100 AS y2 FROM boxes)"


def _corners(spark, d):
    x1 = F.when(F.col("det") % 9 == 4, F.lit(float("nan"))).otherwise(F.col("x") * 100 - 5)
    return t.boxes(spark, d).select("media_id", "frame", "det", "score", x1.alias("x1"), (F.col("y") * 100).alias("y1"), ((F.col("x") + F.col("w")) * 100 - 10).alias("x2"), ((F.col("y") + F.col("h")) * 100).alias("y2"))


@query(f"WITH {_CORNERS}, v AS (SELECT * FROM corners WHERE NOT isnan(x1) AND x1 >= 0 AND x1 < x2 AND x2 <= 100 AND y1 >= 0 AND y1 < y2 AND y2 <= 100), k AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, frame, det) - 1 AS k FROM v) SELECT media_id, frame, det, 'region-' || k AS region, round(score, 6) AS score, round(x1 / 100, 6) AS x, round(y1 / 100, 6) AS y, round((x2 - x1) / 100, 6) AS w, round((y2 - y1) / 100, 6) AS h FROM k WHERE k < 3")
def top_valid_regions(spark, d):
    rows = images.top_regions(images.valid_regions(_corners(spark, d), F.lit(100), F.lit(100)), ["media_id"], ["frame", "det"], 3)
    return r6(rows.select("media_id", "frame", "det", "region", "score", "x", "y", "w", "h"), "score", "x", "y", "w", "h")


_POLY = f"{t.BOXES}, poly AS (SELECT media_id, frame, det, [{{'x': x + w, 'y': y}}, {{'x': x - 0.1, 'y': y + 0.02}}, {{'x': x + w + 0.03, 'y': y + h}}, {{'x': x, 'y': y + h + 0.01}}] AS p FROM boxes)"


def _polygons(spark, d):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return t.boxes(spark, d).select("media_id", "frame", "det", F.array(point(x + w, y), point(x - 0.1, y + 0.02), point(x + w + 0.03, y + h), point(x, y + h + 0.01)).alias("p"))


_ENDS = lambda f, c: f"least(1, greatest(0, list_{f}(list_transform(p, lambda q: q.{c}))))"


@query(f"WITH {_POLY} SELECT media_id, frame, det, round({_ENDS('min', 'x')}, 6) AS x, round({_ENDS('min', 'y')}, 6) AS y, round({_ENDS('max', 'x')} - {_ENDS('min', 'x')}, 6) AS w, round({_ENDS('max', 'y')} - {_ENDS('min', 'y')}, 6) AS h FROM poly")
def polygon_boxes(spark, d):
    rows = _polygons(spark, d)
    return r6(rows.select("media_id", "frame", "det", *[v.alias(c) for c, v in images.polygon_box(F.col("p")).items()]), "x", "y", "w", "h")


_PICK = lambda f, order: f"arg_{f}(i, round({order}, 9) * 1000 {'+' if f == 'min' else '-'} i * 1e-6)"


@query(f"WITH {_POLY}, u AS (SELECT media_id, frame, det, unnest(range(0, 4)) AS i, unnest(p) AS q FROM poly), o AS (SELECT media_id, frame, det, {_PICK('min', 'q.x + q.y')} AS tl, {_PICK('min', 'q.y - q.x')} AS tr, {_PICK('max', 'q.x + q.y')} AS br, {_PICK('max', 'q.y - q.x')} AS bl FROM u GROUP BY ALL), s AS (SELECT media_id, frame, det, abs(sum(q.x * n.y - n.x * q.y)) / 2 AS area, sum(sqrt(pow(q.x - n.x, 2) + pow(q.y - n.y, 2))) AS length FROM (SELECT *, coalesce(lead(q) OVER w, first(q) OVER w) AS n FROM u WINDOW w AS (PARTITION BY media_id, frame, det ORDER BY i)) GROUP BY ALL) SELECT media_id, frame, det, tl || '-' || tr || '-' || br || '-' || bl AS corners, round(area, 6) AS area, round(length, 6) AS length, round(area * 1.5 / length, 6) AS distance FROM o JOIN s USING (media_id, frame, det)")
def polygon_geometry(spark, d):
    rows = _polygons(spark, d)
    rounded = F.transform("p", lambda q: F.struct(F.round(q["x"], 9).alias("x"), F.round(q["y"], 9).alias("y")))
    place = lambda q: (F.array_position(rounded, F.struct(F.round(q["x"], 9).alias("x"), F.round(q["y"], 9).alias("y"))) - 1).cast("string")
    area, length = images.polygon_size(F.col("p"))
    corners = F.array_join(F.transform(images.ordered_quad(rounded), place), "-")
    return r6(rows.select("media_id", "frame", "det", corners.alias("corners"), area.alias("area"), length.alias("length"), images.unclip_distance(F.col("p")).alias("distance")), "area", "length", "distance")


_SIZES = "sizes AS (SELECT o_orderkey::BIGINT AS image, (o_orderkey % 2300 + 40)::INT AS w, (o_custkey % 1700 + 40)::INT AS h FROM orders)"


def _sizes(spark, d):
    return t.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("image"), (F.col("o_orderkey") % 2300 + 40).cast("int").alias("w"), (F.col("o_custkey") % 1700 + 40).cast("int").alias("h"))


@query(f"WITH {_SIZES}, r AS (SELECT *, CASE WHEN greatest(w, h) > 960 THEN 960.0::DOUBLE / greatest(w, h) ELSE 1 END AS ratio FROM sizes) SELECT image, greatest(round_even(w * ratio / 32, 0) * 32, 32)::INT AS input_w, greatest(round_even(h * ratio / 32, 0) * 32, 32)::INT AS input_h FROM r")
def text_input_sizes(spark, d):
    w, h = images.text_input_size(F.col("w"), F.col("h"))
    return _sizes(spark, d).select("image", w.alias("input_w"), h.alias("input_h"))


@query(f"WITH {_SIZES}, a AS (SELECT image, CASE WHEN (greatest(w, h) < 512 OR least(w, h) > 512) THEN CASE WHEN w >= h THEN floor(w / h * 512)::INT ELSE 512 END ELSE w END AS rw, CASE WHEN (greatest(w, h) < 512 OR least(w, h) > 512) THEN CASE WHEN w >= h THEN 512 ELSE floor(h / w * 512)::INT END ELSE h END AS rh FROM sizes), b AS (SELECT image, greatest(rw - rw % 32, 32) AS rw, greatest(rh - rh % 32, 32) AS rh FROM a), c AS (SELECT *, greatest(rw / 2048, rh / 2048, 1) AS over FROM b), e AS (SELECT image, CASE WHEN over > 1 THEN greatest(floor(rw / over)::INT - floor(rw / over)::INT % 32, 32) ELSE rw END AS rw, CASE WHEN over > 1 THEN greatest(floor(rh / over)::INT - floor(rh / over)::INT % 32, 32) ELSE rh END AS rh FROM c) SELECT image, rw AS input_w, rh AS input_h, CASE WHEN greatest(rw / rh, rh / rw) > 32 THEN 'INVALID_REQUEST' END AS fault FROM e")
def matte_input_sizes(spark, d):
    w, h, fault = images.matte_input_size(F.col("w"), F.col("h"))
    return _sizes(spark, d).select("image", w.alias("input_w"), h.alias("input_h"), fault.alias("fault"))


@query(f"WITH {_SIZES}, a AS (SELECT *, CASE image % 6 WHEN 0 THEN NULL WHEN 1 THEN -2 WHEN 2 THEN w // 2 + 1 ELSE w * 2 END AS aw, CASE image % 6 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE h * 2 END AS ah FROM sizes), f AS (SELECT *, CASE WHEN (aw IS NULL) <> (ah IS NULL) THEN 'one dimension' WHEN aw <= 0 OR ah <= 0 THEN 'not positive' WHEN abs(aw / w - ah / h) > 1e-6 THEN 'not uniform' END AS fault FROM a) SELECT image, CASE WHEN fault IS NULL THEN coalesce(aw, w) END AS mw, CASE WHEN fault IS NULL THEN coalesce(ah, h) END AS mh, fault FROM f")
def measure_sizes(spark, d):
    k = F.col("image") % 6
    rows = _sizes(spark, d).withColumn("aw", F.when(k == 0, None).when(k == 1, -2).when(k == 2, F.floor(F.col("w") / 2) + 1).otherwise(F.col("w") * 2)).withColumn("ah", F.when(k.isin(0, 3), None).otherwise(F.col("h") * 2))
    w, h, fault = images.measure_size(F.col("w"), F.col("h"), F.col("aw"), F.col("ah"))
    return rows.select("image", w.alias("mw"), h.alias("mh"), fault.alias("fault"))


@query(f"WITH {_SIZES} SELECT image, CASE WHEN greatest(w, h) / least(w, h) > 8 THEN 'DEPTH_ASPECT_UNSUPPORTED' WHEN image % 5 = 0 THEN 'DEPTH_NO_IMAGE_VARIATION' ELSE 'ok' END AS verdict, CASE WHEN greatest(w, h) > 512 THEN greatest(1, round_even(w * (512.0::DOUBLE / greatest(w, h)), 0))::INT ELSE w END AS map_w, CASE WHEN greatest(w, h) > 512 THEN greatest(1, round_even(h * (512.0::DOUBLE / greatest(w, h)), 0))::INT ELSE h END AS map_h FROM sizes")
def depth_suitability(spark, d):
    same = [(F.lit(7), F.when(F.col("image") % 5 == 0, 7).otherwise(9)), (F.lit(1), F.lit(1))]
    w, h = depth.map_size(F.col("w"), F.col("h"))
    return _sizes(spark, d).select("image", depth.suitability(F.col("w"), F.col("h"), same).alias("verdict"), w.alias("map_w"), h.alias("map_h"))


@query(f"WITH {t.PATCH}, e AS (SELECT media_id, frame_index, frame_index % 7 AS k, [0, 65535, (patch[1] * 257)::INT, (patch[2] * 257)::INT] AS s FROM patches) SELECT media_id, frame_index, CASE k WHEN 1 THEN 'LENGTH' WHEN 2 THEN 'ENCODING' WHEN 3 THEN 'RANGE' WHEN 4 THEN 'EXTREMES' WHEN 5 THEN 'CHECKSUM' WHEN 6 THEN 'DIMENSIONS' END AS fault FROM e")
def depth_payload_validation(spark, d):
    k = F.col("frame_index") % 7
    s = F.array(F.when(k == 4, 3).otherwise(0), F.lit(65535), F.col("patch")[0] * 257, F.col("patch")[1] * 257)
    rows = t.patches(spark, d).withColumn("s", s)
    hexed = F.concat(*[F.concat(F.substring(F.lpad(F.hex(F.col("s")[i].cast("long")), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(F.col("s")[i].cast("long")), 4, "0"), 1, 2)) for i in range(4)])
    digest = F.when(k == 5, "00").otherwise(F.sha2(F.unhex(hexed), 256))
    payload = F.struct(F.when(k == 6, 0).otherwise(2).alias("width"), F.when(k == 1, 3).otherwise(2).alias("height"), F.col("s").alias("samples"), digest.alias("sha256"), F.when(k == 2, 1).otherwise(65535).alias("near"), F.lit(0).alias("far"), F.lit(1.0).alias("low"), F.when(k == 3, 1.0).otherwise(2.0).alias("high"))
    return rows.withColumn("payload", payload).select("media_id", "frame_index", depth.payload_fault(F.col("payload")).alias("fault"))


_POINTS = f"{t.BOXES}, pts AS (SELECT media_id, frame, det, x * 320 AS x, y * 240 AS y, x * 320 + w * 4 AS bu, y * 240 + h * 3 AS bv, 1 - det % 2 AS found, (score >= 0.1)::INT AS found_back, w, h FROM boxes)"


def _points(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    return t.boxes(spark, d).select("media_id", "frame", "det", (x * 320).alias("x"), (y * 240).alias("y"), (x * 320 + w * 4).alias("bx"), (y * 240 + h * 3).alias("by"), (1 - F.col("det") % 2).alias("found"), (F.col("score") >= 0.1).cast("int").alias("found_back"), "w", "h")


@query(f"WITH {_POINTS} SELECT media_id, frame, det FROM pts WHERE found = 1 AND found_back = 1 AND sqrt(pow(x - bu, 2) + pow(y - bv, 2)) <= 2.0000001")
def consistent_tracks(spark, d):
    return images.consistent_points(_points(spark, d), 2.0000001).select("media_id", "frame", "det")


_A = {"a00": "0.99 + frame / 500.0::DOUBLE", "a01": "0.01", "a02": "frame * 1.5::DOUBLE - 4", "a10": "-0.01", "a11": "0.98", "a12": "2 - frame / 3.0::DOUBLE"}


@query(f"WITH {_POINTS}, a AS (SELECT *, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _A.items())} FROM pts), m AS (SELECT media_id, frame, sqrt(avg(pow(bu - (a00 * x + a01 * y + a02), 2) + pow(bv - (a10 * x + a11 * y + a12), 2))) / 320 AS residual, any_value(a02) / 320 AS tx, any_value(a12) / 240 AS ty, sqrt(pow(any_value(a00), 2) + pow(any_value(a01), 2)) AS scale, atan2(any_value(a10), any_value(a00)) AS rotation FROM a GROUP BY ALL), g AS (SELECT *, sqrt(tx * tx + ty * ty) + abs(scale - 1) AS magnitude FROM m) SELECT media_id, frame, round(tx, 6) AS tx, round(ty, 6) AS ty, round(scale, 6) AS scale, round(rotation, 6) AS rotation, round(magnitude, 6) AS magnitude, CASE WHEN magnitude >= 0.0018 THEN round(atan2(ty, tx), 6) END AS direction, round(residual, 6) AS residual FROM g")
def affine_motion(spark, d):
    f = F.col("frame")
    a = {"a00": F.lit(0.99) + f / 500.0, "a01": F.lit(0.01), "a02": f * 1.5 - 4, "a10": F.lit(-0.01), "a11": F.lit(0.98), "a12": 2 - f / 3.0}
    rows = images.affine_residual(_points(spark, d).withColumn("u", F.col("bx")).withColumn("v", F.col("by")), ["media_id", "frame"], F.lit(320), F.lit(240), a)
    made = images.affine_motion(F.lit(320), F.lit(240), a)
    return r6(rows.select("media_id", "frame", *[v.alias(k) for k, v in made.items()], "residual"), *made, "residual")


@query(f"WITH {_POINTS}, i AS (SELECT media_id, frame, det, x AS px, y AS py FROM pts WHERE x >= 26 AND x < 294 AND y >= 20 AND y < 220), b AS (SELECT media_id, frame, floor(x * 320) - 8 AS x0, floor(y * 240) - 6 AS y0, floor((x + w / 8) * 320) + 8 AS x1, floor((y + h / 8) * 240) + 6 AS y1 FROM boxes WHERE det % 2 = 1) SELECT media_id, frame, det FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.media_id = i.media_id AND b.frame = i.frame AND px >= x0 AND px < x1 AND py >= y0 AND py < y1)")
def points_outside_subjects(spark, d):
    points = _points(spark, d).select("media_id", "frame", "det", F.col("x").alias("px"), F.col("y").alias("py"))
    boxes = t.boxes(spark, d).where("det % 2 = 1").select("media_id", "frame", "x", "y", (F.col("w") / 8).alias("w"), (F.col("h") / 8).alias("h"))
    return images.outside_boxes(points, boxes, 320, 240).select("media_id", "frame", "det")


@query(f"WITH {t.PATCH}, c AS (SELECT media_id, frame_index, i, (patch[(i // 4) * 16 + (i % 4) * 2 + 1] + patch[(i // 4) * 16 + (i % 4) * 2 + 2] + patch[(i // 4) * 16 + (i % 4) * 2 + 9] + patch[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4 AS v FROM patches, (SELECT unnest(range(0, 16)) AS i)) SELECT media_id, frame_index, i, round(v, 6) AS v FROM c")
def area_reduced_frames(spark, d):
    rows = images.reduced(t.patches(spark, d).select("media_id", "frame_index", "patch"), "patch", 8, 4, 4)
    return rows.select("media_id", "frame_index", F.posexplode("reduced").alias("i", "v")).withColumn("i", F.col("i").cast("long")).withColumn("v", F.round("v", 6))


@query(f"WITH {t.PATCH} SELECT media_id, frame_index, i, round_even(patch[(i // 8) * 8 + least(i % 8, 6) + 1] * CASE WHEN i % 8 = 7 THEN 0 ELSE 0.5 END + patch[(i // 8) * 8 + least(i % 8 + 1, 7) + 1] * CASE WHEN i % 8 = 7 THEN 1 ELSE 0.5 END, 0)::INT AS v FROM patches, (SELECT unnest(range(0, 64)) AS i)")
def flow_warped_mattes(spark, d):
    half = F.array_repeat(F.lit(0.25), 16)
    rows = t.patches(spark, d).select("media_id", "frame_index", F.col("patch").alias("alpha"), half.alias("dx"), F.array_repeat(F.lit(0.0), 16).alias("dy"))
    out = images.warp_mattes(rows, 8, 4)
    return out.select("media_id", "frame_index", F.posexplode("aligned").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
