"""Queries of the trackers, matches and merges, on boxes made from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from frametide.operators import tracks
from frametide.plans.registry import _crowded, _track, _tracked, _TRACK, _TRACKED, query, r6
from frametide.sources import tables as t


@query()
def face_tracker(spark, d):
    return tracks.face_tracks(_crowded(spark, d))


_FRAGMENTS = f"{_TRACKED}, fragment AS (SELECT media_id, 'face-' || track AS track, CASE WHEN (media_id + track) % 3 = 0 THEN NULL ELSE (media_id + track) % 2 END AS subject, frame, CASE WHEN round(score * 100)::INT % 2 = 0 THEN 'detected' ELSE 'interpolated' END AS kind, CASE WHEN media_id % 4 = 1 THEN 0.95 ELSE score END AS score FROM tracked)"


def _fragments(spark, d):
    subject = F.when((F.col("media_id") + F.col("track")) % 3 != 0, (F.col("media_id") + F.col("track")) % 2)
    kind = F.when(F.round(F.col("score") * 100).cast("int") % 2 == 0, "detected").otherwise("interpolated")
    score = F.when(F.col("media_id") % 4 == 1, 0.95).otherwise(F.col("score"))
    return _tracked(spark, d).select("media_id", F.concat(F.lit("face-"), F.col("track").cast("string")).alias("track"), subject.alias("subject"), "frame", kind.alias("kind"), score.alias("score"))


@query(f"WITH {_FRAGMENTS}, fine AS (SELECT media_id, track FROM fragment WHERE subject IS NULL GROUP BY ALL HAVING avg(score) >= 0.9 AND sum((kind = 'detected')::INT) >= 2), r AS (SELECT *, min(track) OVER (PARTITION BY media_id, subject) AS first, row_number() OVER (PARTITION BY media_id, subject, frame ORDER BY (kind = 'detected')::INT DESC, score DESC, track) AS k FROM fragment WHERE subject IS NOT NULL) SELECT media_id, first AS track, subject, frame, kind, round(score, 6) AS score FROM r WHERE k = 1 UNION ALL SELECT media_id, track, NULL, frame, kind, round(score, 6) FROM fragment JOIN fine USING (media_id, track) WHERE subject IS NULL")
def face_fragment_merge(spark, d):
    return r6(tracks.merge_faces(_fragments(spark, d)), "score")


@query(f"WITH {_TRACKED} SELECT media_id, track, round(avg(CASE WHEN frame <> 1 THEN score END), 6) AS aggregate_score, count(*) AS n_samples, string_agg(frame::VARCHAR, ',' ORDER BY frame) AS frames FROM tracked GROUP BY ALL")
def track_serialisation(spark, d):
    rows = _tracked(spark, d).withColumn("kind", F.lit("detected")).withColumn("score", F.when(F.col("frame") != 1, F.col("score")))
    out = tracks.serialise(rows)
    return r6(out.select("media_id", "track", "aggregate_score", "n_samples", F.array_join(F.transform("samples", lambda s: s["frame"].cast("string")), ",").alias("frames")), "aggregate_score")


@query(f"WITH {_TRACKED} SELECT media_id, frame, count(*)::INT AS n, round(sum(w * (0.1 + 0)), 6) AS width FROM tracked WHERE track <> 1 OR frame <> 0 GROUP BY ALL")
def subject_boxes_by_frame(spark, d):
    hidden = (F.col("track") == 1) & (F.col("frame") == 0)
    rows = _tracked(spark, d).withColumn("kind", F.lit("detected")).withColumns({c: F.when(~hidden, F.col(c)) for c in "xywh"})
    out = tracks.boxes_by_frame(tracks.serialise(rows))
    return out.select("media_id", "frame", F.size("boxes").alias("n"), F.round(F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["w"]) * 0.1, 6).alias("width"))


_MATCH = f"""{t.BOXES}, few AS (SELECT media_id, frame, det, x, y, w, h FROM boxes), pred AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY det) AS k FROM few WHERE det % 2 = 0), truth AS (SELECT media_id, frame, row_number() OVER (PARTITION BY media_id, frame ORDER BY det) AS k, x, y, w, h FROM few WHERE det % 2 = 1),
pair AS (SELECT a.media_id, a.frame, a.k AS p, b.k AS q, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s FROM pred a JOIN truth b ON a.media_id = b.media_id AND a.frame = b.frame), good AS (SELECT media_id, frame, p, q, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 9) AS v FROM pair),
go AS (SELECT media_id, frame, 0::BIGINT AS k, []::BIGINT[] AS used FROM few GROUP BY ALL UNION ALL SELECT g.media_id, g.frame, p.k, coalesce(list_append(g.used, (SELECT q FROM good WHERE good.media_id = p.media_id AND good.frame = p.frame AND good.p = p.k AND v >= 0.3 AND NOT list_contains(g.used, q) ORDER BY v DESC, q DESC LIMIT 1)), g.used) FROM go g JOIN pred p ON p.media_id = g.media_id AND p.frame = g.frame AND p.k = g.k + 1),
done AS (SELECT media_id, frame, len(list_filter(arg_max(used, k), lambda u: u IS NOT NULL)) AS hits FROM go GROUP BY ALL), tot AS (SELECT media_id, frame, sum((det % 2 = 0)::INT) AS np, sum((det % 2 = 1)::INT) AS nt FROM few GROUP BY ALL), sc AS (SELECT media_id, sum(hits)::BIGINT AS hits, sum(nt - hits)::BIGINT AS misses, sum(np - hits)::BIGINT AS false_alarms FROM done JOIN tot USING (media_id, frame) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_MATCH} SELECT media_id, hits, misses, false_alarms, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 1 END, 6) AS recall, round(CASE WHEN hits + false_alarms > 0 THEN hits / (hits + false_alarms) ELSE 1 END, 6) AS precision FROM sc")
def detection_scores(spark, d):
    few = t.boxes(spark, d)
    found = tracks.greedy_matches(few.where("det % 2 = 0").select("media_id", "frame", "det", *"xywh"), few.where("det % 2 = 1").select("media_id", "frame", "det", *"xywh"), 0.3)
    return r6(tracks.detection_scores(found, ["media_id"]), "recall", "precision")


@query(f"WITH RECURSIVE {t.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY frame, det) AS k FROM boxes), n AS (SELECT media_id, k, [k] AS kept FROM r WHERE k = 1 UNION ALL SELECT r.media_id, r.k, CASE WHEN EXISTS (SELECT 1 FROM r b WHERE b.media_id = r.media_id AND list_contains(n.kept, b.k) AND greatest(least(r.x + r.w, b.x + b.w) - greatest(r.x, b.x), 0) * greatest(least(r.y + r.h, b.y + b.h) - greatest(r.y, b.y), 0) >= 0.4 * (r.w * r.h + b.w * b.h - greatest(least(r.x + r.w, b.x + b.w) - greatest(r.x, b.x), 0) * greatest(least(r.y + r.h, b.y + b.h) - greatest(r.y, b.y), 0))) THEN n.kept ELSE list_append(n.kept, r.k) END FROM n JOIN r ON r.media_id = n.media_id AND r.k = n.k + 1), l AS (SELECT media_id, arg_max(kept, k) AS kept FROM n GROUP BY 1) SELECT r.media_id, frame, det FROM r JOIN l ON l.media_id = r.media_id AND list_contains(l.kept, r.k)")
def temporal_box_dedup(spark, d):
    return tracks.distinct_boxes(t.boxes(spark, d), 0.4)


@query(f"WITH {_TRACK} SELECT media_id, frame, round((x + nx) / 2, 6) AS x, round((y + ny) / 2, 6) AS y, round((w + nw) / 2, 6) AS w, round((h + nh) / 2, 6) AS h FROM n WHERE nf IS NOT NULL")
def box_interpolation(spark, d):
    from frametide.operators.frames import between

    w = t.Window.partitionBy("media_id").orderBy("frame")
    rows = _track(spark, d).withColumns({f"_{c}": F.lead(c).over(w) for c in "xywh"}).where("_x is not null")
    return r6(rows.select("media_id", "frame", *[between(c, f"_{c}", F.lit(0.5)).alias(c) for c in "xywh"]), *"xywh")
