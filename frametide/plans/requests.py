"""Queries of the request, timeline, grant and registry operators. Requests are made from events, timelines from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from frametide.operators import requests as ops
from frametide.plans.registry import query
from frametide.sources import tables as t

_ALL = sorted({*ops.VIDEO, *ops.IMAGE, *ops.AUDIO})
_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_GRANTS = ["depthMap", "canonicalMp4", "canonicalImage", "canonicalAudio", "matteAssets", "thumbnails"]

#: One request for each event: all fields are remainders of its id.
_REQUESTS = f"""req AS (SELECT event_id, user_id, props, CASE event_id % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'picture' ELSE 'video' END AS kind,
  list_transform(range(0, (event_id % 4)::BIGINT), lambda i: CASE WHEN (event_id + i) % 31 = 5 THEN 'mood' ELSE {_list(_ALL)}[((event_id * (i + 3)) % {len(_ALL)} + 1)::BIGINT] END) AS features,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE sha256(props) END AS sha256, event_id % 3 <> 0 AS canonicalize, event_id % 13 = 6 AS has_video_facts, event_id % 17 = 3 AS has_image_options, event_id % 19 = 4 AS neural_beats, event_id % 23 < 3 AS has_rhythm_options, event_id % 29 = 7 AS has_resolution,
  CASE WHEN event_id % 2 = 0 THEN [{_list(_GRANTS)}[(event_id // 2 % 6 + 1)::BIGINT]] ELSE []::VARCHAR[] END AS grants, CASE WHEN event_id % 8 < 4 THEN [0::BIGINT] ELSE [0::BIGINT, 1] END AS thumbnail_indexes FROM events)"""


def _requests(spark, d):
    e = F.col("event_id")
    pick = lambda names, i: F.element_at(F.lit(names), (i + 1).cast("int"))
    kind = F.when(e % 7 <= 1, "image").when(e % 7 == 2, "audio").when(e % 7 == 3, "picture").otherwise("video")
    features = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i >= e % 4, F.lit(None)).when((e + i) % 31 == 5, "mood").otherwise(pick(_ALL, (e * (i + 3)) % len(_ALL)))), lambda x: x.isNotNull())
    return t.table(spark, d, "events").select(
        "event_id", "user_id", "props", kind.alias("kind"), features.alias("features"), F.when(e % 5 == 0, None).when(e % 5 == 1, "abc").otherwise(F.sha2("props", 256)).alias("sha256"), (e % 3 != 0).alias("canonicalize"), (e % 13 == 6).alias("has_video_facts"), (e % 17 == 3).alias("has_image_options"),
        (e % 19 == 4).alias("neural_beats"), (e % 23 < 3).alias("has_rhythm_options"), (e % 29 == 7).alias("has_resolution"), F.when(e % 2 == 0, F.array(pick(_GRANTS, F.floor(e / 2) % 6))).otherwise(F.array().cast("array<string>")).alias("grants"),
        F.when(e % 8 < 4, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("thumbnail_indexes"),
    )


_HAS = lambda x: f"list_contains(grants, '{x}')"
_EXTRA = lambda a: f"len(list_filter(features, lambda f: NOT list_contains({a}, f))) > 0"
_CONTRACT = f"""CASE WHEN kind NOT IN ('video', 'image', 'audio') THEN 'unknown mediaKind' WHEN len(features) = 0 THEN 'features is empty' WHEN {_EXTRA(_list(_ALL))} THEN 'unknown features'
  WHEN len(list_distinct(features)) <> len(features) THEN 'duplicate features' WHEN (kind = 'video' AND {_EXTRA(_list(ops.VIDEO))}) OR (kind = 'image' AND {_EXTRA(_list(ops.IMAGE))}) OR (kind = 'audio' AND {_EXTRA(_list(ops.AUDIO))}) THEN 'features do not suit mediaKind'
  WHEN kind <> 'video' AND sha256 IS NULL THEN 'source.sha256 is missing' WHEN sha256 IS NOT NULL AND NOT regexp_full_match(sha256, '[0-9a-fA-F]{{64}}') THEN 'source.sha256 is no digest' WHEN kind <> 'video' AND has_video_facts THEN 'video metadata does not suit mediaKind'
  WHEN has_image_options AND kind <> 'image' THEN 'imageOptions needs an image' WHEN neural_beats AND kind <> 'audio' THEN 'neuralBeats needs audio' WHEN has_rhythm_options AND NOT list_contains(features, 'rhythm') THEN 'rhythmOptions needs rhythm' WHEN kind = 'audio' AND has_resolution THEN 'audio has no resolution'
  WHEN list_contains(features, 'relative_depth') AND (kind <> 'image' OR NOT canonicalize OR NOT {_HAS('depthMap')}) THEN 'relative_depth needs a canonical image and its grant' WHEN NOT list_contains(features, 'relative_depth') AND {_HAS('depthMap')} THEN 'depthMap needs relative_depth'
  WHEN {_HAS('canonicalMp4')} AND kind <> 'video' THEN 'canonicalMp4 needs its canonical video' WHEN {_HAS('canonicalImage')} AND (kind <> 'image' OR NOT canonicalize) THEN 'canonicalImage needs its canonical image' WHEN {_HAS('canonicalAudio')} AND (kind <> 'audio' OR NOT canonicalize) THEN 'canonicalAudio needs its canonical audio'
  WHEN kind <> 'video' AND {_HAS('matteAssets')} THEN 'matte grants need a video' WHEN kind <> 'video' AND {_HAS('thumbnails')} AND NOT list_contains(features, 'thumbnails') THEN 'thumbnail grants need thumbnails' WHEN kind = 'image' AND {_HAS('thumbnails')} AND thumbnail_indexes <> [0::BIGINT] THEN 'an image has one thumbnail, index 0' END"""


@query(f"WITH {_REQUESTS} SELECT event_id, {_CONTRACT} AS fault FROM req")
def request_validation(spark, d):
    r = _requests(spark, d)
    return r.select("event_id", ops.contract_fault({c: F.col(c) for c in r.columns}).alias("fault"))


_SERVED = ["shots", "subjects", "faces", "ocr", "motion", "quality", "exposure", "audio", "waveform", "rhythm"]
_ROUTE = "CASE event_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'ocr' WHEN 2 THEN 'audio' ELSE 'all' END AS role, CASE event_id % 3 WHEN 0 THEN 'analysis-cpu' WHEN 1 THEN 'matte-gpu' ELSE 'analysis-gpu' END AS image"


@query(f"WITH {_REQUESTS}, w AS (SELECT event_id, features, {_ROUTE} FROM req) SELECT event_id, CASE WHEN role = 'audio' AND {_EXTRA(_list(ops.AUDIO))} THEN 'FEATURE_UNAVAILABLE' WHEN image = 'analysis-cpu' AND list_contains(features, 'person_matte') THEN 'INVALID_REQUEST' WHEN image LIKE 'matte%' AND {_EXTRA(_list(['person_matte']))} THEN 'FEATURE_UNAVAILABLE' WHEN role = 'general' AND list_contains(features, 'ocr') THEN 'FEATURE_UNAVAILABLE' WHEN role = 'ocr' AND {_EXTRA(_list(['ocr', 'shots']))} THEN 'FEATURE_UNAVAILABLE' WHEN {_EXTRA(_list([*_SERVED, 'person_matte']))} THEN 'FEATURE_UNAVAILABLE' END AS code FROM w")
def feature_routing(spark, d):
    e = F.col("event_id")
    role = F.when(e % 4 == 0, "general").when(e % 4 == 1, "ocr").when(e % 4 == 2, "audio").otherwise("all")
    image = F.when(e % 3 == 0, "analysis-cpu").when(e % 3 == 1, "matte-gpu").otherwise("analysis-gpu")
    return _requests(spark, d).select("event_id", ops.routing_fault(F.col("features"), role, image, _SERVED).alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 3 THEN 'segmented delivery is not offered' WHEN event_id % 4 = 0 THEN 'matteTarget is missing' WHEN event_id % 4 = 1 THEN 'subject_tracks is not offered' WHEN event_id % 4 = 2 AND event_id % 8 = 2 THEN 'mode must be all_people' WHEN event_id % 3 <> 1 THEN 'exactly one matteAssets grant' WHEN event_id % 5 < 2 THEN 'grant lacks its label' WHEN event_id % 7 = 0 THEN 'shots are missing' END AS fault FROM events")
def matte_validation(spark, d):
    e = F.col("event_id")
    mode = F.when(e % 4 == 0, None).when(e % 4 == 1, "subject_tracks").when(e % 8 == 2, "some_people").otherwise("all_people")
    return t.table(spark, d, "events").select("event_id", ops.matte_fault(mode, e % 11 == 3, F.when(e % 3 != 0, e % 3), F.when(e % 5 == 0, None).when(e % 5 == 1, "").otherwise("full"), e % 7).alias("fault"))


@query("SELECT o_orderkey::BIGINT AS source, CASE WHEN floor(o_totalprice) * 300 > 83886080 THEN 'bytes' WHEN o_custkey % 70 > 60.05 THEN 'duration' WHEN o_orderkey % 2000 > 1920 OR o_orderkey % 1999 > 1920 THEN 'side' WHEN (o_orderkey % 2000) * (o_orderkey % 1999) * (o_custkey % 2400) > 6635520000 THEN 'pixels' END AS exceeded FROM orders")
def resource_limits(spark, d):
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    return t.table(spark, d, "orders").select(k.alias("source"), ops.limit_fault(c % 70, k % 2000, k % 1999, c % 2400, F.floor("o_totalprice") * 300).alias("exceeded"))


@query("SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS row_id, count(*) AS n, bool_and(l_quantity::DOUBLE / 50 + l_tax::DOUBLE * 5 <= 1.000001 AND l_discount::DOUBLE * 5 + (l_partkey % 90)::DOUBLE / 100 <= 1.000001) AS inside, min(CASE WHEN l_partkey % 4 = 0 THEN 'denominator is 0' WHEN l_suppkey % 3 - 1 <= 0 THEN 'rate is not positive' END) AS fault FROM lineitem GROUP BY 1")
def value_validators(spark, d):
    num = lambda c: F.col(c).cast("double")
    inside = ops.is_unit_box(num("l_quantity") / 50, num("l_discount") * 5 + 0.0, num("l_tax") * 5 + 0.0, (F.col("l_partkey") % 90) / 100)
    fault = ops.rational_fault(F.col("l_suppkey") % 3 - 1, F.col("l_partkey") % 4)
    return t.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row_id")).agg(F.count("*").alias("n"), F.bool_and(inside).alias("inside"), F.min(fault).alias("fault"))


#: Timelines with faults: by remainder of the media, shots out of order, shifted, cut short, overlapping, apart or out of range.
_TIMES = f"{t.SHOTS}, media AS (SELECT media_id, max(end_frame) AS frame_count, count(*) AS n_shots FROM shots GROUP BY 1), odd AS (SELECT media_id, CASE WHEN media_id % 8 = 1 THEN -shot_index ELSE shot_index END AS position, CASE WHEN media_id % 8 = 2 THEN start_frame + 1 WHEN media_id % 8 = 4 AND shot_index > 0 THEN start_frame - 1 WHEN media_id % 8 = 5 AND shot_index > 0 THEN start_frame + 1 ELSE start_frame END AS start_frame, CASE WHEN media_id % 8 = 3 THEN end_frame + 2 ELSE end_frame END AS end_frame FROM shots WHERE media_id % 8 <> 6 OR shot_index > 99)"


def _times(spark, d):
    s = t.shots(spark, d)
    k, later = F.col("media_id") % 8, F.col("shot_index") > 0
    media = s.groupBy("media_id").agg(F.max("end_frame").alias("frame_count"), F.count("*").alias("n_shots"))
    start = F.when(k == 2, F.col("start_frame") + 1).when((k == 4) & later, F.col("start_frame") - 1).when((k == 5) & later, F.col("start_frame") + 1).otherwise(F.col("start_frame"))
    odd = s.where((k != 6) | (F.col("shot_index") > 99)).select("media_id", F.when(k == 1, -F.col("shot_index")).otherwise(F.col("shot_index")).alias("position"), start.alias("start_frame"), F.when(k == 3, F.col("end_frame") + 2).otherwise(F.col("end_frame")).alias("end_frame"))
    return media, odd


@query(f"WITH {_TIMES}, n AS (SELECT *, lag(start_frame) OVER w AS ps, lag(end_frame) OVER w AS pe FROM odd WINDOW w AS (PARTITION BY media_id ORDER BY position)), f AS (SELECT media_id, bool_or(start_frame < ps) AS unsorted, min(start_frame) AS low, arg_max(end_frame, start_frame) AS high, max(end_frame) AS most, bool_or(start_frame < pe) AS overlap, bool_or(start_frame > pe) AS gap FROM n GROUP BY 1) SELECT media_id, CASE WHEN frame_count <= 0 THEN 'frame count' WHEN low IS NULL THEN 'no shots' WHEN unsorted THEN 'unsorted' WHEN low <> 0 THEN 'start' WHEN high <> frame_count THEN 'cover' WHEN most > frame_count THEN 'outside' WHEN overlap THEN 'overlap' WHEN gap THEN 'gap' END AS fault FROM media LEFT JOIN f USING (media_id)")
def shot_timeline_rules(spark, d):
    media, odd = _times(spark, d)
    return ops.timeline_fault(odd, media)


_STREAM = f"{_TIMES}, st AS (SELECT media_id, position, CASE WHEN media_id % 4 = 1 AND position = 2 THEN 1 WHEN media_id % 4 = 2 AND position >= 3 THEN position + 1 ELSE position END AS frame FROM (SELECT media_id, unnest(range(0, 6)) AS position FROM media)), cnt AS (SELECT media_id, CASE WHEN media_id % 4 = 3 THEN 7 ELSE 6 END AS frame_count FROM media)"


@query(f"WITH {_STREAM}, e AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY position) - 1 AS expected, row_number() OVER (PARTITION BY media_id, frame ORDER BY position) AS seen FROM st), b AS (SELECT media_id, count(*) AS n, arg_min(CASE WHEN seen > 1 THEN 'duplicate' ELSE 'not contiguous' END, position) FILTER (WHERE seen > 1 OR frame <> expected) AS fault FROM e GROUP BY 1) SELECT media_id, coalesce(fault, CASE WHEN n <> frame_count THEN 'count' END) AS fault FROM cnt LEFT JOIN b USING (media_id)")
def contiguous_indexes(spark, d):
    media, _ = _times(spark, d)
    k, p = F.col("media_id") % 4, F.col("position")
    rows = media.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("position"))
    rows = rows.withColumn("frame", F.when((k == 1) & (p == 2), 1).when((k == 2) & (p >= 3), p + 1).otherwise(p))
    return ops.contiguous_fault(rows, media.select("media_id", F.when(k == 3, 7).otherwise(6).alias("frame_count")))


@query(f"WITH {_TIMES}, g AS (SELECT media_id, shot_index AS index FROM shots WHERE (media_id * 7 + shot_index) % 23 <> 5 UNION ALL SELECT media_id, shot_index FROM shots WHERE (media_id * 5 + shot_index) % 29 = 3 UNION ALL SELECT media_id, 90 FROM media WHERE media_id % 9 = 2), f AS (SELECT media_id, count(*) AS n, count(DISTINCT index) AS kinds, min(index) AS low, max(index) AS high FROM g GROUP BY 1) SELECT media_id, CASE WHEN coalesce(n, 0) = 0 THEN 'no grants' WHEN n <> n_shots THEN 'not one grant per shot' WHEN NOT (kinds = n AND low = 0 AND high = n - 1) THEN 'indexes' END AS fault FROM media LEFT JOIN f USING (media_id)")
def thumbnail_grants(spark, d):
    media, _ = _times(spark, d)
    s = t.shots(spark, d).select("media_id", F.col("shot_index").alias("index"))
    g = s.where((F.col("media_id") * 7 + F.col("index")) % 23 != 5).union(s.where((F.col("media_id") * 5 + F.col("index")) % 29 == 3)).union(media.where("media_id % 9 = 2").select("media_id", F.lit(90).cast("long")))
    return ops.grant_fault(g, media)


@query(f"WITH {_TIMES} SELECT media_id, start_frame, end_frame, CASE WHEN start_frame < 0 OR end_frame > frame_count OR end_frame <= start_frame THEN 'INVALID_REQUEST' END AS fault FROM odd JOIN media USING (media_id) WHERE media_id % 3 <> 0 UNION ALL SELECT media_id, 0, frame_count, NULL FROM media WHERE media_id % 3 = 0 AND frame_count > 0")
def quality_shot_ranges(spark, d):
    media, odd = _times(spark, d)
    return ops.quality_ranges(media.withColumn("shots_given", F.col("media_id") % 3 != 0), odd.select("media_id", "start_frame", "end_frame"))


@query(f"WITH {_TIMES}, s AS (SELECT * FROM shots WHERE media_id % 4 = 0), p AS (SELECT * FROM shots WHERE media_id % 4 < 2) SELECT media_id, start_frame, end_frame, 'supplied' AS origin FROM s UNION ALL SELECT media_id, start_frame, end_frame, 'prior' FROM p WHERE media_id % 4 = 1 UNION ALL SELECT media_id, NULL, NULL, 'INVALID_REQUEST' FROM media WHERE media_id % 4 = 2 UNION ALL SELECT media_id, 0, frame_count, 'whole' FROM media WHERE media_id % 4 = 3")
def prior_facts_override(spark, d):
    media, _ = _times(spark, d)
    s = t.shots(spark, d)
    return ops.resolve_shots(media.withColumn("fill_only", F.col("media_id") % 4 == 2), s.where("media_id % 4 = 0"), s.where("media_id % 4 < 2"))


_JSON = """'{"analysisResolution":' || CASE WHEN has_resolution THEN '{"height":' || (event_id % 700)::VARCHAR || ',"width":1280}' ELSE 'null' END || ',"canonicalMedia":null,"canonicalize":' || canonicalize::VARCHAR || ',"features":[' || coalesce(list_aggregate(list_transform(list_sort(features), lambda f: '"' || f || '"'), 'string_agg', ','), '') || '],"matteFrameRanges":null,"matteTarget":null,' || CASE WHEN kind = 'video' THEN '' ELSE '"mediaKind":"' || kind || '",' END || '"outputGrants":' || CASE WHEN len(grants) = 0 THEN 'null' ELSE '["' || grants[1] || '"]' END || ',"priorFacts":null,"sourceSha256":' || coalesce('"' || sha256 || '"', 'null') || '}'"""


@query(f"WITH {_REQUESTS} SELECT event_id, sha256({_JSON}) AS request_hash, sha256(coalesce(sha256, '') || chr(0) || sha256({_JSON}) || chr(0) || 'motion-v1' || chr(0) || kind) AS cache_key FROM req".replace("chr(0)", "chr(1)"))
def request_hash_and_cache_key(spark, d):
    nothing = F.lit(None).cast("string")
    r = {
        "canonicalize": F.col("canonicalize"), "features": F.col("features"), "canonicalMedia": nothing, "matteFrameRanges": nothing, "matteTarget": nothing, "priorFacts": nothing, "sourceSha256": F.col("sha256"),
        "analysisResolution": F.when(F.col("has_resolution"), F.struct((F.col("event_id") % 700).alias("height"), F.lit(1280).alias("width"))), "outputGrants": F.when(F.size("grants") > 0, F.col("grants")),
    }
    digest = ops.request_hash(r, F.col("kind"))
    return _requests(spark, d).select("event_id", digest.alias("request_hash"), F.sha2(F.concat_ws("\x01", F.coalesce("sha256", F.lit("")), digest, F.lit("motion-v1"), F.col("kind")), 256).alias("cache_key"))


@query("""WITH RECURSIVE c AS (SELECT user_id AS idempotency_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch(ts)::DOUBLE AS tick, (event_id // 97 % 5 = 0)::INT AS h, CASE WHEN event_id % 6 = 0 THEN NULL ELSE epoch(ts) + value * 400 END AS ended, event_id % 3 = 0 AS redeliver FROM events),
f AS (SELECT idempotency_key, k, tick, 'start' AS verdict, h AS bound, ended AS ends, ended IS NULL AS failed FROM c WHERE k = 1 UNION ALL
SELECT c.idempotency_key, c.k, c.tick, v.verdict, f.bound, CASE WHEN v.verdict = 'start' THEN c.ended ELSE f.ends END, CASE WHEN v.verdict = 'start' THEN c.ended IS NULL ELSE f.failed END FROM f JOIN c ON c.idempotency_key = f.idempotency_key AND c.k = f.k + 1, LATERAL (SELECT CASE WHEN f.bound <> c.h THEN 'conflict' WHEN coalesce(f.ends <= c.tick, false) AND NOT c.redeliver THEN 'replay' WHEN NOT coalesce(f.ends <= c.tick, false) AND NOT f.failed THEN 'active' ELSE 'start' END AS verdict) v)
SELECT idempotency_key, verdict, count(*) AS n, round(sum(tick), 3) AS "at" FROM f GROUP BY ALL""")
def job_registry_verdicts(spark, d):
    e, at = F.col("event_id"), F.col("ts").cast("timestamp").cast("double")
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("idempotency_key"), at.alias("at"), (F.floor(e / 97) % 5 == 0).cast("int").cast("string").alias("request_hash"), F.when(e % 6 != 0, at + F.col("value") * 400).alias("ended"), (e % 3 == 0).alias("redeliver"))
    return ops.begin_jobs(rows).groupBy("idempotency_key", "verdict").agg(F.count("*").alias("n"), F.round(F.sum("at"), 3).alias("at"))


@query("WITH j AS (SELECT user_id AS registry, event_id AS job, ts AS started, event_type IN ('click', 'error') AS active, count(*) OVER (PARTITION BY user_id) - 20 AS over FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY registry, active ORDER BY started, job) AS k FROM j) SELECT registry, job, active FROM r WHERE active OR k > over")
def job_registry_pruning(spark, d):
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("registry"), F.col("event_id").alias("job"), F.col("ts").alias("started"), F.col("event_type").isin("click", "error").alias("active"))
    return ops.prune_jobs(rows, 20).select("registry", "job", "active")


@query("SELECT user_id AS job, coalesce(list_aggregate(list_sort(list_distinct(list(upper(event_type)) FILTER (WHERE event_type <> 'view'))), 'string_agg', ','), '') AS warnings FROM events GROUP BY 1")
def warning_union(spark, d):
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("job"), F.when(F.col("event_type") != "view", F.upper("event_type")).alias("warning"))
    return ops.warnings(rows, "job").withColumn("warnings", F.array_join("warnings", ","))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in ops.ERROR_CODES.items()) + ") AS e(code, status)")
def error_codes(spark, d):
    return spark.createDataFrame(list(ops.ERROR_CODES.items()), "code string, status int")
