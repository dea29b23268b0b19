"""Queries of the service operators: sources, caches, manifests, readiness, capabilities, telemetry, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from frametide.operators import requests as ops
from frametide.operators import service
from frametide.plans.registry import query, r6
from frametide.sources import tables as t

_ASKED = "asked AS (SELECT doc_id AS request, 'https://media' || (doc_id % 3)::VARCHAR || CASE WHEN doc_id % 11 = 3 THEN '.evil.test/' ELSE '.example.com/' END || doc_id AS url, CASE doc_id % 13 WHEN 5 THEN '2020-01-01T00:00:00Z' ELSE '2030-01-01T00:00:00Z' END AS expires_at, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ABCD' ELSE upper(sha256(coalesce(text, ''))) END AS declared, CASE WHEN doc_id % 17 <> 4 THEN coalesce(text, '') END AS body FROM documents)"


def _asked(spark, d):
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    url = F.concat(F.lit("https://media"), (k % 3).cast("string"), F.when(k % 11 == 3, ".evil.test/").otherwise(".example.com/"), k.cast("string"))
    return t.table(spark, d, "documents").select(k.alias("request"), url.alias("url"), F.when(k % 13 == 5, "2020-01-01T00:00:00Z").otherwise("2030-01-01T00:00:00Z").alias("expires_at"), F.when(k % 7 == 0, None).when(k % 7 == 1, "ABCD").otherwise(F.upper(F.sha2(text, 256))).alias("declared"), F.when(k % 17 != 4, text).alias("body"))


@query(f"WITH {_ASKED}, v AS (SELECT request, body, CASE WHEN expires_at < '2025' THEN 'SOURCE_EXPIRED' WHEN url LIKE '%evil%' OR body IS NULL THEN 'SOURCE_FETCH_FAILED' WHEN octet_length(encode(body)) > 20000 THEN 'LIMIT_EXCEEDED' WHEN lower(declared) <> sha256(body) THEN 'CHECKSUM_MISMATCH' ELSE 'ok' END AS status FROM asked) SELECT request, CASE WHEN status = 'ok' THEN octet_length(encode(body))::BIGINT END AS byte_count, CASE WHEN status = 'ok' THEN sha256(body) END AS sha256, status FROM v")
def source_fetch(spark, d):
    rows = _asked(spark, d)
    sources = rows.where("body is not null").select("url", F.col("body").cast("binary").alias("content"))
    return service.fetched(rows.drop("body"), sources, ["*.example.com"], F.lit("2025-06-01 00:00:00").cast("timestamp"), 20_000)


@query(f"WITH {_ASKED}, c AS (SELECT DISTINCT upper(sha256(body)) AS key, CASE WHEN octet_length(encode(body)) % 9 = 2 THEN body || 'x' ELSE body END AS content FROM asked WHERE request % 2 = 0 AND body IS NOT NULL) SELECT request, content IS NOT NULL AS hit, CASE WHEN content IS NULL THEN 'download' WHEN octet_length(encode(content)) > 20000 THEN 'LIMIT_EXCEEDED' WHEN sha256(content) <> lower(declared) THEN 'CHECKSUM_MISMATCH' ELSE 'cached' END AS status FROM asked LEFT JOIN c ON key = declared")
def source_checkout(spark, d):
    rows = _asked(spark, d)
    body = F.col("body")
    cache = rows.where("request % 2 = 0 AND body IS NOT NULL").select(F.upper(F.sha2(body, 256)).alias("key"), F.when(F.octet_length(body) % 9 == 2, F.concat(body, F.lit("x"))).otherwise(body).cast("binary").alias("content")).distinct()
    return service.checkout(rows.select("request", "declared"), cache, 20_000)


_ENTRIES = "en AS (SELECT o_custkey::BIGINT AS cache, o_orderkey::BIGINT AS key, floor(o_totalprice)::BIGINT AS size, o_orderdate::TIMESTAMP AS mtime, o_orderkey % 10 = 0 AS protected FROM orders)"


def _entries(spark, d):
    return t.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("cache"), F.col("o_orderkey").cast("long").alias("key"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").cast("timestamp").alias("mtime"), (F.col("o_orderkey") % 10 == 0).alias("protected"))


@query(f"WITH {_ENTRIES}, l AS (SELECT * FROM en WHERE protected OR epoch(TIMESTAMP '1996-06-01') - epoch(mtime) <= 86400 * 700), s AS (SELECT *, sum(size) OVER (PARTITION BY cache) - coalesce(sum(CASE WHEN protected THEN 0 ELSE size END) OVER (PARTITION BY cache ORDER BY mtime, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM l) SELECT cache, key, size FROM s WHERE protected OR rest <= 300000")
def cache_eviction(spark, d):
    return service.evict(_entries(spark, d), F.lit("1996-06-01 00:00:00").cast("timestamp"), 86400 * 700, F.lit(300_000)).select("cache", "key", "size")


@query(f"WITH {_ENTRIES}, a AS (SELECT cache % 3 AS namespace, key % 400 AS key, min(size) AS size, max(mtime) AS mtime FROM en WHERE key % 3 = 0 GROUP BY ALL), b AS (SELECT cache % 3 AS namespace, key % 400 AS key, arg_min(size, epoch(mtime) * 1e7 + size) AS size, max(mtime) AS mtime FROM en WHERE key % 3 <> 0 AND size <= 200000 GROUP BY ALL), p AS (SELECT namespace, key, coalesce(a.size, b.size) AS size, greatest(coalesce(a.mtime, b.mtime), coalesce(b.mtime, a.mtime)) AS mtime FROM a FULL JOIN b USING (namespace, key)) SELECT namespace, key, size, epoch(TIMESTAMP '1998-06-01') - epoch(mtime) <= 86400 * 30 AS found FROM p")
def cache_put_get(spark, d):
    rows = _entries(spark, d).select((F.col("cache") % 3).alias("namespace"), (F.col("key") % 400).alias("short"), "key", "size", "mtime")
    old = rows.where("key % 3 = 0").groupBy("namespace", F.col("short").alias("key")).agg(F.min("size").alias("size"), F.max("mtime").alias("mtime"))
    new = rows.where("key % 3 <> 0").groupBy("namespace", F.col("short").alias("key"), "size", "mtime").agg(F.count("*").alias("n")).drop("n")
    w = t.Window.partitionBy("namespace", "key").orderBy("mtime", "size")
    first = new.where("size <= 200000").withColumn("_r", F.row_number().over(w)).withColumn("_m", F.max("mtime").over(t.Window.partitionBy("namespace", "key"))).where("_r = 1").select("namespace", "key", "size", F.col("_m").alias("mtime"))
    put = service.cache_put(old, first, 200_000)
    found = service.cache_get(put, put.select("namespace", "key"), F.lit("1998-06-01 00:00:00").cast("timestamp"), 86400 * 30)
    return put.select("namespace", "key", "size").join(found, ["namespace", "key"])


@query("WITH names AS (SELECT unnest(['ALGERIA', 'BRAZIL', 'CANADA', 'NARNIA', 'EGYPT']) AS name), e AS (SELECT n_name AS name, n_name || '.onnx' AS file, CASE WHEN n_nationkey % 4 = 2 THEN 'bad' ELSE sha256(n_name) END AS sha256 FROM nation), f AS (SELECT n_name || '.onnx' AS file, sha256(n_name) AS digest FROM nation WHERE n_nationkey % 5 <> 3) SELECT names.name, CASE WHEN e.name IS NULL THEN 'missing manifest entry' WHEN digest IS NULL THEN 'missing file' WHEN sha256 <> digest THEN 'sha256 mismatch' ELSE 'loaded' END AS status FROM names LEFT JOIN e USING (name) LEFT JOIN f USING (file)")
def model_manifest_scan(spark, d):
    n = t.table(spark, d, "nation")
    file = F.concat("n_name", F.lit(".onnx"))
    entries = n.select(F.col("n_name").alias("name"), file.alias("file"), F.when(F.col("n_nationkey") % 4 == 2, "bad").otherwise(F.sha2("n_name", 256)).alias("sha256"))
    files = n.where("n_nationkey % 5 <> 3").select(file.alias("file"), F.sha2("n_name", 256).alias("digest"))
    return service.manifest_state(entries, files, ["ALGERIA", "BRAZIL", "CANADA", "NARNIA"], ["EGYPT"], "analysis-gpu")[0]


@query("SELECT n_name AS file, n_nationkey % 5 <> 3 AND n_nationkey % 4 <> 2 AND n_nationkey % 7 <> 6 AS pinned FROM nation")
def model_pin_check(spark, d):
    n = t.table(spark, d, "nation")
    files = n.where("n_nationkey % 5 <> 3").select(F.col("n_name").alias("file"), F.length("n_name").alias("size"), F.sha2("n_name", 256).alias("digest"))
    pins = n.select(F.col("n_name").alias("file"), (F.length("n_name") + F.when(F.col("n_nationkey") % 7 == 6, 1).otherwise(0)).alias("pinned_size"), F.when(F.col("n_nationkey") % 4 == 2, "bad").otherwise(F.upper(F.sha2("n_name", 256))).alias("pinned_sha256"))
    return service.pinned(files, pins)


@query("WITH b AS (SELECT event_id, event_id % 2 = 0 AS entry, event_id % 3 = 0 AS stub, event_id % 5 > 0 AND event_id % 7 > 0 AS gate, event_id % 4 = 1 AS reference FROM events), c AS (SELECT *, concat_ws('; ', CASE WHEN NOT entry THEN 'missing modnet manifest entry' WHEN stub THEN 'modnet artifact is stub/reference-only' END, CASE WHEN NOT gate THEN 'matte production gate is closed' END) AS blockers FROM b) SELECT event_id, blockers = '' AS production, blockers = '' OR reference AS serving, blockers FROM c")
def matte_gates(spark, d):
    e = F.col("event_id")
    mode = F.when(e % 4 == 1, F.lit(" Yes ")).otherwise("off")
    ready, serving, blockers = service.matte_readiness(e % 2 == 0, e % 3 == 0, e % 5 > 0, e % 7 > 0, service.truthy(mode))
    return t.table(spark, d, "events").select("event_id", ready.alias("production"), serving.alias("serving"), F.concat_ws("; ", blockers).alias("blockers"))


_FEATURES = [(k, f, {"subjects": "yolox", "faces": "yunet", "ocr": "ppocr", "person_matte": "modnet", "relative_depth": "depth"}.get(f)) for k, names in (("video", ops.VIDEO), ("image", ops.IMAGE), ("audio", ops.AUDIO)) for f in names]


@query("WITH f(kind, feature, model) AS (VALUES " + ", ".join(f"('{k}', '{f}', {repr(m) if m else 'NULL'})" for k, f, m in _FEATURES) + ") SELECT kind, feature, feature <> 'rhythm' AS configured, model IS NULL OR model IN ('yolox', 'ppocr') AS model_ready, feature <> 'rhythm' AND (model IS NULL OR model IN ('yolox', 'ppocr')) AS available FROM f")
def capability_document(spark, d):
    features = spark.createDataFrame(_FEATURES, "kind string, feature string, model string")
    loaded = spark.createDataFrame([("yolox",), ("ppocr",)], "model string")
    return service.capabilities(features, features.where("feature <> 'rhythm'").select("feature"), loaded, True)


@query("WITH e AS (SELECT event_type AS stage, floor(value)::BIGINT - 20 AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT stage, greatest(0, v) AS v FROM e WHERE r <= 100), s AS (SELECT *, count(*) OVER (PARTITION BY stage) AS n, row_number() OVER (PARTITION BY stage ORDER BY v) AS i FROM k) SELECT stage, n, max(v) FILTER (WHERE i = greatest(1, floor(n * 0.50 + 0.999999))) AS p50, max(v) FILTER (WHERE i = greatest(1, floor(n * 0.95 + 0.999999))) AS p95 FROM s GROUP BY ALL")
def stage_rolling_percentiles(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.floor("value") - 20).alias("duration_ms"), "ts", "event_id")
    return service.stage_percentiles(e, 100)


@query("WITH e AS (SELECT user_id * 100 + event_id % 3 AS job, event_type AS stage, greatest(0, floor(value)::BIGINT - 20) AS ms, length(props) AS bytes, event_id % 1000 AS rss FROM events) SELECT job, sum(ms)::BIGINT AS total_ms, count(DISTINCT stage) AS n_stages, sum(bytes)::BIGINT AS bytes, max(rss) AS peak, coalesce(sum(ms) FILTER (WHERE stage = 'view'), -1)::BIGINT AS view_ms FROM e GROUP BY 1")
def job_telemetry(spark, d):
    e = t.table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 3).alias("job"), F.col("event_type").alias("stage"), (F.floor("value") - 20).alias("duration_ms"), F.length("props").cast("long").alias("bytes"), (F.col("event_id") % 1000).alias("rss"))
    out = service.job_rollup(e)
    return out.select("job", F.aggregate(F.map_values("stage_ms"), F.lit(0).cast("long"), lambda s, v: s + v).alias("total_ms"), "n_stages", "bytes", "peak", F.coalesce(F.col("stage_ms")["view"], F.lit(-1).cast("long")).alias("view_ms"))


@query("SELECT user_id AS job, event_type AS component, floor(sum(greatest(0, round((value - 20) / 1000, 6))) * 1000 + 1e-7)::BIGINT AS ms FROM events GROUP BY ALL")
def matte_component_timings(spark, d):
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("component"), (F.round((F.col("value") - 20) / 1000, 6) + F.lit(1e-12)).alias("seconds"))
    return service.component_timings(rows)


@query("WITH e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, event_type AS stage, floor(value) AS took, event_id % 50 = 3 AS c FROM events), s AS (SELECT *, sum(took) OVER (PARTITION BY job ORDER BY position) AS fin FROM e), o AS (SELECT *, CASE WHEN c THEN 'cancelled' WHEN fin > 400 OR took > 60 THEN 'timeout' ELSE 'ok' END AS outcome FROM s), b AS (SELECT *, coalesce(max((outcome <> 'ok')::INT) OVER (PARTITION BY job ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM o) SELECT job, stage, outcome FROM b WHERE bad = 0")
def stage_deadlines(spark, d):
    w = t.Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.table(spark, d, "events").select(F.col("user_id").alias("job"), F.row_number().over(w).alias("position"), F.col("event_type").alias("stage"), F.sum(F.floor("value")).over(w).cast("double").alias("end"), F.floor("value").alias("took"), "event_id")
    rows = e.withColumn("begin", F.col("end") - F.col("took")).withColumn("job_begin", F.lit(0.0)).withColumn("cancelled_at", F.when(F.col("event_id") % 50 == 3, F.col("end")))
    return service.deadlines(rows, 400.0, 60.0)


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN page_id::VARCHAR || '.2' ELSE 'n' || page_id END AS version FROM pages")
def tool_banner_versions(spark, d):
    k = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 3 == 0, F.lit("nothing\nabout x version 3")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("head\n  ffmpeg version "), k, F.lit(".2 Copyright\nconfiguration: --x"))).otherwise(F.concat(F.lit("ffmpeg version   n"), k))
    return t.table(spark, d, "pages").select("page_id", service.tool_version(text, "ffmpeg version").alias("version"))


_PARTS = "cn AS (SELECT user_id AS media_id, event_type AS feature, count(*) AS n FROM events GROUP BY ALL), pt AS (SELECT media_id, feature, CASE n % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN n % 3 > 0 THEN '[' || n || ']' END AS body, [upper(feature), 'W' || (n % 2)] AS warnings FROM cn)"


@query(f"""WITH {_PARTS}, b AS (SELECT *, CASE WHEN status <> 'failed' THEN coalesce(body, '[]') END AS shown FROM pt) SELECT media_id, count(*)::INT AS features, sum((status = 'completed')::INT)::INT AS completed, '{{"capabilities":{{' || string_agg('"' || feature || '":"' || status || '"', ',' ORDER BY feature) || '}},"features":{{' || coalesce(string_agg('"' || feature || '":"' || shown || '"', ',' ORDER BY feature) FILTER (WHERE shown IS NOT NULL), '') || '}},"warnings":["' || list_aggregate(list_sort(list_distinct(flatten(list(warnings)))), 'string_agg', '","') || '"]}}' AS document FROM b GROUP BY 1""")
def result_assembly(spark, d):
    n = F.count("*")
    parts = t.table(spark, d, "events").groupBy(F.col("user_id").alias("media_id"), F.col("event_type").alias("feature")).agg(n.alias("n"))
    k = F.col("n")
    parts = parts.select("media_id", "feature", F.when(k % 4 == 0, "failed").when(k % 4 == 1, "partial").otherwise("completed").alias("status"), F.when(k % 3 > 0, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).alias("body"), F.array(F.upper("feature"), F.concat(F.lit("W"), (k % 2).cast("string"))).alias("warnings"))
    return service.assemble(parts).drop("warnings")


@query("SELECT l_orderkey * 10 + l_linenumber AS box, count(*) AS n, count(CASE WHEN l_suppkey % 5 <> 2 THEN 1 END) AS mapped FROM lineitem GROUP BY 1")
def analysis_box_map(spark, d):
    from frametide.functions.geometry import map_box

    aw = F.when(F.col("l_suppkey") % 5 == 2, 700).otherwise(640)
    x = map_box(F.col("l_quantity"), aw, F.lit(360), F.lit(1280), F.lit(720))
    return t.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box")).agg(F.count("*").alias("n"), F.count(x).alias("mapped"))


_PUT = "put AS (SELECT doc_id AS artifact, 'https://' || CASE WHEN doc_id % 11 = 3 THEN 'evil.test/' ELSE 'put.example.com/' END || doc_id AS url, CASE doc_id % 13 WHEN 5 THEN '2020-01-01T00:00:00Z' ELSE '2030-01-01T00:00:00Z' END AS expires_at, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ABCD' ELSE sha256(coalesce(text, '')) END AS declared, coalesce(text, '') AS body FROM documents)"


@query(f"WITH {_PUT} SELECT artifact, sha256(body) AS sha256, octet_length(encode(body))::BIGINT AS byte_count, 'image/png' AS mime_type, CASE WHEN expires_at < '2025' THEN 'GRANT_EXPIRED' WHEN url LIKE '%evil%' THEN 'UPLOAD_FAILED' WHEN declared <> sha256(body) THEN 'CHECKSUM_MISMATCH' WHEN octet_length(encode(body)) > 20000 THEN 'LIMIT_EXCEEDED' ELSE 'ok' END AS status FROM put")
def artifact_manifest(spark, d):
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    url = F.concat(F.lit("https://"), F.when(k % 11 == 3, "evil.test/").otherwise("put.example.com/"), k.cast("string"))
    rows = t.table(spark, d, "documents").select(k.alias("artifact"), url.alias("url"), F.when(k % 13 == 5, "2020-01-01T00:00:00Z").otherwise("2030-01-01T00:00:00Z").alias("expires_at"), F.when(k % 7 == 0, None).when(k % 7 == 1, "ABCD").otherwise(F.sha2(text, 256)).alias("declared"), text.cast("binary").alias("content"), F.lit("image/png").alias("mime_type"))
    return service.artifacts(rows, ["*.example.com"], F.lit("2025-06-01 00:00:00").cast("timestamp"), 20_000)


@query("SELECT event_id, CASE WHEN event_id % 7 < 1 THEN 'window_frames' WHEN event_id % 3 - 1 < 0 THEN 'hash_distance' WHEN event_id % 5 <= 0 THEN 'soft_focus' WHEN value / 300 > 1 THEN 'blown_fraction' WHEN value / 200 <= 0 OR value / 200 > 1 THEN 'inlier_ratio' END AS fault FROM events")
def config_guards(spark, d):
    e, v = F.col("event_id"), F.col("value")
    fault = service.config_fault({"window_frames": e % 7, "hash_distance": e % 3 - 1, "soft_focus": e % 5, "blown_fraction": v / 300, "inlier_ratio": v / 200})
    return t.table(spark, d, "events").select("event_id", fault.alias("fault"))


@query(f"WITH {t.SHOTS}, w AS (SELECT media_id, shot_index, start_frame + (end_frame - start_frame) // 2 AS frame FROM shots), r AS (SELECT *, CASE WHEN frame % 17 <> 3 THEN frame * 3 END AS value FROM w) SELECT media_id, shot_index, frame, value, CASE WHEN bool_or(value IS NULL) OVER (PARTITION BY media_id) THEN 'DECODE_FAILED' END AS fault FROM r")
def representative_reads(spark, d):
    s = t.shots(spark, d)
    wanted = s.select("media_id", "shot_index", (F.col("start_frame") + F.floor((F.col("end_frame") - F.col("start_frame")) / 2)).alias("frame"))
    frames = s.select("media_id", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame")).where("frame % 17 <> 3").withColumn("value", F.col("frame") * 3)
    return service.read_frames(wanted, frames)


@query("WITH a AS (SELECT user_id AS media_id, unnest(['faces', 'ocr', 'shots']) AS feature FROM events GROUP BY 1), p AS (SELECT media_id, feature, CASE (media_id + length(feature)) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN media_id % 3 > 0 THEN '[1]' END AS body FROM a WHERE feature <> 'shots') SELECT media_id, feature, coalesce(status, 'failed') AS status, CASE WHEN status IN ('completed', 'partial') THEN coalesce(body, '[]') END AS body FROM a LEFT JOIN p USING (media_id, feature)")
def empty_results(spark, d):
    from frametide.operators import features

    asked = t.table(spark, d, "events").select(F.col("user_id").alias("media_id")).distinct().select("media_id", F.explode(F.array(F.lit("faces"), F.lit("ocr"), F.lit("shots"))).alias("feature"))
    k = (F.col("media_id") + F.length("feature")) % 4
    parts = asked.where("feature <> 'shots'").select("media_id", "feature", F.when(k == 0, "failed").when(k == 1, "partial").otherwise("completed").alias("status"), F.when(F.col("media_id") % 3 > 0, "[1]").alias("body"))
    return features.empty_results(parts, asked)


@query("SELECT n_name AS name, 'quality-v1-sf120-sh0.0065' AS policy_version FROM nation")
def policy_versions(spark, d):
    from frametide.operators import shots

    return t.table(spark, d, "nation").select(F.col("n_name").alias("name"), shots.policy_version("quality-v1", {"sf": 120, "sh": 0.0065}).alias("policy_version"))
