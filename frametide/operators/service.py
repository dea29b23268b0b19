"""The service around the measurements: sources and caches, manifests, readiness, capabilities, telemetry, deadlines, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Durations kept of each stage for its percentiles; models that must and may be there.
ROLLING, REQUIRED_CPU, OPTIONAL_CPU, REQUIRED_MATTE = 1024, ["yolox", "yunet", "silero"], ["ppocr"], ["modnet"]


# ---------------------------------------------------------------- sources and caches


def fetched(requests: DataFrame, sources: DataFrame, patterns: list[str], now: Column, most: int) -> DataFrame:
    """(request, byte_count, sha256, status) of each requested address: expiry, then host, then what is there, its size, its declared digest. Failures are rows, nothing is raised.

    ``requests``: (request, url, expires_at, declared), ``sources``: (url, content binary). An equi-join on the address.
    """
    from frametide.operators.control import allowed_urls, freshness

    ok = allowed_urls(requests.select("request", "url"), patterns).select("request", F.lit(True).alias("_host"))
    size, digest = F.octet_length("content"), F.sha2("content", 256)
    rows = requests.join(ok, "request", "left").join(sources, "url", "left").withColumn("_fresh", freshness(F.col("expires_at"), now))
    status = (
        F.when(F.col("_fresh") != "live", "SOURCE_EXPIRED")
        .when(F.col("_host").isNull(), "SOURCE_FETCH_FAILED")
        .when(F.col("content").isNull(), "SOURCE_FETCH_FAILED")
        .when(size > most, "LIMIT_EXCEEDED")
        .when(F.lower("declared") != digest, "CHECKSUM_MISMATCH")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    good = F.col("status") == "ok"
    return rows.select("request", F.when(good, size.cast("long")).alias("byte_count"), F.when(good, digest).alias("sha256"), "status")


def checkout(requests: DataFrame, cache: DataFrame, most: int) -> DataFrame:
    """(request, hit, status): a request whose declared digest is cached takes the cached bytes, checked again for size and digest; others are downloaded."""
    rows = requests.join(cache.select(F.col("key").alias("declared"), "content"), "declared", "left")
    hit = F.col("content").isNotNull()
    status = F.when(~hit, "download").when(F.octet_length("content") > most, "LIMIT_EXCEEDED").when(F.sha2("content", 256) != F.lower("declared"), "CHECKSUM_MISMATCH").otherwise("cached")
    return rows.select("request", hit.alias("hit"), status.alias("status"))


def cache_put(cache: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """The cache (namespace, key, size, mtime) after putting ``entries``: what is there stays and is touched, what is larger than the whole cache is passed over."""
    small = entries.where(F.col("size") <= most)
    both = cache.withColumn("_new", F.lit(0)).unionByName(small.withColumn("_new", F.lit(1)))
    return both.groupBy("namespace", "key").agg(F.min_by("size", F.struct("_new", "mtime")).alias("size"), F.max("mtime").alias("mtime"))


def cache_get(cache: DataFrame, wanted: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """(namespace, key, found): whether a key is there and not older than the time to live (strictly older is gone; 0: none expires)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("mtime")
    fresh = F.lit(True) if ttl_seconds == 0 else age <= ttl_seconds
    return wanted.join(cache, ["namespace", "key"], "left").select("namespace", "key", F.coalesce(F.col("mtime").isNotNull() & fresh, F.lit(False)).alias("found"))


def evict(entries: DataFrame, now: Column, ttl_seconds: int, budget: Column) -> DataFrame:
    """What stays in a cache: expired entries go unless ``protected``; then the oldest unprotected ones go while the total exceeds the budget.

    Going through the entries from the oldest, an entry goes if what is left without all older unprotected ones still exceeds the budget.
    """
    live = entries if ttl_seconds == 0 else entries.where(F.col("protected") | (F.unix_timestamp(now) - F.unix_timestamp("mtime") <= ttl_seconds))
    w = Window.partitionBy("cache")
    gone = F.sum(F.when(~F.col("protected"), F.col("size")).otherwise(0)).over(w.orderBy("mtime", "key").rowsBetween(Window.unboundedPreceding, -1))
    rows = live.withColumn("_left", F.sum("size").over(w) - F.coalesce(gone, F.lit(0)))
    return rows.where(F.col("protected") | (F.col("_left") <= budget)).drop("_left")


# ---------------------------------------------------------------- models


def manifest_state(entries: DataFrame, files: DataFrame, required: list[str], optional: list[str], image: str) -> tuple[DataFrame, DataFrame]:
    """((name, status), (ready, errors)): of each required and optional model whether its manifest entry, its file and the file's digest are there.

    ``entries``: (name, file, sha256), ``files``: (file, digest). Only required models make errors; a CPU image must not hold matte weights.
    """
    spark = entries.sparkSession
    names = spark.createDataFrame([(n, n in required) for n in [*required, *optional]], "name string, required boolean")
    first = entries.groupBy("name").agg(F.min_by(F.struct("file", "sha256"), "file").alias("e"))
    rows = F.broadcast(names).join(first, "name", "left").join(files.withColumnRenamed("file", "_file"), F.col("e.file") == F.col("_file"), "left")
    status = F.when(F.col("e").isNull(), "missing manifest entry").when(F.col("digest").isNull(), "missing file").when(F.lower("e.sha256") != F.col("digest"), "sha256 mismatch").otherwise("loaded")
    models = rows.select("name", "required", status.alias("status"))
    matte = entries.where(F.lit(image == "analysis-cpu") & (F.col("name") == "modnet")).select(F.lit("analysis-cpu must not ship matte weights").alias("error"))
    errors = models.where("required AND status <> 'loaded'").select(F.concat_ws(": ", "status", "name").alias("error")).union(matte.distinct())
    return models.drop("required"), errors.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("error")).alias("errors")).select((F.col("n") == 0).alias("ready"), "errors")


def pinned(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(file, pinned): whether a file has exactly the pinned size and digest."""
    rows = pins.join(files, "file", "left")
    return rows.select("file", F.coalesce((F.col("size") == F.col("pinned_size")) & (F.col("digest") == F.lower("pinned_sha256")), F.lit(False)).alias("pinned"))


def matte_readiness(entry: Column, stub: Column, enabled: Column, benchmarked: Column, reference_mode: Column) -> tuple[Column, Column, Column]:
    """Ready for production (a real model and both gates open), for serving (or reference mode), and the blockers of production."""
    blockers = F.array_compact(F.array(F.when(~entry, "missing modnet manifest entry").when(stub, "modnet artifact is stub/reference-only"), F.when(~F.coalesce(enabled & benchmarked, F.lit(False)), "matte production gate is closed")))
    ready = F.size(blockers) == 0
    return ready, ready | F.coalesce(reference_mode, F.lit(False)), blockers


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))


def capabilities(features: DataFrame, configured: DataFrame, loaded: DataFrame, ready: bool) -> DataFrame:
    """(kind, feature, configured, model_ready, available) of every kind and feature. ``features``: (kind, feature, model or null)."""
    rows = features.join(configured.select("feature").distinct().withColumn("_c", F.lit(True)), "feature", "left").join(loaded.select("model").distinct().withColumn("_m", F.lit(True)), "model", "left")
    on, model = F.col("_c").isNotNull(), F.col("model").isNull() | F.col("_m").isNotNull()
    return rows.select("kind", "feature", on.alias("configured"), model.alias("model_ready"), (on & model & F.lit(ready)).alias("available"))


# ---------------------------------------------------------------- telemetry


def stage_percentiles(rows: DataFrame, most: int = ROLLING) -> DataFrame:
    """(stage, n, p50, p95) of the last ``most`` durations of each stage: the value at rank int(n * q + 0.999999). Negative durations count as 0.

    The last rows of a stage are at most ``most``; they are found by rank before anything is gathered.
    """
    w = Window.partitionBy("stage").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    out = last.groupBy("stage").agg(F.sort_array(F.collect_list(F.greatest(F.lit(0), F.col("duration_ms")))).alias("_v"))
    rank = lambda q: F.element_at("_v", F.greatest(F.lit(1), F.least(F.size("_v"), F.floor(F.size("_v") * q + 0.999999).cast("int"))))
    return out.select("stage", F.size("_v").cast("long").alias("n"), rank(0.50).alias("p50"), rank(0.95).alias("p95"))


def job_rollup(stages: DataFrame) -> DataFrame:
    """(job, stage_ms, n_stages, bytes, peak): milliseconds of each stage of a job as a map, and its counters."""
    each = stages.groupBy("job", "stage").agg(F.sum(F.greatest(F.lit(0), F.col("duration_ms"))).alias("ms"), F.sum("bytes").alias("bytes"), F.max("rss").alias("rss"))
    return each.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("stage_ms"), F.count("*").alias("n_stages"), F.sum("bytes").alias("bytes"), F.max("rss").alias("peak"))


def component_timings(rows: DataFrame) -> DataFrame:
    """(job, component, ms): the seconds measured of each component of a job, summed and cut to whole milliseconds."""
    return rows.groupBy("job", "component").agg(F.floor(F.sum(F.greatest(F.lit(0.0), F.col("seconds"))) * 1000).alias("ms"))


def deadlines(stages: DataFrame, job_seconds: float, stage_seconds: float) -> DataFrame:
    """(job, stage, outcome): ``cancelled`` from the job's cancel time on, ``timeout`` where a stage ends behind the job's deadline or its own, else ``ok``; nothing is judged behind the first that is not ok.

    ``stages``: (job, position, stage, begin, end, job_begin, cancelled_at).
    """
    late = (F.col("end") - F.col("job_begin") > job_seconds) | (F.col("end") - F.col("begin") > stage_seconds)
    outcome = F.when(F.coalesce(F.col("cancelled_at") <= F.col("end"), F.lit(False)), "cancelled").when(late, "timeout").otherwise("ok")
    w = Window.partitionBy("job").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = stages.withColumn("outcome", outcome).withColumn("_bad", F.max((F.col("outcome") != "ok").cast("int")).over(w))
    return rows.where(F.coalesce("_bad", F.lit(0)) == 0).select("job", "stage", "outcome")


def tool_version(text: Column, prefix: str) -> Column:
    """The first word behind ``prefix`` at the start of a line of a tool's banner, null if there is none."""
    found = F.regexp_extract(text, rf"(?m)^[ \t]*{prefix}[ \t]*([^ \t\r\n]+)", 1)
    return F.when(found != "", found)


# ---------------------------------------------------------------- results


def assemble(parts: DataFrame) -> DataFrame:
    """(media_id, features, completed, warnings, document): one JSON document of each media from its feature parts (media_id, feature, status, body or null, warnings array).

    A body stands only beside a completed or partial status; an empty one is kept, as completed and empty is not the same as left out.
    """
    body = F.when(F.col("status").isin("completed", "partial"), F.coalesce("body", F.lit("[]")))
    listed = F.array_sort(F.collect_list(F.struct("feature", "status", body.alias("body"))))
    out = parts.groupBy("media_id").agg(listed.alias("parts"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"))
    done = F.filter("parts", lambda p: p["status"] == "completed")
    document = F.to_json(F.struct(F.map_from_entries(F.transform("parts", lambda p: F.struct(p["feature"], p["status"]))).alias("capabilities"), F.map_from_entries(F.transform(F.filter("parts", lambda p: p["body"].isNotNull()), lambda p: F.struct(p["feature"], p["body"]))).alias("features"), F.col("warnings")))
    return out.select("media_id", F.size("parts").alias("features"), F.size(done).alias("completed"), "warnings", document.alias("document"))


def artifacts(uploads: DataFrame, patterns: list[str], now: Column, most: int) -> DataFrame:
    """(artifact, sha256, byte_count, mime_type, status) of what is to be uploaded: grant, host, digest, size, in this order; a manifest instead of an upload. ``uploads``: (artifact, url, expires_at, declared, content, mime_type)."""
    from frametide.operators.control import allowed_urls, freshness

    ok = allowed_urls(uploads.select("artifact", "url"), patterns).select("artifact", F.lit(True).alias("_host"))
    digest, size = F.sha2("content", 256), F.octet_length("content")
    status = F.when(freshness(F.col("expires_at"), now) != "live", "GRANT_EXPIRED").when(F.col("_host").isNull(), "UPLOAD_FAILED").when(F.lower("declared") != digest, "CHECKSUM_MISMATCH").when(size > most, "LIMIT_EXCEEDED").otherwise("ok")
    return uploads.join(ok, "artifact", "left").select("artifact", digest.alias("sha256"), size.cast("long").alias("byte_count"), "mime_type", status.alias("status"))


def config_fault(values: dict[str, Column]) -> Column:
    """The first setting of the motion and quality measures that is out of its range, null if none. Settings that are not given are not looked at."""
    low = {"window_frames": 1, "sample_stride": 1, "sharpness_width": 1, "sharpness_height": 1, "hash_distance": 0}
    positive = ["consistency_px", "soft_focus", "severe_shake", "luma_distance", "colour_distance"]
    rules = [(values[k] < v, k) for k, v in low.items() if k in values] + [(values[k] <= 0, k) for k in positive if k in values]
    rules += [((values[k] < 0) | (values[k] > 1), k) for k in ("blown_fraction", "crushed_fraction") if k in values]
    rules += [((values[k] <= 0) | (values[k] > 1), k) for k in ("inlier_ratio",) if k in values]
    out = None
    for bad, name in rules:
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out if out is not None else F.lit(None).cast("string")


def read_frames(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """The wanted frames (media_id, frame) with their pixels, null where a frame could not be decoded, and ``fault`` DECODE_FAILED for every row of a media that misses one of them."""
    rows = wanted.join(frames, ["media_id", "frame"], "left")
    value = next(c for c in frames.columns if c not in ("media_id", "frame"))
    missing = F.max(F.col(value).isNull().cast("int")).over(Window.partitionBy("media_id"))
    return rows.withColumn("fault", F.when(missing == 1, "DECODE_FAILED"))
