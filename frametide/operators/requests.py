"""Requests: schema rules, routing, limits, grants, stable hashes, the job registry and prior facts.

Validators give a table the first rule a row breaks, null where none is; nothing is raised, so one bad request stops no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.operators.folds import fold

#: Features by kind of media.
VIDEO = ["shots", "subjects", "faces", "ocr", "motion", "quality", "exposure", "thumbnails", "audio", "waveform", "rhythm", "person_matte"]
IMAGE = ["quality", "exposure", "saliency", "focus", "relative_depth", "visual_regions", "faces", "subjects", "ocr", "thumbnails"]
AUDIO = ["audio", "waveform", "rhythm"]
#: Limits of a source, and of the registry.
MAX_SECONDS, SECONDS_SLACK, MAX_SIDE, MAX_BYTES, MAX_DECODED, MAX_JOBS = 60, 0.05, 1920, 80 * 1024 * 1024, 1920 * 1920 * 1800, 1000
#: Error codes and their HTTP statuses.
ERROR_CODES = {
    "INVALID_REQUEST": 400,
    "UNAUTHORIZED": 401,
    "IDEMPOTENCY_CONFLICT": 409,
    "CHECKSUM_MISMATCH": 422,
    "UNSUPPORTED_MEDIA": 415,
    "LIMIT_EXCEEDED": 413,
    "SOURCE_FETCH_FAILED": 502,
    "DECODE_FAILED": 422,
    "FEATURE_UNAVAILABLE": 409,
    "TIMEOUT": 504,
    "CANCELLED": 499,
    "UPLOAD_FAILED": 502,
    "INTERNAL": 500,
}


def first_fault(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule whose condition (a fault) holds; a condition that is null does not."""
    out = None
    for broken, name in rules:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


# ---------------------------------------------------------------- values


def rational_fault(numerator: Column, denominator: Column) -> Column:
    return first_fault([(denominator == 0, "denominator is 0"), ((numerator / F.nullif(denominator, F.lit(0))) <= 0, "rate is not positive")])


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def is_unit_box(x: Column, y: Column, w: Column, h: Column, slack: float = 1e-6) -> Column:
    """Finite, not negative, and inside the unit square but for the slack."""
    finite = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h))
    return F.coalesce(finite & (F.least(x, y, w, h) >= 0) & (x + w <= 1 + slack) & (y + h <= 1 + slack), F.lit(False))


# ---------------------------------------------------------------- whole requests


def contract_fault(r: dict[str, Column]) -> Column:
    """First rule of the request schema that a request breaks. ``r``: kind, features (array), sha256, canonicalize, has_video_facts, has_image_options, neural_beats, has_rhythm_options, has_resolution, grants (array of roles), thumbnail_indexes (array)."""
    kind, features, grants = r["kind"], r["features"], r["grants"]
    allowed = F.when(kind == "video", F.lit(VIDEO)).when(kind == "image", F.lit(IMAGE)).otherwise(F.lit(AUDIO))
    has = lambda a, x: F.array_contains(a, x)
    depth = has(features, "relative_depth")
    rules = [
        (~kind.isin("video", "image", "audio"), "unknown mediaKind"),
        (F.size(features) == 0, "features is empty"),
        (F.size(F.array_except(features, F.lit(sorted({*VIDEO, *IMAGE, *AUDIO})))) > 0, "unknown features"),
        (F.size(F.array_distinct(features)) != F.size(features), "duplicate features"),
        (F.size(F.array_except(features, allowed)) > 0, "features do not suit mediaKind"),
        ((kind != "video") & r["sha256"].isNull(), "source.sha256 is missing"),
        (r["sha256"].isNotNull() & ~is_digest(r["sha256"]), "source.sha256 is no digest"),
        ((kind != "video") & r["has_video_facts"], "video metadata does not suit mediaKind"),
        (r["has_image_options"] & (kind != "image"), "imageOptions needs an image"),
        (r["neural_beats"] & (kind != "audio"), "neuralBeats needs audio"),
        (r["has_rhythm_options"] & ~has(features, "rhythm"), "rhythmOptions needs rhythm"),
        ((kind == "audio") & r["has_resolution"], "audio has no resolution"),
        (depth & ((kind != "image") | ~r["canonicalize"] | ~has(grants, "depthMap")), "relative_depth needs a canonical image and its grant"),
        (~depth & has(grants, "depthMap"), "depthMap needs relative_depth"),
        *[(has(grants, role) & ((kind != of) | ((kind != "video") & ~r["canonicalize"])), f"{role} needs its canonical {of}") for role, of in (("canonicalMp4", "video"), ("canonicalImage", "image"), ("canonicalAudio", "audio"))],
        ((kind != "video") & has(grants, "matteAssets"), "matte grants need a video"),
        ((kind != "video") & has(grants, "thumbnails") & ~has(features, "thumbnails"), "thumbnail grants need thumbnails"),
        ((kind == "image") & has(grants, "thumbnails") & (r["thumbnail_indexes"] != F.array(F.lit(0).cast("long"))), "an image has one thumbnail, index 0"),
    ]
    return first_fault(rules)


def routing_fault(features: Column, role: Column, image: Column, implemented: list[str]) -> Column:
    """Why a worker of this role and image does not serve the features: the error code, null if it does."""
    matte = F.lit(["person_matte"])
    none_of = lambda a: F.size(F.array_except(features, a)) > 0
    rules = [
        ((role == "audio") & none_of(F.lit(AUDIO)), "FEATURE_UNAVAILABLE"),
        ((image == "analysis-cpu") & F.arrays_overlap(features, matte), "INVALID_REQUEST"),
        (image.startswith("matte") & none_of(matte), "FEATURE_UNAVAILABLE"),
        ((role == "general") & F.array_contains(features, "ocr"), "FEATURE_UNAVAILABLE"),
        ((role == "ocr") & none_of(F.lit(["ocr", "shots"])), "FEATURE_UNAVAILABLE"),
        (none_of(F.lit([*implemented, "person_matte"])), "FEATURE_UNAVAILABLE"),
    ]
    return first_fault(rules)


def matte_fault(mode: Column, segmented: Column, n_grants: Column, label: Column, n_shots: Column) -> Column:
    """Why a matte request is refused: whole people over the whole duration with one grant and known shots only."""
    return first_fault([
        (segmented, "segmented delivery is not offered"),
        (mode.isNull(), "matteTarget is missing"),
        (mode == "subject_tracks", "subject_tracks is not offered"),
        (mode != "all_people", "mode must be all_people"),
        (F.coalesce(n_grants, F.lit(0)) != 1, "exactly one matteAssets grant"),
        (F.coalesce(label, F.lit("")) == "", "grant lacks its label"),
        (F.coalesce(n_shots, F.lit(0)) == 0, "shots are missing"),
    ])


def limit_fault(seconds: Column, width: Column, height: Column, frames: Column, byte_count: Column) -> Column:
    """The limit that a source exceeds, null if none."""
    return first_fault([
        (byte_count > MAX_BYTES, "bytes"),
        (seconds > MAX_SECONDS + SECONDS_SLACK, "duration"),
        ((width > MAX_SIDE) | (height > MAX_SIDE), "side"),
        (width.cast("long") * height.cast("long") * frames.cast("long") > MAX_DECODED, "pixels"),
    ])


# ---------------------------------------------------------------- timelines, indexes and grants


def timeline_fault(shots: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, fault): the first rule a media's shots break, in the order given by ``position``: sorted, from 0, to frame_count, inside, without overlap, without gap. Null: a whole timeline."""
    w = Window.partitionBy("media_id").orderBy("position")
    rows = shots.withColumn("_start", F.lag("start_frame").over(w)).withColumn("_end", F.lag("end_frame").over(w))
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    facts = rows.groupBy("media_id").agg(
        any_of(F.col("start_frame") < F.col("_start")).alias("unsorted"), F.min("start_frame").alias("low"), F.max_by("end_frame", F.struct("start_frame", "position")).alias("high"),
        F.max("end_frame").alias("most"), any_of(F.col("start_frame") < F.col("_end")).alias("overlap"), any_of(F.col("start_frame") > F.col("_end")).alias("gap"),
    )
    known = media.join(facts, "media_id", "left")
    fault = first_fault([
        (F.col("frame_count") <= 0, "frame count"), (F.col("low").isNull(), "no shots"), (F.col("unsorted"), "unsorted"), (F.col("low") != 0, "start"), (F.col("high") != F.col("frame_count"), "cover"),
        ((F.col("low") < 0) | (F.col("most") > F.col("frame_count")), "outside"), (F.col("overlap"), "overlap"), (F.col("gap"), "gap"),
    ])
    return known.select("media_id", fault.alias("fault"))


def contiguous_fault(frames: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, fault) of frame streams: indexes must be 0..frame_count - 1 in the order of ``position``, each once."""
    w = Window.partitionBy("media_id").orderBy("position")
    first_seen = F.row_number().over(Window.partitionBy("media_id", "frame").orderBy("position")) == 1
    rows = frames.withColumn("_expected", F.row_number().over(w) - 1).withColumn("_fresh", first_seen)
    wrong = F.col("frame") != F.col("_expected")
    facts = rows.groupBy("media_id").agg(F.count("*").alias("n"), F.min(F.when(wrong | ~F.col("_fresh"), F.struct("position", F.when(~F.col("_fresh"), "duplicate").otherwise("not contiguous").alias("fault")))).alias("first"))
    out = media.join(facts, "media_id", "left")
    return out.select("media_id", F.coalesce(F.col("first.fault"), F.when(F.coalesce("n", F.lit(0)) != F.col("frame_count"), "count")).alias("fault"))


def grant_fault(grants: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, fault): thumbnails need exactly one grant for each shot, with indexes 0..n_shots - 1."""
    facts = grants.groupBy("media_id").agg(F.count("*").alias("n"), F.countDistinct("index").alias("kinds"), F.min("index").alias("low"), F.max("index").alias("high"))
    n, shots = F.coalesce("n", F.lit(0)), F.col("n_shots")
    aligned = (F.col("kinds") == n) & (F.col("low") == 0) & (F.col("high") == n - 1)
    return media.join(facts, "media_id", "left").select("media_id", first_fault([(n == 0, "no grants"), (shots <= 0, "no shots"), (n != shots, "not one grant per shot"), (~aligned, "indexes")]).alias("fault"))


def quality_ranges(media: DataFrame, shots: DataFrame) -> DataFrame:
    """(media_id, start_frame, end_frame, fault): given shots as they are, with INVALID_REQUEST for those outside the media; the whole media where shots are unknown (``shots_given`` false); none where they are given and empty."""
    given = media.where("shots_given").join(shots, "media_id")
    bad = (F.col("start_frame") < 0) | (F.col("end_frame") > F.col("frame_count")) | (F.col("end_frame") <= F.col("start_frame"))
    given = given.select("media_id", "start_frame", "end_frame", F.when(bad, "INVALID_REQUEST").alias("fault"))
    whole = media.where("NOT shots_given AND frame_count > 0").select("media_id", F.lit(0).cast("long").alias("start_frame"), F.col("frame_count").alias("end_frame"), F.lit(None).cast("string").alias("fault"))
    return given.union(whole)


def resolve_shots(media: DataFrame, supplied: DataFrame, prior: DataFrame) -> DataFrame:
    """(media_id, start_frame, end_frame, origin): supplied shots, else prior ones, else INVALID_REQUEST where only filling in (``fill_only``), else the whole media."""
    has = lambda shots, name: shots.select("media_id").distinct().withColumn(name, F.lit(True))
    known = media.join(has(supplied, "_s"), "media_id", "left").join(has(prior, "_p"), "media_id", "left")
    part = lambda rows, origin: rows.select("media_id", "start_frame", "end_frame", F.lit(origin).alias("origin"))
    one = part(known.where("_s").join(supplied, "media_id"), "supplied")
    two = part(known.where("_s IS NULL AND _p").join(prior, "media_id"), "prior")
    none = known.where("_s IS NULL AND _p IS NULL")
    fault = none.where("fill_only").select("media_id", F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"), F.lit("INVALID_REQUEST").alias("origin"))
    whole = none.where("NOT fill_only").select("media_id", F.lit(0).cast("long").alias("start_frame"), F.col("frame_count").alias("end_frame"), F.lit("whole").alias("origin"))
    return one.union(two).union(fault).union(whole)


# ---------------------------------------------------------------- hashes


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with sorted keys; absent values stay as null. Values: booleans, numbers, strings, arrays and structs (whose fields must be named in sorted order)."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def request_hash(r: dict[str, Column], kind: Column) -> Column:
    """SHA-256 of what a request asks for: features sorted, grants by role only, nothing that is signed or expires. ``mediaKind`` counts only where it is not video."""
    fields = {**r, "features": F.array_sort(r["features"])}
    return F.when(kind == "video", F.sha2(canonical_json(fields), 256)).otherwise(F.sha2(canonical_json({**fields, "mediaKind": kind}), 256))


def cache_key(parts: list[Column]) -> Column:
    """SHA-256 of the parts, joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


# ---------------------------------------------------------------- the job registry


def begin_jobs(requests: DataFrame) -> DataFrame:
    """What the registry says to each request, in the order of ``at`` (unique in a key): ``conflict`` (another request has the key), ``replay`` (completed before), ``active`` (still running) or ``start``.

    ``request_hash``, ``ended`` (time at which a started job completes; null: it fails at once) and ``redeliver`` are given. The first request binds a key for good. A task holds the state of one key.
    """

    def step(job: dict, r: dict) -> list[tuple]:
        done = job["ended"] is not None and job["ended"] <= r["at"]
        if job["hash"] is not None and job["hash"] != r["request_hash"]:
            verdict = "conflict"
        elif job["hash"] is not None and done and not r["redeliver"]:
            verdict = "replay"
        elif job["hash"] is not None and not done and job["ended"] is not None:
            verdict = "active"
        else:
            verdict = "start"
            job.update(hash=r["request_hash"], ended=r["ended"])
        return [(r["idempotency_key"], r["at"], verdict)]

    kind = dict(requests.dtypes)["idempotency_key"]
    return fold(requests.select("idempotency_key", "at", "request_hash", "ended", "redeliver"), ["idempotency_key"], ["at"], lambda row: {"hash": None, "ended": None}, step, f"idempotency_key {kind}, at double, verdict string")


def prune_jobs(jobs: DataFrame, most: int = MAX_JOBS) -> DataFrame:
    """Jobs that stay in each registry: beyond ``most`` jobs, as many of the oldest inactive ones go; active ones never do."""
    w = Window.partitionBy("registry")
    rows = jobs.withColumn("_over", F.count("*").over(w) - most).withColumn("_rank", F.row_number().over(Window.partitionBy("registry", "active").orderBy("started", "job")))
    return rows.where(F.col("active") | (F.col("_rank") > F.col("_over"))).drop("_over", "_rank")


def warnings(rows: DataFrame, key: str) -> DataFrame:
    """Sorted distinct warnings of each job; a job without any has an empty array."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set("warning")).alias("warnings"))
