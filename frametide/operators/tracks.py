"""Associating detections over time and with each other: trackers, text regions, faces and subjects, labels of shots."""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.functions.geometry import contained, iou
from frametide.operators.folds import by_group, fold
from frametide.operators.frames import frames_to_shots

#: Scores of strong and weak detections, largest cost of a match, frames a lost track lives; overlap and gap of text regions.
STRONG, WEAK, MOST_COST, MOST_LOST = 0.5, 0.1, 0.5, 30
TEXT_IOU, TEXT_GAP = 0.30, 15
#: Containment and overlap that tie a face to a subject, overlap that continues a face, and what a face without a subject needs.
CONTAINED, OVERLAP, FACE_IOU, LONELY_SCORE, LONELY_TIMES = 0.85, 0.25, 0.3, 0.9, 2
#: Share of the media a lasting region spans, and the largest variance of its centres.
LASTING_SHARE, LASTING_VARIANCE = 0.40, 0.004


def _areas(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersection and union of every box (x, y, w, h) of ``a`` with every one of ``b``."""
    a, b = a[:, None, :], b[None, :, :]
    wide = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    high = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.maximum(wide, 0) * np.maximum(high, 0)
    return both, a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - both


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of every box (x, y, w, h) of ``a`` with every one of ``b``."""
    both, union = _areas(a, b)
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def _assign(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """One-to-one matches, cheapest first (cost: 1 - overlap), ties in row order."""
    if not len(a) or not len(b):
        return []
    cost = (1 - overlaps(a, b)).astype(np.float32)
    rows, columns, out = set(), set(), []
    for k in np.argsort(cost, axis=None, kind="stable").tolist():
        i, j = divmod(k, len(b))
        if cost[i, j] > MOST_COST:
            break
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((i, j, float(1 - cost[i, j])))
    return out


def track_boxes(boxes: DataFrame) -> DataFrame:
    """(media_id, shot_index, track, frame, det, score, association): strong detections are matched first, weak ones to what is left.

    A strong detection without a match opens a track; a track unmatched for more than ``MOST_LOST`` frames ends. Numbers start anew
    in each shot, so a group is one shot. Weak detections without a match have no row; ``association`` is null where a track opens.
    Tracks end after the matching of a frame; a sampled frame without detections is a row with a null ``det`` and ``score``.
    """

    def run(rows: list[dict]) -> list[tuple]:
        active: list[dict] = []
        lost: list[dict] = []
        out, opened = [], 0
        for frame, group in groupby(rows, key=lambda r: r["frame"]):
            now = list(group)
            box = np.array([[r["x"], r["y"], r["w"], r["h"]] for r in now], dtype=float)
            score = np.array([r["score"] for r in now], dtype=float)
            pool, seen, used = active + lost, set(), set()
            for chosen in (np.flatnonzero(score >= STRONG), np.flatnonzero((score >= WEAK) & (score < STRONG))):
                left = [i for i in range(len(pool)) if i not in seen]
                held = np.array([pool[i]["box"] for i in left]).reshape(-1, 4)
                for i, j, likeness in _assign(held, box[chosen]):
                    d = int(chosen[j])
                    pool[left[i]].update(box=box[d], end=frame)
                    seen.add(left[i])
                    used.add(d)
                    out.append((now[d]["media_id"], now[d]["shot_index"], pool[left[i]]["track"], frame, now[d]["det"], now[d]["score"], likeness))
            active, lost = [x for i, x in enumerate(pool) if i in seen], [x for i, x in enumerate(pool) if i not in seen and frame - x["end"] <= MOST_LOST]
            for d in np.flatnonzero(score >= STRONG).tolist():
                if d not in used:
                    opened += 1
                    active.append({"track": opened, "box": box[d], "end": frame})
                    out.append((now[d]["media_id"], now[d]["shot_index"], opened, frame, now[d]["det"], now[d]["score"], None))
        return out

    return by_group(boxes.select("media_id", "shot_index", "frame", "det", "x", "y", "w", "h", "score"), ["media_id", "shot_index"], ["frame", "det"], run, "media_id long, shot_index long, track long, frame long, det int, score double, association double")


def merge_text(boxes: DataFrame) -> DataFrame:
    """(media_id, shot_index, region, frame, det): each detection joins the unmatched region of greatest overlap, or opens one.

    A region ends ``TEXT_GAP`` frames after its last detection and never crosses a shot; numbers run on over the shots of a media.
    """

    def step(state: dict, r: dict) -> list[tuple]:
        frame, box = r["frame"], np.array([[r["x"], r["y"], r["w"], r["h"]]], dtype=float)
        state["live"] = [x for x in state["live"] if frame - x["end"] <= TEXT_GAP]
        free = [x for x in state["live"] if x["end"] != frame]
        like = overlaps(box, np.array([x["box"] for x in free]).reshape(-1, 4))[0]
        if len(free) and like.max() >= TEXT_IOU:
            mine = free[int(like.argmax())]
        else:
            state["opened"] += 1
            mine = {"region": state["opened"]}
            state["live"].append(mine)
        mine.update(box=box[0], end=frame)
        return [(r["media_id"], r["shot_index"], mine["region"], frame, r["det"])]

    merged = fold(boxes.select("media_id", "shot_index", "frame", "det", "x", "y", "w", "h"), ["media_id", "shot_index"], ["frame", "det"], lambda row: {"live": [], "opened": 0}, step, "media_id long, shot_index long, _in_shot long, frame long, det int")
    number = F.dense_rank().over(Window.partitionBy("media_id").orderBy("shot_index", "_in_shot")).cast("long")
    return merged.withColumn("region", number).drop("_in_shot")


def region_kind(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """persistent_overlay if a region spans enough of its media's ``n_frames`` and its centres hardly move, else ocr_text."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    out = samples.groupBy("media_id", "region").agg((F.max("frame") + 1 - F.min("frame")).alias("span"), (F.var_pop(cx) + F.var_pop(cy)).alias("moved")).join(frames, "media_id")
    lasting = (F.col("n_frames") > 0) & (F.col("span") / F.col("n_frames") >= LASTING_SHARE) & (F.col("moved") <= LASTING_VARIANCE)
    return out.select("media_id", "region", "span", F.when(lasting, "persistent_overlay").otherwise("ocr_text").alias("kind"))


def faces_to_subjects(faces: DataFrame, subjects: DataFrame) -> DataFrame:
    """(media_id, face, subject, n_frames, score): the subject that holds or overlaps a face in at least half of the face's frames.

    Both sides have one box per track and frame. A containment of ``CONTAINED`` scores itself, else an overlap of ``OVERLAP``
    does; the greatest sum wins, then the smallest subject. An equi-join on the frame, so the pairs are those of one frame.
    """
    cols = ("x", "y", "w", "h")
    f = faces.select("media_id", "frame", F.col("track").alias("face"), *[F.col(c).alias(f"f_{c}") for c in cols])
    s = subjects.select("media_id", "frame", F.col("track").alias("subject"), *[F.col(c).alias(f"s_{c}") for c in cols])
    a, b = {c: F.col(f"f_{c}") for c in cols}, {c: F.col(f"s_{c}") for c in cols}
    inside, over = contained(a, b), iou(a, b)
    score = F.when(F.round(inside, 6) >= CONTAINED, inside).when(F.round(over, 6) >= OVERLAP, over)
    pairs = f.join(s, ["media_id", "frame"]).withColumn("score", score).where("score is not null")
    sums = pairs.groupBy("media_id", "face", "subject").agg(F.count("*").alias("n_frames"), F.sum("score").alias("score"))
    seen = f.groupBy("media_id", "face").agg(F.count("*").alias("_seen"))
    w = Window.partitionBy("media_id", "face").orderBy(F.round("score", 6).desc(), "subject")
    return sums.join(seen, ["media_id", "face"]).where("2 * n_frames >= _seen").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_seen")


def densify(track: DataFrame, max_gap: int) -> DataFrame:
    """Every missing frame between two samples of a track that are at most ``max_gap`` frames apart, interpolated; larger gaps stay."""
    w = Window.partitionBy("media_id").orderBy("frame")
    rows = track.withColumns({f"_{c}": F.lead(c).over(w) for c in ("frame", *"xywh")})
    gap = F.col("_frame") - F.col("frame")
    steps = F.when((gap > 1) & (gap <= max_gap), F.sequence(F.col("frame") + 1, F.col("_frame") - 1)).otherwise(F.array().cast("array<long>"))
    filled = rows.withColumn("_at", F.explode(steps)).withColumn("_part", (F.col("_at") - F.col("frame")) / gap)
    filled = filled.select("media_id", F.col("_at").alias("frame"), *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_part")).alias(c) for c in "xywh"], F.lit("interpolated").alias("kind"))
    return track.select("media_id", "frame", *"xywh", F.lit("detected").alias("kind")).union(filled)


def shot_labels(shots: DataFrame, samples: DataFrame, fps: float) -> DataFrame:
    """(media_id, shot_index, persons, label, score): tracks with a sample inside the half-open shot, and the label by their number and the shot's length."""
    inside = frames_to_shots(samples.select("media_id", "frame", "track"), shots.select("media_id", "shot_index", "start_frame", "end_frame")).groupBy("media_id", "shot_index").agg(F.countDistinct("track").alias("_n"))
    n = shots.join(inside, ["media_id", "shot_index"], "left").withColumn("persons", F.coalesce("_n", F.lit(0).cast("long")))
    long = (F.col("end_frame") - F.col("start_frame")) / fps >= 2.0
    choose = lambda none, many, two, talk, other: F.when(F.col("persons") == 0, none).when(F.col("persons") >= 3, many).when(F.col("persons") == 2, two).when(long, talk).otherwise(other)
    return n.select("media_id", "shot_index", "persons", choose("no_person", "multiple_people", "multiple_people", "talking_head", "other").alias("label"), choose(1.0, 0.7, 0.6, 0.4, 0.3).alias("score"))


def face_tracks(boxes: DataFrame) -> DataFrame:
    """(media_id, shot_index, track, frame, det, score, association): the greatest overlaps of at least ``FACE_IOU`` are matched first, ties by the higher track, then detection.

    A track that one sampled frame leaves unmatched ends. Track ids are text (face-SHOT-NUMBER), numbered anew in each shot; a sampled frame without faces is a row with a null ``det``.
    """

    def step(state: dict, frame_rows: list[dict]) -> list[tuple]:
        now = [r for r in frame_rows if r["det"] is not None]
        names = list(state["live"])
        like = overlaps(np.array([state["live"][n] for n in names], dtype=float).reshape(-1, 4), np.array([[r["x"], r["y"], r["w"], r["h"]] for r in now], dtype=float).reshape(-1, 4))
        found = sorted(((like[i, j], names[i], j) for i in range(len(names)) for j in range(len(now)) if like[i, j] >= FACE_IOU), reverse=True)
        out, kept, used = [], {}, set()
        for value, name, j in found:
            if name not in kept and j not in used:
                kept[name] = j
                used.add(j)
                out.append((now[j], name, float(value)))
        live = {n: [now[j]["x"], now[j]["y"], now[j]["w"], now[j]["h"]] for n, j in kept.items()}
        state["live"] = {n: live[n] for n in names if n in live}
        for j, r in enumerate(now):
            if j not in used:
                state["opened"] += 1
                name = f"face-{r['shot_index']:03d}-{state['opened']:03d}"
                state["live"][name] = [r["x"], r["y"], r["w"], r["h"]]
                out.append((r, name, None))
        return [(r["media_id"], r["shot_index"], name, r["frame"], r["det"], r["score"], value) for r, name, value in out]

    def run(rows: list[dict]) -> list[tuple]:
        state, out = {"live": {}, "opened": 0}, []
        for _, group in groupby(rows, key=lambda r: r["frame"]):
            out += step(state, list(group))
        return out

    return by_group(boxes.select("media_id", "shot_index", "frame", "det", "x", "y", "w", "h", "score"), ["media_id", "shot_index"], ["frame", "det"], run, "media_id long, shot_index long, track string, frame long, det int, score double, association double")


def merge_faces(samples: DataFrame) -> DataFrame:
    """(media_id, track, subject, frame, kind, score): fragments of one subject become one face, of each frame the detected, then the highest-scored sample; faces without a subject stay if they score ``LONELY_SCORE`` and were detected ``LONELY_TIMES`` times.

    A face's track is the smallest of its fragments'. ``samples``: (media_id, track, subject or null, frame, kind, score).
    Scores are summed from the highest down, so that a mean at the bound does not depend on the order in which rows arrive.
    """
    detected = (F.col("kind") == "detected").cast("int")
    lonely = samples.where("subject is null")
    mean = F.aggregate(F.sort_array(F.collect_list("score"), False), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.count("score"), F.lit(0))
    strong = lonely.groupBy("media_id", "track").agg(mean.alias("_score"), F.sum(detected).alias("_times")).where((F.col("_score") >= LONELY_SCORE) & (F.col("_times") >= LONELY_TIMES))
    tied = samples.where("subject is not null")
    first = tied.groupBy("media_id", "subject").agg(F.min("track").alias("_track"))
    w = Window.partitionBy("media_id", "subject", "frame").orderBy(detected.desc(), F.coalesce("score", F.lit(0.0)).desc(), "track")
    best = tied.withColumn("_r", F.row_number().over(w)).where("_r = 1").join(first, ["media_id", "subject"])
    columns = ["media_id", "track", "subject", "frame", "kind", "score"]
    return best.withColumn("track", F.col("_track")).select(*columns).union(lonely.join(strong, ["media_id", "track"], "left_semi").select(*columns))


def serialise(samples: DataFrame) -> DataFrame:
    """(media_id, track, aggregate_score, n_samples, samples): each track's samples by frame, and the mean of the scores that are there."""
    listed = F.array_sort(F.collect_list(F.struct("frame", "x", "y", "w", "h", "kind", "score")))
    return samples.groupBy("media_id", "track").agg(F.avg("score").alias("aggregate_score"), F.count("*").alias("n_samples"), listed.alias("samples"))


def boxes_by_frame(tracks: DataFrame) -> DataFrame:
    """(media_id, frame, boxes) from serialised tracks: the boxes that stand in each frame; frames without any have no row."""
    rows = tracks.select("media_id", "track", F.explode("samples").alias("s")).where("s.x is not null").select("media_id", "track", "s.frame", F.struct("s.x", "s.y", "s.w", "s.h").alias("box"))
    return rows.groupBy("media_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("track", "box"))), lambda r: r["box"]).alias("boxes"))


def greedy_matches(predicted: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """(media_id, frame, hits, misses, false_alarms): in order of ``det``, each prediction takes the unused truth of greatest overlap, the later one on ties, if that is at least ``least``."""
    rows = predicted.withColumn("side", F.lit(0)).unionByName(truth.withColumn("side", F.lit(1))).select("media_id", "frame", "side", "det", "x", "y", "w", "h")

    def run(rows: list[dict]) -> list[tuple]:
        box = lambda side: np.array([[r["x"], r["y"], r["w"], r["h"]] for r in rows if r["side"] == side], dtype=float).reshape(-1, 4)
        like = overlaps(box(0), box(1))
        used: set[int] = set()
        for i in range(like.shape[0]):
            best, at = least, -1
            for j in range(like.shape[1]):
                if j not in used and round(like[i, j], 9) >= best:
                    best, at = round(like[i, j], 9), j
            if at >= 0:
                used.add(at)
        return [(rows[0]["media_id"], rows[0]["frame"], len(used), like.shape[1] - len(used), like.shape[0] - len(used))]

    return by_group(rows, ["media_id", "frame"], ["side", "det"], run, "media_id long, frame long, hits long, misses long, false_alarms long")


def detection_scores(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the matches with recall and precision, 1 where nothing was to be found or nothing was predicted."""
    out = matches.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "false_alarms")])
    part = lambda other: F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col(other)), F.lit(1.0))
    return out.withColumn("recall", part("misses")).withColumn("precision", part("false_alarms"))


def distinct_boxes(boxes: DataFrame, least: float = 0.7) -> DataFrame:
    """Boxes of each media, in order of frame and ``det``, that overlap every box kept before them by less than ``least``: intersections are compared with ``least`` times the union, as a quotient would be rounded once more."""

    def step(kept: list, r: dict) -> list[tuple]:
        box = np.array([[r["x"], r["y"], r["w"], r["h"]]], dtype=float)
        if kept:
            both, union = _areas(box, np.array(kept))
            if ((both >= least * union) & (union > 0)).any():
                return []
        kept.append(box[0])
        return [(r["media_id"], r["frame"], r["det"])]

    return fold(boxes.select("media_id", "frame", "det", "x", "y", "w", "h"), ["media_id"], ["frame", "det"], lambda row: [], step, "media_id long, frame long, det int")


def earlier_copy(shots: DataFrame, most_bits: int = 6, most_luma: float = 0.08, most_colour: float = 0.12, side: int = 8) -> DataFrame:
    """(media_id, shot_index, duplicate_of, score): the best earlier shot of the same media whose hash, mean luma and mean colour are near; the earliest on ties, null without one.

    ``shots``: (media_id, shot_index, bits, luma, r, g, b). Candidates come from equal bands of the hash, more bands than bits may differ, so none is lost.
    """
    pairs = near_hashes(shots.select("media_id", F.col("shot_index").alias("frame_index"), "bits"), most_bits, most_bits + 1)
    of = lambda name, key: shots.select("media_id", F.col("shot_index").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("luma", "r", "g", "b")])
    rows = pairs.join(of("a", "frame_a"), ["media_id", "frame_a"]).join(of("b", "frame_b"), ["media_id", "frame_b"])
    luma = F.abs(F.col("a_luma") - F.col("b_luma"))
    colour = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in "rgb"), F.lit(0.0)))
    rows = rows.withColumn("_l", luma).withColumn("_c", colour).where((F.col("_l") <= most_luma) & (F.col("_c") <= most_colour))
    looks = 1 - F.least(F.lit(1.0), F.col("_l") / most_luma + F.col("_c") / most_colour / 2)
    rows = rows.withColumn("score", ((1 - F.col("distance") / (side * side)) + looks) / 2)
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("media_id", "frame_b").orderBy(F.round("score", 9).desc(), "frame_a"))).where("_r = 1")
    best = best.select("media_id", F.col("frame_b").alias("shot_index"), F.col("frame_a").alias("duplicate_of"), "score")
    return shots.select("media_id", "shot_index").join(best, ["media_id", "shot_index"], "left")


def near_hashes(hashes: DataFrame, most: int, bands: int = 7) -> DataFrame:
    """(media_id, frame_a, frame_b, distance): pairs of one media whose bits differ in at most ``most`` places; needs ``bands`` > ``most``.

    With more bands than differing bits one band is equal on both sides, so the equi-join on bands loses no pair. The pair is
    verified in its first equal band only, which makes a distinct superfluous.
    """
    if bands <= most:
        raise ValueError("bands must exceed the distance")
    cut = lambda k: F.slice("bits", F.floor(F.size("bits") * k / bands).cast("int") + 1, (F.floor(F.size("bits") * (k + 1) / bands) - F.floor(F.size("bits") * k / bands)).cast("int"))
    keys = hashes.select("media_id", "frame_index", F.array(*[F.concat_ws("", cut(k).cast("array<string>")) for k in range(bands)]).alias("keys"), "bits")
    rows = keys.select("media_id", "frame_index", "keys", "bits", F.posexplode("keys").alias("band", "key"))
    a = rows.select("media_id", "band", "key", F.col("frame_index").alias("frame_a"), F.col("keys").alias("ka"), F.col("bits").alias("ba"))
    b = rows.select("media_id", "band", "key", F.col("frame_index").alias("frame_b"), F.col("keys").alias("kb"), F.col("bits").alias("bb"))
    first = F.array_position(F.zip_with("ka", "kb", lambda x, y: (x == y).cast("int")), 1) == F.col("band") + 1
    distance = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return a.join(b, ["media_id", "band", "key"]).where(F.col("frame_a") < F.col("frame_b")).where(first).select("media_id", "frame_a", "frame_b", distance.cast("long").alias("distance")).where(F.col("distance") <= most)
