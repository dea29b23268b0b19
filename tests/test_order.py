"""Order-dependent and file operators on small cases whose results are known."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.operators import frames, images, requests, shots, spectral, tracks
from frametide.operators.folds import fold
from frametide.sources import media_files

BOX = "media_id long, shot_index long, frame long, det int, x double, y double, w double, h double, score double"


def test_fold_spans_batches(spark):
    df = spark.range(0, 50_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))

    def step(state, row):
        state["sum"] += row["v"]
        return []

    got = fold(df, ["k"], ["v"], lambda row: {"k": row["k"], "sum": 0}, step, "k long, total long", lambda s: [(s["k"], s["sum"])]).collect()
    assert {r["k"]: r["total"] for r in got} == {k: sum(range(k, 50_000, 3)) for k in range(3)}
    assert fold(df.limit(0), ["k"], ["v"], lambda row: {}, step, "k long, total long", lambda s: []).count() == 0


def test_faces_end_after_one_miss(spark):
    rows = [
        (1, 0, 0, 0, 0.1, 0.1, 0.2, 0.2, 0.9), (1, 0, 0, 1, 0.6, 0.6, 0.2, 0.2, 0.8),
        (1, 0, 5, 0, 0.61, 0.6, 0.2, 0.2, 0.9),  # face 1 is missed
        (1, 0, 10, 0, 0.1, 0.1, 0.2, 0.2, 0.9), (1, 0, 10, 1, 0.61, 0.6, 0.2, 0.2, 0.9),
        (1, 0, 15, None, None, None, None, None, None),  # sampled, no face
        (1, 0, 20, 0, 0.61, 0.6, 0.2, 0.2, 0.9), (1, 1, 21, 0, 0.61, 0.6, 0.2, 0.2, 0.9),
    ]
    got = tracks.face_tracks(spark.createDataFrame(rows, BOX)).collect()
    assert sorted((r["frame"], r["det"], r["track"]) for r in got) == [(0, 0, "face-000-001"), (0, 1, "face-000-002"), (5, 0, "face-000-002"), (10, 0, "face-000-003"), (10, 1, "face-000-002"), (20, 0, "face-000-004"), (21, 0, "face-001-001")]


def test_face_ties_go_to_the_higher_track(spark):
    rows = [(1, 0, 0, 0, 0.1, 0.1, 0.2, 0.2, 0.9), (1, 0, 0, 1, 0.1, 0.1, 0.2, 0.2, 0.9), (1, 0, 5, 0, 0.1, 0.1, 0.2, 0.2, 0.9)]
    got = tracks.face_tracks(spark.createDataFrame(rows, BOX)).where("frame = 5").collect()
    assert [r["track"] for r in got] == ["face-000-002"]


def plain_tracker(rows):
    """The two-stage tracker once more, with plain loops over one shot."""
    out, alive, number = [], [], 0

    def like(a, b):
        wide, high = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        both = max(wide, 0) * max(high, 0)
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    for frame in sorted({r[2] for r in rows}):
        now = sorted((r for r in rows if r[2] == frame), key=lambda r: r[3])
        pool, taken = sorted(alive, key=lambda x: (x["lost"], x["order"])), set()
        used = set()
        for low, high in ((0.5, 2), (0.1, 0.5)):
            some = [r for r in now if low <= r[8] < high]
            pairs = sorted(((np.float32(1 - like(x["box"], r[4:8])), i, j) for i, x in enumerate(pool) if id(x) not in taken for j, r in enumerate(some)), key=lambda p: p[0])
            gone = set()
            for cost, i, j in pairs:
                if cost <= 0.5 and i not in gone and some[j][3] not in used:
                    gone.add(i)
                    used.add(some[j][3])
                    taken.add(id(pool[i]))
                    pool[i].update(box=some[j][4:8], end=frame)
                    out.append((frame, some[j][3], pool[i]["track"]))
        for x in pool:
            x["lost"] = id(x) not in taken
        alive = [x for x in pool if not x["lost"]] + [x for x in pool if x["lost"] and frame - x["end"] <= 30]
        for r in now:
            if r[8] >= 0.5 and r[3] not in used:
                number += 1
                alive.append({"track": number, "box": r[4:8], "end": frame, "lost": False, "order": 0})
                out.append((frame, r[3], number))
        alive = [x for x in alive if not x["lost"]] + [x for x in alive if x["lost"]]
        for i, x in enumerate(alive):
            x["order"] = i
    return sorted(out)


def test_tracker_against_plain_loops(spark):
    rng = random.Random(7)
    rows = []
    for frame in range(0, 120, 4):
        for det in range(rng.randrange(1, 5)):
            rows.append((1, 0, frame, det, rng.choice([0.1, 0.4, 0.7]) + rng.uniform(0, 0.08), 0.2 + rng.uniform(0, 0.08), 0.2, 0.3, rng.choice([0.05, 0.2, 0.4, 0.6, 0.9])))
    got = tracks.track_boxes(spark.createDataFrame(rows, BOX)).collect()
    assert sorted((r["frame"], r["det"], r["track"]) for r in got) == plain_tracker(rows)


def test_runs_end_where_a_window_is_missing(spark):
    rows = [(1, 0, 15, "pan", 1.0, 0.5), (1, 15, 30, "pan", 2.0, 0.7), (1, 45, 60, "pan", 3.0, 0.9), (1, 60, 75, "tilt", 1.0, 1.5)]
    got = frames.camera_runs(spark.createDataFrame(rows, "media_id long, start_frame long, end_frame long, kind string, magnitude double, score double")).collect()
    assert sorted((r["start_frame"], r["end_frame"], r["kind"], r["magnitude"], round(r["score"], 6)) for r in got) == [(0, 30, "pan", 1.5, 0.6), (45, 60, "pan", 3.0, 0.9), (60, 75, "tilt", 1.0, 1.0)]


def test_text_bands_are_top_and_bottom(spark):
    rows = [(1, 0, 0, i, 0.1, y, 0.1, 0.1, 1.0) for i, y in enumerate((0.0, 0.15, 0.16, 0.5, 0.79, 0.8, 0.9))]
    assert sorted(r["det"] for r in frames.text_bands(spark.createDataFrame(rows, BOX)).collect()) == [0, 1, 5, 6]


def test_suppression_keeps_at_most(spark):
    rows = [(1, 0, 0, i, i * 0.01, 0.1, 0.005, 0.1, 0.5) for i in range(130)]
    got = sorted(r["det"] for r in frames.nms(spark.createDataFrame(rows, BOX)).collect())
    assert got == list(range(30, 130))  # equal scores: the higher index first, a hundred at most


@pytest.mark.parametrize("url,ok", [("https://example.com/x", True), ("https://example.com:x@evil.test/", False), ("https://user@a.example.com:8443/x", True), ("ftp://example.com/", False), ("HTTP://example.com", False), ("https://a.example.org", False), ("https://evil.test/?@example.com", False), ("https://evil.test#@example.com/", False), ("https://example.com", True)])
def test_addresses(spark, url, ok):
    from frametide.operators.control import allowed_urls

    df = spark.createDataFrame([(1, url)], "id int, url string")
    assert allowed_urls(df, ["example.com", "*.example.com"]).count() == int(ok)


def test_job_registry(spark):
    rows = [("a", 1.0, "h", 5.0, False), ("a", 2.0, "h", None, False), ("a", 6.0, "h", 7.0, False), ("a", 8.0, "g", 9.0, False), ("a", 9.0, "h", 20.0, True), ("a", 10.0, "h", 11.0, False), ("b", 1.0, "h", None, False), ("b", 2.0, "h", 3.0, False)]
    got = requests.begin_jobs(spark.createDataFrame(rows, "idempotency_key string, at double, request_hash string, ended double, redeliver boolean")).collect()
    assert sorted((r["idempotency_key"], r["at"], r["verdict"]) for r in got) == [("a", 1.0, "start"), ("a", 2.0, "active"), ("a", 6.0, "replay"), ("a", 8.0, "conflict"), ("a", 9.0, "start"), ("a", 10.0, "active"), ("b", 1.0, "start"), ("b", 2.0, "start")]


def test_cuts_keep_their_distance(spark):
    content = [0, 1, 1, 1, 30, 1, 1, 1, 40, 1, 1] + [1] * 20 + [50] + [1] * 5
    rows = [(1, i, float(c)) for i, c in enumerate(content)]
    cuts = shots.adaptive_cuts(spark.createDataFrame(rows, "media_id long, frame long, content double"))
    assert [r["frame"] for r in cuts.collect()] == [31]  # the first two lie within fifteen frames of the start
    found = shots.shots_from_cuts(cuts, spark.createDataFrame([(1, len(rows)), (2, 9)], "media_id long, frame_count long")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 0, 31, "start", 0.8), (1, 1, 31, 37, "hard_cut", 0.8), (2, 0, 0, 9, "end", 1.0)]


def test_wav_files(spark):
    x = np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000) * 0.5
    good = media_files.wav(x, 8000)
    floats = good[:20] + struct.pack("<HHIIHH", 3, 1, 16000, 64000, 4, 32) + b"data" + struct.pack("<I", 12) + np.array([0.5, 2.0, -3.0], "<f4").tobytes()
    broken = good[:20] + struct.pack("<HHIIHH", 3, 1, 16000, 64000, 4, 32) + b"data" + struct.pack("<I", 4) + np.array([np.nan], "<f4").tobytes()
    rows = [("a", good), ("b", b""), ("c", None), ("d", floats), ("e", broken), ("f", media_files.wav(np.zeros(0), 8000)), ("g", media_files.wav(np.zeros((8, 9)), 8000)), ("h", b"RIFF0000WAVEfmt ")]
    df = spark.createDataFrame(rows, "path string, content binary")
    status = {r["path"]: r["status"] for r in media_files.probe_audio(df).collect()}
    assert status == {"a": "ok", "b": "UNSUPPORTED_MEDIA", "c": "UNSUPPORTED_MEDIA", "d": "ok", "e": "DECODE_FAILED", "f": "AUDIO_ABSENT", "g": "LIMIT_EXCEEDED", "h": "UNSUPPORTED_MEDIA"}
    got = {r["path"]: r["samples"] for r in media_files.pcm(df).collect()}
    assert set(got) == {"a", "d"} and got["d"] == [0.5, 1.0, -1.0] and len(got["a"]) == 16000
    want = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000) * 0.5
    assert np.abs(np.array(got["a"]) - want)[200:-200].max() < 0.01


def test_png_files(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 3))
    lines, above = b"", np.zeros(21, int)
    for y, row in enumerate(pixels.reshape(5, 21)):  # one line of each filter
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        paeth = np.select([(abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), abs(p - above) <= abs(p - corner)], [left, above], corner)
        guess = [0, left, above, (left + above) // 2, paeth][y]
        lines += bytes([y]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = lambda w, h, depth=8, kind=2, lace=0: media_files._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, lace))
    filtered = head(7, 5) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    alpha = media_files.png(np.array([[[10, 20, 30, 0], [10, 20, 30, 255]]]))
    rows = [("a", filtered), ("b", alpha), ("c", head(7, 5, 16)), ("d", head(7, 5, 8, 3)), ("e", head(9000, 9000)), ("f", head(7, 5) + chunk(b"IDAT", b"no")), ("g", None), ("h", head(7, 5) + chunk(b"acTL", b"\0" * 8))]
    got = {r["path"]: r for r in media_files.decode_images(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "ok", "c": "UNSUPPORTED_MEDIA", "d": "UNSUPPORTED_MEDIA", "e": "LIMIT_EXCEEDED", "f": "DECODE_FAILED", "g": "UNSUPPORTED_MEDIA", "h": "UNSUPPORTED_MEDIA"}
    assert [got["a"][c] for c in "rgb"] == [pixels[..., k].ravel().tolist() for k in range(3)]
    assert [got["b"][c] for c in "rgb"] == [[255, 10], [255, 20], [255, 30]]


def test_box_mean_and_upsample():
    a = np.random.default_rng(2).random((6, 9))
    mirror = lambda i, n: abs(i) if i < n else 2 * n - 2 - i
    want = [[np.mean([a[mirror(y + dy, 6), mirror(x + dx, 9)] for dy in range(-2, 3) for dx in range(-2, 3)]) for x in range(9)] for y in range(6)]
    assert np.allclose(images.box_mean(a, 2), want)
    assert np.allclose(images.resize(a, 6, 9), a) and np.allclose(images.resize(a, 3, 3), a.reshape(3, 2, 3, 3).mean(axis=(1, 3)))
    image = np.zeros((16, 16, 3))
    image[:, 8:] = 255
    alpha = np.zeros((8, 8))
    alpha[:, 4:] = 255
    matte = images.upsample_alpha(alpha, image)
    assert (matte[:, :7] <= 5).all() and (matte[:, 9:] >= 250).all()  # the edge of the image sharpens that of the matte
    assert (images.upsample_alpha(np.zeros((4, 4)), image) == 0).all()


def test_regions_join_over_corners():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 1, 0]], bool)
    assert images.regions_of(mask).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3], [4, 0, 3, 0]]


def test_click_track_has_a_tempo(spark):
    rate, hop = 16000, 512
    flux = np.zeros(300)
    flux[::16] = 1.0  # every 16 steps of 32 ms: 117.19 beats a minute
    rows = [(1, i, float(v)) for i, v in enumerate(flux)] + [(2, i, 0.5) for i in range(300)] + [(3, i, float(i % 2)) for i in range(10)]
    got = {r["media_id"]: r["bpm"] for r in spectral.tempo(spark.createDataFrame(rows, "media_id long, sample_index long, x double"), rate, hop).collect()}
    assert got == {1: round(60 * rate / (16 * hop), 2), 2: None, 3: None}


def test_flux_of_a_step(spark):
    x = np.concatenate([np.zeros(64), np.sin(np.arange(64) * 2 * np.pi / 8)])
    rows = [(1, i, float(v)) for i, v in enumerate(x)]
    got = spectral.flux(spectral.chunks(spark.createDataFrame(rows, "media_id long, sample_index long, x double"), 37), 8.0, 16, 4, {"all": (0, 5)}).collect()
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 15)
    m = [np.abs(np.fft.rfft(x[a : a + 16] * window)) for a in range(0, len(x) - 15, 4)]
    assert np.allclose([r["flux"] for r in sorted(got, key=lambda r: r["frame"])], [np.maximum(b - a, 0).sum() for a, b in zip(m, m[1:], strict=False)])
