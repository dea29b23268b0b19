"""Order-dependent operators on small cases whose results are known."""

from frametide.operators import audio, tracks

BOX = "media_id long, shot_index long, frame long, det int, x double, y double, w double, h double, score double"


def test_tracker(spark):
    rows = [
        (1, 0, 0, 0, 0.1, 0.1, 0.2, 0.2, 0.9), (1, 0, 0, 1, 0.6, 0.6, 0.2, 0.2, 0.8),
        (1, 0, 5, 0, 0.61, 0.6, 0.2, 0.2, 0.9), (1, 0, 5, 1, 0.11, 0.1, 0.2, 0.2, 0.3),  # the weak one continues track 1
        (1, 0, 20, 0, 0.6, 0.61, 0.2, 0.2, 0.9),  # track 1 is lost
        (1, 0, 35, 0, 0.11, 0.1, 0.2, 0.2, 0.9),  # 30 frames later it is found again
        (1, 0, 70, None, None, None, None, None, None),  # sampled, without detections: the tracks end
        (1, 0, 80, 0, 0.11, 0.1, 0.2, 0.2, 0.9),  # so it is a new one
        (1, 1, 81, 0, 0.11, 0.1, 0.2, 0.2, 0.9), (1, 1, 81, 1, 0.5, 0.5, 0.1, 0.1, 0.2),  # a new shot; a weak detection alone has no row
    ]
    got = tracks.track_boxes(spark.createDataFrame(rows, BOX)).collect()
    assert sorted((r["shot_index"], r["frame"], r["det"], r["track"]) for r in got) == [(0, 0, 0, 1), (0, 0, 1, 2), (0, 5, 0, 2), (0, 5, 1, 1), (0, 20, 0, 2), (0, 35, 0, 1), (0, 80, 0, 3), (1, 81, 0, 1)]
    assert {r["association"] is None for r in got if r["frame"] in (0, 80, 81)} == {True}
    assert tracks.track_boxes(spark.createDataFrame([], BOX)).count() == 0


def test_text_regions(spark):
    rows = [(1, 0, 0, 0, 0.1, 0.1, 0.2, 0.2, 1.0), (1, 0, 0, 1, 0.1, 0.1, 0.2, 0.2, 1.0), (1, 0, 15, 0, 0.1, 0.1, 0.2, 0.2, 1.0), (1, 0, 31, 0, 0.1, 0.1, 0.2, 0.2, 1.0), (1, 1, 32, 0, 0.1, 0.1, 0.2, 0.2, 1.0)]
    got = tracks.merge_text(spark.createDataFrame(rows, BOX)).collect()
    assert sorted((r["frame"], r["det"], r["region"]) for r in got) == [(0, 0, 1), (0, 1, 2), (15, 0, 1), (31, 0, 3), (32, 0, 4)]


def test_onsets_keep_the_anchor(spark):
    peaks = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.03, 2.0), (1, 0.05, 1.5), (1, 0.06, 3.0), (1, 0.5, 0.1)], "media_id long, sec double, strength double")
    got = sorted((r["sec"], r["strength"]) for r in audio.merge_onsets(peaks, 0.04).collect())
    assert got == [(0.03, 2.0), (0.06, 3.0), (0.5, 0.1)]  # 0.05 is 0.05 from the anchor 0.0, so it is accepted; 0.06 replaces it


def test_tempo_runs(spark):
    events = spark.createDataFrame([(1, s) for s in (0.0, 0.5, 1.0, 1.5, 2.0, 5.0, 5.3, 9.0)] + [(2, 1.0)], "media_id long, sec double")
    assert [(r["media_id"], r["start_sec"], r["end_sec"], r["n_intervals"], r["bpm"]) for r in audio.tempo_runs(events, 60, 200).collect()] == [(1, 0.0, 2.0, 4, 120.0)]


def test_near_hashes_lose_no_pair(spark):
    import random

    rnd = random.Random(5)
    base = [[rnd.randint(0, 1) for _ in range(64)] for _ in range(4)]
    rows = []
    for i in range(60):
        bits = list(base[i % 4])
        for k in rnd.sample(range(64), rnd.randint(0, 5)):
            bits[k] ^= 1
        rows.append((1, i, bits))
    want = {(a, b, d) for a in range(60) for b in range(a + 1, 60) if (d := sum(x != y for x, y in zip(rows[a][2], rows[b][2], strict=True))) <= 6}
    got = tracks.near_hashes(spark.createDataFrame(rows, "media_id long, frame_index long, bits array<int>"), 6).collect()
    assert sorted((r["frame_a"], r["frame_b"], r["distance"]) for r in got) == sorted(want)
