"""Comparisons and means whose result hangs on the last bit, against the SQL or on known cases."""

import duckdb

from frametide.operators import frames, sampling, tracks
from frametide.plans import catalogue

MID = "/root/testdata/sf0.01"


def test_motion_windows_to_the_last_digit(spark):
    got = catalogue.QUERIES["motion_windows_circular_mean"](spark, MID).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{MID}/events.parquet'")
    want = con.execute(catalogue.ORACLES["motion_windows_circular_mean"]).df()[list(got.columns)]
    rows = lambda df: sorted(map(str, df.fillna(9.0).itertuples(index=False, name=None)))
    assert rows(got.astype(float)) == rows(want.astype(float))


def test_motion_windows_do_not_depend_on_layout(spark):
    pairs = spark.createDataFrame([(1, 2 * i, v, 0.1, 0.5, 1.0, 0.0) for i, v in enumerate((0.1, 0.2, 0.3, 1e16, -1e16))], "media_id long, start_frame long, magnitude double, direction double, coherence double, scale double, residual double")
    got = {frames.motion_windows(p).head()["magnitude"] for p in (pairs.coalesce(1), pairs.orderBy(pairs.start_frame.desc()).coalesce(1), pairs.repartition(4))}
    assert len(got) == 1


BOX = "media_id long, frame long, det int, x double, y double, w double, h double, score double"


def test_distinct_boxes_at_the_threshold(spark):
    """Overlap 0.4 by the product, as the SQL compares, and just below it by the quotient."""
    rows = [(1, 0, 0, 0.0, 0.0625, 0.44, 0.15, 1.0), (1, 0, 1, 0.0, 0.0625, 0.24, 0.25, 1.0), (2, 0, 0, 0.15, 0.25, 0.21, 0.2, 1.0), (2, 0, 1, 0.2, 0.1875, 0.2, 0.35, 1.0)]
    got = tracks.distinct_boxes(spark.createDataFrame(rows, BOX), 0.4).collect()
    assert sorted((r["media_id"], r["det"]) for r in got) == [(1, 0), (2, 0)]


def test_suppression_at_the_threshold(spark):
    """Overlap 0.45: the product decides, as in the SQL; the query keeps more than 100 boxes of a frame."""
    rows = [(1, 0, 1, 0.1, 0.3125, 0.28, 0.5, 0.9), (1, 0, 0, 0.1, 0.43750000000000006, 0.18, 0.35, 0.8), (2, 0, 1, 0.1, 0.1875, 0.26, 0.2, 0.9), (2, 0, 0, 0.15, 0.1875, 0.13, 0.18, 0.8)]
    rows += [(3, 0, i, float(i), 0.0, 0.5, 0.5, 0.9) for i in range(120)]
    boxes = spark.createDataFrame(rows, BOX)
    got = frames.nms(boxes, most=None).collect()
    assert sorted((r["media_id"], r["det"]) for r in got) == [(1, 0), (1, 1), (2, 0), (2, 1), *[(3, i) for i in range(120)]]
    assert frames.nms(boxes).where("media_id = 3").count() == 100


def test_lonely_faces_at_the_bound(spark):
    """The mean 0.9 of three scores is kept or not whatever the order of rows."""
    scores = [(0.86, 0.86, 0.98), (0.86, 0.98, 0.86), (0.98, 0.86, 0.86), (0.88, 0.88, 0.94), (0.88, 0.94, 0.88), (0.94, 0.88, 0.88)]
    rows = [(m, "face-0", None, f, "detected", v) for m, s in enumerate(scores) for f, v in enumerate(s)]
    got = tracks.merge_faces(spark.createDataFrame(rows, "media_id long, track string, subject long, frame long, kind string, score double").coalesce(1))
    kept = {r["media_id"] for r in got.collect()}
    assert len(kept & {0, 1, 2}) in (0, 3) and len(kept & {3, 4, 5}) in (0, 3)


def test_motion_pairs_are_not_broadcast(spark):
    media = spark.range(2000).selectExpr("id AS media_id", "transform(sequence(0L, 98L, 2L), s -> named_struct('first', s, 'second', s + 1)) AS pairs")
    have = spark.range(200000).selectExpr("id div 100 AS media_id", "id % 100 AS frame").where("frame % 11 <> 4")
    out = sampling.decodable_pairs(media, have)
    assert out.count() == out.where("decoded").count() == 2000 * sum(1 for s in range(0, 99, 2) if s % 11 != 4 and (s + 1) % 11 != 4)
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
