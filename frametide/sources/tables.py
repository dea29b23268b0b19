"""Reading the test tables, and deterministic adapters that turn them into media tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: media_id, sample_index, x, event_id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 500))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), (F.row_number().over(w) - 1).cast("long").alias("sample_index"), x.alias("x"), "event_id", "value")


def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return s.select("media_id", F.col("sample_index").alias("window_index"), (F.col("sample_index") * 0.032).alias("start_sec"), ((F.col("sample_index") + 1) * 0.032).alias("end_sec"), ((F.col("event_id") * 37 % 100) / 100).alias("score"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 patches of 0..255: media_id, frame_index, patch, vec_id."""
    w = Window.partitionBy("label").orderBy("vec_id")
    patch = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("media_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_index"), patch.alias("patch"), "vec_id")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.floor(F.char_length("text") / 10) + 1
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").cast("long").alias("shot_index"), size.alias("n"), F.sum(size).over(w).alias("end_frame"))
    return rows.select("media_id", "shot_index", (F.col("end_frame") - F.col("n")).alias("start_frame"), "end_frame")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    num = lambda c: F.col(c).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("media_id"), F.col("l_linenumber").cast("long").alias("frame"), (F.row_number().over(w) - 1).cast("int").alias("det"),
        (5 * num("l_discount") + 0.0).alias("x"), (6.25 * num("l_tax") + 0.0).alias("y"), (num("l_quantity") / 100).alias("w"), ((F.col("l_partkey") % 50 + 1) / 100).cast("double").alias("h"), ((F.col("l_suppkey") * 13 % 100) / 100).cast("double").alias("score"),
    )


def motion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("media_id", (F.col("sample_index") * 2).alias("start_frame"), (F.col("value") / 10000).alias("magnitude"), ((F.col("event_id") % 628) / 100 - 3.14).alias("direction"), ((F.col("event_id") * 7 % 100) / 100).alias("coherence"), (1 + (F.col("event_id") % 41 - 20) / 2000).alias("scale"), ((F.col("event_id") % 97) / 10000).alias("residual"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of small frames: media_id, frame_index, i, r, g, b (0..255): the patch and its neighbours in reading order."""
    w = Window.partitionBy("media_id", "frame_index").orderBy("i")
    rows = patches(spark, sf_dir).select("media_id", "frame_index", F.posexplode("patch").alias("i", "r"))
    return rows.withColumn("g", F.coalesce(F.lead("r", 1).over(w), F.col("r"))).withColumn("b", F.coalesce(F.lead("r", 2).over(w), F.col("r")))


#: The adapters in SQL.
SIG = "sig AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 500)) AS x, event_id, value FROM events)"
VAD = SIG + ", vad AS (SELECT media_id, sample_index AS window_index, sample_index * 0.032::DOUBLE AS start_sec, (sample_index + 1) * 0.032::DOUBLE AS end_sec, (event_id * 37 % 100) / 100 AS score FROM sig)"
PATCH = "patches AS (SELECT label::BIGINT AS media_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 127.5)::INT) AS patch, vec_id FROM embeddings)"
SHOTS = "sized AS (SELECT conv_id AS media_id, turn::BIGINT AS shot_index, (length(text) // 10 + 1)::BIGINT AS n FROM conversations), shots AS (SELECT media_id, shot_index, (sum(n) OVER (PARTITION BY media_id ORDER BY shot_index))::BIGINT - n AS start_frame, (sum(n) OVER (PARTITION BY media_id ORDER BY shot_index))::BIGINT AS end_frame FROM sized)"
BOXES = "boxes AS (SELECT l_orderkey::BIGINT AS media_id, l_linenumber::BIGINT AS frame, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax) - 1)::INT AS det, 5 * l_discount::DOUBLE + 0.0 AS x, 6.25::DOUBLE * l_tax::DOUBLE + 0.0 AS y, l_quantity::DOUBLE / 100 AS w, (l_partkey % 50 + 1)::DOUBLE / 100 AS h, (l_suppkey * 13 % 100)::DOUBLE / 100 AS score FROM lineitem)"
MOTION = SIG + ", pairs AS (SELECT media_id, sample_index * 2 AS start_frame, value / 10000 AS magnitude, (event_id % 628)::DOUBLE / 100 - 3.14::DOUBLE AS direction, (event_id * 7 % 100)::DOUBLE / 100 AS coherence, 1 + (event_id % 41 - 20)::DOUBLE / 2000 AS scale, (event_id % 97)::DOUBLE / 10000 AS residual FROM sig)"
PIXELS = PATCH + ", px AS (SELECT media_id, frame_index, generate_subscripts(patch, 1) - 1 AS i, unnest(patch) AS r FROM patches), pixels AS (SELECT media_id, frame_index, i, r, coalesce(lead(r, 1) OVER w, r) AS g, coalesce(lead(r, 2) OVER w, r) AS b FROM px WINDOW w AS (PARTITION BY media_id, frame_index ORDER BY i))"
