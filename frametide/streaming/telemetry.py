"""Streaming twins of the telemetry and request operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern in the path makes a single file acceptable to the file source."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stage_windows(stages: DataFrame, every: str, late: str) -> DataFrame:
    """Number, sum and longest of the durations of each stage in tumbling windows; a window comes out once the watermark passes its end."""
    out = stages.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))
    return out.select(F.col("w.start").alias("window_start"), "stage", "n", "total_ms", "longest_ms")


def first_requests(requests: DataFrame, late: str) -> DataFrame:
    """The first row of each idempotency key; state is kept no longer than the watermark's delay."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there now, into a table in the folder that all executors share."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp()
    path = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
