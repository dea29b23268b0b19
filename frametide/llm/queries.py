"""One query per operator over whole tables; ``ORACLES`` holds DuckDB SQL where SQL can express a query."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm import chat_format, decontaminate, fingerprints, jaccard_join, license_scan, quality_rules, sentencepiece_codec, sharding, substring_dedup, toxicity
from frametide.llm.common import read_table
from frametide.llm.oracles import ORACLES as ORACLES

#: Fixed value of the contracts: a document is predicted to carry label 1 from this score on.
THRESHOLD = 0.7
MODEL = "piece_bpe_32k.model"


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def tokenizer_model(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), usable=lambda i: fold(i, 3) != 1)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = toxicity.score_column(toxicity_model(spark, sf_dir))
    out = read_table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode(read_table(spark, sf_dir, "documents"), tokenizer_model())
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], table.schema)
    return chat_format.read_back(chat_format.expand(table.union(extra)))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = quality_rules.train(documents, read_table(spark, sf_dir, "labels"), usable=lambda i: fold(i, 4) != 2)
    out = quality_rules.score(documents, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_substring_dedup, op4_decontamination, op5_license_scan, op6_jaccard_join, op7_chat_format, op8_sharding, op9_quality, op10_fingerprints)}
