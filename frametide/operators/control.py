"""Caches, requests, grants, telemetry and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ranked(rows: DataFrame, key: str, value: str, place: Column) -> DataFrame:
    """The value at the one-based rank ``place`` (of ``_n``, the rows of the key) of each key: rows are counted by value first, so what is sorted are the distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key)
    counts = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_r", place)
    return counts.where((F.col("_r") <= F.col("_upto")) & (F.col("_r") > F.col("_upto") - F.col("_c"))).select(key, F.col(value))


def nearest_rank(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """The value at rank int(n * q + 0.999999), at least 1, of each key."""
    return _ranked(rows, key, value, F.greatest(F.lit(1), F.floor(F.col("_n") * q + 0.999999)))


def prune(entries: DataFrame, now: Column, ttl_days: int, budget: Column, group: str) -> DataFrame:
    """What a cache keeps: entries not older than the time to live (0: none expires; strictly older goes), then the newest ones while the sum stays within the budget of their group."""
    live = entries if ttl_days == 0 else entries.where(F.datediff(now, "mtime") <= ttl_days)
    w = Window.partitionBy(group).orderBy(F.col("mtime").desc(), F.col("size").desc(), F.col("key").desc())
    return live.withColumn("_sum", F.sum("size").over(w)).where(F.col("_sum") <= budget).drop("_sum")


def conflicts(jobs: DataFrame) -> DataFrame:
    """Keys used with more than one request."""
    return jobs.groupBy("idempotency_key").agg(F.countDistinct("request_hash").alias("n_hashes"), F.count("*").alias("n_jobs")).where("n_hashes > 1")


def host_of(url: Column) -> Column:
    """The lower-cased host of an http or https address, without credentials and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#]*@)?([^/:?#@]+)", 1))


def allowed_urls(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose host is listed, or lies below the suffix of a pattern ``*.suffix`` (which never matches the bare suffix)."""
    rows = rows.withColumn("host", host_of(F.col("url")))
    ok = F.col("host").isin([p for p in patterns if not p.startswith("*.")])
    for p in patterns:
        if p.startswith("*."):
            ok = ok | (F.col("host").endswith(p[1:]) & (F.length("host") > len(p) - 1))
    return rows.where((F.col("host") != "") & ok).drop("url")


def freshness(expires_at: Column, now: Column) -> Column:
    """``live``, ``expired`` (from the very moment on) or ``invalid``, of an ISO-8601 time; without a zone it is UTC, the session's zone."""
    at = F.try_to_timestamp(F.regexp_replace(expires_at, "T", " "))
    return F.when(at.isNull(), "invalid").when(now >= at, "expired").otherwise("live")


def precision_recall(rows: DataFrame) -> DataFrame:
    hit = F.sum((F.col("predicted") & F.col("actual")).cast("long"))
    return rows.agg(hit.alias("hits"), (hit / F.sum(F.col("predicted").cast("long"))).alias("precision"), (hit / F.sum(F.col("actual").cast("long"))).alias("recall"))


def overall_status(parts: DataFrame, key: str) -> DataFrame:
    """Of the parts' statuses: completed if all are; with failures, partial if any is completed, else failed; else partial."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(F.bool_and(F.col("status") == "completed"), "completed").when(any_of("failed") & ~any_of("completed"), "failed").otherwise("partial")
    return parts.groupBy(key).agg(status.alias("status"), F.count("*").alias("n_parts"))


def native_status(parts: DataFrame, key: str) -> DataFrame:
    """The same for images and audio: completed if all are, partial if any is completed or partial, else failed."""
    status = F.when(F.bool_and(F.col("status") == "completed"), "completed").when(F.bool_or(F.col("status").isin("completed", "partial")), "partial").otherwise("failed")
    return parts.groupBy(key).agg(status.alias("status"), F.count("*").alias("n_parts"))


def rounded_rank(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """The value at the zero-based rank (n - 1) * q of each key, rounded half to even."""
    return _ranked(rows, key, value, F.bround((F.col("_n") - 1) * q) + 1)


def loudness_report(reports: DataFrame, text: str) -> DataFrame:
    """integrated_lufs and true_peak_db from the text of an EBU R128 meter: the last figure counts, minus infinity is null."""

    def last(pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), 1)
        return F.when(F.get(found, F.size(found) - 1).rlike(r"\d"), F.get(found, F.size(found) - 1).cast("double"))

    return reports.withColumn("integrated_lufs", last(r"I:\s*(-?(?:\d+(?:\.\d+)?|inf))\s*LUFS")).withColumn("true_peak_db", last(r"Peak:\s*(-?(?:\d+(?:\.\d+)?|inf))\s*dBFS"))
