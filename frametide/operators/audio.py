"""Loudness, waveform, onsets and speech islands over sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.operators.folds import fold

#: Speech threshold, shortest speech and shortest silence in seconds, silence floor, threshold parts of rhythm novelty, spread of a tempo.
SPEECH_THRESHOLD, MIN_SPEECH, MIN_SILENCE = 0.5, 0.10, 0.15
NOVELTY_FLOOR, NOVELTY_OF_MAX, NOVELTY_MADS, TEMPO_SPREAD = 0.001, 0.15, 4, 0.12


def rms_hops(pcm: DataFrame, hop: int) -> DataFrame:
    """Root mean square of every ``hop`` samples (the last hop may be shorter)."""
    return pcm.groupBy("media_id", F.floor(F.col("sample_index") / hop).alias("hop")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def envelope(pcm: DataFrame, hop: int) -> DataFrame:
    return pcm.groupBy("media_id", F.floor(F.col("sample_index") / hop).alias("bucket")).agg(F.min("x").alias("low"), F.max("x").alias("high"))


def presence(pcm: DataFrame, media: DataFrame, silence: float) -> DataFrame:
    """absent (no samples), present (peak at or above the floor) or silence, for each media."""
    peak = pcm.groupBy("media_id").agg(F.max(F.abs("x")).alias("peak"))
    state = F.when(F.col("peak").isNull(), "absent").when(F.col("peak") >= silence, "present").otherwise("silence")
    return media.join(peak, "media_id", "left").select("media_id", state.alias("presence"))


def local_maxima(series: DataFrame, value: str, threshold: float) -> DataFrame:
    """Points at or above the threshold that are strictly above the one before and not below the one after; the ends do not count."""
    w = Window.partitionBy("media_id").orderBy("sample_index")
    out = series.withColumn("_before", F.lag(value).over(w)).withColumn("_after", F.lead(value).over(w))
    return out.where((F.col(value) >= threshold) & (F.col(value) > F.col("_before")) & (F.col(value) >= F.col("_after"))).drop("_before", "_after")


def autocorrelation(series: DataFrame, value: str, lags: int) -> DataFrame:
    """(media_id, lag, corr): the sum of x(i) * x(i + lag) for lags from 1; the partners come from one window, not from a self-join."""
    w = Window.partitionBy("media_id").orderBy("sample_index")
    products = series.select("media_id", *[(F.col(value) * F.lead(value, k).over(w)).alias(f"_{k}") for k in range(1, lags + 1)])
    sums = products.groupBy("media_id").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in range(1, lags + 1)])
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_{k}").alias("corr")) for k in range(1, lags + 1)])
    return sums.select("media_id", F.explode(table).alias("r")).select("media_id", "r.lag", "r.corr").where("corr is not null")


def best_lag(table: DataFrame, least: int) -> DataFrame:
    """The lag of the greatest correlation among those from ``least`` on; the smallest on ties."""
    w = Window.partitionBy("media_id").orderBy(F.round("corr", 6).desc(), "lag")
    return table.where(F.col("lag") >= least).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def novelty_threshold(series: DataFrame, value: str) -> DataFrame:
    """The greatest of a floor, a share of the maximum, and median + 4 median absolute deviations."""
    mid = series.groupBy("media_id").agg(F.percentile(value, F.lit(0.5)).alias("middle"), F.max(value).alias("top"))
    mad = series.join(mid, "media_id").groupBy("media_id").agg(F.first("middle").alias("middle"), F.first("top").alias("top"), F.percentile(F.abs(F.col(value) - F.col("middle")), F.lit(0.5)).alias("mad"))
    return mad.select("media_id", F.greatest(F.lit(NOVELTY_FLOOR), F.col("top") * NOVELTY_OF_MAX, F.col("middle") + NOVELTY_MADS * F.col("mad")).alias("threshold"))


def speech_segments(vad: DataFrame, threshold: float = SPEECH_THRESHOLD) -> DataFrame:
    """Islands of windows scoring at least the threshold; short ones go, then those with a gap below the least silence merge.

    An island ends where the next window begins (the last one: at its last window's end).
    """
    w = Window.partitionBy("media_id").orderBy("window_index")
    flag = (F.col("score") >= threshold).cast("int")
    rows = vad.withColumn("speech", flag).withColumn("until", F.coalesce(F.lead("start_sec").over(w), F.col("end_sec")))
    rows = rows.withColumn("change", (F.coalesce(F.lag("speech").over(w), F.lit(-1)) != F.col("speech")).cast("int"))
    rows = rows.withColumn("island", F.sum("change").over(w)).where("speech = 1")
    islands = rows.groupBy("media_id", "island").agg(F.min("start_sec").alias("start_sec"), F.max("until").alias("end_sec"), F.max("score").alias("score")).where(F.round(F.col("end_sec") - F.col("start_sec"), 6) >= MIN_SPEECH)
    v = Window.partitionBy("media_id").orderBy("start_sec")
    gap = F.round(F.col("start_sec") - F.lag("end_sec").over(v), 6)
    merged = islands.withColumn("fresh", F.when(gap < MIN_SILENCE, 0).otherwise(1)).withColumn("segment", F.sum("fresh").over(v))
    return merged.groupBy("media_id", "segment").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("score").alias("score"))


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def merge_onsets(peaks: DataFrame, least_gap: float) -> DataFrame:
    """(media_id, sec, strength): peaks nearer than ``least_gap`` to the last accepted one replace it if stronger; its time as anchor stays.

    A peak that far from the one before it is always accepted, so the series falls into islands that are folded apart, by an
    expression: no group is larger than a burst of peaks.
    """
    w = Window.partitionBy("media_id").orderBy("sec")
    fresh = F.coalesce(F.round(F.col("sec") - F.lag("sec").over(w), 6) >= least_gap, F.lit(True)).cast("int")
    rows = peaks.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w))
    lists = rows.groupBy("media_id", "_island").agg(F.array_sort(F.collect_list(F.struct(F.col("sec").cast("double").alias("sec"), F.col("strength").cast("double").alias("strength")))).alias("p"))
    kind = "struct<out:array<struct<sec:double,strength:double>>,anchor:double>"

    def step(acc: Column, p: Column) -> Column:
        out = acc["out"]
        accepted = F.struct(F.concat(out, F.array(p)).alias("out"), p["sec"].alias("anchor")).cast(kind)
        replaced = F.struct(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(p)).alias("out"), acc["anchor"].alias("anchor")).cast(kind)
        return F.when(acc["anchor"].isNull() | (F.round(p["sec"] - acc["anchor"], 6) >= least_gap), accepted).when(p["strength"] > F.element_at(out, -1)["strength"], replaced).otherwise(acc)

    zero = F.struct(F.array().alias("out"), F.lit(None).alias("anchor")).cast(kind)
    return lists.select("media_id", F.explode(F.aggregate("p", zero, step, lambda a: a["out"])).alias("o")).select("media_id", "o.sec", "o.strength")


def tempo_runs(events: DataFrame, min_bpm: float, max_bpm: float) -> DataFrame:
    """(media_id, run, start_sec, end_sec, n_intervals, bpm): three or more intervals in a row within 12 % of the first of them.

    The first interval lies between the periods of both tempos. A task holds one media's state, not its events.
    """

    def step(state: dict, row: dict) -> list[tuple]:
        before, state["sec"] = state["sec"], row["sec"]
        if before is None:
            return []
        gap, state["i"] = round(row["sec"] - before, 6), state["i"] + 1
        if state["period"] is None or round(abs(gap / state["period"] - 1), 6) > TEMPO_SPREAD:
            fits = 60 / max_bpm <= gap <= 60 / min_bpm
            state["period"], state["run"] = (gap, state["i"]) if fits else (None, None)
        return [] if state["run"] is None else [(row["media_id"], state["run"], before, row["sec"], gap)]

    marked = fold(events.select("media_id", "sec"), ["media_id"], ["sec"], lambda row: {"sec": None, "i": -1, "period": None, "run": None}, step, "media_id long, run long, sec double, until double, gap double")
    runs = marked.groupBy("media_id", "run").agg(F.min("sec").alias("start_sec"), F.max("until").alias("end_sec"), F.count("*").alias("n_intervals"), (60 / F.percentile("gap", F.lit(0.5))).alias("bpm"))
    return runs.where("n_intervals >= 3")
