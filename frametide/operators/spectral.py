"""Spectral flux, bands, tempo, rhythm and gated loudness from samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.operators.audio import MIN_SPEECH, NOVELTY_FLOOR, NOVELTY_MADS, NOVELTY_OF_MAX, autocorrelation
from frametide.operators.folds import fold

#: Transform length and step, bands in Hz, tempo range, least variance and confidence of a tempo, rhythm step and refractory time in seconds.
N_FFT, HOP, BANDS = 2048, 512, {"low": (20, 200), "mid": (200, 2000), "high": (2000, 8000)}
MIN_BPM, MAX_BPM, LEAST_VARIANCE, LEAST_CONFIDENCE = 60.0, 200.0, 1e-4, 0.45
RHYTHM_HOP, RHYTHM_REFRACTORY, ACTIVE_FLOOR, ACTIVE_PART = 0.005, 0.08, 1e-4, 0.1
#: Samples of a chunk.
CHUNK = 16_384
#: Gates of programme loudness.
ABSOLUTE_GATE, RELATIVE_GATE, LOUDNESS_OFFSET = -70.0, -10.0, -0.691


def chunks(pcm: DataFrame, size: int = CHUNK) -> DataFrame:
    """(media_id, chunk_index, samples): a table of samples as arrays of ``size`` in order."""
    rows = pcm.groupBy("media_id", F.floor(F.col("sample_index") / size).alias("chunk_index")).agg(F.array_sort(F.collect_list(F.struct("sample_index", "x"))).alias("s"))
    return rows.select("media_id", "chunk_index", F.transform("s", lambda r: r["x"]).alias("samples"))


def flux(pcm: DataFrame, rate: float, n_fft: int = N_FFT, hop: int = HOP, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(media_id, frame, flux, flux_<band>): rises of the Hann-windowed magnitudes from each transform to the next, summed over all bins and over bands.

    ``pcm``: chunks (media_id, chunk_index, samples). They stream through in order; a task holds one chunk and what the transform before left over, not a media.
    """
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / (n_fft - 1))
    freqs = np.fft.rfftfreq(n_fft, 1 / rate)
    masks = [(freqs >= a) & (freqs < b) for a, b in bands.values()]

    def step(state: dict, row: dict) -> list[tuple]:
        held = np.concatenate([state["held"], np.array(row["samples"], dtype=float)])
        if len(held) < n_fft:
            state["held"] = held
            return []
        frames = np.lib.stride_tricks.sliding_window_view(held, n_fft)[::hop]
        now = np.abs(np.fft.rfft(frames * window, axis=1))
        state["held"] = held[len(frames) * hop :]
        all_of = now if state["before"] is None else np.concatenate([state["before"][None], now])
        rise = np.maximum(np.diff(all_of, axis=0), 0)
        state["before"], first = now[-1], state["frame"]
        state["frame"] = first + len(rise)
        sums = [rise.sum(axis=1), *[rise[:, m].sum(axis=1) for m in masks]]
        return [(row["media_id"], first + i, *[float(v[i]) for v in sums]) for i in range(len(rise))]

    schema = "media_id long, frame long, flux double" + "".join(f", flux_{b} double" for b in bands)
    return fold(pcm.select("media_id", "chunk_index", "samples"), ["media_id"], ["chunk_index"], lambda row: {"held": np.zeros(0), "before": None, "frame": 0}, step, schema)


def band_of_onsets(onsets: DataFrame, flux_rows: DataFrame, rate: float, hop: int = HOP, bands: dict = BANDS) -> DataFrame:
    """``band`` of each onset (media_id, sec): the one of greatest flux at its frame (clamped to the media's), the lower on ties."""
    last = flux_rows.groupBy("media_id").agg(F.max("frame").alias("_last"))
    at = F.least(F.greatest(F.bround(F.col("sec") * rate / hop).cast("long"), F.lit(0)), F.col("_last"))
    rows = onsets.join(last, "media_id").withColumn("frame", at).join(flux_rows, ["media_id", "frame"])
    most = F.greatest(*[F.round(f"flux_{b}", 9) for b in bands])
    band = None
    for b in bands:
        hit = F.round(f"flux_{b}", 9) == most
        band = F.when(hit, b) if band is None else band.when(hit, b)
    return rows.select("media_id", "sec", "frame", band.alias("band"))


def tempo(series: DataFrame, rate: float, hop: int = HOP) -> DataFrame:
    """(media_id, bpm, confidence) from a flux series (media_id, sample_index, x): the first best lag of the centred autocorrelation; null below the least variance or confidence, or where the series is too short."""
    low, high = int(60 / MAX_BPM * rate / hop), int(60 / MIN_BPM * rate / hop)
    stats = series.groupBy("media_id").agg(F.avg("x").alias("_m"), F.var_pop("x").alias("_v"), F.count("*").alias("_n"))
    centred = series.join(stats, "media_id").select("media_id", "sample_index", (F.col("x") - F.col("_m")).alias("x"))
    table = autocorrelation(centred, "x", high + 2)
    listed = table.groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct("lag", "corr"))).alias("corr"), F.max_by("lag", F.when(F.col("lag").between(low, high), F.struct(F.round("corr", 9), -F.col("lag")))).alias("lag"))
    rows = stats.join(listed, "media_id", "left").withColumn("bpm", F.round(60 * rate / (F.col("lag") * hop), 2))
    at = F.bround(60 / F.col("bpm") * rate / hop).cast("long")
    values = lambda a, b: F.filter(F.transform(F.sequence(a, b), lambda k: F.col("corr")[k]), lambda v: v.isNotNull())
    first = F.sort_array(values(F.lit(1).cast("long"), F.lit(max(5, low) - 1).cast("long")))
    middle = (F.element_at(first, F.floor((F.size(first) + 1) / 2).cast("int")) + F.element_at(first, F.floor(F.size(first) / 2).cast("int") + 1)) / 2
    near = values(at - 2, F.least(at + 2, F.col("_n") - 1))
    mean = F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.size(near)
    spread = F.sqrt(F.aggregate(near, F.lit(0.0), lambda s, v: s + (v - mean) ** 2) / F.size(near))
    peak = F.col("corr")[at]
    confidence = F.when(peak > 0, peak / (middle + spread + 1e-8)).otherwise(F.lit(0.0))
    ok = (F.col("_v") >= LEAST_VARIANCE) & (F.col("_n") > high) & F.col("bpm").between(MIN_BPM, MAX_BPM)
    rows = rows.withColumn("confidence", F.when(ok, confidence))
    return rows.select("media_id", F.when(F.col("confidence") >= LEAST_CONFIDENCE, F.col("bpm")).alias("bpm"), "confidence")


def novelty(pcm: DataFrame, hop: int) -> DataFrame:
    """(media_id, hop, novelty): rises of the root mean square from hop to hop; the last hop is filled up with silence, before the first there is none."""
    rms = pcm.groupBy("media_id", F.floor(F.col("sample_index") / hop).alias("hop")).agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / hop).alias("e"))
    before = F.coalesce(F.lag("e").over(Window.partitionBy("media_id").orderBy("hop")), F.lit(0.0))
    return rms.select("media_id", "hop", F.greatest(F.lit(0.0), F.col("e") - before).alias("novelty"))


def rhythm_peaks(rows: DataFrame, refractory: int) -> DataFrame:
    """(media_id, hop, novelty): hops at or above the media's threshold and not below either neighbour; of two nearer than ``refractory`` the earlier stays."""
    middle = rows.groupBy("media_id").agg(F.percentile("novelty", F.lit(0.5)).alias("_mid"), F.max("novelty").alias("_top"))
    mad = rows.join(middle, "media_id").groupBy("media_id", "_mid", "_top").agg(F.percentile(F.abs(F.col("novelty") - F.col("_mid")), F.lit(0.5)).alias("_mad"))
    limit = mad.select("media_id", F.greatest(F.lit(NOVELTY_FLOOR), F.col("_top") * NOVELTY_OF_MAX, F.col("_mid") + NOVELTY_MADS * F.col("_mad")).alias("_limit"))
    w = Window.partitionBy("media_id").orderBy("hop")
    near = rows.withColumn("_b", F.lag("novelty").over(w)).withColumn("_a", F.lead("novelty").over(w)).join(limit, "media_id")
    v = F.col("novelty")
    near = near.where((v >= F.col("_limit")) & (F.col("_b").isNull() | (v >= F.col("_b"))) & (F.col("_a").isNull() | (v >= F.col("_a")))).select("media_id", "hop", "novelty")

    def step(state: dict, row: dict) -> list[tuple]:
        if state["last"] is not None and row["hop"] - state["last"] < refractory:
            return []
        state["last"] = row["hop"]
        return [(row["media_id"], row["hop"], row["novelty"])]

    return fold(near, ["media_id"], ["hop"], lambda row: {"last": None}, step, "media_id long, hop long, novelty double")


def refine(peaks: DataFrame, pcm: DataFrame, hop: int, rate: float) -> DataFrame:
    """(media_id, sample_index, sec, strength): a peak's first sample that reaches a tenth of its hop's greatest level."""
    rows = pcm.withColumn("hop", F.floor(F.col("sample_index") / hop)).join(peaks, ["media_id", "hop"])
    top = F.max(F.abs("x")).over(Window.partitionBy("media_id", "hop"))
    active = F.abs("x") >= F.greatest(F.lit(ACTIVE_FLOOR), top * ACTIVE_PART)
    out = rows.withColumn("_a", active).groupBy("media_id", "hop").agg(F.coalesce(F.min(F.when(F.col("_a"), F.col("sample_index"))), F.first("hop") * hop).alias("sample_index"), F.first("novelty").alias("strength"))
    return out.select("media_id", "sample_index", (F.col("sample_index") / rate).alias("sec"), "strength")


def rhythm_summary(runs: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, bpm, tier, reason): of the periodic runs of a media (media_id, bpm). One tempo where they agree within 12 %."""
    found = runs.groupBy("media_id").agg(F.max("bpm").alias("_top"), F.min("bpm").alias("_low"), F.percentile("bpm", F.lit(0.5)).alias("_mid"))
    rows = media.join(found, "media_id", "left")
    some = F.col("_mid").isNotNull()
    return rows.select("media_id", F.when(F.col("_top") / F.col("_low") < 1.12, F.col("_mid")).alias("bpm"), F.when(some, "periodic-acoustic-attacks").otherwise("none").alias("tier"), F.when(some, "HEURISTIC_NOT_MUSICALLY_VERIFIED").when(F.col("n_events") < 4, "INSUFFICIENT_PERIODIC_EVIDENCE").otherwise("IRREGULAR_OR_AMBIENT").alias("reason"))


def gated_loudness(weighted: DataFrame, block: int, step: int) -> DataFrame:
    """(media_id, lufs): programme loudness of K-weighted samples: whole blocks of ``block`` samples every ``step``, those above the absolute gate, then those above the relative one. Null where none is."""
    last = weighted.groupBy("media_id").agg(F.max("sample_index").alias("_last"))
    i = F.col("sample_index")
    first = F.greatest(F.lit(0), F.ceil((i - block + 1) / step)).cast("long")
    rows = weighted.join(last, "media_id").withColumn("block", F.explode(F.sequence(first, F.floor(i / step)))).where(F.col("block") * step + block - 1 <= F.col("_last"))
    power = rows.groupBy("media_id", "block").agg(F.avg(F.col("x") * F.col("x")).alias("z"))
    level = lambda z: LOUDNESS_OFFSET + 10 * F.log10(z)
    loud = power.where(F.col("z") > 0).where(level(F.col("z")) > ABSOLUTE_GATE)
    gate = loud.groupBy("media_id").agg((level(F.avg("z")) + RELATIVE_GATE).alias("_gate"))
    kept = loud.join(gate, "media_id").where(level(F.col("z")) > F.col("_gate")).groupBy("media_id").agg(level(F.avg("z")).alias("lufs"))
    return last.select("media_id").join(kept, "media_id", "left")


def speech_body(segments: DataFrame, media: DataFrame) -> DataFrame:
    """Segments cut to the duration of their media; those shorter than speech can be then go."""
    rows = segments.join(media, "media_id").withColumn("end_sec", F.least("end_sec", "duration_sec"))
    return rows.where(F.round(F.col("end_sec") - F.col("start_sec"), 6) >= MIN_SPEECH).drop("duration_sec")


def beat_events(times: DataFrame, rate: int = 22050) -> DataFrame:
    """(media_id, position, sample_index, fault): model events in the order of ``position``: finite, rising, from 0 and before the media's ``duration_sec``; the index rounds halves to even."""
    w = Window.partitionBy("media_id").orderBy("position")
    t = F.col("sec")
    bad = t.isNull() | F.isnan(t) | (t < 0) | (t >= F.col("duration_sec")) | F.coalesce(t <= F.lag("sec").over(w), F.lit(False))
    return times.withColumn("_bad", bad).select("media_id", "position", F.when(~F.col("_bad"), F.bround(t * rate).cast("long")).alias("sample_index"), F.when(F.col("_bad"), "INVALID_NEURAL_BEAT_TIME").alias("fault"))


def vad_windows(pcm: DataFrame, size: int = 512, context: int = 64) -> DataFrame:
    """(media_id, window_index, samples): windows of ``size`` samples behind the ``context`` samples before them (silence before the first); the last is filled up with silence. ``pcm``: chunks."""

    def windows(state: dict) -> list[tuple]:
        n = (len(state["held"]) - context) // size
        out = [(state["media"], state["n"] + i, state["held"][i * size : i * size + context + size].tolist()) for i in range(n)]
        state["held"], state["n"] = state["held"][n * size :], state["n"] + n
        return out

    def step(state: dict, row: dict) -> list[tuple]:
        state["media"], state["held"] = row["media_id"], np.concatenate([state["held"], np.array(row["samples"], dtype=float)])
        return windows(state)

    def finish(state: dict) -> list[tuple]:
        left = len(state["held"]) - context
        state["held"] = np.concatenate([state["held"], np.zeros(-left % size)])
        return windows(state)

    return fold(pcm.select("media_id", "chunk_index", "samples"), ["media_id"], ["chunk_index"], lambda row: {"held": np.zeros(context), "n": 0, "media": None}, step, "media_id long, window_index long, samples array<double>", finish)


def probability(raw: Column) -> Column:
    """A model's output as a probability: not a number is 0, others are clamped to 0..1."""
    return F.when(raw.isNull() | F.isnan(raw), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
