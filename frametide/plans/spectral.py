"""Queries of the spectral, rhythm and loudness operators, on the signals made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from frametide.functions import rates
from frametide.operators import audio, spectral
from frametide.plans.registry import query, r6
from frametide.sources import tables as t

#: The test signals have few samples, so transforms take 16 of them, every 4th.
_N, _HOP, _RATE = 16, 4, 16.0
_BANDS = {"low": (0.0, 3.0), "mid": (3.0, 5.0), "high": (5.0, 8.0)}
_IN = " ".join(f"WHEN k >= {a:g} AND k < {b:g} THEN '{n}'" for n, (a, b) in _BANDS.items())
_FLUX = f"""{t.SIG}, len AS (SELECT media_id, count(*) AS n FROM sig GROUP BY 1), fr AS (SELECT media_id, unnest(range(0, (n - {_N}) // {_HOP} + 1)) AS frame FROM len WHERE n >= {_N}),
sp AS (SELECT fr.media_id, frame, k, sqrt(pow(sum(x * h * cos(2 * pi() * k * j / {_N})), 2) + pow(sum(x * h * sin(2 * pi() * k * j / {_N})), 2)) AS m FROM fr JOIN (SELECT j, 0.5 - 0.5 * cos(2 * pi() * j / {_N - 1}) AS h FROM (SELECT unnest(range(0, {_N})) AS j)) w ON true JOIN sig ON sig.media_id = fr.media_id AND sig.sample_index = frame * {_HOP} + j, (SELECT unnest(range(0, {_N // 2 + 1})) AS k) GROUP BY fr.media_id, frame, k),
rise AS (SELECT b.media_id, a.frame, CASE {_IN} END AS band, greatest(b.m - a.m, 0) AS d FROM sp a JOIN sp b USING (k) WHERE a.media_id = b.media_id AND b.frame = a.frame + 1),
flux AS (SELECT media_id, frame, sum(d) AS flux, {', '.join(f"coalesce(sum(d) FILTER (WHERE band = '{n}'), 0) AS flux_{n}" for n in _BANDS)} FROM rise GROUP BY ALL)"""


def _flux(spark, d):
    return spectral.flux(spectral.chunks(t.signal(spark, d), 10), _RATE, _N, _HOP, _BANDS)


_NAMES = ["flux", *(f"flux_{n}" for n in _BANDS)]


@query(f"WITH {_FLUX} SELECT media_id, frame, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM flux")
def spectral_flux(spark, d):
    return r6(_flux(spark, d), *_NAMES)


_BEST = "greatest(" + ", ".join(f"round(flux_{n}, 9)" for n in _BANDS) + ")"


@query(f"WITH {_FLUX}, top AS (SELECT media_id, max(frame) AS last FROM flux GROUP BY 1), o AS (SELECT media_id, sample_index * 0.1::DOUBLE AS sec FROM sig WHERE sample_index % 9 = 4), p AS (SELECT media_id, sec, least(greatest(round_even(sec * {_RATE} / {_HOP}, 0)::BIGINT, 0), last) AS frame FROM o JOIN top USING (media_id)) SELECT media_id, round(sec, 6) AS sec, frame, CASE {' '.join(f'WHEN round(flux_{n}, 9) = {_BEST} THEN {chr(39)}{n}{chr(39)}' for n in _BANDS)} END AS band FROM p JOIN flux USING (media_id, frame)")
def onset_band_labels(spark, d):
    onsets = t.signal(spark, d).where("sample_index % 9 = 4").select("media_id", (F.col("sample_index") * F.lit(0.1)).alias("sec"))
    return r6(spectral.band_of_onsets(onsets, _flux(spark, d), _RATE, _HOP, _BANDS), "sec")


_LAGS = f"""{t.SIG}, st AS (SELECT media_id, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM sig GROUP BY 1), ce AS (SELECT media_id, sample_index AS i, x - m AS x FROM sig JOIN st USING (media_id)),
corr AS (SELECT a.media_id, (b.i - a.i)::BIGINT AS lag, sum(a.x * b.x) AS c FROM ce a JOIN ce b ON a.media_id = b.media_id AND b.i > a.i AND b.i <= a.i + 33 GROUP BY ALL),
best AS (SELECT media_id, lag AS best FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY round(c, 9) DESC, lag) AS k FROM corr WHERE lag BETWEEN 9 AND 31) WHERE k = 1),
bp AS (SELECT st.media_id, v, n, round(60 * 16000 / (best * 512), 2) AS bpm FROM st LEFT JOIN best USING (media_id)), ok AS (SELECT *, round_even(60 / bpm * 16000 / 512, 0)::BIGINT AS at_lag FROM bp WHERE v >= 0.0001 AND n > 31 AND bpm BETWEEN 60 AND 200),
cf AS (SELECT ok.media_id, bpm, (SELECT c FROM corr WHERE corr.media_id = ok.media_id AND lag = at_lag) AS peak, (SELECT median(c) FROM corr WHERE corr.media_id = ok.media_id AND lag BETWEEN 1 AND 8) AS base, (SELECT stddev_pop(c) FROM corr WHERE corr.media_id = ok.media_id AND lag BETWEEN at_lag - 2 AND at_lag + 2) AS spread FROM ok)"""


@query(f"WITH {_LAGS}, z AS (SELECT media_id, bpm, CASE WHEN peak > 0 THEN peak / (base + spread + 1e-8) ELSE 0 END AS confidence FROM cf) SELECT st.media_id, CASE WHEN confidence >= 0.45 THEN bpm END AS bpm, round(confidence, 5) AS confidence FROM st LEFT JOIN z USING (media_id)")
def tempo_estimate(spark, d):
    rows = spectral.tempo(t.signal(spark, d).select("media_id", "sample_index", "x"), 16000.0)
    return rows.withColumn("confidence", F.round("confidence", 5))


_NOV = f"""{t.SIG}, rms AS (SELECT media_id, sample_index // 2 AS hop, sqrt(sum(x * x) / 2) AS e FROM sig GROUP BY ALL), nov AS (SELECT media_id, hop, greatest(0, e - coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY hop), 0)) AS v FROM rms),
mid AS (SELECT media_id, median(v) AS mid, max(v) AS top FROM nov GROUP BY 1), lim AS (SELECT media_id, greatest(0.001, any_value(top) * 0.15, any_value(mid) + 4 * median(abs(v - mid))) AS lim FROM nov JOIN mid USING (media_id) GROUP BY 1),
nb AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM nov WINDOW w AS (PARTITION BY media_id ORDER BY hop)), can AS (SELECT media_id, hop, v, row_number() OVER (PARTITION BY media_id ORDER BY hop) AS k FROM nb JOIN lim USING (media_id) WHERE v >= lim AND (b IS NULL OR v >= b) AND (a IS NULL OR v >= a)),
fold AS (SELECT media_id, hop, v, k, hop AS last FROM can WHERE k = 1 UNION ALL SELECT c.media_id, c.hop, c.v, c.k, CASE WHEN c.hop - f.last < 3 THEN f.last ELSE c.hop END FROM fold f JOIN can c ON c.media_id = f.media_id AND c.k = f.k + 1), pk AS (SELECT media_id, hop, v FROM fold WHERE last = hop)"""


def _novelty(spark, d):
    return spectral.novelty(t.signal(spark, d).select("media_id", "sample_index", "x"), 2)


@query(f"WITH {_NOV.split(', mid AS')[0].rstrip().rstrip(',')} SELECT media_id, hop, round(v, 6) AS novelty FROM nov".replace(",\n SELECT", " SELECT"))
def rhythm_novelty(spark, d):
    return r6(_novelty(spark, d), "novelty")


_ACTIVE = "act AS (SELECT pk.media_id, hop, v, sample_index, abs(x) >= greatest(1e-4, max(abs(x)) OVER (PARTITION BY pk.media_id, hop) * 0.1) AS on_ FROM pk JOIN sig ON sig.media_id = pk.media_id AND sig.sample_index // 2 = hop), ev AS (SELECT media_id, coalesce(min(sample_index) FILTER (WHERE on_), hop * 2) AS sample_index, any_value(v) AS v FROM act GROUP BY media_id, hop)"


def _rhythm_events(spark, d):
    pcm = t.signal(spark, d).select("media_id", "sample_index", "x")
    return spectral.refine(spectral.rhythm_peaks(_novelty(spark, d), 3), pcm, 2, 4.0)


@query(f"WITH RECURSIVE {_NOV}, {_ACTIVE} SELECT media_id, sample_index, round(sample_index / 4, 6) AS sec, round(v, 6) AS strength FROM ev")
def rhythm_events(spark, d):
    return r6(_rhythm_events(spark, d), "sec", "strength")


@query(f"""WITH RECURSIVE {_NOV}, {_ACTIVE}, c AS (SELECT media_id, sample_index / 4 AS sec, row_number() OVER (PARTITION BY media_id ORDER BY sample_index) AS i, lead(sample_index / 4) OVER (PARTITION BY media_id ORDER BY sample_index) AS until FROM ev), g AS (SELECT *, round(until - sec, 6) AS gap FROM c WHERE until IS NOT NULL),
e AS (SELECT media_id, i, gap, CASE WHEN gap BETWEEN 1.5 AND 3.0 THEN gap END AS period, CASE WHEN gap BETWEEN 1.5 AND 3.0 THEN i END AS run FROM g WHERE i = 1 UNION ALL SELECT g.media_id, g.i, g.gap, CASE WHEN round(abs(g.gap / e.period - 1), 6) <= 0.12 THEN e.period WHEN g.gap BETWEEN 1.5 AND 3.0 THEN g.gap END, CASE WHEN round(abs(g.gap / e.period - 1), 6) <= 0.12 THEN e.run WHEN g.gap BETWEEN 1.5 AND 3.0 THEN g.i END FROM e JOIN g ON g.media_id = e.media_id AND g.i = e.i + 1),
rn AS (SELECT media_id, run, 60 / median(gap) AS bpm FROM e WHERE run IS NOT NULL GROUP BY media_id, run HAVING count(*) >= 3), rg AS (SELECT media_id, max(bpm) AS top, min(bpm) AS low, median(bpm) AS mid FROM rn GROUP BY 1), n AS (SELECT media_id, count(*) AS n FROM c GROUP BY 1), me AS (SELECT DISTINCT media_id FROM sig)
SELECT me.media_id, CASE WHEN top / low < 1.12 THEN round(mid, 6) END AS bpm, CASE WHEN mid IS NULL THEN 'none' ELSE 'periodic-acoustic-attacks' END AS tier, CASE WHEN mid IS NOT NULL THEN 'HEURISTIC_NOT_MUSICALLY_VERIFIED' WHEN coalesce(n, 0) < 4 THEN 'INSUFFICIENT_PERIODIC_EVIDENCE' ELSE 'IRREGULAR_OR_AMBIENT' END AS reason FROM me LEFT JOIN rg USING (media_id) LEFT JOIN n USING (media_id)""")
def rhythm_feature(spark, d):
    events = _rhythm_events(spark, d)
    media = t.signal(spark, d).select("media_id").distinct().join(events.groupBy("media_id").agg(F.count("*").alias("n_events")), "media_id", "left").fillna(0, "n_events")
    return r6(spectral.rhythm_summary(audio.tempo_runs(events, 20, 40), media), "bpm")


@query(f"WITH {t.SIG}, len AS (SELECT media_id, max(sample_index) AS n FROM sig GROUP BY 1), bl AS (SELECT media_id, unnest(range(0, (n - 7) // 2 + 1)) AS b FROM len WHERE n >= 7), z AS (SELECT bl.media_id, b, avg(x * x) AS z FROM bl JOIN sig ON sig.media_id = bl.media_id AND sample_index BETWEEN b * 2 AND b * 2 + 7 GROUP BY ALL), l AS (SELECT *, -0.691 + 10 * log10(z) AS lv FROM z WHERE z > 0), a AS (SELECT * FROM l WHERE lv > -70), g AS (SELECT media_id, -0.691 + 10 * log10(avg(z)) - 10 AS gate FROM a GROUP BY 1), r AS (SELECT a.media_id, -0.691 + 10 * log10(avg(z)) AS lufs FROM a JOIN g ON g.media_id = a.media_id AND a.lv > g.gate GROUP BY 1) SELECT len.media_id, round(lufs, 6) AS lufs FROM len LEFT JOIN r USING (media_id)")
def gated_loudness(spark, d):
    return r6(spectral.gated_loudness(t.signal(spark, d).select("media_id", "sample_index", "x"), 8, 2), "lufs")


_TIMES = f"{t.SIG}, ti AS (SELECT media_id, sample_index AS position, CASE WHEN event_id % 41 = 7 THEN 'nan'::DOUBLE WHEN event_id % 37 = 5 THEN sample_index * 0.031::DOUBLE - 0.04 ELSE sample_index * 0.031::DOUBLE END AS sec FROM sig)"


@query(f"WITH {_TIMES}, f AS (SELECT *, lag(sec) OVER (PARTITION BY media_id ORDER BY position) AS p FROM ti), b AS (SELECT *, isnan(sec) OR sec < 0 OR sec >= 1.9 OR coalesce(sec <= p, false) AS bad FROM f) SELECT media_id, position, CASE WHEN NOT bad THEN round_even(sec * 22050, 0)::BIGINT END AS sample_index, CASE WHEN bad THEN 'INVALID_NEURAL_BEAT_TIME' END AS fault FROM b")
def beat_event_validation(spark, d):
    s = t.signal(spark, d)
    e, i = F.col("event_id"), F.col("sample_index") * F.lit(0.031)
    sec = F.when(e % 41 == 7, F.lit(float("nan"))).when(e % 37 == 5, i - 0.04).otherwise(i)
    return spectral.beat_events(s.select("media_id", F.col("sample_index").alias("position"), sec.alias("sec"), F.lit(1.9).alias("duration_sec")))


@query(f"WITH {t.SIG}, len AS (SELECT media_id, count(*) AS n FROM sig GROUP BY 1), w AS (SELECT media_id, unnest(range(0, (n + 9) // 10)) AS window_index FROM len), v AS (SELECT w.media_id, window_index, j, coalesce(x, 0) AS x FROM w, (SELECT unnest(range(-3, 10)) AS j) LEFT JOIN sig ON sig.media_id = w.media_id AND sample_index = window_index * 10 + j) SELECT media_id, window_index, round(sum(x * (j + 4)), 6) AS digest, count(*) AS size FROM v GROUP BY ALL")
def vad_context_windows(spark, d):
    rows = spectral.vad_windows(spectral.chunks(t.signal(spark, d), 7), 10, 3)
    total = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("media_id", "window_index", F.round(total, 6).alias("digest"), F.size("samples").cast("long").alias("size"))


@query(f"WITH {t.SIG}, c AS (SELECT media_id, count(*) AS n FROM sig GROUP BY 1) SELECT media_id, round(n / 16000, 6) AS duration_sec FROM c")
def pcm_duration(spark, d):
    rows = t.signal(spark, d).groupBy("media_id").agg(F.count("*").alias("n"))
    return r6(rows.select("media_id", rates.sample_seconds(F.col("n"), F.lit(16000)).alias("duration_sec")), "duration_sec")
