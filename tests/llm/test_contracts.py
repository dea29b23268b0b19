"""Queries against SQL or brute force, repeated ids, hot groups, planted edits, and the pipeline's stages."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frametide.llm import decontaminate, fingerprints, jaccard_join, license_scan, quality_rules, queries, sharding, substring_dedup, toxicity
from frametide.llm.common import Tables, shared_dir
from tests.llm.test_operators import brute_components, distance

SF = "/root/testdata/sf0.001"


def text(name, n, first=0):
    return " ".join(f"{name}{i}" for i in range(first, first + n))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_jaccard_ids_of_several_texts(spark):
    x, y = text("x", 60), text("y", 60)
    rows = [(1, x), (1, y), (2, x + " end"), (3, y + " end"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (None, y), (None, text("z", 9)), (7, ""), (8, None)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 4), (None, 1), (None, None), (7, 7), (8, 8)], key=str)


def test_jaccard_blocks_of_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIECE", 8)
    rng = random.Random(3)
    rows = []
    for i in range(60):  # a hub of near copies and its neighbours
        words = text("hub", 80).split()
        words[rng.randrange(80)] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, text(f"far{i}x", 20 + i)) for i in range(20)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def tokens(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_substring_against_all_pairs(spark):
    """Every run of 50 words that an earlier document holds lies in a reported passage; every report is similar enough."""
    rng = random.Random(11)
    shared = [text(f"s{k}x", 90) for k in range(12)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(shared).split()
            a = rng.randrange(0, 40)
            words = words[a : a + rng.randrange(30, 90)]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = f"edit{i}"
            parts += [text(f"own{i}x", rng.randrange(5, 40), rng.randrange(1000)), " ".join(words)]
        rows.append((i, " ".join(parts)))
    texts = dict(rows)
    spans = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    covered = {}
    for r in spans:
        mine, source = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["source_id"]][r["source_start"] : r["source_end"]]
        a, b = set(tokens(mine)), set(tokens(source))
        assert r["source_id"] < r["doc_id"] and r["n_words"] == len(mine.split()) >= 50 and len(a & b) >= 0.8 * len(a | b) - 1e-9
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    seen, missed = set(), 0
    for i, t in rows:
        places = [m.span() for m in re.finditer(r"\S+", t)]
        words = t.split()
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        for k, run in enumerate(runs):
            missed += run in seen and not covered.get(i, set()) >= set(range(places[k][0], places[k + 49][1]))
        seen |= set(runs)
    assert missed == 0


def test_substring_first_holders_of_parts(spark):
    """Two earlier documents hold most of a passage each, below what counts; the copy is still found in the document that has all of it."""
    rows = []
    for g in range(40):
        words = text(f"p{g}x", 60).split()
        rows += [(10 * g + 1, f"{text(f'a{g}x', 30)} {' '.join(words[:45])}"), (10 * g + 2, f"{' '.join(words[15:])} {text(f'b{g}x', 30)}")]
        rows += [(10 * g + 3, f"{text(f'c{g}x', 30)} {' '.join(words)}"), (10 * g + 4, f"{text(f'd{g}x', 30)} {' '.join(words)} end{g}")]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(10 * g + 4, 10 * g + 3) for g in range(40)}
    texts = dict(rows)
    for i in (10 * g + 4 for g in range(40)):
        covered = {c for r in got if r["doc_id"] == i for c in range(r["start"], r["end"])}
        assert covered == set(range(texts[i].index("p"), texts[i].index(" end")))


def test_substring_repeated_ids_and_long_insertions(spark):
    one, other = text("one", 70), text("other", 90)
    long = text("long", 400)
    words = long.split()
    rows = [(1, one), (2, text("own", 60) + " " + one), (2, other + " unlike"), (5, other), (5, other), (None, other), (6, long), (7, " ".join([*words[:200], *text("new", 45).split(), *words[200:]]))]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, text_key string")
    spans = substring_dedup.repeats(df)
    assert sorted({(r["doc_id"], r["n_words"], r["source_id"]) for r in spans.collect()}) == [(2, 70, 1), (5, 90, 2), (7, 445, 6)]
    left = [(r["doc_id"], len(r["text"].split())) for r in substring_dedup.cut(df, spans).collect()]
    assert sorted(left, key=str) == sorted([(1, 70), (2, 60), (2, 91), (5, 0), (5, 0), (None, 90), (6, 400), (7, 0)], key=str)


def test_decontamination_query_against_all_substrings(spark):
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(20, 60)))) for i in range(8)]
    rows = []
    for i in range(40):
        body = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 4)):
            body[rng.randrange(len(body))] = rng.choice("abcdefg")
        rows.append((i, "zz yy " + "".join(body) + " xx" * rng.randrange(1, 30)))
    got = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=100)
    want = set()
    for i, t in rows:
        for k, item in items:
            pattern, norm = decontaminate.normalise(item), decontaminate.normalise(t)
            if distance(pattern, norm) <= int(decontaminate.RATE * len(pattern)):
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


def test_license_scan_against_brute_force(spark):
    rng = random.Random(2)
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    rows = []
    for name, t in license_scan.TEMPLATES.items():
        for gap in (0, 60, 27, 7):
            ws = t.split()
            for k in range(gap - 1, len(ws), gap) if gap else ():
                ws[k] = "changed"
            rows.append((len(rows), name, gap, text("before", rng.randrange(3, 150)) + " " + " ".join(ws) + " " + text("after", rng.randrange(3, 90))))
    rows += [(len(rows) + i, "", 0, t) for i, t in enumerate(["Released under the terms of the MIT License.", "Released under some other License.", "", None])]
    df = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(df).collect()}
    want = set()
    for i, _, _, t in rows:
        own = set(grams(words(t or "")))
        for name, template in license_scan.TEMPLATES.items():
            g = set(grams(words(template)))
            if len(g & own) >= license_scan.CONTAINMENT * len(g):
                want.add((i, name))
    assert got <= want and len(want - got) <= 0.02 * len(want)
    assert {(i, name) for i, name, gap, _ in rows if gap == 0 and name} <= got and (len(rows) - 4, "MIT-terms") in got


def test_sharding_of_groups(spark):
    rows = [(i, f"text {i} " * (i % 17 + 1)) for i in range(600)] + [(1000 + i, "copy of a group") for i in range(300)] + [(2000 + i, None if i % 2 else "") for i in range(10)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, cell=100).toPandas()
    assert len(got) == len(rows) and sorted(got.doc_id) == sorted(i for i, _ in rows)
    texts = {i: t or "" for i, t in rows}
    import zlib

    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.itertuples())
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 4 and load.max() - load.min() <= 0.02 * load.mean()
    of = got[(got.doc_id < 1000) | (got.doc_id >= 2000)].assign(t=lambda d: d.doc_id.map(texts))
    assert (of.groupby("t")["shard"].nunique() == 1).all()


def test_fingerprints_of_extreme_and_repeated_ids(spark):
    rows = [(2**63 - 1, "a b, c"), (2**63 - 2, "zz\nyy, xx"), (-(2**63) + 1, "low"), (1, "one"), (1, "one"), (1, "two, three"), *[(5, "x" * 9)] * 40, (None, "nul")]
    got = fingerprints.edit_report(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")).collect()
    assert len(got) == len(rows)
    shas = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["edited_sha256"])
    assert by[2**63 - 1] == [shas("a b, c", "zz\nyy, xx")] and by[2**63 - 2] == [shas("zz\nyy, xx", "x" * 9)]
    assert by[5].count(shas("x" * 9, "x" * 9)) == 39 and by[None] == [shas("nul", "a b, c")] and by[-(2**63) + 1] == [shas("low", "nul")]
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == 39


def test_toxicity_scores_against_plain_loops(spark):
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.1, 1.3, -0.2)
    rows = ["", None, "One two", "Misspeled wörds é", text("many", 900), "\n\t ", "a_b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.score_column(model)(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(rows):
        words = [w for w in re.findall(r"[^\W_]+", (t or "").lower())]
        parts = [float(np.mean([model.gram[g] for g in toxicity.subwords(w)])) for w in words]
        n = toxicity.WINDOW
        means = [sum(parts[k : k + n]) / len(parts[k : k + n]) for k in range(0, len(parts), n)]
        z = model.scale * ((max(means) if means else 0.0) + model.bias) + model.shift
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_rules_against_plain_loops(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Word", "x", "12", "$$", "long-er.", "!"]) for _ in range(rng.randrange(0, 60))) if i else None) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("$$" in (t or ""))) for i, t in rows] * 2, "doc_id long, quality int")
    model = quality_rules.train(df, labels)
    stats = df.select("doc_id", *[v.alias(k) for k, v in quality_rules.statistics(F.col("text")).items()]).toPandas().set_index("doc_id")
    z = np.full(len(stats), model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        z += weight * rule.holds({k: stats[k].to_numpy() for k in stats})
    got = quality_rules.score(df, model).toPandas().set_index("doc_id").score.loc[stats.index]
    assert model.rules and np.allclose(got, 1 / (1 + np.exp(-z)))


def corpus(spark):
    prose = text("prose", 120)
    item = "the quick brown fox jumps over the lazy dog and runs away from there quickly"
    rows = [(1, prose), (2, prose + " end"), (3, text("own", 60) + " " + text("pass", 70)), (4, text("pass", 70) + " tail"), (5, None), (6, ""), (7, "x " + item + " y"), (8, "word " * 20000), (9, "plain"), (9, "plain"), (10, "other words")]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")


def test_pipeline_stages(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from there quickly"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus(spark)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    flat = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0, 1.0, -3.0)
    monkeypatch.setattr(queries, "toxicity_model", lambda spark, sf_dir: flat)
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == ids(docs)
    monkeypatch.setattr(queries, "toxicity_model", lambda spark, sf_dir: toxicity.Model(flat.gram, 0.0, 1.0, 3.0))
    assert ids(stages["toxicity"](spark, docs, str(tmp_path))) == []
    kept = stages["jaccard_join"](spark, docs, str(tmp_path))
    assert ids(kept) == [1, 3, 4, 5, 6, 7, 8, 9, 9, 10] and kept.columns == docs.columns
    cut = {(r["doc_id"], r["text"], r["n_chars"]) for r in stages["substring_dedup"](spark, kept, str(tmp_path)).collect()}
    assert (4, " tail", 5) in cut and (5, None, None) in cut and (9, "plain", 5) in cut and len(cut) == 9
    assert ids(stages["decontamination"](spark, docs, str(tmp_path))) == [i for i in ids(docs) if i != 7]
    tokens = stages["sentencepiece"](spark, docs, str(tmp_path))
    assert ids(tokens) == ids(docs) and tokens.where("doc_id in (5, 6)").agg(F.sum("n_tokens")).head()[0] == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_runs_and_leaves_no_tables(spark):
    before = set(os.listdir(f"{shared_dir(spark)}/frametide"))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert all(x.endswith("-result") for x in set(os.listdir(f"{shared_dir(spark)}/frametide")) - before)


def test_tables_go(spark):
    with pytest.raises(ValueError), Tables(spark, "gone") as tables:
        tables.keep(spark.range(3), "a")
        raise ValueError
    assert not [x for x in os.listdir(f"{shared_dir(spark)}/frametide") if x.startswith("gone")]


def test_toxicity_generalises_to_misspellings():
    """Misspellings that no training text holds: the words they disguise share character n-grams with them."""
    rng = random.Random(3)
    syllables = ["ba", "du", "fen", "gor", "hil", "jam", "kep", "lom", "mur", "nil", "pos", "ros", "tav"]
    plain = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    insults = ["worthless", "pathetic", "disgusting", "horrible"]

    def text(bad):
        words = [rng.choice(plain) for _ in range(120)]
        for _ in range(3 if bad else 0):
            words[rng.randrange(120)] = rng.choice(bad)
        return " ".join(words)

    texts = [text(insults if i % 2 else None) for i in range(400)]
    scorer = toxicity.Scorer(toxicity.fit(texts, [i % 2 for i in range(400)]))
    disguised = ["worthles", "patheticc", "disgustingg", "horriblle", "pathetics", "worthlesss"]
    assert not any(w in t.split() for t in texts for w in disguised)
    caught = scorer.score([text(disguised) for _ in range(100)]) >= queries.THRESHOLD
    clean = scorer.score([text(None) for _ in range(100)]) < queries.THRESHOLD
    assert caught.mean() >= 0.9 and clean.mean() >= 0.9
