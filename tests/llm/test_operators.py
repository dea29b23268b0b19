"""Corpus operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from frametide.llm import chat_format, decontaminate, fingerprints, jaccard_join, license_scan, quality_rules, queries, sentencepiece_codec, sharding, substring_dedup, toxicity
from frametide.llm.common import Tables, Words, connected_components, utf8

SCHEMA = "doc_id long, text string, lang string, score double, key string, n long"
PROSE = " ".join(f"word{i * 7 % 61}x{i}" for i in range(220))
PASSAGE = " ".join(f"shared{i}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE), (2, PROSE), (3, PROSE.replace("word7x1 ", "other ")), (4, "start here " + PASSAGE + " and end"), (5, "quite another " + PASSAGE + " tail"), (6, None), (7, ""), (8, "a b"), (9, "A B"), (10, " \t\n"), (11, "long " * 30000), (12, "é🙂 x\x00y ▁z\n\n  end "), (12, "é🙂 x\x00y ▁z\n\n  end ")]
    return spark.createDataFrame([(i, t, None, 1.0, "k", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_pattern():
    texts = ["", " a  B\tc", "x", "é ü\x0b1", "a" * 50]
    w = Words(*utf8(pa.array(texts)))
    found = [[bytes(w.data[s:e]).decode().lower() for s, e, d in zip(w.start, w.end, w.doc) if d == i] for i in range(len(texts))]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21)], "u long, v long")
    with Tables(spark, "test") as tables:
        got = {r["node"]: r["component"] for r in connected_components(edges, tables).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_sentencepiece(docs, nothing):
    import sentencepiece

    model = queries.tokenizer_model()
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = docs.select("doc_id", "text").collect()
    got = sentencepiece_codec.encode(docs, model).collect()
    want = sorted((r["doc_id"], lib.encode(r["text"] or ""), lib.decode(lib.encode(r["text"] or ""))) for r in rows)
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in got) == want
    small = sentencepiece_codec.ChunkTable(model, most=3)
    assert small.by_chunk and [list(x) for x in small.encode_decode([PROSE])[0]] == [lib.encode(PROSE)]
    assert sentencepiece_codec.encode(nothing, model).count() == 0
    piece = lambda kind: b"\x0a\x04" + b"\x0a\x00" + b"\x18" + bytes([kind])
    spec = lambda *f: b"\x1a" + bytes([len(f)]) + bytes(f)
    assert sentencepiece_codec.keeps_text(model) and sentencepiece_codec.keeps_text(piece(1) + spec(0x18, 1, 0x20, 0))
    for changed in (piece(4) + spec(0x20, 0), piece(1), piece(1) + spec(0x20, 1), piece(1) + spec(0x18, 0, 0x20, 0), piece(1) + spec(0x20, 0, 0x28, 0), piece(1) + spec(0x12, 1, 7, 0x20, 0), b"\x12\x03\xc0\x01\x01" + spec(0x20, 0)):
        assert not sentencepiece_codec.keeps_text(changed)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    return {i: (len(sets[i]), of[i]) for i in sets}


def test_jaccard(docs, nothing):
    got = jaccard_join.components(docs).collect()
    assert len(got) == 13
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert jaccard_join.components(nothing).count() == 0


def test_jaccard_copies_of_all_sizes(spark):
    rows = []
    for group, sizes in enumerate([(380, 384), (384, 385), (386, 390), (360, 400), (383, 386, 389), (20, 21), (900, 1000), (384, 460)]):
        rows += [(100 * group + k, " ".join(f"g{group}w{i}" for i in range(n + 3))) for k, n in enumerate(sizes)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_count_tree_finds_all():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 300).astype(np.uint64) * np.uint64(7919)) for _ in range(120)]
    points = np.stack([np.bincount((s % np.uint64(jaccard_join.GROUPS)).astype(int), minlength=jaccard_join.GROUPS) for s in sets])
    tree = jaccard_join.CountTree(points, np.array([len(s) for s in sets]))
    for i, s in enumerate(sets):
        near = set(tree.search(points[i], len(s))[0].tolist())
        assert {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 85 * len(np.union1d(s, o))} <= near


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(3)
    values, row = rng.integers(0, 2**60, 400).astype(np.uint64) << np.uint64(3), np.repeat([0, 1, 2], [150, 30, 220])
    got = set(zip(*(x.tolist() for x in substring_dedup.compact_windows(values, row, 20)), strict=True))
    want = set()
    for c in range(400):
        left, right = c, c
        while left > 0 and row[left - 1] == row[c] and values[left - 1] > values[c]:
            left -= 1
        while right < 399 and row[right + 1] == row[c] and values[right + 1] > values[c]:
            right += 1
        if right - left + 1 >= 20:
            want.add((c, left, right))
    assert got == want


def test_substring_repeats_and_cut(docs, nothing):
    spans = substring_dedup.repeats(docs)
    rows = [r for r in spans.collect() if r["doc_id"] == 5]
    assert rows and all(r["source_id"] == 4 for r in rows)
    assert "quite another  tail".split() == substring_dedup.cut(docs, spans).where("doc_id = 5").head()["text"].split()
    assert {r["doc_id"] for r in spans.collect()} == {2, 3, 5}
    assert substring_dedup.cut(docs, spans).columns == docs.columns and substring_dedup.repeats(nothing).count() == 0


def context_rows():
    """Passages of two or three lines that each stand alone in an earlier document, shared by two later documents (and twice by one)."""
    rows = []
    for g in range(12):
        text = lambda name, n, g=g: " ".join(f"{name}{g}x{i}" for i in range(n))
        lines = [text("first", 25), text("second", 25), text("third", 25)][: 2 + g % 2]
        rows += [(100 * g + k, text(f"own{k}", 60) + " " + line + " " + text(f"end{k}", 60)) for k, line in enumerate(lines)]
        whole = " ".join(lines)
        rows += [(100 * g + 50, text("before", 55) + " é " + whole + " " + text("after", 70)), (100 * g + 60, text("other", 52) + " " + whole + " " + text("tail", 61) + " " + whole)]
    return rows


def check_contexts(spark, rows, parts):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    texts, spans = dict(rows), substring_dedup.repeats(table).collect()
    assert {r["doc_id"] for r in spans} == {i for i in texts if i % 100 == 60}
    for i in (i for i in texts if i % 100 == 60):
        covered = {c for r in spans if r["doc_id"] == i for c in range(r["start"], r["end"])}
        passage = re.search(f"first{i // 100}x0 .*(second{i // 100}x24|third{i // 100}x24)(?= tail)", texts[i])[0]
        assert texts[i].count(passage) == 2 and all(covered >= set(range(m.start(), m.end())) for m in re.finditer(passage, texts[i]))
    for r in spans:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == texts[r["source_id"]][r["source_start"] : r["source_end"]] and r["n_words"] == len(texts[r["doc_id"]][r["start"] : r["end"]].split()) >= 50


def test_substring_passages_of_frequent_lines(spark):
    check_contexts(spark, context_rows(), 7)


@pytest.mark.parametrize("hot", [0, 100_000])
def test_substring_passages_do_not_depend_on_layout(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_TOKENS", hot)
    first, later, texts = [], [], {}
    for g in range(8):
        text = lambda name, n, g=g: " ".join(f"{name}{g}x{i}" for i in range(n))
        lines = [text("first", 25), text("second", 25)]
        for k, body in ((0, " ".join(lines)), (1, lines[0]), (2, lines[1]), (3, lines[0]), (4, lines[1]), (60, " ".join(lines))):
            texts[100 * g + k] = text(f"own{k}", 60) + " " + body + " " + text(f"end{k}", 60)
            (later if k else first).append((100 * g + k, texts[100 * g + k]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        # The copies' task holds earlier texts with the lines alone, the whole passage is in another task; then all in one task.
        one = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        found = [substring_dedup.repeats(t).collect() for t in (one(first).union(one(sorted(later, key=lambda r: (r[0] % 100, r[0])))), one(first + later), one(later[::-1] + first))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for spans in found:
        for g in range(8):
            mine = [r for r in spans if r["doc_id"] == 100 * g + 60 and r["source_id"] == 100 * g]
            covered = {c for r in mine for c in range(r["start"], r["end"])}
            at = re.search(f"first{g}x0 .* second{g}x24(?= )", texts[100 * g + 60])
            assert covered >= set(range(at.start(), at.end()))


def distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_and_matches(spark, docs, nothing):
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 80), rng.integers(1, 90)))
        assert decontaminate.myers(decontaminate.masks(a), len(a), b)[0] == distance(a, b)
    item = "the quick brown fox jumps over the lazy dog and runs away from there quickly"
    items = spark.createDataFrame([(1, item), (2, None), (3, " "), (4, item)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "xx " + item.upper().replace("FOX", "FOXX") + " yy", 1), (2, "nothing of that kind", 1), (3, None, 1)], "doc_id long, text string, item_id int")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find(texts, items).collect()) == [(1, 1, 1), (1, 4, 1)]
    assert decontaminate.find(nothing, items).count() == 0 and decontaminate.find(docs, items.limit(0)).count() == 0


def test_licenses(spark, docs, nothing):
    rows = [(1, "Prose before.\nReleased under the MIT License.\nMore"), (2, "Released under some other License."), (3, license_scan.TEMPLATES["BSD-3-Clause"]), (4, None)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == [(1, "MIT-notice"), (3, "BSD-2-Clause"), (3, "BSD-3-Clause")]
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(nothing).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]\\( \\\\n <|end|>\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 2, "user", None), (2, 0, "user", "alone"), (3, 0, None, "x"), (3, 1, "assistant", ""), (3, 2, "assistant", "two"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.expand(df)
    assert {r["conv_id"]: r["n_examples"] for r in examples.collect()} == {1: 2, 2: 1, 3: 2, None: 1}
    for r in chat_format.read_back(examples).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.expand(df.limit(0))).count() == 0


def test_sharding(docs, nothing):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == 13
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert sharding.shard(nothing, 4).count() == 0


def test_packing_is_even():
    w = np.random.default_rng(2).lognormal(0, 1, (3000, 3))
    capacity = np.tile(w.sum(axis=0) / 16, (16, 1))
    shard, left = sharding.pack(w, capacity)
    load = np.bincount(shard, weights=w[:, 0], minlength=16)
    assert load.max() / load.min() < 1.02 and np.allclose(capacity[:, 0] - load, left[:, 0])


def test_fingerprints(spark, docs, nothing):
    rows = spark.createDataFrame([(1, "one\ntwo, three\nfour"), (2, "four\none\ntwo, three"), (3, "one\nfour"), (4, None), (5, "")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in fingerprints.fingerprint(rows).collect()}
    assert by[4]["fingerprint"] == by[5]["fingerprint"] != by[3]["fingerprint"]
    strong = 8 * fingerprints.STRONG_LANES
    assert by[1]["fingerprint"][:strong] == by[2]["fingerprint"][:strong]
    report = {r["doc_id"]: r for r in fingerprints.edit_report(rows).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for i, j in ((5, 4), (4, 3), (3, 2), (2, 1), (1, 5)):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        assert report[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and report[i]["n_chars"] == len(texts[i])
    assert fingerprints.edit_report(docs).count() == 13 and fingerprints.edit_report(nothing).count() == 0


def test_fingerprints_are_sums_over_paragraphs(spark):
    from pyspark.sql import functions as F

    whole = ["one", "two, three; x", "  lead. in:", "", "a.", "b!", "\tz ,\r", "four.five", "a."]
    texts = {"whole": whole, "back": whole[::-1], "turned": whole[3:] + whole[:3], "less": whole[:-2], "last": whole[-2:], "more": [*whole, "new, one"], "new": ["new, one"]}
    rows = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()] + [(f"p{i}", p) for i, p in enumerate(whole)], "doc_id string, text string")
    by = {r["doc_id"]: r for r in fingerprints.fingerprint(rows).collect()}
    assert by["whole"]["fingerprint"] == by["back"]["fingerprint"] == by["turned"]["fingerprint"] != by["less"]["fingerprint"]

    def combined(a, b, sign):
        return spark.createDataFrame([(by[a]["vector"], by[b]["vector"])], "a array<long>, b array<long>").select(fingerprints.combine(F.col("a"), F.col("b"), sign).alias("v")).head()["v"]

    for a, b, sign, want in (("less", "last", 1, "whole"), ("whole", "last", -1, "less"), ("whole", "new", 1, "more"), ("more", "new", -1, "back")):
        assert combined(a, b, sign) == by[want]["vector"]
    mods = [fingerprints.STRONG_MOD] * fingerprints.STRONG_LANES + [fingerprints.WORD_MOD] * (fingerprints.WORDS + 1)
    assert [sum(x) % m for x, m in zip(zip(*(by[f"p{i}"]["vector"] for i in range(len(whole)))), mods)] == by["whole"]["vector"]


def test_toxicity_and_quality_fit(spark, docs, nothing):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(200)]
    bad = lambda k: " ".join(["horrible" if k and i % 20 == 3 else words[j] for i, j in enumerate(rng.integers(0, 200, 60))])
    model = toxicity.fit([bad(i % 2) for i in range(200)], [i % 2 for i in range(200)])
    scores = toxicity.Scorer(model).score([bad(1), bad(0), "", None])
    assert scores[0] > 0.7 > scores[1] and scores[2] == scores[3]
    assert docs.select(toxicity.score_column(model)(docs.text).alias("s")).where("s between 0 and 1").count() == 13
    texts = spark.createDataFrame([(i, ("Good words here. " * 9) if i % 2 else "## $$ @@ !! " * 9) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    fitted = quality_rules.train(texts, labels)
    assert fitted.rules and quality_rules.score(texts, fitted).where("(score >= 0.7) = (doc_id % 2 = 1)").count() == 80
    assert quality_rules.score(docs, fitted).where("score between 0 and 1").count() == 13 and quality_rules.score(nothing, fitted).count() == 0
    assert quality_rules.train(nothing, labels.limit(0)).rules == ()


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_edited_passages_of_frequent_lines(spark, parts):
    """Two earlier documents hold a line of a passage each; it is found in the third, though it has an edit in every run of 50 words."""
    rows = []
    for g in range(40):
        text = lambda name, n, g=g: " ".join(f"{name}{g}x{i}" for i in range(n))
        first, second = text("first", 27), text("second", 27)
        rows += [(100 * g + k, f"{text(f'own{k}', 60)} {line} {text(f'end{k}', 60)}") for k, line in enumerate((first, second))]
        rows += [(100 * g + 50, f"{text('before', 55)} é {first} odd{g} {second} {text('after', 70)}"), (100 * g + 60, f"{text('other', 52)} {first} even{g} {second} {text('tail', 61)}")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    got = {(r["doc_id"], r["source_id"], r["n_words"]) for r in substring_dedup.repeats(table).collect()}
    assert {(i, source) for i, source, _ in got} == {(100 * g + 60, 100 * g + 50) for g in range(40)}
    assert sum((100 * g + 60, 100 * g + 50, 55) in got for g in range(40)) >= 39


def test_substring_many_sources(spark, monkeypatch):
    """As many documents hold a line in other contexts as are cut into pieces; each of the edited copies is covered."""
    monkeypatch.setattr(substring_dedup, "PIECE", 16)
    text = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    first, second = text("first", 27), text("second", 27)
    rows = [(i, f"{text(f'own{i}', 60)} {(first, second)[i % 2]} {text(f'end{i}', 60)}") for i in range(60)]
    rows += [(100 + i, f"{text(f'before{i}', 55)} {first} edit{i} {second} {text(f'after{i}', 70)}") for i in range(20)]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"] for r in got} == set(range(101, 120)) and all(r["source_id"] >= 100 and r["similarity"] >= 0.8 for r in got)


def frequent_windows(texts):
    """Windows of all tokens of the texts, as sources, and of the last text as looking for one, by (key, piece)."""
    column = pa.array([[c for c in range(60)] for _ in texts], pa.list_(pa.int32()))
    found = pa.array([[]] * len(texts), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), column, found], names=["doc_id", "text", "centres", "found"])
    rows = [r for b in substring_dedup._open(46)(iter([batch])) for r in b.to_pylist()]
    lists = [[{x: r[x] for x in ("key", "c", "l", "r", "a", "b")} | {"pieces": 1, "role": 2 if i == len(texts) - 1 else 1} for r in rows if r["doc"] == i] for i in range(len(texts))]
    kind = pa.list_(pa.struct([("key", pa.int64()), *((x, pa.int32()) for x in ("c", "l", "r", "a", "b", "pieces", "role"))]))
    contexts = list(substring_dedup._contexts(46)(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, kind)], names=["doc_id", "text", "windows"])])))
    return len(rows), pa.Table.from_batches(contexts).sort_by([("key", "ascending"), ("piece", "ascending")]).combine_chunks().to_batches()[0]


def test_substring_sources_within_others_are_not_sent():
    made, table = frequent_windows([" ".join(["word"] * 90), " ".join(["word"] * 120 + [f"x{i}" for i in range(30)])])
    sources = [(r["key"], r["doc"], r["lo"], r["hi"]) for r in table.to_pylist() if r["role"] == 1]
    assert made > len(sources) > 0
    assert not [1 for a in sources for b in sources if a is not b and a[:2] == b[:2] and b[2] <= a[2] and a[3] <= b[3]]


def test_substring_patterns_are_judged_once(monkeypatch):
    """Many sources hold the same line of a window: one row is judged for all of them; the one that holds more is found."""
    line, own = " ".join(f"line{i}" for i in range(42)), " ".join(f"own{i}" for i in range(40))
    texts = [f"{line} {' '.join(f't{k}x{i}' for i in range(40))}" for k in range(200)] + [f"{line} {own}", f"{line} {own} end"]
    judged, reaches = [], substring_dedup._reaches
    monkeypatch.setattr(substring_dedup, "_reaches", lambda both, *rest: (judged.append(len(both)), reaches(both, *rest))[1])
    _, table = frequent_windows(texts)
    links = np.concatenate(list(substring_dedup._compared(table)))
    assert set(links[:, 1].tolist()) == {201} and set(links[:, 5].tolist()) == {200} and sum(judged) <= 2 * sum(r["role"] == 2 for r in table.to_pylist())


def test_substring_windows_travel_packed():
    """A task sends one row for each bucket of keys, not one for each window, and all windows arrive sorted out by bucket."""
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sent = list(substring_dedup._generate(46, 4)(iter([batch])))
    assert sum(b.num_rows for b in sent) <= 16
    table = pa.Table.from_batches(sent).sort_by("bucket").combine_chunks().to_batches(max_chunksize=3)
    rows = np.concatenate(list(substring_dedup._buckets(iter(table), substring_dedup._ROW)))
    made = [substring_dedup._windows(words, np.arange(lo, lo + words.rows), 46) for lo, words in substring_dedup.word_blocks(batch.column(1))]
    assert sorted(map(tuple, rows[:, :5].tolist())) == sorted(map(tuple, np.concatenate(made).tolist()))
    assert (np.diff((rows[:, 0].view(np.uint64) >> np.uint64(60)).astype(int)) >= 0).all()


@pytest.mark.parametrize("size", [3, 7, 20])
def test_substring_intervals_go_on_in_the_next_batch(size):
    rows = np.array([[0, doc, 10 * i, 10 * i, 10 * i + 30, 0, 10 * i, 10 * i, 10 * i + 30] for doc in (1, 2) for i in range(10)])
    batch = substring_dedup._batch(rows)
    got = [r for b in substring_dedup._chain(iter([batch.slice(i, size) for i in range(0, 20, size)])) for r in b.to_pylist()]
    assert got == [{"doc": doc, "lo": 0, "hi": 120, "rdoc": 0, "rlo": 0, "rhi": 120} for doc in (1, 2)]
