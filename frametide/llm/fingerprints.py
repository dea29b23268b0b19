"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame operations only.

A text is the multiset of its paragraphs (lines). Each paragraph hashes to a wide vector: sixteen
32-bit lanes of its SHA-512, thirty 60-bit words that each pack two 30-bit bit counts over the hashes of its
clauses, and the number of those clauses. A text's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo 2^32 and 2^60. So the order of paragraphs does not matter,
equal multisets have equal fingerprints, and a paragraph is inserted or deleted by adding or
subtracting its own vector (``combine``). The counts also give a likeness: the cosine of the
centred counts estimates the overlap of the two multisets of clauses.

Null text counts as empty: one empty paragraph. The likeness of two texts with the same fingerprint is 1, of others without
clauses in common about 0. No lane wraps: a clause but the last of a paragraph has two characters at least, and a text less than 2^31.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.llm.common import Tables

STRONG_LANES, STRONG_MOD = 16, 1 << 32
#: A clause ends behind one of these marks, or with its paragraph, whose newline is part of no clause: clauses are those of each paragraph on its own.
CLAUSE_END = r"\n|(?<=[.,;:!?][^\S\n]?)(?=\S)"
WORDS, WORD_MOD, LANE_BITS, LANES_A_WORD = 30, 1 << 60, 30, 2
_MASK = sum(1 << (LANE_BITS * i) for i in range(LANES_A_WORD))


def _lanes(digest: Column) -> Column:
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(STRONG_LANES)])


def _add(a: Column, b: Column, mod: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) % F.lit(mod))


def vector(text: Column) -> Column:
    """array<long>: the strong lanes, the packed counts, and the number of clauses."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n")
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 512))
    strong = F.aggregate(digests, F.array_repeat(F.lit(0).cast("long"), STRONG_LANES), lambda acc, d: _add(acc, _lanes(d), STRONG_MOD))

    hashes = F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE_END), lambda c: F.xxhash64(c))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"w{i}") for i in range(WORDS)], F.lit(0).cast("long").alias("n"))
    counts = F.aggregate(
        hashes,
        zero,
        lambda acc, h: F.struct(*[((acc[f"w{i}"] + F.shiftright(h, i).bitwiseAND(F.lit(_MASK))) % F.lit(WORD_MOD)).alias(f"w{i}") for i in range(WORDS)], (acc["n"] + 1).alias("n")),
        lambda acc: F.array(*[acc[f"w{i}"] for i in range(WORDS)], acc["n"]),
    )
    return F.concat(strong, counts)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the union (sign 1) of two multisets of paragraphs, or of a without b (sign -1)."""
    mods = F.lit([STRONG_MOD] * STRONG_LANES + [WORD_MOD] * (WORDS + 1))
    signed = b if sign > 0 else F.transform(b, lambda x: -x)
    return F.zip_with(F.zip_with(a, signed, lambda x, y: x + y), mods, lambda x, m: F.pmod(x, m))


def render(v: Column) -> Column:
    """Lower-case hex, strong lanes first."""
    return F.lower(F.concat(F.array_join(F.transform(F.slice(v, 1, STRONG_LANES), lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.array_join(F.transform(F.slice(v, STRONG_LANES + 1, WORDS + 1), lambda x: F.lpad(F.hex(x), 15, "0")), "")))


def _centred(v: Column) -> Column:
    n = F.element_at(v, STRONG_LANES + WORDS + 1)
    lanes = F.flatten(F.transform(F.slice(v, STRONG_LANES + 1, WORDS), lambda w: F.array(*[F.shiftright(w, LANE_BITS * i).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) for i in range(LANES_A_WORD)])))
    return F.transform(lanes, lambda x: (2 * x - n).cast("double"))


def centred(v: Column) -> Column:
    """What ``likeness_of`` compares: the centred counts."""
    return _centred(v)


def likeness_of(same: Column, a: Column, b: Column) -> Column:
    """Cosine of two arrays of centred counts, 0 to 1; 1 where ``same`` holds."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(same, F.lit(1.0)).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def fingerprint(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vector, fingerprint) for each row."""
    out = df.select(id_col, vector(F.col(text_col)).alias("vector"))
    return out.withColumn("fingerprint", render(F.col("vector")))


def order(rows: DataFrame, tables: Tables) -> DataFrame:
    """For each distinct (key, text_key) the one before it in the order of descending key, then text_key; the first one's is the last.

    ``rows`` are narrow: (key, text_key, id, n_chars). They are dealt in ranges of that order, so no task holds more than a range,
    however often a key comes; the driver holds the last row of each range. Returned: (key, text_key, before), before a struct with copies.
    """
    each = rows.groupBy("key", "text_key").agg(F.max("id").alias("id"), F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    parts = tables.keep(each.repartitionByRange(F.col("key").desc(), F.col("text_key")).withColumn("part", F.spark_partition_id()), "order")
    row = F.struct("key", "text_key", "id", "n_chars", "copies")
    late = F.struct(F.bitwise_not("key"), "text_key")  # turns the order round
    ends = sorted(((r["part"], r["last"]) for r in parts.groupBy("part").agg(F.max_by(row, late).alias("last")).collect()), key=lambda r: r[0])
    others = [(part, ends[i - 1][1]) for i, (part, _) in enumerate(ends)]
    table = F.broadcast(rows.sparkSession.createDataFrame(others, "part int, other struct<key: bigint, text_key: bigint, id: bigint, n_chars: int, copies: bigint>"))  # as many rows as ranges
    before = F.lag(row).over(Window.partitionBy("part").orderBy(F.col("key").desc(), "text_key"))
    return tables.keep(parts.join(table, "part").select("key", "text_key", F.coalesce(before, F.col("other")).alias("before")), "next")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def edit_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with the likenesses to the edited text and to the next document.

    The next document is the one that follows in descending id order; null ids come last, texts under one id follow each other in the
    order of a hash. Equal rows are computed once: all of them but the last are followed by a row like themselves. Each text sends
    the one before it no more characters than that one's edit needs.
    """
    kind = dict(df.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    with Tables(df.sparkSession, "fingerprints") as tables:
        path = order(rows.select("key", "text_key", "id", F.char_length("text").alias("n_chars")), tables)
        same, many = ["key", "text_key"], F.col("before.copies") > 1
        texts = rows.select(*same, "text")
        if not path.where(many).isEmpty():
            texts = texts.dropDuplicates(same)
        ahead = texts.join(path, same)
        ahead = ahead.select(F.col("before.key").alias("key"), F.col("before.text_key").alias("text_key"), "before.id", "before.copies", F.substring("text", F.lit(1), F.floor(F.col("before.n_chars") / 2).cast("int")).alias("ahead"), vector(F.col("text")).alias("x"))
        out = texts.join(ahead, same).select("id", "copies", "text", "ahead", vector(F.col("text")).alias("v"), "x")
        one = lambda ahead, x, times: F.struct(edited(F.col("text"), F.col(ahead)).alias("edited"), F.col(x).alias("x"), times.cast("long").alias("times"))
        cases = F.when(F.col("copies") > 1, F.array(one("ahead", "x", F.lit(1)), one("text", "v", F.col("copies") - 1))).otherwise(F.array(one("ahead", "x", F.lit(1))))
        out = out.select("id", F.char_length("text").cast("long").alias("n_chars"), "v", F.explode(cases).alias("case"))
        out = out.select("id", "n_chars", F.sha2("case.edited", 256).alias("edited_sha256"), "v", vector(F.col("case.edited")).alias("e"), "case.x", "case.times")
        out = out.select("*", *[centred(F.col(c)).alias(f"c{c}") for c in "vex"])
        out = out.select(F.col("id").cast(kind).alias("doc_id"), "n_chars", "edited_sha256", render(F.col("v")).alias("fingerprint"), render(F.col("e")).alias("edited_fingerprint"), likeness_of(F.col("v") == F.col("e"), F.col("cv"), F.col("ce")).alias("near_edited"), likeness_of(F.col("v") == F.col("x"), F.col("cv"), F.col("cx")).alias("near_next"), "times")
        return tables.result(out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")).drop("times", "_"))
