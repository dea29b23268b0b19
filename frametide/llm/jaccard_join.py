"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds its distinct shingles of four words (of all its words if there are fewer). Shingles are hashed into ``GROUPS``
groups, and a set becomes the point of its group counts. Two sets share at most the sum of the
smaller of the two counts of each group; in a tree of boxes over points the same sum with a box's
largest counts bounds the overlap with everything below it, so whole subtrees are passed over. Pairs
that survive are verified exactly on the whole texts.

One tree over all rows could not be distributed, so trees stand in blocks: sets that agree on a band of
three min-hashes (of ``BANDS``) share a block. A pair at similarity 0.85 shares none of 32 bands with a probability of
1e-13. Identical sets are one class and enter once. Links are found in two rounds, so that a group
of near copies costs about as many pairs as it has members: first each set is paired with its nearest
earlier neighbour in each of its blocks, then only with sets that are not yet connected to it.
Blocks of more than ``PIECE`` sets are cut into pieces, and each pair of pieces is its own tree.

Null or empty texts (no words) have an empty set, link with nothing and are their own component. Rows that repeat
are returned as often as they came. Rows under one id count as one node, whatever their texts (a row without words
aside). Rows without an id are no node of their own: they get the component of their set, null if no id is linked with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.llm.common import Tables, Words, bounded_broadcast, connected_components, mix64, utf8, word_blocks

SHINGLE, GROUPS, BANDS, ROWS, PIECE, LEAF = 4, 128, 32, 3, 2048, 32
#: Similarity is at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 85, 100
#: Shingles hashed at once by all functions, to stay in the cache.
CHUNK = 128
#: Ids that may be broadcast (8 MB); beyond, the same join is a shuffle.
BROADCAST_ROWS = 500_000

_SALTS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, at = words.shingles(k)
    row = words.doc[at] if len(at) else np.zeros(0, np.int64)
    ends = np.searchsorted(row, np.arange(words.rows + 1))
    out = []
    for i in range(words.rows):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            out.append(np.unique(hashes[ends[i] : ends[i + 1]]))
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for x in words.hash[a:b]:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(s: np.ndarray) -> np.ndarray:
    """The least hash of the set under each function; one scheme for all sizes, as sets of any two sizes may be linked."""
    out = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for lo in range(0, len(s), CHUNK):
        np.minimum(out, mix64(s[lo : lo + CHUNK, None] ^ _SALTS).min(axis=0), out=out)
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    mins = min_hashes(s).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + mins[:, j])
    return h.view(np.int64)


def needed(total):
    """Least overlap of linked sets whose sizes sum to ``total``."""
    return -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


class CountTree:
    """A packed tree of boxes over count vectors; boxes keep the largest count of each group and the least set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = np.lexsort((*points[:, :3].T[::-1], sizes))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (largest counts, least size, children) from the leaves up
        members, tops, least = order, points[order], sizes[order]
        while True:
            cuts = np.arange(0, len(members), LEAF)
            tops, least = np.maximum.reduceat(tops, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((tops, least, members))
            members = np.arange(len(cuts))
            if len(cuts) == 1:
                break

    def search(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, overlap bounds) of the points that may be linked with ``point``."""
        nodes = np.zeros(1, dtype=np.int64)
        for tops, least, members in self.levels[::-1]:
            nodes = nodes[np.minimum(tops[nodes], point).sum(axis=1) >= needed(size + least[nodes])]
            if not len(nodes):
                return nodes, nodes
            nodes = np.concatenate([members[i * LEAF : (i + 1) * LEAF] for i in nodes])
        bound = np.minimum(self.points[nodes], point).sum(axis=1)
        ok = bound >= needed(size + self.sizes[nodes])
        return nodes[ok], bound[ok]


def signatures(docs: DataFrame) -> DataFrame:
    """``docs``: (doc_id long, text, text_key). (doc_id, text_key, n_shingles, s1, s2, counts, keys) for each row: set size, two sums that name the set, group counts, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, words in word_blocks(batch.column(1)):
                sets = shingle_sets(words)
                names = np.array([[len(s), mix64(s).sum(dtype=np.uint64), mix64(s ^ _SALTS[1]).sum(dtype=np.uint64)] for s in sets], dtype=np.uint64).view(np.int64)
                counts = np.stack([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
                keys = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, words.rows), batch.column(2).slice(lo, words.rows), *[pa.array(names[:, i]) for i in range(3)], pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * GROUPS, pa.int32()), pa.array(counts.ravel())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))],
                    names=["doc_id", "text_key", "n_shingles", "s1", "s2", "counts", "keys"],
                )

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key long, n_shingles long, s1 long, s2 long, counts array<int>, keys array<long>")


def _pairs(blocked: DataFrame, nearest: bool) -> DataFrame:
    """(a, b), a > b, of sets in a block that may be linked; ``nearest``: each with its best earlier one, else with all of other components."""

    def block(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, points, side, label = rows["rep"], rows["n"], rows["counts"], rows["side"], rows["label"]
        tree, a, b = CountTree(points, sizes), [], []
        for i in range(len(ids)):
            near, bound = tree.search(points[i], int(sizes[i]))
            keep = (ids[near] < ids[i]) & ((side[near] != side[i]) | (side[i] == 0)) & (nearest | (label[near] != label[i]))
            near, bound = near[keep], bound[keep]
            if nearest and len(near):
                near = near[np.lexsort((ids[near], -bound / (sizes[near] + sizes[i])))[:1]]
            a.append(np.full(len(near), ids[i]))
            b.append(ids[near])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches):
            del key
            if len(rows["rep"]) > 1:
                a, b = block(rows)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return blocked.mapInArrow(run, "a long, b long").distinct()


def groups(batches: Iterator[pa.RecordBatch]):
    """Runs of equal (key, cell) of sorted batches, as arrays; a run may span batches."""
    held: list[dict[str, np.ndarray]] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("key").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy(zero_copy_only=False)], axis=1)
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "n", "side", "label")}
        rows["counts"] = batch.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if now is not None and now != tuple(key[a]):
                yield now, {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                held = []
            now = tuple(key[a])
            held.append({k: v[a:b] for k, v in rows.items()})
    if held:
        yield now, {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def linked(left: pa.Array, right: pa.Array) -> list[bool]:
    """Whether 100 * |A & B| >= 85 * |A | B| for the sets of two columns of texts."""
    out = []
    for x, y in zip(left, right, strict=True):
        a, b = shingle_sets(Words(*utf8(pa.array([x.as_py(), y.as_py()], pa.string()))))
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(both > 0 and DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both))
    return out


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are linked; ``texts``: (rep, text), each rep once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ok = pa.array(linked(part.column(2), part.column(3)))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["u", "v"])

    one = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long")


def components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; component_id is the smallest id reached by links.

    Raises if the components of the links do not settle within the rounds of ``connected_components``.
    """
    spark, name = df.sparkSession, ["n_shingles", "s1", "s2"]
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    with Tables(spark, "jaccard") as tables:
        rows = tables.keep(signatures(docs), "rows")
        filled, own = rows.where("n_shingles > 0"), F.struct("doc_id", "text_key")
        # A class holds all rows of one set. A number names it, not an id, as an id may stand for several texts.
        classes = filled.groupBy(*name).agg(F.min("doc_id").alias("least"), F.min(own).alias("one")).withColumn("rep", F.monotonically_increasing_id())
        classes = tables.keep(classes, "classes")
        again = not filled.groupBy(own).count().where("count > 1").isEmpty()  # rows that repeat id and text
        single = lambda x: x.dropDuplicates(["rep"]) if again else x
        reps = single(filled.join(classes.select(*name, "rep", "one"), name).where(own.eqNullSafe(F.col("one"))))
        reps = tables.keep(reps.select("rep", F.col("n_shingles").alias("n"), "counts", "keys"), "reps")
        keys = tables.keep(reps.select("rep", F.explode("keys").alias("key")), "keys")
        shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        members = keys.join(shared, "key").join(reps.select("rep", "n", "counts"), "rep")
        # A block of s pieces has a tree for each pair of pieces; a piece's rows go to the s trees that it takes part in.
        members = members.withColumn("pieces", F.ceil(F.col("c") / PIECE).cast("int")).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces").cast("long")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        members = members.select("key", (F.least("piece", "other") * F.col("pieces") + F.greatest("piece", "other")).alias("cell"), "rep", "n", F.when(F.col("piece") == F.col("other"), 0).when(F.col("piece") < F.col("other"), 1).otherwise(2).alias("side"), "counts")
        members = tables.keep(members, "members")
        tables.drop("keys", "reps")
        wanted = members.select("rep").distinct().join(classes.select("rep", F.col("one.doc_id").alias("one_id"), F.col("one.text_key").alias("one_key")), "rep")
        wanted = tables.keep(wanted, "wanted")
        texts = docs.join(bounded_broadcast(wanted, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("one_id")) & F.col("text_key").eqNullSafe(F.col("one_key")))
        texts = tables.keep(single(texts.select("rep", "text")), "texts")

        def trees(labelled: DataFrame, nearest: bool) -> DataFrame:
            return _pairs(labelled.repartition("key", "cell").sortWithinPartitions("key", "cell", "rep"), nearest)

        first = tables.keep(trees(members.withColumn("label", F.col("rep")), True), "nearest")
        links = tables.keep(_verify(first, texts), "links")
        known = connected_components(links, tables, "known")
        tables.drop("links")
        labelled = members.join(known.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        rest = trees(labelled.select("key", "cell", "rep", "n", "side", "counts", "label"), False).join(first, ["a", "b"], "left_anti")
        more = tables.keep(_verify(rest, texts), "more")
        tables.drop("members", "texts", "wanted", "nearest")
        edges = more.select("u", "v").union(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
        # An id that names several sets is one node: it links their classes.
        named = filled.where("doc_id is not null").select("doc_id", *name).distinct()
        several = tables.keep(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
        if not several.isEmpty():
            named = named.join(several, "doc_id").join(classes.select(*name, "rep"), name)
            edges = edges.union(named.join(named.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").select(F.col("rep").alias("u"), "v"))
        whole = connected_components(edges, tables, "whole")
        labels = classes.select(*name, "rep", "least").join(whole.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        labels = labels.join(labels.groupBy("component").agg(F.min("least").alias("label")), "component").select(*name, "label")
        kind = dict(df.dtypes)[id_col]
        out = filled.select("doc_id", *name).join(labels, name).select("doc_id", "n_shingles", "label").union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
        return tables.result(out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", F.col("label").cast(kind).alias("component_id")))
