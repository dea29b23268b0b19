"""Sharding by vector bin packing: groups of equal texts are placed one after the other into the shard whose residual capacity has the largest dot product with the group's (bytes, tokens, rows).

The law that holds is ``bytes``: shard sizes are near equal; tokens and rows are balanced beside it, and a byte counts ``LEAD`` times as much.
Equal texts share a shard. Every group is placed by itself. First the driver places the large ones, those above
1/``LARGE`` of all bytes or rows (there are at most 2 * ``LARGE``); a group larger than a shard's share of the bytes is split by a row hash into pieces, as it could not be
balanced whole. All others are dealt by hash into cells of about ``CELL`` groups, and each cell packs its own groups, large ones first, into shards whose
capacities are the cell's part of what the large groups left open; so every cell comes out even by itself, and so does the sum.

Null text has no bytes (size 1) and counts as the empty text. Repeated rows are rows like any others. ``slot`` numbers the
rows of a shard without gaps, in an order given by hashes of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frametide.llm.common import Tables

LARGE, CELL = 4096, 20_000
#: How much more an open byte counts in the dot product than an open token or row: enough for the law to hold where a hot group overfills a shard in rows.
LEAD = 4096.0
#: Rows that one slot-numbering window should hold.
SLOT_ROWS = 20_000


def pack(weights: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each group (rows of ``weights``; columns bytes, tokens, rows), the largest placed first, and what stays open of ``capacity`` (a row for each shard)."""
    unit = capacity.mean(axis=0)
    unit[unit <= 0] = 1
    w, residual = weights / unit, capacity / unit
    out = np.zeros(len(weights), dtype=np.int32)
    wanted = w * np.array([LEAD] + [1.0] * (weights.shape[1] - 1))
    for i in np.lexsort((np.arange(len(w)), -w[:, 0])):
        out[i] = best = int(np.argmax(residual @ wanted[i]))
        residual[best] -= w[i]
    return out, residual * unit


def _pack_cells(open_share: np.ndarray):
    """Sorted by cell: (text_key, shard) of every group. ``open_share``: each shard's part of what is open, by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def placed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            w = np.stack([table.column(c).to_numpy() for c in ("bytes", "tokens", "n")], axis=1).astype(float)
            shard, _ = pack(w, open_share * w.sum(axis=0))
            return pa.RecordBatch.from_arrays([table.column("text_key").chunk(0), pa.array(shard)], names=["text_key", "shard"])

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column("cell")[0].as_py() != cell[a]:
                    yield placed()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield placed()

    return run


def shard(df: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, cell: int = CELL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("text_key"),
        F.xxhash64(F.lit(1), F.col(id_col), text).alias("row_key"),
    )
    with Tables(spark, "sharding") as tables:
        rows = tables.keep(rows, "rows")  # narrow: no texts from here on
        groups = tables.keep(rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
        whole, tokens, count, n_groups = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens", "n")], F.count("*")).head()
        capacity = np.tile(np.array([whole, tokens, count], dtype=float) / shards, (shards, 1))
        is_large = (F.col("bytes") * large > whole) | (F.col("n") * large > count)
        big = groups.where(is_large).select("text_key", "bytes", "tokens", "n", F.ceil(F.col("bytes") * shards / whole).cast("int").alias("pieces")).collect()  # at most 2 * large groups
        names = [(r["text_key"], p, r["pieces"]) for r in big for p in range(r["pieces"])]
        weights = np.array([[r[c] / r["pieces"] for c in ("bytes", "tokens", "n")] for r in big for _ in range(r["pieces"])], dtype=float).reshape(-1, 3)
        placed, left = pack(weights, capacity)
        of_big = F.broadcast(spark.createDataFrame([(k, p, s, int(x)) for (k, p, s), x in zip(names, placed, strict=True)], "text_key string, piece int, pieces int, shard int"))
        # Where large groups overfill a shard in tokens or rows, these cannot come out even; the others then follow the open bytes.
        left[:, (left < 0).any(axis=0)] = left[:, :1]
        left = np.maximum(left, 0)
        share = left / np.where(left.sum(axis=0) > 0, left.sum(axis=0), 1)
        cells = max(1, -(-n_groups // cell))
        small = groups.where(~is_large).withColumn("cell", F.pmod(F.xxhash64("text_key"), F.lit(cells)).cast("int"))
        small = small.repartition("cell").sortWithinPartitions("cell", "text_key").mapInArrow(_pack_cells(share), "text_key string, shard int")
        keys = of_big.select("text_key", "pieces").distinct()
        of_large = rows.join(F.broadcast(keys), "text_key").withColumn("piece", F.pmod("row_key", F.col("pieces").cast("long")).cast("int")).join(of_big.drop("pieces"), ["text_key", "piece"])
        of_small = rows.join(F.broadcast(keys), "text_key", "left_anti").join(small, "text_key")
        columns = ["doc_id", "size", "text_crc32", "row_key", "shard"]
        out = tables.keep(of_large.select(*columns).union(of_small.select(*columns)), "placed")
        return tables.result(number(out, count, shards))


def number(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Add ``slot``: rows of a shard from 0 without gaps, numbered in blocks of rows whose offsets come from their counts."""
    blocks = max(1, -(-count // (shards * SLOT_ROWS))) * 16
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row_key"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row_key", "doc_id"))
    return rows.withColumn("rank", rank).join(before, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
