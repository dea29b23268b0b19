"""Shared pieces: table access, written intermediate tables, byte-level tokenising, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels hold at once (a longer single text is one block of its own).
BLOCK_BYTES = 1 << 20
#: Spark's setting that drops an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session, where it may be unset as in tests, gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="frametide-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


class _Cleanup:
    """Turns ``SHUFFLE_CLEANUP`` on while at least one table is being written, whichever thread writes it; a setting of the user's stays."""

    def __init__(self):
        self.lock, self.writers = threading.Lock(), 0

    @contextlib.contextmanager
    def on(self, spark: SparkSession) -> Iterator[None]:
        with self.lock:
            own = self.writers > 0 or spark.conf.get(SHUFFLE_CLEANUP, None) is None
            if own:
                self.writers += 1
                spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            yield
        finally:
            if own:
                with self.lock:
                    self.writers -= 1
                    if not self.writers:
                        spark.conf.unset(SHUFFLE_CLEANUP)


_cleanup = _Cleanup()
_results: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_results() -> None:
    for spark, path in _results:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone before Python ends
                remove_path(spark, path)


class Tables:
    """Tables of one run in the shared folder: they cut lineage and survive lost executors, and go when the run ends.

    Nothing reads the shuffle files of a write again, so those go when it is done. ``result`` is for what a returned
    DataFrame still reads; such tables go when Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.paths = spark, {}
        self.top = f"{shared_dir(spark)}/frametide/{label}-{uuid.uuid4().hex}"

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        with _cleanup.on(self.spark):
            df.select("*").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; a table of the same name must have been dropped."""
        path = self.paths[name] = f"{self.top}-{name}"
        return self._write(df, path)

    def drop(self, *names: str) -> None:
        remove_path(self.spark, *[self.paths.pop(x) for x in names])

    def result(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}-result"
        _results.append((self.spark, path))
        return self._write(df, path)


def remove_path(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcasting if a count shows that it has at most ``rows`` (narrow) rows; otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- bytes to words

#: The white space of the word pattern [^\x20\x09-\x0D]+.
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE_SPACE)] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_BYTE_VALUE[_IS_SPACE] = 0
_LOWER_VALUE = _BYTE_VALUE[_LOWER]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if len(_powers["up"]) > 4 * BLOCK_BYTES:  # not kept for the sake of one very long text
        _powers.clear()
    return up, down


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of consecutive texts: ``start``/``end`` byte positions in ``data``, ``doc`` (row) and ``hash`` of each, ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, rows = len(data), len(offsets) - 1
        self.data, self.offsets, self.rows = data, offsets, rows
        space = _IS_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        if len(self.start):
            up, down = _power(n)
            self.hash = mix64(np.add.reduceat(_LOWER_VALUE[data] * up, self.start) * down[self.start])
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of k words of one row, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix64(h[at]), at


def word_blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """(first row, Words) over runs of rows of about ``most`` bytes each; whole texts only."""
    data, offsets = utf8(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, tables: Tables, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of the graph of ``edges`` (u, v longs), a table of ``tables``; component is the smallest node reached.

    Alternates the large-star and small-star steps, each a min per node joined back, until the
    edges stand still; raises after ``rounds`` rounds. Every step is a written table; nodes without edges are not returned.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, name, seen = tables.keep(now, f"{label}-0"), f"{label}-0", None
    for step in range(1, rounds + 1):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.keep(large, f"{label}-large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = tables.keep(small, f"{label}-{step}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        tables.drop(name, f"{label}-large")
        name = f"{label}-{step}"
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
