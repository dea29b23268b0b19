"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space collapsed. An item of m characters may
occur with up to ``floor(rate * m)`` edits; cut into one piece more than that, at least one piece of any
such occurrence is untouched. One Aho-Corasick automaton finds all exact piece hits in a single pass over each whole text;
Myers' bit-parallel algorithm then decides each hit's surroundings.

Null and empty texts match nothing, and null or blank items are never searched for. Items with equal text are
all reported. Repeated rows are reported for each row. The items are gathered in blocks of about ``block_chars`` characters (dealt by hash);
each block is one pass over the documents, and its finds are written before the next block is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.llm.common import Tables
from frametide.llm.sentencepiece_codec import slices

RATE = 0.05
#: Characters of test items in one automaton.
BLOCK_CHARS = 1 << 24


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(text: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece): the error budget plus one pieces, as equal in length as can be."""
    n = int(rate * len(text)) + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(of: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least edit distance of a pattern of m characters to a substring of ``text``, its first end); anchored: to a prefix."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = of.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 | anchored
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best[0]:
            best = (score, j + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, n, int(rate * len(n)), masks(n), masks(n[::-1])) for i, n in ((i, normalise(t)) for i, t in items) if n]
        table: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, *_) in enumerate(self.items):
            for offset, piece in pieces(text, rate):
                table.setdefault(piece, []).append((k, offset))
        self.found = ahocorasick.Automaton()
        for piece, places in table.items():
            self.found.add_word(piece, (len(piece), places))
        if table:
            self.found.make_automaton()
        self.empty = not table

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each occurrence in the normalised text; occurrences of an item do not overlap."""
        text = normalise(text)
        if self.empty or not text:
            return []
        begins: dict[int, set[int]] = {}
        for end, (size, places) in self.found.iter(text):
            for k, offset in places:
                begins.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, starts in begins.items():
            item, pattern, budget, of, reverse = self.items[k]
            done = -1  # characters before it are settled
            for begin in sorted(starts):
                lo, hi = max(0, begin - budget, done), min(len(text), begin + len(pattern) + budget)
                if hi - lo < len(pattern) - budget:
                    continue
                distance, end = myers(of, len(pattern), text[lo:hi])
                if distance <= budget:
                    _, back = myers(reverse, len(pattern), text[lo : lo + end][::-1], True)
                    out.append((item, distance, lo + end - back, lo + end))
                    done = lo + end
        return sorted(out)


def find(documents: DataFrame, items: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every occurrence of an item in a document, positions in the normalised text."""
    bench = items.select(F.col(item_id_col).alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    total = bench.agg(F.sum(F.char_length("t"))).head()[0] or 0
    blocks = -(-total // block_chars) or 1
    kinds = f"doc_id {dict(documents.dtypes)[id_col]}, item_id {dict(items.dtypes)[item_id_col]}, distance int, start int, end int"

    def scan(b: int) -> DataFrame:
        part = [(r["i"], r["t"]) for r in (bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)).collect()]
        return documents.select(id_col, text_col).mapInArrow(_scan(part, rate), kinds)

    if blocks == 1:
        return scan(0)
    with Tables(documents.sparkSession, "decontaminate") as tables:
        # Each block's finds are written before the next is gathered, so the driver holds one block at a time.
        found = [tables.keep(scan(b), str(b)) for b in range(blocks)]
        return tables.result(reduce(DataFrame.union, found))


def _scan(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                rows = [(i, m) for i in range(lo, hi) for m in matcher.matches(texts[i])]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows])), *[pa.array([m[k] for _, m in rows], pa.int64() if k == 0 else pa.int32()) for k in range(4)]], names=["doc_id", "item_id", "distance", "start", "end"])

    return run
