"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so no piece can cross from
one marked word (a run of markers and what follows up to the next marker) to the next. Each distinct
marked word is segmented once, and a text's ids are its words' ids, joined back by position. Models for
which this does not hold, or which change texts before segmenting, are encoded text by text.

Null text counts as empty; an empty text has no ids and decodes to an empty text. Repeated rows stay
repeated rows. Only the id column and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

#: Fixed value: the marker that stands for a space.
MARK = "▁"
#: Distinct words kept by a task before the table is begun anew (bounds its memory, not the result).
TABLE_WORDS = 200_000
#: Characters of the texts that are segmented together.
SLICE_CHARS = 1 << 20

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message: integers, and bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def keeps_text(model: bytes) -> bool:
    """Whether the model's own specification leaves a text as it is, behind one marker, with markers for spaces and no user-defined pieces.

    Fixed values: field numbers of the model format: pieces 1 (type 3, user-defined 4), trainer 2 (white space as suffix 24), normaliser 3
    (character map 2, dummy prefix 3, remove extra spaces 4, escape spaces 5, rules 6). Prefix, removal and escape hold unless they are switched off.
    """
    top = list(wire_fields(model))
    kinds = {dict(wire_fields(v)).get(3, 1) for k, v in top if k == 1}
    trainer = [dict(wire_fields(v)) for k, v in top if k == 2] or [{}]
    rules = [dict(wire_fields(v)) for k, v in top if k == 3] or [{}]
    r = rules[-1]
    return 4 not in kinds and not trainer[-1].get(24, 0) and not r.get(2) and not r.get(6) and r.get(3, 1) == 1 and r.get(4, 1) == 0 and r.get(5, 1) == 1


class ChunkTable:
    """Ids and decoded text of each distinct marked word seen.

    Word ``r`` has the ids ``pieces[start[r] : start[r] + size[r]]`` and decodes to ``words[r]``.
    """

    def __init__(self, model: bytes, most: int = TABLE_WORDS):
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.most = most
        self.alone = self.lib.piece_to_id(MARK)
        everything = range(self.lib.get_piece_size())
        pieces = [self.lib.id_to_piece(i) for i in everything]
        self.surface = [x.replace(MARK, " ") for x in pieces]
        self.length = np.array([len(x) for x in pieces], dtype=np.int64)
        #: Pieces that do not decode to their own characters.
        self.odd = np.array([self.lib.is_unknown(i) or self.lib.is_control(i) or self.lib.is_unused(i) or self.lib.is_byte(i) for i in everything])
        self.by_chunk = not any(MARK in x.lstrip(MARK) for x in pieces) and keeps_text(model) and self.lib.id_to_piece(self.alone) == MARK
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.words: list[str] = []
        self.pieces, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _segment(self, chunks: list[str]) -> None:
        """Add words that are not in the table yet. Only words with odd pieces need the library to decode them."""
        if not chunks:
            return
        got = self.lib.encode([x[1:].replace(MARK, " ") for x in chunks], num_threads=1)
        if MARK in chunks:
            got[chunks.index(MARK)] = [self.alone]
        size = np.fromiter(map(len, got), np.int64, len(got))
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.fromiter(chain.from_iterable(got), np.int32, ends[-1])
        joined = "".join(map(self.surface.__getitem__, flat.tolist()))
        cuts = np.concatenate([[0], np.cumsum(self.length[flat])])[ends].tolist()
        words = [joined[a:b] for a, b in pairwise(cuts)]
        odd = np.concatenate([[0], np.cumsum(self.odd[flat])])[ends]
        for i in np.flatnonzero(np.diff(odd)).tolist():
            words[i] = " " + self.lib.decode(got[i])
        self.row.update(zip(chunks, range(len(self.words), len(self.words) + len(chunks)), strict=True))
        self.words += words
        self.start = np.concatenate([self.start, ends[:-1] + len(self.pieces)])
        self.size = np.concatenate([self.size, size])
        self.pieces = np.concatenate([self.pieces, flat])

    def encode_decode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        if not self.by_chunk:
            rows = self.lib.encode(texts, num_threads=1)
            return [np.array(x, dtype=np.int32) for x in rows], [self.lib.decode(x) for x in rows]
        if not texts:
            return [], []
        chunks = [_CHUNK.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in chunks])])
        distinct = dict.fromkeys(chain.from_iterable(chunks))
        new = [x for x in distinct if x not in self.row]
        if len(self.row) + len(new) > self.most:
            self._clear()
            new = list(distinct)
        self._segment(new)
        at = np.fromiter(map(self.row.__getitem__, chain.from_iterable(chunks)), np.int64, cuts[-1])
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pieces[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        rows = at.tolist()
        decoded = ["".join(map(self.words.__getitem__, rows[a:b]))[1:] for a, b in pairwise(cuts.tolist())]
        return np.split(ids, ends[cuts[1:-1]]), decoded


def encode(df: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id, n_tokens long, ids array<int>, decoded string), one for each input row.

    ``model`` is the content of the model file, so executors need no copy of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE_CHARS):
                ids, decoded = table.encode_decode([x or "" for x in texts[lo:hi]])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, decoded string")


def slices(texts: list[str | None], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters."""
    lo = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
