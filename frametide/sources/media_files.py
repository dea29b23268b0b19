"""Media files as tables: probing, decoding and writing of uncompressed WAV and PNG, which need no codec library.

Files come as (path, content) rows, as Spark's ``binaryFile`` source gives them; every function is one Arrow pass over those
rows. What cannot be read becomes a row with a status, never an exception. Compressed containers need decoders that are not
part of this engine: pass ``decode`` functions for them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rate of analysed samples, and the bounds of audio and image sources.
RATE, MAX_AUDIO_SECONDS, AUDIO_SLACK, MAX_CHANNELS, MAX_RATE, MAX_PIXELS = 16_000, 600.0, 0.01, 8, 192_000, 40_000_000
#: Samples of one chunk row.
CHUNK = 16_384

AUDIO = "path string, status string, codec string, rate int, channels int, duration_sec double"
IMAGE = "path string, status string, format string, width int, height int, channels int, bit_depth int"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def _rows(df: DataFrame, kernel: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = kernel(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return df.select("path", "content").mapInArrow(run, kind)


# ---------------------------------------------------------------- audio


def riff(content: bytes) -> tuple[int, int, int, int, bytes] | None:
    """(format tag, channels, rate, bits, data) of a WAV file; None if it is none. 65534 (extensible) is resolved."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, head = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            head = (struct.unpack("<H", body[24:26])[0] if tag == 65534 and len(body) >= 26 else tag, channels, rate, bits)
        if name == b"data" and head:
            return (*head, body)
        at += 8 + size + size % 2
    return None


def samples_of(tag: int, channels: int, bits: int, data: bytes) -> np.ndarray | None:
    """Samples of -1..1 by channel, or None for an encoding that is not linear."""
    width = bits // 8 * channels
    if not width:
        return None
    data = data[: len(data) // width * width]
    if tag == 1 and bits == 16:
        flat = np.frombuffer(data, "<i2") / 32768.0
    elif tag == 1 and bits == 8:
        flat = (np.frombuffer(data, "u1").astype(float) - 128) / 128
    elif tag == 1 and bits == 32:
        flat = np.frombuffer(data, "<i4") / 2147483648.0
    elif tag == 3 and bits == 32:
        flat = np.frombuffer(data, "<f4").astype(float)
    else:
        return None
    return flat.reshape(-1, channels)


def resampled(mono: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Windowed-sinc resampling; the samples themselves at an equal rate."""
    if rate == to or not len(mono):
        return mono
    ratio, half = min(1.0, to / rate), 16
    at = np.arange(int(np.ceil(len(mono) * to / rate))) * rate / to
    reach = int(np.ceil(half / ratio))
    out = np.zeros(len(at))
    padded = np.pad(mono, reach + 1)
    for k in range(-reach, reach + 1):
        i = np.floor(at).astype(int) + k
        x = (at - i) * ratio
        out += padded[i + reach + 1] * np.sinc(x) * ratio * np.where(np.abs(x) < half, np.cos(np.pi * x / (2 * half)) ** 2, 0)
    return out


def _audio_status(parsed: tuple | None) -> tuple[str, tuple | None]:
    if parsed is None:
        return "UNSUPPORTED_MEDIA", None
    tag, channels, rate, bits, data = parsed
    samples = samples_of(tag, channels, bits, data)
    if samples is None or not rate:
        return "UNSUPPORTED_MEDIA", None
    seconds = len(samples) / rate
    if seconds > MAX_AUDIO_SECONDS + AUDIO_SLACK or channels > MAX_CHANNELS or rate > MAX_RATE:
        return "LIMIT_EXCEEDED", (samples, rate, seconds)
    if not np.isfinite(samples).all():
        return "DECODE_FAILED", None
    return ("ok" if len(samples) else "AUDIO_ABSENT"), (samples, rate, seconds)


def probe_audio(df: DataFrame) -> DataFrame:
    """One row for each file: codec, rate, channels and duration, or why it is refused."""

    def kernel(path: str, content: bytes) -> list[tuple]:
        parsed = riff(content)
        status, found = _audio_status(parsed)
        if found is None:
            return [(path, status, None, None, None, None)]
        tag, channels, rate, bits, _ = parsed
        return [(path, status, f"pcm_{'f' if tag == 3 else 'u' if bits == 8 else 's'}{bits}{'' if bits == 8 else 'le'}", rate, channels, found[2])]

    return _rows(df, kernel, AUDIO)


def pcm(df: DataFrame, rate: int = RATE) -> DataFrame:
    """(path, chunk_index, samples): mono samples at ``rate``, clipped to -1..1, in chunks; files that are refused or silent of data have no rows."""

    def kernel(path: str, content: bytes) -> list[tuple]:
        status, found = _audio_status(riff(content))
        if status != "ok":
            return []
        mono = np.clip(resampled(found[0].mean(axis=1), found[1], rate), -1, 1)
        return [(path, i, mono[a : a + CHUNK].tolist()) for i, a in enumerate(range(0, len(mono), CHUNK))]

    return _rows(df, kernel, "path string, chunk_index int, samples array<double>")


def wav(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16-bit samples, without any metadata."""
    data = np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    channels = 1 if samples.ndim == 1 else samples.shape[1]
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


# ---------------------------------------------------------------- images

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit pixels, (height, width) or (height, width, channels)."""
    shaped = pixels.reshape(*pixels.shape[:2], -1).astype(np.uint8)
    height, width, channels = shaped.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = b"".join(b"\0" + row.tobytes() for row in shaped.reshape(height, -1))
    kind = {v: k for k, v in _CHANNELS.items()}[channels]
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_header(content: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(width, height, bit depth, colour type, interlace, animated) or None."""
    if content[:8] != _SIGNATURE or len(content) < 33 or content[12:16] != b"IHDR":
        return None
    width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", content[16:29])
    return width, height, depth, kind, interlace, b"acTL" in content[33:4096]


def png_pixels(content: bytes) -> np.ndarray:
    """(height, width, channels) of a checked PNG: 8 bits, not interlaced, no palette."""
    width, height, _, kind, _, _ = png_header(content)
    channels, at, packed = _CHANNELS[kind], 8, b""
    while at + 8 <= len(content):
        size = struct.unpack(">I", content[at : at + 4])[0]
        if content[at + 4 : at + 8] == b"IDAT":
            packed += content[at + 8 : at + 8 + size]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        how, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if how == 2:
            line = (line + above) & 255
        elif how:
            for x in range(len(line)):  # each pixel needs the one before it
                left, up, corner = (int(line[x - channels]), int(above[x]), int(above[x - channels])) if x >= channels else (0, int(above[x]), 0)
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    return out.reshape(height, width, channels)


def _image_status(content: bytes) -> tuple[str, tuple | None]:
    head = png_header(content)
    if head is None:
        return "UNSUPPORTED_MEDIA", None
    width, height, depth, kind, interlace, animated = head
    if animated or depth != 8 or kind not in _CHANNELS or interlace:
        return "UNSUPPORTED_MEDIA", head
    return ("LIMIT_EXCEEDED" if width * height > MAX_PIXELS else "ok" if width * height else "DECODE_FAILED"), head


def probe_images(df: DataFrame) -> DataFrame:
    def kernel(path: str, content: bytes) -> list[tuple]:
        status, head = _image_status(content)
        return [(path, status, "png", head[0], head[1], _CHANNELS.get(head[3]), head[2]) if head else (path, status, None, None, None, None, None)]

    return _rows(df, kernel, IMAGE)


def decode_images(df: DataFrame, background: int = 255) -> DataFrame:
    """(path, status, width, height, r, g, b): pixels in reading order; transparency is laid over ``background``."""

    def kernel(path: str, content: bytes) -> list[tuple]:
        status, head = _image_status(content)
        if status != "ok":
            return [(path, status, None, None, None, None, None)]
        try:
            pixels = png_pixels(content).astype(float)
        except (zlib.error, ValueError):
            return [(path, "DECODE_FAILED", None, None, None, None, None)]
        if pixels.shape[2] in (2, 4):
            alpha = pixels[..., -1:] / 255
            pixels = np.rint(pixels[..., :-1] * alpha + background * (1 - alpha))
        r, g, b = (pixels[..., 0], pixels[..., 1 % pixels.shape[2]], pixels[..., 2 % pixels.shape[2]])
        return [(path, status, head[0], head[1], *[c.astype(int).ravel().tolist() for c in (r, g, b)])]

    return _rows(df, kernel, "path string, status string, width int, height int, r array<int>, g array<int>, b array<int>")
