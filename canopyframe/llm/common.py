"""Helpers shared by the operators: tables, durable results and vectorised word hashing.

Word hashing works on whole Arrow string buffers: a polynomial over 64-bit byte codes, modulo 2**64,
whose running sum yields the hash of any span, so no Python object is made for a word. The memory
needed is about fifty bytes for each byte of a slice; slices hold about a megabyte, or one text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = bytes([0x20, *range(0x09, 0x0E)])
SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_rest(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_SHORT = 7919  # keeps a short text's only run apart from full runs
_RATIO = 0xD1342543DE82EF95
_INVERSE = pow(_RATIO, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 64)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class Words:
    """Words of a slice of texts: byte spans, the row of each word and 64-bit hashes of spans.

    ``separators`` are the bytes between words; A-Z count as a-z. Bytes of multi-byte characters
    never equal an ASCII separator, so UTF-8 needs no decoding.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | first[:n]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: words before each text, so words of row i are bound[i]:bound[i + 1]
        self.bound = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bound))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODES[FOLD[data]] * _power(_RATIO, n), out=total[1:])
        self._total = total

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._total[end] - self._total[start]) * _power(_INVERSE, len(self._total))[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(_MULT))

    def hashes(self) -> np.ndarray:
        return self.span(self.start, self.end)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def separators(between: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(between)] = True
    return out


SPACES = separators(SPACE)
#: everything in ASCII but digits and letters
PUNCTUATION = separators(bytes(b for b in range(128) if not chr(b).isalnum()))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string()) if len(texts) else texts.cast(pa.large_string())
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of all runs of ``k`` words; a text with fewer words is one run, one with none has none."""
    h = w.hashes()
    size = np.diff(w.bound)
    at = np.arange(len(h))
    full = at + k <= np.repeat(w.bound[1:], size)
    i = at[full]
    out = np.zeros(len(i), dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_RATIO) + h[i + j]
    rows = w.row[i]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = size[short] > j
            extra[has] = extra[has] * np.uint64(_RATIO) + h[w.bound[short[has]] + j] + np.uint64(_SHORT)
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
    return mix(out), rows


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
