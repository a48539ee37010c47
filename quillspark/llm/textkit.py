"""Vectorised tokenising and hashing of whole texts.

All functions work on the bytes of many texts at once. A batch is cut into
segments of bounded size at word ends, so that the temporary arrays stay small
whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes whose temporary arrays (some 60 bytes for each) are held at once.
SEGMENT = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Bytes that belong to words, by tokenisation.
BLANKS = np.ones(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of the hash base and of its inverse modulo
    2^64. Those that a segment or a slice needs are kept, longer ones aren't."""
    size = 2 * SEGMENT + 1
    if n > size:
        return _powers(BASE, n), _powers(BASE_INVERSE, n)
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(BASE, size), _powers(BASE_INVERSE, size)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one text after the other, and the n + 1
    offsets of the texts in them. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - (at[0] if len(at) else 0)


#: Bytes of text that are worked on at once (a longer text alone may have more).
SLICE = 1 << 20


def with_text(df: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns ``kept`` of ``df`` and the place of the text among them; it
    comes behind them, as ``__text``, only if it isn't one of them as a string.
    So no text goes to a worker twice."""
    columns = [F.col(f"`{c}`") for c in kept]
    if text_col in kept and df.schema[text_col].dataType == T.StringType():
        return df.select(*columns), kept.index(text_col)
    return df.select(*columns, F.col(f"`{text_col}`").cast("string").alias("__text")), len(kept)


def slices(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of rows with at most SLICE bytes in column k, or one row."""
    for batch in batches:
        _, at = buffers(batch.column(k))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _segments(words: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about SEGMENT bytes that go through no word. ``words``: which
    bytes are in words; ``edges``: offsets of texts."""
    at, end = 0, len(words)
    while at < end:
        to = min(end, at + SEGMENT)
        if to < end:
            gaps = np.flatnonzero(~words[at:to])
            k = np.searchsorted(edges, to, "right") - 1
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else 0, int(edges[k]))
            if cut <= at:  # one word is longer than a segment
                after = np.flatnonzero(~words[to:])
                cut = min(to + int(after[0]) if len(after) else end, int(edges[min(k + 1, len(edges) - 1)]))
            to = cut
        yield at, to
        at = to


def words_of(raw: np.ndarray, edges: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts after lower-casing A-Z, the
    byte offset at which each starts, and the n + 1 offsets of each text's
    words among them. ``kind``: BLANKS or ALNUM."""
    hashes, begins = [], []
    for a, b in _segments(kind[raw], edges):
        part = raw[a:b]
        inside = kind[part]
        before = np.empty(len(part), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        k, m = np.searchsorted(edges, (a, b))
        firsts = edges[k:m] - a
        before[firsts[firsts < len(part)]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty(len(part), bool)
        after[-1:] = False
        after[:-1] = inside[1:] & before[1:]
        end = np.flatnonzero(inside & ~after) + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(LOWER[part].astype(np.uint64) * up[: len(part)], out=total[1:])
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        hashes.append(mix(h))
        begins.append(start + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, s, np.searchsorted(s, edges)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word (the last n - 1 words
    start none). Those that cross texts are for the caller to leave out."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * BASE + h[k : k + m]
    return mix(out)
