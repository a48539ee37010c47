"""Removing exact substrings that occur earlier in the corpus.

Two texts that share a string of SPAN bytes agree on everything that follows
from these bytes alone; so each SPAN-byte window is filed under its least
k-gram hash, its anchor, and equal windows meet under one anchor wherever they
stand. First the anchors alone meet, packed, to find those that several texts
have, then the anchors with the bytes before or behind them; bitmaps of fixed
size tell which. Only there the bytes are compared: the windows of an anchor
at one place are a stretch, and

* of equal stretches all but those in the document of least id lose all bytes;
* the stretches of some anchors are a bucket, and the number of buckets follows
  from the rows counted. In each the suffixes of the distinct stretches are put
  in order, by doubling of ranks, up to SPAN bytes. The previous and the next
  smaller document in that order, as far as SPAN bytes are shared, say whether
  a suffix has an earlier match: whether its longest previous factor has SPAN
  bytes at least. A task settles the copies among its own stretches before it
  deals any, so a common stretch comes a few times from a task and not once
  from each document;
* anchors at more than CROWD places (a common line with other bytes around it)
  go to no bucket: their windows are grouped as rows.

Later copies are removed, the first stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .storage import cut, spent

SPAN = 50
GRAM = 20
HALF = (SPAN - GRAM) // 2
#: Windows looked at at once; a power of two.
PIECE = 1 << 16
#: Anchors that a task gathers before it deals them to buckets.
GATHER = 500_000
#: Most bits of the bitmaps of shared hashes, which are broadcast, and bits for
#: each hash where that is less. A larger one lets fewer other stretches
#: through; the result is the same with any.
FILTER_BITS, HASH_BITS = 1 << 28, 64
#: Jobs in which a bitmap comes to the driver, a part of it in each. They come one
#: after the other, so there are not as many as partitions.
FETCHES = 8
#: Hashes of a bucket in which repeats are looked for; and hashes for each bit
#: from which on a bitmap would be full, so that none is made.
PLACES, CROWDED = 1 << 24, 16
#: Size of the bitmap of documents that may lose bytes, likewise.
TOUCHED_BITS = 1 << 23
#: Stretches of a task among which copies are settled at once.
SETTLED = 30_000
#: Stretches of a bucket, on average, and the most of an anchor that goes to one.
BUCKET_ROWS, CROWD = 20_000, 20_000
#: Most stretches of more than CROWD places each whose windows are broadcast; with more, adaptive execution splits their joins.
BROADCAST_ROWS = 20_000


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on as one number (zeros behind the end)."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    out = np.empty(len(raw), np.uint64)
    for k in range(8):
        n = len(out[k::8])
        out[k::8] = padded[k : k + 8 * n].view(np.uint64)
    return out


def windows(raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of one anchor: start of the first window, start of the
    last, place of the anchor and its 64-bit hash. Windows cross no text's end."""
    span = SPAN - GRAM + 1
    for a in range(0, len(raw), PIECE):
        part = raw[a : a + PIECE + SPAN - 1]
        n = len(part) - SPAN + 1
        if n <= 0:
            break
        m = len(part) - GRAM + 1
        x = _eights(part)
        h = textkit.mix((x[:m] * textkit.BASE + x[8 : 8 + m]) * textkit.BASE + x[GRAM - 8 : GRAM - 8 + m])
        # Order by hash, then place; the place stays readable in the low bits.
        key = (h & ~np.uint64(2 * PIECE - 1)) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: n], key[span - width : span - width + n])
        own = (key[:n] & np.uint64(2 * PIECE - 1)).astype(np.int64)
        some = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, a + n, "left") + 1]
        stop = np.repeat(some, np.diff(np.minimum(some, a + n), prepend=a))
        inside = np.arange(a + SPAN, a + SPAN + n) <= stop
        change = own[1:] != own[:-1]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | change
        last = inside.copy()
        last[:-1] &= ~inside[1:] | change
        f = np.flatnonzero(first)
        yield f + a, np.flatnonzero(last) + a, own[f] + a, h[own[f]]


def _anchors(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    parts = list(windows(raw, edges))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))


@dataclass(frozen=True)
class Bitmap:
    """Of hashes: no false zeros. ``bits`` in as many equal stretches as there are buckets."""

    bits: np.ndarray
    buckets: int

    def has(self, h: np.ndarray) -> np.ndarray:
        width = len(self.bits) // self.buckets * 8
        bucket, place = _placed(h, self.buckets)
        at = bucket * width + (place.astype(np.uint64) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _hash_of(raw: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` bytes from each of the places on."""
    out = np.full(len(at), n, np.uint64)
    for k in [*range(0, n - 8, 8), n - 8]:
        out = textkit.mix(out * textkit.BASE + np.ascontiguousarray(raw[at[:, None] + np.arange(k, k + 8)]).view(np.uint64).ravel())
    return out


def _sides(raw: np.ndarray, edges: np.ndarray, shared: Bitmap) -> tuple[np.ndarray, ...]:
    """Of the runs of shared anchors: first and last window, place and hash of
    the anchor, hashes of the anchor with HALF bytes before it and with HALF
    behind it, and whether a window of the run has these. A window holds one
    of the two at least, for SPAN is GRAM and twice HALF."""
    first, last, at, h = _anchors(raw, edges)
    keep = shared.has(h)
    first, last, at, h = first[keep], last[keep], at[keep], h[keep]
    before, behind = first <= at - HALF, last >= at - HALF
    left, right = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    left[before] = _hash_of(raw, at[before] - HALF, GRAM + HALF)
    right[behind] = ~_hash_of(raw, at[behind], GRAM + HALF)
    return first, last, at, h, left, right, before, behind


def _all_anchors(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, _, _, h = _anchors(raw, edges)
    return first, h


def _dealt(hashes: np.ndarray, texts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """What a task has gathered, by bucket: 32 bits of each anchor below the
    bucket's number; once, or twice if several of its texts have it. So an
    anchor comes at most twice from a task, however frequent it is."""
    order = np.lexsort((texts, hashes))
    h, t = hashes[order], texts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h = h[new]
    again = np.zeros(len(h), int)
    again[1:] = h[1:] == h[:-1]
    again[2:] *= 1 + (h[2:] == h[:-2])
    bucket, place = _placed(h[again < 2], buckets)
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, place[ends[k] : ends[k + 1]].tobytes()


def _placed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash, in order of the hashes, and its place in it in 32 bits."""
    high = (h >> np.uint64(32)) * np.uint64(buckets) + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32))
    return (high >> np.uint64(32)).astype(np.int64), (high & np.uint64(0xFFFFFFFF)).astype(np.uint32)


Hashed = Iterator[tuple[np.ndarray, np.ndarray]]


def met_twice(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Hashed], buckets: int, expected: int) -> Bitmap:
    """A bitmap of at most FILTER_BITS bits in which each hash that several owners
    have sets the bit of its place in the hash range. ``hashes``: of a task's
    batches, 64-bit hashes and their owners' numbers, some ``expected`` in all.
    Above FILTER_BITS / HASH_BITS hashes the bitmap's size doesn't depend on the
    data. Each bucket makes its own stretch of it; there are as many as keep each at PLACES hashes, and
    ``buckets`` at least. Where the bitmap would be full, all bits are set."""
    if expected > CROWDED * FILTER_BITS:
        return Bitmap(np.full(1, 255, np.uint8), 1)
    buckets = max(buckets, -(-expected // PLACES))
    width = -(-min(FILTER_BITS, HASH_BITS * max(expected, 1 << 14)) // buckets // 8) * 8

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, many = [], 0

        def batch_of() -> pa.RecordBatch:
            rows = list(_dealt(np.concatenate([h for h, _ in waiting]), np.concatenate([t for _, t in waiting]), buckets))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "places"])

        for h, owners in hashes(batches):
            if len(h):
                waiting.append((h, owners))
                many += len(h)
            if many >= GATHER:
                yield batch_of()
                waiting, many = [], 0
        if waiting:
            yield batch_of()

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.concatenate([np.frombuffer(p, np.uint32) for p in pdf["places"]]))
        at = (x[1:][x[1:] == x[:-1]].astype(np.uint64) * np.uint64(width)) >> np.uint64(32)
        bits = np.zeros(width, np.uint8)
        bits[at.astype(np.int64)] = 1
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(width // 8 * buckets, np.uint8)
    found = cut(rows.mapInArrow(gathered, "bucket int, places binary").groupBy("bucket").applyInPandas(met, "bucket int, bits binary"), "bitmap")
    for r in found.coalesce(FETCHES).toLocalIterator():
        out[width // 8 * r["bucket"] : width // 8 * (r["bucket"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    spent(found)
    return Bitmap(out, buckets)


def shared_hashes(docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], buckets: int, expected: int) -> Bitmap:
    """Of the hashes that different texts have. ``hashes``: of a batch of
    texts, places in it and their hashes, some ``expected`` in all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Hashed:
        texts, seen = 0, set()
        for batch in textkit.slices(batches, 1):
            new = [k for k, i in enumerate(batch.column(0).to_pylist()) if not (i in seen or seen.add(i))]
            raw, edges = textkit.buffers(batch.column(1).take(pa.array(new, pa.int32())))
            at, h = hashes(raw, edges)
            yield h, texts + np.searchsorted(edges, at, "right") - 1
            texts += len(new)

    return met_twice(docs.select(F.unhex(F.sha2("text", 256)), "text"), each, buckets, expected)


def _stretches(docs: DataFrame, buckets: int) -> DataFrame:
    """Written, of texts (doc, text, version): the bytes that the windows of each
    shared anchor cover, the anchor's hash, and where they start. Only
    windows with shared bytes before or behind the anchor count. Where a task
    has the same bytes of a smaller document, they are lost in any case: of
    these come the byte ranges alone (start, stop), with no anchor or bytes."""
    sc = docs.sparkSession.sparkContext
    # A window of SPAN bytes picks one of its grams, so about one gram in 16 is an anchor.
    expected = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 12
    anchors = sc.broadcast(shared_hashes(docs, _all_anchors, buckets, expected))

    def sides(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, _, _, _, left, right, before, behind = _sides(raw, edges, anchors.value)
        return np.concatenate([first[before], first[behind]]), np.concatenate([left[before], right[behind]])

    around = sc.broadcast(shared_hashes(docs, sides, buckets, 2 * expected))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, many = [], 0
        for batch in textkit.slices(batches, 1):
            raw, edges = textkit.buffers(batch.column(1))
            first, last, at, h, left, right, before, behind = _sides(raw, edges, anchors.value)
            before &= around.value.has(left)
            behind &= around.value.has(right)
            first = np.where(before, first, np.maximum(first, at - HALF))
            last = np.where(behind, last, np.minimum(last, at - HALF))
            keep = (before | behind) & (first <= last)
            first, last, h = first[keep], last[keep], h[keep]
            doc = np.searchsorted(edges, first, "right") - 1
            n = last - first + SPAN
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            body = raw[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
            bytes_ = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(body)])
            ids, versions = (batch.column(k).take(pa.array(doc)) for k in (0, 2))
            start = first - edges[doc]
            waiting.append(pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, versions, pa.array(start), pa.array(start + n), bytes_], names=names))
            many += len(n)
            if many >= SETTLED:
                yield from _settled(pa.Table.from_batches(waiting))
                waiting, many = [], 0
        if many:
            yield from _settled(pa.Table.from_batches(waiting))

    names = ["anchor", "doc", "version", "start", "stop", "bytes"]
    found = cut(docs.mapInArrow(cut_out, "anchor long, doc long, version long, start long, stop long, bytes binary"), "stretches")
    anchors.destroy()
    around.destroy()
    return found


def _settled(stretches: pa.Table) -> Iterator[pa.RecordBatch]:
    """The stretches without those that a smaller document among them has
    too, and the byte ranges that these lose."""
    docs, coded = stretches["doc"].to_numpy(), stretches["bytes"].combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy()
    least = np.full(len(coded.dictionary), docs.max())
    np.minimum.at(least, code, docs)
    later = docs > least[code]
    kept = stretches.filter(pa.array(~later))
    yield from kept.set_column(4, "stop", pa.nulls(len(kept), pa.int64())).combine_chunks().to_batches()
    doc, version, a, b = (stretches[c].to_numpy()[later] for c in ("doc", "version", "start", "stop"))
    order = np.lexsort((a, version, doc))
    doc, version, a, b = doc[order], version[order], a[order], b[order]
    other = np.ones(len(a), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    a, b, new = _runs(np.cumsum(other), a, b)
    none = [pa.nulls(len(a), kind) for kind in (pa.int64(), pa.binary())]
    yield pa.RecordBatch.from_arrays([none[0], pa.array(doc[new]), pa.array(version[new]), pa.array(a), pa.array(b), none[1]], names=stretches.column_names)


def _runs(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of documents, in order of these and of their starts, joined
    where they touch: starts, ends, and which ranges begin one."""
    # The furthest end so far in the document: ends of later documents are higher by their number.
    step = int(b.max(initial=0)) + 1
    furthest = np.maximum.accumulate(b + of * step) - of * step
    new = np.ones(len(a), bool)
    new[1:] = (of[1:] != of[:-1]) | (a[1:] > furthest[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(a))[: new.sum()] - 1
    return a[new], furthest[last], new


def suffix_order(raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``start`` by their first SPAN bytes, and
    in that order the first place of each one's run of suffixes that share these."""
    rank = np.unique(_eights(raw).byteswap(), return_inverse=True)[1].astype(np.uint64)
    for step in (8, 16):
        after = np.zeros(len(rank), np.uint64)
        after[:-step] = rank[step:] + np.uint64(1)
        rank = np.unique(rank << np.uint64(32) | after, return_inverse=True)[1].astype(np.uint64)
    # Two overlapping parts of 32 bytes give the order by SPAN bytes.
    key = rank[start] << np.uint64(32) | rank[start + SPAN - 32]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def previous_smaller(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it, from ``run`` on, with a
    smaller value; -1 without one. A pointer that leads to no smaller value
    takes over where that one leads."""
    at = np.arange(len(values)) - 1
    at[at < run] = -1
    left = np.flatnonzero(at >= 0)
    while len(left):
        left = left[values[at[left]] >= values[left]]
        at[left] = at[at[left]]
        left = left[at[left] >= 0]
    return at


def has_previous_factor(raw: np.ndarray, start: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix has SPAN bytes at
    least: whether the previous or the next smaller document in suffix order
    stands where SPAN bytes are still shared. ``docs``: of each suffix."""
    order, run = suffix_order(raw, start)
    values = docs[order]
    n = len(order)
    ends = np.append(np.flatnonzero(run == np.arange(n)), n)
    last = np.repeat(ends[1:] - 1, np.diff(ends))
    before = previous_smaller(values, run) >= 0
    after = previous_smaller(values[::-1], (n - 1 - last)[::-1])[::-1] >= 0
    out = np.empty(n, bool)
    out[order] = before | after
    return out


def earlier_matches(raw: np.ndarray, ends: np.ndarray, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a document before ``least`` has too: the stretch,
    and its first and last window. ``ends``: n + 1 offsets of the distinct
    stretches in ``raw``; ``least``: the least document of each."""
    _, group, many = np.unique(anchors, return_inverse=True, return_counts=True)
    some = np.flatnonzero(many[group] > 1)  # a stretch alone meets no other
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    size = np.diff(ends)[some]
    begin = np.cumsum(size) - size
    body = raw[np.repeat(ends[some] - begin, size) + np.arange(size.sum())]
    windows_ = size - SPAN + 1
    of = np.repeat(np.arange(len(some)), windows_)
    place = np.arange(len(of)) - np.repeat(np.cumsum(windows_) - windows_, windows_)
    hit = has_previous_factor(body, begin[of] + place, least[some][of])
    first, last = hit.copy(), hit.copy()
    same = of[1:] == of[:-1]
    first[1:] &= ~(hit[:-1] & same)
    last[:-1] &= ~(hit[1:] & same)
    return some[of[first]], place[first], place[last]


def _versioned(docs: DataFrame) -> DataFrame:
    """doc, text and the text's hash, which tells rows of one doc_id apart."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    return df.withColumn("version", F.xxhash64("text"))


def _in_buckets(found: DataFrame, buckets: int) -> DataFrame:
    """(doc, version, a, b): byte ranges that stretches lose."""

    def matched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs, starts = table["doc"].to_numpy(), table["start"].to_numpy()
        coded = table["bytes"].chunk(0).dictionary_encode()
        code = coded.indices.to_numpy()
        raw, ends = textkit.buffers(coded.dictionary)
        least = np.full(len(ends) - 1, docs.max())
        np.minimum.at(least, code, docs)
        anchors = np.empty(len(least), np.int64)
        anchors[code] = table["anchor"].to_numpy()
        of, a, b = earlier_matches(raw, ends, anchors, least)
        later = np.flatnonzero(docs > least[code])
        # What the first documents of the distinct stretches lose, at each of their places.
        first = np.flatnonzero(docs == least[code])
        begin = np.searchsorted(of, np.arange(len(least) + 1))
        many = np.diff(begin)[code[first]]
        row = np.repeat(first, many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[code[row]]
        rows = np.concatenate([later, row])
        return pa.table({
            "doc": docs[rows], "version": table["version"].to_numpy()[rows],
            "a": starts[rows] + np.concatenate([np.zeros(len(later), np.int64), a[k]]),
            "b": starts[rows] + np.concatenate([np.diff(ends)[code[later]], b[k] + SPAN]),
        })

    bucket = F.pmod("anchor", F.lit(buckets)).cast("int")
    return found.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(matched, "doc long, version long, a long, b long")


def _by_window(found: DataFrame) -> DataFrame:
    """The same of crowded anchors: each window of a distinct stretch is a
    row, and its least document is found by grouping. Stretches meet their
    windows again by 128 bits of two hashes of their bytes."""
    name = [F.xxhash64("bytes").alias("h1"), F.xxhash64(F.lit(7), "bytes").alias("h2")]
    distinct = found.groupBy("bytes").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("doc").alias("many"))
    each = distinct.select(*name, "most", "many", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - SPAN)).alias("k"), "bytes", "least").withColumn("window", F.expr(f"substring(bytes, k + 1, {SPAN})"))
    first = each.groupBy("window").agg(F.min("least").alias("first"))
    lost = each.join(first, "window").where("first < most").groupBy("h1", "h2").agg(F.max("many").alias("many"), F.collect_list(F.struct("k", "first")).alias("lost"))
    lost = cut(lost, "crowded-windows")
    rows, frequent = found.select(*name, "doc", "version", "start"), lost.where(F.col("many") > CROWD).drop("many")
    met = []
    if 0 < frequent.count() <= BROADCAST_ROWS:  # so few that their places needn't meet in one task each
        met.append(rows.join(F.broadcast(frequent), ["h1", "h2"]))
        rows, lost = rows.join(F.broadcast(frequent.select("h1", "h2")), ["h1", "h2"], "left_anti"), lost.where(F.col("many") <= CROWD)
    met.append(rows.join(lost.drop("many"), ["h1", "h2"]))
    spans = [x.select("doc", "version", "start", F.inline("lost")).where("first < doc") for x in met]
    return reduce(DataFrame.union, [x.select("doc", "version", (F.col("start") + F.col("k")).alias("a"), (F.col("start") + F.col("k") + SPAN).alias("b")) for x in spans])


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc, version, spans) of the documents (doc, version, text) that lose bytes; spans: byte ranges, which don't touch."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = _stretches(docs, 2 * partitions)
    found, settled = stretches.where("stop is null").drop("stop"), stretches.where("stop is not null")
    crowded = cut(found.groupBy("anchor").agg(F.count("anchor").alias("many")).where(f"many > {CROWD}").select("anchor"), "crowded")
    buckets = max(partitions, -(-found.count() // BUCKET_ROWS))
    spans = _in_buckets(found.join(crowded, "anchor", "left_anti"), buckets)
    if not crowded.isEmpty():
        spans = spans.union(_by_window(found.join(crowded, "anchor", "left_semi")))
    spans = spans.union(settled.select("doc", "version", F.col("start").alias("a"), F.col("stop").alias("b")))
    spans = spans.groupBy("doc", "version").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            of = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            order = np.lexsort((a, of))
            a, b, of = a[order], b[order], of[order]
            a, b, new = _runs(of, a, b)
            pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            offsets = np.searchsorted(of[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["doc", "version", "spans"])

    return spans.mapInArrow(merged, "doc long, version long, spans array<struct<a: long, b: long>>")


def _copies(docs: DataFrame) -> DataFrame:
    """(doc, version, size) of the rows whose whole text is also that of a smaller doc_id."""
    rows = _versioned(docs).where(f"doc is not null and octet_length(text) >= {SPAN}").select("doc", "version", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("sha"))
    firsts = rows.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return rows.join(firsts, "sha").where("doc > first").select("doc", "version", "size")


def among(rows: DataFrame) -> Column:
    """Whether a document is in ``rows`` (doc, version), by a bitmap of
    TOUCHED_BITS bits: true of all that are, and of few others. One row of 4 KB
    for each 32,768 bits comes to the driver, 1 MB in all and in one job."""
    mark = F.pmod(F.xxhash64("doc", "version"), F.lit(TOUCHED_BITS))
    bits = np.zeros(TOUCHED_BITS // 8, np.uint8)
    # Spark's bitmap functions count from 1 on.
    marks = rows.select((mark + 1).alias("mark"))
    for r in marks.groupBy(F.bitmap_bucket_number("mark").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits")).collect():
        bits[(r["number"] - 1) * 4096 : r["number"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    known = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def found(marks: pd.Series) -> pd.Series:
        at = marks.to_numpy()
        return pd.Series((known.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return found(mark)


def without_spans(df: DataFrame, lost: DataFrame, more_of: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``df``
    (doc, text, version), the columns ``more_of`` its row, and the further
    columns of ``lost`` (doc, version, spans), null where nothing is lost. Byte ranges may overlap. Only texts
    that may lose bytes are shuffled."""
    more = [c for c in lost.columns if c not in ("doc", "version", "spans")]
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = list(more_of or {})
    df = df.withColumns(more_of or {}).withColumn("maybe", among(lost))
    same = [F.col("doc").alias("doc_id"), number(F.octet_length("text")).alias("n_bytes"), number(F.lit(0)).alias("n_removed"), number(F.lit(0)).alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")]
    kept = df.where("not maybe").select(*same, *own, *[F.lit(None).cast(lost.schema[c].dataType).alias(c) for c in more])
    df = df.where("maybe").join(lost, ["doc", "version"], "left").select("doc", "text", "spans", *own, *more)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, 1):
            raw, edges = textkit.buffers(batch.column(1))
            step = np.zeros(len(raw) + 1, np.int32)
            spans = batch.column(2)
            flat = spans.flatten()
            if len(flat):
                owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
                a, b = (flat.field(k).to_numpy() + edges[owner] for k in (0, 1))
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            begin[edges[:-1][edges[:-1] < len(raw)]] = gone[edges[:-1][edges[:-1] < len(raw)]]
            runs = np.concatenate([[0], np.cumsum(begin)])
            kept = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = raw[a:b]
                kept.append(hashlib.sha256((part[~gone[a:b]] if total[b] > total[a] else part).tobytes()).hexdigest())
            a, b = edges[:-1], edges[1:]
            columns = [batch.column(0), pa.array(b - a), pa.array(total[b] - total[a]), pa.array(runs[b] - runs[a]), pa.array(kept), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=kept_names)

    kept_names = kept.columns
    return kept.union(df.mapInArrow(digested, kept.schema))


def deduplicated(docs: DataFrame) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of each document (doc_id, text).

    Every byte goes that is in a SPAN-byte string which also starts in a
    document of a smaller doc_id. Null texts are empty; texts of under SPAN
    bytes lose nothing, nor do documents without an id, which take nothing
    from others either. Rows of one doc_id take nothing from each other. Texts
    of any length are read whole, PIECE windows at once.
    """
    copies = cut(_copies(docs), "copies")
    df = _versioned(docs).withColumn("maybe", among(copies))
    doubtful = cut(df.where("maybe").join(copies, ["doc", "version"], "left_anti").select("doc", "text", "version"), "doubtful")
    df = df.where("not maybe").drop("maybe").union(doubtful)
    lost = cut(removed_spans(df.where("doc is not null and text is not null")), "lost")
    size = F.col("size").cast("long")
    whole = copies.select(F.col("doc").alias("doc_id"), size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    return whole.union(without_spans(df, lost))
