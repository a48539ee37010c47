"""Benchmark decontamination by winnowing.

Of every sliding window of word k-grams the least hash is kept as fingerprint,
on the side of the documents and on that of the benchmark. A span that both
share and that is as long as a window has the same least hash on both sides,
so fingerprints that meet show every such span; each hit is then extended to
the whole window and compared as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .storage import cut

WINDOW = 10
GRAM = 5
#: Characters of benchmark text in one broadcast index; a longer benchmark is dealt to several, one pass each.
INDEX_CHARS = 64_000_000


@dataclass
class Index:
    """Of benchmark texts: for each window length its hashes, sorted, with
    the items of each, and the fingerprints of the full windows."""

    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    prints: np.ndarray
    items: list[str]


def _least(g: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    out = g[: len(g) - n + 1].copy()
    for k in range(1, n):
        np.minimum(out, g[k : k + len(out)], out=out)
    return out


def build_index(rows: list[tuple[str | None, str | None]]) -> Index:
    items = sorted({i for i, _ in rows if i is not None})
    place = {x: k for k, x in enumerate(items)}
    raw, edges = textkit.buffers(pa.array([t for _, t in rows], pa.string()))
    h, _, at = textkit.words_of(raw, edges, textkit.ALNUM)
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    prints = [np.zeros(0, np.uint64)]
    for (item, _), a, b in zip(rows, at[:-1].tolist(), at[1:].tolist()):
        n = min(WINDOW, b - a)
        if n:
            found.setdefault(n, []).append((textkit.grams(h[a:b], n), place.get(item, -1)))
        if n == WINDOW:
            prints.append(_least(textkit.grams(h[a:b], GRAM), WINDOW - GRAM + 1))
    windows = {}
    for n, parts in found.items():
        keys = np.concatenate([g for g, _ in parts])
        owner = np.concatenate([np.full(len(g), i) for g, i in parts])
        both = np.unique(np.column_stack([keys, owner.astype(np.int64).view(np.uint64)]), axis=0)
        keys, first = np.unique(both[:, 0], return_index=True)
        windows[n] = keys, np.append(first, len(both)), both[:, 1].view(np.int64)
    return Index(windows, np.unique(np.concatenate(prints)), items)


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``values`` of those that are keys, and the places of these keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == values)
    return hit, at[hit]


def find_hits(index: Index, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: its first words in ``h`` where a benchmark
    window occurs inside one text, and the place of the window in the index."""
    for n, (keys, _, _) in index.windows.items():
        if len(h) < n:
            continue
        if n == WINDOW:
            least = _least(textkit.grams(h, GRAM), WINDOW - GRAM + 1)
            first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            run, _ = _find(index.prints, least[first])
            ends = np.append(first[1:], len(least))
            start = np.concatenate([np.arange(first[r], ends[r]) for r in run]) if len(run) else np.zeros(0, np.int64)
        else:
            start = np.arange(len(h) - n + 1)
        start = start[start + n <= at[np.searchsorted(at, start, "right")]]
        if len(start):
            g = np.zeros(len(start), np.uint64)
            for k in range(n):
                g = g * textkit.BASE + h[start + k]
            hit, where = _find(keys, textkit.mix(g))
            if len(hit):
                yield n, start[hit], where


def _mark(df: DataFrame, index: Index, kept: list[str], text: int, last: bool) -> DataFrame:
    """``df`` (kept columns, the text behind them if its place ``text`` isn't
    among them, spans and items so far) with what ``index`` adds."""
    shared = df.sparkSession.sparkContext.broadcast(index)
    schema = df.schema
    spans_at = len(schema) - 2
    if last:
        schema = T.StructType([*[f for f in schema if f.name != "__text"], T.StructField("__n", T.LongType()), T.StructField("__hit", T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in textkit.slices(batches, text):
            raw, edges = textkit.buffers(batch.column(text))
            h, _, at = textkit.words_of(raw, edges, textkit.ALNUM)
            step = np.zeros(len(h) + 1, np.int64)
            pairs = []
            for n, start, where in find_hits(ix, h, at):
                np.add.at(step, start, 1)
                np.add.at(step, start + n, -1)
                _, bounds, owners = ix.windows[n]
                doc = np.searchsorted(at, start, "right") - 1
                many = bounds[where + 1] - bounds[where]
                k = np.repeat(bounds[where] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                pairs.append(np.column_stack([np.repeat(doc, many), owners[k]]))
            items: list[list[str]] = [x or [] for x in batch.column(spans_at + 1).to_pylist()]
            if pairs:
                for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
                    if i >= 0:
                        items[d].append(ix.items[i])
            for d, old in enumerate(batch.column(spans_at).to_pylist()):
                if old:
                    old = np.frombuffer(old, np.int64).reshape(-1, 2) + at[d]
                    np.add.at(step, old[:, 0], 1)
                    np.add.at(step, old[:, 1], -1)
            hit = np.cumsum(step[:-1]) > 0
            spans = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                x = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                spans.append(x.astype(np.int64).tobytes() if len(x) else None)
            columns = [*batch.columns[: len(kept) if last else spans_at], pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            if last:
                total = np.concatenate([[0], np.cumsum(hit)])
                columns += [pa.array(np.diff(at)), pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(marked, schema)


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of each
    document, beside its columns ``keep`` (doc_id).

    A text without words, null included, has no windows and is clean; so is
    all under an empty benchmark. A null item_id marks words but is no item;
    repeated items count once; repeated documents are judged alike.
    """
    kept = [c for c in (["doc_id"] if keep is None else keep) if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    df, text = textkit.with_text(docs, kept, text_col)
    df = df.select("*", F.lit(None).cast("binary").alias("__spans"), F.lit(None).cast("array<string>").alias("__items"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(-(-chars // INDEX_CHARS)) or 1
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        df = _mark(df, build_index([(r["item_id"], r["text"]) for r in part.distinct().collect()]), kept, text, k == parts - 1)
        if k < parts - 1:
            df = cut(df, "decontamination")
    ids = F.array_sort(F.array_distinct("__items"))
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__n").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that share no window with the benchmark."""
    names = docs.columns
    apart = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)])
    judged = judge(apart, benchmark, keep=apart.columns, text_col=f"__k{names.index('text')}")
    return judged.where(~F.col("contaminated")).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)])
