"""Toxicity by maximum-scoring segments.

Every word has a log-odds of toxic against clean documents, with a Dirichlet
prior in proportion to the word's frequency in both. A linear-time scan finds
all maximal segments of a text's word scores. Under the clean model the best
segment of a text follows an extreme-value law whose scale grows with the
text's length; its tail gives each segment's p-value, and a logistic curve on
the document's evidence gives the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .storage import cut, spent


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows to fit on, at most about so many, half of
    each class, whatever the input's size. ``vocabulary``: words with a score
    of their own, at most so many, those of the surest log-odds. ``prior``:
    weight of the Dirichlet prior, as a part of all counted words. ``drift``: what any other word
    costs a segment. ``held_back``: part of the sample that only the
    calibration sees. ``alpha``: p-value of a significant passage."""

    sample: int = 40_000
    vocabulary: int = 50_000
    prior: float = 0.05
    surest: float = 3.0
    drift: float = 0.25
    held_back: float = 0.3
    alpha: float = 0.01
    seed: int = 3


@dataclass
class Model:
    words: np.ndarray
    scores: np.ndarray
    scale: float
    decay: float
    curve: np.ndarray
    settings: Settings

    def word_scores(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        return np.where(known, self.scores[at] if len(self.words) else 0.0, -self.settings.drift)

    def p_value(self, score: float, n_words: int) -> float:
        """That a clean text of so many words has a segment of this score."""
        return float(-np.expm1(-self.scale * n_words * np.exp(-self.decay * score)))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ self.curve[1:], -30, 30)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after the last, score)
    in linear time: each positive word opens a candidate, which joins the
    nearest earlier candidate from a lower level if that one peaks below."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    left: list[float] = []
    right: list[float] = []
    spans: list[tuple[int, int]] = []
    lower: list[int] = []
    for k in np.flatnonzero(scores > 0).tolist():
        a, b, lo, hi = k, k + 1, total[k], total[k + 1]
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = lower[j]
            if j < 0 or right[j] >= hi:
                break
            a, lo = spans[j][0], left[j]
            del left[j:], right[j:], spans[j:], lower[j:]
        left.append(lo)
        right.append(hi)
        spans.append((a, b))
        lower.append(j)
    return [(a, b, float(hi - lo)) for (a, b), lo, hi in zip(spans, left, right)]


def _evidence(p: list[float], alpha: float) -> tuple[float, float]:
    """Of a document: how unlikely its best segment is, and how many significant ones it has."""
    return (min(50.0, -np.log(max(min(p), 1e-300))) if p else 0.0, np.log1p(sum(x <= alpha for x in p)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """A model of the labelled documents (none without both classes).

    ``labels``: doc_id and toxic; several labels of a document count as toxic
    if one is. The sample's size bounds the broadcast of its ids and all that
    comes to the driver.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    rates = {k: min(1.0, s.sample / 2 / n) for k, n in sizes.items()}
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(s.seed)), 11).cast("double") / float(1 << 53)
    drawn = marked.where(unit < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])).limit(2 * s.sample)
    back = F.pmod(F.xxhash64("doc_id", F.lit(s.seed + 1)), F.lit(1000)) < int(1000 * s.held_back)
    drawn = drawn.select("doc_id", "toxic", back.alias("back"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, 0):
            raw, edges = textkit.buffers(batch.column(0))
            h, _, at = textkit.words_of(raw, edges, textkit.ALNUM)
            toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(at))
            # Each word counts once a document, so that no long text outweighs others.
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(at))
            _, first = np.unique(textkit.mix(h + doc * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            w, inverse = np.unique(h[first], return_inverse=True)
            bad = np.bincount(inverse, weights=toxic[first], minlength=len(w)).astype(np.int64)
            n = np.bincount(inverse, minlength=len(w)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(bad), pa.array(n)], names=["word", "bad", "n"])

    words = rows.where("not back").select("text", "toxic").mapInArrow(counted, "word long, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    words = words.where("n > 1")
    sums = words.agg(F.sum("bad"), F.sum("n")).first()
    bad_all, all_ = float(sums[0] or 0), float(sums[1] or 0)
    if not 0 < bad_all < all_:
        return None
    weight = all_ * s.prior
    prior = F.col("n") * s.prior
    y1, y0 = F.col("bad") + prior, F.col("n") - F.col("bad") + prior
    odds = F.log(y1 / (bad_all + weight - y1)) - F.log(y0 / (all_ - bad_all + weight - y0))
    sure = F.abs(odds) / F.sqrt(1 / y1 + 1 / y0)
    kept = words.select("word", odds.alias("odds"), sure.alias("sure"), (y0 / (all_ - bad_all + weight)).alias("clean")).where(F.col("sure") >= s.surest)
    got = sorted(kept.orderBy(F.desc("sure"), "word").limit(s.vocabulary).collect(), key=lambda r: r["word"] & (1 << 64) - 1)
    vocabulary = np.array([r["word"] for r in got], np.int64).view(np.uint64)
    scores = np.array([r["odds"] for r in got]) - s.drift
    clean = np.array([r["clean"] for r in got])
    model = Model(vocabulary, scores, 1.0, _decay(scores, clean, s.drift), np.zeros(3), s)
    held = cut(rows.where("back").select("text", "toxic"), "toxicity-held-back")
    found = _measured(held, model, lambda x, n: (max((g[2] for g in segments(x)), default=0.0), 0.0))
    if not found:
        return None
    n, best, _, toxic = (np.array(x, float) for x in zip(*found))
    ok = toxic == 0
    tail = float((n[ok] * np.exp(-model.decay * best[ok])).sum())
    model.scale = max(1.0, float((best[ok] > 0).sum())) / max(tail, 1.0)
    found = _measured(held, model, lambda x, n: _evidence([model.p_value(g[2], n) for g in segments(x)], s.alpha))
    evidence, toxic = np.array([r[1:3] for r in found]), np.array([r[3] for r in found], float)
    model.curve = _logistic(evidence, toxic, np.where(toxic == 1, 1 / rates[1], 1 / rates[0]))
    spent(held)
    return model


def _decay(scores: np.ndarray, clean: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(root * score)] = 1 over clean words."""
    rest = max(0.0, 1 - clean.sum())

    def excess(x: float) -> float:
        return float((clean * np.exp(np.minimum(x * scores, 600))).sum() + rest * np.exp(-x * drift)) - 1

    lo, hi = 1e-3, 1e-3
    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(lo, 1e-2)


def _measured(rows: DataFrame, model: Model, measure: Callable[[np.ndarray, int], tuple[float, float]]) -> list:
    """Number of words, two measures of the word scores, and the label of each
    row: four numbers for each text of the sample, however long it is."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, 0):
            raw, edges = textkit.buffers(batch.column(0))
            h, _, at = textkit.words_of(raw, edges, textkit.ALNUM)
            x = model.word_scores(h)
            found = [measure(x[a:b], int(b - a)) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), *(pa.array([float(f[k]) for f in found], pa.float64()) for k in (0, 1)), batch.column(1)], names=["n", "one", "two", "toxic"])

    return sorted(map(tuple, rows.mapInArrow(scanned, "n long, one double, two double, toxic int").collect()))


def _word_end(raw: np.ndarray, at: int, end: int) -> int:
    """Where the word that begins at ``at`` ends, ``end`` at the latest."""
    size = 64
    while True:
        stop = np.flatnonzero(~textkit.ALNUM[raw[at : min(end, at + size)]])
        if len(stop) or at + size >= end:
            return at + int(stop[0]) if len(stop) else end
        size *= 8


def score(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with score, predicted and the significant passages: byte offsets
    in the text's UTF-8, score and p-value. Columns of these names are replaced.

    The whole text counts, whatever its length. Empty, null and wordless
    texts have no passage and get the score of a text without evidence; so
    does every text under a missing model, with score 0.
    """
    added = ("score", "predicted", "passages")
    kept = [c for c in df.columns if c not in added]
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in textkit.slices(batches, len(kept)):
            found, values = [[] for _ in range(batch.num_rows)], np.zeros(batch.num_rows)
            if m is not None:
                raw, edges = textkit.buffers(batch.column(len(kept)))
                h, starts, at = textkit.words_of(raw, edges, textkit.ALNUM)
                x = m.word_scores(h)
                evidence = np.zeros((batch.num_rows, 2))
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    spans = segments(x[a:b])
                    if not spans:
                        continue
                    p = [m.p_value(v, b - a) for _, _, v in spans]
                    evidence[i] = _evidence(p, m.settings.alpha)
                    for (u, w, v), q in zip(spans, p):
                        if q <= m.settings.alpha:
                            stop = _word_end(raw, int(starts[a + w - 1]), int(edges[i + 1]))
                            found[i].append({"start": int(starts[a + u] - edges[i]), "end": stop - int(edges[i]), "score": v, "p_value": q})
                values = m.score(evidence)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array(found, pa.list_(passage))], names=[*kept, *added])

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for field in T.StructType.fromDDL("score double, predicted int, passages array<struct<start: bigint, end: bigint, score: double, p_value: double>>"):
        schema = schema.add(field)
    return base.mapInArrow(scored, schema)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key's text is 0 modulo 5; false for null."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
