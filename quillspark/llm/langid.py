"""Language identification.

A text is the average of the embeddings of its subwords (byte n-grams inside
words, hashed into a fixed table); a linear softmax on it gives the language.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy, on subword counts of a bounded sample of labelled rows. One class more
stands for no language: it is learnt from texts of the sample whose letters
are shuffled or drawn at random, and takes its share of the probability. On a
part of the sample that the training doesn't see, the softmax gets its
temperature, and the rejection threshold is set so that it costs few right
answers.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows to draw, at most about so many, dealt
    equally to the languages, whatever the input's size. ``held_back``: part
    of them that isn't trained on; what is over ``fitted`` rows isn't either,
    so that ``lost`` is some rows of a full sample. ``languages``: at
    most so many, the most frequent. ``lost``: part of right answers on the
    held-back rows that rejection may cost. ``least_steps``: of gradient descent,
    so that a small sample is gone through more often."""

    sample: int = 9600
    fitted: int = 4800
    languages: int = 256
    buckets: int = 8192
    orders: tuple[int, ...] = (1, 2, 3, 4)
    width: int = 16
    epochs: int = 12
    least_steps: int = 2000
    rate: float = 4.0
    batch: int = 32
    held_back: float = 0.2
    lost: float = 0.0005
    seed: int = 5


@dataclass
class Model:
    """The last column of ``weights`` and ``bias`` is that of no language."""

    languages: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Rows of subword counts to calibrated probabilities."""
        x = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        z = (x @ self.table @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def subword_counts(raw: np.ndarray, s: Settings) -> np.ndarray:
    """Counts of the hashed subwords of one text, read in pieces. Bytes that
    are no letters count as one blank, which begins and ends words."""
    counts = np.zeros(s.buckets)
    longest = max(s.orders)
    for a in range(0, len(raw), textkit.SEGMENT):
        part = textkit.LOWER[raw[a : a + textkit.SEGMENT + longest - 1]]
        letter = _LETTERS[part]
        part = np.where(letter, part, 0x20).astype(np.uint32)
        inner = len(part) if a + textkit.SEGMENT >= len(raw) else textkit.SEGMENT
        h = np.zeros(len(part), np.uint32)
        some = np.zeros(len(part), bool)
        for n in range(1, longest + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(1)
            some = some[:m] | letter[n - 1 :]
            if n in s.orders:
                at = slice(0, min(m, inner))
                keep = some[at]
                if n > 2:  # no blank inside
                    for k in range(1, n - 1):
                        keep = keep & letter[k : k + len(keep)]
                g = h[at][keep]
                g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                counts += np.bincount((g ^ (g >> np.uint32(13))) % np.uint32(s.buckets), minlength=s.buckets)
    return counts


#: Letters from which on a text has a scrambled copy in the sample.
SCRAMBLED = 40


def scrambled(text: str, seed: int) -> np.ndarray | None:
    """Bytes of the text with its letters shuffled, or (odd seeds) drawn at
    random from a to z; blanks and marks stay. None for a text of few letters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    letter = np.flatnonzero(((codes | 0x20) - 0x61 < 26) | (codes >= 0x80))
    if len(letter) < SCRAMBLED:
        return None
    rng = np.random.default_rng(seed & (1 << 63) - 1)
    codes[letter] = rng.integers(0x61, 0x7B, len(letter)) if seed & 1 else rng.permutation(codes[letter])
    return np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


Counts = tuple[np.ndarray, np.ndarray]


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets, as their distances, and counts, in few bytes for the driver."""
    return zlib.compress(np.concatenate([np.diff(buckets, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel(), counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()]).tobytes())


def unpacked(data: bytes) -> Counts:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 4, -1)
    gaps, counts = (np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in planes)
    return np.cumsum(gaps).astype(np.uint16 if gaps.sum() < 1 << 16 else np.uint32), counts


def train(rows: Iterable[Counts], labels: np.ndarray, languages: list[str], s: Settings) -> Model:
    """Fit on subword counts (buckets and counts of each row); ``labels`` are
    indices of ``languages``, or their number for a text of no language."""
    rng = np.random.default_rng(s.seed)
    shares = [(k, (c / max(1, c.sum())).astype(np.float32)) for k, c in rows]
    order = rng.permutation(len(shares))
    back = order[: max(int(len(shares) * s.held_back), len(shares) - s.fitted)]
    fit = order[len(back) :]
    table = rng.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
    weights = rng.normal(0, 0.1, (s.width, len(languages) + 1)).astype(np.float32)
    bias = np.zeros(len(languages) + 1, np.float32)
    each = max(1, -(-len(fit) // s.batch))
    epochs = max(s.epochs, -(-s.least_steps // each))
    steps, done = epochs * each, 0

    def embedded(at: np.ndarray) -> np.ndarray:
        return np.stack([shares[i][1] @ table[shares[i][0]] for i in at])

    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), s.batch):
            at = fit[k : k + s.batch]
            rate = s.rate * (1 - done / steps)
            done += 1
            inner = embedded(at)
            error = _softmax(inner @ weights + bias)
            error[np.arange(len(at)), labels[at]] -= 1
            error /= len(at)
            back_in = error @ weights.T
            weights -= rate * inner.T @ error
            bias -= rate * error.sum(0)
            for i, g in zip(at, back_in):
                table[shares[i][0]] -= rate * 8 * shares[i][1][:, None] * g
    model = Model(languages, table, weights, bias, 1.0, 0.0, s)
    if len(back):
        z = embedded(back) @ weights + bias
        at = np.arange(len(back))
        grid = np.geomspace(0.25, 8, 41)
        model.temperature = float(grid[np.argmin([-np.log(np.maximum(_softmax(z / t)[at, labels[back]], 1e-12)).mean() for t in grid])])
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(1)[(p.argmax(1) == labels[back]) & (labels[back] < len(languages))])
        junk = np.sort(p[:, :-1].max(1)[labels[back] == len(languages)])
        if len(right):
            # Between what nearly all junk stays below and what nearly all right answers reach.
            low, high = junk[int(len(junk) * 0.99)] if len(junk) else 0.25, right[int(len(right) * s.lost)]
            model.threshold = float(min(0.5, np.sqrt(low * high) if low < high else high))
    return model


def fit(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model | None:
    """A model of the labelled rows of ``docs`` (null without any).

    The sample is drawn by a hash of key and language, at a rate for each
    language that follows from its count over all rows. Its subword counts are
    made where the texts are read; one task trains on them, which the size of
    the sample bounds, and only the model comes to the driver.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key_col, lang_col, F.lit(s.seed)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Of the languages only the most frequent are learnt; what is written in others is for rejection.
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.languages).collect()
    if not sizes:
        return None
    quota = -(-s.sample // len(sizes))
    rates = {r["lang"]: min(1.0, quota / r["count"]) for r in sizes}
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in rates.items()])
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    drawn = rows.where(unit < rate).select("h", "lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, 2):
            raw, at = textkit.buffers(batch.column(2))
            found, of = [], []
            for k, (h, a, b) in enumerate(zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist())):
                junk = scrambled(raw[a:b].tobytes().decode("utf-8", "replace"), h >> 8) if (h >> 32) % len(rates) == 0 else None
                for real, x in ((True, raw[a:b]), (False, junk)):
                    if x is not None:
                        c = subword_counts(x, s)
                        some = np.flatnonzero(c)
                        found.append(packed(some, c[some]))
                        of.append((k, real))
            at, real = pa.array([k for k, _ in of], pa.int32()), pa.array([r for _, r in of], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), real, batch.column(1).take(at), pa.array(found, pa.binary())], names=["h", "real", "lang", "counts"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns)))
        if got:
            languages = sorted({lang for _, _, lang, _ in got})
            index = {x: i for i, x in enumerate(languages)}
            labels = np.array([index[lang] if real else len(languages) for _, real, lang, _ in got])
            model = train((unpacked(counts) for *_, counts in got), labels, languages, s)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The limit only guards the training task: the rates leave about a third of it.
    sample = drawn.mapInArrow(counted, "h long, real boolean, lang string, counts binary").limit(4 * s.sample).repartition(1)
    got = sample.mapInArrow(trained, "model binary").first()
    return pickle.loads(got["model"]) if got else None


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and lang_rejected (columns of these names
    are replaced).

    The whole text counts. A null text, one without a letter, and any text
    under a missing model get ``und``, score 0 and are rejected; so does, but
    for its lang_pred and score, a text whose score is below the model's threshold.
    Ties go to the language that is first in code-point order.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "lang_rejected")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    base, text = textkit.with_text(df, kept, text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in textkit.slices(batches, text):
            raw, at = textkit.buffers(batch.column(text))
            n = batch.num_rows
            letters = np.concatenate([[0], np.cumsum(_LETTERS[raw])])
            langs, scores, out = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            if m is not None:
                for k in range(0, n, 128):
                    rows = range(k, min(n, k + 128))
                    p = m.probabilities(np.stack([subword_counts(raw[at[i] : at[i + 1]], m.settings) for i in rows]).astype(np.float32))
                    few = letters[at[k + 1 : k + len(rows) + 1]] - letters[at[k : k + len(rows)]] < SCRAMBLED
                    p[few, -1] = 0
                    p[few] = (p[few] + 1e-30) / (p[few] + 1e-30).sum(1, keepdims=True)
                    best = p[:, :-1].argmax(1)
                    for j, i in enumerate(rows):
                        piece = raw[at[i] : at[i + 1]]
                        ascii_letter = _LETTERS[piece] & (piece < 0x80)
                        if ascii_letter.any() or _has_letter(piece.tobytes().decode("utf-8", "replace")):
                            langs[i], scores[i] = m.languages[best[j]], float(p[j, best[j]])
                            out[i] = scores[i] < m.threshold
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=[*kept, "lang_pred", "score", "lang_rejected"])

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double").add("lang_rejected", "boolean")
    return base.mapInArrow(predicted, schema)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key's text is 2 modulo 4; false for null."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) whose language the model doesn't reject."""
    names = docs.columns
    apart = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)])
    judged = predict(apart, model, f"__k{names.index('text')}")
    return judged.where(~F.col("lang_rejected")).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)])
