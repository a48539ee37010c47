"""Full-text search over a written inverted index.

An index is a folder of two tables. ``postings`` has a row for each word and
block of chunks: how often the word stands in the chunk that has it most
(tf), the least length of a chunk that has it (len), and of all these chunks
the ids, lengths and counts, then the field and place of each occurrence. A
row of the empty word has all chunks of the block. ``stats`` has one row, the
number of chunks and their mean length; it is written last.

Each task packs the chunks that it reads and writes one file, sorted by words,
so that nothing is shuffled, and a word or a prefix reads of each file the row
groups and pages that hold it and no others.

Chunks of like length share blocks. A search bounds the score of each block
from the maxima, scores the most promising blocks, and then only those whose
bound reaches the k-th best score found there.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuts import cut, shared_folder

K1, B = 1.2, 0.75
#: Chunks of a block, blocks that are scored first, and blocks that are named in a filter (more are joined).
BLOCK, FIRST, NAMED = 1024, 4, 500
#: Words of chunks that are packed at once, about.
PACKED = 2_000_000
#: Bytes of a row group; small ones are skipped more finely.
ROW_GROUP = 4 << 20


@lru_cache
def _accents() -> tuple[str, str]:
    """Small letters with marks, and the letters below the marks."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x2000)) if c == c.lower()]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and unicodedata.category(d[0])[0] == "L" and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


@dataclass(frozen=True)
class Analyzer:
    """How texts become words: small letters, without marks if ``fold``, split at ``other``."""

    other: str
    fold: bool = False

    def words(self, text: Column) -> Column:
        body = F.lower(F.coalesce(text.cast("string"), F.lit("")))
        if self.fold:
            plain = F.regexp_replace(F.translate(body, *_accents()), r"\p{Mn}+", "")
            body = F.when(F.octet_length(body) == F.length(body), body).otherwise(plain)
        return F.filter(F.split(body, self.other), lambda w: w != "")


#: Words of ASCII letters and digits; words of any script without marks; the same with marks and ``_``.
ASCII, UNICODE, SYMBOL = Analyzer("[^a-z0-9]+"), Analyzer(r"[^\p{L}\p{N}\p{Co}]+", fold=True), Analyzer(r"[^\p{L}\p{N}_]+")


@dataclass(frozen=True)
class Index:
    """A written index; ``folder`` is all that it needs to be read again."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def build(chunks: DataFrame, id_col: str, fields: Sequence[str], analyzer: Analyzer, folder: str | None = None) -> Index:
    """Write an index of the ``fields`` of ``chunks`` and return it. Null fields
    have no words; a chunk of none counts in the means; ids should differ."""
    spark = chunks.sparkSession
    folder = folder or f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    split = chunks.select(F.col(id_col).alias("id"), F.array(*[analyzer.words(F.col(c)) for c in fields]).alias("words"))
    packed = split.mapInArrow(_packer(len(fields), BLOCK, PACKED), f"term string, block long, tf int, len int, ids array<{split.schema['id'].dataType.simpleString()}>, lens array<int>, tfs array<int>, fields array<tinyint>, places array<int>")
    packed.sortWithinPartitions("term", "block").write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/postings")
    index = Index(spark, folder)
    every = index.table("postings").where("term = ''").select(F.explode("lens").alias("len"))
    every.agg(F.count("len").alias("n"), F.avg("len").alias("avg")).write.parquet(f"{folder}/stats")
    return index


def _packer(n_fields: int, size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``postings`` from chunks (id, words of each field), some ``most`` words at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                ids, words = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
                yield from _packed(ids, words, n_fields, size, block)

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1).flatten()).to_numpy(zero_copy_only=False).reshape(-1, n_fields).sum(1, dtype=np.int64))
            at = 0
            while at < len(ends):  # up to where the words held are enough, one chunk at least
                before = ends[at - 1] if at else 0
                to = min(len(ends), max(at, int(np.searchsorted(ends, before + most - n))) + 1)
                held.append(batch.slice(at, to - at))
                n, at = n + ends[to - 1] - before, to
                if n >= most:
                    yield from done()
                    block, held, n = block + -(-sum(map(len, held)) // size), [], 0
        yield from done()

    return pack


def _packed(ids: pa.Array, words: pa.Array, n_fields: int, size: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``size`` chunks, numbered from ``block`` on: the row of the empty
    word of each, and the rows of their words."""
    sizes = pc.list_value_length(words.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, lens, n = words.flatten().flatten(), sizes.reshape(-1, n_fields).sum(1), len(ids)
    by_len = np.argsort(lens, kind="stable")
    ids, lens = ids.take(pa.array(by_len)), lens[by_len]
    rank = np.empty(n, np.int64)
    rank[by_len] = np.arange(n)

    def rows(terms: pa.Array, blocks: np.ndarray, first: np.ndarray, chunk: np.ndarray, tf: np.ndarray, field: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """``first``: where the chunks of each row begin; ``chunk``, ``tf``: of each chunk in a row."""
        ends, length = np.append(first, len(chunk)), lens[chunk]
        spent = np.append(0, np.cumsum(tf))[ends]
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        ints = lambda x: pa.array(x, pa.int32())
        columns = [terms, pa.array(block + blocks), ints(np.maximum.reduceat(tf, first)), ints(np.minimum.reduceat(length, first)), lists(ends, ids.take(pa.array(chunk))), lists(ends, ints(length)), lists(ends, ints(tf)), lists(spent, pa.array(field, pa.int8())), lists(spent, ints(place))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "tf", "len", "ids", "lens", "tfs", "fields", "places"])

    first, none = np.arange(0, n, size), np.zeros(0, np.int64)
    yield rows(pa.array([""] * len(first)), first // size, first, np.arange(n), np.zeros(n, np.int64), none, none)
    if not len(flat):
        return
    known = flat.dictionary_encode()
    in_order = pc.sort_indices(known.dictionary).to_numpy()
    number = np.empty(len(in_order), np.int64)
    number[in_order] = np.arange(len(in_order))
    key = number[known.indices.to_numpy()] * n + np.repeat(np.repeat(rank, n_fields), sizes)
    order = np.argsort(key, kind="stable")
    field = np.repeat(np.tile(np.arange(n_fields), n), sizes)[order]
    place = (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    term, chunk = np.divmod(key[starts], n)
    blocks = chunk // size
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])))
    yield rows(known.dictionary.take(pa.array(in_order[term[first]])), blocks[first], first, chunk, np.diff(np.append(starts, len(key))), field, place)


_BUILT: dict[tuple, Index] = {}


def index_of(name: str, over: DataFrame, chunks: DataFrame, id_col: str, fields: Sequence[str], analyzer: Analyzer) -> Index:
    """The index ``name`` of ``chunks``, which are made of the rows of ``over``;
    built once a session for the same files of ``over`` in the same state."""
    files = over.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("file_path"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    key = (over.sparkSession.sparkContext.applicationId, name, *state)
    if key not in _BUILT:
        _BUILT[key] = build(chunks, id_col, fields, analyzer)
    return _BUILT[key]


#: Words in a row, of which the last need only begin a word.
Phrase = tuple[str, ...]


def phrases(tokens: Sequence[str], word: str) -> list[Phrase]:
    """Tokens as phrases of their words: a token that the index splits stands for words in a row."""
    return [p for p in dict.fromkeys(tuple(re.findall(word, t)) for t in tokens) if p]


def _fits(phrase: Phrase, j: int) -> Column:
    return F.col("term").startswith(phrase[j]) if j == len(phrase) - 1 else F.col("term") == phrase[j]


def _matches(rows: DataFrame, wanted: list[tuple[int, int, Column]], *columns: str) -> DataFrame:
    """``rows`` whose term fits, with the phrase and the place in it (i, j) that it fits, once for each."""
    some = reduce(lambda a, b: a | b, [fits for _, _, fits in wanted])
    at = F.array(*[F.when(fits, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j, fits in wanted])
    return rows.where(some).select(*columns, F.explode(F.filter(at, lambda x: x.isNotNull())).alias("at")).select(*columns, "at.i", "at.j")


def occurrences(rows: DataFrame, wanted: list[Phrase]) -> DataFrame:
    """(block, id, len, tf0, tf1, ...): how often each phrase stands in each chunk that has any."""
    single = [(i, 0, _fits(p, 0)) for i, p in enumerate(wanted) if len(p) == 1]
    long = [(i, j, _fits(p, j)) for i, p in enumerate(wanted) if len(p) > 1 for j in range(len(p))]
    parts = []
    if single:
        each = _matches(rows, single, "block", "ids", "lens", "tfs").select("block", "i", F.explode(F.arrays_zip("ids", "lens", "tfs")).alias("c"))
        parts.append(each.select("block", F.col("c.ids").alias("id"), F.col("c.lens").alias("len"), "i", F.col("c.tfs").alias("n")))
    if long:  # the words of a phrase stand at the same start, less their places in it
        size = reduce(lambda e, x: e.when(F.col("i") == x[0], len(x[1])), enumerate(wanted), F.when(F.lit(False), 0))
        owner = F.flatten(F.transform(F.arrays_zip("ids", "lens", "tfs"), lambda c: F.array_repeat(F.struct(c["ids"].alias("id"), c["lens"].alias("len")), c["tfs"])))
        each = _matches(rows, long, "block", "ids", "lens", "tfs", "fields", "places")
        each = each.select("block", "i", "j", F.explode(F.arrays_zip(owner.alias("c"), F.col("fields").alias("field"), F.col("places").alias("place"))).alias("o"))
        each = each.select("block", "o.c.id", "o.c.len", "i", "o.field", (F.col("o.place") - F.col("j")).alias("start"))
        parts.append(each.groupBy("block", "id", "len", "i", "field", "start").agg(F.count("start").alias("n")).where(F.col("n") == size).select("block", "id", "len", "i", F.lit(1).alias("n")))
    found = reduce(DataFrame.union, parts)
    return found.groupBy("block", "id", "len").agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"tf{i}") for i in range(len(wanted))])


def _saturated(idf: float, tf: Column, length: Column, avg: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def inverse_frequency(n: int, df: int) -> float:
    """The weight of a phrase in ``df`` of ``n`` chunks; never below a millionth."""
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def smoothed_frequency(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


Weight = Callable[[int, int], float]


def scored(index: Index, wanted: list[Phrase], weight: Weight = inverse_frequency, every: bool = False) -> DataFrame:
    """(id, block, score) of all chunks that have any (``every``: each) of the phrases."""
    return _scored(index, wanted, *_weights(index, wanted, weight), every)


def _weights(index: Index, wanted: list[Phrase], weight: Weight) -> tuple[list[float], float]:
    stats = index.table("stats").first()
    found = occurrences(index.table("postings"), wanted)
    df = found.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(wanted))]).first()
    return [weight(stats["n"], x) for x in df], stats["avg"] or 1.0


def _scored(index: Index, wanted: list[Phrase], weights: list[float], avg: float, every: bool, blocks: Column | None = None, joined: DataFrame | None = None) -> DataFrame:
    rows = index.table("postings")
    rows = rows if blocks is None else rows.where(blocks)
    rows = rows if joined is None else rows.join(joined.select("block"), "block", "left_semi")
    found = occurrences(rows, wanted)
    if every:
        found = found.where(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(wanted))]))
    score = reduce(lambda a, b: a + b, [_saturated(w, F.col(f"tf{i}"), F.col("len"), avg) for i, w in enumerate(weights)])
    return found.select("id", "block", score.alias("score"))


def _bounds(index: Index, wanted: list[Phrase], weights: list[float], avg: float, every: bool) -> DataFrame:
    """(block, bound): no chunk of the block scores more."""
    words = [(i, j, _fits(p, j)) for i, p in enumerate(wanted) for j in range(len(p))]
    each = _matches(index.table("postings"), words, "block", "tf", "len").groupBy("block", "i", "j").agg(F.sum("tf").alias("tf"), F.min("len").alias("len"))
    size = reduce(lambda e, x: e.when(F.col("i") == x[0], len(x[1])), enumerate(wanted), F.when(F.lit(False), 0))
    idf = reduce(lambda e, x: e.when(F.col("i") == x[0], x[1]), enumerate(weights), F.when(F.lit(False), 0.0))
    whole = each.groupBy("block", "i").agg(F.count("j").alias("n"), F.min("tf").alias("tf"), F.min("len").alias("len")).where(F.col("n") == size)
    blocks = whole.groupBy("block").agg(F.sum(_saturated(1.0, F.col("tf"), F.col("len"), avg) * idf).alias("bound"), F.count("i").alias("n"))
    return (blocks.where(F.col("n") == len(wanted)) if every else blocks).select("block", "bound")


def search(index: Index, wanted: list[Phrase], k: int, weight: Weight = inverse_frequency, every: bool = False) -> DataFrame:
    """The ``k`` chunks of the best scores (id, score); ties to the smaller id.

    Frequencies count over the whole index. A score is that of BM25 over all
    fields together, a phrase counting as a word. Nothing is found for no phrase.
    """
    if not wanted:
        return index.table("postings").select(F.explode("ids").alias("id"), F.lit(0.0).alias("score")).limit(0)
    best = [F.desc("score"), F.asc("id")]
    known = (*_weights(index, wanted, weight), every)
    bounds = cut(_bounds(index, wanted, *known))
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    top = _scored(index, wanted, *known, blocks=F.col("block").isin(first)).orderBy(*best).limit(k).collect()
    reached = top[-1]["score"] if len(top) == k else 0.0
    able = bounds.where(F.col("bound") >= reached * (1 - 1e-9))
    named = [r["block"] for r in able.select("block").limit(NAMED + 1).collect()]
    which = {"blocks": F.col("block").isin(named)} if len(named) <= NAMED else {"joined": able}
    return _scored(index, wanted, *known, **which).orderBy(*best).limit(k).select("id", "score")
