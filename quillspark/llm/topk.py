"""Exact top-k inner products over a bit-sliced index.

The index holds blocks of rows. For every dimension of a block, bit b of all
its rows' quantised values lies together in one bitmap. A query adds the
bitmaps of each dimension, shifted by the bits of its own value, into a
bit-sliced sum; a negative value takes the complements. The best rows are read
off from the most significant bitmap of the sum downward, and ties at the
boundary are resolved by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

BLOCK = 4096
CHUNK = 128
LEVELS = 256
#: Blocks and chunks meet on a grid of at most so many cells a side; a cell is a join key.
GRID = 64

_INDEX = "dim int, n int, ids binary, low long, bits int, slices binary, number long"
_CHUNKS = "dim int, n int, ids binary, q binary, number long"


def quantised(vectors: list[list[float]]) -> np.ndarray:
    return np.floor(np.asarray(vectors, np.float64) * LEVELS).astype(np.int64)


def slice_block(v: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Least value, number of bits, and bitmaps [dimension, bit, word] of a block [row, dimension]."""
    low = int(v.min()) if v.size else 0
    u = (v - low).astype(np.uint64)
    bits = max(1, int(u.max()).bit_length()) if v.size else 1
    words = -(-len(v) // 64)
    padded = np.zeros((words * 64, v.shape[1]), np.uint64)
    padded[: len(v)] = u
    out = np.empty((v.shape[1], bits, words), np.uint64)
    for b in range(bits):
        flags = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        out[:, b] = np.ascontiguousarray(np.packbits(flags, axis=1, bitorder="little")).view(np.uint64)
    return low, bits, out


def sliced_sums(slices: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bitmaps [bit, query, word] of sum(|q| * u), with u complemented where q is negative."""
    dims, bits, words = slices.shape
    size = np.abs(q).astype(np.uint64)
    top = bits + int(size.sum(1).max()).bit_length() if q.size else 1
    acc = np.zeros((top, len(q), words), np.uint64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for d in range(dims):
        turn = np.where(q[:, d] < 0, ones, np.uint64(0))[:, None]
        planes = [slices[d, b][None, :] ^ turn for b in range(bits)]
        for p in range(int(size[:, d].max()).bit_length()):
            on = np.where((size[:, d] >> np.uint64(p)) & np.uint64(1), ones, np.uint64(0))[:, None]
            carry = np.zeros((len(q), words), np.uint64)
            for j in range(p, top):
                a = acc[j]
                if j - p < bits:
                    x = planes[j - p] & on
                    half = a ^ x
                    acc[j], carry = half ^ carry, (a & x) | (carry & half)
                else:
                    acc[j], carry = a ^ carry, a & carry
                    if not carry.any():
                        break
    return acc


def top_rows(acc: np.ndarray, rows: int, k: int) -> list[np.ndarray]:
    """For each query the places of the k rows of largest sums, those before others among equal ones."""
    _, queries, words = acc.shape
    every = np.zeros(words * 64, np.uint8)
    every[:rows] = 1
    tied = np.broadcast_to(np.packbits(every, bitorder="little").view(np.uint64), (queries, words)).copy()
    sure = np.zeros((queries, words), np.uint64)
    for plane in acc[::-1]:
        more = sure | (tied & plane)
        n = np.bitwise_count(more).sum(1)[:, None]
        few = n < k
        sure = np.where(few, more, sure)
        tied = np.where(few, tied & ~plane, tied & plane)
    out = []
    for s, t in zip(sure, tied):
        a = np.flatnonzero(np.unpackbits(s.view(np.uint8), bitorder="little"))
        b = np.flatnonzero(np.unpackbits(t.view(np.uint8), bitorder="little"))
        out.append(np.concatenate([a, b[: max(0, k - len(a))]]))
    return out


def _packed(df: DataFrame, rows: int, index: bool) -> DataFrame:
    """Rows (id, vector) by dimension in blocks of the index, or in chunks of queries."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting: dict[int, list[tuple[int, list[float]]]] = {}
        made = TaskContext.get().partitionId() << 32

        def block(dim: int, part: list[tuple[int, list[float]]]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            part.sort(key=lambda r: r[0])
            ids, v = np.array([r[0] for r in part], np.int64), quantised([r[1] for r in part]).reshape(len(part), dim)
            head = {"dim": [dim], "n": [len(part)], "ids": [ids.tobytes()]}
            if index:
                low, bits, slices = slice_block(v)
                head |= {"low": [low], "bits": [bits], "slices": [slices.tobytes()]}
            else:
                head |= {"q": [v.tobytes()]}
            kinds = {"dim": pa.int32(), "n": pa.int32(), "ids": pa.binary(), "low": pa.int64(), "bits": pa.int32(), "slices": pa.binary(), "q": pa.binary(), "number": pa.int64()}
            return pa.RecordBatch.from_pydict({k: pa.array(x, kinds[k]) for k, x in (head | {"number": [made]}).items()})

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = waiting.setdefault(len(x), [])
                part.append((i, x))
                if len(part) == rows:
                    yield block(len(x), waiting.pop(len(x)))
        for dim, part in waiting.items():
            yield block(dim, part)

    return df.mapInArrow(pack, _INDEX if index else _CHUNKS)


def search(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for each row whose id is divisible by ``every``:
    query_id, rank, vec_id and score (the integer inner product).

    All rows but the query's own are candidates, repeated rows of its id
    included; a repeated query row is a query of its own. Vectors that are
    null, empty, or hold null or non-finite components take no part, nor do
    null ids; vectors of other lengths than the query's are no candidates.
    Ties go to the smaller id; fewer candidates give fewer rows. Scores are
    exact as far as they fit a long.
    """
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))
    index = cut(_packed(rows, BLOCK, True), "topk-index")
    asked = rows.where(F.col("id") % every == 0)
    chunks = cut(_packed(asked.repartition(-(-max(1, asked.count()) // CHUNK)), CHUNK, False), "topk-queries")
    cell = F.pmod(F.xxhash64("number"), F.lit(GRID)).cast("int")
    both = index.withColumn("b", cell).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    used = chunks.select(F.pmod(F.xxhash64("number"), F.lit(GRID)).cast("int").alias("c"), "dim", "number").groupBy("c", "dim").agg(F.count("number").alias("many"))
    both = both.join(F.broadcast(used.select("c", "dim")), ["c", "dim"], "left_semi")
    asked = chunks.withColumn("c", cell).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).select("dim", "b", "c", F.col("n").alias("qn"), F.col("ids").alias("qids"), "q", F.col("number").alias("qnumber"))
    pairs = both.join(asked, ["b", "c", "dim"]).select("dim", "n", "ids", "low", "bits", "slices", "qn", "qids", "q", "qnumber")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(r["dim"], r["bits"], -1)
                q = np.frombuffer(r["q"], np.int64).reshape(r["qn"], r["dim"])
                acc = sliced_sums(slices, q)
                # What the complements and the block's least value add to each sum.
                shift = -np.where(q < 0, -q, 0).sum(1) * ((1 << r["bits"]) - 1) + q.sum(1) * r["low"]
                out: list[tuple[int, int, int, int]] = []
                for i, at in enumerate(top_rows(acc, r["n"], k + 1)):
                    word, bit = at // 64, (at % 64).astype(np.uint64)
                    sums = ((acc[:, i, word] >> bit) & np.uint64(1)).astype(np.int64)
                    values = (sums << np.arange(len(acc))[:, None]).sum(0) + shift[i]
                    own = int((q[i] ** 2).sum())
                    out += [(r["qnumber"] * CHUNK + i, int(qids[i]), int(ids[a]), int(v), int(ids[a] == qids[i] and v == own)) for a, v in zip(at.tolist(), values.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(5)], names=["query", "query_id", "vec_id", "score", "own"])

    found = pairs.mapInArrow(best, "query long, query_id long, vec_id long, score long, own long")
    order = [F.desc("score"), F.asc("vec_id")]
    found = found.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("place") <= k + 1)
    # One of the rows that equal the query is the query itself.
    found = found.withColumn("self", (F.col("own") == 1) & (F.row_number().over(W.partitionBy("query", "own").orderBy("place")) == 1))
    found = found.where(~F.col("self")).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("place"))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
