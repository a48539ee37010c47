"""Near-duplicate groups of units of text: candidates from shared keys, exact
overlaps by blocked sparse products, and components.

A unit is a set of word shingles: of a whole document or of one paragraph.
Units of equal sets are one node. Nodes that share a key are candidates; the
components of the candidate graph, cut into blocks where they are large, are
the blocks of the product. No step makes a row for each pair: a block returns
one row for each of its nodes, with a forest of the links it found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit
from .storage import cut, spent
from .substrings import among, met_twice, without_spans

#: Most nodes of one side of a block, and shingles if these are of several nodes.
BLOCK, SHINGLES = 512, 1 << 20
_NO_ID = -(1 << 63)

def signature(x: np.ndarray) -> int:
    """Of a set of shingles: 63 bits, so below 10^9 different sets less than one false meeting is expected."""
    h = textkit.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(x))
    return int(textkit.mix(np.array([h], np.uint64))[0] >> np.uint64(1))


@dataclass(frozen=True)
class Units:
    """What is compared: whole texts, or their lines, as sets of ``words``-word
    shingles (all words as one shingle if they are fewer). Units of under
    ``least`` words have no near copies. Neighbouring lines of so few words
    are a unit more, a run, if they have ``least`` words together; a line
    without words ends a run."""

    words: int
    least: int = 1
    lines: bool = False

    def split(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``split_words`` returns, without the starts of words."""
        h, _, *rest = self.split_words(raw, edges)
        return h, *rest

    def split_words(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word hashes of all texts and where each starts, each unit's first word and the word after
        its last, the n + 1 offsets of each text's units among them, and each
        unit's first line in its text and number of lines."""
        h, starts, at = textkit.words_of(raw, edges, textkit.BLANKS)
        if not self.lines:
            return h, starts, at[:-1], at[1:], np.arange(len(edges)), np.zeros(len(at) - 1, np.int64), np.ones(len(at) - 1, np.int64)
        breaks = np.flatnonzero(raw == 0x0A)
        # A text's first unit comes before those behind its line breaks.
        order = np.argsort(np.concatenate([2 * edges[:-1], 2 * breaks + 1]), kind="stable")
        begin = np.concatenate([at[:-1], np.searchsorted(starts, breaks)])[order]
        end, lines = np.append(begin[1:], at[-1]), np.arange(len(edges)) + np.searchsorted(breaks, edges)
        short = (end > begin) & (end - begin < self.least)
        joined = short[1:] & short[:-1]
        joined[lines[1:-1] - 1] = False
        head, tail = np.flatnonzero(short & ~np.append(False, joined)), np.flatnonzero(short & ~np.append(joined, False))
        enough = end[tail] - begin[head] >= self.least
        head, tail = head[enough], tail[enough]
        # A run comes behind its first line.
        order = np.argsort(np.concatenate([2 * np.arange(len(begin)), 2 * head + 1]), kind="stable")
        at = lines + np.searchsorted(head, lines)
        first = np.concatenate([np.arange(len(begin)), head])[order] - np.repeat(lines[:-1], np.diff(at))
        many = np.concatenate([np.ones(len(begin), np.int64), tail - head + 1])[order]
        return h, starts, np.append(begin, begin[head])[order], np.append(end, end[tail])[order], at, first, many

    def set_of(self, h: np.ndarray) -> np.ndarray:
        """Sorted distinct shingles of one unit's words."""
        return np.unique(textkit.grams(h, min(self.words, len(h)))) if len(h) else h


class SizedParts:
    """Keys that two sets of a Jaccard similarity of at least ``ratio`` share.

    Sizes fall into classes such that similar sets are in one class or in
    neighbours; a set has keys for its own class and the next. The size bound
    of a class limits in how many shingles two similar sets of it differ, to
    d; so of d + 1 parts of the hash range one at least is equal in both. Each
    part's content is a key; all are used, however long the set, so the number
    of keys is at most 2 (1 - ratio) / (1 + ratio) times that of shingles in
    each way to part. Parts of under two shingles are no keys, for they would
    join all texts with a rare gap; sets of few parts make up for that with
    several ways to part.
    """

    FEW, SOME = 16, 48

    def __init__(self, ratio: Fraction) -> None:
        self.ratio = ratio
        self.starts = [1]
        self._parts: dict[int, tuple[int, np.ndarray]] = {}

    def _class(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(int(self.starts[-1] / self.ratio) + 1)
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def _bounds(self, c: int) -> tuple[int, np.ndarray]:
        """Number of parts of a class and where its used parts begin in the hash range."""
        if c not in self._parts:
            while len(self.starts) <= c + 1:
                self.starts.append(int(self.starts[-1] / self.ratio) + 1)
            largest = self.starts[c + 1] - 1
            parts = int(2 * largest * (1 - self.ratio) / (1 + self.ratio)) + 1
            at = [-(-(i << 64) // parts) for i in range(parts)]
            self._parts[c] = parts, np.array([*at, (1 << 64) - 1], np.uint64)
        return self._parts[c]

    def describe(self, units: Units, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Size, node and keys of each unit."""
        sizes, nodes, keys = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), []
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
            x = units.set_of(h[a:b])
            sizes[k], nodes[k] = len(x), signature(x)
            keys.append(self.of(x))
        return sizes, nodes, keys

    def node_of(self, h: np.ndarray, x: np.ndarray) -> int:
        return signature(x)

    def of(self, x: np.ndarray) -> np.ndarray:
        c = self._class(len(x))
        out = []
        for k in (c, c + 1):
            parts, bounds = self._bounds(k)
            for way in range(1 if parts == 1 or parts >= self.SOME else 2 if parts >= self.FEW else 8 if parts < 4 else 3):
                y = x if way == 0 else np.sort(textkit.mix(x + np.uint64(way)))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix(y ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
                at = np.searchsorted(y, bounds)
                at[-1] = len(y)
                many = np.diff(at)
                some = np.flatnonzero(many >= (2 if parts >= self.FEW else 1))
                sums = total[at[some + 1]] - total[at[some]]
                out.append(textkit.mix(sums + textkit.mix(np.uint64((k * 16 + way) << 32) + some.astype(np.uint64))))
        return np.unique(np.concatenate(out)).view(np.int64)


def tuned_bands(ratio: float, rows: int, recall: float) -> int:
    """The fewest bands of so many rows that let a pair of similarity ``ratio`` meet with probability ``recall``."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - ratio**rows))))


class MinHashBands:
    """Keys from bands of MinHash values."""

    def __init__(self, ratio: float, rows: int = 3, recall: float = 0.999) -> None:
        self.rows, self.bands = rows, tuned_bands(ratio, rows, recall)
        rng = np.random.default_rng(17)
        self.a = rng.integers(1, 1 << 63, rows * self.bands, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, rows * self.bands, np.uint64)

    def describe(self, units: Units, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Number of words, node (of the sequence of words) and keys of each unit, all units at once."""
        if not len(begin):
            return begin, begin, []
        g = np.append(textkit.grams(h, units.words), np.uint64(0))
        bounds = np.column_stack([begin, end - units.words + 1]).ravel()
        out = np.tile(np.arange(self.bands, dtype=np.uint64), (len(begin), 1))
        for k in range(self.rows * self.bands):
            y = g * self.a[k] + self.b[k]
            y ^= y >> np.uint64(32)
            least = np.minimum.reduceat(y, bounds)[::2]
            out[:, k // self.rows] = textkit.mix(out[:, k // self.rows] * textkit.BASE + least)
        return end - begin, sequences(h, begin, end), list(out.view(np.int64))

    def node_of(self, h: np.ndarray, x: np.ndarray) -> int:
        return int(sequences(h, np.array([0]), np.array([len(h)]))[0])


def sequences(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """63-bit hashes of sequences of words."""
    up, down = textkit.powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    mixed = textkit.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return (mixed >> np.uint64(1)).astype(np.int64)


Keys = SizedParts | MinHashBands


def described(docs: DataFrame, units: Units, keys: Keys) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its doc_id, a hash of its text,
    and of its units the sizes, nodes and keys. A node's keys stand at one of
    its units in each task. Lines also have their place, number and bytes, and
    those of under ``units.least`` words, which are no nodes, a hash of their
    words; then follow the passages of the long lines with theirs."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(F.col("text")).alias("hash"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in textkit.slices(batches, 1):
            raw, edges = textkit.buffers(batch.column(1))
            h, starts, begin, end, at, first, lines = units.split_words(raw, edges)
            some = np.flatnonzero(end - begin >= units.least)
            sizes, nodes = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
            sizes[some], nodes[some], found = keys.describe(units, h, begin[some], end[some])
            fresh = [not (x in seen or seen.add(x)) for x in nodes[some].tolist()]
            many = np.zeros(len(begin), np.int64)
            many[some] = [len(k) if new else 0 for k, new in zip(found, fresh)]
            flat = np.concatenate([np.zeros(0, np.int64), *[k for k, new in zip(found, fresh) if new]])
            empty = np.ones(len(begin), bool)
            empty[some] = False
            outer = pa.array(at.astype(np.int32))
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(flat))
            lists = [pa.ListArray.from_arrays(outer, x) for x in (pa.array(sizes), pa.array(nodes, mask=empty), inner)]
            if units.lines:
                few = sequences(h, begin, end), (end == begin) | ~empty
                line_at, text_line = line_starts(raw, edges)
                text = np.repeat(np.arange(batch.num_rows), np.diff(at))
                a, b = (line_at[text_line[text] + x] - edges[text] for x in (first, first + lines))
                lists += [pa.ListArray.from_arrays(outer, x) for x in (pa.array(first.astype(np.int32)), pa.array(lines.astype(np.int32)), pa.array(a), pa.array(b), pa.array(few[0], mask=few[1]))]
                line = np.flatnonzero(lines == 1)  # runs are no lines
                of, x, y = passages(h, begin[line], end[line])
                of = line[of]
                to = np.where(y < end[of], starts[np.minimum(y, len(starts) - 1)], line_at[text_line[text[of]] + first[of] + 1])
                outer = pa.array(np.searchsorted(text[of], np.arange(batch.num_rows + 1)).astype(np.int32))
                lists += [pa.ListArray.from_arrays(outer, pa.array(v)) for v in (first[of].astype(np.int32), starts[x] - edges[text[of]], to - edges[text[of]], sequences(h, x, y))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=names)

    fields = "doc_id long, hash long, sizes array<int>, nodes array<long>, keys array<array<long>>"
    if units.lines:
        fields += ", first array<int>, lines array<int>, a array<long>, b array<long>, short array<long>, p_line array<int>, p_a array<long>, p_b array<long>, p_words array<long>"
    names = [x.split()[0] for x in fields.split(", ")]
    return cut(df.mapInArrow(made, fields), "units")


def line_starts(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of all texts and of the end, and each text's first line among them."""
    breaks = np.flatnonzero(raw == 0x0A)
    order = np.argsort(np.concatenate([2 * edges[:-1], 2 * breaks + 1]), kind="stable")
    at = np.append(np.concatenate([edges[:-1], breaks + 1])[order], edges[-1])
    return at, np.arange(len(edges)) + np.searchsorted(breaks, edges)


#: Words of a passage that is found inside longer lines wherever it stands in
#: them, and of the sub-paragraphs that find it.
PASSAGE, PART = 50, 25


def passages(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sub-paragraphs of PART words of the lines of over PASSAGE words: the
    line, the first word and the word after the last. Their places follow from
    the words: around the least three-word gram of each PASSAGE - PART + 1 in a row,
    so two lines with PASSAGE words in common have one in common."""
    none = (np.zeros(0, np.int64),) * 3
    many, gram = PASSAGE - PART + 1, 3
    long = np.flatnonzero(end - begin > PASSAGE)
    if not len(long):
        return none
    g = textkit.grams(h, gram)
    bits = np.uint64((1 << len(g).bit_length()) - 1)
    key = (g & ~bits) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= many:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    n = len(g) - many + 1
    if width < many:
        key = np.minimum(key[:n], key[many - width : many - width + n])
    starts = end[long] - begin[long] - (many + gram - 1) + 1
    at = np.repeat(begin[long] - np.cumsum(starts) + starts, starts) + np.arange(starts.sum())
    of = np.repeat(long, starts)
    x = (key[at] & bits).astype(np.int64) - (PART - gram) // 2
    good = (x >= begin[of]) & (x + PART <= end[of])
    x, of = x[good], of[good]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return of[new], x[new], x[new] + PART


def shared_keys(table: DataFrame) -> DataFrame:
    """(node, key), written, of the keys that several nodes have, and of a few others: a
    bitmap of bounded size, made from 32 bits of each key, keeps most keys that
    stand alone from being shuffled. Without it the result is the same."""
    rows = table.select("nodes", "keys")

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(1).flatten()
        nodes = batch.column(0).flatten().fill_null(0).to_numpy(zero_copy_only=False)
        return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(nodes, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                yield flat(batch.slice(k, 1000))

    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    expected = table.agg(F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda n, k: n + F.size(k)))).first()[0] or 0
    several = table.sparkSession.sparkContext.broadcast(met_twice(rows, parts, 2 * partitions, expected))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes in parts(batches):
            some = several.value.has(keys)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(keys[some].view(np.int64))], names=["node", "key"])

    found = cut(rows.mapInArrow(kept, "node long, key long"), "keys")
    several.destroy()
    return found


def stars(keys: DataFrame) -> DataFrame:
    """Edges (a, b) from each node of a key to the key's least node. ``keys``: key, node."""
    shared = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("__last")).where("b < __last").drop("__last")
    return keys.join(shared, "key").where("node > b").select(F.col("node").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a > b): the least node that
    each reaches, by large-star and small-star rounds until all edges lead to
    the centre of a star, which the least neighbours of a round's start tell.
    Every round works on edges alone. Least neighbours are written before they
    are joined, so that adaptive execution can split the edges of a hub."""
    now = cut(edges.select("a", "b"), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        below = F.when(F.col("b") < F.col("a"), F.col("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.min(below).alias("x"), F.max(below).alias("y"))
        # No star: a node with two lesser neighbours, or with a lesser and a greater one.
        least = cut(least.select("a", F.least("a", "m").alias("m"), (F.col("x").isNotNull() & ((F.col("x") < F.col("y")) | (F.col("most") > F.col("a")))).alias("open")), "roots")
        if not least.agg(F.max("open")).first()[0]:
            spent(now)
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = cut(both.where("b > a").join(least.drop("open"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        last = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(last, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, cut(small.union(last.select("a", F.col("m").alias("b"))).distinct(), "edges")
        spent(old, least, large, last)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: the product of the incidence
    matrix with its transpose, over the shingles that occur twice or more;
    the rare ones pair by pair, the frequent ones as dense columns."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    doc = np.repeat(np.arange(m), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, doc = values[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    many = np.diff(np.append(first, len(values)))
    column = np.repeat(np.arange(len(first)), many)
    few = max(2, m // 8)
    rare = (many[column] > 1) & (many[column] <= few)
    d, c = doc[rare], column[rare]
    for step in range(1, few):
        same = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else []
        if not len(same):
            break
        out += np.bincount(d[same] * m + d[same + step], minlength=m * m).reshape(m, m)
    out += out.T
    often = np.flatnonzero(many > few)
    place = np.full(len(first), -1)
    place[often] = np.arange(len(often))
    d, c = doc[place[column] >= 0], place[column][place[column] >= 0]
    for a in range(0, len(often), 8192):
        here = (c >= a) & (c < a + 8192)
        dense = np.zeros((m, min(8192, len(often) - a)), np.float32)
        dense[d[here], c[here] - a] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def _forest(link: np.ndarray) -> np.ndarray:
    """The least index that each index reaches."""
    at = np.arange(len(link))
    while True:
        to = np.minimum(at, np.where(link, at[None, :], len(link)).min(1, initial=len(link)))
        to = to[to]
        if (to == at).all():
            return at
        at = to


def _linked(part: pd.DataFrame, ratio: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Roots and numbers of linked units of a block's nodes."""
    sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
    n = np.array([len(x) for x in sets])
    shared = overlaps(sets)
    link = ratio.denominator * shared >= ratio.numerator * (n[:, None] + n[None, :] - shared)
    np.fill_diagonal(link, False)
    side = part["side"].to_numpy()
    if (side > 0).any():  # two blocks: only what goes from one to the other is new
        link &= side[:, None] != side[None, :]
    return _forest(link), link @ part["copies"].to_numpy()


def links(nodes: DataFrame, ratio: Fraction) -> DataFrame:
    """(node, root, links) of each block of ``nodes`` (node, component, copies, size, shingles).

    Components of up to BLOCK nodes and SHINGLES shingles share blocks. Larger
    ones are dealt by size band, as similar sets are in the same band or
    neighbours, and by hash inside a band; each pair of such blocks that can
    hold links is a block. So a task holds a bounded number of shingles unless
    single sets are larger.
    """
    nodes = nodes.withColumn("band", F.floor(F.log("size") / -np.log(float(ratio)) + 1e-9).cast("int"))
    sizes = nodes.groupBy("component", "band").agg(F.count("band").alias("many"), F.sum(F.col("size").cast("long")).alias("mass"))
    total, mass = (F.sum(c).over(W.partitionBy("component")) for c in ("many", "mass"))
    per = W.partitionBy("component").orderBy("band")
    near = lambda f, d: F.when(f("band").over(per) == F.col("band") + d, f("parts").over(per)).otherwise(0)
    parts = F.ceil(F.greatest(F.col("many") / BLOCK, F.least(F.col("mass") / SHINGLES, F.col("many")))).cast("int")
    sizes = sizes.withColumn("small", (total <= BLOCK) & (mass <= SHINGLES)).withColumn("parts", parts)
    sizes = cut(sizes.withColumn("after", near(F.lead, 1)).withColumn("before", near(F.lag, -1)), "block-sizes")
    few, light = sizes.where("small").agg(F.sum("many"), F.sum("mass")).first()
    packs = max(1, -(-int(few or 0) // BLOCK), -(-int(light or 0) // SHINGLES))
    # A merge join at every size, so that one plan's figures hold for all.
    df = nodes.join(sizes.select("component", "band", "small", "parts", "before", "after").hint("merge"), ["component", "band"])
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda i, j, k, l, side: F.struct(F.concat_ws("/", F.col("component"), i, j, k, l).alias("cell"), side.alias("side"))
    band, me = F.col("band"), F.col("mine")
    within = F.transform(upto(F.col("parts")), lambda x: cell(band, F.least(me, x), band, F.greatest(me, x), F.when(me <= x, 0).otherwise(1)))
    above = F.transform(upto(F.col("after")), lambda x: cell(band, me, band + 1, x, F.lit(0)))
    below = F.transform(upto(F.col("before")), lambda x: cell(band - 1, x, band, me, F.lit(1)))
    packed = F.array(F.struct(F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), F.lit(packs))).alias("cell"), F.lit(0).alias("side")))
    df = df.withColumn("mine", mine).withColumn("at", F.explode(F.when(F.col("small"), packed).otherwise(F.concat(within, above, below))))
    df = df.select("at.cell", "at.side", "node", "component", "copies", "shingles")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.drop_duplicates(["node", "side"]).groupby("component", sort=False):
            root, count = _linked(part, ratio)
            node = part["node"].to_numpy()
            out.append(pd.DataFrame({"node": node, "root": node[root], "links": count}))
        return pd.concat(out)

    return df.groupBy("cell").applyInPandas(block, "node long, root long, links long")


def near_duplicates(docs: DataFrame, units: Units, keys: Keys, ratio: Fraction) -> tuple[DataFrame, DataFrame]:
    """The units of ``docs``, and for each node with links or copies: node, component,
    links (number of other units of a similarity of at least ``ratio``), and
    the first unit (doc_id, position) of its component."""
    table = described(docs, units, keys)
    each = table.select("doc_id", "hash", F.posexplode(F.arrays_zip("sizes", "nodes")).alias("place", "unit"))
    each = each.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "place", "hash", F.col("unit.nodes").alias("node")).where("node is not null")
    classes = cut(each.groupBy("node").agg(F.min(F.struct("doc_id", "place", "hash")).alias("first"), F.min(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))).alias("least"), F.count("node").alias("copies")), "classes")
    shared = shared_keys(table)
    candidates = components(stars(shared))
    whole, table = table, cut(table.drop("keys"), "units")
    spent(whole, shared)
    wanted = candidates.join(classes, "node").select(F.col("first.doc_id").alias("doc"), F.col("first.hash").alias("version"), F.struct(F.col("first.place").alias("place"), "node", "component", "copies").alias("w"))
    wanted = cut(wanted.groupBy("doc", "version").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), text_hash(F.col("text")).alias("version"), F.col("text").cast("string").alias("text"))
    # Only texts that candidates come from are shuffled.
    texts = texts.where(among(wanted)).join(wanted.hint("merge"), ["doc", "version"]).select("text", "wanted")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, 0):
            rows = []
            h, begin, end, at, _, _ = units.split(*textkit.buffers(batch.column(0)))
            for k, want in enumerate(batch.column(1).to_pylist()):
                for w in want:
                    if at[k] + w["place"] < at[k + 1]:
                        mine = h[begin[at[k] + w["place"]] : end[at[k] + w["place"]]]
                        x = units.set_of(mine)
                        if len(mine) >= units.least and keys.node_of(mine, x) == w["node"]:  # else another row of this doc_id
                            rows.append((w["node"], w["component"], w["copies"], len(x), x.tobytes()))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["node", "component", "copies", "size", "shingles"])

    found = texts.mapInArrow(shingles, "node long, component long, copies long, size int, shingles binary")
    sets = cut(found, "shingles")
    forest = cut(links(sets, ratio), "links")
    spent(sets, wanted)
    joined = components(forest.where("node <> root").select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")))
    counts = forest.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(joined, "node", "left").join(counts, "node", "left")
    known = known.select("node", "first", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = known.where("links > 0")
    known = cut(known, "known")
    first = cut(known.groupBy("component").agg(F.min("first").alias("group_first"), F.min("least").alias("group_least")), "firsts")
    groups = cut(known.join(first, "component").select("node", "component", "links", "group_first", "group_least"), "groups")
    spent(known, first, forest, classes)
    return table, groups


def jaccard_groups(docs: DataFrame, words: int, ratio: Fraction) -> DataFrame:
    """n_shingles, component_id and n_links of each document (doc_id, text).

    A document's set holds its distinct ``words``-word shingles, or all its
    words as one if they are fewer. Documents link when their sets' Jaccard
    similarity is at least ``ratio``; component_id is the least doc_id that
    links reach, n_links the number of documents linked with directly, copies
    included. Null, empty and wordless texts have an empty set and no links.
    Repeated rows are copies of each other. A null doc_id is linked as any
    other, but component_id is null only where all that it reaches are null.
    """
    table, groups = near_duplicates(docs, Units(words), SizedParts(ratio), ratio)
    rows = table.select("doc_id", F.col("sizes")[0].cast("long").alias("n_shingles"), F.col("nodes")[0].alias("node"))
    df = rows.join(groups, "node", "left")
    return df.select("doc_id", "n_shingles", F.coalesce("group_least", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def paragraph_groups(docs: DataFrame, words: int = 5, ratio: Fraction = Fraction(4, 5), least: int = 10) -> DataFrame:
    """Of each document (doc_id, text): how many lines lose something
    (n_removed), the bytes removed, a hash of what is kept, the places of the
    lines removed and of those cut, the documents that hold the kept copies,
    and the number of lines (n_paragraphs).

    Paragraphs are lines. Those of at least ``least`` words, and runs of
    shorter ones that have so many together, meet in bands of MinHash values
    tuned to the similarity ``ratio``; pairs that reach it exactly are linked,
    and of every component the first paragraph (by doc_id and place) stays.
    Of what then is left, a line of fewer words goes if a document of lesser
    doc_id holds the same words as a line, and so does, out of a line of over
    PASSAGE words, each sub-paragraph (see ``passages``) that a document of
    lesser doc_id holds in such a line; inside one document both stay. So of
    PASSAGE words that two documents share some go in any case, but up to
    PASSAGE - PART at either end may stay. Null and empty texts have one empty
    paragraph; of repeated rows of one doc_id and text, none is first, so that
    all keep it. A line goes with its line break.
    """
    table, groups = near_duplicates(docs, Units(words, max(words, least), lines=True), MinHashBands(float(ratio)), ratio)
    me = F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc")
    each = table.select(me, "hash", F.posexplode(F.arrays_zip("nodes", "first", "lines", "a", "b", "short")).alias("place", "unit")).select("doc", "hash", "place", F.col("unit.nodes").alias("node"), "unit.first", "unit.lines", "unit.a", "unit.b", "unit.short")
    same_place = (F.col("doc") == F.col("group_first.doc_id")) & (F.col("place") == F.col("group_first.place"))
    hit = each.where("node is not null").join(groups, "node").where(~same_place)
    hit = cut(hit.select("doc", "hash", F.explode(F.sequence("first", F.col("first") + F.col("lines") - 1)).alias("line"), "a", "b", F.lit(True).alias("whole"), F.col("group_first.doc_id").alias("kept")), "removed")
    short = each.where("short is not null").select("doc", "hash", F.col("first").alias("line"), "a", "b", F.lit(True).alias("whole"), "short")
    inner = table.select(me, "hash", F.explode(F.arrays_zip("p_line", "p_a", "p_b", "p_words")).alias("p")).select("doc", "hash", "p.p_line", "p.p_a", "p.p_b", F.lit(False), "p.p_words")
    exact = short.union(inner)
    first = exact.join(hit.select("doc", "hash", "line").distinct(), ["doc", "hash", "line"], "left_anti")
    first = cut(first.groupBy("short").agg(F.min("doc").alias("kept"), F.max("doc").alias("__last")).where("kept < __last").drop("__last"), "exact")
    again = exact.join(first, "short").where("doc > kept").join(hit.select("doc", "hash", "line").distinct(), ["doc", "hash", "line"], "left_anti")
    lines = lambda whole: F.sort_array(F.collect_set(F.when(F.col("whole") == whole, F.col("line"))))
    lost = hit.union(again.select(*hit.columns)).groupBy("doc", F.col("hash").alias("version")).agg(F.collect_set(F.struct("a", "b")).alias("spans"), lines(True).alias("removed"), lines(False).alias("cut"), F.sort_array(F.collect_set("kept")).alias("kept_in"))
    lost = cut(lost, "lost-lines")
    texts = docs.select(me, F.col("text").cast("string").alias("text"), text_hash(F.col("text")).alias("version"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    kept = without_spans(texts, lost, {"n_paragraphs": F.coalesce(breaks + 1, F.lit(1)).cast("long")})
    ints, longs = F.array().cast("array<int>"), F.array().cast("array<long>")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return kept.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), (count("removed") + count("cut")).cast("long").alias("n_removed"), F.col("n_removed").alias("bytes_removed"), "kept_sha256",
        F.coalesce("removed", ints).alias("removed"), F.coalesce("cut", ints).alias("cut"), F.coalesce("kept_in", longs).alias("kept_in"), "n_paragraphs",
    )


def one_of_each_group(docs: DataFrame, words: int = 5, ratio: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near copies:
    of every group of linked documents one row stays, that of least doc_id.

    Columns stay as they are. Texts without words are in no group and stay;
    repeated rows are copies; a null doc_id comes before all others.
    """
    table, groups = near_duplicates(docs, Units(words), SizedParts(ratio), ratio)
    rows = table.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__id"), F.col("hash").alias("__hash"), F.col("nodes")[0].alias("node"))
    grouped = rows.join(groups.select("node", "component"), "node").select("component", F.struct("__id", "__hash").alias("me"))
    members = cut(grouped.groupBy("component", "me").agg(F.count("me").alias("many")), "members")
    stays = cut(members.groupBy("component").agg(F.min("me").alias("best")), "stays")
    verdict = members.join(stays, "component").select("me.__id", "me.__hash", F.when(F.col("me") != F.col("best"), "drop").when(F.col("many") > 1, "once").alias("__verdict")).where("__verdict is not null")
    df = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("__hash", text_hash(F.col("text")))
    df = df.join(verdict, ["__id", "__hash"], "left")
    once = df.where("__verdict = 'once'").dropDuplicates(["__id", "__hash"])
    return df.where("__verdict is null").union(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text.cast("string"))
