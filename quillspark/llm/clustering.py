"""Centroid clustering over partition-local ball trees.

Every task packs the vectors it reads into trees of at most ``TREE`` vectors.
A node of a tree is a ball: the floored mean of its vectors, the radius around
it, their number and their integer sum. A round sends only the centroids to
the trees. By the triangle inequality a centroid is out of the question for a
whole ball if it is farther from the middle than the nearest one by more than
two radii; once one is left, the ball's number and sum go to it as a whole.
Balls that stay undecided are descended to leaves, whose vectors are compared
exactly. What a task returns is one row for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Vectors of a tree, and of a leaf.
TREE, LEAF = 4096, 32
LEVELS = 256
#: Distances are computed in floating point only where it is exact. Components
#: of at most MOST keep squared distances of 64 dimensions inside a long.
EXACT, MOST, LONG = 1 << 52, 1 << 27, (1 << 63) - 1


@dataclass
class BallTree:
    """Nodes in the order of their making, parents first. Each holds the
    vectors from ``begin`` to ``end``; ``child`` is the first of its two
    children, which stand side by side, or -1 for a leaf."""

    vectors: np.ndarray
    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(vectors))
        nodes = [(0, len(vectors))]
        child, middle, radius, total = [], [], [], []
        for a, b in nodes:  # grows while it is walked
            mine = vectors[order[a:b]]
            total.append(mine.sum(0))
            middle.append(total[-1] // max(1, b - a))
            off = squared(mine, middle[-1][None])[:, 0]
            radius.append(float(np.sqrt(off.max(initial=0))))
            if b - a <= leaf or radius[-1] == 0:
                child.append(-1)
                continue
            pole = mine[int(off.argmax())]
            other = mine[int(squared(mine, pole[None])[:, 0].argmax())]
            side = squared(mine, np.stack([pole, other]))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argsort(side[:, 0] - side[:, 1], kind="stable")]
            child.append(len(nodes))
            nodes += [(a, a + half), (a + half, b)]
        begin, end = np.array(nodes, np.int64).reshape(-1, 2).T
        return BallTree(vectors[order], ids[order], begin, end, np.array(child), np.array(middle), np.array(radius), np.array(total))

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (ties: the first) of each whole ball that has
        one, else -1, and of each vector of the leaves that have none, else -1."""
        ball = np.full(len(self.begin), -1)
        each = np.full(len(self.vectors), -1)
        far = np.sqrt(squared(self.middle, centroids).astype(np.float64))
        # A little more than rounding can change.
        slack = 1e-9 * (1 + far.max(initial=0))
        todo, able = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(todo):
            d = np.where(able, far[todo], np.inf)
            able = d <= (d.min(1) + 2 * self.radius[todo] + slack)[:, None]
            one = able.sum(1) == 1
            ball[todo[one]] = able[one].argmax(1)
            todo, able = todo[~one], able[~one]
            leaf = self.child[todo] < 0
            for i, among in zip(todo[leaf].tolist(), able[leaf]):
                a, b = self.begin[i], self.end[i]
                left = np.flatnonzero(among)
                each[a:b] = left[squared(self.vectors[a:b], centroids[left]).argmin(1)]
            down = self.child[todo[~leaf]]
            todo, able = np.concatenate([down, down + 1]), np.tile(able[~leaf], (2, 1))
        return ball, each

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and integer sums of the vectors nearest to each centroid."""
        ball, each = self.assigned(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, single = np.flatnonzero(ball >= 0), np.flatnonzero(each >= 0)
        np.add.at(n, ball[whole], (self.end - self.begin)[whole])
        np.add.at(total, ball[whole], self.total[whole])
        np.add.at(n, each[single], 1)
        np.add.at(total, each[single], self.vectors[single])
        return n, total

    def clusters(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector."""
        ball, each = self.assigned(centroids)
        for i in np.flatnonzero(ball >= 0).tolist():
            each[self.begin[i] : self.end[i]] = ball[i]
        return each, ((self.vectors - centroids[each]) ** 2).sum(1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b`` (integers)."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * most * most * max(1, a.shape[1]) < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


_TREES = "n int, vectors binary, ids binary, begin binary, end binary, child binary, middle binary, radius binary, total binary"


def _packed(tree: BallTree, known: np.ndarray) -> pa.RecordBatch:
    made = {"n": len(tree.ids), "vectors": tree.vectors, "ids": np.stack([tree.ids, known], 1), "begin": tree.begin, "end": tree.end, "child": tree.child, "middle": tree.middle, "radius": tree.radius, "total": tree.total}
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32()) if k == "n" else pa.array([v.tobytes()], pa.binary()) for k, v in made.items()})


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[BallTree, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            ints = lambda name: np.frombuffer(r[name], np.int64)  # noqa: E731, B023
            ids = ints("ids").reshape(-1, 2)
            yield BallTree(ints("vectors").reshape(-1, dims), ids[:, 0], ints("begin"), ints("end"), ints("child"), ints("middle").reshape(-1, dims), np.frombuffer(r["radius"], np.float64), ints("total").reshape(-1, dims)), ids[:, 1]


def forest(vectors: DataFrame, dims: int) -> DataFrame:
    """The trees of ``vectors`` (id, v: ``dims`` integers), made where they are read."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def tree() -> pa.RecordBatch:
            v, ids, known = (np.concatenate(x) for x in zip(*waiting))
            # The places in the tree's order stand for the ids until it is built.
            t = BallTree.build(v, np.arange(len(v)))
            at, t.ids = t.ids, ids[t.ids]
            return _packed(t, known[at])

        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(v), TREE):
                part = v[a : a + TREE]
                if n + len(part) > TREE:
                    yield tree()
                    waiting, n = [], 0
                waiting.append((part, ids[a : a + TREE], known[a : a + TREE]))
                n += len(part)
        if waiting:
            yield tree()

    return cut(vectors.select("id", "v").mapInArrow(built, _TREES), "ball-trees")


def recentred(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floored means of what is nearest to each centroid; empty ones stay."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for tree, _ in _trees(batches, dims):
            more, sums = tree.sums(centroids)
            n, total = n + more, total + sums
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    found = trees.mapInArrow(partial, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(dims)]
    out = centroids.copy()
    for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # k rows
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector's id, cluster, squared distance to its centroid, the sums of
    these over the cluster and over all (cluster_inertia, inertia), and the
    SHA-256 of the centroid's components in decimal, joined by commas.

    Vectors are taken as the integers floor(256 * x). Those that are null, have
    not ``dims`` components, or hold null or non-finite ones take no part and
    have no row. The ``k`` vectors of smallest SHA-256 of ``seed:id`` are the
    first centroids, in this order (repeated ids: by their components; a null
    id comes last); with fewer vectors there are fewer centroids. Of equally
    near centroids the first has the vector, so of equal centroids the later
    are empty and stay as they are. Repeated rows count as often as they
    stand there. Integers beyond MOST (x beyond half a million) count as MOST, so
    that squared distances of 64 components fit a long; sums beyond a long are
    its largest value.
    """
    spark, x = df.sparkSession, F.col(f"`{vector_col}`")
    fine = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    vectors = df.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.lit(float(LEVELS)) * c.cast("double")))).cast("long")).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.withColumn("h", digest).orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    if not first:
        schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    trees = forest(vectors, dims)
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = recentred(trees, centroids)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, known in _trees(batches, dims):
            cluster, distance = tree.clusters(centroids)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, mask=known == 0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    found = cut(trees.mapInArrow(labelled, "id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    rows = [(c, min(int(d), LONG), min(int(sum(sums.values())), LONG), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
