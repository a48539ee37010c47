"""Line deduplication over levelled sorted runs of line hashes.

Documents are taken in batches of descending doc_id, so that whatever a run
holds of a line stands behind the lines of the batches to come. A run has one
row for each line hash: the number of documents that hold the line, and the
largest of their ids. Its rows are dealt to buckets by hash and sorted in them.

A batch's own rows are made first, one for each hash however often the line
occurs. They are anti-joined with the settled rows of all runs, those of
enough documents: such a line is lost in any case and needs no further count.
What is left becomes a run of level 0. Two runs of a level are compacted into
one of the next, so a hash is rewritten as often as there are levels and a
batch meets few runs. As all runs share their buckets and are sorted, neither
the anti-joins nor the compactions shuffle a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, cut

#: Batches of documents.
BATCHES = 4
BLANK = " \t\n\x0b\x0c\r"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]
_NO_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased; for ASCII that is the much faster ``lower``."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, SMALL))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")


def _version() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("version")


def hashed_lines(docs: DataFrame, length: int) -> DataFrame:
    """doc, version, h1, h2 (128 bits of the key), line, and whether the line is
    the first of its key in the document (lead), of all lines with keys of at
    least ``length`` code points."""
    keys = F.transform(lines_of(F.col("text")), key_of)
    each = F.transform(keys, lambda k, i: F.when(F.length(k) >= length, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("line"))))
    rows = docs.select(_id(), _version(), F.sort_array(F.filter(each, lambda x: x.isNotNull())).alias("s"))
    before = F.concat(F.array(F.lit(None).cast("struct<h1:bigint,h2:bigint,line:int>")), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))))
    fresh = lambda x, y: ~(x["h1"].eqNullSafe(y["h1"]) & x["h2"].eqNullSafe(y["h2"]))
    rows = rows.select("doc", "version", F.explode(F.zip_with("s", before, lambda x, y: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["line"].alias("line"), fresh(x, y).alias("lead")))).alias("x"))
    return rows.select("doc", "version", "x.*")


class LineRuns:
    """Levels of sorted runs (h1, h2, n, last): one at most stays on each level."""

    def __init__(self, spark: SparkSession, scratch: Scratch, settled: int) -> None:
        self.spark, self.scratch, self.settled = spark, scratch, settled
        self.levels: dict[int, str] = {}

    def add(self, lines: DataFrame) -> None:
        """A batch of lines (h1, h2, doc, lead), none with a greater doc than those before."""
        own = lines.where("lead").groupBy(*HASH).agg(F.count("doc").alias("n"), F.max("doc").alias("last"))
        for run in self.levels.values():
            own = own.join(self.spark.table(run).where(F.col("n") >= self.settled), HASH, "left_anti")
        self._put(self.scratch.sorted_run(own, HASH), 0)

    def _put(self, run: str, level: int) -> None:
        if level in self.levels:
            self._put(self._compacted(self.levels.pop(level), run), level + 1)
        else:
            self.levels[level] = run

    def _compacted(self, one: str, other: str) -> str:
        a, b = (self.spark.table(t).select(*HASH, F.col("n").alias(f"n_{k}"), F.col("last").alias(f"last_{k}")) for k, t in enumerate((one, other)))
        n = F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))
        both = a.join(b.hint("merge"), HASH, "full").select(*HASH, n.alias("n"), F.greatest("last_0", "last_1").alias("last"))
        run = self.scratch.sorted_run(both, HASH)
        self.scratch.drop(one)
        self.scratch.drop(other)
        return run

    def repeated(self) -> DataFrame:
        """(h1, h2, last) of the lines of enough documents, after a last compaction of all levels."""
        runs = [self.levels.pop(k) for k in sorted(self.levels)]
        self.levels[0] = reduce(self._compacted, runs)
        return self.spark.table(self.levels[0]).where(F.col("n") >= self.settled).select(*HASH, "last")


def lost_lines(docs: DataFrame, length: int, documents: int, batches: int = BATCHES) -> DataFrame:
    """(doc, version, lost): the sorted numbers of the lines that each document loses."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line_runs")
    try:
        ends = docs.select(_id()).agg(F.percentile_approx("doc", F.lit([k / batches for k in range(1, batches)]), 10_000)).first()[0] or []
        batch = reduce(lambda a, b: a + b, [(F.col("doc") < e).cast("int") for e in sorted(set(ends))], F.lit(0))
        lines = scratch.parts(hashed_lines(docs, length).withColumn("batch", batch), "batch")
        runs = LineRuns(spark, scratch, documents)
        for b in range(len(set(ends)) + 1):
            runs.add(lines.where(F.col("batch") == b))
        # Rows of a very common line can be split here: both sides are shuffled by adaptive execution.
        repeated = cut(runs.repeated(), "line-repeats")
        lost = lines.join(repeated.hint("merge"), HASH).where("doc < last").groupBy("doc", "version").agg(F.sort_array(F.collect_set("line")).alias("lost"))
        return cut(lost, "lost-lines")
    finally:
        scratch.close()


def deduplicated(docs: DataFrame, length: int = 20, documents: int = 3, batches: int = BATCHES) -> DataFrame:
    """n_lines, n_dropped, kept_sha256 and the kept text of each document (doc_id, text).

    A line's key is the line without spaces and tabs, CR, VT and FF at its
    ends and with A-Z lower-cased. Keys of at least ``length`` code points that
    ``documents`` documents hold lose all their lines but those in the largest
    doc_id that holds it. A null or empty text is one empty line. Each row is
    a document: a repeated row counts again, and rows that share the largest
    doc_id all keep the line. A null doc_id is the smallest. A document keeps
    the empty text if it loses all lines; other columns play no part.
    """
    lost = lost_lines(docs.select("doc_id", "text"), length, documents, batches)
    df = docs.select("doc_id", _id(), _version(), lines_of(F.col("text")).alias("lines")).join(lost.hint("merge"), ["doc", "version"], "left")
    # What is kept are the slices between the lost lines.
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("lost", F.array().cast("array<int>")), F.array(F.size("lines")))
    gaps = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("many")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["at"], g["many"])))
    df = df.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"), "kept")
