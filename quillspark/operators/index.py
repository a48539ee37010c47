"""Stages of a knowledge index: what is chunked, hashed, kept and stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

# Most of each kind of fact in a file's summary, and the lines read for marks.
MOST_IMPORTS, MOST_EXPORTS, MOST_CALLS, MOST_LITERALS, HEADER_LINES = 24, 24, 32, 32, 12


def excluded(body: Column, marks: tuple[str, ...]) -> Column:
    """Whether one of the first 12 lines is a mark, in any case."""
    head = F.array_join(F.slice(F.split(body, "\r?\n"), 1, HEADER_LINES), "\n")
    return F.coalesce(head.rlike("(?im)" + "|".join(f"(?:{m})" for m in marks)), F.lit(False))


def producer(path: Column, has_facts: Column) -> Column:
    """Who chunks a file: markdown first, then code with facts, else null."""
    return F.when(path.rlike(r"(?i)\.(md|markdown)$"), "markdown").when(has_facts, "code")


def fact_summary(facts: DataFrame) -> DataFrame:
    """(path, summary) of facts (path, kind, value, ordinal): the first
    different imports, exports, calls and literals of a file, a line for each
    kind. Different values are grouped and ranked first, so no more of a file's facts meet than are shown."""
    kinds = (("import", "imports", MOST_IMPORTS), ("export", "exports", MOST_EXPORTS), ("call", "calls", MOST_CALLS), ("literal", "literals", MOST_LITERALS))
    once = facts.groupBy("path", "kind", "value").agg(F.min("ordinal").alias("at"))
    most = F.coalesce(*[F.when(F.col("kind") == k, n) for k, _, n in kinds])
    first = once.withColumn("place", F.row_number().over(W.partitionBy("path", "kind").orderBy("at", "value"))).where(F.col("place") <= most)
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "value")))), lambda x: x["value"]).alias(name) for k, name, _ in kinds]
    df = first.groupBy("path").agg(*lists)
    line = lambda name: F.when(F.size(name) > 0, F.concat(F.lit(f"{name}: "), F.array_join(name, ", ")))
    return df.select("path", F.concat_ws("\n", *[line(name) for _, name, _ in kinds]).alias("summary")).where("summary <> ''")


def embedding_hash(chunk_hash: Column, provider: str) -> Column:
    """Of a chunk and what embeds it; both must be the same for a vector to be kept."""
    return text.joined_hash(F.lit(provider), chunk_hash)


def build_stats(old: DataFrame, new: DataFrame, id_col: str, content: str) -> DataFrame:
    """One row: chunks added, changed, removed and reused by a build."""
    from .rollups import diff

    change = diff(new, old, id_col, content)
    return change.agg(*[F.count_if(F.col("change") == k).alias(name) for k, name in (("added", "added"), ("changed", "changed"), ("deleted", "removed"), ("unchanged", "reused"))])


def tree_hash(chunks: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """(path, hash): one hash of each file's chunks, in order of their fields.
    A file's is what one task holds; ``rollups.inventory_hash`` makes one of all."""
    row = F.concat_ws("\0", *fields)
    return chunks.groupBy(path).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n").cast("binary"), 256).alias("hash"))


def mode(status: str, forced: bool, has_index: bool) -> str:
    """full if forced, missing or not ready, else delta."""
    return "delta" if has_index and not forced and status == "ready" else "full"


def stale_chunks(chunks: DataFrame, inventory: DataFrame, provider: str) -> DataFrame:
    """Chunks (path, content_hash, provider) with ``stale``: the file is gone
    or another (inventory: path, content_hash), or another provider embedded them."""
    now = inventory.select("path", F.col("content_hash").alias("__now"))
    df = chunks.join(now, "path", "left")
    return df.withColumn("stale", F.coalesce((F.col("__now") != F.col("content_hash")) | (F.col("provider") != provider), F.lit(True))).drop("__now")


def invalid_nodes(paths: DataFrame, path: str) -> DataFrame:
    """(node): the folders above changed paths, and the root."""
    above = paths.select(F.explode(text.ancestors(F.col(path))).alias("node")).distinct()
    return above.union(paths.sparkSession.range(1).select(F.lit(".").alias("node")))


def insert_problems(old: DataFrame, new: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """(id, problem) of a batch of vectors: wrong sizes, and ids that are there
    already or twice in the batch. A batch with any is rejected as a whole."""
    wrong = new.where(F.coalesce(F.size(vector), F.lit(-1)) != size).select(id_col, F.lit("dimension").alias("problem"))
    twice = new.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col, F.lit("duplicate").alias("problem"))
    there = new.select(id_col).join(old.select(id_col).distinct(), id_col, "left_semi").select(id_col, F.lit("exists").alias("problem"))
    return wrong.union(twice).union(there).distinct()


def inserted(old: DataFrame, new: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """``old`` with the batch, or an error if any of its rows is bad."""
    bad = insert_problems(old, new, id_col, vector, size).first()
    if bad:
        raise ValueError(f"{id_col} {bad[0]}: {bad[1]}")
    return old.unionByName(new)


def without_deleted(rows: DataFrame, deleted: DataFrame, id_col: str) -> DataFrame:
    return rows.join(deleted.select(id_col).distinct(), id_col, "left_anti")
