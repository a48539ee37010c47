"""Grouping operators: repeated values, folder rollups, hash trees, coverage, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .cuts import cut


def repeated(rows: DataFrame, value: list[str], file: str, order: list[str], least: int = 3, least_files: int = 1) -> DataFrame:
    """Values that occur ``least`` times in ``least_files`` files: counts, files and the first place."""
    agg = rows.groupBy(*value).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(file).alias("n_files"), F.min(F.struct(*order)).alias("first"))
    return agg.where((F.col("n") >= least) & (F.col("n_files") >= least_files))


def folders(files: DataFrame, path: str) -> DataFrame:
    """Every folder above a file: its depth and number of different files."""
    each = files.select(path).distinct().withColumn("folder", F.explode(text.ancestors(F.col(path))))
    return each.groupBy("folder").agg(F.count(path).alias("n_files")).withColumn("depth", F.size(F.split("folder", "/")))


def hash_tree(leaves: DataFrame, path: str, leaf_hash: str, depth: int) -> DataFrame:
    """(node, kind, parent, hash) of leaves, files, folders and the root ``.``:
    a parent's hash is that of its children's in order. One aggregation a
    level, from the deepest up; ``depth``: most folders above a file."""
    chunks = leaves.select(F.concat_ws("#", path, leaf_hash).alias("node"), F.lit("chunk").alias("kind"), F.col(path).alias("parent"), F.col(leaf_hash).alias("hash"))
    above = F.regexp_replace(F.col("parent"), "/?[^/]*$", "")
    level = chunks.groupBy("parent").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), "\n").cast("binary"), 256).alias("hash"))
    level = level.select(F.col("parent").alias("node"), F.lit("file").alias("kind"), F.when(above == "", ".").otherwise(above).alias("parent"), "hash")
    level = cut(level)  # read by every level above
    out, waiting = chunks.unionByName(level), level.withColumn("level", F.size(F.split("node", "/")) - 1)
    for d in range(depth, -1, -1):
        due = waiting.where(F.col("level") == d)
        made = due.groupBy("parent").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), "\n").cast("binary"), 256).alias("hash"))
        if d == 0:
            out = out.unionByName(made.select(F.col("parent").alias("node"), F.lit("root").alias("kind"), F.lit(None).cast("string").alias("parent"), "hash"))
            break
        made = made.select(F.col("parent").alias("node"), F.lit("dir").alias("kind"), F.when(above == "", ".").otherwise(above).alias("parent"), "hash")
        made = cut(made)  # a level is read by its parents and by the result
        out = out.unionByName(made)
        waiting = waiting.where(F.col("level") < d).unionByName(made.withColumn("level", F.lit(d - 1)))
    return out


def coverage(files: DataFrame, indexed: Column, governed: Column, stale: Column) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return files.agg(F.count(F.lit(1)).alias("files"), count(indexed).alias("indexed"), count(governed).alias("governed"), count(~governed).alias("ungoverned"), count(stale).alias("stale"))


def kind_counts(rows: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """One row with a count for each kind, absent ones 0."""
    return rows.agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds])


def diff(new: DataFrame, old: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, changed, unchanged or deleted."""
    both = new.select(key, F.col(content).alias("__new")).join(old.select(key, F.col(content).alias("__old")), key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__new") == F.col("__old"), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def inventory_hash(files: DataFrame, path: str, content: str) -> DataFrame:
    """One hash of all (path, hash) lines in order. The lines meet by prefix
    first, so that no task holds more than a part of them."""
    lines = files.select(F.concat_ws("\0", path, content).alias("line"), F.substring(F.sha2(F.col(path).cast("binary"), 256), 1, 3).alias("part"))
    parts = lines.groupBy("part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n").cast("binary"), 256).alias("hash"))
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\0", "part", "hash"))), "\n").cast("binary"), 256).alias("inventory_hash"))


def backlinks(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(target, sources in order)."""
    return edges.groupBy(target).agg(F.sort_array(F.collect_set(source)).alias("sources"))


def linked_both_ways(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(side, id, others): what each target is linked from, and what each source links to."""
    into = backlinks(edges, source, target).select(F.lit("target").alias("side"), F.col(target).cast("string").alias("id"), F.col("sources").alias("others"))
    out = backlinks(edges, target, source).select(F.lit("source").alias("side"), F.col(source).cast("string").alias("id"), F.col("sources").alias("others"))
    return into.unionByName(out)


def owners(edges: DataFrame, owner: str, target: str) -> DataFrame:
    """Targets that several owners claim."""
    agg = edges.groupBy(target).agg(F.count_distinct(owner).alias("n_owners"), F.min(owner).alias("first_owner"))
    return agg.where("n_owners > 1")


def hinted(found: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """``found`` (key, change, of ``diff``) where ``hints`` (key) name files
    that changed though their content doesn't tell: unchanged ones become
    changed, and those that aren't there deleted."""
    both = found.join(hints.select(key, F.lit(True).alias("__hint")).distinct(), key, "full_outer")
    change = F.when(F.col("change").isNull(), "deleted").when((F.col("change") == "unchanged") & F.col("__hint"), "changed").otherwise(F.col("change"))
    return both.select(key, change.alias("change"))


def missing(references: DataFrame, targets: DataFrame, key: str, target_key: str) -> DataFrame:
    """References whose target is not there; null references are none."""
    return references.where(F.col(key).isNotNull()).join(targets.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def unique_ids(rows: DataFrame, id_col: str, order: list[Column], out: str = "unique_id") -> DataFrame:
    """The first row of an id keeps it, later ones get ``-2``, ``-3`` and so on."""
    n = F.row_number().over(W.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("__n", n).withColumn(out, F.when(F.col("__n") == 1, F.col(id_col).cast("string")).otherwise(F.concat_ws("-", id_col, "__n"))).drop("__n")
