"""Definition graphs: what governs which file, and what is missing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rollups
from .cuts import cut
from .joins import glob_join


def nodes(definitions: DataFrame) -> DataFrame:
    """(kind, id, title): the first definition of an id; ``ordinal`` is the order."""
    first = F.min(F.struct("ordinal", "title"))
    return definitions.groupBy("kind", "id").agg(first.alias("__f")).select("kind", "id", F.col("__f.title").alias("title"))


def edges(definitions: DataFrame, relations: dict[str, str]) -> DataFrame:
    """Distinct (kind, id, relation, target) of the array columns in ``relations`` (column: relation)."""
    each = [definitions.select("kind", "id", F.lit(name).alias("relation"), F.explode(column).alias("target")) for column, name in relations.items()]
    return reduce(DataFrame.unionByName, each).distinct()


def diagnostics(definitions: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """(code, id, detail): duplicate ids, missing titles, references to
    nothing, targets with several owners."""
    twice = definitions.groupBy("kind", "id").count().where("count > 1").select(F.lit("duplicate-id").alias("code"), "id", F.col("kind").alias("detail"))
    bare = definitions.where(F.coalesce(F.trim("title"), F.lit("")) == "").select(F.lit("missing-title").alias("code"), "id", F.col("kind").alias("detail"))
    lost = rollups.missing(links, known, "target", "id").select(F.lit("missing-reference").alias("code"), "id", F.col("target").alias("detail"))
    shared = rollups.owners(links.where("relation = 'owns'"), "id", "target").select(F.lit("duplicate-ownership").alias("code"), F.col("target").alias("id"), F.col("first_owner").alias("detail"))
    return twice.unionByName(bare).unionByName(lost).unionByName(shared)


def file_coverage(files: DataFrame, path: str, patterns: dict[str, list[str]]) -> DataFrame:
    """(path, definitions in order), an empty list for what nothing governs."""
    hits = glob_join(files.select(path).distinct(), path, patterns).groupBy(path).agg(F.sort_array(F.collect_set("definition")).alias("definitions"))
    return files.select(path).distinct().join(hits, path, "left").withColumn("definitions", F.coalesce("definitions", F.array().cast("array<string>")))


def governing(files: DataFrame, path: str, applies: dict[str, list[str]], surfaces: DataFrame, explicit: DataFrame) -> DataFrame:
    """(convention, sources, n_files): conventions by their globs, by a
    surface of the file (path, convention), or named outright (convention)."""
    by_glob = glob_join(files.select(path).distinct(), path, applies, "convention").select("convention", path, F.lit("applies").alias("source"))
    by_surface = surfaces.join(files.select(path).distinct(), path, "left_semi").select("convention", path, F.lit("impact-surface").alias("source"))
    outright = explicit.select("convention", F.lit(None).cast("string").alias(path), F.lit("explicit").alias("source"))
    every = by_glob.unionByName(by_surface).unionByName(outright)
    return every.groupBy("convention").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count_distinct(path).alias("n_files"))


@dataclass(frozen=True)
class Step:
    """Definitions of a kind that share a key of the kinds ``by`` with what is
    known (``own``: or are named), and the kinds of their keys that become
    known. Without ``by`` and ``own`` those found before give their keys."""

    kind: str
    by: tuple[str, ...] = ()
    own: bool = True
    collect: tuple[str, ...] = ()
    known: bool = True


# The order in which related definitions are looked for. It isn't repeated.
RELATED_STEPS = (
    Step("finding", ("file", "validator", "convention"), collect=("file", "validator", "convention", "doc"), known=False),
    Step("validator", ("file", "topic", "convention"), collect=("topic", "convention", "doc"), known=False),
    Step("convention", ("topic", "validator", "file", "doc"), known=False),
    Step("surface", ("convention", "topic", "file"), own=False, collect=("convention", "doc", "topic")),
    Step("convention", own=False, collect=("topic", "validator", "convention", "doc")),
    Step("area", ("file", "doc", "surface"), own=False, collect=("doc", "surface")),
    Step("spec", ("file", "doc", "convention", "area", "surface"), own=False, collect=("doc", "convention", "area", "surface")),
    Step("change", ("file", "doc", "convention", "area", "spec", "surface"), own=False, collect=("doc", "convention", "area", "spec", "surface")),
    Step("surface"),
    Step("validator", ("file", "topic", "convention"), collect=("topic", "convention", "doc"), known=False),
)


def related_context(seed: DataFrame, keys: DataFrame, steps: tuple[Step, ...] = RELATED_STEPS) -> DataFrame:
    """(kind, id) of the definitions found from what a query names.

    ``seed``: kind and id of files, topics, conventions, validators or
    findings. ``keys``: kind, id, key_kind and key of each definition, one row
    for each of its files, topics, docs and links; globs are joined with the
    files before. What is known, found definitions as well, grows step by step
    in the fixed order, by one join with the keys each; there is no fixpoint.
    """
    known = cut(seed.select("kind", "id").distinct())
    found = seed.sparkSession.createDataFrame([], "kind string, id string")
    for step in steps:
        mine = keys.where(F.col("kind") == step.kind)
        if step.by or step.own:
            asked = known.where(F.col("kind").isin(*step.by))
            hit = mine.join(asked.select(F.col("kind").alias("key_kind"), F.col("id").alias("key")), ["key_kind", "key"], "left_semi").select("kind", "id")
            if step.own:
                hit = hit.union(mine.select("kind", "id").join(known, ["kind", "id"], "left_semi"))
            found = cut(found.union(hit).distinct())
        taken = mine.where(F.col("key_kind").isin(*step.collect)).join(found, ["kind", "id"], "left_semi").select(F.col("key_kind").alias("kind"), F.col("key").alias("id"))
        known = known.union(taken)
        known = cut((known.union(found.where(F.col("kind") == step.kind).select("kind", "id")) if step.known else known).distinct())
    return found
