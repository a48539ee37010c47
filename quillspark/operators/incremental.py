"""A code graph that is kept up to date: only files that changed are extracted
anew, and only references whose target may have changed are resolved anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import cut
from .graph import resolve_all

#: What tells whether a file's facts still hold.
STATE = ("content_hash", "parser", "extractor")

Facts = tuple[DataFrame, DataFrame, DataFrame]


@dataclass(frozen=True)
class GraphState:
    """Written tables: files (path and STATE), nodes, references and imports
    with their path, as ``resolve_all`` takes them, and resolved (ref, target, how)."""

    files: DataFrame
    nodes: DataFrame
    references: DataFrame
    imports: DataFrame
    resolved: DataFrame


def built(files: DataFrame, extract: Callable[[DataFrame], Facts]) -> GraphState:
    """The graph of ``files`` from nothing. ``extract``: nodes, references and imports of some files (path)."""
    files = cut(files.select("path", *STATE).distinct())
    nodes, references, imports = map(cut, extract(files.select("path")))
    return GraphState(files, nodes, references, imports, cut(resolve_all(references, nodes, imports)))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed in content or in a version, or deleted."""
    both = old.select("path", F.struct(*STATE).alias("__old")).join(new.select("path", F.struct(*STATE).alias("__new")), "path", "full_outer")
    change = F.when(F.col("__new").isNull(), "deleted").when(F.col("__old").isNull(), "added").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def updated(state: GraphState, files: DataFrame, extract: Callable[[DataFrame], Facts]) -> tuple[GraphState, DataFrame]:
    """The graph of ``files`` (all that there are now) from an earlier state,
    and the ``differences``. Equal to ``built``.

    A reference of an unchanged file may lead elsewhere only if nodes of its
    name came, went or changed, or if what it is imported or taken from is a
    file that did. These and the references of changed files are resolved
    again, against the new nodes; all others keep their target.
    """
    files = cut(files.select("path", *STATE).distinct())
    what = cut(differences(state.files, files))
    if what.isEmpty():
        return state, what
    gone = what.select("path")
    fresh = extract(what.where("change <> 'deleted'").select("path"))
    kept = [df.join(gone, "path", "left_anti").select(*df.columns) for df in (state.nodes, state.references, state.imports)]
    nodes, references, imports = (cut(old.unionByName(new)) for old, new in zip(kept, fresh))
    names = state.nodes.join(gone, "path", "left_semi").select("name").union(nodes.join(gone, "path", "left_semi").select("name")).distinct()
    moved = imports.join(gone.withColumnRenamed("path", "target_path"), "target_path", "left_semi").select("path", "name")
    touched = [
        references.join(gone, "path", "left_semi"), references.join(names, "name", "left_semi"), references.join(moved.distinct(), ["path", "name"], "left_semi"),
        references.join(gone.withColumnRenamed("path", "source_path"), "source_path", "left_semi"),
    ]
    again = cut(references.join(reduce(DataFrame.union, [df.select("ref") for df in touched]).distinct(), "ref", "left_semi"))
    still = references.select("ref").join(again.select("ref"), "ref", "left_anti")
    resolved = state.resolved.join(still, "ref", "left_semi").unionByName(resolve_all(again, nodes, imports))
    return GraphState(files, nodes, references, imports, cut(resolved)), what
