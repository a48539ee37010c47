"""Composed search, coverage with its gaps, and lookups around definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .chunks import lines
from .joins import glob_join
from .rules import finding_key
from .search import clamp, definition_score, merged_best, rank_boost


def unified(results: list[DataFrame], limit: int, scopes: tuple[str, ...] = ()) -> DataFrame:
    """The best of several searches (kind, path, title, score): by score, kind,
    path and title. ``scopes``: folders to stay in."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    if scopes:
        every = every.where(reduce(lambda a, b: a | b, [(F.col("path") == s) | F.col("path").startswith(s.rstrip("/") + "/") for s in scopes]))
    return every.orderBy(F.desc("score"), "kind", "path", "title").limit(limit)


def line_search(docs: DataFrame, query: str, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """Lines that the query fits, loosely: id, line_no, line, score."""
    return lines(docs, id_col, body).withColumn("score", text.fuzzy_score(query, F.col("line"))).where("score > 0")


def file_scores(files: DataFrame, path: str, definitions: dict[str, tuple[str, list[str]]], query: str) -> DataFrame:
    """(path, score): the best score of the definitions (id: words and globs)
    that cover a file; files of score 0 are left out."""
    scores = F.coalesce(*[F.when(F.col("definition") == k, definition_score(query, F.lit(f"{k} {body}"))) for k, (body, _) in definitions.items()], F.lit(0.0))
    hits = glob_join(files.select(path).distinct(), path, {k: globs for k, (_, globs) in definitions.items()})
    return hits.groupBy(path).agg(F.max(scores).alias("score")).where("score > 0")


def owned_results(chunks: DataFrame, scores: DataFrame, boost: Column, signal: Column, path: str = "path") -> DataFrame:
    """Chunks of the files that definitions own, with a score: the file's with
    boost and signal, or without a signal of its own a damped one."""
    s = F.col("score")
    damped = F.when(s >= 0.85, F.least(F.lit(0.75), s)).otherwise(F.least(F.lit(0.25), s * 0.5))
    return chunks.join(scores, path).withColumn("score", F.when(signal > 0, F.least(F.lit(1.0), s + boost + signal)).otherwise(damped))


def context_search(found: DataFrame, owned: DataFrame, query: str, limit: int, id_col: str, language: Column, heading: Column) -> DataFrame:
    """Search results and those of owned files (id, path, score), the better
    of two for one id, boosted by path and heading and cut at 1."""
    best = merged_best(found, owned, id_col=id_col)
    ranked = best.withColumn("score", F.least(F.lit(1.0), F.col("score") + rank_boost(query, F.col("path"), heading, language)))
    return ranked.orderBy(F.desc("score"), id_col).limit(clamp(limit))


def answer(found: DataFrame, id_col: str, title: str) -> DataFrame:
    """One row: what the best six results say, in four lines at most, and how many there are."""
    top = found.orderBy(F.desc("score"), id_col).limit(6)
    place = F.row_number().over(W.orderBy(F.desc("score"), id_col))
    lined = top.select(place.alias("n"), F.concat_ws(" ", F.concat(place, F.lit(".")), title).alias("line"))
    rows = F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= 4, F.struct("n", "line")))), lambda x: x["line"])
    return lined.agg(F.array_join(rows, "\n").alias("answer"), F.count("n").alias("n_results"))


def gaps(files: DataFrame, path: str) -> DataFrame:
    """(gap, path): files (path, n_chunks, governed, stale) that lack something."""
    kinds = F.array(F.when(~F.col("governed"), F.lit("ungoverned")), F.when(F.col("n_chunks") == 0, F.lit("unindexed")), F.when(F.col("stale"), F.lit("stale")))
    return files.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("gap"), path)


def chunk_counts(files: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """(path, n_chunks) of every file, 0 included."""
    n = chunks.groupBy(path).agg(F.count(F.lit(1)).alias("n_chunks"))
    return files.select(path).distinct().join(n, path, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))


def link_search(query: str, nodes: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, id): nodes (kind, id, label), findings (id, message) and files
    (path) that hold the query in any case."""
    q = query.strip().lower()
    holds = lambda c: F.contains(F.lower(c), F.lit(q))
    by_node = nodes.where(holds(F.col("id")) | holds(F.col("label"))).select("kind", "id")
    by_finding = findings.where((F.lower("id") == q) | holds(F.col("message"))).select(F.lit("finding").alias("kind"), "id")
    by_file = files.where(holds(F.col("path"))).select(F.lit("file").alias("kind"), F.col("path").alias("id"))
    return by_node.unionByName(by_finding).unionByName(by_file).distinct()


def chunk_list(chunks: DataFrame, path: str | None = None, definitions: dict[str, list[str]] | None = None, wanted: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Chunks (path, ordinal, id) of a path, or of the files of the wanted
    definitions; unknown definitions give none, not all."""
    df = chunks if path is None else chunks.where(F.col("path") == path)
    if wanted is not None:
        known = {k: v for k, v in (definitions or {}).items() if k in wanted}
        df = df.join(glob_join(df.select("path").distinct(), "path", known).select("path").distinct(), "path", "left_semi") if known else df.where("false")
    return df.orderBy("path", F.col("ordinal").cast("int"), "id").offset(offset).limit(min(500, max(1, limit)))


def by_file(found: DataFrame) -> DataFrame:
    """(file, n, findings): each file's findings as an array in their order."""
    row = F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("column"), "rule_id", "severity", "message")
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(row)).alias("findings"))


def evidence(found: DataFrame, covered: DataFrame, most: int = 6) -> DataFrame:
    """(definition, n_findings, evidence): the findings (file) of the files
    each definition covers (file, definition), and the first ``most`` of their keys."""
    key = found.select("file", finding_key().alias("key"))
    hits = covered.join(key, "file").groupBy("definition", "key").agg(F.count("key").alias("n"))
    ranked = hits.withColumn("place", F.row_number().over(W.partitionBy("definition").orderBy("key")))
    first = F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.col("key"))))
    return ranked.groupBy("definition").agg(F.sum("n").alias("n_findings"), first.alias("evidence"))


def domain_edges(*relations: DataFrame) -> DataFrame:
    """All different edges (source, relation, target) of areas: what they own, depend on and feed."""
    return reduce(DataFrame.union, [r.select("source", "relation", "target") for r in relations]).distinct()


def surface_checks(files: DataFrame, path: str, surfaces: dict[str, list[str]], conventions: dict[str, list[str]], checks: DataFrame) -> DataFrame:
    """(surface, n_files, conventions, checks): for each surface that a file
    touches, the conventions that govern these files and the checks (surface, check) asked for."""
    touched = glob_join(files.select(path).distinct(), path, surfaces, "surface")
    governed = touched.join(glob_join(files.select(path).distinct(), path, conventions, "convention"), path, "left")
    needed = checks.groupBy("surface").agg(F.sort_array(F.collect_set("check")).alias("checks"))
    sums = governed.groupBy("surface").agg(F.count_distinct(path).alias("n_files"), F.sort_array(F.collect_set("convention")).alias("conventions"))
    return sums.join(needed, "surface", "left").withColumn("checks", F.coalesce("checks", F.array().cast("array<string>")))


def scope_drift(changed: DataFrame, path: str, scope: list[str], most: int = 8) -> DataFrame:
    """One row: how many changed files lie outside the scope's globs, and the first ``most``."""
    from ..functions import globs

    out = changed.select(path).distinct().where(~globs.matches(F.col(path), scope))
    first = out.orderBy(path).limit(most).agg(F.sort_array(F.collect_list(path)).alias("files"))
    return out.agg(F.count(path).alias("n_outside")).join(F.broadcast(first))


def authoritative(candidates: DataFrame, precedence: list[str]) -> DataFrame:
    """(language, status): the candidate (language, ordinal, status) whose
    status stands first in ``precedence``; unknown ones last, of equal ones the first."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(precedence)], F.lit(len(precedence)))
    return candidates.groupBy("language").agg(F.min_by("status", F.struct(rank, "ordinal")).alias("status"))
