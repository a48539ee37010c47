"""Refactor plans: renames and moves as rows of edits, moves and diagnostics.

An edit (file, start, end, replacement, safety) is what ``rules.fixed_texts``
applies; offsets count characters from 0. Nothing here changes a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .imports import folder_of

# What imports are rewritten in, and how an import names its source.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".svelte")
IMPORT = r"\b(?:from\s+|import\s*\(\s*|import\s+)[\"'][^\"']+[\"']"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"


def _edits(found: DataFrame, replacement: Column) -> DataFrame:
    return found.select(F.col("path").alias("file"), "start", (F.col("start") + F.length("match")).alias("end"), replacement.alias("replacement"), F.lit("safe").alias("safety"))


def _matches(texts: DataFrame, pattern: str) -> DataFrame:
    """(path, start, match) of all matches in ``texts`` (path, text; one row a
    path): offsets are sums of the lengths of matches and of what is between."""
    body = F.col("text")
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    pieces = texts.where(body.rlike(pattern)).select("path", found.alias("found"), F.split(body, pattern).alias("between"))
    each = pieces.select("path", F.posexplode(F.zip_with(F.slice("between", 1, F.size("found")), "found", lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match")))).alias("n", "x"))
    upto = F.sum(F.col("x.gap") + F.length("x.match")).over(W.partitionBy("path").orderBy("n"))
    return each.select("path", (upto - F.length("x.match")).cast("int").alias("start"), F.col("x.match").alias("match"))


def identifier_problems(source: str, target: str) -> list[str]:
    return [f"Invalid {kind} identifier: {name}" for kind, name in (("source", source), ("target", target)) if not re.fullmatch(IDENTIFIER, name)]


def rename_by_text(texts: DataFrame, source: str, target: str) -> DataFrame:
    """Edits of all whole words ``source`` in ``texts`` (path, text); none for a bad identifier."""
    word = rf"(?<![A-Za-z0-9_$]){re.escape(source)}(?![A-Za-z0-9_$])"
    found = _matches(texts if not identifier_problems(source, target) else texts.limit(0), word)
    return _edits(found, F.lit(target))


def rename_by_graph(symbols: DataFrame, references: DataFrame, source: str, target: str) -> DataFrame:
    """Edits of the declarations and references (path, name, start) of a name
    that has one declaration; none where it has several or none."""
    named = symbols.where(F.col("name") == source).select("path", "start")
    one = named.agg(F.count("path").alias("n")).where("n = 1")
    every = named.union(references.where(F.col("name") == source).select("path", "start")).distinct()
    return _edits(every.withColumn("match", F.lit(source)).join(F.broadcast(one.select(F.lit(True).alias("__one")))).drop("__one"), F.lit(target))


def rename_problems(symbols: DataFrame, source: str, target: str) -> DataFrame:
    """(message): why a rename by the graph isn't done."""
    bad = identifier_problems(source, target)
    counted = symbols.where(F.col("name") == source).agg(F.count("name").alias("n"))
    word = F.when(F.col("n") > 1, F.concat(F.lit(f"Ambiguous graph rename for symbol {source}: "), F.col("n").cast("string"), F.lit(" declarations match."))).when(F.col("n") == 0, f"No declaration of symbol: {source}")
    return counted.select(F.explode(F.array_compact(F.array(*map(F.lit, bad), word))).alias("message"))


def moves_of_folder(files: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target) of all ``files`` (path) below a folder that moves."""
    source, target = source.rstrip("/") + "/", target.rstrip("/") + "/"
    return files.where(F.col("path").startswith(source)).select(F.col("path").alias("source"), F.concat(F.lit(target), F.substring("path", F.lit(len(source) + 1), F.length("path"))).alias("target")).distinct()


def without_extension(path: Column) -> Column:
    ends = "|".join(re.escape(e) for e in EXTENSIONS)
    return F.regexp_replace(path, f"(?:{ends})$", "")


def relative_path(folder: Column, target: Column) -> Column:
    """How ``target`` is reached from ``folder``; both from the project's root."""
    a, b = F.filter(F.split(folder, "/"), lambda x: x != ""), F.split(target, "/")
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct((s["n"] + (s["on"] & p["a"].eqNullSafe(p["b"])).cast("int")).alias("n"), (s["on"] & p["a"].eqNullSafe(p["b"])).alias("on")), lambda s: s["n"])
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    return F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b))), "/")


def specifier(importer: Column, target: Column, like: Column) -> Column:
    """A relative import of ``target`` in ``importer``: the inverse of
    resolution. With the extension if ``like``, the import so far, has one."""
    had = like.rlike("(?:" + "|".join(re.escape(e) for e in EXTENSIONS) + ")$")
    path = relative_path(folder_of(importer), F.when(had, target).otherwise(without_extension(target)))
    return F.when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), path))


def updated_imports(texts: DataFrame, moves: DataFrame) -> DataFrame:
    """Edits of all relative imports in ``texts`` (path, text) that lead to the
    source of a move (source, target). A source without an extension stands
    for the file of that name, with one of EXTENSIONS, or for an index of the
    folder, of several moves the first such. All moves, of a folder too, meet
    all imports in one join."""
    found = _matches(texts, IMPORT)
    quoted = F.regexp_extract("match", r"[\"']([^\"']+)[\"']$", 1)
    found = found.select("path", (F.col("start") + F.length("match") - 1 - F.length(quoted)).alias("start"), quoted.alias("match")).where(F.col("match").startswith("."))
    base = text.normal_path(F.concat_ws("/", folder_of(F.col("path")), "match"))
    found = found.withColumn("base", base)
    ends = ["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)]
    whole = F.col("base").rlike("(?:" + "|".join(re.escape(e) for e in EXTENSIONS) + ")$")
    each = found.select("path", "start", "match", F.posexplode(F.when(whole, F.array("base")).otherwise(F.array(*[F.concat("base", F.lit(e)) for e in ends]))).alias("place", "source"))
    led = each.join(moves.select("source", F.col("target").alias("to")), "source").groupBy("path", "start", "match").agg(F.min_by("to", F.struct("place", "to")).alias("to"))
    return _edits(led, specifier(F.col("path"), F.col("to"), F.col("match")))


def move_problems(files: DataFrame, moves: DataFrame) -> DataFrame:
    """(message): sources that aren't there, targets that are, and targets of several sources."""
    known = files.select(F.col("path")).distinct()
    gone = moves.join(known.withColumnRenamed("path", "source"), "source", "left_anti").select(F.concat(F.lit("Cannot move missing file: "), "source").alias("message"))
    there = moves.join(known.withColumnRenamed("path", "target"), "target", "left_semi").join(moves.select(F.col("source").alias("target")), "target", "left_anti").select(F.concat(F.lit("Target exists: "), "target").alias("message"))
    twice = moves.groupBy("target").agg(F.count_distinct("source").alias("n")).where("n > 1").select(F.concat(F.lit("Several files move to: "), "target").alias("message"))
    return gone.union(there).union(twice).distinct()


def renamed_package(texts: DataFrame, source: str, target: str) -> DataFrame:
    """Edits of all quoted strings that are a package's name."""
    name = re.escape(source)
    found = _matches(texts if source.strip() and target.strip() else texts.limit(0), f"\"{name}\"|'{name}'")
    return _edits(found, F.concat(F.left("match", F.lit(1)), F.lit(target), F.left("match", F.lit(1))))
