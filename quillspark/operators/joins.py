"""Joins beyond equality: nearest, longest prefix, glob, and similar names.

The nearest-row joins are windows over the union of both sides, one shuffle by
key and no range join; so a hot key costs a sort, not a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import globs, text

#: A pattern table of up to so many rows is broadcast; a larger one is joined by shuffle.
SMALL_ROWS = 10_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is checked to have few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, value: str, forward: bool = False, out: str = "nearest") -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before
    ``at`` (first at or after it, if ``forward``) with the same ``by``.

    Of right rows at one place, the greatest value counts backward and the
    least forward. Rows without a match keep a null; nulls never match.
    """
    side = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(by, at).agg((F.min if forward else F.max)(value).alias("__v"))
    both = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__left", F.lit(1))
    both = both.unionByName(side.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    # At one place, right rows come before left ones in the direction of the search.
    order = [F.desc(at), F.asc("__left")] if forward else [F.asc(at), F.asc("__left")]
    last = F.last("__v", ignorenulls=True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    found = F.when(F.col(by).isNotNull() & F.col(at).isNotNull(), last)
    return both.withColumn(out, found).where("__left = 1").drop("__v", "__left")


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str, out: str = "owner") -> DataFrame:
    """``paths`` with the longest of ``roots`` that is the path or a folder
    above it: each path's folders are its candidate keys, joined by equality."""
    keyed = paths.select(path).distinct().withColumn("__key", F.explode(F.concat(text.ancestors(F.col(path)), F.array(path))))
    hit = keyed.join(small(roots.select(F.col(root).alias("__key")).distinct()), "__key")
    best = hit.groupBy(path).agg(F.max_by("__key", F.length("__key")).alias(out))
    return paths.join(best, path, "left")


def glob_join(files: DataFrame, path: str, definitions: dict[str, list[str]], out: str = "definition") -> DataFrame:
    """A row for each file and each definition whose patterns fit it.

    The definitions are the program's own, so each becomes one expression and
    the join one scan; patterns without wildcards turn into equality.
    """
    def fits(patterns: list[str]) -> Column:
        if all(not any(c in p for c in "*?[{!") for p in patterns):
            return F.col(path).isin(*patterns)
        return globs.matches(F.col(path), patterns)

    hits = F.array(*[F.when(fits(p), F.lit(k)) for k, p in definitions.items()])
    return files.withColumn(out, F.explode(F.filter(hits, lambda x: x.isNotNull())))


def similar_names(df: DataFrame, id_col: str, name: str, least: float = 0.82) -> DataFrame:
    """Pairs (a < b) of rows whose names, without case and verbs, are alike.

    A similarity of ``least`` bounds the edit distance to d of the longer
    name; of d + 1 pieces that a name is cut into, one is left as it is, at a
    place shifted by d at most. These pieces are the join keys, by length.
    Equal names meet once for each distinct name.
    """
    names = df.select(F.col(id_col).alias("id"), text.identifier_key(F.col(name)).alias("key")).where("key <> ''")
    kinds = names.select("key").distinct().withColumn("n", F.length("key"))
    d = F.floor(F.lit(1 - least + 1e-9) * F.col("n")).cast("int")

    # The shorter of a pair looks up the pieces of the longer, at all shifts and lengths that d allows.
    bounds = lambda i: F.floor(i * F.col("n") / (F.col("d") + 1)).cast("int")
    pieces = kinds.withColumn("d", d).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    pieces = pieces.withColumn("from", bounds(F.col("i"))).withColumn("len", bounds(F.col("i") + 1) - F.col("from"))
    pieces = pieces.select(F.col("key").alias("long"), "n", "d", "i", F.substring("key", F.col("from") + 1, F.col("len")).alias("piece"))
    shorter = kinds.select(F.col("key").alias("short"), F.col("n").alias("m"))
    longest = F.floor(F.col("m") / least + 1e-9).cast("int")
    shorter = shorter.withColumn("n", F.explode(F.sequence(F.col("m"), F.greatest(F.col("m"), longest))))
    shorter = shorter.withColumn("d", d).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    shorter = shorter.withColumn("from", bounds(F.col("i"))).withColumn("len", bounds(F.col("i") + 1) - F.col("from"))
    shorter = shorter.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("from") - F.col("d")), F.col("from") + F.col("d"))))
    shorter = shorter.where(F.col("at") + F.col("len") <= F.col("m")).select("short", "n", "i", F.substring("short", F.col("at") + 1, F.col("len")).alias("piece"))
    pairs = pieces.join(shorter, ["n", "i", "piece"]).where("long <> short").select(F.least("long", "short").alias("x"), F.greatest("long", "short").alias("y")).distinct()
    score = text.key_similarity(F.col("x"), F.col("y"))
    pairs = pairs.withColumn("similarity", score).where(F.col("similarity") >= least)
    pairs = pairs.union(kinds.select(F.col("key").alias("x"), F.col("key").alias("y"), F.lit(1.0)))
    a, b = names.select(F.col("id").alias("p"), F.col("key").alias("x")), names.select(F.col("id").alias("q"), F.col("key").alias("y"))
    hit = pairs.join(a, "x").join(b, "y").where("x <> y or p < q")
    return hit.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
