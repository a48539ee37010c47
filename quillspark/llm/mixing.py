"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight. Each
source has a word budget. Complete epochs (every document once) come first;
the rest of the budget goes to the documents of smallest keys, as far as the
prefix sums of their sizes come nearest to it.

The prefix sums need no sort of a whole source: sizes are first summed in key
buckets, and only the bucket in which a source's budget ends is sorted. All
that leaves this module's plan is one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Key buckets of a source. One bucket of each source is sorted.
BUCKETS = 4096
#: Up to so many sources their table is broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Quality weight of a document: 1, or 1/4 where the mean word has under 3
    or over 13 characters (runs of symbols, glued text). Positive always."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3.0, 13.0), 1.0).otherwise(0.25)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with its working columns: __size, __source, __hash, __id, __key."""
    text = F.col("text")
    df = docs.withColumn("__size", size_of(text))
    df = df.withColumn("__source", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))))
    df = df.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), text).cast("binary"))
    df = df.withColumn("__hash", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))
    uniform = (F.col("__hash").cast("double") + 0.5) / float(1 << 52)
    return df.withColumn("__key", -F.log(uniform) / quality_of(text, F.col("__size")))


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row for each source: its size and target. ``sizes``: __source, source_size.

    Sources run into their caps in the order of cap by weight; so the shares
    of all others follow from the sums over those before and after.
    """
    by_name = sizes.withColumn("__n", F.row_number().over(W.orderBy("__source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__n") - 1) % len(weights) + 1).cast("int"))
    t = by_name.withColumn("__w", w).withColumn("__cap", F.col("source_size") * float(cap))
    t = t.withColumn("__total", F.sum("source_size").over(W.partitionBy()) * float(share)).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = W.orderBy("__ratio", "__n")
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("__level", (F.col("__total") - before) / weight_left)
    t = t.withColumn("__open", F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__n", "__level")))
    level = F.min("__open").over(W.partitionBy())["__level"]
    return t.select("__source", "source_size", F.coalesce(F.least(F.col("__cap"), F.col("__w") * level), F.col("__cap")).alias("target"))


_PLACE = ["__key", "__hash", "__id"]


def _twins(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """One row for each group of rows that are equal in source, doc_id and text, and how many they are (__n)."""
    keyed = _keyed(docs.select("doc_id", "text", "source"), seed)
    return cut(keyed.groupBy("__source", *_PLACE, "__size", *more).agg(F.count("__hash").alias("__n")), "mix-base")


def _decisions(base: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row for each source: size, target, epochs, and where the fractional
    selection ends: the first place (key, hash, id) of which not all twins are
    taken and how many of them are (__out), or else the last place (__end)."""
    base = base.withColumn("__bucket", F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("__key")))).cast("int"))
    words = F.col("__size") * F.col("__n")
    sums = cut(base.groupBy("__source", "__bucket").agg(F.sum(words).alias("__sum")), "mix-buckets")
    targets = _targets(sums.groupBy("__source").agg(F.sum("__sum").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("__rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = cut(targets, "mix-targets")
    running = F.sum("__sum").over(W.partitionBy("__source").orderBy("__bucket"))
    ends = sums.withColumn("__before", running - F.col("__sum")).join(targets, "__source")
    ends = ends.where((F.col("__before") < F.col("__rest")) & (F.col("__rest") <= F.col("__before") + F.col("__sum")))
    ends = ends.select("__source", "__bucket", "__before", "__rest")
    last = base.join(F.broadcast(ends) if targets.count() <= BROADCAST_SOURCES else ends, ["__source", "__bucket"])
    place = F.struct(*_PLACE)
    upto = F.col("__before") + F.sum(words).over(W.partitionBy("__source").orderBy(*_PLACE).rowsBetween(W.unboundedPreceding, 0))
    # A document is in as long as that brings the sum nearer to the budget.
    whole = 2 * F.col("__rest") - 2 * F.col("__upto") + F.col("__size") >= 0
    some = F.floor((2 * F.col("__rest") - 2 * (F.col("__upto") - words) + F.col("__size")) / (2 * F.col("__size")))
    taken = F.when(whole, F.col("__n")).when(F.col("__n") == 1, 0).otherwise(F.greatest(F.lit(0), F.least(some, F.col("__n") - 1)))
    last = last.withColumn("__upto", upto).select("__source", place.alias("__place"), "__n", taken.cast("long").alias("__more"))
    bound = last.groupBy("__source").agg(F.min(F.when(F.col("__more") < F.col("__n"), F.struct("__place", "__more"))).alias("__out"), F.max("__place").alias("__end"))
    return targets.join(bound, "__source", "left").drop("__rest")


def _with_copies(df: DataFrame, plan: DataFrame, twin: Column) -> DataFrame:
    """``df`` with the plan of its source and __copies; ``twin`` numbers the rows at an __out place from 1."""
    place = F.struct(*_PLACE)
    upto = F.when(F.col("__out").isNull(), F.coalesce(place <= F.col("__end"), F.lit(False))).when(place == F.col("__out.__place"), twin <= F.col("__out.__more")).otherwise(place < F.col("__out.__place"))
    return _joined(df, plan).withColumn("__copies", F.col("epochs") + (upto & (F.col("__size") > 0)).cast("int"))


def _joined(df: DataFrame, plan: DataFrame) -> DataFrame:
    return df.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "__source")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target,
    taken, and how often it is taken (copies).

    Sources in code-point order, null last, have ``weights`` in turn and share
    ``share`` times all words; no target exceeds ``cap`` times its source.
    Null texts have size 0 and take nothing; a null source is one source; rows
    of one source, doc_id and text are twins, of which as many are taken as
    the target asks; an empty table gives no rows. Texts without words are
    taken in complete epochs only.
    """
    base = _twins(docs, seed, "doc_id")
    plan = cut(_decisions(base, weights, share, cap), "mix-plan")
    each = base.withColumn("__twin", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    df = _with_copies(each, plan, F.col("__twin"))
    return df.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, each document as often
    as it is taken. Which of the twins at the end of a selection are taken is open."""
    plan = cut(_decisions(_twins(docs, seed), weights, share, cap), "mix-plan")
    df = _keyed(docs, seed)
    split = plan.where("__out.__more > 0").select("__source", F.col("__out.__place").alias("__split"))
    rows = _with_copies(df, plan, F.lit(1 << 62))
    if split.count():  # of a few places some twins are taken: those rows get numbers
        at = F.struct(*_PLACE).eqNullSafe(F.col("__split"))
        marked = _joined(df, plan.select("__source", F.col("__out.__place").alias("__split"), (F.col("__out.__more") > 0).alias("__some")))
        some = F.coalesce(F.col("__some") & at, F.lit(False))
        number = F.row_number().over(W.partitionBy("__source").orderBy(F.col("__hash")))
        rows = _with_copies(marked.where(~some).drop("__split", "__some"), plan, F.lit(1 << 62)).unionByName(_with_copies(marked.where(some).withColumn("__twin", number).drop("__split", "__some"), plan, F.col("__twin")).drop("__twin"))
    return rows.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
