"""Event logs, jobs and work states in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import cut


def linked(events: DataFrame, links: dict[str, DataFrame], key: str) -> DataFrame:
    """Events that have a link in every one of ``links`` (each with the column ``key``)."""
    for rows in links.values():
        events = events.join(rows.select(key).distinct(), key, "left_semi")
    return events


def replay(log: DataFrame, after: int, limit: int, only: Column | None = None, sequence: str = "sequence") -> DataFrame:
    """The next rows behind a cursor; 1 to 1000 at once."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit: 1 to 1000")
    rows = log.where(F.col(sequence) > after)
    return (rows if only is None else rows.where(only)).orderBy(sequence).limit(limit)


def bounds(log: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Latest (0 for an empty log) and oldest sequence, over all rows."""
    return log.agg(F.coalesce(F.max(sequence), F.lit(0)).alias("latest"), F.min(sequence).alias("oldest"))


def retained(log: DataFrame, at: str, not_before: Column, most: int, sequence: str = "sequence") -> DataFrame:
    """What is left after rows expire by age, and then all but the newest ``most``.

    The bound is the most-th newest sequence: a top-k, no sort of the log in one task.
    """
    fresh = log.where(F.col(at) >= not_before)
    newest = fresh.select(sequence).orderBy(F.desc(sequence)).limit(most).agg(F.min(sequence).alias("__from"))
    return fresh.join(F.broadcast(newest)).where(F.col(sequence) >= F.col("__from")).drop("__from")


def pruned(jobs: DataFrame, terminal: Column, at: str, cutoff: Column, most: int, id_col: str) -> DataFrame:
    """``jobs`` with ``pruned``: terminal ones that are too old or not among the newest ``most``.

    The newest are found as a top-k and joined back, so no window spans all jobs.
    """
    keep = jobs.where(terminal).select(id_col, at).orderBy(F.desc(at), F.desc(id_col)).limit(most).select(id_col, F.lit(True).alias("__kept"))
    marked = jobs.join(F.broadcast(keep), id_col, "left")
    gone = terminal & ((F.col(at) < cutoff) | F.col("__kept").isNull())
    return marked.withColumn("pruned", F.coalesce(gone, F.lit(False))).drop("__kept")


def pruned_pair(jobs: DataFrame, children: DataFrame, terminal: Column, at: str, cutoff: Column, most: int, id_col: str, parent: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What pruning leaves of ``jobs`` and of their ``children``, and one row of
    counts: deleted_runs, deleted_children, retained_terminal.

    Both sides follow from one written table of marks, so they fit each other
    whenever they are read. Children of no job go as well. Publish them by one
    rename or pointer after both are written.
    """
    marks = cut(pruned(jobs.select(id_col, at, terminal.alias("__end")), F.col("__end"), at, cutoff, most, id_col).select(id_col, "__end", "pruned"))
    left = marks.where("not pruned").select(id_col)
    kept, theirs = jobs.join(left, id_col, "left_semi"), children.join(left.withColumnRenamed(id_col, parent), parent, "left_semi")
    runs = marks.agg(F.count_if("pruned").alias("deleted_runs"), F.count_if(F.col("__end") & ~F.col("pruned")).alias("retained_terminal"))
    gone = children.join(left.withColumnRenamed(id_col, parent), parent, "left_anti").agg(F.count(F.lit(1)).alias("deleted_children"))
    return kept, theirs, runs.join(F.broadcast(gone)).select("deleted_runs", "deleted_children", "retained_terminal")


def latest(rows: DataFrame, by: list[str], at: str, id_col: str) -> DataFrame:
    """The last row of each key by time, then id; an aggregation, so hot keys combine before the shuffle."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*by).agg(F.max_by(every, F.struct(at, id_col)).alias("__row"))
    return best.select("__row.*")


def numbered(rows: DataFrame, by: list[str], order: list[Column], start: Column | int = 1, out: str = "sequence") -> DataFrame:
    """Consecutive numbers inside each key from ``start``."""
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1 + start)


def admitted(batch: DataFrame, active: DataFrame, capacity: int) -> DataFrame:
    """``batch`` with ``admitted``: all of it, or nothing where it would exceed the capacity."""
    load = active.agg(F.count(F.lit(1)).alias("__a")).join(F.broadcast(batch.agg(F.count(F.lit(1)).alias("__b"))))
    return batch.join(F.broadcast(load)).withColumn("admitted", F.col("__a") + F.col("__b") <= capacity).drop("__a", "__b")


def merged(lists: list[DataFrame], id_col: str, at: str, limit: int) -> DataFrame:
    """One row for each id, the last list's; newest first."""
    union = None
    for i, df in enumerate(lists):
        part = df.withColumn("__list", F.lit(i))
        union = part if union is None else union.unionByName(part)
    place = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("__list")))
    return union.withColumn("__place", place).where("__place = 1").drop("__place", "__list").orderBy(F.desc(at), F.desc(id_col)).limit(limit)


def sessions(events: DataFrame, by: str, at: str, gap: str, value: str) -> DataFrame:
    """Bursts of events until they pause for ``gap``: start, end, count and distinct values."""
    window = F.session_window(at, gap)
    return events.groupBy(by, window.alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_set(value)).alias("kinds")).select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events", "kinds")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` and what of ``old`` it doesn't replace."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))
