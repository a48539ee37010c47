"""Search over code nodes and references."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import B, K1, clamp

#: What a search for symbols reads, in this order.
FIELDS = ("name", "qualified_name", "kind", "path", "signature")
MOST_SYMBOLS, MOST_REFERENCES = 500, 1000


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every argument given; None asks for nothing."""
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def prefixes(query: str) -> list[str]:
    """The query's tokens in order: runs of letters, digits and ``_`` of any script, lower-cased."""
    return re.findall(r"\w+", query.lower())


def words(*fields: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *fields))
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


def symbols(nodes: DataFrame, query: str | None = None, path: str | None = None, kind: str | None = None, limit: int = 50, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The best ``limit`` (1 to 500) nodes for the query with ``score``, less
    is better, then by path, line and id; without one all nodes by path, line
    and id, with a null score.

    Every token must begin some word of the fields. Scores are those of the
    whole table, so path and kind filter after them. Two scans, no shuffle of
    nodes: one row of sums is broadcast.
    """
    limit, tokens = clamp(limit, MOST_SYMBOLS), prefixes(query or "")
    if not tokens:
        return matching(nodes, path=path, kind=kind).withColumn("score", F.lit(None).cast("double")).orderBy("path", "start_line", "id").limit(limit)
    found = nodes.withColumn("__words", words(*[F.col(c) for c in fields])).withColumn("__len", F.size("__words"))

    def begun(token: str) -> Column:
        return F.size(F.filter("__words", lambda w: w.startswith(token)))

    for i, t in enumerate(tokens):
        found = found.withColumn(f"__tf{i}", begun(t))
    sums = found.agg(F.count("__len").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(tokens))])
    hits = matching(found.drop("__words").where(" and ".join(f"__tf{i} > 0" for i in range(len(tokens)))), path=path, kind=kind).join(F.broadcast(sums))
    score = F.lit(0.0)
    for i in range(len(tokens)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.greatest(F.log((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    ranked = hits.withColumn("score", F.round(score, 9)).select(*nodes.columns, "score")
    return ranked.orderBy("score", "path", "start_line", "id").limit(limit)


def references(rows: DataFrame, limit: int = 100, **wanted: object) -> DataFrame:
    """References that equal every argument given, by path, line and column; 1 to 1000."""
    return matching(rows, **wanted).orderBy("path", "line", "column").limit(clamp(limit, MOST_REFERENCES))


def nested(nodes: DataFrame) -> DataFrame:
    """Nodes as records with a range of start and end."""
    at = lambda side: F.struct(F.col(f"{side}_line").alias("line"), F.col(f"{side}_byte").alias("byte")).alias(side)
    return nodes.select("id", "path", "name", F.struct(at("start"), at("end")).alias("range"))
