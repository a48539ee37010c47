"""Literals in their contexts, and what values match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first role that holds is a literal's context.
CONTEXTS = ("const-object", "test-title", "type-union", "object-property", "array-item", "comparison", "argument")
SITE = ["file", "line", "column"]


def value_matches(value: Column, text: str | None = None, regex: str | None = None) -> Column:
    """Whether a value holds ``text``, or has a match of ``regex``."""
    return value.contains(text) if text is not None else value.rlike(regex)


def ignored(value: Column, texts: list[str], regexes: list[str] = []) -> Column:  # noqa: B006
    """Whether a value equals one of ``texts`` (a part doesn't count) or has a match of a regex."""
    tests = [value.isin(*texts)] * bool(texts) + [value.rlike(r) for r in regexes]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def context_of(roles: Column) -> Column:
    """The context of a literal from the array of its roles; ``unknown`` without one."""
    return F.coalesce(*[F.when(F.array_contains(roles, c), F.lit(c)) for c in CONTEXTS], F.lit("unknown"))


def typed(literals: DataFrame, types: DataFrame) -> DataFrame:
    """``literals`` with ``surrounding_type`` from ``types`` (file, line, column, display), null where no type is known."""
    return literals.join(types.select(*SITE, F.col("display").alias("surrounding_type")), SITE, "left")


def queried(literals: DataFrame, types: DataFrame, value_kind: str | None = None, contexts: list[str] | None = None, declarations: list[str] | None = None, surrounding: list[str] | None = None) -> DataFrame:
    """Literals that fit every filter given, with their types. Filters by kind,
    context and declaration reach the scan; only what they leave is joined."""
    df = literals
    if value_kind:
        df = df.where(F.col("value_kind") == value_kind)
    for column, wanted in (("context", contexts), ("declaration", declarations)):
        if wanted is not None:
            df = df.where(F.col(column).isin(*wanted))
    df = typed(df, types)
    return df if surrounding is None else df.where(F.col("surrounding_type").isin(*surrounding))


def comparison_sites(literals: DataFrame) -> DataFrame:
    return literals.where("context = 'comparison'").select(*SITE)
