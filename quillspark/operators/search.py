"""Vector, lexical and hybrid search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import postings

# Fixed values of the scoring rules.
BOTH, VECTOR_ONLY, LEXICAL_ONLY = (0.7, 0.3), 0.95, 0.85
K1, B = 1.2, 0.75
VECTOR_OVERFETCH, LEXICAL_OVERFETCH, RESCORE = 4, 8, 4


def clamp(limit: int, most: int = 100) -> int:
    return max(1, min(limit, most))


def query_tokens(query: str) -> list[str]:
    """Up to 16 different lower-case ASCII words of two characters and more."""
    return sorted({t for t in re.findall(r"[a-z0-9_]+", query.lower()) if len(t) > 1})[:16]


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(df: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k rows most similar to the query: id, score; ties to the smaller id.
    The query is part of the plan, and each task keeps k rows."""
    q, v = literal(query), F.col(vector)
    score = {"cosine": vectors.cosine, "dot": vectors.dot, "l2": lambda a, b: -vectors.l2(a, b)}[metric](v, q)
    return df.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def quantiser(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Least value and step of each dimension (position, lo, step)."""
    flat = df.select(F.posexplode(vector).alias("position", "x")).groupBy("position").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    return flat.select("position", "lo", F.when(F.col("hi") - F.col("lo") <= 1.1920929e-07, 1.0).otherwise((F.col("hi") - F.col("lo")) / 255).alias("step"))


def _with_quantiser(df: DataFrame, table: DataFrame) -> DataFrame:
    """One row of parameters, as many as there are dimensions, beside each row."""
    row = table.agg(F.sort_array(F.collect_list(F.struct("position", "lo", "step"))).alias("p")).select(F.col("p.lo").alias("lo"), F.col("p.step").alias("step"))
    return df.join(F.broadcast(row))


def quantise(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with the quantised vector in ``q`` and its parameters in lo and step."""
    return _with_quantiser(df, quantiser(df, vector)).withColumn("q", vectors.quantised(F.col(vector), F.col("lo"), F.col("step")))


def two_stage(df: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best k * RESCORE rows by quantised product, and of these the best k by cosine."""
    q = literal(query)
    coded = quantise(df, vector).withColumn("rough", vectors.rough_cosine(F.col("q"), vectors.quantised(q, F.col("lo"), F.col("step"))))
    first = coded.orderBy(F.desc("rough"), id_col).limit(k * RESCORE)
    return first.select(id_col, vectors.cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def bm25(df: DataFrame, query: str, k: int, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """The k best rows for any of the query's words as prefixes: id, bm25, rank
    (from 1); ties to the smaller id. Only words that a query word begins
    leave the scan; lengths are summed there too."""
    tokens = query_tokens(query)
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    base = df.select(id_col, F.filter(words, lambda w: w != "").alias("words")).withColumn("len", F.size("words"))

    def occurrences(token: str) -> Column:
        return F.size(F.filter("words", lambda w: w.startswith(token)))

    for i, t in enumerate(tokens):
        base = base.withColumn(f"tf{i}", occurrences(t))
    base = base.drop("words")
    stats = base.agg(F.count("len").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(tokens))])
    joined = base.where(" or ".join(f"tf{i} > 0" for i in range(len(tokens))) or "false").join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(tokens)):
        tf, dfi = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - dfi + 0.5) / (dfi + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    best = joined.select(id_col, score.alias("bm25")).orderBy(F.desc("bm25"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("bm25"), id_col)))


def lexical(index: postings.Index, query: str, k: int, id_col: str = "doc_id") -> DataFrame:
    """What ``bm25`` returns, from a written index of words of ASCII letters and digits."""
    wanted = [(t,) for t in query_tokens(query)]
    best = postings.search(index, wanted, k, postings.smoothed_frequency).select(F.col("id").alias(id_col), F.col("score").alias("bm25"))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("bm25"), id_col)))


def knowledge(index: postings.Index, query: str, limit: int) -> DataFrame:
    """The best ``limit`` chunks (id, score) for any of the query's tokens as
    prefixes, over all fields. The index splits words at ``_``, so a token with
    one is a phrase whose last word is a prefix."""
    return postings.search(index, postings.phrases(query_tokens(query), "[a-z0-9]+"), limit)


def fuse(by_vector: DataFrame, by_words: DataFrame, limit: int, id_col: str, keep: Column | None = None) -> DataFrame:
    """Candidates of both searches in one order. ``by_vector``: id, vector;
    ``by_words``: id, rank. ``keep`` filters the lexical side after its limit."""
    lexical = by_words.select(id_col, (1.0 / F.col("rank")).alias("lexical"))
    both = by_vector.join(lexical if keep is None else lexical.where(keep), id_col, "full_outer")
    v, x = F.col("vector"), F.col("lexical")
    combined = F.when(v.isNotNull() & x.isNotNull(), BOTH[0] * v + BOTH[1] * x).when(v.isNotNull(), VECTOR_ONLY * v).otherwise(LEXICAL_ONLY * x)
    return both.withColumn("combined", combined).orderBy(F.desc("combined"), id_col).limit(limit)


def hybrid(chunks: DataFrame | postings.Index, vectors_: DataFrame, query: str, query_vector: list[float], limit: int, chunk_id: str = "doc_id", vec_id: str = "vec_id", allowed: Column | None = None, keep: Column | None = None) -> DataFrame:
    """id, vector, lexical and combined scores of the best ``limit`` chunks.
    ``chunks``: a table, which is read whole, or its index. ``allowed`` restricts
    vectors before their limit, ``keep`` words after theirs."""
    limit = clamp(limit)
    pool = vectors_ if allowed is None else vectors_.where(allowed)
    by_vector = top_k(pool, query_vector, VECTOR_OVERFETCH * limit, vec_id).select(F.col(vec_id).alias(chunk_id), F.col("score").alias("vector"))
    words = lexical if isinstance(chunks, postings.Index) else bm25
    by_words = words(chunks, query, LEXICAL_OVERFETCH * limit, chunk_id)
    return fuse(by_vector, by_words, limit, chunk_id, keep)


def rank_boost(query: str, path: Column, heading: Column, language: Column, docs_prefix: str = "docs/") -> Column:
    """What path, heading and language add to a chunk's score."""
    q = F.lit(query)
    slug, words, pairs = text.rank_slug(q), text.rank_text(q), text.pair_slugs(text.rank_terms(q))
    path_slug, head = text.rank_slug(path), text.rank_text(F.coalesce(heading, F.lit("")))
    head_slug = F.regexp_replace(head, " ", "")
    terms = F.filter(F.split(words, " "), lambda t: F.length(t) > 1)
    boost = F.when(language == "markdown", 0.05).otherwise(0.0) + F.when(path.startswith(docs_prefix), 0.05).otherwise(0.0)
    boost += F.when((slug != "") & F.contains(path_slug, slug), 0.35).otherwise(0.0)
    boost += F.when(F.exists(pairs, lambda p: F.contains(path_slug, p)), 0.2).otherwise(0.0)
    boost += (
        F.when(head == "", 0.0)
        .when(head == words, 0.7)
        .when(F.contains(head, words) | F.forall(terms, lambda t: F.contains(head, t)), 0.35)
        .when(F.exists(pairs, lambda p: F.contains(head_slug, p)), 0.2)
        .otherwise(0.0)
    )
    return F.when(words == "", 0.0).otherwise(boost)


def definition_score(query: str, body: Column) -> Column:
    """0.9 for the whole query, 0.45 and more for a phrase, 0.35 for enough words, else 0."""
    q = F.lit(query)
    terms, words, field = text.rank_terms(q), text.rank_text(q), text.rank_text(body)
    n = F.size(terms)
    overlap = F.size(F.filter(terms, lambda t: F.contains(field, t)))
    phrase = F.exists(text.pair_slugs(terms), lambda p: F.contains(F.regexp_replace(field, " ", ""), p))
    return (
        F.when((n == 0) | (field == ""), 0.0)
        .when(F.contains(field, words), 0.9)
        .when(overlap < F.least(F.lit(2), n), 0.0)
        .when(phrase, 0.45 + F.least(F.lit(0.15), overlap / n / 3))
        .otherwise(0.35)
    )


def merged_best(*lists: DataFrame, id_col: str, score: str = "score") -> DataFrame:
    """One row for each id, that of the greatest score; of equal ones, of the earlier list."""
    union = None
    for i, df in enumerate(lists):
        part = df.withColumn("__list", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc(score), "__list"))
    return union.withColumn("__place", place).where("__place = 1").drop("__place", "__list")


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """Part of ``exact`` that ``found`` has; 1 for an empty ``exact``."""
    hit = exact.select(id_col).join(found.select(id_col, F.lit(1).alias("__hit")), id_col, "left")
    return hit.agg(F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.count("__hit") / F.count(F.lit(1))).alias("recall"))
