"""Vector, lexical and hybrid search over embeddings, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import postings, search
from .registry import query, table

#: A fixed query vector and text.
PROBE = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
WORDS = "that with tion"
_Q = "[" + ", ".join(map(str, PROBE)) + "]::double[]"
_COS = f"list_cosine_similarity(embedding::double[], {_Q})"


def _scored(df, digits=6):
    return df.withColumn("score", F.round("score", digits))


@query(f"select vec_id, round({_COS}, 6) as score from embeddings order by {_COS} desc, vec_id limit 20")
def vector_topk(spark, sf_dir):
    return _scored(search.top_k(table(spark, sf_dir, "embeddings"), PROBE, 20))


@query(f"select vec_id, round({_COS}, 6) as score from embeddings where label in (1, 3) order by {_COS} desc, vec_id limit 20")
def vector_topk_filtered(spark, sf_dir):
    return _scored(search.top_k(table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3)), PROBE, 20))


@query(f"select vec_id, round(list_dot_product(embedding::double[], {_Q}), 6) as score from embeddings order by list_dot_product(embedding::double[], {_Q}) desc, vec_id limit 20")
def vector_dot(spark, sf_dir):
    return _scored(search.top_k(table(spark, sf_dir, "embeddings"), PROBE, 20, metric="dot"))


@query(f"select vec_id, round(-list_distance(embedding::double[], {_Q}), 6) as score from embeddings order by list_distance(embedding::double[], {_Q}), vec_id limit 20")
def vector_l2(spark, sf_dir):
    return _scored(search.top_k(table(spark, sf_dir, "embeddings"), PROBE, 20, metric="l2"))


_PARAMS = """
with flat as (select unnest(embedding)::double as x, unnest(range(len(embedding)))::integer as position from embeddings),
p as (select position, min(x) as lo, case when max(x) - min(x) <= 1.1920929e-07 then 1.0::double else (max(x) - min(x)) / 255 end as step from flat group by position)
"""


@query(_PARAMS + "select position, lo, round(step, 12) as step from p")
def quantizer_params(spark, sf_dir):
    return search.quantiser(table(spark, sf_dir, "embeddings")).withColumn("step", F.round("step", 12))


@query(
    _PARAMS
    + """, e as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding)))::integer as position from embeddings),
q as (select vec_id, x, lo, step, least(255, greatest(0, round((x - lo) / step))) - 128 as q from e join p using (position))
select vec_id, sum(q)::bigint as code_sum, round(max(abs((q + 128) * step + lo - x)), 9) as worst from q group by vec_id"""
)
def quantize_roundtrip(spark, sf_dir):
    df = search.quantise(table(spark, sf_dir, "embeddings"))
    back = vectors.restored(F.col("q"), F.col("lo"), F.col("step"))
    worst = F.array_max(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double"))))
    return df.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round(worst, 9).alias("worst"))


_ROUGH = (
    _PARAMS
    + f""", qv as (select unnest({_Q}) as x, unnest(range(64))::integer as position),
qq as (select position, least(255, greatest(0, round((x - lo) / step))) - 128 as q from qv join p using (position)),
e as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding)))::integer as position from embeddings),
r as (select vec_id, (sum((least(255, greatest(0, round((e.x - lo) / step))) - 128) * qq.q) / (64 * 16384.0) + 1) / 2 as rough from e join p using (position) join qq using (position) group by vec_id),
f as (select vec_id from r order by rough desc, vec_id limit 40)"""
)


@query(_ROUGH + f" select vec_id, round({_COS}, 6) as score from embeddings where vec_id in (select vec_id from f) order by {_COS} desc, vec_id limit 10")
def two_stage_search(spark, sf_dir):
    return _scored(search.two_stage(table(spark, sf_dir, "embeddings"), PROBE, 10))


@query(
    _ROUGH
    + f""", a as (select vec_id from embeddings where vec_id in (select vec_id from f) order by {_COS} desc, vec_id limit 10),
x as (select vec_id from embeddings order by {_COS} desc, vec_id limit 10)
select count(a.vec_id)::double / count(*) as recall from x left join a using (vec_id)"""
)
def recall_at_k(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return search.recall(search.two_stage(df, PROBE, 10), search.top_k(df, PROBE, 10), "vec_id")


def _bm25_sql(k: int) -> str:
    tokens = search.query_tokens(WORDS)
    tf = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}')))::double as tf{i}" for i, t in enumerate(tokens))
    df = ", ".join(f"sum((tf{i} > 0)::int) as df{i}" for i in range(len(tokens)))
    term = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(tokens)))
    some = " or ".join(f"tf{i} > 0" for i in range(len(tokens)))
    return f"""
b as (select doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents),
t as (select doc_id, len(w)::double as len, {tf} from b),
s as (select count(*) as n, avg(len) as avg, {df} from t),
m as (select doc_id, {term} as bm25 from t, s where {some}),
lex as (select doc_id, bm25, row_number() over (order by bm25 desc, doc_id) as rank from m qualify rank <= {k})"""


@query("with " + _bm25_sql(20) + " select doc_id, round(bm25, 6) as bm25, rank::integer as rank from lex")
def lexical_bm25(spark, sf_dir):
    return search.lexical(text_index(spark, sf_dir), WORDS, 20).withColumn("bm25", F.round("bm25", 6))


def text_index(spark, sf_dir):
    """The words of all documents, shared by the queries that search them."""
    docs = table(spark, sf_dir, "documents")
    return postings.index_of("document words", docs, docs, "doc_id", ["text"], postings.ASCII)


_CHUNK_FIELDS = ["path", "heading", "symbol", "language", "kind", "preview", "text"]
_KNOWLEDGE = "en_an src7 that_with ing vi_le doc0 zzzz"


def _knowledge_sql(limit: int) -> str:
    wanted = postings.phrases(search.query_tokens(_KNOWLEDGE), "[a-z0-9]+")

    def count(field: str, p: tuple[str, ...]) -> str:
        if len(p) == 1:
            return f"len(list_filter({field}, lambda x: starts_with(x, '{p[0]}')))"
        at = " and ".join([*(f"{field}[k + {j}] = '{w}'" for j, w in enumerate(p[:-1])), f"starts_with({field}[k + {len(p) - 1}], '{p[-1]}')"])
        return f"len(list_filter(range(1, len({field}) + {2 - len(p)}), lambda k: {at}))"

    split = lambda c: rf"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    words = ", ".join(f"{split(c)} as w{i}" for i, c in enumerate(_CHUNK_FIELDS))
    length = " + ".join(f"len(w{i})" for i in range(len(_CHUNK_FIELDS)))
    tf = ", ".join(f"({' + '.join(count(f'w{f}', p) for f in range(len(_CHUNK_FIELDS)))})::double as tf{i}" for i, p in enumerate(wanted))
    df = ", ".join(f"sum((tf{i} > 0)::int)::double as df{i}" for i in range(len(wanted)))
    term = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6::double) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * len / avg))" for i in range(len(wanted)))
    some = " or ".join(f"tf{i} > 0" for i in range(len(wanted)))
    return f"""
with c as (
  select doc_id, source || '/doc' || doc_id || '.txt' as path, split_part(coalesce(text, ''), chr(10), 1) as heading, split_part(coalesce(text, ''), ' ', 1) as symbol, lang as language, 'document' as kind,
    left(coalesce(text, ''), 240) as preview, text from documents),
w as (select doc_id, {words} from c),
t as (select doc_id, ({length})::double as len, {tf} from w),
s as (select count(*)::double as n, avg(len) as avg, {df} from t)
select doc_id, round(score, 6) as score from (select doc_id, {term} as score from t, s where {some} order by 2 desc, 1 limit {limit})"""


@query(_knowledge_sql(40))
def knowledge_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    chunks = docs.select(
        "doc_id", F.concat("source", F.lit("/doc"), "doc_id", F.lit(".txt")).alias("path"), F.substring_index(body, "\n", 1).alias("heading"), F.substring_index(body, " ", 1).alias("symbol"), F.col("lang").alias("language"),
        F.lit("document").alias("kind"), F.substring(body, 1, 240).alias("preview"), "text",
    )
    index = postings.index_of("knowledge chunks", docs, chunks, "doc_id", _CHUNK_FIELDS, postings.UNICODE)
    found = search.knowledge(index, _KNOWLEDGE, 40)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id")


def _hybrid_sql(limit: int, where: str = "", keep: str = "") -> str:
    return f"""
with {_bm25_sql(8 * limit)},
vec as (select vec_id as doc_id, {_COS} as vector from embeddings {where} order by vector desc, vec_id limit {4 * limit}),
fused as (select coalesce(vec.doc_id, l.doc_id) as doc_id, vector, 1.0::double / rank as lexical from vec full join (select * from lex {keep}) l on vec.doc_id = l.doc_id),
c as (select *, case when vector is not null and lexical is not null then 0.7 * vector + 0.3 * lexical when vector is not null then 0.95 * vector else 0.85 * lexical end as combined from fused)
select doc_id, round(vector, 6) as vector, round(lexical, 6) as lexical, round(combined, 6) as combined from c order by c.combined desc, doc_id limit {limit}"""


def _rounded(df):
    return df.select("doc_id", *[F.round(c, 6).alias(c) for c in ("vector", "lexical", "combined")])


@query(_hybrid_sql(10))
def hybrid_search(spark, sf_dir):
    return _rounded(search.hybrid(text_index(spark, sf_dir), table(spark, sf_dir, "embeddings"), WORDS, PROBE, 10))


@query(_hybrid_sql(10, "where label = 2", "where doc_id % 2 = 0"))
def hybrid_post_limit_filter(spark, sf_dir):
    return _rounded(search.hybrid(text_index(spark, sf_dir), table(spark, sf_dir, "embeddings"), WORDS, PROBE, 10, allowed=F.col("label") == 2, keep=F.col("doc_id") % 2 == 0))


@query(r"""
with p as (select page_id, url as path, regexp_extract(html, '<title>([^<]*)', 1) as heading from pages),
n as (select *, regexp_replace(lower(path), '[^a-z0-9]+', '', 'g') as slug, trim(regexp_replace(lower(heading), '[^a-z0-9]+', ' ', 'g')) as head from p),
b as (select page_id, 0.05 * (path like 'https%')::int + 0.55 * contains(slug, 'thbleexample')::int
  + case when head = '' then 0 when head = 'thble example' then 0.7 when contains(head, 'thble example') or (contains(head, 'thble') and contains(head, 'example')) then 0.35
    when contains(replace(head, ' ', ''), 'thbleexample') then 0.2 else 0 end as boost from n)
select page_id, round(boost::double, 6) as boost, round(least(1, 0.5 + boost)::double, 6) as score from b order by b.boost desc, page_id limit 50""")
def rerank_boost(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("heading", F.regexp_extract("html", "<title>([^<]*)", 1))
    boost = F.round(search.rank_boost("thble example", F.col("url"), F.col("heading"), F.lit("html"), "https"), 6)
    df = pages.select("page_id", boost.alias("boost")).orderBy(F.desc("boost"), "page_id").limit(50)
    return df.select("page_id", "boost", F.round(F.least(F.lit(1.0), 0.5 + F.col("boost")), 6).alias("score"))


_N = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query(f"""
with v as (select c_custkey, {_N.format('c_name')} as v from customer)
select c_custkey, case when v = 'cust12' then 100 when starts_with(v, 'cust12') then 80 when contains(v, 'cust12') then 60
  when regexp_matches(v, 'c.*u.*s.*t.*1.*2') then greatest(10, 40 - (length(v) - 6)) else 0 end::integer as score from v""")
def fuzzy_score(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.fuzzy_score("cust-12", F.col("c_name")).cast("int").alias("score"))


@query(r"""
with d as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) as t from documents)
select doc_id, case when t = '' then 0 when contains(t, 'that with these') then 0.9
  when contains(t, 'that')::int + contains(t, 'these')::int < 2 then 0 when contains(replace(t, ' ', ''), 'thatthese') then 0.45 + least(0.15, 2.0 / 2 / 3) else 0.35 end::double as score from d""")
def definition_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.definition_score("that with these", F.coalesce("text", F.lit(""))).alias("score"))


@query("""
with a as (select vec_id, label::double as score, 0 as l from embeddings where vec_id % 2 = 0 union all select vec_id, 2.5::double, 1 from embeddings where vec_id % 3 = 0)
select vec_id, score from (select *, row_number() over (partition by vec_id order by score desc, l) as n from a) where n = 1""")
def merge_max_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.merged_best(e.where("vec_id % 2 = 0").select("vec_id", F.col("label").cast("double").alias("score")), e.where("vec_id % 3 = 0").select("vec_id", F.lit(2.5).alias("score")), id_col="vec_id")
