"""Composed search, index stage, rule and record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs, records
from ..functions import text as texts_
from ..operators import chunks, context, index, joins, rules, search
from .registry import ORACLES, query, table

_SLUG = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


def _fuzzy(column, needle):
    v, scattered = _SLUG.format(column), ".*".join(needle)
    return f"case when {v} = '{needle}' then 100 when starts_with({v}, '{needle}') then 80 when contains({v}, '{needle}') then 60 when regexp_matches({v}, '{scattered}') then greatest(10, 40 - (length({v}) - {len(needle)})) else 0 end"


_LINES = "l as (select doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) as line, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) as no from documents)"


@query(f"with {_LINES}, s as (select doc_id, no::integer as line_no, {_fuzzy('line', 'thenthe')} as score from l) select doc_id, line_no, score::integer as score from s where score > 0")
def doc_line_search(spark, sf_dir):
    return context.line_search(table(spark, sf_dir, "documents"), "then the").select("doc_id", "line_no", F.col("score").cast("int").alias("score"))


@query(f"""with {_LINES}, u as (
  select 'doc' as kind, coalesce(source, '') || '/' || doc_id as path, no::varchar as title, {_fuzzy('line', 'ring')} as score from l join documents using (doc_id) union all
  select 'symbol', p_brand || '/' || p_partkey, p_name, {_fuzzy('p_name', 'ring')} from part union all
  select 'validator', 'web/' || s_suppkey, s_name, {_fuzzy('s_name', 'ring')} from supplier)
select kind, path, title, score::integer as score from u where score > 0 and (starts_with(path, 'web/') or starts_with(path, 'Brand#7/')) order by score desc, kind, path, title limit 40""")
def unified_search(spark, sf_dir):
    d, p, s = (table(spark, sf_dir, t) for t in ("documents", "part", "supplier"))
    by_line = context.line_search(d.select(F.concat_ws("/", F.coalesce("source", F.lit("")), "doc_id").alias("path"), "text"), "ring", "path").select(F.lit("doc").alias("kind"), "path", F.col("line_no").cast("string").alias("title"), "score")
    fuzzy = lambda df, kind, path, title: df.select(F.lit(kind).alias("kind"), path.alias("path"), F.col(title).alias("title"), texts_.fuzzy_score("ring", F.col(title)).alias("score")).where("score > 0")
    found = [by_line, fuzzy(p, "symbol", F.concat_ws("/", "p_brand", "p_partkey"), "p_name"), fuzzy(s, "validator", F.concat(F.lit("web/"), "s_suppkey"), "s_name")]
    return context.unified(found, 40, ("web", "Brand#7")).withColumn("score", F.col("score").cast("int"))


_PATH = "regexp_extract(url, '://([^?#]*)', 1)"
_OWNERS = {"spanish-pages": ("all spanish pages of the site", ["*/es/**"]), "pages": ("pages", ["**/*.html"]), "other": ("something else", ["*/de/**"])}


@query(f"""with p as (select page_id, {_PATH} as path from pages),
s as (select page_id, path, case when regexp_matches(path, '{globs.regex_of("*/es/**")}') then 0.9 else 0.0 end as a, case when regexp_matches(path, '{globs.regex_of("**/*.html")}') then 0.0 else 0.0 end as b from p)
select page_id, path, case when contains(path, '/es/7') then 1.0 else 0.75 end::double as score from s where greatest(a, b) > 0""")
def owned_search(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    scores = context.file_scores(p, "path", _OWNERS, "spanish pages")
    signal = F.when(F.contains(F.col("path"), F.lit("/es/7")), 0.2).otherwise(0.0)
    return context.owned_results(p, scores, F.lit(0.0), signal).select("page_id", "path", "score")


def _context_search(spark, sf_dir):
    from .search import hybrid_search

    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), "doc_id").alias("path"), F.col("lang").alias("language"))
    found = hybrid_search(spark, sf_dir).select("doc_id", F.col("combined").alias("score"))
    owned = d.where("language = 'es'").select("doc_id", F.lit(0.25).alias("score"))
    both = [x.join(d, "doc_id") for x in (found, owned)]
    return context.context_search(*both, "web 12", 100, "doc_id", F.col("language"), F.lit("web")).select("doc_id", "path", "score")


_CONTEXT_SQL = f"""h as (select doc_id, combined as score, 0 as l from ({ORACLES['hybrid_search']}) union all select doc_id, 0.25::double, 1 from documents where lang = 'es'),
m as (select doc_id, score from (select *, row_number() over (partition by doc_id order by score desc, l) as n from h) where n = 1),
r as (select m.doc_id, concat_ws('/', coalesce(source, ''), m.doc_id) as path, score from m join documents d on d.doc_id = m.doc_id),
c as (select doc_id, path, least(1.0::double, score + case when contains({_SLUG.format('path')}, 'web12') then 0.35::double + 0.2::double else 0.0::double end) as score from r order by 3 desc, 1 limit 100)"""


@query(f"with {_CONTEXT_SQL} select doc_id, path, round(score, 6) as score from c")
def context_search(spark, sf_dir):
    return _context_search(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"with {_CONTEXT_SQL}, t as (select *, row_number() over (order by score desc, doc_id) as n from c) select string_agg(n || '. ' || path, chr(10) order by n) filter (n <= 4) as answer, count(*) filter (n <= 6) as n_results from t")
def context_answer(spark, sf_dir):
    return context.answer(_context_search(spark, sf_dir), "doc_id", "path")


@query("""with c as (select conv_id, count(*) as n from conversations group by conv_id), f as (select d.doc_id, coalesce(c.n, 0) as n, coalesce(l.quality, 0) = 1 as governed, coalesce(l.toxic, 0) = 1 as stale from documents d left join c on c.conv_id = d.doc_id left join labels l on l.doc_id = d.doc_id)
select 'ungoverned' as gap, doc_id from f where not governed union all select 'unindexed', doc_id from f where n = 0 union all select 'stale', doc_id from f where stale""")
def coverage_gaps(spark, sf_dir):
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    one = lambda x: F.coalesce(F.col(x) == 1, F.lit(False))
    files = context.chunk_counts(d, c, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "n_chunks", one("quality").alias("governed"), one("toxic").alias("stale"))
    return context.gaps(files, "doc_id")


@query(f"""select 'part' as kind, p_partkey::varchar as id from part where contains(lower(p_name), 'red') or contains(lower(p_partkey::varchar), 'red') union
select 'finding', 'd' || doc_id from documents where contains(lower(text), 'red') union select 'file', {_PATH} from pages where contains(lower({_PATH}), 'red')""")
def link_search(spark, sf_dir):
    p, d, g = (table(spark, sf_dir, t) for t in ("part", "documents", "pages"))
    nodes = p.select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"))
    return context.link_search(" Red ", nodes, d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("message")), g.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")))


@query(f"""with c as (select regexp_extract(url, '://([^?#]*)', 1) as path, page_id::varchar as ordinal, 'c' || page_id as id from pages)
select path, ordinal, id from c where regexp_matches(path, '{globs.regex_of("*/es/**")}') order by path, ordinal::integer, id limit 40 offset 5""")
def chunk_listing(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.col("page_id").cast("string").alias("ordinal"), F.concat(F.lit("c"), "page_id").alias("id"))
    return context.chunk_list(c, None, {"es": ["*/es/**"]}, ["es", "nothing"], 40, 5)


_FOUND = "f as (select 'doc/' || source as file, doc_id::integer as line, 'short-text' as rule_id, 'warning' as severity, 'short ' || length(text) as message from documents where length(text) < 200)"


def _found(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") < 200)
    return rules.findings(d.select(F.concat(F.lit("doc/"), "source").alias("file"), F.col("doc_id").alias("line"), "text"), "short-text", F.concat(F.lit("short "), F.length("text")), "warning")


@query(f"with {_FOUND} select file, count(*) as n, string_agg(line || ':' || message, '|' order by line, message) as findings from f where file is not null group by file")
def findings_by_file(spark, sf_dir):
    lined = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["line"], x["message"])), "|")
    return context.by_file(_found(spark, sf_dir)).where("file is not null").select("file", "n", lined.alias("findings"))


@query(f"""with {_FOUND}, d as (select file, unnest(case when file = 'doc/web' then ['a', 'b'] else ['b'] end) as definition from (select distinct file from f where file is not null)),
k as (select definition, 'short-text' || chr(0) || file || chr(0) || line || chr(0) || message as key from d join f using (file)) select definition, count(*) as n_findings, array_to_string(list_sort(list(distinct key))[1:6], '|') as evidence from k group by definition""")
def definition_evidence(spark, sf_dir):
    found = _found(spark, sf_dir)
    names = F.when(F.col("file") == "doc/web", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    covered = found.where("file is not null").select("file").distinct().withColumn("definition", F.explode(names))
    return context.evidence(found, covered).withColumn("evidence", F.array_join("evidence", "|"))


@query("""select distinct 's' || l_suppkey as source, 'owns' as relation, 'p' || l_partkey as target from lineitem union select distinct 's' || l_suppkey, 'depends-on', 's' || (l_suppkey + 1) from lineitem where l_linenumber > 2 union select distinct 's' || l_suppkey, 'downstream', 'o' || l_orderkey % 10 from lineitem""")
def domain_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    me = F.concat(F.lit("s"), "l_suppkey").alias("source")
    named = lambda relation, p, c, rows=li: rows.select(me, F.lit(relation).alias("relation"), F.concat(F.lit(p), c).alias("target"))
    return context.domain_edges(named("owns", "p", F.col("l_partkey")), named("depends-on", "s", F.col("l_suppkey") + 1, li.where("l_linenumber > 2")), named("downstream", "o", F.col("l_orderkey") % 10))


_SURFACES, _CONVENTIONS = {"es": ["*/es/**"], "html": ["**/*.html"], "none": ["nothing/**"]}, {"c-en": ["*/en/**"], "c-html": ["*/**/*.html"]}


@query(f"""with p as (select distinct {_PATH} as path from pages),
t as (select path, 'es' as surface from p where regexp_matches(path, '{globs.regex_of("*/es/**")}') union all select path, 'html' from p where regexp_matches(path, '{globs.regex_of("**/*.html")}')),
c as (select path, 'c-en' as c from p where regexp_matches(path, '{globs.regex_of("*/en/**")}') union all select path, 'c-html' from p where regexp_matches(path, '{globs.regex_of("*/**/*.html")}'))
select surface, count(distinct path) as n_files, coalesce(array_to_string(list_sort(list(distinct c) filter (c is not null)), ','), '') as conventions, case surface when 'es' then 'k1,k2' else '' end as checks from t left join c using (path) group by surface""")
def surface_checks(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    checks = spark.createDataFrame([("es", "k2"), ("es", "k1"), ("gone", "k3")], "surface string, check string")
    return context.surface_checks(p, "path", _SURFACES, _CONVENTIONS, checks).withColumn("conventions", F.array_join("conventions", ",")).withColumn("checks", F.array_join("checks", ","))


@query(f"with o as (select distinct {_PATH} as path from pages where not (regexp_matches({_PATH}, '{globs.regex_of('*/e[ns]/**')}'))) select count(*) as n_outside, array_to_string((list_sort(list(path)))[1:8], ',') as files from o")
def scope_drift(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return context.scope_drift(p, "path", ["*/e[ns]/**"]).withColumn("files", F.array_join("files", ","))


@query("with c as (select coalesce(lang, '-') as language, doc_id, case doc_id % 4 when 0 then 'stale' when 1 then 'warming' when 2 then 'idle' else 'odd' end as status from documents), r as (select *, row_number() over (partition by language order by case status when 'ready' then 0 when 'warming' then 1 when 'stale' then 2 else 3 end, doc_id) as n from c) select language, status from r where n = 1")
def producer_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    status = F.coalesce(*[F.when(F.col("doc_id") % 4 == i, F.lit(s)) for i, s in enumerate(("stale", "warming", "idle"))], F.lit("odd"))
    return context.authoritative(d.select(F.coalesce("lang", F.lit("-")).alias("language"), F.col("doc_id").alias("ordinal"), status.alias("status")), ["ready", "warming", "stale"])


@query(r"select doc_id, regexp_matches(array_to_string((regexp_split_to_array(text, '\r?\n'))[1:12], chr(10)), '(?i)(?m)^\s*licensed under\b|apache') as excluded, case when doc_id % 3 = 0 then 'markdown' when source = 'web' then 'code' end as producer from documents")
def index_selection(spark, sf_dir):
    path = F.concat(F.lit("d/x"), F.when(F.col("doc_id") % 3 == 0, ".MD").otherwise(".ts"))
    return table(spark, sf_dir, "documents").select("doc_id", index.excluded(F.col("text"), (r"^\s*licensed under\b", "apache")).alias("excluded"), index.producer(path, F.col("source") == "web").alias("producer"))


@query("""with o as (select l_suppkey as path, l_partkey as v, case l_linenumber % 4 when 0 then 'import' when 1 then 'export' when 2 then 'call' else 'literal' end as kind, min(l_orderkey) as o from lineitem group by 1, 2, 3),
r as (select *, row_number() over (partition by path, kind order by o, 'v' || v) as n from o),
s as (select path, kind, string_agg('v' || v, ', ' order by o, 'v' || v) as t from r where n <= case when kind in ('import', 'export') then 24 else 32 end group by path, kind)
select path, string_agg(kind || 's: ' || t, chr(10) order by case kind when 'import' then 0 when 'export' then 1 when 'call' then 2 else 3 end) as summary from s group by path""")
def fact_summaries(spark, sf_dir):
    kinds = ("import", "export", "call")
    kind = F.coalesce(*[F.when(F.col("l_linenumber") % 4 == i, F.lit(k)) for i, k in enumerate(kinds)], F.lit("literal"))
    return index.fact_summary(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), kind.alias("kind"), F.concat(F.lit("v"), "l_partkey").alias("value"), F.col("l_orderkey").alias("ordinal")))


@query("""with o as (select doc_id, sha256('p1' || chr(0) || sha256(text)) as h from documents where doc_id % 3 <> 0), n as (select doc_id, sha256(case when doc_id % 7 = 0 then 'p2' else 'p1' end || chr(0) || sha256(text)) as h from documents where doc_id % 4 <> 0)
select count(*) filter (o.h is null) as added, count(*) filter (o.h <> n.h) as changed, count(*) filter (n.h is null) as removed, count(*) filter (o.h = n.h) as reused from n full join o on n.doc_id = o.doc_id""")
def build_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("c", texts_.text_hash(F.col("text")))
    old = d.where("doc_id % 3 <> 0").withColumn("h", index.embedding_hash(F.col("c"), "p1"))
    new = d.where("doc_id % 4 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, index.embedding_hash(F.col("c"), "p2")).otherwise(index.embedding_hash(F.col("c"), "p1")))
    return index.build_stats(old, new, "doc_id", "h")


@query("select conv_id, sha256(string_agg(turn || chr(0) || role || chr(0) || sha256(text), chr(10) order by turn || chr(0) || role || chr(0) || sha256(text))) as hash from conversations group by conv_id")
def chunk_tree_hash(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("h", texts_.text_hash(F.col("text"))).withColumn("turn", F.col("turn").cast("string"))
    return index.tree_hash(c, "conv_id", ["turn", "role", "h"])


@query("select c.conv_id, c.turn, d.doc_id is null or (d.lang <> 'en' and d.lang is not null) or (d.lang is null and c.role <> 'user') or c.role <> 'user' as stale from conversations c left join documents d on d.doc_id = c.conv_id * 2")
def stale_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 2).alias("path"), "conv_id", "turn", F.lit("en").alias("content_hash"), F.col("role").alias("provider"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("lang", F.lit("en")).alias("content_hash"))
    return index.stale_chunks(c, files, "user").select("conv_id", "turn", "stale")


@query(f"with p as (select distinct string_split({_PATH}, '/') as s from pages where page_id % 3 = 0) select distinct unnest(list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) as node from p union select '.'")
def invalid_nodes(spark, sf_dir):
    return index.invalid_nodes(table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")), "path")


@query("""with n as (select vec_id, embedding from embeddings where vec_id % 3 = 0 union all select vec_id, embedding[1:5] from embeddings where vec_id % 9 = 0)
select vec_id, 'dimension' as problem from n where len(embedding) <> (select max(len(embedding)) from embeddings) union select vec_id, 'duplicate' from n group by vec_id having count(*) > 1 union select vec_id, 'exists' from n where vec_id % 2 = 0""")
def insert_problems(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = e.select(F.max(F.size("embedding"))).first()[0]
    batch = e.where("vec_id % 3 = 0").union(e.where("vec_id % 9 = 0").select("vec_id", F.slice("embedding", 1, 5)))
    return index.insert_problems(e.where("vec_id % 2 = 0"), batch, "vec_id", "embedding", size)


_PATTERNS = ["*.example.{com,org}/e[ns]/**", "!**/*.html"]


@query(f"with p as (select page_id, {_PATH} as path from pages) " + " union all ".join(f"select page_id, '{g}' as pattern, {str(g.startswith('!')).lower()} as negated, regexp_matches(path, '{globs.regex_of(g)}') as matched from p" for g in _PATTERNS))
def glob_explain(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return p.join(globs.explained(p.select("path").distinct(), "path", _PATTERNS), "path").select("page_id", "pattern", "negated", "matched")


@query(f"with p as (select page_id, {_PATH} as path from pages) select page_id, regexp_matches(path, '{globs.regex_of('*/e[ns]/**')}') and not regexp_matches(path, '{globs.regex_of('**/*.html')}') and regexp_matches(path, '{globs.regex_of('*.com/**')}') as fits from p")
def scoped_targets(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return p.select("page_id", globs.in_every_scope(F.col("path"), [["*/e[ns]/**", "!**/*.html"], ["*.com/**"]]).alias("fits"))


@query(f"with p as (select distinct {_PATH} as path from pages) select path from p where starts_with(path, 't') union select path from p where regexp_matches(path, '{globs.regex_of('*/de/**')}')")
def widened_targets(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return rules.widened(p, p.where("path like 't%'"), ["*/de/**"])


@query("select p_partkey as id from part where p_partkey in (3, 5) or p_brand in ('Brand#3', 'Brand#4') or p_type = 'PROMO'")
def validator_selection(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", F.lit("x")).alias("topics"), F.array("p_type").alias("conventions"))
    return rules.selected(v, [3, 5], ["Brand#3", "Brand#4"], ["PROMO"]).select("id")


@query(f"with p as (select distinct {_PATH} as path from pages where page_id % 2 = 0) select min(path) as file, 'surface es requires approval' as message from p where regexp_matches(path, '{globs.regex_of('*/es/**')}') having count(*) > 0")
def sensitive_changes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    rule = rules.sensitive_changes({"es": ["*/es/**"], "html": ["**/*.html"]}, {"es": ["approval"], "html": ["docs"]}, "approval")
    return rule(rules.Context({"changed": p})).select("file", "message")


@query("""with f as (select doc_id, case when doc_id % 5 = 0 then 'x' else 'r' end as rule_id, case when doc_id % 7 = 0 then 'bad' else 'error' end as severity, source as file, (doc_id % 4)::integer as line, text as message from documents),
p as (select doc_id, list_filter([case when rule_id <> 'r' then 'unknown rule' end, case when severity = 'bad' then 'invalid severity' end, case when coalesce(file, '') = '' then 'missing file' end, case when line < 1 then 'invalid line' end, case when coalesce(message, '') = '' then 'missing message' end], lambda x: x is not null) as p from f)
select doc_id, array_to_string(p, ',') as problems from p where len(p) > 0""")
def malformed_findings(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    found = d.select(k, F.when(k % 5 == 0, "x").otherwise("r").alias("rule_id"), F.when(k % 7 == 0, "bad").otherwise("error").alias("severity"), F.col("source").alias("file"), (k % 4).cast("int").alias("line"), F.col("text").alias("message"))
    return rules.malformed(found, ["r"]).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("""select doc_id as path, '[' || substr(text, 3, 4) || ']' || substr(text, 9) as text from documents where length(text) >= 12 and doc_id % 2 = 0""")
def fixed_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 12).select(F.col("doc_id").alias("path"), "text")
    edit = lambda a, b, x, s="safe": F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("replacement"), F.lit(s).alias("safety"))
    edits = d.select(F.col("path").alias("file"), F.inline(F.when(F.col("path") % 2 == 0, F.array(edit(0, 2, "["), edit(6, 8, "]"), edit(1, 3, "?", "manual"))).otherwise(F.array(edit(0, 5, "x"), edit(4, 6, "y")))))
    return rules.fixed_texts(d, edits).select("path", "text")


@query(r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no, unnest(string_split(text, chr(10))) as line from documents),
m as (select doc_id, no, unnest(regexp_extract_all(line, '[0-9]+')) as match, unnest(range(1, len(regexp_extract_all(line, '[0-9]+')) + 1)) as k, regexp_split_to_array(line, '[0-9]+') as b, regexp_extract_all(line, '[0-9]+') as f from l)
select doc_id, no::integer as line, (1 + list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k-1], lambda x: length(x))), 0))::integer as "column", match from m""")
def pattern_sites(spark, sf_dir):
    rows = chunks.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", F.inline(records.matches_with_columns(F.col("line"), "[0-9]+"))).withColumnRenamed("line_no", "line")


@query("""with t as (select doc_id, text, string_split(text, chr(10)) as s, 1 + doc_id % 4 as l, 1 + doc_id % 9 as c from documents)
select doc_id, case when l <= len(s) and c <= length(s[l]) + 1 then coalesce(list_sum(list_transform(s[1:l - 1], lambda x: length(x) + 1)), 0)::bigint + c - 1 end::bigint as at from t""")
def text_offsets(spark, sf_dir):
    at = records.offset_of(F.col("text"), (1 + F.col("doc_id") % 4).cast("int"), (1 + F.col("doc_id") % 9).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", at.cast("long").alias("at"))


@query("""with c as (select doc_id, unnest(string_split(regexp_replace(text, '[^(\\[{)\\]}]+', '', 'g'), '')) as c, unnest(range(1, length(text) + 1)) as n from documents), s as (select doc_id, n, case when c in ('(', '[', '{') then 1 when c in (')', ']', '}') then -1 else 0 end as d from c where c is not null),
r as (select doc_id, n, sum(d) over w as u from s window w as (partition by doc_id order by n)), q as (select doc_id, u - least(0, min(u) over (partition by doc_id order by n)) as depth from r)
select d.doc_id, coalesce(max(depth), 0)::integer as depth from documents d left join q using (doc_id) group by d.doc_id""")
def bracket_depths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(records.bracket_depth(F.col("text")), F.lit(0)).alias("depth"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k, md5(event_id::varchar) as trace, '00-' || md5(event_id::varchar) || '-' || left(md5(user_id::varchar), 16) || case when event_id % 2 = 0 then '-01' else '-00' end as traceparent,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') < '2024-01-15T00:00:00Z' as early from events""")
def event_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    trace, span = F.md5(F.col("event_id").cast("string")), F.left(F.md5(F.col("user_id").cast("string")), F.lit(16))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = records.ordinal_of(F.replace("props", F.lit('"k"'), F.lit('"ordinal"')))
    return e.select("event_id", k.alias("k"), trace.alias("trace"), records.traceparent(trace, span, F.col("event_id") % 2 == 0).alias("traceparent"), records.iso_before(at, F.lit("2024-01-15T00:00:00Z")).alias("early"))


@query("select event_id, unnest(['a' || user_id, event_type]) as item from events")
def json_items(spark, sf_dir):
    payload = F.to_json(F.array(F.concat(F.lit("a"), "user_id"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(records.json_items(payload)).alias("item"))


@query("""select doc_id, 'r:' || left(sha256('{"rule":"r","file":' || to_json(source) || ',"line":' || doc_id || ',"column":0}'), 16) as finding_id,
  sha256('r' || chr(0) || 'error' || chr(0) || source || chr(0) || doc_id || chr(0) || '0' || chr(0) || lang) as fingerprint, sha256('{"a":' || doc_id || ',"lang":' || to_json(lang) || ',"z":' || to_json(source) || '}') as canonical,
  case when lang = 'en' and source = 'web' then 'camel' when lang = 'de' and source = 'web' then 'snake' end as idiom from documents where source is not null and lang is not null""")
def finding_identities(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    fields = {"rule": F.lit("r"), "file": F.col("source"), "line": F.col("doc_id"), "column": F.lit(0)}
    mark = records.fingerprint(F.lit("r"), F.lit("error"), F.col("source"), F.col("doc_id"), F.lit(None).cast("int"), F.col("lang"))
    whole = records.canonical_hash({"z": F.col("source"), "a": F.col("doc_id"), "lang": F.col("lang")})
    return d.select("doc_id", records.finding_id(F.lit("r"), fields).alias("finding_id"), mark.alias("fingerprint"), whole.alias("canonical"), records.naming_idiom(F.col("lang"), F.col("source"), {("en", "web"): "camel", ("de", "web"): "snake"}).alias("idiom"))


@query(f"with p as (select distinct p_brand || '#' || p_partkey as n from part) select n from p where starts_with(n, 'Brand#1#')")
def names_under(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat_ws("#", "p_brand", "p_partkey").alias("n")).where(globs.under(F.col("n"), "Brand#1")).distinct()
