"""Text, path, literal and rule queries over documents, pages, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs, text
from ..operators import chunks, facts, joins, rollups, rules
from ..sources import files
from .registry import query, table


@query("select doc_id, sha256(text) as hash from documents")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("hash"))


@query(r"""with l as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) > 240 then rtrim(left(t, 237)) || '...' else t end as preview from l""")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by sha256(text)")
def dedupe_exact(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(text.text_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("select doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as slug, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as words from documents")
def rank_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.rank_slug(F.col("text")).alias("slug"), text.rank_text(F.col("text")).alias("words"))


_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no from documents)"


@query(f"""with {_LINES}
select line as value, count(*) as n, count(distinct doc_id) as n_files, min(doc_id) as first_doc, arg_min(no, (doc_id, no))::integer as first_line
from l where regexp_matches(line, '[A-Za-z0-9]') group by line having count(*) >= 3 and count(distinct doc_id) >= 2""")
def duplicate_literals(spark, sf_dir):
    rows = chunks.lines(table(spark, sf_dir, "documents")).where(F.col("line").rlike("[A-Za-z0-9]"))
    found = rollups.repeated(rows, ["line"], "doc_id", ["doc_id", "line_no"], 3, 2)
    return found.select(F.col("line").alias("value"), "n", "n_files", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


@query(r"""with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{8,}')) as v from documents)
select v as value, count(*) as n, count(distinct doc_id) as n_files from w group by v having count(*) >= 5""")
def repeated_literals(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{8,}"), F.lit(0))).alias("value"))
    return words.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_files")).where("n >= 5")


@query("""with c as (select p_partkey, p_name || p_brand as t, unnest(string_split(p_name || p_brand, '')) as ch from part), n as (select p_partkey, ch, count(*) as k from c group by all),
s as (select p_partkey, sum(k) as n from n group by p_partkey) select n.p_partkey, round(-sum(k / s.n * log2(k / s.n)), 6) as entropy from n join s using (p_partkey) group by n.p_partkey""")
def entropy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.entropy(F.concat("p_name", "p_brand")), 6).alias("entropy"))


_SECRETS = " or ".join(f"regexp_matches(v, '{p}')" for p in text.SECRET_PATTERNS)


@query(rf"""with w as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{12,}}')) as v from documents),
e as (select v, -sum(k::double / n * log2(k::double / n)) as h from (select v, ch, count(*) as k, any_value(length(v)) as n from (select v, unnest(string_split(v, '')) as ch from (select distinct v from w where length(v) >= 32)) group by v, ch) group by v)
select doc_id, v as value from w left join e using (v)
where not regexp_matches(v, '{text.PLACEHOLDER}') and ({_SECRETS} or (length(v) >= 32 and regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]') and h >= 3.5))""")
def secret_literals(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{12,}"), F.lit(0)))).alias("value"))
    return words.where(text.secret_like(F.lit(None).cast("string"), F.col("value")))


@query(r"""with w as (select page_id, unnest([url, regexp_extract(url, '://([^/?#]*)', 1), regexp_extract(url, '://[^/?#]*([^?#]*)', 1)]) as v from pages)
select page_id, v as value, case when regexp_matches(v, '(?i)^https?://[^\s"''`]+$') then 'url' when regexp_matches(v, '^(?:localhost|127(?:\.\d{1,3}){3}|0\.0\.0\.0|::1)$') then 'host'
  when regexp_matches(v, '^\d{4,5}$') and try_cast(v as integer) between 1024 and 65535 then 'port'
  when length(v) >= 4 and (regexp_matches(v, '^(?:\.{0,2}/|~/|/)[A-Za-z0-9._/-]+$') or (regexp_matches(v, '^[A-Za-z0-9._-]+/[A-Za-z0-9._/-]+$') and not starts_with(v, 'docs/'))) then 'path' end as kind from w""")
def config_literals(spark, sf_dir):
    v = F.array("url", F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(v).alias("value")).withColumn("kind", text.config_kind(F.col("value")))


_STYLES = " || ".join(f"case when regexp_matches(v, '{p}') then ['{k}'] else [] end" for k, p in text.NAMING_STYLES)


@query(f"with w as (select p_partkey, replace(p_name, ' ', '_') as v from part union all select p_partkey, p_type from part) select p_partkey, v as name, array_to_string({_STYLES}, ',') as styles from w")
def naming_style(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).union(p.select("p_partkey", "p_type"))
    return w.withColumn("styles", F.array_join(text.naming_styles(F.col("name")), ","))


_KEY = "regexp_replace(regexp_replace(lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '\\b(?:" + "|".join(text.VERB_WORDS) + ")\\b', '', 'g'), '[^a-z0-9]+', '', 'g')"


@query(f"""with p as (select distinct p_name || ' ' || p_type as n from part), k as (select n, {_KEY} as k from p),
x as (select a.n as a, b.n as b, case when a.k = b.k then 1.0 else 1 - levenshtein(a.k, b.k)::double / greatest(length(a.k), length(b.k)) end as s from k a join k b on a.n < b.n and a.k <> '' and b.k <> '')
select a, b, round(s, 6) as similarity from x where s >= 0.82""")
def similar_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("n")).distinct()
    return joins.similar_names(names.select(F.col("n").alias("id"), "n"), "id", "n").withColumn("similarity", F.round("similarity", 6))


_PATH = "regexp_extract(url, '://([^?#]*)', 1)"
_GLOBS = ["*.example.{com,org}/e[ns]/**", "!**/*.html"]
_G1, _G2 = globs.regex_of(_GLOBS[0]), globs.regex_of(_GLOBS[1])


@query(f"with p as (select page_id, {_PATH} as path from pages) select page_id, path from p where regexp_matches(path, '{_G1}') and not regexp_matches(path, '{_G2}')")
def glob_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return p.where(globs.matches(F.col("path"), _GLOBS))


_DEFINITIONS = {"com": ["*.example.com/**"], "english": ["*/en/**", "!www.*/**"], "pages": ["**/*.html"]}


def _fits(patterns):
    rx = lambda p: f"regexp_matches(path, '{globs.regex_of(p)}')"
    yes, no = [rx(p) for p in patterns if p[0] != "!"], [rx(p) for p in patterns if p[0] == "!"]
    return f"({' or '.join(yes)})" + (f" and not ({' or '.join(no)})" if no else "")


@query(f"with p as (select page_id, {_PATH} as path from pages) " + " union all ".join(f"select page_id, '{k}' as definition from p where {_fits(v)}" for k, v in _DEFINITIONS.items()))
def glob_join_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return joins.glob_join(p, "path", _DEFINITIONS).select("page_id", "definition")


@query(f"with p as (select page_id, string_split({_PATH}, '/') as s from pages) select page_id, len(s)::integer as segments, len(list_filter(s, lambda x: x = '..'))::integer as ups from p")
def path_segments(spark, sf_dir):
    parts = F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")
    return table(spark, sf_dir, "pages").select("page_id", F.size(parts).alias("segments"), F.size(F.filter(parts, lambda x: x == "..")).alias("ups"))


@query(f"""with p as (select distinct {_PATH} as path from pages), s as (select path, string_split(path, '/') as s from p),
f as (select path, unnest(list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) as folder from s)
select folder, count(*) as n_files, len(string_split(folder, '/'))::integer as depth from f group by folder""")
def folder_rollup(spark, sf_dir):
    return rollups.folders(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")), "path")


@query("""with c as (select regexp_extract(url, '://([^/?#]*)', 1) || '/' || regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) || '/' || page_id as path, sha256(html) as h from pages),
f as (select path, regexp_replace(path, '/[^/]*$', '') as dir, sha256(string_agg(h, chr(10) order by h)) as h from c group by path),
d as (select dir, regexp_replace(dir, '/[^/]*$', '') as up, sha256(string_agg(h, chr(10) order by h)) as h from f group by dir),
t as (select up, sha256(string_agg(h, chr(10) order by h)) as h from d group by up),
r as (select sha256(string_agg(h, chr(10) order by h)) as h from t)
select path || '#' || h as node, 'chunk' as kind, path as parent, h as hash from c union all select path, 'file', dir, h from f union all select dir, 'dir', up, h from d
union all select up, 'dir', '.', h from t union all select '.', 'root', null, h from r""")
def merkle_tree(spark, sf_dir):
    part = lambda x: F.regexp_extract("url", x, 1)
    leaves = table(spark, sf_dir, "pages").select(F.concat_ws("/", part("://([^/?#]*)"), part("://[^/?#]*/([^/?#]*)"), "page_id").alias("path"), text.text_hash(F.col("html")).alias("h"))
    return rollups.hash_tree(leaves, "path", "h", 2)


@query("""with o as (select doc_id, sha256(text) as h from documents where doc_id % 3 <> 0), n as (select doc_id, case when doc_id % 5 = 0 then sha256(text || 'x') else sha256(text) end as h from documents where doc_id % 4 <> 0)
select coalesce(n.doc_id, o.doc_id) as doc_id, case when o.h is null then 'added' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'changed' end as change from n full join o on n.doc_id = o.doc_id""")
def delta_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 3 <> 0").select("doc_id", text.text_hash(F.col("text")).alias("h"))
    new = d.where("doc_id % 4 <> 0").select("doc_id", text.text_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return rollups.diff(new, old, "doc_id", "h")


@query("""select count(*) as files, sum((l.doc_id is not null)::int)::bigint as indexed, sum((coalesce(quality, 0) = 1)::int)::bigint as governed, sum((coalesce(quality, 0) <> 1)::int)::bigint as ungoverned, sum((coalesce(toxic, 0) = 1)::int)::bigint as stale
from documents d left join labels l on d.doc_id = l.doc_id""")
def coverage_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("seen", F.lit(1)), "doc_id", "left")
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return rollups.coverage(d, F.col("seen").isNotNull(), one("quality"), one("toxic"))


@query("select count(*) filter (lang = 'en') as en, count(*) filter (lang = 'de') as de, count(*) filter (lang = 'xx') as xx from documents")
def kind_counts(spark, sf_dir):
    return rollups.kind_counts(table(spark, sf_dir, "documents"), "lang", ["en", "de", "xx"])


@query(r"with a as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages) select page_id, target, count(*) as n from a group by all")
def html_links_graph(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with t as (select doc_id, unnest(regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9_-]*)', 1)) as tag from documents)
select doc_id, regexp_replace(regexp_replace(lower(tag), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as tag from t""")
def annotation_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.annotation_tags(F.col("text"))).alias("tag"))


@query(r"""with h as (select doc_id, sha256(text) as h from documents) select doc_id from h where h not in (select h from h where doc_id < 200)""")
def feedback_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("h"))
    return d.join(d.where("doc_id < 200").select("h").distinct(), "h", "left_anti").select("doc_id")


@query(r"""with f as (
  select 'short-text' as rule_id, 'warning' as severity, 'doc/' || doc_id as file, length(text) as n from documents where length(text) < 120 union all
  select 'license-line', 'error', 'doc/' || doc_id, length(text) from documents where regexp_matches(text, 'GNU|Apache License'))
select rule_id, severity, file, coalesce(l.toxic, 0) = 1 as known from f left join labels l on f.file = 'doc/' || l.doc_id""")
def findings_union_sorted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    registry = {
        "a": lambda c: rules.findings(c.files.where(F.length("text") < 120), "short-text", F.lit("short"), "warning", file="path"),
        "b": lambda c: rules.findings(c.files.where(F.col("text").rlike("GNU|Apache License")), "license-line", F.lit("license"), file="path"),
    }
    found = rules.run(rules.Context({"files": d}), registry)
    known = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc/"), "doc_id").alias("file"), (F.col("toxic") == 1).alias("known"))
    found = rules.in_order(found.join(known, "file", "left"))
    return found.select("rule_id", "severity", "file", F.coalesce("known", F.lit(False)).alias("known"))


_GATE = ["doc_id", "gate", "rule_id", "severity", "file", "scope"]
_GATE_SQL = "doc_id, 'commit' as gate, case when quality = 1 then 'q' else 'p' end as rule_id, case when toxic = 1 then 'error' else 'warning' end as severity, 'doc/' || doc_id as file, case when doc_id % 3 = 0 then null else 's' || doc_id % 3 end as scope"


@query(f"""with f as (select {_GATE_SQL} from labels), a as (select distinct {_GATE_SQL.replace("doc_id % 3 = 0", "doc_id % 6 = 0")} from labels where quality = 1)
select {", ".join("f." + c for c in _GATE)}, a.gate is not null as approved from f left join a on {" and ".join(f"f.{c} is not distinct from a.{c}" for c in _GATE)}""")
def gate_resolution(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")

    def gates(rows, every):
        scope = F.when(F.col("doc_id") % every != 0, F.concat(F.lit("s"), F.col("doc_id") % 3))
        return rows.select("doc_id", F.lit("commit").alias("gate"), F.when(F.col("quality") == 1, "q").otherwise("p").alias("rule_id"), F.when(F.col("toxic") == 1, "error").otherwise("warning").alias("severity"), F.concat(F.lit("doc/"), "doc_id").alias("file"), scope.alias("scope"))

    return rules.gates(gates(labels, 3), gates(labels.where("quality = 1"), 6), _GATE)


@query("select doc_id, source from documents order by source, doc_id limit 50 offset 100")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("source", "doc_id").offset(100).limit(50).select("doc_id", "source")




_HEADED = "html"
for _n in range(1, 7):
    _HEADED = f"regexp_replace({_HEADED}, '<h{_n}[^>]*>', chr(10) || '{'#' * _n} ', 'g')"
_HEADED = f"regexp_replace(regexp_replace({_HEADED}, '<(?:script|style|pre)>', chr(10) || '```' || chr(10), 'g'), '</(?:h[1-6]|script|style|pre)>', chr(10), 'g')"


@query(rf"""with t as (select page_id as doc_id, string_split(regexp_replace({_HEADED}, '<[^>]*>|&[a-z]+;', '', 'g'), chr(10)) as a from pages),
r as (select doc_id, len(a) as n, unnest(range(1, len(a) + 1)) as no, unnest(a) as line from t),
f as (select *, regexp_matches(line, '^\s{{0,3}}(```|~~~)') as is_fence, sum(regexp_matches(line, '^\s{{0,3}}(```|~~~)')::int) over (partition by doc_id order by no) % 2 = 1 as odd from r),
h as (select doc_id, n, no, length(regexp_extract(line, '^(#{{1,6}})\s', 1)) as level, regexp_extract(line, '^#{{1,6}}\s+(.+?)\s*#*\s*$', 1) as heading from f where not is_fence and not odd and regexp_matches(line, '^#{{1,6}}\s+(.+?)\s*#*\s*$'))
select a.doc_id, a.heading, a.level::integer as level, a.no::integer as start_line, coalesce(min(b.no) - 1, a.n)::integer as end_line
from h a left join h b on a.doc_id = b.doc_id and b.no > a.no and b.level <= a.level group by a.doc_id, a.heading, a.level, a.no, a.n""")
def markdown_sections(spark, sf_dir):
    body = F.col("html")
    for n in range(1, 7):
        body = F.regexp_replace(body, f"<h{n}[^>]*>", "\n" + "#" * n + " ")
    body = F.regexp_replace(F.regexp_replace(body, "<(?:script|style|pre)>", "\n```\n"), "</(?:h[1-6]|script|style|pre)>", "\n")
    d = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(body, "<[^>]*>|&[a-z]+;", "").alias("text"))
    return chunks.sections(d).select("doc_id", "heading", "level", "start_line", "end_line")


@query()
def markdown_chunks(spark, sf_dir):
    return chunks.markdown_chunks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "start_byte", "end_byte", "chunk_hash", "preview")


@query()
def fact_extract_python(spark, sf_dir):
    return facts.python_facts(files.generated(spark, 20, 1))


@query(r"""with recursive t as (select doc_id, text, regexp_extract_all(text, '\s*[\p{L}\p{N}_]+|\s*[^\s\p{L}\p{N}_]|\s+$') as w from documents where length(text) > 0),
u as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as k from t),
v as (select doc_id, k, regexp_extract(w, '^\s*') as s, (sum(length(w)) over (partition by doc_id order by k))::integer - length(w) as o from u),
b as (select doc_id, count(*)::integer as n, list(o + length(s) order by k) as o, list(case when contains(s, chr(10)) then o + length(regexp_extract(s, '^[\s\S]*\n')) else -1 end order by k) as ln, list(case when s <> '' then o + length(s) else -1 end order by k) as bl from v group by doc_id),
r as (
  select doc_id, -1 as piece_no, 0 as start, 0 as e, 1 as i, 0 as n_tokens from b
  union all
  select r.doc_id, piece_no + 1, r.e, f.e::integer, f.i::integer, (f.i - r.i)::integer from r join b on b.doc_id = r.doc_id and r.i <= b.n,
    lateral (select least(r.i + 64, b.n + 1) as j) x,
    lateral (select case when x.j > b.n then null else b.o[x.j] end as at, list_max(b.ln[r.i:x.j]) as ml, list_max(b.bl[r.i:x.j]) as mb) y,
    lateral (select r.e + (y.at - r.e) // 2 as half) z,
    lateral (select case when y.at is null then (select length(text) from t where t.doc_id = r.doc_id) when y.ml > z.half then y.ml when y.mb > z.half then y.mb else y.at end as e,
      case when y.at is null then x.j when y.ml > z.half then r.i - 1 + list_position(b.ln[r.i:x.j], y.ml) when y.mb > z.half then r.i - 1 + list_position(b.bl[r.i:x.j], y.mb) else x.j end as i) f)
select r.doc_id, piece_no, start, e as "end", n_tokens, md5(substr(text, start + 1, e - start)) as piece_md5 from r join t using (doc_id) where piece_no >= 0""")
def token_pieces(spark, sf_dir):
    """Pieces of all documents with at most 64 words and marks each."""
    found = chunks.token_pieces(table(spark, sf_dir, "documents"), 64, "doc_id", "text")
    return found.select("doc_id", "piece_no", "start", "end", "n_tokens", F.md5("piece").alias("piece_md5"))


_ID = "left(md5(base || ':duplicate:' || {n} || ':' || doc_id % 50), 4)"


def _free_ids_sql(rounds: int) -> str:
    """The rounds one after the other; the last select fails the comparison if rows still wait."""
    steps, done = [], "select doc_id, base, base as unique_id from d where n = 1"
    for k in range(1, rounds + 1):
        waiting = "select doc_id, base from d where n > 1" if k == 1 else f"select doc_id, base from c{k - 1} where doc_id not in (select doc_id from g{k - 1})"
        steps.append(f"c{k} as materialized (select *, {_ID.format(n=k)} as unique_id from ({waiting}))")
        steps.append(f"g{k} as materialized (select doc_id, base, unique_id from (select *, row_number() over (partition by unique_id order by doc_id) as m from c{k} where unique_id not in (select unique_id from ({done}))) where m = 1)")
        done += f" union all select doc_id, base, unique_id from g{k}"
    return f"with b as (select doc_id, lang || '-' || length(text) % 40 as base from documents), d as (select *, row_number() over (partition by base order by doc_id) as n from b), {', '.join(steps)} {done}"


@query(_free_ids_sql(9))
def chunk_ids(spark, sf_dir):
    """Short ids, so that some collide again and again. Four hexadecimal digits give 65,536; with more documents
    than that (and one for each base) some have no id, here as in the SQL, and it is an error."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("-"), F.length("text") % 40).alias("base"))
    digest = lambda base, n: F.left(F.md5(F.concat(base, F.lit(":duplicate:"), n.cast("string"), F.lit(":"), (F.col("doc_id") % 50).cast("string"))), F.lit(4))
    return chunks.free_ids(d, "base", ["doc_id"], digest, alike=[F.col("doc_id") % 50], space=16**4)
