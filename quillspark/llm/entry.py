"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, conversations, decontamination, langid, linededup, mixing, sharding, similarity, substrings, topk, toxicity, urlfilter

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES: list[urlfilter.Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = [f"shard-{k:02d}" for k in range(16)]
SLOTS = 5003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_groups(table(spark, sf_dir, "documents"), words=3, ratio=Fraction(9, 10))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS, slot_out="slot")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.paragraph_groups(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def _url_sql() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return rf"""
with rules(verdict, rhost, rpath) as (values {values}),
parts as (
  select page_id,
    case when url like '%://%' then translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
ranked as (
  select p.page_id, p.host, p.path, r.rhost || r.rpath as rule, r.verdict,
    row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc nulls last) as n
  from parts p left join rules r on p.host <> '' and (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from ranked where n = 1
"""


def _shard_sql() -> str:
    slots = ", ".join(map(str, sharding.lookup_table(SHARDS, SLOTS)))
    return f"""
with t as (select doc_id, cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % {SLOTS} as integer) as slot from documents)
select doc_id, slot, 'shard-' || lpad(cast([{slots}][slot + 1] as varchar), 2, '0') as shard from t
"""


def _mix_sql() -> str:
    return r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, length(text) as chars,
    cast('0x' || substr(md5(concat_ws(':', '11', cast(doc_id as varchar), text)), 1, 13) as bigint) as h
  from documents),
k as (
  select *, -ln((h + 0.5::double) / 4503599627370496::double) / (case when chars::double / greatest(size, 1) between 3 and 13 then 1.0::double else 0.25::double end) as key from d),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n from k group by source),
w as (select *, [3, 1, 2][((n - 1) % 3 + 1)::bigint]::double as w, 2.0::double * source_size as cap from s),
o as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, n rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, n rows between current row and unbounded following) as level from w),
l as (select arg_min(level, n2) as level from (select level, row_number() over (order by cap / w, n) as n2 from o where level <= cap / w)),
t as (select o.source, source_size, coalesce(least(cap, w * l.level), cap) as target from o, l),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
r as (
  select k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    sum(size) over (partition by k.source order by key, h, doc_id rows between unbounded preceding and current row) as upto
  from k join e on k.source is not distinct from e.source),
c as (select *, (epochs + (rest > 0 and upto + upto - size <= 2 * rest and size > 0)::int)::integer as copies from r)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies from c
"""


_DECONTAMINATION_SQL = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bs as (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as g from bs),
ds as (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from bw) where len(w) >= n),
dw as (select r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as g from ds),
m as (select dw.r, dw.n, dw.s, bw.item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from m) group by r),
it as (select r, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct r, cast(item_id as varchar) as i from m where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join it using (r)
"""

_TOP_K_SQL = """
with e as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.r as r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from e q join e c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select query_id, vec_id, score, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank from p) where rank <= 5
"""

_JACCARD_SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, array_to_string(list_slice(w, k, k + least(len(w), 3) - 1), ' ') as g from (select r, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) as k from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
o as (select a.r as x, b.r as y, count(*) as o from s a join s b on a.g = b.g and a.r <> b.r group by all),
e as (select x, y from o join n p on p.r = x join n q on q.r = y where 100 * o >= 90 * (p.n + q.n - o)),
reach as (select r as x, r as y from d union select reach.x, e.y from reach join e on e.x = reach.y),
c as (select x, min(doc_id) as component_id from reach join d on d.r = reach.y group by x),
k as (select x, count(*) as n_links from e group by x)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
from d join c on c.x = d.r left join n on n.r = d.r left join k on k.x = d.r
"""

_SUBSTRING_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, doc_id, k, substr(h, 2 * k + 1, 100) as g from (select r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) as k from d)),
f as (select g, min(doc_id) as first from w group by g),
z as (select r, k, max(k) over (partition by r order by k rows between unbounded preceding and 1 preceding) as b from w join f using (g) where first < doc_id),
i as (select r, k, sum(case when b is null or k > b + 50 then 1 else 0 end) over (partition by r order by k) as run from z),
g as (select r, run, min(k) as a, max(k) + 50 as b from i group by r, run),
q as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as c from g),
t as (select r, count(*) as n, sum(b - a) as gone, max(b) as e from q group by r),
u as (select q.r, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' order by a) as kept from q join d on d.r = q.r group by q.r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(case when n is null then h else kept || substr(h, 2 * e + 1) end)) as kept_sha256
from d left join t on t.r = d.r left join u on u.r = d.r
"""

_LINES_SQL = """
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, -9223372036854775808) as id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, id, unnest(lines) as line, unnest(range(len(lines))) as i from d),
k as (
  select r, id, i, line, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, max(id) as last from k where length(key) >= 20 group by key having count(distinct r) >= 3),
j as (select r, i, line, coalesce(id < last, false) as gone from k left join g using (key)),
t as (select r, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept from j group by r)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from d join t using (r)
"""



def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    near = lambda c: f"""(
  select r, any_value(v) as v, any_value(vec_id) as vec_id, arg_min(c, (d, c)) as c, min(d) as d from (
    select e.r, e.vec_id, e.v, k.c, list_sum(list_transform(list_zip(e.v, k.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d from e, {c} k) group by r)"""  # noqa: E731
    steps = [
        f"k{n + 1} as (select k.c, coalesce(m.v, k.v) as v from k{n} k left join (select c, list(cast((s - ((s % n) + n) % n) / n as bigint) order by i) as v from ("
        f"select c, i, sum(x)::bigint as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as i from {near(f'k{n}')}) group by c, i) group by c) m on m.c = k.c)"
        for n in range(rounds)
    ]
    return f"""
with e as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
k0 as (select c, v from (select v, row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1 as c from e) where c < {k}),
{", ".join(steps)},
z as {near(f"k{rounds}")}
select vec_id, z.c::integer as cluster, d as distance, (sum(d) over (partition by z.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(k.v, ',')) as centroid_sha256
from z join k{rounds} k on k.c = z.c
"""


def _repair_sql() -> str:
    """Distances to the end and audits are carried backward over the symbols of
    a conversation, as (cost, audit) for each of the four states."""
    state = lambda k: f"acc.s{k}"
    step = lambda cost, letter, s: f"{{'c': {cost} + {s}.c, 'a': '{letter}' || {s}.a}}"
    fill, kept = (2, 2, 3, 2), {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
    never = "{'c': 1000000000, 'a': ''}"

    def base(q: int) -> str:
        extra = "case when x between 'A' and 'Z' then 3 else 0 end"
        keep = " ".join(f"when lower(x) = '{i}' then {step(extra, 'K', state(to[q]))}" for i, to in kept.items() if to[q] is not None)
        rerole = f"case when x = '-' then {never} else {step(f'3 + {extra}', 'R', state(fill[q]))} end"
        return f"list_min([{step(4, 'D', state(q))}, {rerole}, case {keep} else {never} end])"

    def inserted(b: str) -> str:
        two, three = f"list_min([{b}.s2, {step(3, 'I', f'{b}.s3')}])", f"list_min([{b}.s3, {step(3, 'I', f'{b}.s2')}])"
        return f"{{'s0': list_min([{b}.s0, {step(3, 'I', f'({two})')}]), 's1': list_min([{b}.s1, {step(3, 'I', f'({two})')}]), 's2': {two}, 's3': {three}}}"

    bases = "{" + ", ".join(f"'s{q}': {base(q)}" for q in range(4)) + "}"
    ends = f"{{'s0': {{'c': 0, 'a': ''}}, 's1': {never}, 's2': {never}, 's3': {{'c': 0, 'a': ''}}}}"
    shift = "xor(z // 2, case when z % 2 = 1 then 3988292384 else 0 end)"
    crc = f"xor(list_reduce(list_transform(string_split(k, ''), lambda t: ord(t)::bigint), lambda z0, t: list_reduce(range(8), lambda z, n: {shift}, xor(z0, t)), 4294967295::bigint), 4294967295)"
    filled = "case when q in (0, 1, 3) then 2 else 3 end"
    return rf"""
with recursive r as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
f as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as fate from r),
d as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when fate = 3 then 2 else 1 end)) as copy from f where fate <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as seq from d),
o as (
  select *, row_number() over (partition by conv_id, role, text order by seq) > 1 as again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from n),
g as (
  select *, left(role, 1) as initial, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by seq) as before from o),
y as (select *, case when initial in ('s', 'u', 'a') then initial else 'o' end as good from g),
h as (select *, case when fault in ('blank', 'duplicate') then '-' when fault = 'truncated' then upper(good) else good end as symbol from y),
c as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank')::bigint as blank, count(*) filter (fault = 'duplicate')::bigint as duplicate,
    count(*) filter (fault = 'truncated')::bigint as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au'))::bigint as illegal, list(symbol order by seq desc) as symbols
  from h group by conv_id),
b as (select *, list_reduce(symbols, lambda acc, x: list_transform([{bases}], lambda w: {inserted("w")})[1], {inserted(ends)}) as best from c),
p as (select *, best.s0.c::bigint as cost, best.s0.a as audit from b),
walk as (
  select conv_id, audit, 1 as pos, 0 as seq, 0 as q, ''::varchar as done, ''::varchar as sep from p
  union all
  select w.conv_id, w.audit, w.pos + 1, w.seq + (w.letter <> 'I')::int,
    case w.letter when 'D' then q when 'K' then (case h.initial when 's' then 1 when 'u' then 2 else 3 end) else {filled} end,
    case w.letter when 'D' then done else done || sep || (case when w.letter = 'K' then h.role when {filled} = 2 then 'user' else 'assistant' end) || ':' || (case when w.letter = 'I' then '' else h.text end) end,
    case when w.letter = 'D' then sep else chr(10) end
  from (select *, substr(audit, pos, 1) as letter from walk where pos <= length(audit)) w left join h on h.conv_id is not distinct from w.conv_id and h.seq = w.seq + 1),
z as (select conv_id, done from walk where pos = length(audit) + 1)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(done, '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join p on p.conv_id is not distinct from a.conv_id left join z on z.conv_id is not distinct from a.conv_id
"""


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_url_filters": op2_url_filters,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_top_k": op8_top_k,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_paragraph_dedup": op10_paragraph_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": _url_sql(),
    "op3_jaccard_join": _JACCARD_SQL,
    "op4_mixing": _mix_sql(),
    "op6_decontamination": _DECONTAMINATION_SQL,
    "op7_sharding": _shard_sql(),
    "op8_top_k": _TOP_K_SQL,
    "op9_suffix_dedup": _SUBSTRING_SQL,
    "op11_line_dedup": _LINES_SQL,
    "op12_conversation_repair": _repair_sql(),
    "op13_centroid_clustering": _cluster_sql(),
}
