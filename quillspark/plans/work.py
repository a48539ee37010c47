"""Work-state and definition queries over events, nations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import definitions, work
from .registry import query, table

_KINDS = {"signup": "claimed", "view": "started", "click": "check-started", "error": "check-failed", "purchase": "closed"}
_KIND_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _KINDS.items()) + " end"
_STATE_SQL = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in work.TASK_STATES.items()) + " end"


def _states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _KINDS.items()])
    log = e.select("event_id", "ts", F.col("user_id").alias("task"), F.when(kind.startswith("check"), F.lit("c1")).alias("check"), kind.alias("kind"))
    tasks = e.select(F.col("user_id").alias("task"), F.array(F.lit("c1")).alias("checks")).distinct()
    leases = tasks.where("task % 5 = 0").select(F.concat(F.lit("l"), "task").alias("lease_id"), "task", F.lit("active").alias("status"), F.lit(1).alias("updated_at"), F.lit("a").alias("agent"))
    return work.task_states(tasks, log, leases)


_TASKS = f"""with l as (select user_id as task, {_KIND_SQL} as kind, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events),
s as (select l.task, l.task % 5 = 0 as leased, case when l.task % 5 = 0 and (kind is null or kind = 'claimed') then 'claimed' else coalesce({_STATE_SQL}, 'planned') end as status
  from l where n = 1)"""


@query(_TASKS + " select task, status, leased from s")
def task_states(spark, sf_dir):
    return _states(spark, sf_dir)


@query(_TASKS + """, b as (select a.task, a.task + 3 as blocker, case when d.task is null then 'missing' else 'open' end as reason from s a left join s d on d.task = a.task + 3 where d.task is null or d.status <> 'closed')
select task, blocker, reason from b""")
def task_blockers(spark, sf_dir):
    states = _states(spark, sf_dir)
    return work.blockers(states, states.select("task", (F.col("task") + 3).alias("needs")))


@query("select page_id, coalesce(list_sort(list_filter([case when regexp_matches(url, '^https.*') then 'secure' end, case when url like '%.html' then 'static' end], lambda x: x is not null)), [])::varchar as definitions from pages")
def file_coverage(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("://"), F.lit("/")).alias("path"))
    found = definitions.file_coverage(pages, "path", {"secure": ["https/**"], "static": ["**/*.html"]})
    return pages.join(found, "path").select("page_id", F.concat(F.lit("["), F.array_join("definitions", ", "), F.lit("]")).alias("definitions"))


@query("""with l as (select distinct p_name as id, case when l_linenumber = 1 then 'owns' else 'uses' end as relation, l_suppkey::varchar as target from lineitem join part on p_partkey = l_partkey)
select 'duplicate-id' as code, p_name as id, p_brand as detail from part group by p_brand, p_name having count(*) > 1
union all select 'missing-title', p_name, p_brand from part where p_type = 'SMALL'
union all select 'missing-reference', id, target from l where target not in (select s_suppkey::varchar from supplier where s_suppkey % 10 <> 0)
union all select 'duplicate-ownership', target, min(id) from l where relation = 'owns' group by target having count(distinct id) > 1""")
def definition_diagnostics(spark, sf_dir):
    part, li, s = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    defs = part.select(F.col("p_brand").alias("kind"), F.col("p_name").alias("id"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("title"))
    links = li.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_name").alias("id"), F.when(F.col("l_linenumber") == 1, "owns").otherwise("uses").alias("relation"), F.col("l_suppkey").cast("string").alias("target")).distinct()
    return definitions.diagnostics(defs, links, s.where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").cast("string").alias("id")))


#: Definitions made of parts: kind, first letter, every how many, and their keys.
_DEFINED = [
    ("validator", "v", 5, {"file": "concat('file', k + 1)", "topic": "concat('t', k - k % 10)", "convention": "concat('c', k + 5)", "doc": "concat('d', k)"}),
    ("convention", "c", 5, {"topic": "concat('t', k - k % 10 + 30)", "validator": "concat('v', k + 10)", "file": "concat('file', k + 2)", "doc": "concat('d', k + 20)", "convention": "concat('c', k + 15)"}),
    ("surface", "s", 7, {"convention": "concat('c', k - k % 5)", "topic": "concat('t', k - k % 10 + 50)", "file": "concat('file', k + 3)", "doc": "concat('d', k + 1)"}),
    ("area", "a", 6, {"file": "concat('file', k + 4)", "doc": "concat('d', k)", "surface": "concat('s', k - k % 7)"}),
    ("spec", "p", 8, {"file": "concat('file', k)", "doc": "concat('d', k + 2)", "convention": "concat('c', k - k % 5)", "area": "concat('a', k - k % 6)", "surface": "concat('s', k - k % 7 + 7)"}),
    ("change", "h", 9, {"file": "concat('file', k + 5)", "doc": "concat('d', k + 3)", "convention": "concat('c', k - k % 5 + 5)", "area": "concat('a', k - k % 6 + 6)", "spec": "concat('p', k - k % 8)", "surface": "concat('s', k - k % 7)"}),
]
_FINDING = {"file": "concat('file', l_partkey)", "validator": "concat('v', l_partkey - l_partkey % 5)", "convention": "concat('c', l_suppkey - l_suppkey % 5)"}
_SEED = "select 'file' as kind, concat('file', p_partkey) as id from part where p_partkey % 397 = 5 union all select 'topic', 't1000' union all select 'convention', 'c600' union all select 'validator', 'v300' union all select distinct 'finding', concat('f', l_orderkey) from lineitem where l_orderkey % 3001 = 9 and l_linenumber = 7"


def _related_sql() -> str:
    keys = [f"select '{kind}' as kind, concat('{letter}', k) as id, '{name}' as key_kind, {key} as key from (select p_partkey as k from part where p_partkey % {every} = 0)" for kind, letter, every, links in _DEFINED for name, key in links.items()]
    keys += [f"select 'finding', concat('f', l_orderkey), '{name}', {key} from lineitem where l_linenumber = 7" for name, key in _FINDING.items()]
    listed = lambda names: "(" + ", ".join(f"'{n}'" for n in ("", *names)) + ")"
    steps, found = [f"n0 as materialized (select distinct kind, id from ({_SEED}))", "f0 as materialized (select kind, id from n0 where false)"], 0
    for i, s in enumerate(definitions.RELATED_STEPS):
        mine = f"(select * from keys where kind = '{s.kind}')"
        if s.by or s.own:
            hit = f"select m.kind, m.id from {mine} m join n{i} n on n.kind = m.key_kind and n.id = m.key where n.kind in {listed(s.by)}"
            own = f" union select m.kind, m.id from {mine} m join n{i} n on n.kind = m.kind and n.id = m.id" if s.own else ""
            steps.append(f"f{found + 1} as materialized (select kind, id from f{found} union {hit}{own})")
            found += 1
        taken = f"select m.key_kind, m.key from {mine} m join f{found} f on f.kind = m.kind and f.id = m.id where m.key_kind in {listed(s.collect)}"
        named = f" union select kind, id from f{found} where kind = '{s.kind}'" if s.known else ""
        steps.append(f"n{i + 1} as materialized (select kind, id from n{i} union {taken}{named})")
    return f"with keys as materialized (select distinct * from ({' union all '.join(keys)})), {', '.join(steps)} select kind, id from f{found}"


@query(_related_sql())
def related_context(spark, sf_dir):
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    k = part.select(F.col("p_partkey").alias("k"))
    pairs = lambda links: F.explode(F.array(*[F.struct(F.lit(name).alias("key_kind"), F.expr(key).alias("key")) for name, key in links.items()])).alias("x")
    keys = li.where("l_linenumber = 7").select(F.lit("finding").alias("kind"), F.concat(F.lit("f"), "l_orderkey").alias("id"), pairs(_FINDING))
    for kind, letter, every, links in _DEFINED:
        keys = keys.union(k.where(F.col("k") % every == 0).select(F.lit(kind).alias("kind"), F.concat(F.lit(letter), "k").alias("id"), pairs(links)))
    files = part.where("p_partkey % 397 = 5").select(F.lit("file").alias("kind"), F.concat(F.lit("file"), "p_partkey").alias("id"))
    named = spark.createDataFrame([("topic", "t1000"), ("convention", "c600"), ("validator", "v300")], "kind string, id string")
    findings = li.where("l_orderkey % 3001 = 9 and l_linenumber = 7").select(F.lit("finding"), F.concat(F.lit("f"), "l_orderkey")).distinct()
    return definitions.related_context(files.union(named).union(findings), keys.select("kind", "id", "x.key_kind", "x.key").distinct())
