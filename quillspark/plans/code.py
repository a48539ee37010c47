"""Symbol, import, literal and lifecycle queries over parts, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports, lifecycle, literals, rules, symbols
from .registry import query, table

_NODES = """n as (select p_partkey as id, p_brand || '/' || replace(p_name, ' ', '_') as path, p_name as name, p_type || '.' || p_name as qualified_name, p_type as kind, 'size ' || p_size as signature, p_size as start_line from part),
w as (select *, list_filter(string_split(regexp_replace(lower(name || ' ' || qualified_name || ' ' || kind || ' ' || path || ' ' || signature), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') as ws from n),
c as (select *, len(ws)::double as dl, len(list_filter(ws, lambda x: starts_with(x, 'ri')))::double as t0, len(list_filter(ws, lambda x: starts_with(x, 'brand')))::double as t1 from w),
s as (select count(*)::double as n, avg(dl) as a, sum((t0 > 0)::int)::double as d0, sum((t1 > 0)::int)::double as d1 from c),
f as (select c.*, -(greatest(ln((s.n - d0 + 0.5) / (d0 + 0.5)), 1e-6::double) * t0 * 2.2::double / (t0 + 1.2::double * (0.25::double + 0.75::double * dl / a))) - greatest(ln((s.n - d1 + 0.5) / (d1 + 0.5)), 1e-6::double) * t1 * 2.2::double / (t1 + 1.2::double * (0.25::double + 0.75::double * dl / a)) as raw from c, s where t0 > 0 and t1 > 0)"""


def _nodes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("path"), F.col("p_name").alias("name"), F.concat("p_type", F.lit("."), "p_name").alias("qualified_name"),
        F.col("p_type").alias("kind"), F.concat(F.lit("size "), "p_size").alias("signature"), F.col("p_size").alias("start_line"),
    )


@query(f"with {_NODES} select id, path, name, kind, start_line, round(raw, 6) as score from f where kind = 'ECONOMY' order by round(raw, 9), path, start_line, id limit 60")
def symbol_search(spark, sf_dir):
    found = symbols.symbols(_nodes(spark, sf_dir), "Ri* brand", kind="ECONOMY", limit=60)
    return found.select("id", "path", "name", "kind", "start_line", F.round("score", 6).alias("score"))


@query(f"with {_NODES} select id, path, kind, start_line from n where kind = 'PROMO' order by path, start_line, id limit 500")
def symbol_list(spark, sf_dir):
    return symbols.symbols(_nodes(spark, sf_dir), None, kind="PROMO", limit=5000).select("id", "path", "kind", "start_line")


@query("select l_orderkey as path, l_linenumber as line, l_suppkey as \"column\", p_name as name from lineitem join part on l_partkey = p_partkey where p_name = 'red widget' and l_suppkey = 3 order by 1, 2, 3 limit 1000")
def reference_search(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("column"), F.col("p_name").alias("name"))
    return symbols.references(refs, 9999, name="red widget", column=3, path=None)


@query("select id, path, name, '{\"start\":{\"line\":' || l || ',\"byte\":' || b || '},\"end\":{\"line\":' || l + 3 || ',\"byte\":' || b + 40 || '}}' as range from (select p_partkey as id, p_brand as path, p_name as name, p_size as l, p_partkey * 7 as b from part)")
def symbol_records(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("start_line"), (F.col("p_partkey") * 7).alias("start_byte"), (F.col("p_size") + 3).alias("end_line"), (F.col("p_partkey") * 7 + 40).alias("end_byte"))
    return symbols.nested(n).withColumn("range", F.to_json("range"))


_FILES = """f as (select distinct 'src/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || case p_partkey % 3 when 0 then '.ts' when 1 then '.tsx' else '/index.js' end as path from part),
q as (select p_partkey as k, 'src/' || replace(p_brand, '#', '') as dir, replace(p_brand, '#', '') as b, replace(p_name, ' ', '_') as n from part),
i as (select distinct a.dir || '/' || a.n || '.ts' as path, case l_suppkey % 6 when 0 then './' || t.n when 1 then '../' || t.b || '/' || t.n when 2 then '@app/' || t.b || '/' || t.n
  when 3 then 'pkg-' || t.b || '/' || t.n when 4 then 'pkg-' || t.b else 'react/' || t.n end as source from lineitem join q a on a.k = l_partkey join q t on t.k = l_suppkey * 3),
pk as (select distinct 'pkg-' || b as name, dir as root from q),
e(ending, place) as (values ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.svelte', 5), ('.json', 6), ('/index.ts', 7), ('/index.tsx', 8), ('/index.js', 9), ('/index.jsx', 10), ('/index.svelte', 11)),
b as (
  select path, source, null as package, 0 as step, case when starts_with(source, './') then regexp_replace(path, '/[^/]*$', '') || substr(source, 2) else 'src' || substr(source, 3) end as base from i where starts_with(source, '.')
  union all select path, source, null, 1, 'src/' || substr(source, 6) from i where starts_with(source, '@app/')
  union all select path, source, name, 2 + k, case when source = name then root || case k when 0 then '/src/index' else '/index' end else root || case k when 0 then '' else '/src' end || substr(source, length(name) + 1) end
    from i join pk on source = name or starts_with(source, name || '/'), (select unnest([0, 1]) as k)),
h as (select b.path, b.source, arg_min(f.path, step * 100 + place) as target, min(step) as s from b, e join f on f.path = b.base || e.ending group by b.path, b.source),
r as (select i.path, i.source, h.target, case when starts_with(i.source, '.') then case when h.target is null then 'unresolved' else 'relative' end when h.s = 1 then 'alias' when g.package is not null then 'workspace' else 'external' end as resolution,
  case when h.s = 1 then null else g.package end as package from i left join h using (path, source) left join (select distinct path, source, package from b where package is not null) g using (path, source)),
o as (select r.*, 'pkg-' || regexp_extract(path, '^src/([^/]*)', 1) as from_package, coalesce(package, 'pkg-' || nullif(regexp_extract(target, '^src/([^/]*)', 1), '')) as to_package, case when starts_with(source, '../') then 1 else 0 end as depth from r)"""
_ALIASES = (imports.Alias("@app/*", ("*",), base="src"),)


def _modules(spark, sf_dir):
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    brand, name, key = F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey")
    folder = F.concat(F.lit("src/"), brand)
    files = part.select(F.concat_ws("/", folder, F.concat(name, F.when(key % 3 == 0, ".ts").when(key % 3 == 1, ".tsx").otherwise("/index.js"))).alias("path")).distinct()
    a = part.select(key.alias("l_partkey"), F.concat(folder, F.lit("/"), name, F.lit(".ts")).alias("path"))
    t = part.select(key.alias("__t"), brand.alias("b"), name.alias("n"))
    kind = F.col("l_suppkey") % 6
    both = li.select("l_partkey", "l_suppkey").distinct().join(a, "l_partkey").join(t, F.col("l_suppkey") * 3 == F.col("__t"))
    forms = [F.concat(F.lit("./"), "n"), F.concat(F.lit("../"), "b", F.lit("/"), "n"), F.concat(F.lit("@app/"), "b", F.lit("/"), "n"), F.concat(F.lit("pkg-"), "b", F.lit("/"), "n"), F.concat(F.lit("pkg-"), "b")]
    source = F.coalesce(*[F.when(kind == i, f) for i, f in enumerate(forms)], F.concat(F.lit("react/"), "n"))
    wanted = both.select("path", source.alias("source")).distinct()
    return wanted, files, part.select(F.concat(F.lit("pkg-"), brand).alias("name"), folder.alias("root")).distinct()


@query(f"with {_FILES} select path, source, resolution, target, from_package, to_package, depth::integer as depth from o")
def import_graph(spark, sf_dir):
    return imports.import_graph(*_modules(spark, sf_dir), _ALIASES).select("path", "source", "resolution", "target", "from_package", "to_package", "depth")


@query(f"""with {_FILES} select 'package:pkg-' || regexp_extract(path, '^src/([^/]*)', 1) as source, 'holds' as relation, 'file:' || path as target, 1::bigint as n from f
union all select 'file:' || path, 'imports', 'file:' || target, count(*) from o where target is not null and path <> target group by path, target
union all select 'package:' || from_package, 'imports', 'package:' || to_package, count(*) from o where to_package is not null and from_package <> to_package group by from_package, to_package""")
def repo_graph(spark, sf_dir):
    wanted, files, packages = _modules(spark, sf_dir)
    return imports.repo_graph(imports.import_graph(wanted, files, packages, _ALIASES), files, packages)


_LITERALS = """l as (select o_orderpriority as file, o_custkey::integer as line, o_orderkey as \"column\", o_orderstatus || '-' || o_orderkey % 7 as value, case when o_orderkey % 5 = 0 then 'number' else 'string' end as value_kind,
  case o_orderkey % 3 when 0 then 'comparison' when 1 then 'argument' else 'unknown' end as context, 'd' || o_orderkey % 4 as declaration from orders),
t as (select o_orderpriority as file, o_custkey::integer as line, o_orderkey as \"column\", c_mktsegment as display from orders join customer on c_custkey = o_custkey where o_orderkey % 2 = 0)"""


def _literals(spark, sf_dir):
    o, c, key = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), F.col("o_orderkey")
    site = [F.col("o_orderpriority").alias("file"), F.col("o_custkey").cast("int").alias("line"), key.alias("column")]
    role = F.when(key % 3 == 0, F.array(F.lit("argument"), F.lit("comparison"))).when(key % 3 == 1, F.array(F.lit("argument"))).otherwise(F.array().cast("array<string>"))
    rows = o.select(*site, F.concat("o_orderstatus", F.lit("-"), key % 7).alias("value"), F.when(key % 5 == 0, "number").otherwise("string").alias("value_kind"), literals.context_of(role).alias("context"), F.concat(F.lit("d"), key % 4).alias("declaration"))
    types = o.where("o_orderkey % 2 = 0").join(c, F.col("c_custkey") == F.col("o_custkey")).select(*site, F.col("c_mktsegment").alias("display"))
    return rows, types


@query(f"with {_LITERALS} select file, line, \"column\", value, display as surrounding_type from l join t using (file, line, \"column\") where value_kind = 'string' and context in ('comparison', 'argument') and declaration in ('d0', 'd2') and display in ('HOUSEHOLD', 'MACHINERY')")
def literal_query(spark, sf_dir):
    found = literals.queried(*_literals(spark, sf_dir), "string", ["comparison", "argument"], ["d0", "d2"], ["HOUSEHOLD", "MACHINERY"])
    return found.select(*literals.SITE, "value", "surrounding_type")


@query(f"with {_LITERALS} select file, line, \"column\", display as surrounding_type from l left join t using (file, line, \"column\") where context = 'comparison'")
def comparison_sites(spark, sf_dir):
    rows, types = _literals(spark, sf_dir)
    return literals.typed(literals.comparison_sites(rows), types)


@query(f"with {_LITERALS} select \"column\", contains(value, 'F-1') as by_text, regexp_matches(value, '^[OP]-[3-5]$') as by_regex, value = 'F-1' or regexp_matches(value, '-6$') as ignored from l")
def literal_matches(spark, sf_dir):
    v = F.col("value")
    return _literals(spark, sf_dir)[0].select("column", literals.value_matches(v, text="F-1").alias("by_text"), literals.value_matches(v, regex="^[OP]-[3-5]$").alias("by_regex"), literals.ignored(v, ["F-1"], ["-6$"]).alias("ignored"))


@query(f"""with {_LITERALS}, k as (select * from l where value_kind = 'string' and value <> 'F-1')
select arg_min(file, (file, line, \"column\")) as file, arg_min(line, (file, line, \"column\")) as line, 'appears ' || count(*) || ' times in ' || count(distinct file) || ' files' as message from k group by value having count(*) >= 4 and count(distinct file) >= 2""")
def boundary_literals(spark, sf_dir):
    context = rules.Context({"literals": _literals(spark, sf_dir)[0]})
    return rules.boundary_literals(4, 2, ("F-1",))(context).select("file", "line", "message")


_KINDS = {"signup": "change-started", "view": "change-review", "click": "check-passed", "error": "check-failed", "purchase": "change-closed"}
_STATES = {"signup": "started", "view": "review", "click": "check-passed", "error": "check-failed", "purchase": "closed"}
_AS = lambda names: "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"
_CHANGES = f"""l as (select user_id as change, {_AS(_STATES)} as kind, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events),
s as (select change, case kind when 'started' then 'running' when 'review' then 'review' when 'check-passed' then 'ready' when 'check-failed' then 'blocked' when 'closed' then 'closed' end as status from l where n = 1),
b as (select s.change, count(*) as n from s left join s d on d.change = s.change + 2 where d.change is null or d.status <> 'closed' group by s.change)"""


def _kind(names):
    return F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in names.items()]).alias("kind")


def _changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return lifecycle.change_states(e.select(F.col("user_id").alias("change")).distinct(), e.select("event_id", "ts", F.col("user_id").alias("change"), _kind(_STATES)))


@query(f"with {_CHANGES} select s.change, status, case when status = 'planned' and b.n is null then 'ready' when status <> 'closed' and b.n > 0 then 'blocked' end as queue, coalesce(b.n, 0) as n_blockers from s left join b using (change)")
def change_queue(spark, sf_dir):
    states = _changes(spark, sf_dir)
    return lifecycle.change_queue(states, states.select("change", (F.col("change") + 2).alias("needs")))


@query(f"""with {_CHANGES}, e as (select event_id, user_id as change, case event_id % 6 when 0 then 'claimed' when 1 then 'started' when 2 then 'review' when 3 then 'ready' when 4 then 'closed' else 'blocked' end as kind, event_id % 11 > 2 as passed from events)
select event_id, kind, array_to_string(case when t.status is null then ['unknown task'] when s.status = 'closed' then ['the change is closed'] when t.status = 'closed' then ['the task is closed']
  when w.wrong or w.held or (kind = 'closed' and not passed) then list_filter(['status is ' || t.status, case when w.held then 'open dependencies' end,
    case when kind = 'started' and not w.held then 'claim it first' when kind = 'review' then 'start it and complete its checks first' when kind = 'ready' then 'only blocked or reviewed tasks can be ready' when kind = 'closed' and w.wrong then 'move it to review first' end,
    case when kind = 'closed' and not passed then 'checks must pass' end], lambda x: x is not null) else []::varchar[] end, '; ') as task_issues,
  array_to_string(list_filter([case when kind = 'started' and s.status = 'closed' then 'the change is closed' end, case when kind in ('review', 'closed') and coalesce(b.n, 0) > 0 then 'unfinished tasks' end,
    case when kind = 'closed' and s.status not in ('review', 'ready') then 'status is ' || s.status || '; move it to review first' end, case when kind not in ('started', 'review', 'closed', 'ready') and s.status = 'closed' then 'the change is closed' end], lambda x: x is not null), '; ') as change_issues
from e join s using (change) left join s t on t.change = e.change + 1 left join b on b.change = e.change, lateral (select kind in ('claimed', 'started', 'closed') and coalesce(b.n, 0) > 0 and event_id % 2 = 0 as held,
  (kind = 'claimed' and t.status not in ('planned')) or (kind = 'started' and t.status not in ('claimed')) or (kind = 'review' and t.status not in ('running', 'ready')) or (kind = 'ready' and t.status not in ('blocked', 'review')) or (kind = 'closed' and t.status not in ('review', 'ready')) as wrong) w""")
def lifecycle_steps(spark, sf_dir):
    states = _changes(spark, sf_dir)
    blocked = lifecycle.change_queue(states, states.select("change", (F.col("change") + 2).alias("needs")))
    kinds = ("claimed", "started", "review", "ready", "closed")
    kind = F.coalesce(*[F.when(F.col("event_id") % 6 == i, F.lit(k)) for i, k in enumerate(kinds)], F.lit("blocked"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("change"), kind.alias("kind"))
    df = e.join(blocked, "change").join(states.select((F.col("change") - 1).alias("change"), F.col("status").alias("task")), "change", "left")
    held = F.when(F.col("event_id") % 2 == 0, F.col("n_blockers")).otherwise(0)
    of_task = lifecycle.task_step_issues(F.col("kind"), F.col("status"), F.col("task"), held, F.col("event_id") % 11 > 2)
    of_change = lifecycle.change_step_issues(F.col("kind"), F.col("status"), F.col("n_blockers"))
    return df.select("event_id", "kind", F.array_join(of_task, "; ").alias("task_issues"), F.array_join(of_change, "; ").alias("change_issues"))


@query(f"""with {_CHANGES},
t as (select s.change, s.change * 10 + k as task, case k when 0 then s.status when 1 then 'planned' else 'closed' end as status from s, (select unnest([0, 1, 2]) as k) where s.change % 3 = 0),
d as (select change, change + 2 as needs from s where change % 4 = 0 union all select change, change + 7 from s where change % 5 = 0),
tn as (select change, change * 10 + 1 as task, change * 10 + k as needs from s, (select unnest([0, 2, 5]) as k) where change % 6 = 0 and (k < 5 or change % 12 = 0)),
cb as (select d.change, case when n.change is null then 'missing ' else 'waits for ' end || needs as reason from d left join s n on n.change = d.needs where n.change is null or n.status <> 'closed'),
tb as (select tn.change, tn.task, case when n.task is null then 'missing ' else 'waits for ' end || needs as reason from tn left join t n on n.change = tn.change and n.task = tn.needs where n.task is null or n.status <> 'closed'),
i as (select 'task' as kind, change, task, status from t union all select 'change', change, null, status from s where change not in (select change from t)),
r as (select i.*, coalesce((select list(distinct reason) from (select reason from cb where cb.change = i.change union select reason from tb where tb.change = i.change and tb.task = i.task)), []) as reasons from i)
select kind, change, task, status, case when len(reasons) = 0 then 'ready' else 'blocked' end as queue, array_to_string(list_sort(reasons), ', ') as reasons from r where (status = 'planned' and len(reasons) = 0) or (status <> 'closed' and len(reasons) > 0)""")
def change_work_queue(spark, sf_dir):
    states, change = _changes(spark, sf_dir), F.col("change")
    some = states.where(change % 3 == 0)
    tasks = some.select("change", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "status").select("change", (change * 10 + F.col("k")).alias("task"), F.when(F.col("k") == 0, F.col("status")).when(F.col("k") == 1, "planned").otherwise("closed").alias("status"))
    needs = states.where(change % 4 == 0).select("change", (change + 2).alias("needs")).union(states.where(change % 5 == 0).select("change", change + 7))
    inner = states.where(change % 6 == 0).select("change", (change * 10 + 1).alias("task"), F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("k")).where((F.col("k") < 5) | (change % 12 == 0)).select("change", "task", (change * 10 + F.col("k")).alias("needs"))
    return lifecycle.work_queue(states, needs, tasks, inner).withColumn("reasons", F.array_join("reasons", ", "))


@query(f"""with l as (select user_id as change, {_AS(_KINDS)} as kind, row_number() over (partition by user_id order by ts desc, {_AS(_KINDS)} desc) as n from events where event_id % 4 <> 0),
e as (select change, case kind when 'change-started' then 'running' when 'change-review' then 'review' when 'check-passed' then 'ready' when 'check-failed' then 'blocked' when 'change-closed' then 'closed' end as c from l where n = 1),
t as (select o_custkey as change, max((o_orderstatus = 'P')::int) as b, max((o_orderstatus = 'F')::int) as r, min((o_orderstatus = 'O')::int) as closed from orders group by o_custkey)
select c_custkey as change, case when e.c in ('closed', 'ready', 'review', 'running') then e.c when c_acctbal < 0 or e.c = 'blocked' or t.b = 1 then 'blocked' when t.r = 1 then 'running' when t.closed = 1 then 'ready' else 'planned' end as \"column\"
from customer left join e on e.change = c_custkey left join t on t.change = c_custkey""")
def change_board(spark, sf_dir):
    c, o, e = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "task-closed").otherwise(_kind(_KINDS)).alias("kind")
    tasks = o.select(F.col("o_custkey").alias("change"), F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "closed").otherwise("planned").alias("status"), (F.col("o_orderstatus") == "P").alias("blocked"))
    errors = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("change"))
    return lifecycle.board(c.select(F.col("c_custkey").alias("change")), e.select(F.col("user_id").alias("change"), "ts", kind), errors, tasks)


@query("select o_orderkey as id, o_orderstatus as status, o_orderdate as updated_at from orders where o_orderstatus in ('O', 'P') order by o_orderdate desc, o_orderkey desc limit 500")
def job_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return lifecycle.jobs(o, 900, ["O", "P"])


@query("select coalesce(r.p, e.p) as position, r.id, e.job_id, coalesce(r.id = e.job_id, false) as valid from (select o_orderkey as p, o_custkey as id from orders) r full join (select event_id as p, case when event_id % 9 = 0 then -1 else o_custkey end as job_id from events join orders on o_orderkey = event_id) e on r.p = e.p")
def admission_pairs(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    named = e.join(o, F.col("o_orderkey") == F.col("event_id")).select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 9 == 0, -1).otherwise(F.col("o_custkey")).alias("job_id"))
    return lifecycle.admitted_pairs(o.select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("id")), named)
