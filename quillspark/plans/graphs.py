"""Graph, definition and integrity queries over the star schema, pages and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, facts, graph, joins, rollups, rules
from .registry import query, table

_EDGES = "e as (select distinct l_partkey as source, l_suppkey as target from lineitem)"


def _edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()


@query(f"with {_EDGES} select source, target, p_name as source_name, s_name as target_name from e join part on p_partkey = source join supplier on s_suppkey = target where target = 3 order by source, target limit 200")
def edge_callers(spark, sf_dir):
    e = graph.edges_of(_edges(spark, sf_dir), F.lit(3), "incoming", 200)
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    return e.join(p.select(F.col("p_partkey").alias("source"), F.col("p_name").alias("source_name")), "source").join(s.select(F.col("s_suppkey").alias("target"), F.col("s_name").alias("target_name")), "target").select("source", "target", "source_name", "target_name")


@query(f"with {_EDGES} select source, target from e where source = 7 order by source, target limit 200")
def edge_callees(spark, sf_dir):
    return graph.edges_of(_edges(spark, sf_dir), F.lit(7), "outgoing", 200)


@query(f"with {_EDGES} select source, target from e where source = 5 or target = 5 order by source, target limit 500")
def edge_impact(spark, sf_dir):
    return graph.edges_of(_edges(spark, sf_dir), F.lit(5), "both", 500)


@query("""with nodes as (select p_partkey as id, p_brand as path, p_name as name, p_partkey % 2 = 0 as exported from part),
refs as (select l_orderkey * 10 + l_linenumber as ref, 'Brand#' || (l_suppkey % 25 + 1) as path, p_name as name from lineitem join part on p_partkey = l_partkey),
imports as (select distinct 'Brand#' || (s_suppkey % 25 + 1) as path, p_name as name, 'Brand#' || (s_suppkey % 7 + 1) as target_path from supplier, part where p_size = s_suppkey % 50),
own as (select path, name, min(id) as own from nodes group by all having count(*) = 1),
via as (select i.path, i.name, min(id) as via from imports i join nodes n on n.path = i.target_path and n.name = i.name and n.exported group by all having count(*) = 1),
anywhere as (select name, min(id) as anywhere from nodes group by name having count(*) = 1)
select ref, coalesce(own, via, anywhere) as target, case when own is not null then 'same-file' when via is not null then 'import' when anywhere is not null then 'project' end as how
from refs left join own using (path, name) left join via using (path, name) left join anywhere using (name)""")
def resolve_precedence(spark, sf_dir):
    p, s, li = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    brand = lambda c, n: F.concat(F.lit("Brand#"), F.col(c) % n + 1)
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), (F.col("p_partkey") % 2 == 0).alias("exported"))
    refs = li.join(p, F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), brand("l_suppkey", 25).alias("path"), F.col("p_name").alias("name"))
    # Suppliers count by their key modulo 50, 25 and 7 alone, so there are 350 kinds at most, however many suppliers.
    kinds = s.select((F.col("s_suppkey") % 50).alias("p_size"), brand("s_suppkey", 25).alias("path"), brand("s_suppkey", 7).alias("target_path")).distinct()
    imports = p.select("p_size", F.col("p_name").alias("name")).distinct().join(F.broadcast(kinds), "p_size").select("path", "name", "target_path").distinct()
    return graph.resolve(refs, nodes, imports)


@query("select p_partkey, p_name from part where p_partkey % 2 = 0 and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def unused_exports(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_partkey") % 2 == 0).alias("exported"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("target"))
    return graph.callers_without(p, used).select(F.col("id").alias("p_partkey"), "p_name")


@query("with f as (select 'ord/' || (o_orderkey % 40) || '/' || o_custkey || '.ts' as path from orders), w as (select distinct path, regexp_replace(path, '/([0-9]+)\\.ts$', '/\\1.test.ts') as want from f), g as (select distinct 'ord/' || (o_orderkey % 40) || '/' || o_custkey || '.test.ts' as want from orders where o_orderkey % 3 = 0) select path, want from w where want not in (select want from g)")
def missing_sibling(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = lambda end: F.concat(F.lit("ord/"), F.col("o_orderkey") % 40, F.lit("/"), F.col("o_custkey"), F.lit(end))
    want = o.select(at(".ts").alias("path")).distinct().withColumn("want", text.sibling(F.col("path"), "{stem}.test.{ext}"))
    have = o.where("o_orderkey % 3 = 0").select(at(".test.ts").alias("want"))
    return rollups.missing(want, have, "want", "want").select("path", "want")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 7 <> 0)")
def integrity_missing_refs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0")
    return rollups.missing(table(spark, sf_dir, "lineitem"), o, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("select p_name as id, count(*) as n from part group by p_name having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select p_partkey, case when n = 1 then p_name else p_name || '-' || n end as unique_id from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as n from part)")
def unique_ids(spark, sf_dir):
    return rollups.unique_ids(table(spark, sf_dir, "part"), "p_name", [F.col("p_partkey")]).select("p_partkey", "unique_id")


@query("select l_suppkey as target, count(distinct l_returnflag) as n_owners, min(l_returnflag) as first_owner from lineitem group by 1 having count(distinct l_returnflag) > 1")
def duplicate_owners(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), "l_returnflag")
    return rollups.owners(li, "l_returnflag", "target")


_LINKS = """l as (select distinct 'page/' || page_id as source, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages)"""


@query(f"""with {_LINKS} select 'target' as side, target as id, array_to_string(list_sort(list(source)), ' ') as others from l group by target
union all select 'source', source, array_to_string(list_sort(list(target)), ' ') from l group by source""")
def backlinks(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return rollups.linked_both_ways(links, "source", "target").select("side", "id", F.array_join("others", " ").alias("others"))


_CYCLE = """e as (select c_custkey as source, c_custkey // 8 * 8 + (c_custkey * 5 + c_nationkey) % 8 as target from customer
union select c_custkey, c_custkey + 8 from customer where c_custkey % 16 = 3 union select c_custkey, c_custkey - 3 from customer where c_custkey % 24 = 7)"""


def _customer_graph(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return (
        c.select(key.alias("source"), (F.floor(key / 8) * 8 + (key * 5 + F.col("c_nationkey")) % 8).cast("long").alias("target"))
        .union(c.where(key % 16 == 3).select(key, key + 8))
        .union(c.where(key % 24 == 7).select(key, key - 3))
        .distinct()
    )


@query(f"""with recursive {_CYCLE}, r as (select source, target from e union select r.source, e.target from r join e on r.target = e.source)
select a.source as node, min(a.target) as cycle from r a join r b on b.source = a.target and b.target = a.source group by a.source""")
def dependency_cycles(spark, sf_dir):
    return graph.cycles(_customer_graph(spark, sf_dir))


@query(f"""with recursive {_CYCLE}, r as (select source, target from e union select r.source, e.target from r join e on r.target = e.source),
own as (select a.source as node, min(a.target) as cycle from r a join r b on b.source = a.target and b.target = a.source group by a.source),
i as (select source, target, a.cycle from e join own a on a.node = source join own b on b.node = target and b.cycle = a.cycle),
h(node, cycle, d) as (select distinct cycle, cycle, 0 from own union select i.source, h.cycle, h.d + 1 from h join i on i.target = h.node and i.cycle = h.cycle where h.d < 200),
m as (select node, cycle, min(d) as d from h group by node, cycle),
n as (select source, i.cycle, arg_min(target, d * 10000000 + target) as next from i join m on m.node = target and m.cycle = i.cycle group by source, i.cycle),
w(cycle, position, node) as (select distinct cycle, 0::bigint, cycle from own union all select w.cycle, position + 1, next from w join n on n.source = w.node and n.cycle = w.cycle where next <> w.cycle)
select cycle, position, node from w""")
def cycle_paths(spark, sf_dir):
    return graph.cycle_paths(_customer_graph(spark, sf_dir))


@query(f"""with recursive {_CYCLE}, r(node, steps) as (select source, 0 from e where source % 50 = 1 union select e.target, r.steps + 1 from r join e on e.source = r.node where r.steps < 3)
select node, min(steps)::integer as steps from r group by node""")
def reach(spark, sf_dir):
    edges = _customer_graph(spark, sf_dir)
    return graph.reach(edges, edges.where("source % 50 = 1").select(F.col("source").alias("node")), 3)


_P = "regexp_extract(url, '://([^?#]*)', 1)"


@query(f"""with p as (select distinct {_P} as path from pages), r as (select distinct regexp_extract(path, '^([^/]*)', 1) as root from p where path like '%.com/%' union select distinct regexp_extract(path, '^([^/]*/[^/]*)', 1) from p where path like '%/en/%'),
m as (select path, root, row_number() over (partition by path order by length(root) desc) as n from p left join r on path = root or starts_with(path, root || '/'))
select path, root as owner from m where n = 1""")
def longest_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")).distinct()
    roots = p.where("path like '%.com/%'").select(F.regexp_extract("path", "^([^/]*)", 1).alias("root")).union(p.where("path like '%/en/%'").select(F.regexp_extract("path", "^([^/]*/[^/]*)", 1).alias("root")))
    return joins.longest_prefix(p, roots, "path", "root")


@query(f"with p as (select {_P} as file, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as source from pages) select file, source from p where regexp_matches(file, '^(?:[^/]+/)*en/.*$') and regexp_matches(source, '^/[^/]*th[^/]*$')")
def import_boundaries(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("file"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("source"))
    found = rules.import_boundary(["**/en/**"], ["/*th*"])(rules.Context({"imports": links.withColumn("resolved", F.lit(None).cast("string")).withColumn("line", F.lit(1))}))
    return found.select("file", F.regexp_extract("message", "^must not import (.*)$", 1).alias("source"))


@query("""with w as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as name from documents), s as (select distinct regexp_extract(text, '[A-Za-z]{14,}') as name, doc_id as d from documents)
select doc_id, name, d as defined_in from w join s using (name) where doc_id <> d and name <> ''""")
def reference_facts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    symbols = d.select(F.regexp_extract("text", "[A-Za-z]{14,}", 0).alias("name"), F.col("doc_id").alias("path"), F.lit(True).alias("exported")).where("name <> ''")
    return facts.reference_facts(d.select(F.col("doc_id").alias("path"), "text"), symbols).select(F.col("path").alias("doc_id"), "name", "defined_in")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no from documents)
select doc_id, no::integer as line_no, regexp_matches(line, '^Ern?') as is_fence, (sum(regexp_matches(line, '^Ern?')::int) over (partition by doc_id order by no) % 2 = 1 and not regexp_matches(line, '^Ern?')) as in_fence from l""")
def fence_state(spark, sf_dir):
    rows = chunks.lines(table(spark, sf_dir, "documents")).withColumn("line", F.when(F.col("line").rlike("^Ern?"), F.concat(F.lit("```"), "line")).otherwise(F.col("line")))
    return chunks.with_fences(rows).select("doc_id", "line_no", "is_fence", "in_fence")


@query("""with a as (select doc_id, sha256(text) as h from documents where doc_id % 3 <> 0), b as (select doc_id, sha256(text) as h from documents where doc_id % 4 <> 0)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.h is null then 'delete' when a.h = b.h then 'keep' else 'write' end as action from a full join b on a.doc_id = b.doc_id""")
def vector_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("h"))
    return chunks.vector_delta(d.where("doc_id % 3 <> 0"), d.where("doc_id % 4 <> 0"), "doc_id", "h")


@query("""with l as (select doc_id::varchar || chr(0) || sha256(text) as line, left(sha256(doc_id::varchar), 3) as part from documents), p as (select part, sha256(string_agg(line, chr(10) order by line)) as h from l group by part)
select sha256(string_agg(part || chr(0) || h, chr(10) order by part)) as inventory_hash from p""")
def inventory_hash(spark, sf_dir):
    return rollups.inventory_hash(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), text.text_hash(F.col("text")).alias("h")), "path", "h")
