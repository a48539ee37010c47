"""Modules of Python and of packages, references with sources, and refactor plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, imports, incremental, refactors, rules
from .code import _ALIASES, _FILES, _modules
from .registry import ORACLES, query, table

_PYTHON = """q as (select p_partkey as k, replace(p_brand, '#', '') as b, replace(p_name, ' ', '_') as n from part),
m as (select k, b, n, 'lib/' || b || case when k % 4 = 2 then '/sub/' else '/' end || n || case when k % 4 = 1 then '/__init__.py' else '.py' end as path from q),
f as (select path from m union select 'lib/' || b || '/__init__.py' from q where right(b, 1) in ('1', '3', '5') union select 'lib/' || b || '/sub/__init__.py' from q where right(b, 1) in ('1', '2', '6')),
i as (select distinct a.path, case l_linenumber when 1 then '.' || t.n when 2 then '..' || t.b || '.' || t.n when 3 then '...lib.' || t.b || '.' || t.n when 4 then t.b || '.' || t.n
  when 5 then 'lib.' || t.b || '.sub.' || t.n when 6 then 'sub.' || t.n else '.' end as source from lineitem join m a on a.k = l_partkey join q t on t.k = l_suppkey * 3),
d as (select path, source, length(source) - length(ltrim(source, '.')) as dots, replace(ltrim(source, '.'), '.', '/') as module, string_split(regexp_replace(path, '/[^/]*$', ''), '/') as dirs from i),
a as (select distinct path, dirs, unnest(range(1, len(dirs) + 1)) as u from d),
r as (select path, array_to_string(dirs[1:u - 1], '/') as root from a where array_to_string(dirs[1:u], '/') || '/__init__.py' in (select path from f) union select path, '' from d),
c as (
  select path, source, 0 as step, array_to_string(list_concat(dirs[1:greatest(len(dirs) - dots + 1, 0)], case when module = '' then []::varchar[] else [module] end), '/') as base from d where dots > 0
  union all select d.path, source, length(root), case when root = '' then module else root || '/' || module end from d join r on r.path = d.path where dots = 0),
e(ending, place) as (values ('.py', 0), ('/__init__.py', 1)),
h as (select c.path, source, arg_min(f.path, step * 10 + place) as target from c, e join f on f.path = c.base || e.ending group by c.path, source)"""


@query(f"with {_PYTHON} select path, source, target from i left join h using (path, source)")
def python_imports(spark, sf_dir):
    part, li, key = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), F.col("p_partkey")
    brand, name = F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_"))
    named = part.select(key.alias("k"), brand.alias("b"), name.alias("n"))
    path = F.concat(F.lit("lib/"), "b", F.when(F.col("k") % 4 == 2, "/sub/").otherwise("/"), "n", F.when(F.col("k") % 4 == 1, "/__init__.py").otherwise(".py"))
    begun = lambda end, digits: named.where(F.right("b", F.lit(1)).isin(*digits)).select(F.concat(F.lit("lib/"), "b", F.lit(end)).alias("path"))
    files = named.select(path.alias("path")).union(begun("/__init__.py", "135")).union(begun("/sub/__init__.py", "126"))
    a, t = named.select(F.col("k").alias("l_partkey"), path.alias("path")), named.select((F.col("k") / 3).alias("l_suppkey"), "b", "n")
    number = F.col("l_linenumber")
    forms = {1: F.concat(F.lit("."), "n"), 2: F.concat(F.lit(".."), "b", F.lit("."), "n"), 3: F.concat(F.lit("...lib."), "b", F.lit("."), "n"), 4: F.concat("b", F.lit("."), "n"), 5: F.concat(F.lit("lib."), "b", F.lit(".sub."), "n"), 6: F.concat(F.lit("sub."), "n")}
    source = F.coalesce(*[F.when(number == k, v) for k, v in forms.items()], F.lit("."))
    wanted = li.select("l_partkey", F.col("l_suppkey").cast("double").alias("l_suppkey"), "l_linenumber").join(a, "l_partkey").join(t, "l_suppkey").select("path", source.alias("source")).distinct()
    return imports.python_resolved(wanted, files).select("path", "source", "target")


#: What packages offer, by their number: manifests, and what follows from them.
_MANIFESTS = [
    '{"name": "x", "exports": "./red_widget"}',
    '{"exports": {".": {"require": "./no", "default": "./hot_gear", "types": "./blue_bolt"}, "./small_ring": "./red_widget", "./blue_bolt": {"node": "./no"}, "x": "./no"}}',
    '{"exports": {".": {"svelte": "./blue_bolt"}, "./red_widget": {"types": "./src/none", "import": {"node": "./no"}}, "./hot_gear": 7}}',
    '{"name": "y"}',
]
_OFFERED = [[("", "red_widget")], [("", "hot_gear"), ("small_ring", "red_widget")], [("", "blue_bolt"), ("red_widget", "src/none")], []]
_WITH_EXPORTS = _FILES.replace("2 + k", "3 + k").replace(
    "),\nh as",
    "\n  union all select path, source, name, 2, root || '/' || export from i join pk on source = name or starts_with(source, name || '/') join offers o on o.number = substr(name, 10)::integer % 4 and o.subpath = substr(source, length(name) + 2)),\nh as",
    1,
)
_OFFERS = "offers(number, subpath, export) as (values " + ", ".join(f"({n}, '{a}', '{b}')" for n, rows in enumerate(_OFFERED) for a, b in rows) + "), "


@query(f"with {_OFFERS}{_WITH_EXPORTS} select path, source, resolution, target, from_package, to_package, depth::integer as depth from o")
def package_exports(spark, sf_dir):
    wanted, files, packages = _modules(spark, sf_dir)
    number = F.substring("name", 10, 9).cast("int") % len(_MANIFESTS)
    manifests = packages.withColumn("manifest", F.get(F.array(*map(F.lit, _MANIFESTS)), number))
    found = imports.import_graph(wanted, files, packages, _ALIASES, imports.package_exports(manifests))
    return found.select("path", "source", "resolution", "target", "from_package", "to_package", "depth")


_REFERENCES = """n as (select p_partkey as id, p_brand as path, case when p_partkey % 9 = 0 then 'default' else p_name || p_partkey % 40 end as name, p_partkey % 2 = 0 and p_partkey % 25 < 20 as exported from part),
s as (select l_orderkey * 10 + l_linenumber as ref, 'Brand#' || l_suppkey % 25 + 1 as path, name, ['import-module', 'call', 'identifier'][l_linenumber % 3 + 1] as kind, case when l_orderkey % 4 = 0 then 'python' else 'typescript' end as language,
  case when l_orderkey % 8 <> 4 then 'm' end as source, case when l_linenumber < 7 then 'Brand#' || l_linenumber * 3 % 25 + 1 end as source_path from lineitem join n on id = l_partkey),
i as (select distinct 'Brand#' || l_suppkey % 25 + 1 as path, name, ['import-named', 'import-default', 'import-namespace'][l_linenumber % 3 + 1] as kind, 'Brand#' || (l_partkey + l_linenumber) % 30 + 1 as target_path from lineitem join n on id = l_partkey where l_quantity > 48),
o as (select path as target_path, name, id from n where exported),
sole as (select target_path, min(id) as id from o group by target_path having count(*) = 1),
def as (select target_path, id from o where name = 'default' union all select target_path, id from sole where target_path not in (select target_path from o where name = 'default')),
via as (select path, name, min(id) as via from (select i.path, i.name, id from i join o using (target_path, name) where kind = 'import-named' union all select i.path, i.name, id from i join def using (target_path) where kind = 'import-default') group by path, name having count(*) = 1),
own as (select path, name, min(id) as own from n group by path, name having count(*) = 1),
alone as (select name, min(id) as alone from n group by name having count(*) = 1),
named as (select target_path, name, min(id) as id from o group by target_path, name having count(*) = 1)"""


@query(f"""with {_REFERENCES}
select ref, coalesce(named.id, case when kind = 'import-module' then sole.id end) as target, case when coalesce(named.id, case when kind = 'import-module' then sole.id end) is not null then 'module' end as how
  from s left join named on named.target_path = source_path and named.name = s.name left join sole on sole.target_path = source_path where language = 'python' and source is not null
union all select ref, coalesce(own, via, alone), case when own is not null then 'same-file' when via is not null then 'import' when alone is not null then 'project' end
  from s left join own using (path, name) left join via using (path, name) left join alone using (name) where not (language = 'python' and source is not null)""")
def resolve_references(spark, sf_dir):
    return graph.resolve_all(*_facts(spark, sf_dir))


def _facts(spark, sf_dir):
    """References, nodes and imports."""
    part, li, key = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), F.col("p_partkey")
    nodes = part.select(key.alias("id"), F.col("p_brand").alias("path"), F.when(key % 9 == 0, "default").otherwise(F.concat("p_name", (key % 40).cast("string"))).alias("name"), ((key % 2 == 0) & (key % 25 < 20)).alias("exported"))
    used = li.join(nodes.select(F.col("id").alias("l_partkey"), "name"), "l_partkey")
    brand = lambda n, size: F.concat(F.lit("Brand#"), (n % size + 1).cast("string"))
    of = lambda *kinds: F.get(F.array(*map(F.lit, kinds)), F.col("l_linenumber") % 3)
    path, line = brand(F.col("l_suppkey"), 25).alias("path"), F.col("l_linenumber")
    references = used.select(
        (F.col("l_orderkey") * 10 + line).alias("ref"), path, "name", of("import-module", "call", "identifier").alias("kind"), F.when(F.col("l_orderkey") % 4 == 0, "python").otherwise("typescript").alias("language"),
        F.when(F.col("l_orderkey") % 8 != 4, "m").alias("source"), F.when(line < 7, brand(line * 3, 25)).alias("source_path"),
    )
    wanted = used.where("l_quantity > 48").select(path, "name", of("import-named", "import-default", "import-namespace").alias("kind"), brand(F.col("l_partkey") + line, 30).alias("target_path")).distinct()
    return references, nodes, wanted


@query(ORACLES["resolve_references"])
def graph_delta(spark, sf_dir):
    """The same graph, from an earlier state in which some files had other nodes and some were not there yet."""
    references, nodes, wanted = _facts(spark, sf_dir)
    paths = references.select("path").union(nodes.select("path")).union(wanted.select("path")).distinct()
    version = F.when(F.substring("path", 7, 9).cast("int") % 8 == 3, "2").otherwise("1")
    now = paths.select("path", version.alias("content_hash"), F.lit("p").alias("parser"), F.lit("e").alias("extractor"))
    before = now.where("path <> 'Brand#7'").withColumn("content_hash", F.lit("1")).union(now.limit(1).select(F.lit("gone.ts"), F.lit("1"), F.lit("p"), F.lit("e")))
    older = nodes.where((F.col("id") % 5 != 0) | (version == "1")).union(nodes.where("id = 1").select(F.col("id") + 10_000_000, F.lit("gone.ts"), "name", F.lit(True)))
    facts = lambda n: lambda some: tuple(df.join(some, "path", "left_semi") for df in (n, references, wanted))
    state = incremental.built(before, facts(older))
    return incremental.updated(state, now, facts(nodes))[0].resolved


@query(r"""with t as (select doc_id, text, regexp_extract_all(text, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+') as w from documents where text is not null),
u as (select doc_id, unnest(w) as w, unnest(range(len(w))) as k from t),
p as (select *, sum(length(w)) over (partition by doc_id order by k) as upto from u)
select doc_id, count(*) filter (w = 'that') as n_edits, (min(upto) filter (w = 'that') - 4)::integer as first_start, (max(upto) filter (w = 'that'))::integer as last_end, sha256(string_agg(case when w = 'that' then 'whatever' else w end, '' order by k)) as text_sha256
from p group by doc_id having count(*) filter (w = 'that') > 0""")
def rename_plan(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    edits = refactors.rename_by_text(texts, "that", "whatever")
    applied = rules.fixed_texts(texts, edits).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    sums = edits.groupBy(F.col("file").alias("path")).agg(F.count("start").alias("n_edits"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    return sums.join(applied, "path").withColumnRenamed("path", "doc_id").select("doc_id", "n_edits", "first_start", "last_end", "text_sha256")


@query(f"""with {_FILES},
mv as (select path as source, 'lib/new/three/' || substr(path, 12) as target from f where starts_with(path, 'src/Brand3/') union select path, 'src/' || regexp_extract(path, '^src/([^/]*)', 1) || '/core/widget.ts' from f where ends_with(path, '/red_widget.ts') and not starts_with(path, 'src/Brand3/')),
l as (select path, source, 'import {{ x }} from "' || source || '";' as line from i),
s as (select *, coalesce(sum(length(line) + 1) over (partition by path order by line rows between unbounded preceding and 1 preceding), 0) + 19 as start from l where true),
x(ending, place) as (values ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.svelte', 5), ('/index.ts', 6), ('/index.tsx', 7), ('/index.js', 8), ('/index.jsx', 9), ('/index.svelte', 10)),
c as (select s.path, s.source, start, regexp_extract(s.path, '^src/([^/]*)', 1) as b, arg_min(mv.target, x.place) as target from s join b on b.path = s.path and b.source = s.source and b.step = 0, x join mv on mv.source = b.base || x.ending group by all)
select path as file, start::integer as start, (start + length(source))::integer as "end", case when starts_with(target, 'lib/') then '../../' || regexp_replace(target, '\\.(ts|tsx|js|jsx)$', '')
  when starts_with(target, 'src/' || b || '/') then './core/widget' else '../' || regexp_extract(target, '^src/([^/]*)', 1) || '/core/widget' end as replacement from c""")
def move_plan(spark, sf_dir):
    wanted, files, _ = _modules(spark, sf_dir)
    lines = wanted.select("path", F.concat(F.lit('import { x } from "'), "source", F.lit('";')).alias("line"))
    texts = lines.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    folder = refactors.moves_of_folder(files, "src/Brand3/", "lib/new/three")
    single = files.where(F.col("path").endswith("/red_widget.ts") & ~F.col("path").startswith("src/Brand3/")).select(F.col("path").alias("source"), F.concat(imports.folder_of(F.col("path")), F.lit("/core/widget.ts")).alias("target"))
    return refactors.updated_imports(texts, folder.union(single)).drop("safety")
