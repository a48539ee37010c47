"""The library's operators on small hand-made frames, and its queries against SQL."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions import globs, text, vectors
from quillspark.operators import chunks, events, facts, graph, joins, rollups, rules, search
from quillspark.sources import files
from quillspark.streaming import streams

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def column(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression).first()[0]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("src/*.ts", ["src/a.ts", "src/.a.ts"], ["src/a/b.ts", "a.ts", "src/a_ts"]),
        ("src/**", ["src", "src/a", "src/a/b.ts"], ["srcx/a"]),
        ("**/*.py", ["a.py", "x/y/a.py"], ["a.pyc"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("*.{ts,tsx}", ["a.ts", "a.tsx"], ["a.js"]),
        ("[a-c]?.md", ["bx.md"], ["dx.md", "b.md"]),
        ("[!a-c].md", ["d.md"], ["a.md"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in rows.where(globs.matches(F.col("p"), [pattern])).collect()} == set(yes)


def test_glob_sets(spark):
    rows = spark.createDataFrame([("a/x.ts",), ("a/x.test.ts",)], "p string")
    assert [r.p for r in rows.where(globs.matches(F.col("p"), ["a/*.ts", "!**/*.test.ts"])).collect()] == ["a/x.ts"]
    assert rows.where(globs.matches(F.col("p"), ["!a/**"])).count() == 0
    assert globs.problems(["a/*"]) == [] and len(globs.problems(["!a", "", "+(x)"])) == 2


def test_text_functions(spark):
    row = spark.createDataFrame([("src/a/b.test.ts", "fetchUserName", "../../x", "  a \n b ", "@Deprecated_Soon x @owner me", "type Foo as Bar")], "path string, name string, source string, body string, tags string, spec string")
    got = row.select(
        text.sibling(F.col("path"), "{stem}.spec.{ext}").alias("sibling"), text.identifier_key(F.col("name")).alias("key"), text.relative_depth(F.col("source")).alias("depth"), text.preview(F.col("body")).alias("preview"),
        text.annotation_tags(F.col("tags")).alias("tags"), text.imported_name(F.col("spec")).alias("imported"), text.ancestors(F.col("path")).alias("above"), text.normal_path(F.lit("a/./b/../c//d")).alias("normal"),
        text.language_of(F.col("path")).alias("language"), text.fuzzy_score("usr-nm", F.col("name")).alias("fuzzy"), text.naming_styles(F.lit("abc")).alias("styles"), text.pair_slugs(text.rank_terms(F.lit("the quick Brown fox"))).alias("pairs"),
        text.entropy(F.lit("aabb")).alias("entropy"), text.config_kind(F.lit("http://x/y")).alias("url"), text.config_kind(F.lit("8080")).alias("port"), text.config_kind(F.lit("99999")).alias("none"),
        text.secret_like(F.lit("apiKey"), F.lit("example")).alias("placeholder"), text.secret_like(F.lit("x"), F.lit("AKIA" + "A1" * 8)).alias("secret"), text.key_similarity(F.lit("abcd"), F.lit("abce")).alias("alike"),
    ).first().asDict()
    assert got == {
        "sibling": "src/a/b.test.spec.ts", "key": "username", "depth": 2, "preview": "a b", "tags": ["deprecated-soon", "owner"], "imported": "Foo", "above": ["src", "src/a"], "normal": "a/c/d", "language": "typescript", "fuzzy": 32,
        "styles": ["camel", "kebab", "snake"], "pairs": ["quickbrown", "brownfox"], "entropy": 1.0, "url": "url", "port": "port", "none": None, "placeholder": False, "secret": True, "alike": 0.75,
    }


def test_vectors(spark):
    df = spark.createDataFrame([(k, [float((k * 7 + d * 3) % 11) - 5 for d in range(8)]) for k in range(200)] + [(999, [0.0] * 8)], "vec_id long, embedding array<double>")
    assert df.where("vec_id = 999").select(vectors.cosine("embedding", search.literal([1.0] * 8))).first()[0] == 0.0
    probe = [1.0, -2, 3, 0, 1, 1, -1, 2]
    exact, rough = search.top_k(df, probe, 10), search.two_stage(df, probe, 10)
    assert search.recall(rough, exact, "vec_id").first()[0] > 0.8
    assert search.recall(rough, exact.limit(0), "vec_id").first()[0] == 1.0
    q = search.quantise(df).withColumn("back", vectors.restored(F.col("q"), F.col("lo"), F.col("step")))
    assert q.select(F.max(F.array_max(F.zip_with("back", "embedding", lambda a, b: F.abs(a - b))))).first()[0] < 0.05


def test_hybrid_rules(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, vector double")
    w = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = {r.id: r.combined for r in search.fuse(v, w, 10, "id").collect()}
    assert got == pytest.approx({1: 0.855, 2: 0.86, 3: 0.425})
    kept = {r.id for r in search.fuse(v, w, 10, "id", F.col("id") != 3).collect()}
    assert kept == {1, 2}
    assert search.query_tokens("A the_x of-OF zz!") == ["of", "the_x", "zz"]


def test_nearest(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3), (5, "a", 7)], "id long, k string, at int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 5, 51), ("a", 3, 30), ("b", 10, 100), (None, 1, 1)], "k string, at int, v int")
    assert {r.id: r.nearest for r in joins.nearest(left, right, "k", "at", "v").collect()} == {1: 51, 2: None, 3: None, 4: None, 5: 51}
    assert {r.id: r.nearest for r in joins.nearest(left, right, "k", "at", "v", True).collect()} == {1: 50, 2: 30, 3: 100, 4: None, 5: None}


def test_similar_names(spark):
    names = ["getUserName", "setUserName", "userNames", "username1", "load", "zebra", "UserNme", "abcdefghijk", "abcdefghijl", "bcdefghijkl"]
    got = {(r.a, r.b) for r in joins.similar_names(spark.createDataFrame(list(enumerate(names)), "id int, n string"), "id", "n").collect()}

    def key(n):
        return spark.range(1).select(text.identifier_key(F.lit(n))).first()[0]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    keys = [key(n) for n in names]
    want = {(i, j) for j in range(len(keys)) for i in range(j) if keys[i] and keys[j] and 1 - distance(keys[i], keys[j]) / max(len(keys[i]), len(keys[j])) >= 0.82}
    assert got == want


def test_longest_prefix(spark):
    got = joins.longest_prefix(spark.createDataFrame([("a/b/c.ts",), ("a/x",), ("ab/x",)], "p string"), spark.createDataFrame([("a",), ("a/b",)], "r string"), "p", "r")
    assert {r.p: r.owner for r in got.collect()} == {"a/b/c.ts": "a/b", "a/x": "a", "ab/x": None}


def test_events(spark):
    log = spark.createDataFrame([(k, k % 7, "x" if k % 2 else "y") for k in range(100)], "sequence long, at long, kind string")
    assert [r.sequence for r in events.replay(log, 90, 3, F.col("kind") == "x").collect()] == [91, 93, 95]
    with pytest.raises(ValueError):
        events.replay(log, 0, 1001)
    assert events.bounds(log.limit(0)).first().latest == 0
    kept = events.retained(log, "at", F.lit(3), 5)
    assert sorted(r.sequence for r in kept.collect()) == [k for k in range(100) if k % 7 >= 3][-5:]
    jobs = events.pruned(log, F.col("kind") == "x", "at", F.lit(1), 10, "sequence")
    assert jobs.where("pruned and kind = 'y'").count() == 0 and jobs.where("kind = 'x' and not pruned").count() == 10
    assert not events.admitted(log.limit(5), log, 104).first().admitted and events.admitted(log.limit(5), log, 105).first().admitted


def test_graph(spark):
    nodes = spark.createDataFrame([(1, "a", "f", True, 0, 0), (2, "a", "g", False, 50, 1), (3, "b", "f", True, 0, 0), (4, "c", "h", True, 0, 0), (5, "d", "h", True, 0, 0)], "id long, path string, name string, exported boolean, start_byte int, ordinal int")
    refs = spark.createDataFrame([(1, "a", "f", "call", 60), (2, "c", "f", "call", 5), (3, "a", "h", "call", 55), (4, "b", "g", "identifier", 9), (5, "a", "g", "call", 70)], "ref long, path string, name string, kind string, start_byte int")
    imports = spark.createDataFrame([("c", "f", "b")], "path string, name string, target_path string")
    found = graph.resolve(refs.select("ref", "path", "name"), nodes, imports)
    assert {r.ref: (r.target, r.how) for r in found.collect()} == {1: (1, "same-file"), 2: (3, "import"), 3: (None, None), 4: (2, "project"), 5: (2, "same-file")}
    assert {(r.source, r.target) for r in graph.emitted(refs, found, nodes).collect()} == {(2, 1), (4, 3), (3, 2)}
    with pytest.raises(ValueError):
        graph.edges_of(refs, F.lit(1), "sideways")
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "source long, target long")
    assert {r.node for r in graph.on_cycles(cycle).collect()} == {1, 2, 3}


def test_long_chains_are_no_cycles(spark):
    chain = spark.range(140).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graph.on_cycles(chain).collect() == []
    assert {r.node for r in graph.on_cycles(chain.where("source < 5").union(spark.createDataFrame([(7, 8), (8, 7)], chain.schema))).collect()} == {7, 8}


def test_rules(spark):
    context = rules.Context({
        "files": spark.createDataFrame([("a/x.py", "# head\ntry:\n    pass\nexcept:\n    pass"), ("compat/y.ts", "")], "path string, text string"),
        "literals": spark.createDataFrame([("a/x.py", k, 1, "v", "same", "string") for k in range(3)] + [("a/x.py", 9, 1, "token", "q1w2e3r4", "string"), ("a/x.py", 9, 2, "u", "https://h/p", "string")], "file string, line int, column int, name string, value string, value_kind string"),
        "symbols": spark.createDataFrame([("a/x.py", 1, 1, 10, "f", "function", True, ["a"]), ("a/x.py", 2, 1, 11, "E", "enum", True, [])], "file string, line int, column int, id long, name string, kind string, exported boolean, params array<string>"),
        "imports": spark.createDataFrame([("a/x.py", 1, "../../deep", "b/index.ts", ["S as T"])], "file string, line int, source string, resolved string, specifiers array<string>"),
        "comments": spark.createDataFrame([("a/x.py", 1, "noqa"), ("a/x.py", 2, "noqa reason: old thing"), ("a/x.py", 3, "@deprecated")], "file string, line int, text string"),
        "calls": spark.createDataFrame([("a/x.py", 4, "eval")], "file string, line int, name string"),
        "edges": spark.createDataFrame([(10, 11)], "source long, target long"),
    })
    more = {
        "deep": rules.deep_imports(1), "calls": rules.forbidden_calls("^eval$"), "symbols": rules.restricted_symbols(["S"]), "param": rules.required_param("ctx", "first"), "sibling": rules.required_sibling("{stem}.test.{ext}"),
        "export": rules.required_export("^f$"), "boundary": rules.import_boundary(["a/**"], ["b/**"]), "tags": rules.required_tags("deprecated", ["owner"]), "folder": rules.folder_names(["compat"]), "names": rules.file_names(r"^[a-z]+\.py$"), "header": rules.header_comments(), "comment": rules.comment_matches("noqa"),
    }
    found = rules.run(context, rules.REGISTRY | more)
    rows = found.collect()
    count = {}
    for r in rows:
        count[r.rule_id] = count.get(r.rule_id, 0) + 1
    assert count == {
        "unused-exports": 1, "native-enums": 1, "repeated-literals": 1, "secret-literals": 1, "config-literals": 1, "bypass-comments": 1, "barrel-imports": 1, "shim-files": 1, "bare-except": 1, "deep-imports": 1, "forbidden-calls": 1, "restricted-symbols": 1,
        "required-param": 1, "required-sibling": 2, "required-export": 1, "import-boundary": 1, "required-tags": 1, "folder-names": 1, "file-names": 1, "header-comments": 1, "comment-matches": 2,
    }
    assert [r.file for r in rows] == sorted(r.file for r in rows)
    base = found.where("rule_id = 'bare-except'").select(rules.finding_key().alias("key"))
    assert rules.with_baseline(found, base).where("known").count() == 1
    assert rules.unseen(found, base).count() == len(rows) - 1
    edits = spark.createDataFrame([("f", 0, 5), ("f", 4, 6), ("f", 6, 9)], "file string, start int, end int")
    assert [r.overlaps for r in rules.overlapping_fixes(edits).orderBy("start").collect()] == [False, True, False]


def test_chunks(spark):
    body = "# A\n" + "x" * 900 + "\n## B\nshort\n" + "y" * 3000 + "\nend\n"
    rows = chunks.markdown_chunks(spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "plain")], "doc_id long, text string")).orderBy("doc_id", "ordinal").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [r.heading for r in one] == ["A", "B", None] and {r.doc_id for r in rows} == {1, 4}
    for r in one:
        assert body.encode()[r.start_byte : r.end_byte].decode().strip() == r.chunk
    found = chunks.sections(spark.createDataFrame([(1, "# A\n```\n# no\n```\n## B b\n# A")], "doc_id long, text string")).orderBy("start_line").collect()
    assert [(r.slug, r.level, r.start_line, r.end_line) for r in found] == [("a", 1, 1, 5), ("b-b", 2, 5, 5), ("a-1", 1, 6, 6)]
    pieces = chunks.fitted(spark.createDataFrame([("c", "aaaa bbbb cccc dddd")], "chunk_id string, chunk string"), 10).orderBy("piece_no").collect()
    assert [p.piece for p in pieces] == ["aaaa bbbb", "cccc dddd"]


def test_delta_is_a_full_build(spark):
    files_ = lambda rows: spark.createDataFrame(rows, "path string, content_hash string, chunk string")
    old, new = files_([("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z")]), files_([("a", "1", "x"), ("b", "9", "w"), ("d", "4", "v")])
    kept, again = chunks.delta(old, new)
    assert sorted(map(tuple, kept.union(again).collect())) == sorted(map(tuple, new.collect()))


def test_facts(spark):
    source = "import os\nfrom a.b import c as d\nclass K:\n    def _m(self, x):\n        return os.getcwd()\ndef f(y):\n    return 'lit'\n"
    rows = facts.python_facts(spark.createDataFrame([("a.py", source), ("bad.py", "def (")], "path string, text string")).collect()
    seen = {(r.fact, r.name, r.kind, r.exported) for r in rows if r.path == "a.py"}
    assert {("import", "os", "module", False), ("import", "d", "name", False), ("symbol", "K", "class", True), ("symbol", "_m", "method", False), ("symbol", "f", "function", True), ("call", "getcwd", "call", False), ("literal", "lit", "string", False)} == seen
    assert [r.fact for r in rows if r.path == "bad.py"] == ["diagnostic"]


def test_rollups(spark):
    leaves = spark.createDataFrame([("a/b/x", "1"), ("a/y", "2"), ("z", "3")], "path string, h string")
    tree = {r.node: r for r in rollups.hash_tree(leaves, "path", "h", 2).collect() if r.kind != "chunk"}
    assert {k: r.parent for k, r in tree.items()} == {"a/b/x": "a/b", "a/y": "a", "z": ".", "a/b": "a", "a": ".", ".": None}
    other = {r.node: r for r in rollups.hash_tree(leaves.replace("1", "9", "h"), "path", "h", 2).collect()}
    assert tree["."].hash != other["."].hash and tree["z"].hash == other["z"].hash
    assert rollups.inventory_hash(leaves, "path", "h").first() == rollups.inventory_hash(leaves.orderBy("h", ascending=False), "path", "h").first()


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    found = files.snapshot(files.discovered(spark, str(tmp_path), ["src/*.py"])).collect()
    assert [(r.path, r.text, r.language) for r in found] == [("src/a.py", "x = 1", "python")]
    with pytest.raises(ValueError):
        files.discovered(spark, str(tmp_path), ["**"], most_files=1)
    loose = files.loose_json(spark.createDataFrame([('{"a": "x//y", /* c */ "b": [1,],} // end',)], "j string"), "j", "a string, b array<int>").first().parsed
    assert loose.a == "x//y" and loose.b == [1]
    report = json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 3}}}]}]}]})
    assert tuple(files.sarif(spark.createDataFrame([(report,)], "j string"), "j").first()) == ("t", "r", "warning", "m", "f", 3, None)
    assert files.commits(spark.createDataFrame([("a\tb\t5\td\te\tsub\tject",), ("short",)], "value string")).first().subject == "sub\tject"
    store = files.VersionedTable(spark, str(tmp_path / "t"))
    store.publish(spark.range(3), 1, 3)
    store.publish(spark.range(5), 2)
    assert store.read().count() == 5 and store.revision()[0] == 2
    for bad in ((spark.range(1), 2), (spark.range(1), 3, 7)):
        with pytest.raises(ValueError):
            store.publish(*bad)
    assert store.read().count() == 5


def test_streams(spark, tmp_path):
    rows = [("r", "a", "2024-01-01 00:00:00.000"), ("r", "b", "2024-01-01 00:00:00.100"), ("r", "c", "2024-01-01 00:00:05"), ("r", "late", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "root string, path string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("root string, path string, at timestamp").parquet(str(tmp_path / "in"))
    q = streams.debounced(stream, "at").writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.paths for r in spark.table("bursts").collect()) == [["a", "b"], ["c"]]
    q = streams.latest_into(stream, str(tmp_path / "out"), ["root"], ["at", "path"], str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out/batch-0")).collect()] == ["late"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        cell = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
        return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())

    norm = lambda r: [tuple(c.removesuffix(".0") for c in x) for x in r]
    assert norm(rows(got)) == norm(rows(want))
