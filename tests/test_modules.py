"""Module resolution, references with sources, and refactor plans on hand-made files."""

import random

from pyspark.sql import functions as F

from quillspark.operators import graph, imports, refactors, rules


def test_python_modules(spark):
    files = ["top.py", "pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "pkg/sub/deep/c.py", "src/lib/__init__.py", "src/lib/m.py", "src/tool.py", "pkg/both.py", "pkg/both/__init__.py"]
    wanted = {
        ("pkg/a.py", ".sub"): "pkg/sub/__init__.py", ("pkg/a.py", ".sub.b"): "pkg/sub/b.py", ("pkg/sub/b.py", "..a"): "pkg/a.py", ("pkg/sub/b.py", "."): "pkg/sub/__init__.py", ("pkg/sub/b.py", "..."): None, ("pkg/sub/b.py", "...top"): "top.py",
        ("pkg/sub/b.py", ".....top"): "top.py", ("pkg/sub/b.py", "top"): "top.py", ("pkg/sub/b.py", "pkg.a"): "pkg/a.py", ("pkg/sub/b.py", "sub.b"): "pkg/sub/b.py", ("pkg/sub/deep/c.py", "sub.b"): "pkg/sub/b.py", ("src/lib/m.py", "lib.m"): "src/lib/m.py",
        ("src/tool.py", "lib.m"): None, ("src/tool.py", "tool"): None, ("top.py", "pkg.both"): "pkg/both.py", ("top.py", "numpy"): None, ("top.py", ".pkg"): "pkg/__init__.py",
    }
    df = spark.createDataFrame([*wanted, (None, ".a"), ("top.py", None)], "path string, source string")
    got = imports.python_resolved(df, spark.createDataFrame([(f,) for f in files], "path string")).collect()
    assert {(r.path, r.source): r.target for r in got} == wanted | {(None, ".a"): None, ("top.py", None): None}


def test_exports_of_packages(spark):
    manifests = [
        ("one", '{"exports": "./dist/main.js"}'), ("two", '{"exports": {".": {"types": "./t.d.ts", "default": "./d.js", "import": "./i.js"}, "./x": "./src/x", "./y": {"node": "./n.js"}, "bad": "./b"}}'), ("three", "{}"), ("four", "no json"), ("five", None),
        ("six", '{"exports": ["./a"]}'), ("seven", '{"exports": {"./z": {"import": {"node": "./n.js"}, "svelte": "./s.svelte"}}}'),
    ]
    offered = imports.package_exports(spark.createDataFrame(manifests, "name string, manifest string"))
    assert sorted(map(tuple, offered.collect())) == [("one", "", "./dist/main.js"), ("seven", "z", "./s.svelte"), ("two", "", "./i.js"), ("two", "x", "./src/x")]
    files = spark.createDataFrame([("p/two/i.js",), ("p/two/src/x.ts",), ("p/two/x.ts",), ("p/two/w.ts",), ("p/two/src/index.ts",)], "path string")
    packages = spark.createDataFrame([("two", "p/two")], "name string, root string")
    wanted = spark.createDataFrame([("a.ts", "two"), ("a.ts", "two/x"), ("a.ts", "two/w"), ("a.ts", "two/q"), ("a.py", "two"), ("a.py", ".b")], "path string, source string")
    got = {(r.path, r.source): (r.resolution, r.target) for r in imports.resolved(wanted, files, packages, exports=offered).collect()}
    assert got == {("a.ts", "two"): ("workspace", "p/two/i.js"), ("a.ts", "two/x"): ("workspace", "p/two/src/x.ts"), ("a.ts", "two/w"): ("workspace", "p/two/w.ts"), ("a.ts", "two/q"): ("workspace", None), ("a.py", "two"): ("unresolved", None), ("a.py", ".b"): ("unresolved", None)}
    plain = {r.source: r.target for r in imports.resolved(wanted, files, packages).where("path = 'a.ts'").collect()}
    assert plain == {"two": "p/two/src/index.ts", "two/x": "p/two/x.ts", "two/w": "p/two/w.ts", "two/q": None}


def test_references_with_sources(spark):
    nodes = [(1, "m.py", "f", True), (2, "m.py", "hidden", False), (3, "n.py", "only", True), (4, "a.ts", "f", True), (5, "b.ts", "default", True), (6, "b.ts", "g", True), (7, "c.ts", "sole", True), (8, "d.ts", "twin", True), (9, "d.ts", "twin", True), (10, "e.ts", "alone", False)]
    references = [
        (1, "x.py", "f", "call", "python", "m", "m.py"), (2, "x.py", "hidden", "call", "python", "m", "m.py"), (3, "x.py", "n", "import-module", "python", "n", "n.py"), (4, "x.py", "alone", "call", "python", "m", "m.py"), (5, "x.py", "alone", "call", "python", None, None),
        (6, "a.ts", "f", "call", "ts", None, None), (7, "x.ts", "f", "call", "ts", None, None), (8, "x.ts", "dflt", "call", "ts", None, None), (9, "x.ts", "s", "call", "ts", None, None), (10, "d.ts", "twin", "call", "ts", None, None), (11, "x.ts", "ns", "call", "ts", None, None),
        (12, "x.ts", "g", "call", "ts", None, None), (13, "x.py", "f", "call", "python", "gone", None),
    ]
    wanted = [("x.ts", "f", "import-named", "a.ts"), ("x.ts", "dflt", "import-default", "b.ts"), ("x.ts", "s", "import-default", "c.ts"), ("x.ts", "ns", "import-namespace", "c.ts"), ("x.ts", "g", "import-named", "b.ts"), ("x.ts", "g", "import-default", "c.ts")]
    got = graph.resolve_all(
        spark.createDataFrame(references, "ref int, path string, name string, kind string, language string, source string, source_path string"),
        spark.createDataFrame(nodes, "id int, path string, name string, exported boolean"), spark.createDataFrame(wanted, "path string, name string, kind string, target_path string"),
    )
    assert {r.ref: (r.target, r.how) for r in got.collect()} == {
        1: (1, "module"), 2: (None, None), 3: (3, "module"), 4: (None, None), 5: (10, "project"), 6: (4, "same-file"), 7: (4, "import"), 8: (5, "import"), 9: (7, "import"), 10: (None, None), 11: (None, None), 12: (6, "project"), 13: (None, None),
    }


def test_renames(spark):
    texts = spark.createDataFrame([("a.ts", "foo foo.bar $foo foo$ foos\n_foo (foo)"), ("b.ts", "nothing"), ("c.ts", None), ("d.ts", "é foo")], "path string, text string")
    edits = refactors.rename_by_text(texts, "foo", "longer")
    assert {r.path: r.text for r in rules.fixed_texts(texts, edits).collect()} == {"a.ts": "longer longer.bar $foo foo$ foos\n_foo (longer)", "d.ts": "é longer"}
    assert refactors.rename_by_text(texts, "foo", "no good").count() == 0 and refactors.identifier_problems("1a", "b c") == ["Invalid source identifier: 1a", "Invalid target identifier: b c"]
    symbols = spark.createDataFrame([("a.ts", "foo", 0), ("a.ts", "two", 3), ("b.ts", "two", 0)], "path string, name string, start int")
    references = spark.createDataFrame([("a.ts", "foo", 4), ("d.ts", "foo", 2), ("d.ts", "foo", 2), ("b.ts", "two", 1)], "path string, name string, start int")
    assert sorted(map(tuple, refactors.rename_by_graph(symbols, references, "foo", "x").drop("safety").collect())) == [("a.ts", 0, 3, "x"), ("a.ts", 4, 7, "x"), ("d.ts", 2, 5, "x")]
    assert refactors.rename_by_graph(symbols, references, "two", "x").count() == 0
    said = lambda a, b: [r.message for r in refactors.rename_problems(symbols, a, b).collect()]
    assert said("foo", "x") == [] and said("two", "x") == ["Ambiguous graph rename for symbol two: 2 declarations match."] and said("none", "-") == ["Invalid target identifier: -", "No declaration of symbol: none"]
    quoted = spark.createDataFrame([("p.json", """{"dep": "pkg", 'pkg': "pkg-x", "pkg': 1}""")], "path string, text string")
    assert rules.fixed_texts(quoted, refactors.renamed_package(quoted, "pkg", "@a/b")).first().text == """{"dep": "@a/b", '@a/b': "pkg-x", "pkg': 1}"""


def test_moves(spark):
    rng = random.Random(3)
    texts = [
        ("src/a.ts", "import { x } from './lib/x';\nimport y from \"./lib/y.ts\"; import('./lib');\nconst s = './lib/x';"), ("src/lib/x.ts", "import '../a'; export * from './y'"), ("src/lib/y.ts", ""), ("src/lib/index.ts", ""), ("main.js", "import z from './src/lib/x'; import r from 'react'; import q from './src/a.js'"),
    ]
    df = spark.createDataFrame(texts, "path string, text string")
    moves = refactors.moves_of_folder(df, "src/lib", "core/new/").union(spark.createDataFrame([("src/a.ts", "src/b.ts")], "source string, target string"))
    assert sorted(map(tuple, moves.collect())) == [("src/a.ts", "src/b.ts"), ("src/lib/index.ts", "core/new/index.ts"), ("src/lib/x.ts", "core/new/x.ts"), ("src/lib/y.ts", "core/new/y.ts")]
    got = {r.path: r.text for r in rules.fixed_texts(df, refactors.updated_imports(df, moves)).collect()}
    assert got == {
        "src/a.ts": "import { x } from '../core/new/x';\nimport y from \"../core/new/y.ts\"; import('../core/new/index');\nconst s = './lib/x';",
        "src/lib/x.ts": "import '../b'; export * from '../../core/new/y'", "main.js": "import z from './core/new/x'; import r from 'react'; import q from './src/a.js'",
    }
    bad = spark.createDataFrame([("gone.ts", "n.ts"), ("src/a.ts", "main.js"), ("src/lib/x.ts", "n.ts")], "source string, target string")
    assert {r.message for r in refactors.move_problems(df, bad).collect()} == {"Cannot move missing file: gone.ts", "Target exists: main.js", "Several files move to: n.ts"}
    folders = [("/".join(rng.choice("abc") for _ in range(rng.randrange(4))), "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))) for _ in range(60)]
    import posixpath

    paths = spark.createDataFrame(folders, "a string, b string").select("a", "b", refactors.relative_path(F.col("a"), F.col("b")).alias("c")).collect()
    assert all((r.c or ".") == posixpath.relpath("/" + r.b, "/" + r.a) for r in paths if not (r.a + "/").startswith(r.b + "/"))
