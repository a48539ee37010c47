"""Operators that no query covers, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import globs, records
from quillspark.operators import chunks, definitions, events, facts, index, rollups, rules, work
from quillspark.sources import files
from quillspark.streaming import streams


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_bytes_of_texts(spark):
    text = "aé日x"
    for n in range(9):
        assert one(spark, records.utf8_head(F.col("t"), n), t=text) == text.encode()[:n].decode(errors="ignore")
        assert one(spark, records.utf8_tail(F.col("t"), n), t=text) == (text.encode()[len(text.encode()) - n :] if n and n < 7 else text.encode() if n else b"").decode(errors="ignore")


def test_sources(spark):
    log = [("a.py", k, f"s{k}\th{k}\t2024\tme\tsubject\twith tab {k}") for k in range(7)] + [("b.py", 0, "bad line")]
    got = files.file_history(spark.createDataFrame(log, "path string, ordinal int, value string"), most=2).collect()
    assert [(r.path, r.short, r.subject) for r in got] == [("a.py", "s0", "subject\twith tab 0"), ("a.py", "s1", "subject\twith tab 1")]
    parsed = files.strict_json(spark.createDataFrame([('{"a": 1}',), ('{"a": 1,}',), ("no",)], "body string"), "body", "a int").collect()
    assert [r.broken for r in parsed] == [False, True, True] and parsed[0].parsed.a == 1
    lists = [spark.createDataFrame([(p,) for p in x], "path string") for x in ("ba", "c", "a")]
    assert [r.path for r in files.changed_paths(*lists).collect()] == ["a", "b", "c"]
    said = ['[{"file": "a", "line": 3, "message": "m1"}, {"file": "b"}]', '{"diagnostics": [{"file": "c", "message": "m2", "severity": "error"}]}', 'noise\n{"file": "d", "message": "m3"}\n{"file": "e", "message": "m4", "column": 2}', "nothing"]
    got = files.diagnostics_json(spark.createDataFrame([(x,) for x in said], "body string"), "body").collect()
    assert sorted((r.file, r.line, r.column, r.message, r.severity) for r in got) == [("a", 3, None, "m1", "warning"), ("c", None, None, "m2", "error"), ("d", None, None, "m3", "warning"), ("e", None, 2, "m4", "warning")]
    some = [("x.json", '[{"id": "1"}, {"id": "2"}]'), ("y.json", '{"id": "3"}'), ("z.json", "[broken"), ("e.json", "[]")]
    good, bad = files.definition_files(spark.createDataFrame(some, "path string, body string"), "path", "body", "id string")
    assert [(r.path, r.id) for r in good.collect()] == [("x.json", "1"), ("x.json", "2")] and {r.path: r.problem for r in bad.collect()} == {"y.json": "must contain an array", "z.json": "could not be parsed"}


def test_paths(spark):
    names = ["src/a.ts", "src/a.rb", "node_modules/x/a.ts", "a/build/b.py", "tmp/c.py", "docs/x.md", "w/one/q.svelte", "w/one/package.json"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    keep = lambda c: [r.p for r in df.where(c).collect()]
    assert keep(globs.is_source(F.col("p"))) == ["src/a.ts", "node_modules/x/a.ts", "a/build/b.py", "tmp/c.py", "w/one/q.svelte"]
    assert keep(globs.watched(F.col("p"), ["tmp/**"])) == ["src/a.ts", "src/a.rb", "docs/x.md", "w/one/q.svelte", "w/one/package.json"]
    assert keep(globs.matches(F.col("p"), globs.default_patterns(["w/*"]))) == ["src/a.ts", "docs/x.md", "w/one/q.svelte", "w/one/package.json"]
    found = spark.createDataFrame([("a", "unchanged"), ("b", "added"), ("c", "deleted"), ("d", "unchanged")], "path string, change string")
    hints = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("x",)], "path string")
    assert dict(map(tuple, rollups.hinted(found, hints, "path").collect())) == {"a": "changed", "b": "added", "c": "deleted", "d": "unchanged", "x": "deleted"}


def test_batches_of_texts(spark):
    sizes = [10] * 17 + [63_990, 20, 70_000, 5]
    df = spark.createDataFrame([("g", k, "x" * n) for k, n in enumerate(sizes)] + [("h", 0, None)], "g string, k int, body string")
    got = {(r.g, r.k): r.batch for r in chunks.batches(df, "g", "k", "body").collect()}
    assert [got["g", k] for k in range(21)] == [0] * 16 + [1, 1, 2, 3, 4]
    assert got["h", 0] == 0
    for b in set(got.values()):
        mine = [sizes[k] for (g, k), x in got.items() if g == "g" and x == b]
        assert len(mine) <= 16 and (sum(mine) <= 64_000 or len(mine) == 1)


def test_index_upkeep(spark):
    old = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    new = spark.createDataFrame([(3, [1.0, 1.0])], old.schema)
    assert sorted(r.id for r in index.inserted(old, new, "id", "v", 2).collect()) == [1, 2, 3]
    for bad in ([(2, [1.0, 1.0])], [(4, [1.0])], [(5, [1.0, 1.0]), (5, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            index.inserted(old, spark.createDataFrame(bad, old.schema), "id", "v", 2)
    assert [r.id for r in index.without_deleted(old, new.select(F.lit(2).alias("id")), "id").collect()] == [1]
    assert [index.mode(*x) for x in (("ready", False, True), ("ready", True, True), ("stale", False, True), ("ready", False, False))] == ["delta", "full", "full", "full"]
    assert chunks.healthy(old, 2, "m", "m") == "ready" and chunks.healthy(old, 3, "m", "m") == chunks.healthy(old, 2, None, "m") == "stale"
    assert sorted((r.id, r.v[0]) for r in events.upserted(old, spark.createDataFrame([(2, [9.0])], old.schema), ["id"]).collect()) == [(1, 1.0), (2, 9.0)]


def test_rules_of_texts(spark, tmp_path):
    context = rules.Context({"files": spark.createDataFrame([("src/bad/a.py", "old()\nfine\nold()"), ("src/ok/b.py", "evil evil devil")], "path string, text string")})
    known = spark.createDataFrame([("src/bad/a.py", 1)], "file string, line int")
    assert sorted((r.line, r.severity) for r in rules.migration_references(r"old\(", known)(context).collect()) == [(1, "warning"), (3, "error")]
    assert [r.message for r in rules.folder_structure("src", ["ok"])(context).collect()] == ["folder not allowed: bad"]
    assert [(r.file, r.line, r.message) for r in rules.restricted_text(["evil"])(context).collect()] == [("src/ok/b.py", 1, "restricted: evil")]
    found = rules.restricted_text(["evil", "fine"])(context)
    rules.write_baseline(found.where("line = 1"), f"{tmp_path}/baseline")
    assert {r.file: r.known for r in rules.with_baseline(found, rules.known_findings(spark, f"{tmp_path}/baseline")).collect()} == {"src/ok/b.py": True, "src/bad/a.py": False}


def test_definitions(spark):
    rows = [("area", "a", 2, "late", ["x"], ["b"]), ("area", "a", 1, "first", ["x"], []), ("spec", "s", 3, None, [], ["a", "a"])]
    df = spark.createDataFrame(rows, "kind string, id string, ordinal int, title string, owns array<string>, needs array<string>")
    assert {(r.kind, r.id): r.title for r in definitions.nodes(df).collect()} == {("area", "a"): "first", ("spec", "s"): None}
    assert sorted((r.id, r.relation, r.target) for r in definitions.edges(df, {"owns": "owns", "needs": "depends-on"}).collect()) == [("a", "depends-on", "b"), ("a", "owns", "x"), ("s", "depends-on", "a")]
    paths = spark.createDataFrame([("a.md",), ("b.py",)], "path string")
    got = definitions.governing(paths, "path", {"c1": ["*.md"], "c2": ["**"]}, spark.createDataFrame([("b.py", "c1"), ("z", "c9")], "path string, convention string"), spark.createDataFrame([("c3",)], "convention string"))
    assert {r.convention: (r.sources, r.n_files) for r in got.collect()} == {"c1": (["applies", "impact-surface"], 2), "c2": (["applies"], 2), "c3": (["explicit"], 0)}


def test_attributes_tags_and_windows(spark, tmp_path):
    many = {f"k{n:02d}": str(n) for n in range(6)}
    got = spark.createDataFrame([(many,), ({"a": "1"},)], "m map<string,string>").select(work.bounded_attributes(F.col("m"), 4).alias("m")).collect()
    assert got[0].m == {"k00": "0", "k01": "1", "k02": "2", "otel.metric.overflow": "true"} and got[1].m == {"a": "1"}
    tags = facts.tag_facts(spark.createDataFrame([("f", 1, "@owner me @since 2"), ("f", 2, "none")], "file string, line int, text string")).collect()
    assert [(r.line, r.tag) for r in tags] == [(1, "owner"), (1, "since")]
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00"), ("z", "2024-01-02 00:00:00")], "k string, at string")
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    counted = streams.windowed_counts(spark.readStream.schema("k string, at string").json(f"{tmp_path}/in"), "at", "k")
    query = counted.writeStream.format("memory").queryName("windowed").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.table("windowed").collect()} == {("a", 2), ("b", 1), ("z", 1)}
