"""References resolve without a row for each supplier and part of one size."""

import duckdb

import __spark_entry__ as entry
from quillspark.operators import graph


def above(plan, word):
    """The operators over the first line of a plan that has ``word``, up to the next join."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.splitlines()]
    at = next(i for i, (_, x) in enumerate(lines) if "Relation" in x and word in x)
    depth, found = lines[at][0], []
    for d, x in reversed(lines[:at]):
        if d < depth:
            depth = d
            found.append(x.lstrip(" :+-").split(" ")[0])
            if found[-1] == "Join":
                return found
    raise AssertionError("no join")


def test_sides_shrink_before_they_meet(spark, tmp_path):
    db = duckdb.connect()
    db.sql(f"copy (select k as p_partkey, 'Brand#' || (k % 25 + 1) as p_brand, 'n' || (k % 90) as p_name, k % 50 + 1 as p_size from range(200) t(k)) to '{tmp_path}/part.parquet'")
    db.sql(f"copy (select k as s_suppkey from range(400) t(k)) to '{tmp_path}/supplier.parquet'")
    db.sql(f"copy (select k as l_orderkey, 1 as l_linenumber, k % 200 as l_partkey, k * 7 % 400 as l_suppkey from range(900) t(k)) to '{tmp_path}/lineitem.parquet'")
    got = entry.queries()["resolve_precedence"](spark, str(tmp_path))
    assert "Aggregate" in above(got._jdf.queryExecution().optimizedPlan().toString(), "s_suppkey")
    for t in ("part", "supplier", "lineitem"):
        db.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()["resolve_precedence"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and {w[2] for w in want} >= {"same-file", "import"}


def test_imports_of_several_nodes_are_as_none(spark):
    nodes = spark.createDataFrame([(1, "a", "f", True), (2, "a", "f", True), (3, "b", "f", True), (4, "c", "g", True), (5, "c", "g", False), (6, "d", "g", True)], "id int, path string, name string, exported boolean")
    imports = spark.createDataFrame([("x", "f", "a"), ("y", "f", "b"), ("z", "f", "a"), ("z", "f", "b"), ("x", "g", "c"), ("y", "g", "c"), ("y", "g", "d"), ("w", "f", "b"), ("w", "f", "b")], "path string, name string, target_path string")
    refs = spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate([("x", "f"), ("y", "f"), ("z", "f"), ("x", "g"), ("y", "g"), ("w", "f")])], "ref int, path string, name string")
    found = graph.resolve(refs, nodes, imports)
    assert {r.ref: r.target for r in found.collect()} == {0: None, 1: 3, 2: None, 3: 4, 4: None, 5: None}
