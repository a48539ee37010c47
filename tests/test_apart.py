"""Rules that run apart: one that fails in a task leaves the others' findings."""

from pyspark.sql import functions as F

from quillspark.operators import rules


def test_failing_rules_stop_no_other(spark):
    files = spark.createDataFrame([("a.ts", "x"), ("b.ts", "secret")], "path string, text string")
    context = rules.Context({"files": files})

    def broken_plan(c):
        return rules.findings(c.files.select("nothing"), "plan", F.lit("no"))

    def raises(c):
        raise RuntimeError("not today")

    registry = {
        "good": lambda c: rules.findings(c.files.where("text = 'secret'"), "good", F.lit("found"), file="path"),
        "in-a-task": lambda c: rules.findings(c.files.where(F.when(F.col("text") == "x", F.raise_error(F.lit("task gone wrong"))).otherwise(F.lit(True)).cast("boolean")), "task", F.lit("no"), file="path"),
        "none": lambda c: rules.findings(c.files.where("text = 'absent'"), "none", F.lit("no"), file="path"),
        "plan": broken_plan, "raises": raises,
        "wrong-shape": lambda c: c.files,
        "last": lambda c: rules.findings(c.files, "last", F.lit("every file"), "warning", file="path"),
    }
    found, outcomes = rules.run_apart(context, registry)
    assert sorted((r.rule_id, r.file) for r in found.collect()) == [("good", "b.ts"), ("last", "a.ts"), ("last", "b.ts")]
    got = {r.rule_id: r for r in outcomes.collect()}
    assert {k: (r.outcome, r.n_findings) for k, r in got.items()} == {"good": ("findings", 1), "last": ("findings", 2), "none": ("passed", 0), **dict.fromkeys(("in-a-task", "plan", "raises", "wrong-shape"), ("error", 0))}
    assert "task gone wrong" in got["in-a-task"].error and got["raises"].error == "not today" and all(r.seconds >= 0 for r in got.values())
    assert [r.rule_id for r in outcomes.collect()] == sorted(registry)
