"""The graph kept up to date against the graph built from nothing, over random edits."""

import random

from quillspark.operators import incremental

FILES = "path string, content_hash string, parser string, extractor string"


def test_random_edits(spark):
    rng = random.Random(5)
    tree, number = {}, 0

    def facts():
        nonlocal number
        number += 1
        nodes = [(number * 100 + k, rng.choice(["f", "g", "h", "default", "k", "m"]), rng.random() < 0.7) for k in range(rng.randrange(4))]
        refs = [(number * 100 + k, rng.choice("fghkm"), rng.choice(["call", "import-module"]), rng.choice(["python", "ts", "ts"]), rng.choice([None, "s"]), rng.choice([None, "p0", "p1", "p2", "p3"])) for k in range(4)]
        wanted = [(rng.choice("fghkm"), rng.choice(["import-named", "import-default", "import-all"]), f"p{rng.randrange(7)}") for _ in range(2)]
        return str(number), nodes, refs, wanted

    def extract(some):
        paths = {r.path for r in some.collect()}
        rows = [[(*x[:1], p, *x[1:]) for p in sorted(paths) for x in tree[p][k]] for k in (1, 2)]
        return (
            spark.createDataFrame(rows[0], "id long, path string, name string, exported boolean"),
            spark.createDataFrame(rows[1], "ref long, path string, name string, kind string, language string, source string, source_path string"),
            spark.createDataFrame([(p, *x) for p in sorted(paths) for x in tree[p][3]], "path string, name string, kind string, target_path string"),
        )

    files = lambda parser="1": spark.createDataFrame([(p, t[0], parser, "1") for p, t in tree.items()], FILES)
    tree |= {f"p{k}": facts() for k in range(6)}
    state = incremental.built(files(), extract)
    for step in range(4):
        for p in rng.sample(sorted(tree), 2):
            tree[p] = facts()
        if step % 2:
            tree.pop(rng.choice(sorted(tree)))
            tree[f"p{rng.randrange(9)}"] = facts()
        state, what = incremental.updated(state, files(), extract)
        full = incremental.built(files(), extract)
        order = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert order(state.resolved) == order(full.resolved) and order(state.nodes) == order(full.nodes), step
        assert 2 <= what.count() <= 5
    same, what = incremental.updated(state, files(), extract)
    assert same is state and what.count() == 0
    assert {r.change for r in incremental.differences(state.files, files("2")).collect()} == {"changed"}
