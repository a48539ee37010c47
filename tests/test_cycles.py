"""Cycles and their paths against a plain search, and the rounds that long chains take."""

import random

import pytest

from quillspark.operators import graph


def plain_cycles(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def steps(a):
        seen, now, n = {}, [a], 0
        while now:
            n += 1
            now = [y for y in {y for x in now for y in out.get(x, ())} if y not in seen]
            seen |= dict.fromkeys(now, n)
        return seen

    reach = {a: steps(a) for a in out}
    own = {a: min(b for b in reach[a] if a in reach.get(b, {})) for a in out if a in reach[a]}
    paths = []
    for head in set(own.values()):
        left = {v: 0 if v == head else reach[v][head] for v, c in own.items() if c == head}
        paths.append((head, 0, head))
        at, place = min((1 + left[y], y) for y in out[head] if y in left)[1], 1
        while at != head:
            paths.append((head, place, at))
            at, place = min((1 + left[y], y) for y in out[at] if y in left)[1], place + 1
    return sorted(own.items()), sorted(paths)


@pytest.mark.parametrize("seed", [1, 3])
def test_cycles_against_plain_search(spark, seed):
    rng = random.Random(seed)
    n = [14, 30, 40, 60][seed]
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range([20, 30, 44, 90][seed])} | {(100 + k, 100 + (k + 1) % 9) for k in range(9)} | {(200, 200), (200, 201)}
    edges |= {(300 + k, 301 + k) for k in range(12)} | {(312, 304), (305, 320), (320, 321), (321, 309)}
    own, paths = plain_cycles(edges)
    df = spark.createDataFrame(sorted(edges), "source long, target long").repartition(3)
    assert sorted(map(tuple, graph.cycles(df).collect())) == own
    assert sorted(map(tuple, graph.cycle_paths(df).collect())) == paths


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: rounds.append(1) or f(df))
    chain = spark.range(10_000).selectExpr("id as source", "id + 1 as target")
    assert graph.cycles(chain).count() == 0 and len(rounds) < 30
    rounds.clear()
    ring = chain.union(spark.createDataFrame([(10_000, 0), (20_000, 5)], "source long, target long"))
    assert sorted({r.cycle for r in graph.cycles(ring).collect()}) == [0] and len(rounds) < 70
    assert graph.cycles(spark.createDataFrame([], "source long, target long")).count() == 0
