"""Token budgets, free ids, pairs that are pruned together, and the queue of work."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunks, events, lifecycle


@pytest.mark.parametrize("budget", [1, 3, 8])
def test_token_pieces(spark, budget):
    rng = random.Random(budget)
    texts = ["".join(rng.choice(["word", "a", " ", "  ", "\n", "\n\n", ", ", "é_1", "日", "!", " \n "]) for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "   ", "x" * 500, "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for costly in (False, True):
        size = {"count": lambda t: F.when(F.contains(t, F.lit("word")), 2).otherwise(1)} if costly else {}
        got = {}
        for r in chunks.token_pieces(df, budget, "id", "body", **size).orderBy("id", "piece_no").collect():
            got.setdefault(r.id, []).append(r)
        for i, t in enumerate(texts):
            pieces = got.get(i, [])
            assert "".join(r.piece for r in pieces) == (t or "") and [r.piece_no for r in pieces] == list(range(len(pieces)))
            for r in pieces:
                tokens = re.findall(r"\w+|[^\s\w]", r.piece)
                cost = sum(2 if costly and "word" in x else 1 for x in tokens)
                assert t[r.start : r.end] == r.piece and r.n_tokens >= cost and (r.n_tokens <= budget or len(tokens) == 1)


def test_pieces_end_at_lines_and_blanks(spark):
    df = spark.createDataFrame([(1, "one two\nthree four five six seven"), (2, "aa.bb.cc.dd.ee")], "id int, body string")
    got = [(r.id, r.piece) for r in chunks.token_pieces(df, 4, "id", "body").orderBy("id", "piece_no").collect()]
    assert got == [(1, "one two\nthree four "), (1, "five six seven"), (2, "aa.bb."), (2, "cc.dd."), (2, "ee")]
    assert [r.piece for r in chunks.token_pieces(df, 3, "id", "body").where("id = 1").orderBy("piece_no").collect()] == ["one two\n", "three four five ", "six seven"]


def test_free_ids(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", "3", "5", None])) for k in range(60)]
    digest = lambda base, n: F.substring(F.md5(F.concat(base, n.cast("string"))), 1, 1)
    few = rows[:14]
    got = {r.k: r.unique_id for r in chunks.free_ids(spark.createDataFrame(few, "k int, id string"), "id", ["k"], digest).collect() if r.id is not None}
    taken, waiting = {}, []
    for k, i in few:
        if i is not None and i not in taken.values():
            taken[k] = i
        elif i is not None:
            waiting.append((k, i, 1))
    while waiting:
        given, later, used = {}, [], set(taken.values())
        for k, i, n in waiting:
            new = hashlib.md5(f"{i}{n}".encode()).hexdigest()[0]
            if new in used or new in given.values():
                later.append((k, i, n + 1))
            else:
                given[k] = new
        taken |= given
        waiting = later
    assert got == taken and len(set(got.values())) == len(got)


def test_free_ids_of_a_crowded_space(spark, monkeypatch):
    """As many rounds as the last row has numbers would take hundreds here."""
    cuts = []
    monkeypatch.setattr(chunks, "cut_point", lambda df, f=chunks.cut_point: cuts.append(1) or f(df))
    rows = [(k, None if k % 50 == 49 else f"b{k % 3}", k % 7) for k in range(220)]
    digest = lambda base, n: F.substring(F.md5(F.concat(base, n.cast("string"), F.lit(":"), F.col("g").cast("string"))), 1, 2)
    df = spark.createDataFrame(rows, "k int, id string, g int")
    got = {r.k: r.unique_id for r in chunks.free_ids(df, "id", ["k"], digest, alike=[F.col("g")], space=256).collect()}
    want, waiting, n = {}, [], 0
    for k, i, g in rows:
        if i is None or i not in want.values():
            want[k] = i
        else:
            waiting.append((k, i, g))
    while waiting:
        n, used = n + 1, set(want.values())
        for k, i, g in waiting:
            new = hashlib.md5(f"{i}{n}:{g}".encode()).hexdigest()[:2]
            if new not in used:
                used.add(new)
                want[k] = new
        waiting = [r for r in waiting if r[0] not in want]
    assert got == want and n > 40 and len(cuts) < n / 2, (n, len(cuts))
    with pytest.raises(ValueError, match="rows want ids"):
        chunks.free_ids(df, "id", ["k"], digest, space=100)


def test_pruned_pair(spark):
    jobs = spark.createDataFrame([(1, "done", 10), (2, "done", 20), (3, "open", 1), (4, "done", 30), (5, "done", 2)], "id int, state string, at int")
    children = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (4, "d"), (5, "e"), (9, "orphan"), (None, "none")], "job int, name string")
    runs, kids, counts = events.pruned_pair(jobs, children, F.col("state") == "done", "at", F.lit(5), 2, "id", "job")
    assert sorted(r.id for r in runs.collect()) == [2, 3, 4] and sorted(r.name for r in kids.collect()) == ["c", "d"]
    assert counts.first().asDict() == {"deleted_runs": 2, "deleted_children": 5, "retained_terminal": 2}


def test_steps_say_all_that_is_wrong(spark):
    rows = [("closed", "running", "running", 2, False), ("closed", "running", "review", 0, True), ("started", "running", "planned", 0, True), ("started", "running", "planned", 1, True), ("claimed", "running", "planned", 1, True), ("claimed", "closed", "planned", 0, True), ("review", "running", "planned", 0, True), ("started", "running", None, 0, True)]
    df = spark.createDataFrame(rows, "kind string, change string, task string, n int, passed boolean")
    got = [r.issues for r in df.select(lifecycle.task_step_issues(*[F.col(c) for c in df.columns]).alias("issues")).collect()]
    assert got == [
        ["status is running", "open dependencies", "move it to review first", "checks must pass"], [], ["status is planned", "claim it first"], ["status is planned", "open dependencies"], ["status is planned", "open dependencies"], ["the change is closed"],
        ["status is planned", "start it and complete its checks first"], ["unknown task"],
    ]
    both = spark.createDataFrame([("closed", "running", 3)], "kind string, status string, n int").select(lifecycle.change_step_issues(F.col("kind"), F.col("status"), F.col("n"))).first()[0]
    assert both == ["unfinished tasks", "status is running; move it to review first"]
