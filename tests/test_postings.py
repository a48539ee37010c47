"""The written index against a search that reads every text."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.operators import cuts, postings, search


def plain_words(text):
    folded = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", folded)


def plain_scores(rows, wanted, every=False):
    words = {i: [plain_words(t) for t in fields] for i, *fields in rows}
    length = {i: sum(map(len, w)) for i, w in words.items()}

    def times(w, p):
        return sum(all(w[k + j] == x for j, x in enumerate(p[:-1])) and w[k + len(p) - 1].startswith(p[-1]) for k in range(len(w) - len(p) + 1))

    tf = {i: [sum(times(w, p) for w in fields) for p in wanted] for i, fields in words.items()}
    n, avg = len(rows), sum(length.values()) / len(rows)
    idf = [max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) for d in (sum(t[k] > 0 for t in tf.values()) for k in range(len(wanted)))]
    return {i: sum(w * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * length[i] / avg)) for w, x in zip(idf, t)) for i, t in tf.items() if (all if every else any)(t)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    pool = ["foo", "foobar", "bar", "barn", "Übung", "ubung", "naïve", "état", "état", "x1", "the", "the", "the", "日本", "straße"]
    text = lambda: rng.choice([" ", "_", ", "]).join(rng.choice(pool) for _ in range(rng.choice([1, 3, 8, 30])))
    return [(k, rng.choice([None, text()]), text()) for k in range(300)] + [(900, None, None), (901, "", "...")]


@pytest.mark.parametrize(("block", "first", "named", "every"), [(1024, 4, 500, True), (4, 1, 500, False), (4, 2, 1, False)])
def test_search_against_all_texts(spark, rows, block, first, named, every, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "NAMED", named)
    chunks = spark.createDataFrame(rows, "id long, heading string, text string")
    index = postings.build(chunks, "id", ["heading", "text"], postings.UNICODE)
    for query in (["the", "ubun"], ["foo_bar"], ["the_the_fo", "etat"], ["zzz_foo"], ["x1", "nai", "stra"]):
        wanted = postings.phrases(query, "[a-z0-9]+")
        want = plain_scores(rows, wanted, every)
        best = sorted(((-round(s, 9), i) for i, s in want.items()))
        got = postings.search(index, wanted, 7, every=every).collect()
        assert [r.id for r in got] == [i for _, i in best[:7]] and all(abs(r.score - want[r.id]) < 1e-9 for r in got), query
        every_hit = postings.scored(index, wanted, every=every).collect()
        assert {r.id: round(r.score, 9) for r in every_hit} == {i: round(s, 9) for i, s in want.items()}
    assert postings.search(index, [], 5).collect() == [] and search.knowledge(index, "é ! _", 5).collect() == []


def test_index_is_read_in_part_and_kept(spark, tmp_path):
    rows = [(k, f"word{k % 997} common") for k in range(5000)]
    df = spark.createDataFrame(rows, "id long, text string")
    df.write.parquet(f"{tmp_path}/chunks")
    over = spark.read.parquet(f"{tmp_path}/chunks")
    index = postings.index_of("t", over, over, "id", ["text"], postings.ASCII)
    assert postings.index_of("t", over, over, "id", ["text"], postings.ASCII) is index
    again = postings.Index(spark, index.folder)
    got = postings.search(again, [("word12",)], 100)
    assert len(got.collect()) == sum(f"word{k % 997}".startswith("word12") for k in range(5000))
    plan = got._jdf.queryExecution().toString()
    assert "StringStartsWit" in plan and f"{tmp_path}/chunks" not in plan
    df.withColumn("id", F.col("id") + 1).write.mode("append").parquet(f"{tmp_path}/chunks")
    assert postings.index_of("t", spark.read.parquet(f"{tmp_path}/chunks"), over, "id", ["text"], postings.ASCII) is not index
    assert postings.search(postings.build(df.limit(0), "id", ["text"], postings.ASCII), [("a",)], 3).collect() == []
    assert [(r.id, round(r.bm25, 9)) for r in search.lexical(index, "word1 common", 20, "id").collect()] == [(r.id, round(r.bm25, 9)) for r in search.bm25(over, "word1 common", 20, "id").collect()]


def test_index_is_packed_where_texts_are_read(spark, rows, tmp_path, monkeypatch):
    """Nothing but the index is written, a row for each word and block, and tasks pack apart."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "PACKED", 90)
    shared = tmp_path / "shared"
    monkeypatch.setattr(postings, "shared_folder", lambda spark: str(shared))
    written = []
    monkeypatch.setattr(postings, "cut", lambda df, f=postings.cut: written.append(1) or f(df))
    long = [(1000, "the " * 500, "ubung foo bar " * 300)]
    chunks = spark.createDataFrame(rows + long, "id long, heading string, text string").repartition(3)
    index = postings.build(chunks, "id", ["heading", "text"], postings.UNICODE)
    assert not written and sorted(p.name for p in shared.glob("*/*")) == ["postings", "stats"]
    every = index.table("postings").select("term", "block", F.size("ids").alias("n")).collect()
    assert len({r.block for r in every}) > 30 and len({(r.term, r.block) for r in every}) == len(every) and all(r.n <= 4 for r in every)
    assert sum(r.n for r in every if not r.term) == len(rows) + 1
    for query in (["the", "ubun"], ["foo_bar", "etat"]):
        wanted = postings.phrases(query, "[a-z0-9]+")
        want = plain_scores(rows + long, wanted)
        assert {r.id: round(r.score, 9) for r in postings.scored(index, wanted).collect()} == {i: round(s, 9) for i, s in want.items()}
        best = sorted((-round(s, 9), i) for i, s in want.items())[:9]
        assert [r.id for r in postings.search(index, wanted, 9).collect()] == [i for _, i in best]


def test_knowledge_search_leaves_its_index_alone(spark, tmp_path, monkeypatch):
    """The query keeps no table of words beside the index of its seven fields."""
    monkeypatch.setattr(postings, "_BUILT", {})
    monkeypatch.setattr(postings, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(cuts, "shared_folder", lambda spark: str(tmp_path))
    assert catalog.QUERIES["knowledge_search"](spark, "/root/testdata/sf0.001").count() > 0
    size = {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in tmp_path.iterdir()}
    index = sum(n for name, n in size.items() if name.startswith("postings-"))
    assert index > 0 and sum(size.values()) - index < index / 10, size
