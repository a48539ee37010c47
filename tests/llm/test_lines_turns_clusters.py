"""Line deduplication, conversation repair and clustering against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import clustering, conversations, linededup

LOWER = str.maketrans(linededup.UPPER, linededup.SMALL)


def brute_lines(rows, length=20, documents=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    lines = [(t or "").split("\n") for _, t in rows]
    ids = [-math.inf if i is None else i for i, _ in rows]
    for r, found in enumerate(lines):
        for x in {key(x) for x in found}:
            holders.setdefault(x, []).append(ids[r])
    out = []
    for r, found in enumerate(lines):
        kept = [x for x in found if len(key(x)) < length or len(holders[key(x)]) < documents or ids[r] == max(holders[key(x)])]
        out.append((rows[r][0], len(found), len(found) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 5, 7])
def test_lines_against_all_lines(spark, batches):
    rng = random.Random(batches)
    pool = [f"{k} a line that is long enough É" for k in range(12)] + ["short", "", "  ", "exactly twenty chars", "only nineteen chars", "ünïcödé of just 20 c"]
    turn = lambda x: rng.choice([x, x.upper(), f" \t{x}\r", f"\x0b{x}\x0c ", x.replace("É", "é")])
    rows = [(k * 37 % 1000, "\n".join(turn(rng.choice(pool)) for _ in range(rng.randrange(9)))) for k in range(120)]
    rows += [(None, pool[0]), (None, None), (5000, None), (5001, ""), (5002, "\n"), (5003, "\n".join(pool * 50)), (5003, pool[1]), (5004, pool[2]), (5004, pool[2]), (5005, "x" * 200_000), (5006, "X" * 200_000), (7, "x" * 200_000)]
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], "doc_id long, text string, line string, doc int").repartition(6)
    got = linededup.deduplicated(df, batches=batches)
    assert sorted(map(tuple, got.drop("kept").collect()), key=str) == brute_lines(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_lines_of_an_empty_table_and_spent_runs(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.deduplicated(df).collect() == []
    assert not [d.name for d in spark.catalog.listDatabases() if d.name.startswith("line_runs")]
    same = spark.createDataFrame([(k, "the same line in all of them\nown %d" % k) for k in range(50)], df.schema)
    assert {r.doc_id: r.n_dropped for r in linededup.deduplicated(same).collect()} == {k: int(k < 49) for k in range(50)}


def brute_repair(rows):
    """rows: role, text and fault, in order. All edits by cost, then by their string."""
    blocked = [f in ("blank", "duplicate") for _, _, f in rows]
    extra = [3 if f == "truncated" else 0 for _, _, f in rows]
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = ("" if not roles else "s" if roles == "s" else roles[-1], i)
        if state in seen:
            continue
        seen.add(state)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        fits = lambda r: bool(re.fullmatch("s?(ua)*u?", roles + r))  # noqa: E731, B023
        for r in "ua":
            if fits(r):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
                if i < len(rows) and not blocked[i]:
                    heapq.heappush(heap, (cost + 3 + extra[i], audit + "R", i + 1, roles + r))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if not blocked[i] and rows[i][0][:1] in ("s", "u", "a") and fits(rows[i][0][0]):
                heapq.heappush(heap, (cost + extra[i], audit + "K", i + 1, roles + rows[i][0][0]))
    out, at, names = [], 0, {"u": "user", "a": "assistant"}
    for letter in audit:
        if letter != "D":
            kept = roles[len(out)]
            out.append(f"{rows[at][0] if letter == 'K' else names[kept]}:{'' if letter == 'I' else rows[at][1]}")
        at += letter != "I"
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_conversations(rows):
    groups = {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        group += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, found = set(), []
        for _, role, text in group:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            found.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none"))
            seen.add((role, text))
        turns = [t for t, _, _ in group if t is not None]
        count = [sum(f == x for _, _, f in found) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, *brute_repair(found)))
    return sorted(out, key=str)


def test_conversations_against_all_edits(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "sage", "uncle"])
            text = rng.choice(["One.", "Two!", "Three? ", "four", " five\n", "é. \t", "", " \t", None, "a:b."])
            rows.append((conv, rng.choice([turn] * 9 + [None, turn - 1, turn + 3]), role, text))
    rows += rows[:20]
    rows += [(next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0), 0, "user", "All is dropped.")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, fault string, seq int").repartition(5)
    got = conversations.repaired(conversations.damaged(df))
    assert sorted(map(tuple, got.collect()), key=str) == brute_conversations(rows)
    assert any(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got.collect())
    assert conversations.repaired(conversations.damaged(df.limit(0))).collect() == []


def test_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = conversations.repaired(df).collect()
    assert (got.gaps, got.illegal, got.cost, got.audit) == (0, 0, 6, "I" + "K" * 3000 + "I")
    kept = ["user:", *(f"{r[2]}:{r[3]}" for r in rows), "assistant:"]
    assert got.repaired_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_distances_and_audits():
    rng = random.Random(4)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(400):
        symbols = "".join(rng.choice("uauasoUASO-") for _ in range(rng.randrange(10)))
        rows = [(names.get(x.lower(), "user"), "t", "blank" if x == "-" else "truncated" if x.isupper() else "none") for x in symbols]
        assert conversations.repair(symbols) == brute_repair(rows)[:2]


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        found = {}
        for _, v in kept:
            found.setdefault(near(v)[1], []).append(v)
        for n, vs in found.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    last = [(i, *near(v)) for i, v in kept]
    total = {}
    for _, d, n in last:
        total[n] = total.get(n, 0) + d
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in last), key=str)


@pytest.mark.parametrize("spread", [0.001, 0.2, 1e4])
def test_clusters_against_all_distances(spark, spread, monkeypatch):
    monkeypatch.setattr(clustering, "TREE", 100)
    monkeypatch.setattr(clustering, "LEAF", 4)
    rng = random.Random(6)
    middles = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, spread) for x in middles[k % 5]]) for k in range(500)]
    rows += [(600 + k, [0.25] * 8) for k in range(150)] + [(600, [0.25] * 8), (None, [0.5] * 8), (800, None), (801, [0.1] * 7), (802, [0.1] * 7 + [None]), (803, [float("nan")] * 8), (804, [float("inf")] * 8), (805, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = clustering.clustered(df, k=9, dims=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 9, 5, 8)
    few = df.where("vec_id < 4")
    assert sorted(map(tuple, clustering.clustered(few, k=9, dims=8).collect()), key=str) == brute_clusters(rows[:4], 9, 5, 8)
    assert clustering.clustered(df.limit(0)).collect() == []
    huge = spark.createDataFrame([(k, [(-1.0) ** k * 10.0 ** (k * 30)] * 64) for k in range(10)], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in clustering.clustered(huge, k=3).collect()} == set(range(10))


def test_balls_go_as_a_whole():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-9, 9, (600, 16)) + c for c in (0, 1000, -1000)])
    tree = clustering.BallTree.build(v, np.arange(len(v)))
    assert (np.sort(tree.ids) == np.arange(len(v))).all() and (tree.total[0] == v.sum(0)).all() and tree.end[0] == len(v)
    centroids = np.stack([np.full(16, c) for c in (0, 1000, -1000)])
    ball, each = tree.assigned(centroids)
    assert (ball >= 0).sum() >= 3 and (each >= 0).sum() < 100
    n, total = tree.sums(centroids)
    assert n.tolist() == [600, 600, 600] and (total == np.stack([v[a : a + 600].sum(0) for a in (0, 600, 1200)])).all()
    big = v.astype(np.int64) * (1 << 24)
    assert (clustering.squared(big, big[:3]) == ((big[:, None] - big[None, :3]) ** 2).sum(2)).all()
