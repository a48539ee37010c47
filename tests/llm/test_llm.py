"""Every operator against a plain version, and its behaviour at the edges."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, entry, langid, mixing, sharding, similarity, substrings, textkit, topk, toxicity, urlfilter

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score double, shard string, n_hit long"


def words_of(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets_of(texts, n):
    out = []
    for t in texts:
        w = words_of(t, r"[^\x20\x09-\x0D]+")
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def random_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns."""
    rng = random.Random(3)
    base = random_text(rng, 90)
    near = base.split()
    near[4] = "changed"
    long = random_text(rng, 40_000, 100_000)
    rows = [
        (1, base, "en", "a"), (2, base, None, "b"), (2, base, None, "b"), (3, " ".join(near), "en", None), (4, None, None, None), (5, "", "de", "a"),
        (6, " \t\n", "en", "a"), (7, long, "fr", "a"), (8, long + " tail", "fr", "c"), (None, base, "en", "a"), (9, "Ünï cödé", "de", "a"), (9, "other text of nine", "en", "a"),
        (10, "12 34 !!", "en", "b"), (11, "x" * 5000, "en", "b"), (12, "x" * 5000 + "y", "en", "b"), (13, "one", "en", "b"), (14, "ONE", "en", "b"),
    ]
    return [(*r, 0.5, "s", 7) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_words_across_segments(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abCD é\t\n1.") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "z" * 300]
    import pyarrow as pa

    raw, edges = textkit.buffers(pa.array(texts))
    for kind, pattern in ((textkit.BLANKS, rb"[^\x20\x09-\x0D]+"), (textkit.ALNUM, rb"[0-9A-Za-z\x80-\xff]+")):
        whole = textkit.words_of(raw, edges, kind)
        monkeypatch.setattr(textkit, "SEGMENT", 37)
        pieces = textkit.words_of(raw, edges, kind)
        monkeypatch.undo()
        for x, y in zip(whole, pieces):
            assert np.array_equal(x, y)
        at = whole[2]
        seen = {}
        for i, t in enumerate(texts):
            found = [m.group().lower() if m.group().isascii() else re.sub(rb"[A-Z]", lambda c: c[0].lower(), m.group()) for m in re.finditer(pattern, t.encode())]
            hashes = whole[0][at[i] : at[i + 1]].tolist()
            assert len(found) == len(hashes)
            for w, h in zip(found, hashes):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def brute_groups(rows, n, ratio):
    sets = sets_of([t for _, t in rows], n)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union and ratio.denominator * len(sets[a] & sets[b]) >= ratio.numerator * union and sets[a] and sets[b]:
                parent[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min((x for x in (least.get(find(a)), i) if x is not None), default=None)
    return sorted(((i, len(sets[a]), least[find(a)], links[a]) for a, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("n", "ratio"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_against_all_pairs(spark, n, ratio, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)  # components are cut into blocks
    rng = random.Random(n)
    rows = []
    for base in range(12):
        words = random_text(rng, rng.choice([2, 5, 12, 30, 80, 200])).split()
        for _ in range([1, 3, 25][base % 3]):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
            if rng.random() < 0.3:
                copy.append("tail")
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    rows += [(2000, ""), (2001, None)]
    got = similarity.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), n, ratio)
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows, n, ratio)


def test_jaccard_edges(spark, odd_rows):
    got = similarity.jaccard_groups(frame(spark, odd_rows), 3, Fraction(9, 10)).collect()
    assert len(got) == len(odd_rows)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[4, 0].component_id == 4 and by[5, 0].component_id == 5 and by[6, 0].n_links == 0
    assert by[8, 39_999].component_id == 7
    assert by[14, 1].component_id == 13 and by[13, 1].n_links == 1
    assert sorted(map(tuple, got), key=str) == brute_groups([r[:2] for r in odd_rows], 3, Fraction(9, 10))
    nulls = [(None, "a b c d"), (None, "a b c d"), (9, "e f g h"), (None, "e f g h"), (7, "e f g h"), (None, "alone"), (None, None)]
    got = similarity.jaccard_groups(spark.createDataFrame(nulls, "doc_id long, text string"), 3, Fraction(9, 10)).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(nulls, 3, Fraction(9, 10))
    assert similarity.jaccard_groups(frame(spark, []), 3, Fraction(9, 10)).collect() == []


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)] + [np.arange(60, dtype=np.uint64)] * 9
    got = similarity.overlaps(sets)
    for a in range(len(sets)):
        for b in range(len(sets)):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i + 1, i) for i in range(200, 260)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = similarity.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((a, find(a)) for a in list(parent))


def test_one_of_each_group(spark, odd_rows):
    df = frame(spark, odd_rows)
    kept = similarity.one_of_each_group(df)
    assert kept.columns == df.columns
    got = sorted(map(tuple, kept.collect()), key=str)
    # Of the group of document 1 the row without id stays; 2, its repetition and 3 go; of 13 and 14 the first stays.
    want = [r for r in odd_rows if r[0] not in (1, 2, 3, 8, 14)]
    assert got == sorted(want, key=str)
    twice = [(1, "a b c d e f g", None, None, None, None, None)] * 3 + [(2, "q r s t u", None, None, None, None, None)]
    assert sorted(r.doc_id for r in similarity.one_of_each_group(frame(spark, twice)).collect()) == [1, 2]


def test_paragraphs(spark):
    rng = random.Random(8)
    shared = random_text(rng, 60)
    changed = shared.split()
    changed[30] = "new"
    rows = [(k, random_text(rng, 50) + "\n" + random_text(rng, 40)) for k in range(20)]
    rows += [(20, random_text(rng, 30) + "\n" + shared), (21, " ".join(changed) + "\n" + random_text(rng, 30)), (22, shared), (23, "short line\nshort line"), (24, None), (25, "")]
    got = {r.doc_id: r for r in similarity.paragraph_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.removed for k, r in got.items() if r.n_removed} == {21: [0], 22: [0]}
    assert got[22].kept_in == [20] and got[24].n_paragraphs == 1 and got[0].n_paragraphs == 2
    assert similarity.tuned_bands(0.8, 3, 0.999) == 10


def brute_paragraphs(rows, least=10, part=25):
    """(doc_id, removed lines, cut lines, bytes removed, hash of the rest): all units against all, sub-paragraphs by plain loops."""
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    units, short, inner, lines_of = [], [], [], {}
    for r, (i, t) in enumerate(rows):
        i, lines = -(1 << 63) if i is None else i, (t or "").split("\n")
        lines_of[r] = lines
        w = [re.findall(r"[^\x20\x09-\x0D]+", low(x)) for x in lines]
        place = 0
        for k in range(len(lines)):
            if len(w[k]) >= least:
                units.append((i, place, r, k, 1, w[k]))
            elif w[k]:
                short.append((i, r, k, None, tuple(w[k])))
            place += 1
            if 0 < len(w[k]) < least and (k == 0 or not 0 < len(w[k - 1]) < least):
                j = k
                while j < len(lines) and 0 < len(w[j]) < least:
                    j += 1
                run = sum(w[k:j], [])
                if len(run) >= least:
                    units.append((i, place, r, k, j - k, run))
                    place += 1
            if len(w[k]) > 50:
                h = np.array([textkit.words_of(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]), textkit.BLANKS)[0][0] for x in w[k]])
                g = textkit.grams(h, 3)
                spots = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", lines[k])]
                for p in sorted({min(range(q, q + 26), key=lambda z: (g[z], z)) for q in range(len(g) - 25)}):
                    if p >= 11 and p + 14 <= len(w[k]):
                        inner.append((i, r, k, (spots[p - 11][0], spots[p + 14][0] if p + 14 < len(spots) else len(lines[k])), tuple(w[k][p - 11 : p + 14])))
    sets = [{tuple(u[5][a : a + 5]) for a in range(len(u[5]) - 4)} for u in units]
    parent = list(range(len(units)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(units)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if units[a][5] == units[b][5] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)), key=lambda z: (units[z][:2], z))
                parent[y] = x
    removed = {r: set() for r in range(len(rows))}
    for a, u in enumerate(units):
        if units[root(a)][:2] != u[:2]:
            removed[u[2]] |= set(range(u[3], u[3] + u[4]))
    left = [x for x in short + inner if x[2] not in removed[x[1]]]
    first = {}
    for i, *_, words in left:
        first[words] = min(first.get(words, i), i)
    cuts = {r: {} for r in range(len(rows))}
    again = [x for x in left if first[x[4]] < x[0]]
    for _, r, k, span, _ in again:
        if span is None:
            removed[r].add(k)
        else:
            cuts[r].setdefault(k, set()).update(range(*span))
    out = []
    for r, (i, t) in enumerate(rows):
        kept = []
        for k, x in enumerate(lines_of[r]):
            if k not in removed[r]:
                kept.append("".join(c for n, c in enumerate(x) if n not in cuts[r].get(k, ())) + "\n" * (k < len(lines_of[r]) - 1))
        kept = "".join(kept).encode()
        out.append((i, sorted(removed[r]), sorted(cuts[r]), len((t or "").encode()) - len(kept), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_paragraphs_against_all_pairs(spark):
    rng = random.Random(18)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, common = words(60), " ".join(words(20))
    rows = []
    for k in range(40):
        lines = [" ".join(words(rng.choice([3, 12, 80]))) for _ in range(rng.randrange(4))]
        if k % 3 == 0:  # a passage inside a longer line
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words(30) + passage + words(25)))
        if k % 4 == 0:
            near = list(passage)
            near[rng.randrange(60)] = "changed"
            lines.append(" ".join(near))
        if k % 5 == 0:
            lines += [common, "a short Line", "tail é of  it"]
        rows.append((k * 7 % 41, "\n".join(lines)))
    rows += [(None, common), (None, None), (50, ""), (51, "\n\n"), (52, "x" * 3000), (7, rows[0][1]), (7, rows[0][1]), (60, " ".join(words(30_000) + passage + words(30_000)))]
    df = spark.createDataFrame([(i, t, [i], "c", 0) for i, t in rows], "doc_id long, text string, lines array<long>, cut string, hash int").repartition(3)
    got = similarity.paragraph_groups(df).collect()
    mine = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.removed, r.cut, r.bytes_removed, r.kept_sha256) for r in got), key=str)
    want = brute_paragraphs([(i if i is not None else -(1 << 63), t) for i, t in rows])
    assert mine == want
    assert any(r.cut for r in got) and all(r.n_removed == len(r.removed) + len(r.cut) for r in got)
    assert all(r.cut for r in got if r.doc_id == 60)
    assert similarity.paragraph_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shared_passages_have_a_part_in_common():
    rng = np.random.default_rng(19)
    for _ in range(400):
        shared = rng.integers(0, 60, 50).astype(np.uint64)
        sides = [np.concatenate([rng.integers(0, 60, rng.integers(40)), shared, rng.integers(0, 60, 1 + rng.integers(40))]).astype(np.uint64) for _ in range(2)]
        found = []
        for h in sides:
            h = textkit.mix(h)
            _, a, b = similarity.passages(h, np.array([0]), np.array([len(h)]))
            found.append({h[x:y].tobytes() for x, y in zip(a, b)})
        assert found[0] & found[1]


def test_similar_sets_share_a_key():
    """Pairs exactly at the bound: the share of them that no key joins."""
    rng = np.random.default_rng(20)
    for ratio in (Fraction(9, 10), Fraction(4, 5)):
        keys, missed, pairs = similarity.SizedParts(ratio), 0, 0
        for n in (4, 9, 20, 40, 80, 150, 300, 700, 1500):
            for _ in range(100 if n > 300 else 400):
                both = rng.integers(0, 1 << 63, n, np.uint64)
                differ = int(n * (1 - ratio) / ratio)  # the most that the bound allows beside n in common
                a = rng.integers(0, differ + 1)
                extra = rng.integers(0, 1 << 63, differ, np.uint64)
                x, y = (np.unique(np.concatenate([both, e])) for e in (extra[:a], extra[a:]))
                pairs += 1
                missed += not len(np.intersect1d(keys.of(x), keys.of(y)))
        assert missed == 0, (ratio, missed, pairs)


def test_short_paragraphs(spark):
    rng = random.Random(9)
    passage = [random_text(rng, 6, 10_000) for _ in range(11)]
    wrapped, near = "\n".join(passage), "\n".join(["other words here", *passage])
    long = lambda: random_text(rng, 40, 10_000)
    rows = [
        (1, f"{long()}\n{wrapped}\n{long()}"), (2, f"{near}\n\n{long()}"), (3, " ".join(passage)), (4, f"{long()}\nseven words\n{long()}"),
        (5, f"seven  WORDS\n{long()}\nseven words\n\n\n"), (6, "seven words"), (6, "seven words"), (7, f"other words here\n{long()}"), (None, "no id\nno id"), (8, "no id"), (9, None),
    ]
    got = similarity.paragraph_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # What only a removed run holds, "other words here" of 2, doesn't count as kept.
    assert sorted((r.doc_id, r.n_paragraphs, r.n_removed, r.removed, r.kept_in) for r in got if r.doc_id) == [
        (1, 13, 0, [], []), (2, 14, 12, list(range(12)), [1]), (3, 1, 1, [0], [1]), (4, 3, 0, [], []), (5, 6, 2, [0, 2], [4]),
        (6, 1, 1, [0], [4]), (6, 1, 1, [0], [4]), (7, 2, 0, [], []), (8, 1, 1, [0], [-(1 << 63)]), (9, 1, 0, [], []),
    ]


def test_runs_of_lines():
    rng = random.Random(10)
    texts = ["\n".join(" ".join("w" * rng.randrange(4) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(12))) for _ in range(200)]
    raw, edges = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    _, begin, end, at, first, lines = similarity.Units(2, 4, lines=True).split(raw, edges)
    for k, t in enumerate(texts):
        n = [len(x.split()) for x in t.split("\n")]
        want = [(i, 1, x) for i, x in enumerate(n)]
        for i in range(len(n)):
            j = i
            while j < len(n) and 0 < n[j] < 4:
                j += 1
            if (i == 0 or not 0 < n[i - 1] < 4) and sum(n[i:j]) >= 4:
                want.append((i, j - i, sum(n[i:j])))
        u = slice(at[k], at[k + 1])
        assert list(zip(first[u].tolist(), lines[u].tolist(), (end - begin)[u].tolist())) == sorted(want, key=lambda x: (x[0], x[1] > 1))


def brute_substrings(rows):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None and t), key=lambda r: r[0]):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_substrings_against_all_windows(spark, odd_rows, monkeypatch):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [letters(n) for n in (49, 50, 51, 90, 300)]
    rows = [(k * 31 % 97, "".join(rng.choice([rng.choice(shared), letters(rng.randrange(120))]) for _ in range(rng.randrange(5)))) for k in range(60)]
    rows += [r[:2] for r in odd_rows]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_substrings(rows)
    assert substrings.deduplicated(frame(spark, [])).collect() == []


@pytest.mark.parametrize("crowd, rows", [(3, 1), (3, 1000), (20_000, 1000)])
def test_substrings_with_one_line_in_every_text(spark, crowd, rows, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", rows)
    rng = random.Random(14)
    line = random_text(rng, 30)
    docs = [(k, f"{random_text(rng, rng.randrange(12))}\n{line}\n{random_text(rng, rng.randrange(12))}\n{line}") for k in range(40)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, bytes int, anchor int")
    assert sorted(map(tuple, substrings.deduplicated(df).collect()), key=str) == brute_substrings(docs)


def test_previous_factors():
    rng = np.random.default_rng(15)
    text = lambda n: rng.integers(97, 99, n).astype(np.uint8)
    shared = text(120)
    parts = [np.concatenate([text(5), shared[rng.integers(60) : 60 + rng.integers(60)], text(60)]) for _ in range(30)]
    raw = np.concatenate(parts)
    start = np.concatenate([np.arange(len(p) - 49) + a for p, a in zip(parts, np.cumsum([0, *map(len, parts)]))])
    docs = rng.integers(0, 12, len(parts))[np.repeat(np.arange(30), [len(p) - 49 for p in parts])]
    least = {}
    for s, d in zip(start.tolist(), docs.tolist()):
        w = raw[s : s + 50].tobytes()
        least[w] = min(least.get(w, d), d)
    want = [least[raw[s : s + 50].tobytes()] < d for s, d in zip(start.tolist(), docs.tolist())]
    assert any(want) and substrings.has_previous_factor(raw, start, docs).tolist() == want
    values, run = rng.integers(0, 9, 300), np.repeat(np.arange(0, 300, 20), 20)
    want = [max((j for j in range(run[i], i) if values[j] < values[i]), default=-1) for i in range(300)]
    assert substrings.previous_smaller(values, run).tolist() == want


def test_substrings_of_a_long_text(spark):
    rng = random.Random(16)
    long = random_text(rng, 300_000, 1_000_000)  # over 2 MB: many pieces of windows
    docs = [(1, long[500_000:600_000]), (2, long), (3, long[-70:] + "é")]
    assert sorted(map(tuple, substrings.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str) == brute_substrings(docs)


def test_window_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    edges = np.array([0, 0, 30, 700, 749, 2500, 5000])
    whole = substrings._anchors(raw, edges)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(*whole[:2])])
    want = np.concatenate([np.arange(a, b - 49) for a, b in zip(edges[:-1], edges[1:]) if b - a >= 50])
    assert np.array_equal(covered, want)
    monkeypatch.setattr(substrings, "PIECE", 256)
    pieces = substrings._anchors(raw, edges)
    assert np.array_equal(np.concatenate([np.arange(a, b + 1) for a, b in zip(*pieces[:2])]), want)


def brute_decontamination(rows, bench):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = {}
    for item, t in bench:
        w = words_of(t, pattern)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, items = words_of(t, pattern), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= x
        items.discard(None)
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [1 << 30, 400])
def test_decontamination(spark, odd_rows, chars, monkeypatch):
    monkeypatch.setattr(decontamination, "INDEX_CHARS", chars)
    rng = random.Random(9)
    bench = [(k, random_text(rng, rng.choice([1, 3, 9, 10, 11, 40]), 300)) for k in range(20)] + [(100, None), (101, "!!"), (None, random_text(rng, 15)), (3, random_text(rng, 12)), (12, "w1"), (2, "w1")]
    rows = []
    for k in range(60):
        parts = [random_text(rng, rng.randrange(30), 300)]
        if k % 3 == 0:
            w = rng.choice([t for _, t in bench if t]).upper().split()
            parts += ["; ".join(w[rng.randrange(3) :]), random_text(rng, 5)]
        rows.append((k, " ".join(parts)))
    rows += [r[:2] for r in odd_rows]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.judge(spark.createDataFrame(rows, "doc_id long, text string"), b)
    assert sorted(map(tuple, got.collect()), key=str) == brute_decontamination(rows, bench)
    df = frame(spark, odd_rows)
    clean = decontamination.clean(df, b)
    bad = [x[5] for x in sorted(brute_decontamination([r[:2] for r in odd_rows], bench), key=str)]
    assert clean.columns == df.columns and clean.count() == bad.count(False)
    assert decontamination.judge(df, b.limit(0)).where("contaminated").count() == 0


def test_urls(spark):
    assert urlfilter.split_url("HTTP://A.B.Example.ORG/En/x?q#f") == ("a.b.example.org", "/En/x")
    assert urlfilter.split_url("x.org/a") == urlfilter.split_url(None) == ("", "")
    rules = entry.URL_RULES
    urls = ["http://example.org/es/a", "http://x.example.org/en/12", "https://org/", "https://org", "http://a.com/fr/", "http://com/de/x?y", "http://xcom/de/", "http://notexample.org/es/", "http://EXAMPLE.org?/es/", None, "", "nope", "://", "http://a.com/fr"]

    def plain(url):
        host, path = urlfilter.split_url(url)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert got == {k: plain(u) for k, u in enumerate(urls)}
    trie = urlfilter.build_trie([("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("allow", "org", "/xyz/long/path")])
    assert urlfilter.match(trie, "b.a.org", "/xy")[2] == "block"
    assert urlfilter.judge(df.limit(0), rules).collect() == []


def test_tries_in_parts_agree(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    whole = urlfilter.judge(df, entry.URL_RULES).collect()
    monkeypatch.setattr(urlfilter, "TRIE_RULES", 2)
    assert urlfilter.judge(df, entry.URL_RULES).collect() == whole


def test_mixing(spark, odd_rows):
    rng = random.Random(2)
    rows = [(k, random_text(rng, rng.randrange(1, 60)), None, rng.choice(["a", "b", "b", "b", "c", None])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixture(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(df.repartition(5)).collect()))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, total, target = set(order), 1.5 * sum(sizes.values()), {}
    while True:  # fix what exceeds its cap, share the rest again
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    of = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 60
        copies = {r.copies for r in got if of[r.doc_id] == s}
        assert max(copies) - min(copies) <= 1  # complete epochs first
    odd = mixing.mixture(frame(spark, odd_rows)).collect()
    assert len(odd) == len(odd_rows) and all(r.taken == 0 for r in odd if r.size == 0)
    assert mixing.mixture(df.limit(0)).collect() == []
    full = mixing.mixed(frame(spark, odd_rows))
    assert full.columns == frame(spark, odd_rows).columns
    assert full.count() == sum(r.copies for r in odd)


def brute_mixture(rows):
    """Targets of sources by name, then documents one by one in the order of their keys."""
    size = [len(words_of(t, r"[^\x20\x09-\x0D]+")) for _, t, _ in rows]
    total = {}
    for n, (_, _, s) in zip(size, rows):
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, open_, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set(order), {}
    while open_:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: weight[s] * level for s in open_}
        open_ = open_ - over if over else set()
    out = []
    for s in order:
        keyed = []
        for n, (i, t, mine) in zip(size, rows):
            if mine == s:
                h = int(hashlib.md5(":".join(["11", *([str(i)] if i is not None else []), *([t] if t is not None else [])]).encode()).hexdigest()[:13], 16)
                keyed.append((-math.log((h + 0.5) / 2.0**52) / (1 if 3 <= len(t or "") / max(n, 1) <= 13 else 0.25), h, i if i is not None else -(1 << 63), n, i))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - epochs * total[s], 0
        for *_, n, i in sorted(keyed):
            upto += n
            copies = epochs + (rest > 0 and 2 * upto - n <= 2 * rest and n > 0)
            out.append((i, n, total[s], round(target[s], 6), copies * n, copies))
    return sorted(out, key=str)


def test_mixing_of_repeated_rows(spark, odd_rows):
    rng = random.Random(8)
    rows = [(1, "w x y z", "a")] * 10 + [(2 + k, random_text(rng, 3), "b") for k in range(4)]
    rows += [(100 + k % 7, random_text(random.Random(k % 7), 1 + k % 7), "c") for k in range(60)] + [(i, t, s) for i, t, _, s, *_ in odd_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(*r[:3], round(r.target, 6), *r[4:]) for r in mixing.mixture(df).collect()]
    assert sorted(got, key=str) == brute_mixture(rows)
    full = mixing.mixed(df.withColumn("n", F.monotonically_increasing_id()))
    assert full.count() == sum(r[5] for r in got)
    want = {}
    for i, *_, copies in got:
        want[i] = want.get(i, 0) + copies
    assert {r.doc_id: r["count"] for r in full.groupBy("doc_id").count().collect()} == {i: n for i, n in want.items() if n}
    ten = mixing.mixture(spark.createDataFrame(rows[:10], df.schema)).agg(F.sum("taken")).first()[0]
    assert ten == 60  # the whole target


def test_sharding(spark, odd_rows):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = [table.count(k) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a < 6) < 0.2 * 1009
    df = frame(spark, odd_rows)
    got = sharding.place(df, "doc_id", names, 1009).collect()
    assert len(got) == len(odd_rows)

    def plain(i):
        return names[table[int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:15], 16) % 1009]]

    assert all(r.shard == plain(r.doc_id) for r in got)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)
    assert sharding.place(df.limit(0), "doc_id", names).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = random.Random(7)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(300)]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, []), (650, [0.5, 0.5]), (651, [0.25, 0.1]), (None, [0.0] * 6), (100, [0.1] * 6), (700, [100.0] * 6)] + [(800 + k, [0.5] * 6) for k in range(20)]
    q = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, x) in enumerate(q):
        if i % 50 == 0:
            found = sorted((-sum(p * r for p, r in zip(x, y)), j) for b, (j, y) in enumerate(q) if b != a and len(x) == len(y))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df).collect())) == sorted(want)
    assert topk.search(df.limit(0)).collect() == []


def test_language_id(spark, odd_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = entry.op1_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert sum(r.lang_rejected for r in got) <= 2
    model = langid.fit(docs)
    df = frame(spark, odd_rows)
    odd = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert odd[4].lang_pred == odd[5].lang_pred == odd[10].lang_pred == "und" and odd[10].score == 0
    assert odd[9].lang_pred in model.languages and 0 <= odd[7].score <= 1
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and not {4, 5, 6, 10} & {r.doc_id for r in kept.collect()}
    assert langid.fit(df.where("lang = 'none'")) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).collect() == []


def test_junk_is_rejected(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(2)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (200, 900, 5000)] + ["qwrt zxcv bnmp " * 20, "xkcd" * 100]
    real = [r.text for r in docs.where("length(text) > 200").orderBy("doc_id").limit(40).collect()]
    scrambled = ["".join(rng.sample(t, len(t))) for t in real[:10]]
    df = spark.createDataFrame([(0, t) for t in junk + scrambled] + [(1, t) for t in real], "real int, text string")
    got = langid.predict(df, model).collect()
    assert all(r.lang_rejected for r in got if not r.real) and not any(r.lang_rejected for r in got if r.real)
    # The forward pass, text by text.
    for r in got:
        c = langid.subword_counts(np.frombuffer(r.text.encode(), np.uint8), model.settings)
        inner = sum(n / c.sum() * model.table[b].astype(float) for b, n in enumerate(c) if n)
        z = [(sum(x * w for x, w in zip(inner, model.weights[:, k])) + model.bias[k]) / model.temperature for k in range(len(model.languages) + 1)]
        e = [math.exp(x - max(z)) for x in z]
        p = [x / sum(e) for x in e]
        best = max(range(len(model.languages)), key=lambda k: p[k])
        assert r.lang_pred == model.languages[best] and abs(r.score - p[best]) < 1e-3
    few = langid.predict(spark.createDataFrame([("xyz",), ("the",), ("q",)], "text string"), model).collect()
    assert all(0 <= r.score <= 1 for r in few)
    assert langid.scrambled("few letters", 1) is None


def test_rejection_threshold_is_a_quantile():
    rng = np.random.default_rng(4)
    s = langid.Settings(least_steps=1, epochs=1)
    labels = rng.integers(0, 2, s.sample)
    # The rows show their language in half of 8 buckets; some show the other one nearly as often.
    rows = []
    for y in labels:
        c = rng.multinomial(40, np.where(np.arange(8) // 4 == y, 0.18, 0.07)).astype(np.uint32)
        rows.append((np.flatnonzero(c), c[c > 0]))
    model = langid.train(iter([langid.unpacked(langid.packed(*r)) for r in rows]), labels, ["a", "b"], s)
    order = np.random.default_rng(s.seed).permutation(len(rows))
    back = order[: len(rows) - s.fitted]
    dense = np.zeros((len(back), s.buckets), np.float32)
    for i, k in enumerate(back):
        dense[i, rows[k][0]] = rows[k][1]
    p = model.probabilities(dense)
    right = int((p.argmax(1) == labels[back]).sum())
    assert len(back) == s.sample - s.fitted == 4800 and int(right * s.lost) >= 1
    for got, want in zip(langid.unpacked(langid.packed(*rows[0])), rows[0]):
        assert np.array_equal(got, want)
    assert [x.tolist() for x in langid.unpacked(langid.packed(np.array([], np.int64), np.array([], np.int64)))] == [[], []]


def test_subwords_in_pieces(monkeypatch):
    raw = np.frombuffer("The quick, brown fox—jümps over it. ".encode() * 40, np.uint8)
    whole = langid.subword_counts(raw, langid.Settings())
    monkeypatch.setattr(textkit, "SEGMENT", 97)
    assert np.array_equal(whole, langid.subword_counts(raw, langid.Settings()))


def test_segments():
    def plain(x):
        found = []

        def split(a, b):
            best = max(((sum(x[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best and best[0] > 0:
                i, j = -best[2], best[3]
                found.append((i, j, best[0]))
                split(a, i)
                split(j, b)

        split(0, len(x))
        return sorted(found)

    rng = random.Random(11)
    for _ in range(60):
        x = [rng.choice([-7, -5, -3, 2, 4, 11]) + rng.random() for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(x))] == [(a, b) for a, b, _ in plain(x)]


def test_toxicity(spark, odd_rows):
    rng = random.Random(12)
    bad_words = ["vile", "nasty", "horrid"]
    rows, labels = [], []
    for k in range(900):
        words = random_text(rng, rng.randrange(0, 80), 150).split()
        bad = k % 6 == 0
        for _ in range(5 if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad_words))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    labels += [(None, 1), (5000, 1), (3, None), (6, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score(docs.withColumn("held_out", toxicity.held_out(F.col("doc_id"))), model).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)
    text = dict(rows)
    for r in got:
        for p in r.passages:
            assert any(w in text[r.doc_id].encode()[p.start : p.end].decode() for w in bad_words)
    df = frame(spark, odd_rows)
    odd = toxicity.score(df, model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if not (r.text or "").strip()}) == 1
    assert toxicity.fit(docs, marks.where("toxic = 0")) is None
    assert {r.predicted for r in toxicity.score(df, None).collect()} == {0}
    assert toxicity.score(df.limit(0), model).collect() == []


@pytest.mark.parametrize(("places", "crowded"), [(50, 16), (1 << 24, 0)])
def test_filters_of_any_size_change_nothing(spark, places, crowded, monkeypatch):
    rng = random.Random(14)
    lines = [random_text(rng, 14) for _ in range(12)]
    rows = [(k, "\n".join(rng.sample(lines, 4) + [random_text(rng, 30)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "PLACES", places)
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(similarity, "SHINGLES", 300)
    assert sorted(map(tuple, substrings.deduplicated(df).collect())) == sorted(brute_substrings(rows))
    near = [(100 + k, " ".join(x for n, x in enumerate(rows[k % 7][1].split()) if n != k % 60)) for k in range(40)]
    got = similarity.jaccard_groups(spark.createDataFrame(near, df.schema), 3, Fraction(9, 10))
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(near, 3, Fraction(9, 10))


def test_bitmaps_come_in_few_jobs(spark, monkeypatch):
    """As many whatever the number of partitions."""
    tracker, before = spark.sparkContext.statusTracker(), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = spark.createDataFrame([(k, f"{k % 9} one text", k) for k in range(40)], "doc long, text string, version long")
    try:
        for k, v in zip(before, ("60", "false")):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("bitmaps", "")
        hashes = lambda raw, edges: (edges[:-1], textkit.mix(raw[edges[:-1]].astype(np.uint64)))
        shared = substrings.shared_hashes(rows, hashes, 60, 40)
        assert rows.where(substrings.among(rows.where("doc < 20"))).count() == 20
        assert len(tracker.getJobIdsForGroup("bitmaps")) < 25
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not shared.has(textkit.mix(np.arange(1000, 2000, dtype=np.uint64))).any()


def test_few_hashes_make_a_small_bitmap(spark):
    df = spark.createDataFrame([(k, f"text {k % 3}") for k in range(9)], "doc_id long, text string")
    hashes = lambda raw, edges: (edges[:-1], textkit.mix(np.arange(len(edges) - 1, dtype=np.uint64)))
    assert len(substrings.shared_hashes(df, hashes, 8, 9).bits) <= 1 << 20


def test_stars_need_no_round(spark, tmp_path, monkeypatch):
    from quillspark.llm import storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    edges = [(a, a % 3) for a in range(3, 30)] * 2
    got = similarity.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(a, a % 3) for a in range(30)]
    assert {p.name.rpartition("-")[0] for p in tmp_path.iterdir()} == {"roots"} and len(list(tmp_path.iterdir())) == 1


def test_common_stretches_are_settled_in_tasks(spark, monkeypatch):
    """A stretch of all texts comes from a task once, not from each text."""
    rng = random.Random(41)
    line = random_text(rng, 40)
    rows = [(k, f"{random_text(rng, 12)}\n{line}\n{random_text(rng, 12)}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = substrings._stretches(substrings._versioned(df), 4).where("bytes is not null")
    assert found.groupBy("bytes").count().agg(F.max("count")).first()[0] <= 2
    assert sorted(map(tuple, substrings.deduplicated(df).collect())) == sorted(brute_substrings(rows))
    monkeypatch.setattr(substrings, "SETTLED", 30)
    assert sorted(map(tuple, substrings.deduplicated(df).collect())) == sorted(brute_substrings(rows))


def test_spent_tables_are_deleted(spark, tmp_path, monkeypatch):
    from quillspark.llm import storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    rows = [(k, f"alpha beta gamma delta {'x' * (k % 3)} epsilon zeta eta theta iota {k // 20}") for k in range(60)]
    similarity.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10)).collect()
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert not left & {"keys", "least", "large", "shingles", "wanted", "classes", "known", "firsts"} and "groups" in left
    outside = tmp_path.parent / f"{tmp_path.name}-outside"
    spark.range(3).write.parquet(str(outside))
    storage.spent(spark.read.parquet(str(outside)))
    assert outside.exists()


def test_corpus_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in entry.ORACLES.items():
        got, want = entry.QUERIES[name](spark, SMALL), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
        order = sorted(got.columns)
        rows = [sorted(tuple(map(cell, (r[c] for c in order))) for r in found) for found in ([r.asDict() for r in got.collect()], [dict(zip(want.columns, r)) for r in want.fetchall()])]
        assert rows[0] == rows[1], name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in now.collect()]
        source, after = now, stage(spark, now, SMALL)
        rows = [(r.doc_id, r.text) for r in after.collect()]
        if k < 4:
            assert after.columns == docs.columns, name
        if k == 1:
            groups = brute_groups(before, 5, Fraction(4, 5))
            assert sorted(i for i, _ in rows) == sorted({c for _, _, c, _ in groups})
        if k == 2:
            assert sorted(i for i, _ in rows) == sorted(r[0] for r in brute_decontamination(before, bench) if not r[5])
        if k == 4:
            assert len(rows) == len(before) and set(after.columns) == {*docs.columns, "shard"}
        now = spark.createDataFrame(after.collect(), after.schema)
        if k == 0:
            model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
            assert sorted(rows) == sorted((r.doc_id, r.text) for r in langid.predict(docs, model).collect() if not r.lang_rejected)
        if k == 3:
            plan = {}
            for i, *_, copies in brute_mixture([(r.doc_id, r.text, r.source) for r in source.collect()]):
                plan[i] = plan.get(i, 0) + copies
            assert {i: [x for x, _ in rows].count(i) for i in plan} == plan
        if k == 4:
            places = sharding.lookup_table(entry.SHARDS, entry.SLOTS)
            assert all(r.shard == entry.SHARDS[places[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % entry.SLOTS]] for r in after.collect())
    assert corpus_pipeline.run(spark, SMALL).count() == now.count()


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    now = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        assert now.collect() == []
