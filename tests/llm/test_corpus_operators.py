import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from regista.llm import line_dedup, ngram_join, suffix_dedup
from regista.llm.common import fitting

DOC = "doc_id long, text string, lang string"


def removed_by_hand(rows):
    """op4's contract, byte by byte."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        left = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[d] = (len(raw), len(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4000, 0])
def test_suffix_dedup_by_hand(spark, hot):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(80))) + passage[draw.randrange(50) :] * draw.randrange(3)) for i in range(40)]
    rows += [(50, "a" * 700), (51, "ab" * 200), (52, "a" * 130), (53, None), (54, ""), (55, "q" * 99), (56, "\0" * 250), (-3, passage)]
    got = suffix_dedup.dedup(spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, d string"), hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed_by_hand(rows)


def test_suffix_dedup_of_pieces(spark, monkeypatch):
    """Texts longer than what is parsed at a time, and rows of runs cut short."""
    draw = random.Random(7)
    base = "".join(draw.choices("abcdefgh ", k=900))
    rows = [(1, base + "x" * 500 + base[200:]), (2, base[100:] + "ab" * 300), (3, "ab" * 260 + base), (4, base[:150])]
    want = removed_by_hand(rows)
    for most in (1, 150, 700, 5000):
        monkeypatch.setattr(suffix_dedup.pieces, "__defaults__", (100, most))
        some = [p for ps in suffix_dedup.pieces([t.encode() for _, t in rows]) for p in ps]
        starts = sorted((i, lo + j) for i, lo, part in some for j in range(len(part) - 99))
        assert starts == [(i, j) for i, (_, t) in enumerate(rows) for j in range(len(t) - 99)]
    assert want == {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_suffix_dedup_of_runs(spark):
    """Ten million times one byte, and long periods: few phrases."""
    long = [(1, "a" * 10_000_000), (2, "b" + "a" * 300), (3, "abc" * 200_000), (4, "xyz" * 50 + "c" + "abc" * 100)]
    parsed = [suffix_dedup.parse(some) for _, t in long for some in suffix_dedup.pieces([t.encode()])]
    assert sum(int((~p[-1]).sum()) for p in parsed) < 300
    got = {r.doc_id: tuple(r)[1:4] for r in suffix_dedup.dedup(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert got[1] == (10_000_000, 9_999_999, 1)
    assert got[2] == (301, 300, 1)
    assert got[3] == (600_000, 599_997, 1)
    assert got[4] == removed_by_hand([(3, "abc" * 200), long[3]])[4][:3]


def test_suffix_dedup_odd_rows(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=400))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text, "c")]
    got = sorted(tuple(r)[:3] for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOC)).select(*["doc_id", "n_bytes", "n_removed"]).na.fill(-1).collect())
    assert got == [(-1, 400, 0), (1, 400, 400), (1, 400, 400), (2, 400, 400)]  # the null id comes first
    assert suffix_dedup.dedup(spark.createDataFrame([], DOC)).count() == 0


def lines_by_hand(rows, k=3):
    seen, out = set(), {}
    for d, t in sorted(rows):
        if t is None:
            out[d] = (None, 0, 0)
            continue
        lines = t.split("\n")
        some = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for p in range(len(some) - k + 1):
            run = tuple(lines[i] for i in some[p : p + k])
            if run in seen:
                gone.update(range(p, p + k))
            seen.add(run)
        drop = {some[p] for p in gone}
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in drop), len(gone), sum(1 for p in gone if p - 1 not in gone))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7])
def test_line_runs_by_hand(spark, k):
    draw = random.Random(k)
    rows = [(i, "\n".join(draw.choice(["one", "two", "three", "", "  ", "four five"]) for _ in range(draw.randrange(14)))) for i in range(25)] + [(30, None), (31, ""), (32, "\n\n"), (33, "x\n" * 40)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, pos string")
    got = line_dedup.strip_runs(docs, k).collect()
    assert {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in got} == lines_by_hand(rows, k)
    assert all(r.pos == "n" for r in got)


def test_maximal_runs_by_hand(spark):
    draw = random.Random(8)
    rows = [(i, "\n".join(draw.choice("abc") for _ in range(draw.randrange(25)))) for i in range(12)] + [(20, "x\n" * 70), (21, "\n".join(map(str, range(50)))), (22, "\n".join(map(str, range(3, 47))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = {d: [x for x in t.split("\n") if x] for d, t in rows}
    runs = line_dedup.maximal_runs(line_dedup.symbols(docs).drop("words", "last"), 3).collect()
    for r in runs:  # each is a common prefix that cannot grow to the right, and begins earlier
        a, b = text[r.d][r.pos :], text[r.source.d][r.source.pos :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert r.n == n >= 3 and (r.source.d, r.source.pos) < (r.d, r.pos)
    assert [(r.d, r.pos, r.source.d, r.source.pos, r.n) for r in runs if r.d == 22] == [(22, 0, 21, 3, 44)]
    assert max(r.n for r in runs if r.d == 20) == 69


@pytest.mark.parametrize("k", [2, 3, 5])
def test_long_passages_by_hand(spark, k):
    draw = random.Random(k)
    pool = ["one", "two words", "six words stand on this line", "a " * 9, "", "文字" * 5]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(12)))) for i in range(25)] + [(30, None), (31, "")]
    seen, want = set(), {}
    for d, t in rows:
        some = [x for x in (t or "").split("\n") if x.strip()]
        words = [len(x.split()) if x.isascii() else len(x) for x in some]
        gone = set()
        for p in range(len(some)):
            for n in range(1, len(some) - p + 1):
                run = tuple(some[p : p + n])
                if run in seen and (n >= k or sum(words[p : p + n]) >= 9):
                    gone.update(range(p, p + n))
                seen.add(run)
        want[d] = (len(gone), sum(p - 1 not in gone for p in gone))
    got = line_dedup.strip_runs(spark.createDataFrame([(*r, "n") for r in rows], DOC), k, min_words=9).collect()
    assert {r.doc_id: (r.n_removed, r.n_runs) for r in got} == want


def test_pipeline_cuts_a_long_paragraph(spark, sf):
    passage = " ".join(f"word{i}" for i in range(60))
    halves = "\n".join([" ".join(f"left{i}" for i in range(30)), " ".join(f"right{i}" for i in range(30))])
    rows = [(i, f"own line {i}\n{passage}\nshort\nend {i}\n{halves}", "en") for i in range(3)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOC), sf).collect()
    assert {r.doc_id: r.text for r in got} == {0: rows[0][1]} | {i: f"own line {i}\nend {i}" for i in (1, 2)}


def test_line_runs_odd_rows(spark):
    text = "a\nb\nc"
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text, "c")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in line_dedup.strip_runs(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(-1, 0), (1, 3), (1, 3), (2, 3)]
    assert line_dedup.strip_runs(spark.createDataFrame([], DOC)).count() == 0


def near_by_hand(rows, threshold=0.8):
    sets = [set(ngram_join.shingles(t or "").tolist()) for _, t in rows]
    n = len(rows)
    near = [[i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in range(n):
                if near[a][b] and b not in group:
                    group.add(b)
                    todo.append(b)
        out.append((rows[i][0], min(rows[g][0] for g in group), sum(map(bool, near[i])), len(sets[i])))
    return sorted(out)


def near_rows(seed=4):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(draw.choice([30, 120, 300]))]
        for _ in range(8):
            own = list(base)
            for _ in range(draw.randrange(6)):
                own[draw.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(100, "a b"), (101, "A, b!"), (102, ""), (103, None), (104, "..."), (105, rows[0][1]), (106, rows[0][1].upper())]
    return rows


def test_ngram_join_by_hand(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    want = near_by_hand(rows)
    got = ngram_join.join(docs)
    assert sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)  # many blocks to a component
    assert sorted(tuple(r) for r in ngram_join.join(docs).collect()) == want


def test_keep_one(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, rows[3], (None, rows[2][1])]], DOC)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "lang"]
    classes = {c for _, c, _, _ in near_by_hand([(-1 if d is None else d, t) for d, t in [*rows, (None, rows[2][1])]])}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(classes)
    assert ngram_join.join(spark.createDataFrame([], DOC)).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    assert ngram_join.shortened([], 0.8, 20, 8, 0.999) == 5
    assert ngram_join.bound(0.8, 20, 5) >= 0.999 > ngram_join.bound(0.8, 20, 6)
    assert ngram_join.shortened([1, 1, 1, 0.9999, 0.99, 0.9, 0.8, 0.7], 0.8, 20, 8, 0.999) == 4
    assert ngram_join.shortened([1.0] * 8, 0.8, 20, 8, 0.9) == 8
    assert ngram_join.shortened([0.5] * 8, 0.8, 20, 8, 0.9) == 1


def test_a_sample_passes_over_texts_that_do_not_fit(spark):
    assert fitting([3, 9, 2, 4, 1], 6) == [True, False, True, False, True] and fitting([], 5) == []
    # whichever document comes first, one of over the bound takes no other's place
    rows = [(i, "some words " * (500 if i % 5 == 0 else 3)) for i in range(20)]
    texts = ngram_join.drawn(spark.createDataFrame(rows, "doc_id long, text string"), 20, longest=1000)
    assert sorted(map(len, texts)) == [33] * 16


def test_recall_is_measured_on_exact_partners(spark):
    rows = near_rows(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = ngram_join.signatures(docs, 20, 8, 5, 1000, 0.8)
    got = {}
    for r in seen.collect():
        for m in r.met:
            got.setdefault(m // 16, []).append((r.d, m % 16))
    sets = {}
    for d, t in rows:
        sets.setdefault(frozenset(ngram_join.shingles(t or "").tolist()), []).append(d)
    sets.pop(frozenset(), None)
    pairs = sum(len(b) for x, a in sets.items() for y, b in sets.items() if x != y and len(x & y) >= 0.8 * len(x | y))
    assert sum(map(len, got.values())) == pairs > 20
    measured = ngram_join.recalls(seen, 8)
    assert measured == sorted(measured, reverse=True) and measured[0] > 0.99


def test_large_nodes_and_chance_meetings(spark, monkeypatch):
    rows = near_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_hand(rows)
    monkeypatch.setattr(ngram_join, "NODE", 2)
    assert sorted(tuple(r) for r in ngram_join.join(docs).collect()) == want
    monkeypatch.setattr(ngram_join, "NODE", 10**6)
    assert sorted(tuple(r) for r in ngram_join.join(docs, recall=1.1).collect()) == want  # nodes of one minimum: mostly chance


def test_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_adjacency_is_exact():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 40, draw.integers(1, 30), dtype=np.uint64)) for _ in range(60)]
    near = ngram_join.adjacency(rows, np.array([len(r) for r in rows], np.float32), 0.5)
    for i in range(60):
        for j in range(60):
            a, b = set(rows[i].tolist()), set(rows[j].tolist())
            assert near[i, j] == (i != j and 2 * len(a & b) >= len(a | b))
