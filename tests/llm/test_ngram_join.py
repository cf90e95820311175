import random

import numpy as np
import pytest

from colsonde.llm import components as graph
from colsonde.llm import ngram_join
from colsonde.llm.ngram_join import digest, forest, keep_one, near_duplicates, prefix, shared

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).translate(FOLD).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, per_cent):
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((k, len(sets[i]), k if not sets[i] else min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, groups=6, size=12, extra=30):
    g = random.Random(seed)
    vocab = ["w%d" % k for k in range(300)] + ["Été", "日本"]
    passage = [g.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [g.choice(vocab) for _ in range(g.choice([3, 20, 60, 150]))]
        for _ in range(g.randint(1, size)):
            w = list(base)
            for _ in range(g.choice([0, 0, 1, 2, 3, 6])):
                w[g.randrange(len(w))] = g.choice(vocab)
            rows.append(" ".join(w).upper() if g.random() < 0.2 else "\n".join(w))
    for _ in range(extra):
        w = [g.choice(vocab) for _ in range(g.randint(0, 80))]
        rows.append(" ".join(passage + w if g.random() < 0.5 else w))
    rows += ["a b", "A  b", "a", None, "", " \n", "one two three", "one two three four", rows[0]]
    g.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(make_docs, seed):
    rows = corpus(seed)
    got = sorted(map(tuple, digest(make_docs(rows, files=3)).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_long_lists_and_large_clusters(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    g = random.Random(9)
    base = ["v%d" % k for k in range(70)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(g.randint(0, 5)):
            w[g.randrange(70)] = "x%d" % g.randrange(40)
        rows.append((k, " ".join(w + ["t"] * g.choice([0, 0, 30]))))
    docs = make_docs(rows, files=3)
    for n, per_cent in ((3, 90), (5, 80)):
        out = near_duplicates(docs, n, per_cent, is_scan=True).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows, n, per_cent)


def test_keep_one(make_docs):
    rows = [(4, "a b c d e f g"), (2, "A b c d e f g"), (2, "a b c d e f g"), (7, None), (8, ""), (9, "z y x"), (None, "q q"), (None, "q q")]
    kept = keep_one(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 7, 8, 9, None]
    clash = [(1, "a b", "x", 5), (2, "a b", "y", 6)]
    row = keep_one(make_docs(clash, "doc_id bigint, text string, node string, `a.b` int")).collect()
    assert [(r.doc_id, r.node, r["a.b"]) for r in row] == [(1, "x", 5)]


def test_repeated_and_null_ids(make_docs):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "other text here"), (None, "lonely words of a null"), (1, None), (None, None)]
    got = sorted(map(tuple, digest(make_docs(rows)).collect()), key=str)
    assert got == brute(rows, 3, 90)
    assert digest(make_docs([])).collect() == []


def test_prefix_asks_for_more_matches_where_lists_are_long():
    assert prefix(np.array([1] * 10 + [2] * 90), 90)[1] == 1
    length, matches = prefix(np.array([500] * 2000), 1800)
    assert matches > 1 and length == 2000 - 1800 + matches


def test_shared_and_forest(monkeypatch):
    g = np.random.default_rng(1)
    sets = [np.unique(g.integers(0, 500, k).astype(np.uint64)) for k in (3, 50, 200, 400)]
    monkeypatch.setattr(ngram_join, "CELLS", 256)
    assert shared(sets, sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert len(forest(np.array([[0, 1], [1, 2], [2, 0], [3, 4]]), 5)) == 3


def test_components(spark):
    g = random.Random(4)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_words_that_collide_under_polynomials(make_docs):
    from test_span_dedup import parity_words

    one, other = parity_words()
    rows = [(1, one), (2, other), (3, f"{one} x y z"), (4, f"{other} x y z"), (5, f"x {one}"), (6, f"x {other}"), (7, one[:64]), (8, other[:64]), (9, one.upper())]
    got = sorted(map(tuple, digest(make_docs(rows)).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_rings_of_large_clusters(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    g = random.Random(2)
    words = ["v%d" % k for k in range(60)]
    rows = []
    # A chain of copies that drifts away from its start, a dense group, and unrelated texts that share a line.
    for k in range(80):
        if k % 2:
            words[g.randrange(60)] = "c%d" % k
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(["d%d" % j for j in range(50)] + ["e%d" % g.randrange(9)] * g.randint(1, 3))) for k in range(40)]
    rows += [(200 + k, "v0 v1 v2 v3 v4 d0 d1 d2 d3 d4 " + " ".join("u%d" % g.randrange(99) for _ in range(g.randint(0, 9)))) for k in range(40)]
    docs = make_docs(rows, files=3)
    for n, per_cent in ((2, 70), (3, 100)):
        out = near_duplicates(docs, n, per_cent, is_scan=True).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows, n, per_cent), per_cent


def test_rejects_impossible_parameters(make_docs):
    docs = make_docs([(1, "a")])
    for n, per_cent in ((0, 90), (3, 0), (3, 101)):
        with pytest.raises(ValueError):
            near_duplicates(docs, n, per_cent)
