import hashlib
import random
import re

import pytest

from colsonde.llm import decontaminate
from colsonde.llm.decontaminate import Automaton, cut_spans, cut_text, digest, item_words, judge

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)) if w]


def brute(text, items, window):
    """(number of words, words hit, items) of a text."""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for k in range(max(1, len(x) - window + 1) if x else 0):
            part = x[k : k + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(item)
    return len(w), hit, found


def corpus(seed):
    g = random.Random(seed)
    vocab = ["a", "b", "c", "D", "é", "日本", "x1"]
    line = lambda n: g.choice([" ", ", ", "\n"]).join(g.choice(vocab) for _ in range(n))
    items = [(k, line(g.choice([1, 2, 3, 5, 13, 14, 20]))) for k in range(2, 25)] + [(50, None), (51, "!!"), (None, line(14)), (2, line(15))]
    rows = []
    for k in range(60):
        parts = [line(g.randint(0, 12))]
        for _ in range(g.randint(0, 3)):
            parts += [g.choice(items)[1] or "", line(g.randint(0, 12))]
        rows.append((k, g.choice([" ", "; "]).join(parts)))
    return items, [*rows, (90, None), (91, ""), rows[1], (None, rows[2][1])]


def expected(rows, items):
    out = []
    for i, t in rows:
        n, hit, found = brute(t, items, 13)
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_matches_brute_force(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items, rows = corpus(1)
    if block < 100:
        items, rows = items[-9:], rows[-25:]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, digest(make_docs(rows), table).collect()), key=str)
    assert got == expected(rows, items)


def test_automaton_on_random_items():
    g = random.Random(3)
    for _ in range(300):
        window = g.choice([1, 2, 3, 5])
        text = lambda n: " ".join(g.choice("abc") for _ in range(n))
        items = [(k, text(g.randint(0, 8))) for k in range(g.randint(0, 5))]
        doc = text(g.randint(0, 30))
        spans, found = Automaton(items, window).scan(item_words(doc))
        _, hit, names = brute(doc, items, window)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == names


def test_cut(spark, make_docs):
    items = spark.createDataFrame([(7, ITEM), (8, "Short item!"), (9, None), (10, "")], "item_id bigint, text string")
    rows = [(1, f"Before, {ITEM.upper()}! after"), (2, "a short, item here"), (3, "one two three four"), (4, None), (5, "x " * 500 + "short item")]
    got = {r.doc_id: r for r in cut_spans(judge(make_docs(rows), items)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].items, got[1].contaminated, got[1].text) == (16, 14, "7", True, "Before, ! after")
    assert (got[2].items, got[2].text) == ("8", "a  here")
    assert (got[3].n_hit, got[4].n_words, got[4].contaminated, got[4].text) == (0, 0, False, None)
    assert (got[5].n_hit, got[5].contaminated, got[5].text) == (2, False, rows[4][1])
    assert cut_text("é one, two é", [(1, 3)]) == "é  é"
    long = "w " * 200_000
    assert cut_text(long, [(k, k + 1) for k in range(0, 200_000, 2)]).split() == ["w"] * 100_000


def test_empty_benchmark_and_clashing_columns(spark, make_docs):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    docs = make_docs([(1, "a b", "s", 5)], "doc_id bigint, text string, n_words string, `a.b` int")
    row = judge(docs, empty).collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated, row["a.b"]) == (2, 0, False, 5)
    assert digest(make_docs([]), empty).collect() == []
