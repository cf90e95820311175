import hashlib
import random
from collections import defaultdict

import pytest

from colsonde.llm import line_runs
from colsonde.llm.line_runs import LineRuns, dedup_lines, digest

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "a line of more than forty code points, number "


def key(line):
    return line.strip(WHITE).translate(FOLD)


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, ids):
    g = random.Random(seed)
    shared = [LONG + str(k) for k in range(12)] + ["x" * 39, "x" * 40, "é" * 40, " short "]
    rows = []
    for i in ids:
        lines = [g.choice(["", " \t"]) + (x.upper() if g.random() < 0.2 else x) + g.choice(["", " ", "\r"]) for x in g.choices(shared, k=g.randint(0, 6))]
        lines += ["own line of one document only, long enough: " + str(g.random())] * g.choice([0, 1, 2])
        g.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(rows[0][0], None), (rows[1][0], ""), rows[2], rows[2], (rows[3][0], rows[4][1]), (None, rows[5][1]), (None, None)]


@pytest.mark.parametrize("sent", [100_000, 2])
def test_matches_brute_force(make_docs, monkeypatch, sent):
    monkeypatch.setattr(line_runs, "SENT", sent)
    rows = corpus(1, range(60))
    got = sorted(map(tuple, digest(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 50


def test_extreme_and_text_ids(spark):
    ids = [-(2**63), 2**63 - 1, *range(-9, 9), 2**62, -(2**62)]
    rows = corpus(2, ids)
    assert sorted(map(tuple, digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str) == brute(rows)
    named = [(None if i is None else f"doc{i}", t) for i, t in rows]
    assert sorted(map(tuple, digest(spark.createDataFrame(named, "doc_id string, text string")).collect()), key=str) == brute(named)


def test_rows_of_one_document_count_once(spark):
    rows = [(1, LONG)] * 5 + [(2, LONG)]
    assert sum(r.n_dropped for r in digest(spark.createDataFrame(rows, "doc_id int, text string")).collect()) == 0
    rows = [(k, LONG) for k in range(5)] * 2
    out = digest(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in out) == sorted([(k, int(k < 4)) for k in range(5)] * 2)


def test_clashing_columns_and_long_texts(spark):
    rows = [(k, "\n".join([LONG] * 3000 + [str(k)]), "n", 1) for k in range(6)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id int, text string, n_lines string, `a.b` int")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r["a.b"]) for r in out) == [(k, 3001, 3000 * (k < 5), 1) for k in range(6)]


def test_runs_are_compacted(spark):
    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        runs.absorb(spark.createDataFrame([(7, 7, k), (k, k, k), (k, k, k)], "k1 long, k2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.common_keys(5).collect()] == [(7, 7, 5, 4)]
    assert runs.keys().where("fresh").count() == 6
