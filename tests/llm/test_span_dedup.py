import hashlib
import random
from collections import Counter

from colsonde.llm.span_dedup import digest, ladder, remove_repeated_spans

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in (text or "").translate(str.maketrans(WHITE, " " * 6)).split(" ") if w]


def brute(rows, length):
    seen = Counter(tuple(w[i : i + length]) for _, t in rows for w in [words(t)] for i in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    g = random.Random(seed)
    vocab = ["w%d" % k for k in range(40)] + ["é", "日本", "A", "a", "x.", " y"]
    passages = [[g.choice(vocab) for _ in range(g.choice([34, 35, 36, 50, 71, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(g.randint(0, 5)):
            w += g.choice(passages) if g.random() < 0.4 else [g.choice(vocab) for _ in range(g.randint(1, 60))]
        rows.append((i, g.choice([" ", "\n", "\t "]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "a " * 300), (n + 4, "b " * 35), (n + 5, "b " * 34), (None, rows[3][1]), (3, rows[3][1]), (None, None)]
    return rows


def test_matches_brute_force(make_docs):
    rows = corpus(1)
    got = sorted(map(tuple, digest(make_docs(rows, files=3)).collect()), key=str)
    assert got == brute(rows, 35)


def test_other_lengths_and_kept_text(make_docs):
    rows = corpus(2, 25)
    for length in (2, 3, 8):
        out = remove_repeated_spans(make_docs(rows), length).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str)
        assert got == brute(rows, length)
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_empty_and_clashing_columns(spark, make_docs):
    assert digest(make_docs([])).collect() == []
    docs = make_docs([(1, "a b " * 40, "n", 2, 3)], "doc_id bigint, text string, n_words string, kept_text int, `a.b` int")
    out = remove_repeated_spans(docs).collect()[0]
    assert (out.doc_id, out.n_words, out.n_removed, out["a.b"]) == (1, 80, 80, 3)


def parity_words(n=1024):
    """Two words that polynomial hashes modulo a power of two do not tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_under_polynomials(make_docs):
    one, other = parity_words()
    rows = [(k, " ".join([x] * 35)) for k, x in enumerate((one, other, one[:64], other[:64], one + other, other + one))]
    rows.append((9, "c " + one + " " + " ".join(f"w{k}" for k in range(34))))
    rows.append((10, "d " + other + " " + " ".join(f"w{k}" for k in range(34))))
    got = sorted(map(tuple, digest(make_docs(rows)).collect()), key=str)
    assert got == brute(rows, 35)
    assert sum(r[2] for r in got) == 0


def test_levels(make_docs):
    assert ladder(35, 9) == [9, 18, 35] and ladder(2, 9) == [2] and ladder(36, 9) == [9, 18, 36] and ladder(35, 35) == [35]
    rows = corpus(3, 25)
    for shortest in (1, 3, 40):
        out = remove_repeated_spans(make_docs(rows), 35, shortest=shortest).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute(rows, 35)
    # Shorter repeats alone survive a level or two, not the last.
    rows = [(k, " ".join([f"s{j}" for j in range(20)] + [f"t{k}-{j}" for j in range(30)])) for k in range(5)]
    assert sorted(map(tuple, digest(make_docs(rows)).collect()), key=str) == brute(rows, 35)
