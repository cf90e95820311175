import re
from collections import Counter, defaultdict

import corpus_pipeline
from colsonde.llm import quality_model

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LIMITS = {"symbols": (3, 40), "dup_lines": (3, 150), "repeats": (3, 150), "word_length": (4, 150)}


def words(text):
    return [w for w in text.translate(str.maketrans(WHITE, " " * 6)).split(" ") if w]


def quality(rows, _):
    measured = {}
    for i, r in rows.items():
        text, w = r.text or "", words(r.text or "")
        n, chars = len(w), sum(map(len, w))
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        grams = [tuple(w[k : k + 3]) for k in range(n - 2)]
        seen = Counter(grams)
        again = len({p for k, g in enumerate(grams) if seen[g] > 1 for p in (k, k + 1, k + 2)})
        if n >= 50 and 100 * again <= 50 * n:
            symbols = len(re.findall(r"[#*$%&|<>]", text))
            measured[i] = dict(zip(LIMITS, (1000 * symbols // chars, 1000 * (len(lines) - len(set(lines))) // (len(lines) + 5), 1000 * again // (n + 50), 100 * chars // n), strict=True))

    def limits(of):
        out = {}
        for k, (spread, slack) in LIMITS.items():
            cells = sorted(v >> d << d for m in of for v in [m[k]] for d in [max(0, len(bin(v)) - 2 - 6)])
            low, high = (cells[-(-len(cells) * q // 4) - 1] for q in (1, 3))
            reach = spread * (high - low) + slack
            out[k] = max(low - reach, 0), high + reach
        return out

    def blend(of, wide):
        n, own = len(of), limits(of)
        return {k: ((n * max(own[k][0], wide[k][0] // 2) + 100 * wide[k][0]) // (n + 100), (n * min(own[k][1], 2 * wide[k][1]) + 100 * wide[k][1]) // (n + 100)) for k in own}

    groups = defaultdict(list)
    for i, m in measured.items():
        groups[rows[i].lang, None].append(m)
        groups[rows[i].lang, "of", rows[i].source].append(m)
    everyone = limits(list(measured.values()))

    def fits(i, m):
        lang = blend(groups[rows[i].lang, None], everyone)
        own = blend(groups[rows[i].lang, "of", rows[i].source], lang)
        return all(m[k] <= own[k][1] for k in m) and m["word_length"] >= own["word_length"][0]

    return {i: rows[i].text for i, m in measured.items() if fits(i, m)}


def lines(rows, _):
    holders = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(FOLD)
    for i, r in rows.items():
        for line in r.text.split("\n"):
            holders[key(line)].add(i)
    gone = lambda i, k: len(k) >= 40 and len(holders[k]) >= 5 and i != max(holders[k])
    return {i: "\n".join(x for x in r.text.split("\n") if not gone(i, key(x))) for i, r in rows.items()}


def near_copies(rows, _):
    sets = {}
    for i, r in rows.items():
        w = words(r.text.translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in rows}
    for i in rows:
        for j in rows:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    return {i: r.text for i, r in rows.items() if least[i] == i}


def decontaminated(rows, items):
    split = lambda text: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)) if w]
    windows = {tuple(w[k : k + 13]) for x in items for w in [split(x)] if w for k in range(max(1, len(w) - 12))}
    sizes, out = {len(x) for x in windows}, {}
    for i, r in rows.items():
        w = split(r.text)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            out[i] = r.text
    return out


def test_each_stage_keeps_what_brute_force_keeps(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    changed = []
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (quality, lines, near_copies, decontaminated), strict=True):
        rows = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.common.settle(stage(spark, docs, sf), "test-stage")
        out = docs.collect()
        got, want = {r.doc_id: r.text for r in out}, brute(rows, items)
        assert len(out) == len(got) and got == want, name
        assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source) for r in out if r.text != rows[r.doc_id].text), name
        changed.append(got != {i: r.text for i, r in rows.items()})
    assert all(changed)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_model.digest(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = scored.where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert area > 0.95
