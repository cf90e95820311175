import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colsonde.llm.packing import Planner, WordTokens, cut_places, default_tokenizer, digest


@pytest.fixture(scope="module")
def words():
    return WordTokens(default_tokenizer())


def whole(tokens, text):
    return tokens.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbéÉßÿŸİΣσς'’s.,!<|endoftext>1 \n\t\x0b\x1c\x85　é日ª×÷µ-")), max_size=5))
def test_ids_equal_those_of_whole_texts(words, texts):
    ids, offsets, _ = words.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole(words, t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from([*map(chr, range(33, 127)), *map(chr, range(192, 256)), *" \n\t\x0b\x0c\r'''"]), max_size=60))
def test_plain_texts_are_split_as_the_tokenizer_does(words, text):
    assert words.encode([text])[0].tolist() == whole(words, text)


def test_special_tokens_and_contractions(words):
    for t in ("a<|endoftext|>b c", "<|x .<| ...'s,'s 'lla 12.5 ÀÞß's'T'RE ''d",  "it's we'll I'D", "ﬁ Å é", "x" * 300, "<|startoftext|> hi"):
        ids, _, _ = words.encode([t])
        assert ids.tolist() == whole(words, t)


def cost_of(n, size, tail):
    return 0 if n & (n - 1) == 0 and (n >= size // 8 or tail) else size - n


def brute(cuts, costs, size):
    best = [0.0] + [1e18] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        for i in range(j):
            n = cuts[j] - cuts[i]
            if n <= size:
                best[j] = min(best[j], best[i] + cost_of(n, size, cuts[j] > cuts[-1] - size) + costs[j] + 4.0)
    return best[-1]


def test_plan_is_optimal_however_the_stream_is_dealt():
    g = random.Random(5)
    for _ in range(60):
        cuts = [0]
        while len(cuts) < 200:
            cuts.append(cuts[-1] + g.randint(1, g.choice([4, 20, 64])))
        costs = [g.choice([0.0, 12.0, 64.0]) for _ in cuts]
        planner, ends, at = Planner(64), [0], 1
        while at < len(cuts):
            to = min(len(cuts), at + g.randint(1, 30))
            planner.extend(cuts[at:to], costs[at:to])
            at = to
            if at < len(cuts) and g.random() < 0.7:
                ends += planner.settle(False)
        ends += planner.settle(True)
        cost, total = dict(zip(cuts, costs, strict=True)), 0.0
        for a, b in zip(ends, ends[1:], strict=False):
            assert 0 < b - a <= 64
            total += cost_of(b - a, 64, b > cuts[-1] - 64) + cost[b] + 4.0
        assert ends[-1] == cuts[-1] and total == pytest.approx(brute(cuts, costs, 64))


def test_settles_early_and_gives_up_what_is_settled():
    g, planner, at, settled, held = random.Random(1), Planner(2048), 0, 0, []
    for _ in range(50):
        steps = np.cumsum([g.randint(1, 60) for _ in range(2000)]) + at
        planner.extend(steps.tolist(), [g.choice([0.0, 12.0]) for _ in steps])
        at = int(steps[-1])
        settled = (planner.settle(False) or [settled])[-1]
        held.append((at - settled) / 2048)
        assert len(planner.best) == len(planner.level) == len(planner.back)
    assert settled > 0 and max(held) < 400


def test_cut_places():
    places, costs = cut_places(10, np.array([20, 60, 61]), np.array([14, 20, 55]), 64)
    assert places.tolist() == [14, 20, 28, 36, 44, 52, 55, 60, 61]
    assert costs.tolist() == [12.0, 0.0, 64.0, 64.0, 64.0, 64.0, 12.0, 0.0, 0.0]


def test_pieces_cover_every_id_once(make_docs, words):
    g = random.Random(3)
    texts = [" ".join(g.choice(["word", "Thing,", "it's", "été.", "of"]) for _ in range(g.choice([0, 1, 30, 400, 9000]))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (None, "a b"), (7, texts[7])]
    docs = make_docs(rows, files=2)
    got = digest(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    padding = tokens = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * tokens
    for i, t in rows:
        ids = np.array(whole(words, t), "<u4")
        parts = sorted(by_doc[i], key=lambda r: (r.start, r.sequence_id))
        copies = 2 if i == 7 else 1
        assert sum(r.length for r in parts) == copies * len(ids)
        for r in parts:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_empty_table(make_docs):
    assert digest(make_docs([])).collect() == []
