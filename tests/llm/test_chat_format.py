import json
import random
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from colsonde.llm.chat_format import SQL, canonical, digest

KIND = "conv_id bigint, turn bigint, role string, text string"


def call(i, name, args, **more):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args}], **more})


def answer(i, content="ok", **more):
    return json.dumps({"tool_call_id": i, "content": content, **more})


def formatted(spark, rows):
    out = digest(spark.createDataFrame(rows, KIND)).collect()
    return sorted(out, key=lambda r: (str(r.conv_id), r.seq))


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", answer("a", "early")),
        (1, 2, "assistant", call("a", "search", {"query": "q", "limit": 3.0}, content="look")),
        (1, 3, "assistant", call("b", "search", {"limit": "three"})),
        (1, 4, "tool", answer("zz", "lost")),
        (1, 5, "assistant", call("c", "unknown", {})),
        (1, 6, "assistant", call("d", "search", {"query": "q", "filter": {"lang": "xx"}})),
        (1, 7, "assistant", call("e", "search", {"query": "q", "filter": {"lang": "de"}, "sources": ["a", "b"]})),
        (1, 8, "assistant", call("f", "search", {"query": "q", "sources": ["a", 1]})),
    ]
    got = formatted(spark, rows)
    found = [json.loads(r.message) for r in got]
    assert [m.get("content") for m in found][:3] == ["hi", "look", "early"]
    assert found[1]["tool_calls"] == [{"arguments": '{"limit":3,"query":"q"}', "id": "a", "name": "search"}]
    assert [(r.turn, r.n_calls, r.n_invalid, r.linked, r.orphan) for r in got] == [
        (0, 0, 0, False, False), (2, 1, 0, False, False), (1, 0, 0, True, False), (3, 1, 1, False, False), (4, 0, 0, False, True),
        (5, 1, 1, False, False), (6, 1, 1, False, False), (7, 1, 0, False, False), (8, 1, 1, False, False),
    ]


def test_canonical_numbers(spark):
    given = {
        '{"b":1e2,"a":{"z":3.0,"y":[1.50,-0.0,1e-7,1.5e22,0.00001,123456789012345678901234567890, -0, 12345.678,1e20]}}':
            '{"a":{"y":[1.5,0,1e-7,1.5e+22,0.00001,123456789012345678901234567890,0,12345.678,100000000000000000000],"z":3},"b":100}',
        '{"k 1.0":"a\\"1.00"}': '{"k 1.0":"a\\"1.00"}', "[]": "[]", '{"a":1,"a":2}': None, "{": None,
    }
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", canonical(F.to_json(F.try_parse_json("t"))).alias("c"))
    assert {r.t: r.c for r in rows.collect()} == given


def test_chains_cycles_and_repeated_identifiers(spark):
    rows = [
        # c answers b's call, b answers a's, all stand before a; a chain of three.
        (1, 1, "tool", answer("y", "c")), (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": "b", "tool_calls": [{"id": "y", "name": "weather", "arguments": {"city": "s"}}]})),
        (1, 3, "assistant", call("x", "weather", {"city": "s"}, content="a")), (1, 4, "user", "d"),
        # Two messages that answer each other, and one that answers the second.
        (2, 1, "tool", json.dumps({"tool_call_id": "q", "content": "e", "tool_calls": [{"id": "p", "name": "n"}]})),
        (2, 2, "tool", json.dumps({"tool_call_id": "p", "content": "f", "tool_calls": [{"id": "q", "name": "n"}, {"id": "r", "name": "n"}]})),
        (2, 0, "tool", answer("r", "g")),
        # One identifier called twice: each result answers the last call before it, or the first.
        (3, 1, "tool", answer("i", "h")), (3, 2, "assistant", call("i", "weather", {"city": "1"}, content="j")), (3, 3, "tool", answer("i", "k")),
        (3, 4, "assistant", call("i", "weather", {"city": "2"}, content="l")), (3, 5, "tool", answer("i", "m")),
        # A message that answers its own call stays.
        (4, 0, "tool", json.dumps({"tool_call_id": "s", "content": "n", "tool_calls": [{"id": "s", "name": "n"}]})),
    ]
    got = defaultdict(list)
    for r in formatted(spark, rows):
        got[r.conv_id].append((json.loads(r.message)["content"], r.linked, r.cyclic))
    assert "".join(x[0] for x in got[1]) == "abcd" and "".join(x[0] for x in got[3]) == "jhklm"
    assert got[2] == [("e", True, True), ("f", True, True), ("g", True, False)]
    assert got[4] == [("n", True, False)]


def brute(rows):
    """conv_id, seq, turn, linked, orphan of every message."""
    out = []
    convs = defaultdict(set)
    for c, t, role, text in rows:
        convs[c].add((t, role or "", text or ""))
    for c, messages in convs.items():
        order = sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0, m[1], sha256(m[2].encode()).hexdigest()))
        parsed = [json.loads(m[2]) if m[1] in ("assistant", "tool") and m[2].startswith("{") else {} for m in order]
        turn = [-(2**63) if m[0] is None else m[0] for m in order]
        parent = {}
        for i, p in enumerate(parsed):
            if order[i][1] == "tool" and p.get("tool_call_id") is not None:
                calls = [j for j, q in enumerate(parsed) if any(x["id"] == p["tool_call_id"] for x in q.get("tool_calls", []))]
                before = [j for j in calls if turn[j] <= turn[i]]
                parent[i] = before[-1] if before else calls[0] if calls else None

        def chain(i, links):
            seen = [i]
            while links.get(seen[-1]) is not None and links[seen[-1]] not in seen:
                seen.append(links[seen[-1]])
            return seen

        links = {i: p for i, p in parent.items() if p != i}
        around = {i for i in links if links.get(chain(i, links)[-1]) == i}
        links = {i: p for i, p in links.items() if i not in around}
        keyed = sorted(range(len(order)), key=lambda i: (max(turn[j] for j in chain(i, links)), len(chain(i, links)), i))
        for seq, i in enumerate(keyed):
            out.append((c, seq, order[i][0], parent.get(i) is not None, i in parent and parent[i] is None, i in around))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def generated():
    g = random.Random(11)
    rows = []
    for c in range(30):
        ids = ["i%d" % k for k in range(4)]
        for _ in range(g.randint(1, 14)):
            turn = g.choice([None, *range(10)])
            kind = g.random()
            if kind < 0.3:
                rows.append((c, turn, "user", g.choice(["hello", "", None, "{not json"])))
            elif kind < 0.6:
                rows.append((c, turn, "assistant", call(g.choice(ids), g.choice(["search", "weather", "none"]), g.choice([{"query": "x"}, {"city": "y", "days": 2}, {"a b": 1}, {"query": "x", "limit": 2.5}]))))
            elif kind < 0.85:
                rows.append((c, turn, "tool", answer(g.choice([*ids, "gone"]), g.choice(["r", "s"]))))
            else:
                rows.append((c, turn, "tool", json.dumps({"tool_call_id": g.choice(ids), "tool_calls": [{"id": g.choice(ids), "name": "weather", "arguments": {"city": "z"}}]})))
        if g.random() < 0.3:
            rows.append(rows[-1])
    return rows


def test_matches_brute_force_and_sql(spark, generated):
    got = formatted(spark, generated)
    assert sorted(((r.conv_id, r.seq, r.turn, r.linked, r.orphan, r.cyclic) for r in got), key=str) == brute(generated)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", generated)
    want = db.sql(SQL)
    assert want.columns == got[0].__fields__
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
    assert any(r.cyclic for r in got) and any(r.n_invalid for r in got) and sum(r.linked for r in got) > 30


def test_nulls_repeats_long_conversations_and_clashing_columns(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 0, "user", "b"), (2, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 5000, "user", 'é\n"')]
    got = [(r.conv_id, r.seq, r.message) for r in formatted(spark, rows)]
    assert got == [
        (2, 0, '{"content":"","role":""}'), (2, 1, '{"content":"x","role":"user"}'), (3, 0, '{"content":"é\\n\\"","role":"user"}'),
        (None, 0, '{"content":"a","role":"user"}'), (None, 0, '{"content":"b","role":"user"}'),
    ]
    assert digest(spark.createDataFrame([], KIND)).collect() == []
    # One conversation over many ranges; a call far from its result, whose identifier others repeat.
    long = [(7, k, "user", "m%d" % k) for k in range(3000)] + [(7, 10, "assistant", call("far", "weather", {"city": "c"})), (7, 2999, "tool", answer("far")), (7, 0, "tool", answer("far", "0"))]
    clash = [(*r, 1, "s") for r in long]
    out = digest(spark.createDataFrame(clash, f"{KIND}, seq int, __m string")).orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(3003)) and sum(r.linked for r in out) == 2
    assert [r.turn for r in out][:14] == [*range(11), 10, 0, 11]
