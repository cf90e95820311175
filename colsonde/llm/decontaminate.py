"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsonde.llm import common
from colsonde.llm.packing import slabs

#: Item text (bytes) that one automaton holds; more items are streamed against in further blocks.
BLOCK_BYTES = 8 << 20

#: Every byte that is no letter, digit or part of a longer character separates; A-Z fold.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, for the longest match at each word read.

    ``jump[state]`` maps a word's number to the next state; ``length`` and ``link`` are the
    automaton's own. A state holds one sequence of each length above its link's, so a window is
    the state that holds it and its length: ``full[state]`` are the items of the full window in
    it, ``short[state]`` those of short items by their lengths. ``whole`` and ``above`` lead from
    a state along its links to the one that holds its full window, and the next one with
    short items.
    """

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.jump: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        read = []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number)) for w in item_words(text)]
            last = 0
            for w in words:
                last = self._extend(last, w)
            read.append((item, words))
        self._lead()
        self.full: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for item, words in read:
            state = 0
            for i, w in enumerate(words):
                state = self.jump[state][w]
                if i + 1 >= window:
                    self.full.setdefault(self.whole[state], set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(state, {}).setdefault(len(words), set()).add(item)
        self._lead()
        self.least = min([window, *(n for found in self.short.values() for n in found)])

    def _lead(self) -> None:
        """``whole`` and ``above`` of all states, shorter ones first, as links lead to them."""
        n, short = len(self.jump), getattr(self, "short", {})
        self.whole, self.above = [0] * n, [0] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= self.window:
                self.whole[state] = self.whole[up] if self.length[up] >= self.window else state
            self.above[state] = up if up in short else self.above[up]

    def _new(self, length: int) -> int:
        self.jump.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.jump) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the words of ``p`` and then ``w``, apart from the longer ones of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1)
        self.jump[twin] = dict(self.jump[q])
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p != -1 and self.jump[p].get(w) == q:
            self.jump[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.jump[last]:
            return self._split(last, w, self.jump[last][w])
        state, p = self._new(self.length[last] + 1), last
        while p != -1 and w not in self.jump[p]:
            self.jump[p][w] = state
            p = self.link[p]
        self.link[state] = 0 if p == -1 else self._split(p, w, self.jump[p][w])
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(merged spans of words inside windows, items whose windows occur)."""
        number, jump, link, length = self.number.get, self.jump, self.link, self.length
        full, short, whole, above, window, least = self.full, self.short, self.whole, self.above, self.window, self.least
        spans: list[tuple[int, int]] = []
        items: set = set()
        state = match = 0
        for i, word in enumerate(words):
            w = number(word, -1)
            if w < 0:
                state = match = 0
                continue
            while state and w not in jump[state]:
                state = link[state]
                match = length[state]
            if w not in jump[state]:
                continue
            state = jump[state][w]
            match += 1
            if match < least:
                continue
            start = i + 1
            if match >= window:
                found = full.get(whole[state])
                if found:
                    items |= found
                    start = i + 1 - window
            if short:
                at = state if state in short else above[state]
                while at:
                    for n, found in short[at].items():
                        if n <= match:
                            items |= found
                            start = min(start, i + 1 - n)
                    at = above[at]
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def _blocks(items: DataFrame, key: str, column: str) -> list[DataFrame]:
    """The items in blocks of at most BLOCK_BYTES each, as measured, but for one longer item on its own."""
    sized = items.select(F.col(key).alias("item"), common.text_of(column).alias("text")).where("text <> ''").distinct()
    size = F.octet_length("text") + F.coalesce(F.octet_length(F.col("item").cast("string")), F.lit(0))
    total = sized.agg(F.sum(size)).first()[0]
    if not total:
        return []
    if total <= BLOCK_BYTES:
        return [sized]
    sized = common.settle(sized, "benchmark-items")
    parts = -(-total // (BLOCK_BYTES // 2))
    while True:
        part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
        found = sized.groupBy(part.alias("part")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))
        if found.where((F.col("size") > BLOCK_BYTES) & (F.col("n") > 1)).isEmpty():
            return [sized.where(part == k) for k in range(parts)]
        parts *= 2


_built: dict[str, Automaton] = {}


def _automaton(name: str, packed: str, window: int) -> Automaton:
    """Built once a worker and block; only the last is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton([tuple(x) for x in json.loads(packed)], window)
    return _built[name]


def match_items(docs: DataFrame, items: DataFrame, window: int = 13, column: str = "text", item_key: str = "item_id", item_column: str = "text") -> DataFrame:
    """``docs`` with n_words, __spans (words inside items' windows) and __items (as strings, sorted).

    Words are runs of letters a-z (A-Z folded), digits and non-ASCII characters. A window is
    ``window`` consecutive words of an item, or all of an item of fewer. Documents stream
    through the automaton once for every block of items; there is one block up to BLOCK_BYTES.
    Null and blank texts have no words; null item keys match but are not listed; columns of
    these names are replaced; repeated rows are matched each.
    """
    spark = docs.sparkSession
    common.ship(spark)
    out = docs.drop("n_words", "__spans", "__items").withColumn("__text", F.col(column).cast("string"))
    out = out.withColumn("n_words", F.lit(0).cast("bigint")).withColumn("__spans", F.array().cast("array<struct<a:int,b:int>>"))
    out = out.withColumn("__items", F.array().cast("array<string>"))
    schema = out.schema
    for sized in _blocks(items, item_key, item_column) or [None]:
        # A block has been measured, so this is bounded by BLOCK_BYTES, or is one longer item.
        rows = [] if sized is None else [[r.item if r.item is None else str(r.item), r.text] for r in sized.collect()]
        packed = json.dumps(rows, ensure_ascii=False)
        name = hashlib.sha256(packed.encode()).hexdigest()
        sent = spark.sparkContext.broadcast(packed)

        def run(batches, sent=sent, name=name):
            machine = _automaton(name, sent.value, window)
            for batch in batches:
                for slab in slabs(batch, "__text"):
                    at = {n: i for i, n in enumerate(slab.schema.names)}
                    counts, spans, found = [], [], []
                    old_spans, old_items = slab.column(at["__spans"]).to_pylist(), slab.column(at["__items"]).to_pylist()
                    for k, text in enumerate(slab.column(at["__text"]).to_pylist()):
                        words = item_words(text)
                        s, i = machine.scan(words)
                        counts.append(len(words))
                        merged = _union([(x["a"], x["b"]) for x in old_spans[k]] + s) if old_spans[k] else s
                        spans.append([{"a": a, "b": b} for a, b in merged])
                        found.append(sorted({*old_items[k], *(x for x in i if x is not None)}))
                    columns = [slab.column(c) for c in range(slab.num_columns)]
                    for column_name, values in (("n_words", counts), ("__spans", spans), ("__items", found)):
                        columns[at[column_name]] = pa.array(values, slab.schema.field(column_name).type)
                    yield pa.RecordBatch.from_arrays(columns, names=slab.schema.names)

        out = common.map_rows(out, run, schema)
    return out.drop("__text")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def judge(docs: DataFrame, items: DataFrame, window: int = 13, per_cent: int = 5, **names) -> DataFrame:
    """:func:`match_items` with n_hit, n_items, items (comma-joined) and contaminated.

    A document is contaminated if words are hit at all and make ``per_cent`` of its words or more.
    """
    out = match_items(docs, items, window, **names)
    hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["b"] - s["a"])
    out = out.withColumn("n_hit", hit).withColumn("n_items", F.size("__items").cast("bigint"))
    out = out.withColumn("items", F.array_join("__items", ","))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= per_cent * F.col("n_words")))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given spans of words, each from its first word's start to its last word's end."""
    raw, out, at = text.encode(), [], 0
    places = [m.span() for m in _WORD.finditer(raw)]
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def cut_spans(judged: DataFrame, column: str = "text") -> DataFrame:
    """Cut hit spans of contaminated documents from ``column``, which keeps all else unchanged.

    A hit span goes from the first character of its first word to the last of its last. Rows
    and columns stay as they are otherwise; null texts stay null.
    """
    common.ship(judged.sparkSession)

    def run(batches):
        for batch in batches:
            for slab in slabs(batch, column):
                at = {n: i for i, n in enumerate(slab.schema.names)}
                texts = slab.column(at[column]).to_pylist()
                spans, bad = slab.column(at["__spans"]).to_pylist(), slab.column(at["contaminated"]).to_pylist()
                cut = [cut_text(t, [(s["a"], s["b"]) for s in spans[i]]) if bad[i] and t else t for i, t in enumerate(texts)]
                columns = list(slab.columns)
                columns[at[column]] = pa.array(cut, slab.schema.field(column).type)
                yield pa.RecordBatch.from_arrays(columns, schema=slab.schema)

    return common.map_rows(judged, run, judged.schema)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = judge(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


# Windows of the items are equi-joined with those of the documents, by their words.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
o AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM g JOIN v ON g.n = v.n AND g.win = v.win),
h AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
