"""Packing of tokenised documents into fixed-length sequences by dynamic programming."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsonde.llm import common

#: Bytes of text that are tokenised in one go (or one longer text).
SLAB_BYTES = 1 << 20
#: Units of text whose ids a task remembers before it starts afresh.
REMEMBERED = 500_000
#: Sequences' worth of undecided ids at which the plan is asked what is settled; results do not depend on it.
ASKED = 64
#: Costs of a cut in ids of padding: at the end of a document, of a sentence, within one; and of a window.
DOCUMENT, SENTENCE, WITHIN, WINDOW = 0.0, 12.0, 64.0, 4.0


def slabs(batch: pa.RecordBatch, column: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each."""
    col = batch.column(batch.schema.get_field_index(column))
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class WordTokens:
    """Units of text (bytes) to places in a pool of token ids, filled as units are met.

    The tokenizer drops white space and never joins across it. Texts of ASCII and Latin-1
    letters are lower-cased and split here by the tokenizer's own pattern, so a unit is what
    its merges work on, and goes to them directly: its normaliser does no more to such texts.
    In other texts, and in those that may name a special token, a unit is a word, given to
    the whole tokenizer; its key is told apart by a leading zero byte. Units not met before
    are learnt together, a slab's at a time.
    """

    _letters = rb"a-z\xdf-\xf6\xf8-\xff"
    #: Marks take the white space after them along, which tells ends of sentences.
    _unit = re.compile(rb"'(?:[stmd]|re|ve|ll)|[" + _letters + rb"]+|[0-9]|[!-/:-@\[-`{-~]+ ?")
    _fold = bytes(b + 32 if 65 <= b <= 90 or 192 <= b <= 222 and b != 215 else 32 if b in b"\t\n\v\f\r" else b for b in range(256))
    _plain = bytes([*b"\t\n\v\f\r", *range(32, 127), *(b for b in range(192, 256) if b not in (215, 247))])
    _stops = tuple(x.encode() for x in ".!?。！？")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        shown = {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}
        self.shown = {b: c for b, c in shown.items() if b != 10}
        self._reset()

    def _reset(self) -> None:
        self.places: dict[bytes, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.stops = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _units(self, text: str) -> list[bytes]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        if raw is None or raw.translate(None, self._plain) or b"<|" in raw:
            return [b"\0" + w for w in text.encode().split()]
        return self._unit.findall(raw.translate(self._fold))

    def _learn(self, units: list[bytes]) -> None:
        pieces = [u for u in units if u[0]]
        words = [u for u in units if not u[0]]
        stops = [u[-1] == 32 and u[-2] in b".!?" for u in pieces] + [u.endswith(self._stops) for u in words]
        shown = b"\n".join(pieces).replace(b" ", b"").decode("latin-1").encode().decode("latin-1").translate(self.shown)
        merge = self.tokenizer.model.tokenize
        flat, sizes = [], []
        for piece in shown.split("\n") if pieces else ():
            tokens = merge(piece)
            flat += [t.id for t in tokens]
            sizes.append(len(tokens))
        for found in self.tokenizer.encode_batch_fast([w[1:].decode("utf-8", "replace") for w in words], add_special_tokens=False):
            flat += found.ids
            sizes.append(len(found.ids))
        sizes = np.array(sizes, np.int64)
        self.places.update(zip([*pieces, *words], range(len(self.places), len(self.places) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.array(flat, np.uint32)])
        self.stops = np.concatenate([self.stops, np.array(stops, bool)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with an end id after each text, offsets of the texts, ends of sentences within)."""
        if len(self.places) > REMEMBERED:
            self._reset()
        units, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                u = self._units(text)
                counts[i] = len(u)
                units += u
        place = np.fromiter(map(self.places.get, units, repeat(-1)), np.int64, len(units))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            unmet = [units[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(unmet)))
            place[unknown] = np.fromiter(map(self.places.__getitem__, unmet), np.int64, len(unmet))
        sizes = self.sizes[place]
        starts = self.starts[place]
        ends = np.cumsum(sizes)
        doc_units = np.concatenate([[0], np.cumsum(counts)])
        doc_ends = np.concatenate([[0], ends])[doc_units[1:]]
        total = int(ends[-1]) if len(ends) else 0
        ids = np.ones(total + len(texts), np.uint32)
        owner = np.repeat(np.arange(len(texts)), counts)
        if total:
            take = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
            put = np.repeat(owner, sizes) + np.arange(total)
            ids[put] = self.pool[take]
        offsets = np.concatenate([[0], doc_ends + np.arange(1, len(texts) + 1)])
        return ids, offsets, (ends + owner)[self.stops[place]]


class Planner:
    """Windows of least total cost over a stream, planned as the stream grows.

    A window of n ids (at most ``size``) pads ``size - n``, or nothing at a power of two of an
    eighth of ``size`` or more; at the end of the stream, of any power of two. It costs that,
    WINDOW, and the cost of the cut that ends it. The best start of a padded window is the
    least f(i) + i within reach, kept in a monotone queue; powers of two are looked up.

    A prefix is settled once the best ways to all places that a later window can start from
    lead through it, so the windows are those of one programme over the whole stream. Ways
    meet within a few sequences; until they do, the stream is held.
    """

    def __init__(self, size: int):
        self.size = size
        self.cuts, self.costs = [0], [0.0]  # of nodes that are not given up, in order
        self.best, self.level, self.back = [0.0], [0.0], [0]
        self.queue: deque[int] = deque([0])
        self.powers = [1 << k for k in range(size.bit_length()) if (1 << k) <= size]

    def extend(self, cuts: list[int], costs: list[float]) -> None:
        """Further places where the stream may be cut, with no gap above ``size``, and what that costs."""
        self.cuts += cuts
        self.costs += costs

    def _run(self, upto: int, powers: list[int]) -> None:
        """Best ways to the nodes whose places are at most ``upto``."""
        first = len(self.best)
        cuts, costs, best, level, back, queue, size = self.cuts, self.costs, self.best, self.level, self.back, self.queue, self.size
        last = bisect_right(cuts, upto, first)
        if last <= first:
            return
        known = np.array(cuts[:last], np.int64)
        exact: dict[int, list[int]] = {}
        for p in powers:
            at = np.searchsorted(known, known[first:] - p)
            for j in np.flatnonzero(known[at] == known[first:] - p).tolist():
                exact.setdefault(first + j, []).append(int(at[j]))
        for j in range(first, last):
            c = cuts[j]
            while cuts[queue[0]] < c - size:
                queue.popleft()
            i = queue[0]
            value = level[i] + size - c
            if j in exact:
                for k in exact[j]:
                    if best[k] < value:
                        value, i = best[k], k
            value += costs[j] + WINDOW
            best.append(value)
            back.append(i)
            g = value + c
            level.append(g)
            while queue and level[queue[-1]] >= g:
                queue.pop()
            queue.append(j)

    def settle(self, last: bool) -> list[int]:
        """Ends of further windows that no later place can change; all that are left if ``last``."""
        end = self.cuts[-1]
        self._run(end - self.size, self.powers[-4:])
        if last:
            self._run(end, self.powers)
            node = len(self.best) - 1
        else:
            # Later windows start at a node in reach of the first one not run yet, or after it.
            run = len(self.best)
            if run == len(self.cuts):
                return []
            live = list(range(bisect_left(self.cuts, self.cuts[run] - self.size, 0, run), run))
            while len(live) > 1:
                node = self.back[live.pop()]
                at = bisect_left(live, node)
                if at == len(live) or live[at] != node:
                    live.insert(at, node)
            node = live[0]
        ends, j = [], node
        while j:
            ends.append(self.cuts[j])
            j = self.back[j]
        for held in (self.cuts, self.costs, self.best, self.level):
            del held[:node]
        self.back = [max(0, b - node) for b in self.back[node:]]
        self.queue = deque(q - node for q in self.queue if q >= node)
        return ends[::-1]


def cut_places(start: int, docs: np.ndarray, sentences: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) where the stream may be cut after ``start``: ends of documents, of sentences, and within long ones."""
    places = np.concatenate([docs, sentences])
    costs = np.repeat([DOCUMENT, SENTENCE], [len(docs), len(sentences)])
    order = np.lexsort((costs, places))
    places, costs = places[order], costs[order]
    new = np.diff(places, prepend=start) > 0
    places, costs = places[new], costs[new]
    step = max(1, size // 8)
    gaps = np.diff(places, prepend=start)
    more = (gaps - 1) // step
    within = np.repeat(places - gaps - step * (np.cumsum(more) - more), more) + step * (np.arange(more.sum()) + 1)
    order = np.argsort(np.concatenate([places, within]), kind="stable")
    return np.concatenate([places, within])[order], np.concatenate([costs, np.full(len(within), WITHIN)])[order]


class Packer:
    """The stream of one task's documents, from which planned windows are given out as pieces."""

    def __init__(self, size: int):
        self.size, self.base = size, 0
        self.parts: list[np.ndarray] = []  # ids of the stream from base on
        self.end = 0
        self.docs: deque = deque()  # (row, start, end) in ids of the stream; base is the first kept
        self.plan = Planner(size)
        self.sequence = 0

    def add(self, rows: list, ids: np.ndarray, offsets: np.ndarray, sentences: np.ndarray) -> None:
        if not rows:
            return
        at = self.end
        self.docs.extend(zip(rows, (offsets[:-1] + at).tolist(), (offsets[1:] + at).tolist(), strict=True))
        places, costs = cut_places(at, offsets[1:] + at, sentences[sentences > 0] + at, self.size)
        self.plan.extend(places.tolist(), costs.tolist())
        self.parts.append(ids)
        self.end += len(ids)

    def ready(self) -> bool:
        return self.end - self.base >= ASKED * self.size

    def take(self, last: bool) -> Iterator[tuple]:
        """Pieces (row, start in the document, length, crc32, document's ids, sequence, offset)."""
        ends = self.plan.settle(last) if self.end > self.base else []
        if not ends:
            return
        ids = np.concatenate(self.parts).astype("<u4", copy=False)
        base, x = self.base, self.base
        for b in ends:
            a = x
            while x < b:
                row, start, end = self.docs[0]
                stop = min(end, b)
                yield row, x - start, stop - x, zlib.crc32(ids[x - base : stop - base].data), end - start, self.sequence, x - a
                x = stop
                if x == end:
                    self.docs.popleft()
            self.sequence += 1
        self.parts, self.base = [ids[x - base :].copy()], x


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack documents, in their order, into sequences of at most ``size`` token ids.

    A document is the ids of its text and then id 1, so null and empty texts are one id. Each
    task packs the documents it reads, one after the other: windows over the stream are cut at
    ends of documents or sentences (within a sentence only if it is long) so that padding plus
    cutting costs least, by one dynamic programme over all the task reads (:class:`Planner`). The
    last windows of a task may be of any power of two, which needs no padding.

    One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    sequence_id is the partition's number times 2**40 plus a count. Repeated rows are packed
    each; a null key is kept. ``docs`` should be a file scan, so that a lost task repeats alike.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("__key"), F.col(column).cast("string").alias("__text"))
    names = ["__key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        import gc
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # no cycles are made, and looking for them through all that is held takes a tenth of the time
        words, packer = WordTokens(tokenizer), Packer(size)
        first = TaskContext.get().partitionId() << 40
        key_type = None

        def rows(pieces):
            cols = list(zip(*pieces, strict=True))
            if not cols:
                return
            arrays = [pa.array(cols[0], key_type)] + [pa.array(c, pa.int64()) for c in cols[1:5]]
            arrays += [pa.array([first + s for s in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

        try:
            for batch in batches:
                key_type = batch.schema.field("__key").type
                for slab in slabs(batch, "__text"):
                    packer.add(slab.column(0).to_pylist(), *words.encode(slab.column(1).to_pylist()))
                    if packer.ready():
                        yield from rows(packer.take(False))
            if key_type is not None:
                yield from rows(packer.take(True))
        finally:
            gc.enable()

    out = source.mapInArrow(common.tidy(run), f"__key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("__key", key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack(docs.select("doc_id", "text"), default_tokenizer())
