"""Removal of word spans that repeat anywhere in the corpus, by level-wise doubling."""

from __future__ import annotations

import hashlib
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsonde.llm import blocks, common
from colsonde.llm.wordhash import grow, sliding_min, window_hashes, word_hashes

_OUT = "n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"


def _inside(offsets: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which windows of ``length`` words, by first word, lie in one text."""
    ok = np.ones(max(0, n - length + 1), bool)
    for cut in (offsets[1:-1],):
        bad = np.zeros(n + 1, np.int32)
        np.add.at(bad, np.maximum(cut - length + 1, 0), 1)
        np.add.at(bad, cut, -1)
        ok &= np.cumsum(bad[: len(ok)]) == 0
    return ok


def ladder(window: int, shortest: int) -> list[int]:
    """Lengths from about ``shortest`` words to ``window``, each at most twice the one before."""
    lengths = [window]
    while lengths[0] > max(1, shortest):
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def _rungs(h: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Hashes of all windows of each length, each doubled up from the one before."""
    out = [window_hashes(h, lengths[0])]
    for have, want in pairwise(lengths):
        out.append(grow(out[-1], have, want))
    return out


def _asked(rungs: list[np.ndarray], lengths: list[int], ok: np.ndarray, level: int) -> np.ndarray:
    """Which windows of a level have to be known, so that all full windows within texts are decided.

    A longer window is represented by its least shorter one, which depends on its own words
    alone: equal windows have equal representatives, of which there are few.
    """
    asked = ok
    for k in range(len(lengths) - 2, level - 1, -1):
        least = sliding_min(rungs[k], lengths[k + 1] - lengths[k] + 1)
        chosen = np.zeros(len(rungs[k]), bool)
        for shift in range(lengths[k + 1] - lengths[k] + 1):
            chosen[shift : shift + len(least)] |= asked & (rungs[k][shift : shift + len(least)] == least)
        asked = chosen
    return asked


def _spread_back(flags: np.ndarray, n: int, length: int) -> np.ndarray:
    """Words covered by the flagged windows."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeated_spans(docs: DataFrame, window: int = 35, column: str = "text", is_scan: bool = False, shortest: int = 9) -> DataFrame:
    """Cut every word that some ``window``-word sequence, found at two places or more, covers.

    Level-wise doubling over :func:`ladder` (9, 18 and 35 words). Of a level's windows those
    are counted over the whole corpus that represent a longer one and whose own representative
    of the level before occurs twice or more; the levels end early if none does. Full windows
    are counted by two independent hashes, 128 bits. Windows are judged on the input.

    Returns the columns of ``docs`` with ``n_words``, ``n_removed``, ``kept_text`` (kept words
    joined by one space) and ``kept_sha256`` added; columns of these names are replaced.
    A null or blank text has no words; a text of fewer words than ``window`` loses none; a
    repeated row is another place, so long texts of repeated rows go altogether. ``is_scan``:
    docs is a plain scan of Parquet files already, so no copy is made of it.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    docs = docs.drop("n_words", "n_removed", "kept_text", "kept_sha256")
    spark, lengths = docs.sparkSession, ladder(window, shortest)
    source = docs if is_scan else blocks.stable(docs)
    only = blocks.named(source.select(common.text_of(column).alias("text")))
    bits, stretch = blocks.measure(only)
    common.ship(spark)

    def windows(level: int):
        full = level == len(lengths) - 1

        def of(_, rows, answers):
            *h, offsets = word_hashes(blocks.one_column(rows, "text"), lanes=2 if full else 1)
            ok = _inside(offsets, len(h[0]), window)
            rungs = _rungs(h[0], lengths)
            at = np.flatnonzero(_asked(rungs, lengths, ok, level))
            if level:
                least = sliding_min(rungs[level - 1], lengths[level] - lengths[level - 1] + 1)
                at = at[answers.holds(least[at])]
            return rungs[level][at], _rungs(h[1], lengths)[level][at] if full else None

        return of

    answers = None
    for level in range(len(lengths)):
        before, answers = answers, blocks.post(only, windows(level), bits, stretch, False, False, "span-windows", state=answers)
        if before:
            common.discard(before)
        if not blocks.any_answer(answers):
            break
    decided = level == len(lengths) - 1

    def cut(batches):
        for block, rows in blocks.runs(batches, stretch, "__text"):
            texts = blocks.one_column(rows, "__text")
            h, g, offsets = word_hashes(texts, lanes=2)
            flags = _inside(offsets, len(h), window)
            if decided:
                found = blocks.receive(answers, block, bits)
                flags[flags] = found.holds(_rungs(h, lengths)[-1][flags], _rungs(g, lengths)[-1][flags])
            else:
                flags[:] = False
            gone = _spread_back(flags, len(h), window) if len(h) >= window else np.zeros(len(h), bool)
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
            rest = rows.drop_columns(["__text"])
            for at in range(0, len(texts), 500):
                kept, sha = [], []
                for i in range(at, min(at + 500, len(texts))):
                    words = (texts[i].as_py() or "").encode().split()
                    if lost[i]:
                        words = compress(words, (~gone[offsets[i] : offsets[i + 1]]).tolist())
                    joined = b" ".join(words)
                    kept.append(joined.decode())
                    sha.append(hashlib.sha256(joined).hexdigest())
                part = rest.slice(at, len(kept))
                more = [pa.array(np.diff(offsets)[at : at + len(kept)], pa.int64()), pa.array(lost[at : at + len(kept)], pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())]
                names = [*rest.column_names, "n_words", "n_removed", "kept_text", "kept_sha256"]
                yield from pa.table([*part.columns, *more], names=names).to_batches()

    carried = blocks.named(source.withColumn("__text", common.text_of(column)))
    return common.map_rows(carried, cut, T.StructType([*source.schema, *T.StructType.fromDDL(_OUT)]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; only doc_id travels beside the text."""
    out = remove_repeated_spans(docs.select("doc_id", "text"), is_scan=True)
    return out.select("doc_id", F.col("n_words"), F.col("n_removed"), F.col("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM g) WHERE c > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w WHERE len(w) > 0),
k AS (SELECT t.doc_id, count(*) AS n, count(p.i) AS lost, coalesce(string_agg(word, ' ' ORDER BY t.i) FILTER (p.i IS NULL), '') AS kept
      FROM t LEFT JOIN p ON t.doc_id = p.doc_id AND t.i = p.i GROUP BY t.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(lost, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
