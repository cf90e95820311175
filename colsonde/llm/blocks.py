"""Counting of hashes over the whole corpus without moving texts.

A *block* is a bounded run of adjacent rows of one file. Every block sends each of its distinct
hashes once, packed by hash range; the ranges are counted by grouped tasks of a size that the
input sets; and each block gets back, in a folder of its own stretch of the file, those of its
hashes that occur at least twice. A hash held by a third of all documents costs an entry a
block, not one a document, so there are no hot groups.

Blocks are named by file and row numbers, which no scan can change. How Spark deals files over
partitions does change from pass to pass: it follows the cores registered at the time. So a
block takes the answers of all blocks that it shares rows with. Those of other rows among them
do no harm, since what is said of a hash holds for the whole corpus. The input has to be a plain
scan of Parquet files (see :func:`stable`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsonde.llm import common

#: Bytes of text in a block, at which it is closed (it may exceed this by one row).
BLOCK_BYTES = 12 << 20
#: Hashes that one counting task group should hold.
GROUP_HASHES = 1 << 18

#: Columns that name a row: its file's hash and its number in the file.
FILE, ROW = "__block_file", "__block_row"

_MAIL = pa.schema([("bucket", pa.int32()), ("part", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("many", pa.binary())])
_MAIL_SQL = "bucket int, part string, low bigint, high bigint, keys binary, checks binary, many binary"
_ANSWER = pa.schema([("part", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("counts", pa.binary())])
_ANSWER_SQL = "part string, low bigint, high bigint, bucket int, keys binary, checks binary, counts binary"


class Block(NamedTuple):
    """Rows ``low`` to ``high`` of a file, both included, in its stretch ``part``."""

    file: int
    part: str
    low: int
    high: int


def stable(docs: DataFrame) -> DataFrame:
    """A copy that is a plain scan, so that its rows can be named."""
    return common.settle(docs, "docs")


def named(docs: DataFrame) -> DataFrame:
    """``docs``, a plain scan of Parquet files, with the names of its rows added."""
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def measure(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(log2 of the number of hash ranges for the words of this input, rows of a stretch of a file).

    A stretch holds three quarters of a block's bytes on average, so most are one block.
    """
    size, rows = docs.agg(F.sum(F.octet_length(common.text_of(column)) + 1), F.count(F.lit(1))).first()
    size, rows = size or 0, max(1, rows)
    return max(4, int(size // 6 // GROUP_HASHES).bit_length()), max(1, BLOCK_BYTES * 3 // 4 * rows // max(1, size))


def part_of(file: str, row: str, stretch: int) -> Column:
    """The stretch of a named row, as in :class:`Block`."""
    return F.concat_ws("-", F.hex(file), F.floor(F.col(row) / stretch).cast("string"))


def runs(batches: Iterator[pa.RecordBatch], stretch: int, column: str = "text") -> Iterator[tuple[Block, pa.Table]]:
    """Blocks of this task, as (name, rows without their names): cut by row, so batch sizes have no effect."""
    held, size, file, low, high = [], 0, 0, 0, -1

    def closed() -> tuple[Block, pa.Table]:
        name = Block(file, f"{file & 0xFFFFFFFFFFFFFFFF:X}-{low // stretch}", low, high)
        return name, pa.Table.from_batches(held).drop_columns([FILE, ROW])

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64) + 1
        files, rows = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in (FILE, ROW))
        new = (files[1:] != files[:-1]) | (rows[1:] != rows[:-1] + 1) | (rows[1:] % stretch == 0)
        for at, end in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]):
            row = int(rows[at])
            if held and (files[at] != file or row != high + 1 or row % stretch == 0):
                yield closed()
                held, size = [], 0
            file = int(files[at])
            while at < end:
                total = size + np.cumsum(lengths[at:end])
                to = min(at + int(np.searchsorted(total, BLOCK_BYTES)) + 1, end)
                low = low if held else int(rows[at])
                held.append(batch.slice(at, to - at))
                size, high = int(total[to - at - 1]), int(rows[to - 1])
                at = to
                if size >= BLOCK_BYTES:
                    yield closed()
                    held, size = [], 0
    if held:
        yield closed()


def one_column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).combine_chunks()
    if not isinstance(chunks, pa.ChunkedArray):
        return chunks
    return pa.concat_arrays(chunks.chunks) if chunks.num_chunks else pa.array([], chunks.type)


def distinct(keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Sorted distinct (key, check) pairs and how often each occurs."""
    if checks is None:
        keys = np.sort(keys)
    else:
        order = np.lexsort((checks, keys))
        keys, checks = keys[order], checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if checks is not None:
        new[1:] |= checks[1:] != checks[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    return keys[first], None if checks is None else checks[first], counts


def post(docs: DataFrame, hashes: Callable, bits: int, stretch: int, short: bool, with_counts: bool, label: str, state: str | None = None) -> str:
    """Count hashes of ``docs``, whose rows are named, and return the path of the answers.

    ``hashes(block, rows, answers)`` gives (uint64 keys, uint64 checks or None), where
    ``answers`` are the block's answers of the earlier exchange ``state``. ``short`` sends 32
    bits below the range's own, enough for statistics; else all 64, and the checks, of which
    both have to be equal to count as one.
    """
    spark = docs.sparkSession
    common.ship(spark)

    def send(batches):
        for block, rows in runs(batches, stretch):
            keys, checks = hashes(block, rows, receive(state, block, bits) if state else None)
            keys, checks, counts = distinct(keys, checks)
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            packed = (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32) if short else keys
            for at in range(0, len(some), 4096):
                out = []
                for b in some[at : at + 4096].tolist():
                    lo, hi = cuts[b], cuts[b + 1]
                    many = np.flatnonzero(counts[lo:hi] > 1)
                    more = np.concatenate([many, counts[lo:hi][many]]).astype(np.uint32) if len(many) else many.astype(np.uint32)
                    out.append((b, packed[lo:hi].tobytes(), None if checks is None else checks[lo:hi].tobytes(), more.tobytes()))
                bucket, k, c, m = zip(*out, strict=True)
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([block.part] * n, pa.string()), pa.array([block.low] * n, pa.int64()), pa.array([block.high] * n, pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary()), pa.array(m, pa.binary())], schema=_MAIL)

    width = np.uint32 if short else np.uint64

    def count(group: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x.as_py(), width) for x in group.column("keys")]
        owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        keys = np.concatenate(raw)
        counts = np.ones(len(keys), np.int64)
        at = 0
        for x, more in zip(raw, group.column("many"), strict=True):
            m = np.frombuffer(more.as_py(), np.uint32)
            half = len(m) // 2
            counts[at + m[:half].astype(np.int64)] = m[half:]
            at += len(x)
        if group.column("checks")[0].as_py() is not None:
            checks = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("checks")])
            order = np.lexsort((checks, keys))
            new = np.ones(len(keys), bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
        else:
            checks, order = None, np.argsort(keys, kind="stable")
            new = np.ones(len(keys), bool)
            new[1:] = keys[order][1:] != keys[order][:-1]
        entry = np.cumsum(new) - 1
        total = np.bincount(entry, weights=counts[order]).astype(np.int64)
        again = np.zeros(len(keys), bool)
        again[order] = total[entry] > 1
        each = np.zeros(len(keys), np.uint32)
        each[order] = np.minimum(total[entry], 2**32 - 1)
        cuts = np.searchsorted(owner[again], np.arange(len(raw) + 1))
        keys, each, checks = keys[again], each[again], None if checks is None else checks[again]
        some = np.flatnonzero(np.diff(cuts)).tolist()
        return pa.Table.from_arrays([
            group.column("part").take(pa.array(some, pa.int64())),
            group.column("low").take(pa.array(some, pa.int64())),
            group.column("high").take(pa.array(some, pa.int64())),
            group.column("bucket").take(pa.array(some, pa.int64())),
            pa.array([keys[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
            pa.array([None if checks is None else checks[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
            pa.array([each[cuts[i] : cuts[i + 1]].tobytes() if with_counts else None for i in some], pa.binary()),
        ], schema=_ANSWER)

    path = common.scratch(spark, label)
    mail = docs.mapInArrow(common.tidy(send), _MAIL_SQL)
    answers = mail.groupBy("bucket").applyInArrow(common.tidy_group(count), _ANSWER_SQL)
    answers.repartition("part").write.partitionBy("part").parquet(path)
    return path


def _parts(path: str, part: str) -> tuple:
    from pyarrow import fs

    files, root = common.open_fs(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/part={part}" if part else root, allow_not_found=True))
    return files, [x.path for x in found if x.path.endswith(".parquet") or not part and "part=" in x.base_name]


def any_answer(path: str) -> bool:
    """Whether anything occurs twice at all."""
    return bool(_parts(path, "")[1])


class Answers(NamedTuple):
    """Sorted distinct hashes that occur elsewhere too, or again in the block."""

    keys: np.ndarray
    checks: np.ndarray | None
    counts: np.ndarray | None

    def holds(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Which of the given hashes are among them."""
        if checks is None or self.checks is None or not len(self.keys):
            return member(keys, self.keys)
        at, found = np.searchsorted(self.keys, keys), np.zeros(len(keys), bool)
        todo = np.arange(len(keys))
        # One round, but for different checks under one key.
        while len(todo):
            todo = todo[at[todo] < len(self.keys)]
            todo = todo[self.keys[at[todo]] == keys[todo]]
            hit = self.checks[at[todo]] == checks[todo]
            found[todo[hit]] = True
            todo = todo[~hit]
            at[todo] += 1
        return found


def receive(path: str, block: Block, bits: int, short: bool = False) -> Answers:
    """What the exchange answered for the block's rows.

    All such hashes of its rows are among them, whatever blocks the sending pass had.
    """
    import pyarrow.parquet as pq

    files, found = _parts(path, block.part)
    keys, checks, counts = [], [], []
    for name in found:
        with files.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(256, columns=["low", "high", "bucket", "keys", "checks", "counts"]):
                for low, high, bucket, k, other, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if low <= block.high and high >= block.low:
                        x = np.frombuffer(k, np.uint32 if short else np.uint64)
                        if short:
                            x = (np.uint64(bucket) << np.uint64(64 - bits)) | (x.astype(np.uint64) << np.uint64(32 - bits))
                        keys.append(x)
                        if other is not None:
                            checks.append(np.frombuffer(other, np.uint64))
                        if c is not None:
                            counts.append(np.frombuffer(c, np.uint32))
    if not keys:
        return Answers(np.zeros(0, np.uint64), None, np.zeros(0, np.uint32))
    if checks:
        out, other, _ = distinct(np.concatenate(keys), np.concatenate(checks))
        return Answers(out, other, None)
    out, first = np.unique(np.concatenate(keys), return_index=True)
    return Answers(out, None, np.concatenate(counts)[first] if counts else None)


def short_key(h: np.ndarray, bits: int) -> np.ndarray:
    """What a hash is cut to in a ``short`` exchange."""
    return h & (np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(32 - bits))


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values
