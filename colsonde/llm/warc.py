"""WARC archives as a Spark data source, and archiving of pages with revisit records."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from colsonde.llm import common

#: Bytes at which a writer begins another file, and of files that one reading task gets.
FILE_BYTES = 32 << 20
#: Payload bytes sent to Spark at a time.
BATCH_BYTES = 4 << 20

SCHEMA = (
    "record_type string, record_id string, date string, target_uri string, page_id string, refers_to string, "
    "content_type string, payload_digest string, payload_length bigint, payload binary"
)
_ARROW = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in SCHEMA.split(", "))])

# The header of each column that can be judged before a payload is read.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "page_id": "X-Page-ID",
    "refers_to": "X-Refers-To-Page",
    "content_type": "Content-Type",
}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: str) -> str:
    """A header value on one line: CR, LF and NUL are percent-encoded, nothing else changes."""
    return value.replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00")


def _record_id(page_id: str | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def record_bytes(row: dict, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without one, which names the response."""
    payload = row["payload"] or b""
    response = row["record_type"] != "revisit"
    block = _HTTP + (payload if response else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {date}"]
    lines.append(f"WARC-Record-ID: {_record_id(row['page_id'], row['url'], row['payload_digest'])}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    lines.append(f"X-Payload-Length: {row['payload_length']}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {_clean(row['page_id'])}")
    if not response:
        lines.append(f"WARC-Profile: {_REVISIT}")
        lines.append(f"WARC-Refers-To: {_record_id(row['refers_to'], row['refers_url'], row['payload_digest'])}")
        if row["refers_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(row['refers_url'])}")
        lines.append(f"X-Refers-To-Page: {_clean(row['refers_to'])}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_headers(stream) -> dict[str, str] | None:
    """The header lines of the next record by lower-case name, or None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:60]!r}")
    out: dict[str, str] = {}
    last = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _skip(stream, n: int, seekable: bool) -> None:
    if seekable:
        stream.seek(n, io.SEEK_CUR)
    else:
        while n > 0 and (got := stream.read(min(n, 1 << 20))):
            n -= len(got)


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str]


@dataclass
class FilePartition(InputPartition):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own under names that only a commit makes final.

    Names start with the job's, so its end removes what lost attempts of its tasks left behind.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.job = uuid.uuid4().hex
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.gzip = options.get("compression", "none") == "gzip"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenFiles:
        files, root = common.open_fs(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in batches:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    if out is None:
                        name = f"{self.job}-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                        out, size = files.open_output_stream(f"{root}/_{name}", compression=None), 0
                        names.append(name)
                    record = record_bytes({n: c[i].as_py() for n, c in columns.items()}, self.date)
                    if self.gzip:
                        record = gzip.compress(record, 6, mtime=0)
                    out.write(record)
                    size += len(record)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(names)

    def commit(self, messages) -> None:
        files, root = common.open_fs(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for x in _listed(files, root):
                files.delete_file(x.path)
        for m in messages:
            for name in m.names if m else []:
                files.move(f"{root}/_{name}", f"{root}/{name}")
        self._sweep(files, root)

    def abort(self, messages) -> None:
        self._sweep(*common.open_fs(self.path))

    def _sweep(self, files, root: str) -> None:
        from pyarrow import fs

        for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.is_file and x.base_name.startswith(f"_{self.job}-"):
                files.delete_file(x.path)


def _listed(files, root: str) -> list:
    """Committed archives of a folder, or the one file named."""
    from pyarrow import fs

    if files.get_file_info(root).type.name == "File":
        return [files.get_file_info(root)]
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((x for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and x.base_name[0] not in "_."), key=lambda x: x.path)


class WarcReader(DataSourceReader):
    """Reads headers first; records that a pushed predicate rejects are skipped undecoded."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes")
        if self.payload not in ("bytes", "digest", "none"):
            raise ValueError("payload must be bytes, digest or none")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif not (column in HEADERS and isinstance(f, IsNotNull)):
                yield f
            else:
                self.wanted.setdefault(column + "?", set())

    def partitions(self):
        """Groups of whole files: a file is never split, as payloads may hold text of records."""
        files, root = common.open_fs(self.path)
        parts, names, size = [], [], 0
        for x in _listed(files, root):
            if names and size + x.size > FILE_BYTES:
                parts.append(FilePartition(names))
                names, size = [], 0
            names.append(x.path)
            size += x.size
        return [*parts, FilePartition(names)] if names or not parts else parts

    def _accepts(self, values: dict) -> bool:
        for column, wanted in self.wanted.items():
            if column.endswith("?"):
                if values[column[:-1]] is None:
                    return False
            elif values[column] not in wanted:
                return False
        return True

    def read(self, partition):
        files, _ = common.open_fs(self.path)
        rows, held = [], 0
        for name in partition.names:
            with files.open_input_file(name) as raw:
                packed = name.endswith(".gz")
                reader = gzip.GzipFile(fileobj=raw) if packed else _Lines(raw)
                while (headers := read_headers(reader)) is not None:
                    length = int(headers.get("content-length", "0"))
                    values = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                    if not self._accepts(values):
                        _skip(reader, length, not packed)
                        continue
                    row, size = self._row(reader, headers, values, length, packed)
                    rows.append(row)
                    held += size
                    if held >= BATCH_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _row(self, reader, headers: dict, values: dict, length: int, packed: bool) -> tuple[dict, int]:
        digest = headers.get("warc-payload-digest", "")
        declared = headers.get("x-payload-length")
        row = values | {"payload_digest": digest.partition(":")[2] or None, "payload_length": int(declared) if declared else None, "payload": None}
        if self.payload == "none" or values["record_type"] == "revisit":
            _skip(reader, length, not packed)
            return row, 256
        block = reader.read(length)
        if len(block) != length:
            raise ValueError("the archive ends within a record")
        payload = block.partition(b"\r\n\r\n")[2] if (values["content_type"] or "").startswith("application/http") else block
        row["payload_digest"], row["payload_length"] = hashlib.sha256(payload).hexdigest(), len(payload)
        if self.payload == "bytes":
            row["payload"] = payload
        return row, 256 + len(payload) * (self.payload == "bytes")


class _Lines:
    """Buffered reading with cheap relative seeks over an Arrow file."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.buffer, self.at = raw, size, b"", 0

    def _more(self) -> bool:
        got = self.raw.read(self.size)
        self.buffer, self.at = self.buffer[self.at :] + got, 0
        return bool(got)

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buffer) - 1
                break
        line, self.at = self.buffer[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        have = self.buffer[self.at : self.at + n]
        self.at += len(have)
        return have + self.raw.read(n - len(have)) if len(have) < n else have

    def seek(self, n: int, _whence: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
        else:
            self.raw.seek(n - have, io.SEEK_CUR)
            self.buffer, self.at = b"", 0


class WarcDataSource(DataSource):
    """``format("warc")``.

    Reading options: path; payload = bytes (default), digest (measured, not returned) or none
    (payloads are skipped). Predicates of equality on header columns are pushed down.
    Writing takes rows of (page_id, url, payload, payload_digest, payload_length, record_type,
    refers_to, refers_url), page_id and refers_to as strings; options: path, date, compression =
    none or gzip.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    common.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def plan_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Rows for the writer: which pages are responses and which revisit an equal payload.

    Of payloads of ``min_bytes`` or more that are equal, the smallest page_id is the response;
    all rows of that page_id if it repeats. A null html is an empty payload. A null page_id is
    above all others; if equal payloads have null ids only, all are responses.

    Groups are found from identifiers and digests alone, and revisits are joined to the payloads
    by page: where the list of revisits is too large to broadcast, payloads are spread by page_id,
    so a payload that very many pages share does not meet in one task.
    """
    rows = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    marks = common.settle(rows.where(F.col("payload_length") >= min_bytes).select("page_id", "url", "payload_digest"), "warc-marks")
    groups = marks.groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.where((F.col("n") > 1) & F.col("first").isNotNull())
    again = marks.join(groups.drop("n"), "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    again = again.groupBy(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest")).agg(F.first("first").alias("first"))
    joined = rows.join(common.settle(again, "warc-revisits"), F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return joined.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "payload_digest", "payload_length",
        F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        F.col("first.page_id").cast("string").alias("refers_to"), F.col("first.url").alias("refers_url"),
    )


def archive(pages: DataFrame, path: str, **options) -> None:
    """Write the records of ``pages`` to WARC files under ``path``."""
    register(pages.sparkSession)
    plan_records(pages).write.format("warc").options(**options).mode("append").save(path)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, read back from archives in the shared folder."""
    spark = pages.sparkSession
    path, kind = common.scratch(spark, "warc"), pages.schema["page_id"].dataType
    archive(pages, path)
    back = spark.read.format("warc").option("payload", "digest").load(path)
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""
