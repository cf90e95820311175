import hashlib

import pytest

from colsonde.llm import common, warc

BODY = "x" * 150
ROWS = [
    (5, "http://a/1", BODY), (3, "http://a/2", BODY), (9, None, BODY), (None, "http://n", BODY),
    (1, "http://b\r\nX: y", "small"), (2, "http://b", "small"), (4, "u", None), (6, "u", ""),
    (7, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\nétç" * 9), (8, "u", "é" * 50), (10, "u", "é" * 50), (10, "u", "é" * 50), (11, "u", "é" * 49 + "a"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string")


def expected():
    out = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "").encode() == body and j is not None]
        again = len(body) >= 100 and i != min(same)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def test_contract(pages):
    assert sorted(map(tuple, warc.digest(pages).collect()), key=str) == expected()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip_and_pushdown(spark, pages, compression):
    path = common.scratch(spark, "test-warc")
    warc.archive(pages, path, compression=compression)
    back = spark.read.format("warc").load(path)
    got = sorted((r.page_id, bytes(r.payload)) for r in back.where("record_type = 'response' and page_id in ('3', '7', '4')").collect())
    assert got == [("3", BODY.encode()), ("4", b""), ("7", ROWS[8][2].encode())]
    assert back.where("record_type = 'revisit'").count() == 5
    assert back.where("page_id = '1'").first().target_uri == "http://b%0D%0AX: y"
    assert {r.payload for r in spark.read.format("warc").option("payload", "none").load(path).collect()} == {None}


def test_revisits_name_the_record_of_the_response(spark, pages):
    path = common.scratch(spark, "test-warc")
    warc.archive(pages, path)
    files, root = common.open_fs(path)
    by_page, found = {}, []
    for x in warc._listed(files, root):
        with files.open_input_file(x.path) as raw:
            reader = warc._Lines(raw)
            while (headers := warc.read_headers(reader)) is not None:
                warc._skip(reader, int(headers["content-length"]), True)
                by_page.setdefault(headers.get("x-page-id"), headers)
                found.append(headers)
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert len(revisits) == 5
    for h in revisits:
        first = by_page[h["x-refers-to-page"]]
        assert h["warc-refers-to"] == first["warc-record-id"] and h["warc-refers-to-target-uri"] == first["warc-target-uri"]


def test_files_of_lost_attempts_are_removed(tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)}, False)
    row = {"page_id": "1", "url": None, "payload": b"x", "payload_digest": "d", "payload_length": 1, "record_type": "response", "refers_to": None, "refers_url": None}
    batch = warc.pa.RecordBatch.from_pylist([row])
    kept, _lost = writer.write(iter([batch])), writer.write(iter([batch]))
    (tmp_path / "_other-1.warc").write_bytes(b"")
    writer.commit([kept, None])
    assert sorted(x.name for x in tmp_path.iterdir()) == sorted(["_other-1.warc", *kept.names])
    aborted = warc.WarcWriter({"path": str(tmp_path)}, False)
    aborted.write(iter([batch]))
    aborted.abort([])
    assert len(list(tmp_path.iterdir())) == 2


def test_rejected_payloads_are_not_read():
    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_length",), 3)]))
    assert [f.attribute for f in left] == [("payload_length",)]
    assert reader.wanted == {"record_type": {"response"}}


def test_empty(spark):
    assert warc.digest(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
