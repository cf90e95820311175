import random

import pyarrow as pa
import pytest

from colsonde.llm import blocks, ngram_join, span_dedup

OPTIONS = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
#: One partition for all files, one for each, one for each row group or so: what fewer or more cores do.
LAYOUTS = [("128m", "4m", "1"), ("1m", "1m", "8"), ("8k", "1", "64")]


def layout(spark, i):
    for key, value in zip(OPTIONS, LAYOUTS[i % 3], strict=True):
        spark.conf.set(key, value)


@pytest.fixture
def moving(spark, monkeypatch):
    """Every exchange and every settled table leaves another split layout behind it."""
    step = [0]

    def then_move(f):
        def moved(*args, **more):
            out = f(*args, **more)
            step[0] += 1
            layout(spark, step[0])
            return out

        return moved

    layout(spark, 0)
    monkeypatch.setattr(blocks, "post", then_move(blocks.post))
    monkeypatch.setattr(ngram_join.common, "settle", then_move(ngram_join.common.settle))
    yield lambda i: layout(spark, i)
    for key in OPTIONS:
        spark.conf.unset(key)


@pytest.fixture
def docs(spark, tmp_path):
    """(rows, their table of three files of several row groups), with repeated passages and near copies."""
    g = random.Random(5)
    passages = [" ".join(g.choice("abcdefgh") + str(g.randrange(90)) for _ in range(80)) for _ in range(6)]
    texts = []
    for _ in range(900):
        own = " ".join("w%d" % g.randrange(10**6) for _ in range(g.randint(1, 60)))
        texts.append(f"{own} {g.choice(passages)}" if g.random() < 0.3 else own)
    for i in range(0, 200, 2):
        texts[899 - i] = texts[i] + " more"
    rows = list(enumerate(texts))
    path = str(tmp_path / "documents.parquet")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    frame.write.option("parquet.block.size", "8192").option("parquet.page.size.row.check.min", "50").parquet(path)
    return rows, spark.read.parquet(path)


def partitions(frame):
    return frame.rdd.getNumPartitions()


def test_layouts_differ(spark, docs, moving):
    counts = []
    for i in range(3):
        moving(i)
        counts.append(partitions(docs[1].select("doc_id")))
    assert counts[0] == 1 and counts[1] == 3 and counts[2] > 3


@pytest.mark.parametrize("last", [0, 1, 2])
def test_spans_under_changing_layouts(docs, moving, last):
    from test_span_dedup import brute

    rows, table = docs
    out = span_dedup.digest(table)
    moving(last)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 35)


def test_near_copies_under_changing_layouts(docs, moving):
    rows, table = docs
    sets = {i: {" ".join(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))} for i, t in rows}
    least = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    found = ngram_join.near_duplicates(table, is_scan=True)
    moving(2)
    assert {r.doc_id: r.component_id for r in found.collect()} == least
    kept = ngram_join.keep_one(table, is_scan=True)
    moving(1)
    assert sorted(map(tuple, kept.collect())) == [(i, t) for i, t in rows if least[i] == i]


def test_blocks_are_adjacent_rows_of_one_file():
    def batch(file, rows):
        return pa.record_batch({"text": ["x"] * len(rows), blocks.FILE: pa.array([file] * len(rows), pa.int64()), blocks.ROW: pa.array(rows, pa.int64())})

    # A file's tail, another file, a gap, and a stretch that ends within a batch.
    given = [batch(-1, [7, 8]), batch(-1, [9, 10, 11]), batch(3, [0, 1]), batch(3, [4, 5]), batch(3, [])]
    got = [(b.file, b.part, b.low, b.high, t.num_rows, t.column_names) for b, t in blocks.runs(iter(given), 10)]
    assert got == [
        (-1, "FFFFFFFFFFFFFFFF-0", 7, 9, 3, ["text"]), (-1, "FFFFFFFFFFFFFFFF-1", 10, 11, 2, ["text"]),
        (3, "3-0", 0, 1, 2, ["text"]), (3, "3-0", 4, 5, 2, ["text"]),
    ]
