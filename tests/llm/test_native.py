from colsonde.llm import line_runs, quality_model, quality_rules, secret_links


def test_empty_tables_and_nulls(spark, make_docs):
    empty = make_docs([])
    for f in (line_runs.digest, quality_rules.digest, secret_links.digest):
        assert f(empty).collect() == []
    docs = make_docs([(None, None), (None, ""), (1, "line " * 12), (1, "line " * 12)])
    for f in (line_runs.digest, quality_rules.digest, secret_links.digest):
        assert f(docs).count() == 4
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality_model.digest(docs, labels).collect()} == {0.5}
