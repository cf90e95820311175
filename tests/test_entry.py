import __spark_entry__ as repo


def test_entry_and_registry(spark):
    df = repo.entry(spark)
    assert df.count() > 0
    queries, oracles = repo.queries(), repo.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(callable(q) for q in queries.values())
