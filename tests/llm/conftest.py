import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """A table of documents, as Parquet, from (doc_id, text) pairs."""

    def make(rows, schema=DOC_SCHEMA, files=2):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows] if schema == DOC_SCHEMA else rows
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(full, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
