import pyarrow as pa

from colsonde.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    docs = spark.range(0, 2000, 1, 1).selectExpr("repeat('word ', 1000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    spark.conf.unset(KEY)
    common.small_batches(spark)
    found = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 10_000_000 and max(found) <= 2 * common.BATCH_BYTES
    spark.conf.set(KEY, "5m")
    common.small_batches(spark)
    assert spark.conf.get(KEY) == "5m"
    spark.conf.unset(KEY)
