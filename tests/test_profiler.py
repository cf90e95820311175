import datetime as dt
import json
import math
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import colsonde as C
from colsonde import vocabulary as V
from colsonde.functions import families
from colsonde.operators import registers as R
from colsonde.profile_queries import QUERIES

CONFIG = C.AdaptiveCardinalityConfig


def test_intake(spark):
    df = spark.range(3)
    identity = C.identify_backend(df)
    assert (identity.name, identity.connection_mode, identity.evaluation_mode) == ("pyspark", "spark_classic", "lazy")
    assert json.loads(json.dumps(identity.as_dict()))["frame_kind"] == "dataframe"
    item = C.resolve_dataframe_input(df)
    assert "range" not in repr(item) and item != C.resolve_dataframe_input(df)
    assert C.identify_backend(type("Mine", (pd.DataFrame,), {})()).name == "pandas"
    with pytest.raises(C.MissingDataFrameError):
        C.identify_backend(None)
    with pytest.raises(TypeError):
        C.identify_backend([1])

    class Twin:
        name = "twin"

        def detect(self, x):
            return identity

    class Broken:
        name = "broken"

        def detect(self, x):
            raise OSError("no")

    with pytest.raises(C.AmbiguousBackendError):
        C.DEFAULT_BACKEND_REGISTRY.with_detector(Twin()).identify(df)
    with pytest.raises(C.BackendDetectorError) as caught:
        C.BackendRegistry([Broken()]).identify(df)
    assert isinstance(caught.value.__cause__, OSError)
    with pytest.raises(C.DuplicateDetectorNameError):
        C.BackendRegistry([Twin(), Twin()])


def test_schema(spark):
    df = spark.createDataFrame([(1, "a", [1])], "id bigint not null, s string, l array<int>")
    schema = C.discover_physical_schema(df)
    assert schema.shape == (None, 3) and schema.dimensions.row_count_source == "not_computed"
    assert [(c.column_name, c.dtype, c.nullable) for c in schema.columns] == [("id", "bigint", False), ("s", "string", True), ("l", "array<int>", True)]
    assert C.discover_physical_schema(df, row_count_mode=C.RowCountMode.EXACT).dimensions.row_count == 1
    stream = spark.readStream.format("rate").load()
    assert C.discover_physical_schema(stream, row_count_mode=C.RowCountMode.EXACT).dimensions.row_count_source == "unbounded"
    twice = pd.DataFrame([[1, 2]], columns=["x", "x"])
    assert C.discover_physical_schema(twice).shape == (1, 2)
    with pytest.raises(ValueError):
        C.DataFrameDimensions(None, 1, C.RowCountSource.EXECUTED_QUERY)
    with pytest.raises(TypeError):
        C.discover_physical_schema_from_input(df)
    with pytest.raises(C.UnsupportedSchemaDiscoveryBackendError):
        C.discover_physical_schema(df, schema_registry=C.PhysicalSchemaRegistry())
    assert schema.as_frame(spark).count() == 3


def test_families():
    cases = {
        T.BooleanType(): "boolean", T.ByteType(): "integer", T.LongType(): "integer", T.FloatType(): "floating", T.DecimalType(9, 2): "decimal", T.StringType(): "string",
        T.BinaryType(): "binary", T.DateType(): "date", T.TimestampType(): "timestamp", T.TimestampNTZType(): "timestamp_ntz", T.DayTimeIntervalType(): "daytime_interval",
        T.YearMonthIntervalType(): "yearmonth_interval", T.NullType(): "null", T.ArrayType(T.LongType()): "nested", T.StructType(): "nested", T.VariantType(): "other",
        T.StringType("UTF8_LCASE"): "other",
    }
    assert {k: C.family_of(k).value for k in cases} == cases


def test_null_nan_and_zero(spark):
    rows = [(1.0,), (float("nan"),), (None,), (2.0,), (-0.0,), (0.0,)]
    for kind in ("double", "float"):
        r = C.profile_cardinality(spark.createDataFrame(rows, f"x {kind}"), "x")
        assert (r.distinct_count, r.total_row_count, r.null_count, r.is_exact) == (3, 6, 2, True)


def test_every_countable_type(spark):
    df = spark.sql("""SELECT * FROM VALUES (true, 1, 1.50, 'a', X'01', DATE'2020-01-01', INTERVAL '1' DAY, INTERVAL '1' YEAR, NULL),
      (false, 2, 1.5, 'b', X'02', DATE'2020-01-01', INTERVAL '2' DAY, INTERVAL '12' MONTH, NULL), (NULL, 2, NULL, 'é', X'02', NULL, NULL, NULL, NULL) AS t(b, i, d, s, x, a, l, y, n)""")
    report = C.profile_cardinality(df)
    assert [c.result.distinct_count for c in report.columns] == [2, 2, 1, 3, 2, 1, 2, 1, 0]


def test_promotion_and_error(spark):
    df = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("few"))
    report = C.profile_cardinality(df, config=CONFIG(exact_unique_threshold=100))
    k, few = (c.result for c in report.columns)
    assert not k.is_exact and abs(k.distinct_count - 100_000) < 5_000 and k.promotion.reason == "exact_unique_threshold"
    assert few.is_exact and few.distinct_count == 10
    assert k.as_dict()["output"]["relative_standard_error"] == 0.008125
    low, high = k.bounds()
    assert low < k.distinct_count < high
    text = spark.range(20).select(F.repeat(F.col("id").cast("string"), 50).alias("s"))
    memory = C.profile_cardinality(text, "s", config=CONFIG(exact_memory_budget_bytes=300))
    assert memory.promotion.reason == "exact_memory_budget"
    both = C.profile_cardinality(text, "s", config=CONFIG(exact_memory_budget_bytes=300, exact_unique_threshold=2))
    assert both.promotion.reason == "exact_unique_threshold_and_memory_budget"
    kept = C.profile_cardinality(text, "s", config=CONFIG(exact_memory_budget_bytes=300, keep_exact=True))
    assert kept.is_exact and kept.distinct_count == 20
    boundary = C.profile_cardinality(spark.range(100), "id", config=CONFIG(exact_unique_threshold=100))
    assert boundary.is_exact
    over = C.profile_cardinality(spark.range(101), "id", config=CONFIG(exact_unique_threshold=100))
    assert not over.is_exact and over.promotion.unique_count == 101


def test_isolation_and_columns(spark):
    df = spark.createDataFrame([(1, [1]), (1, None), (2, [2])], "id bigint, nested array<bigint>")
    report = C.profile_cardinality(df)
    assert [c.status for c in report.columns] == ["ok", "unsupported"] and report.total_row_count == 3
    assert report.unsupported_column_count == 1 and len(report.warnings) == 1
    with pytest.raises(C.UnsupportedCardinalityDtypeError) as caught:
        C.profile_cardinality(df, "nested")
    assert caught.value.as_dict()["context"]["dtype_family"] == "nested"
    nothing = C.profile_cardinality(df.select("nested"))
    assert (nothing.total_row_count, nothing.successful_column_count) == (3, 0)
    with pytest.raises(KeyError):
        C.profile_cardinality(df, "absent")
    with pytest.raises(TypeError):
        C.profile_cardinality(df, 3)
    twins = df.select(F.col("id"), F.col("id"))
    with pytest.raises(ValueError):
        C.profile_cardinality(twins, "id")
    assert [c.result.distinct_count for c in C.profile_cardinality(twins).columns] == [2, 2]
    odd = spark.createDataFrame([(1,)], ["a`b.c"])
    assert C.profile_cardinality(odd, "a`b.c").distinct_count == 1
    assert C.profile_cardinality(spark.createDataFrame([], "x int"), "x").distinct_count == 0
    with pytest.raises(C.StreamingCardinalityError):
        C.profile_cardinality(spark.readStream.format("rate").load())
    with pytest.raises(C.UnsupportedCardinalityBackendError):
        C.profile_cardinality(df, cardinality_registry=C.CardinalityRegistry())
    for bad in (True, 1.5):
        with pytest.raises(TypeError):
            C.profile_cardinality(df, batch_size=bad)
    with pytest.raises(ValueError):
        C.profile_cardinality(df, batch_size=0)


def test_json(spark):
    text = C.profile_cardinality_json(spark.range(3), "id")
    found = json.loads(text)
    assert found["schema_version"] == "adaptive-cardinality-v6" and found["output"]["distinct_count"] == 3
    assert set(found) == {"schema_version", "algorithm_version", "output", "row_metrics", "parameters", "exact_state", "hll_state", "promotion", "warnings", "lineage"}
    assert json.loads(C.profile_cardinality_json(spark.range(3)))["schema_version"] == "dataframe-cardinality-v1"
    assert C.json_safe(b"abc") == {"type": "bytes", "length": 3}
    assert C.json_safe((1, float("inf"), object())) == [1, "inf", {"type": "builtins.object", "serialization": "omitted"}]


def test_pandas(spark):
    frame = pd.DataFrame({"i": pd.array([1, None, 1], "Int64"), "c": pd.Categorical(["x", "y", "x"]), "p": pd.period_range("2020-01", periods=3, freq="M")})
    frame["o"] = [1, True, "1"]
    frame["d"] = [Decimal("1.50"), Decimal("1.5"), None]
    frame["t"] = [dt.datetime(2020, 1, 1, tzinfo=dt.UTC), dt.datetime(2020, 1, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=1))), None]
    frame.insert(6, "i", [1.0, -0.0, 0.0], allow_duplicates=True)
    report = C.profile_cardinality(frame)
    assert [c.result.distinct_count for c in report.columns] == [1, 2, 3, 3, 1, 1, 2]
    assert report.columns[3].warnings[0].code == "scalar_canonicalization_fallback"
    with pytest.raises(C.UnsupportedCardinalityValueError):
        C.profile_cardinality(pd.DataFrame({"o": [{}, 1]}))


def test_configuration():
    for bad in ({"exact_unique_threshold": 0}, {"hll_precision": 3}, {"memory_safety_factor": 0.5}, {"policy": "x"}):
        with pytest.raises(ValueError):
            CONFIG(**bad)
    with pytest.raises(TypeError):
        CONFIG(exact_unique_threshold=True)
    bound = C.HashConfiguration(seed=5).bind("k")
    assert bound.bind("k") == bound
    with pytest.raises(ValueError):
        bound.bind("other")
    with pytest.raises(ValueError):
        C.HashConfiguration(kernel_id="k")


def python_registers(hashes, p):
    out = {}
    for h in hashes:
        h &= (1 << 64) - 1
        rest = h & ((1 << (64 - p)) - 1)
        out[h >> (64 - p)] = max(out.get(h >> (64 - p), 0), 64 - p - rest.bit_length() + 1)
    return out


@pytest.mark.parametrize("p", [4, 10, 14, 20])
def test_registers_equal_a_second_implementation(spark, p):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    want = python_registers([r.h for r in df.collect()], p)
    assert {r.register: r["rank"] for r in R.registers(df, F.col("h"), p).collect()} == want
    m, zero = 1 << p, (1 << p) - len(want)
    raw = R.alpha(p) * m * m / (sum(2.0**-x for x in want.values()) + zero)
    expected = m * math.log(m / zero) if raw <= 2.5 * m and zero else raw
    assert math.isclose(R.estimated(R.registers(df, F.col("h"), p), p).first().estimate, expected, rel_tol=1e-12)


def test_accuracy(spark):
    for n in (1, 10, 1000, 100_000):
        assert abs(R.nunique(spark.range(n), "id") - n) <= max(1, 2 * R.relative_standard_error(14) * n)
    assert R.estimated(R.registers(spark.range(0), F.xxhash64("id"))).first().estimate == 0


def test_merge_laws_and_store(spark, tmp_path):
    a, b = (R.Sketch.of(spark.range(lo, hi), "id", 12) for lo, hi in ((0, 20_000), (10_000, 30_000)))
    whole = R.Sketch.of(spark.range(30_000), "id", 12)
    rows = lambda s: sorted(map(tuple, s.table.collect()))
    assert rows(a.merge(b)) == rows(b.merge(a)) == rows(whole) == rows(whole.merge(whole))
    with pytest.raises(ValueError):
        a.merge(R.Sketch.of(spark.range(5), "id", 10))
    with pytest.raises(ValueError):
        a.merge(R.Sketch.of(spark.range(5).select(F.col("id").cast("int").alias("id")), "id", 12))
    path = str(tmp_path / "sketches")
    a.write(path, "id")
    b.write(path, "id")
    back = R.Sketch.read(spark, path, "id")
    assert rows(back) == rows(whole) and back.contract == whole.contract


def test_promotion_position(spark):
    df = spark.createDataFrame([(0, None), (1, 1), (2, None), (3, 2), (4, 3), (5, 4)], "at int, v bigint")
    r = C.promotion_position(df, "v", ["at"], CONFIG(exact_unique_threshold=2)).first()
    assert (r.row_position, r.non_null_position, r.unique_count) == (4, 3, 3)
    assert C.promotion_position(df, "v", ["at"]).collect() == []


def test_streaming_sketch(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1, 0, k % 50), k % 7) for k in range(200)]
    spark.createDataFrame(rows, "ts timestamp, u bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, u bigint").parquet(str(tmp_path / "in"))
    out = C.windowed_registers(stream, "u", "ts", "1 hour", "10 minutes", 10)
    query = out.writeStream.outputMode("complete").format("memory").queryName("sketches").start()
    query.processAllAvailable()
    query.stop()
    assert round(R.estimated(spark.table("sketches"), 10, ["window"]).first().estimate) == 7


def test_reports_bind_the_contract_and_state_what_ran(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("a.b`c"))
    report = C.profile_cardinality(df, config=CONFIG(exact_unique_threshold=100, hash_configuration=C.portable()))
    for c in report.columns:
        found = c.result.config.hash_configuration
        assert found.kernel_id == C.Kernel.of(df.schema[c.position].dataType).kernel_id and found.runtime_id == "pyspark"
        assert c.result.config.hash_configuration == R.Sketch.of(df, c.column, 14, C.portable()).contract
        assert c.result.lineage["hash_execution"] == "md5_expression_distributed"
        assert c.result.execution_parameters["exact_state_source"] == "modelled_from_routing_sketch"
        assert c.result.lineage["adaptive_strategy"] == "routed_by_sketch_then_exact_or_hll"
    only = C.profile_cardinality(df, "id", config=CONFIG(policy="hll_only"))
    assert only.lineage["adaptive_strategy"] == "hll_only" and only.lineage["hash_execution"] == "xxhash64_expression_distributed" and not only.is_exact
    assert C.profile_cardinality(df, "id").execution_parameters["exact_state_source"] == "observed"
    assert C.promotion_position(df, "a.b`c", ["a.b`c"], CONFIG(exact_unique_threshold=2)).first().unique_count == 3


def test_identifiers_of_contracts():
    for name in ("algorithm_id", "engine_id", "canonicalisation_version"):
        with pytest.raises(ValueError):
            C.HashConfiguration(**{name: " "})
        with pytest.raises(TypeError):
            C.HashConfiguration(**{name: None})
    with pytest.raises(ValueError):
        C.HashConfiguration(kernel_id="", runtime_id="r", runtime_version="1")
    bound = C.HashConfiguration(seed=3).bind("k")
    assert bound.unbound() == C.HashConfiguration(seed=3)


def test_states_of_either_kind_merge(spark):
    a, b = spark.range(60), spark.range(40, 120)
    rows = lambda s: sorted(map(tuple, s.table.collect()))
    whole = R.Sketch.of(spark.range(120), "id", 12)
    exact = R.merge_states(a, b, "id", 120)
    assert sorted(r.id for r in exact.collect()) == list(range(120))
    assert rows(R.merge_states(a, b, "id", 119, 12)) == rows(whole)
    sketch = R.Sketch.of(a, "id", 12)
    for left, right in ((sketch, b), (b, sketch), (sketch, R.Sketch.of(b, "id", 12))):
        assert rows(R.merge_states(left, right, "id", 10)) == rows(whole)
    assert R.Sketch.of(spark.range(0), "id").is_empty() and not sketch.is_empty()


def test_ordered_positions_and_telemetry(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, 1, "a"), (2, None, "a"), (3, 2, "a"), (4, 3, "a"), (5, 4, None)], "at int, v bigint, w string")
    config = CONFIG(exact_unique_threshold=2)
    report = C.profile_cardinality(df, config=config, order_by=["at"])
    at = {c.column: c.result.promotion for c in report.columns}
    assert (at["v"].row_position, at["v"].non_null_position, at["v"].unique_count) == (4, 3, 3)
    assert (at["at"].row_position, at["at"].non_null_position) == (2, 3) and not at["w"].occurred
    assert C.profile_cardinality(df, "v", config=config).promotion.row_position is None
    with pytest.raises(KeyError):
        C.profile_cardinality(df, "v", order_by=["none"])
    told = report.telemetry()
    assert (told["profiled_columns"], told["promotion_reasons"], told["sketch_bytes"]) == (3, {"exact_unique_threshold": 2}, 2 << 14)
    nested = spark.createDataFrame([([1],)], "x array<int>")
    assert C.profile_cardinality(nested).telemetry()["exact_completion_rate"] is None


def test_tagged_values(spark):
    df = spark.sql("SELECT 1 AS i, '1' AS s, CAST(NULL AS int) AS n")
    tagged = families.tagged
    row = df.select(tagged(V.DtypeFamily.INTEGER, F.col("i")).alias("i"), tagged(V.DtypeFamily.STRING, F.col("s")).alias("s"), tagged(V.DtypeFamily.INTEGER, F.col("n")).alias("n")).first()
    assert bytes(row.i) == b"integer:1" and bytes(row.s) == b"string:1" and row.n is None


def test_exact_states_stay_exact_beyond_the_threshold(spark):
    a, b = spark.range(60), spark.range(40, 120)
    exact = R.merge_states(a, b, "id", 10, policy="exact_only")
    assert sorted(r.id for r in exact.collect()) == list(range(120))
    with pytest.raises(ValueError):
        R.merge_states(R.Sketch.of(a, "id", 12), b, "id", 10, policy="exact_only")
    with pytest.raises(ValueError):
        R.merge_states(a, b, "id", 10, policy="exact")


def test_merged_exact_states_are_all_values(spark, tmp_path):
    spark.range(50_010).selectExpr("id AS l_suppkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["exact_states_merged"](spark, str(tmp_path))
    assert found.columns == ["l_suppkey"] and sorted(r.l_suppkey for r in found.collect()) == list(range(50_010))


def test_promotion_position_among_ties(spark):
    """Rows that tie come by value, those without one last, whatever order they are read in."""
    rows = [(0, 7), (1, 9), (1, 7), (1, None), (1, 9), (1, 8), (1, 8), (2, 5)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "at int, v bigint").repartition(3)
        for threshold, want in ((1, (2, 3, 2)), (2, (4, 5, 3)), (3, (7, 7, 4))):
            r = C.promotion_position(df, "v", ["at"], CONFIG(exact_unique_threshold=threshold)).collect()
            assert [(x.row_position, x.non_null_position, x.unique_count) for x in r] == [want]
    texts = spark.createDataFrame([(0, "aaaa"), (0, "b"), (0, "b"), (0, "cc")], "at int, v string").repartition(4)
    r = C.promotion_position(texts, "v", ["at"], CONFIG(exact_memory_budget_bytes=28, memory_safety_factor=1.0)).first()
    assert (r.row_position, r.unique_count, r.state_bytes, r.reason) == (1, 2, 53, "exact_memory_budget")
    r = C.promotion_position(texts, "v", ["at"], CONFIG(exact_memory_budget_bytes=1)).first()
    assert (r.row_position, r.non_null_position, r.unique_count) == (0, 1, 1)


def _tied_lineitem(spark, folder):
    """Orders of two lines of one number each, whose parts are all different: the 101st part is in row 100 in any order of ties."""
    spark.range(300).selectExpr("id DIV 2 AS l_orderkey", "id AS l_partkey", "1 AS l_linenumber").write.parquet(f"{folder}/lineitem.parquet")
    return (100, 101, 101, 4040, "exact_unique_threshold")


def test_promotion_position_query_among_ties(spark, tmp_path):
    want = _tied_lineitem(spark, tmp_path)
    assert [tuple(r) for r in QUERIES["promotion_position_ordered"](spark, str(tmp_path)).collect()] == [want]


def test_promotion_telemetry_among_ties(spark, tmp_path):
    want = _tied_lineitem(spark, tmp_path)
    assert [tuple(r) for r in QUERIES["promotion_telemetry_ordered"](spark, str(tmp_path)).collect()] == [want]
    tied = spark.createDataFrame([(1, 5, 3), (1, 6, 3), (2, 7, 3), (2, 8, 3)], "at int, v bigint, w bigint")
    report = C.profile_cardinality(tied, config=CONFIG(exact_unique_threshold=2), order_by=["at"])
    at = {c.column: c.result.promotion for c in report.columns}
    assert (at["v"].row_position, at["v"].non_null_position, at["v"].unique_count) == (2, 3, 3) and not at["w"].occurred


def test_isolation_query_counts_exactly_beyond_the_threshold(spark, tmp_path):
    spark.range(60_000).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT)) AS embedding", "CAST(id % 10 AS INT) AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["unsupported_isolation_embeddings"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("vec_id", "ok", 60_000, 60_000), ("embedding", "unsupported", 60_000, None), ("label", "ok", 60_000, 10)]


@pytest.mark.parametrize("query", ["promotion_position_ordered", "promotion_telemetry_ordered"])
def test_promotion_queries_take_ties_as_stored(spark, tmp_path, query):
    """Two files hold the same orders, each of three tied lines, parts falling: the 101st part is the second line of order 33 in the first file."""
    rows = spark.range(0, 600, 1, 2).selectExpr("id % 300 DIV 3 AS l_orderkey", "300 - id % 300 AS l_partkey", "1 AS l_linenumber")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES[query](spark, str(tmp_path)).collect()] == [(199, 200, 101, 4040, "exact_unique_threshold")]
