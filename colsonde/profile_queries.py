"""Registered queries of the profiler, and their SQL twins for another engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsonde.functions.families import family_of, tagged
from colsonde.functions.hashes import portable
from colsonde.operators import cardinality, registers
from colsonde.plans.report import AdaptiveCardinalityConfig
from colsonde.sources.schema import discover_physical_schema
from colsonde.streaming.sketches import windowed_registers
from colsonde.vocabulary import DtypeFamily, RowCountMode

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: Columns whose text is the same in every engine, so that md5 hashes are too.
PORTABLE = tuple(c for c in LINEITEM if c != "l_extendedprice")
#: The order of lines, in which many tie, and then that in which they are stored.
LINE_ORDER = ["l_orderkey", "l_linenumber", "file", "row"]
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
QUERIES, ORACLES = {}, {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _stored(df: DataFrame) -> DataFrame:
    """The frame with each row's place in its files, so that rows that tie can come as they are stored."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _union(template: str, values) -> str:
    return " UNION ALL ".join(template.format(x) for x in values)


def _md5_registers(column: str, table: str, p: int, more: str = "", where: str = "true") -> str:
    """(more, register, rank) of md5 hashes."""
    mask = (1 << (64 - p)) - 1
    return (
        f"SELECT {more} (h >> {64 - p})::INT AS register, max(CASE WHEN h & {mask}::UBIGINT = 0 THEN {65 - p} ELSE {65 - p} - length(bin(h & {mask}::UBIGINT)) END)::INT AS rank "
        f"FROM (SELECT *, ('0x' || substr(md5({column}::VARCHAR), 1, 16))::UBIGINT AS h FROM {table} WHERE {column} IS NOT NULL AND {where}) GROUP BY ALL"
    )


def _md5_estimate(source: str, p: int, more: str = "") -> str:
    """(more, zero_registers, branch, estimate rounded to 6 places)."""
    m = 1 << p
    return (
        f"SELECT {more} zero_registers, CASE WHEN raw <= {2.5 * m} AND zero_registers > 0 THEN 'linear' ELSE 'raw' END AS branch, "
        f"round(CASE WHEN raw <= {2.5 * m} AND zero_registers > 0 THEN {m} * ln({m}.0::DOUBLE / zero_registers) ELSE raw END, 6) AS estimate FROM ("
        f"SELECT {more} ({m} - count(*))::BIGINT AS zero_registers, {registers.alpha(p) * m * m!r} / (sum(pow(2.0, -rank)) + {m} - count(*)) AS raw FROM ({source}) GROUP BY ALL)"
    )


def _estimate(df: DataFrame, column: str, p: int = 14, by: list | None = None) -> DataFrame:
    h = portable().hash(F.col(column))
    out = registers.estimated(registers.registers(df, h, p, by), p, by)
    return out.select(*(by or []), "zero_registers", "branch", F.round("estimate", 6).alias("estimate"))


@_query(_union("SELECT {0[0]}::INT AS position, '{0[1]}' AS name, '{0[2]}' AS family", [(i, c, "timestamp_ntz" if c == "l_shipdate" else "string" if c in ("l_returnflag", "l_linestatus") else "integer" if i < 4 else "floating") for i, c in enumerate(LINEITEM)]))
def schema_columns_lineitem(spark, sf_dir):
    schema = discover_physical_schema(_read(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(c.position, c.column_name, family_of(c.native_dtype).value) for c in schema.columns], "position int, name string, family string")


@_query(_union("SELECT '{0}' AS table_name, count(*)::BIGINT AS row_count, 'executed_query' AS source FROM {0}", TABLES))
def row_count_exact(spark, sf_dir):
    rows = []
    for t in TABLES:
        d = discover_physical_schema(_read(spark, sf_dir, t), row_count_mode=RowCountMode.EXACT).dimensions
        rows.append((t, d.row_count, d.row_count_source.value))
    return spark.createDataFrame(rows, "table_name string, row_count bigint, source string")


_EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@_query(_union("SELECT '{0}' AS \"column\", count(*)::BIGINT AS row_count, count({0})::BIGINT AS non_null_count, (count(*) - count({0}))::BIGINT AS null_count, count(DISTINCT {0})::BIGINT AS distinct_count FROM events", _EVENTS))
def row_metrics_events(spark, sf_dir):
    report = cardinality.profile_cardinality(_read(spark, sf_dir, "events").select(*_EVENTS), config=AdaptiveCardinalityConfig(policy="exact_only"))
    return report.as_frame(spark).select("column", "row_count", "non_null_count", "null_count", "distinct_count")


@_query("""
WITH v AS (SELECT CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN -0.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE ELSE l_quantity END AS x FROM lineitem)
SELECT count(*)::BIGINT AS row_count, (count(x) FILTER (NOT isnan(x)))::BIGINT AS non_null_count, (count(*) - count(x) FILTER (NOT isnan(x)))::BIGINT AS null_count,
       (count(DISTINCT CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE x END) FILTER (NOT isnan(x)))::BIGINT AS distinct_count FROM v""")
def null_nan_zero_semantics(spark, sf_dir):
    n = F.col("l_linenumber")
    x = F.when(n == 1, F.lit(None)).when(n == 2, F.lit(float("nan"))).when(n == 3, F.lit(-0.0)).when(n == 4, F.lit(0.0)).otherwise(F.col("l_quantity"))
    report = cardinality.profile_cardinality(_read(spark, sf_dir, "lineitem").select(x.cast("double").alias("x")))
    return report.as_frame(spark).select("row_count", "non_null_count", "null_count", "distinct_count")


@_query(_union("SELECT '{0}' AS \"column\", count(DISTINCT {0})::BIGINT AS distinct_count, 'exact' AS mode FROM lineitem", LINEITEM))
def exact_distinct_lineitem(spark, sf_dir):
    config = AdaptiveCardinalityConfig(policy="exact_only")
    return cardinality.profile_cardinality(_read(spark, sf_dir, "lineitem"), config=config).as_frame(spark).select("column", "distinct_count", "mode")


@_query(_union("SELECT '{0}' AS \"column\", least(count(DISTINCT {0}), 101)::BIGINT AS unique_seen, count(DISTINCT {0}) > 100 AS promoted FROM lineitem", LINEITEM))
def bounded_distinct_threshold(spark, sf_dir):
    report = cardinality.profile_cardinality(_read(spark, sf_dir, "lineitem"), config=AdaptiveCardinalityConfig(exact_unique_threshold=100))
    rows = [(c.column, min(c.result.unique_seen, 101), c.result.promotion.occurred) for c in report.columns]
    return spark.createDataFrame(rows, "column string, unique_seen bigint, promoted boolean")


_NUMBERS = LINEITEM[:8]


@_query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN n > 1000 AND b > 1900 THEN 'exact_unique_threshold_and_memory_budget' WHEN n > 1000 THEN 'exact_unique_threshold'
  WHEN b > 1900 THEN 'exact_memory_budget' END AS reason FROM (SELECT count(DISTINCT {c}) AS n, ceil(least(count(DISTINCT {c}), 1001) * 32 * 1.25) AS b FROM lineitem)""" for c in _NUMBERS))
def promotion_reason(spark, sf_dir):
    config = AdaptiveCardinalityConfig(exact_unique_threshold=1000, exact_memory_budget_bytes=1900)
    report = cardinality.profile_cardinality(_read(spark, sf_dir, "lineitem").select(*_NUMBERS), config=config)
    rows = [(c.column, c.result.promotion.reason and c.result.promotion.reason.value) for c in report.columns]
    return spark.createDataFrame(rows, "column string, reason string")


@_query(_md5_registers("l_orderkey", "lineitem", 14))
def hll_registers_orderkey(spark, sf_dir):
    return registers.registers(_read(spark, sf_dir, "lineitem"), portable().hash(F.col("l_orderkey")))


def _register_estimates():
    for name, table, column, p in (
        ("hll_estimate_orderkey", "lineitem", "l_orderkey", 14), ("hll_estimate_custkey", "orders", "o_custkey", 14),
        ("hll_estimate_strings", "pages", "url", 12), ("hll_linear_counting_branch", "lineitem", "l_suppkey", 10),
    ):
        QUERIES[name] = lambda spark, sf_dir, table=table, column=column, p=p: _estimate(_read(spark, sf_dir, table), column, p)
        ORACLES[name] = _md5_estimate(_md5_registers(column, table, p), p)


_register_estimates()
_SWEEP = (4, 5, 6, 10, 12, 14)


@_query(" UNION ALL ".join(f"SELECT {p}::INT AS precision, {registers.relative_standard_error(p)!r}::DOUBLE AS rse, * FROM ({_md5_estimate(_md5_registers('l_orderkey', 'lineitem', p), p)})" for p in _SWEEP))
def hll_precision_sweep(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey")
    out = None
    for p in _SWEEP:
        one = _estimate(df, "l_orderkey", p).select(F.lit(p).alias("precision"), F.lit(registers.relative_standard_error(p)).alias("rse"), "zero_registers", "branch", "estimate")
        out = one if out is None else out.unionByName(one)
    return out


@_query(_md5_registers("l_partkey", "lineitem", 12))
def hll_merge_union(spark, sf_dir):
    df, contract = _read(spark, sf_dir, "lineitem"), portable()
    early, late = (registers.Sketch.of(df.where(c), "l_partkey", 12, contract) for c in ("l_linenumber <= 3", "l_linenumber >= 3"))
    return early.merge(late).table


@_query(_md5_registers("l_partkey", "lineitem", 12))
def hll_merge_exact_and_sketch(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem")
    sketch = registers.Sketch.of(df.where("l_linenumber <= 3"), "l_partkey", 12, portable())
    exact = df.where("l_linenumber >= 3").select("l_partkey").distinct()
    return registers.merge_states(exact, sketch, "l_partkey", 50_000).table


@_query("SELECT DISTINCT l_suppkey FROM lineitem")
def exact_states_merged(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem")
    early, late = (df.where(c).select("l_suppkey") for c in ("l_linenumber <= 3", "l_linenumber >= 3"))
    return registers.merge_states(early, late, "l_suppkey", 50_000, policy="exact_only")


@_query(_md5_estimate(_md5_registers("user_id", "events", 12, "date_trunc('week', ts)::DATE AS week,"), 12, "week,"))
def hll_rollup_events_daily(spark, sf_dir):
    df = _read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = registers.registers(df, portable().hash(F.col("user_id")), 12, ["day"])
    weekly = registers.merged(daily.withColumn("week", F.trunc("day", "week")), ["week"])
    return registers.estimated(weekly, 12, ["week"]).select("week", "zero_registers", "branch", F.round("estimate", 6).alias("estimate"))


def _adaptive(table: str, columns, threshold: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN n > {threshold} THEN 'hll' ELSE 'exact' END AS mode, CASE WHEN n > {threshold} THEN round_even(estimate, 0)::BIGINT ELSE n END AS distinct_count
        FROM (SELECT count(DISTINCT {c})::BIGINT AS n FROM {table}), ({_md5_estimate(_md5_registers(c, table, 14), 14)})"""
        for c in columns
    )


@_query(_adaptive("lineitem", PORTABLE, 5000))
def adaptive_profile_lineitem(spark, sf_dir):
    config = AdaptiveCardinalityConfig(exact_unique_threshold=5000, hash_configuration=portable())
    return cardinality.profile_cardinality(_read(spark, sf_dir, "lineitem").select(*PORTABLE), config=config).as_frame(spark).select("column", "mode", "distinct_count")


@_query(_adaptive("orders", ORDERS, 100))
def adaptive_profile_orders_forced(spark, sf_dir):
    config = AdaptiveCardinalityConfig(exact_unique_threshold=100, hash_configuration=portable())
    return cardinality.profile_cardinality(_read(spark, sf_dir, "orders").select(*ORDERS), config=config).as_frame(spark).select("column", "mode", "distinct_count")


@_query("""SELECT 'vec_id' AS "column", 'ok' AS status, count(*)::BIGINT AS row_count, count(DISTINCT vec_id)::BIGINT AS distinct_count FROM embeddings
UNION ALL SELECT 'embedding', 'unsupported', count(*)::BIGINT, NULL FROM embeddings UNION ALL SELECT 'label', 'ok', count(*)::BIGINT, count(DISTINCT label)::BIGINT FROM embeddings""")
def unsupported_isolation_embeddings(spark, sf_dir):
    config = AdaptiveCardinalityConfig(policy="exact_only")
    return cardinality.profile_cardinality(_read(spark, sf_dir, "embeddings"), config=config).as_frame(spark).select("column", "status", "row_count", "distinct_count")


@_query(_union("SELECT '{0}' AS \"column\", round(count(DISTINCT {0})::DOUBLE / count({0}), 9) AS distinct_ratio, round(1 - count(DISTINCT {0})::DOUBLE / count({0}), 9) AS duplicate_ratio FROM orders", ORDERS))
def distinct_and_duplicate_ratio(spark, sf_dir):
    report = cardinality.profile_cardinality(_read(spark, sf_dir, "orders").select(*ORDERS), config=AdaptiveCardinalityConfig(policy="exact_only"))
    rows = [(c.column, round(c.result.distinct_ratio, 9), round(c.result.duplicate_ratio, 9)) for c in report.columns]
    return spark.createDataFrame(rows, "column string, distinct_ratio double, duplicate_ratio double")


@_query(f"""SELECT round(abs(estimate - n) / n, 6) AS relative_error, abs(estimate - n) / n <= 4 * {registers.relative_standard_error(14)!r} AS within
FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem), ({_md5_estimate(_md5_registers("l_orderkey", "lineitem", 14), 14)})""")
def error_bounds(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem")
    n = df.agg(F.count_distinct("l_orderkey")).first()[0]
    error = F.abs(F.col("estimate") - n) / n
    return _estimate(df, "l_orderkey").select(F.round(error, 6).alias("relative_error"), (error <= 4 * registers.relative_standard_error(14)).alias("within"))


@_query("""
WITH o AS (SELECT l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem),
f AS (SELECT l_partkey, min(pos) AS pos FROM o GROUP BY 1), c AS (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM f)
SELECT min(pos)::BIGINT AS row_position, (min(pos) + 1)::BIGINT AS non_null_position, min(n)::BIGINT AS unique_count, ceil(min(n) * 32 * 1.25)::BIGINT AS state_bytes, 'exact_unique_threshold' AS reason FROM c WHERE n > 100""")
def promotion_position_ordered(spark, sf_dir):
    df = _stored(_read(spark, sf_dir, "lineitem"))
    return cardinality.promotion_position(df, "l_partkey", LINE_ORDER, AdaptiveCardinalityConfig(exact_unique_threshold=100))


@_query("SELECT 'embeddings' AS table_name, 3::BIGINT AS column_count, 2::BIGINT AS successful, 1::BIGINT AS unsupported, 1::BIGINT AS warnings UNION ALL SELECT 'orders', 6, 6, 0, 0")
def profile_report_summary(spark, sf_dir):
    rows = []
    for t in ("embeddings", "orders"):
        r = cardinality.profile_cardinality(_read(spark, sf_dir, t))
        rows.append((t, r.column_count, r.successful_column_count, r.unsupported_column_count, len(r.warnings)))
    return spark.createDataFrame(rows, "table_name string, column_count bigint, successful bigint, unsupported bigint, warnings bigint")


def _hll_only(columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'hll' AS mode, round_even(estimate, 0)::BIGINT AS distinct_count FROM ({_md5_estimate(_md5_registers(c, "orders", 12), 12)})""" for c in columns
    )


@_query(_hll_only(ORDERS))
def hll_only_profile_orders(spark, sf_dir):
    config = AdaptiveCardinalityConfig(policy="hll_only", hll_precision=12, hash_configuration=portable())
    return cardinality.profile_cardinality(_read(spark, sf_dir, "orders").select(*ORDERS), config=config).as_frame(spark).select("column", "mode", "distinct_count")


@_query("""SELECT 'o_custkey' AS "column", count(*)::BIGINT AS row_count, count(DISTINCT o_custkey)::BIGINT AS distinct_count FROM orders""")
def profile_one_column_orders(spark, sf_dir):
    result = cardinality.profile_cardinality(_read(spark, sf_dir, "orders"), "o_custkey", config=AdaptiveCardinalityConfig(policy="exact_only"))
    return spark.createDataFrame([("o_custkey", result.total_row_count, result.distinct_count)], "column string, row_count bigint, distinct_count bigint")


@_query(_md5_registers("'7:' || o_custkey", "orders", 10).replace("WHERE '7:' || o_custkey IS", "WHERE o_custkey IS"))
def hll_registers_seeded(spark, sf_dir):
    return registers.Sketch.of(_read(spark, sf_dir, "orders"), "o_custkey", 10, portable(seed=7)).table


def _folder(spark: SparkSession) -> str:
    """A new folder of the shared one that the session names; of this machine if it names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("stored sketches need spark.checkpoint.dir on a cluster")
    return f"{root}/colsonde-sketches-{uuid.uuid4().hex}" if root else f"file://{tempfile.mkdtemp(prefix='colsonde-')}/sketches"


@_query(_md5_estimate(_md5_registers("o_custkey", "orders", 12), 12))
def hll_stored_sketches(spark, sf_dir):
    df, path = _read(spark, sf_dir, "orders"), _folder(spark)
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        registers.Sketch.of(df.where(part), "o_custkey", 12, portable()).write(path, "o_custkey")
    stored = registers.Sketch.read(spark, path, "o_custkey")
    return registers.estimated(stored.table, 12).select("zero_registers", "branch", F.round("estimate", 6).alias("estimate"))


@_query(f"""SELECT (1024 - count(*))::BIGINT AS zero_registers, 'linear' AS branch, round(1024 * ln(1024.0::DOUBLE / (1024 - count(*))), 6) AS estimate
FROM ({_md5_registers("o_custkey", "orders", 10, where="o_orderkey < 0")})""")
def hll_empty_sketch(spark, sf_dir):
    return _estimate(_read(spark, sf_dir, "orders").where("o_orderkey < 0"), "o_custkey", 10)


@_query(_md5_registers("ts", "events", 8).replace("md5(ts::VARCHAR)", "md5(user_id::VARCHAR)").replace("SELECT  (h", "SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS week, (h").replace("WHERE ts IS", "WHERE user_id IS"))
def hll_windowed_registers(spark, sf_dir):
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    table = windowed_registers(events, "user_id", "ts", "7 days", "1 day", 8, portable())
    return table.select(F.col("window.start").alias("week"), "register", "rank")


_BOUNDS = registers.relative_standard_error(14) * 1.96


@_query(f"""SELECT "column", mode, round(distinct_count * CASE WHEN mode = 'hll' THEN 1 - {_BOUNDS!r}::DOUBLE ELSE 1 END, 4)::DOUBLE AS lower_bound,
round(distinct_count * CASE WHEN mode = 'hll' THEN 1 + {_BOUNDS!r}::DOUBLE ELSE 1 END, 4)::DOUBLE AS upper_bound FROM ({_adaptive("orders", ORDERS, 100)})""")
def cardinality_bounds_orders(spark, sf_dir):
    config = AdaptiveCardinalityConfig(exact_unique_threshold=100, hash_configuration=portable())
    report = cardinality.profile_cardinality(_read(spark, sf_dir, "orders").select(*ORDERS), config=config)
    rows = [(c.column, c.result.final_mode.value, *(round(x, 4) for x in c.result.bounds())) for c in report.columns]
    return spark.createDataFrame(rows, "column string, mode string, lower_bound double, upper_bound double")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS exact_count, true AS within FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate")))
def hll_default_contract_bounds(spark, sf_dir):
    """The default contract's hashes are Spark's own, so estimates are held against exact counts, within 5 standard errors."""
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate")
    sketched, exact = (cardinality.profile_cardinality(df, config=AdaptiveCardinalityConfig(policy=p)) for p in ("hll_only", "exact_only"))
    rows = []
    for s, e in zip(sketched.columns, exact.columns, strict=True):
        low, high = s.result.bounds(5)
        rows.append((e.column, e.result.distinct_count, not s.result.is_exact and low <= e.result.distinct_count <= high))
    return spark.createDataFrame(rows, "column string, exact_count bigint, within boolean")


@_query("""SELECT count(DISTINCT tagged)::BIGINT AS distinct_count, count(tagged)::BIGINT AS non_null_count FROM (
SELECT 'integer:' || l_linenumber AS tagged FROM lineitem UNION ALL SELECT 'string:' || l_linenumber FROM lineitem UNION ALL SELECT 'integer:' || l_suppkey FROM lineitem)""")
def tagged_values(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem")
    kinds = ((DtypeFamily.INTEGER, "l_linenumber"), (DtypeFamily.STRING, "l_linenumber"), (DtypeFamily.INTEGER, "l_suppkey"))
    mixed = df.select(F.explode(F.array(*[tagged(family, F.col(c)) for family, c in kinds])).alias("mixed"))
    result = cardinality.profile_cardinality(mixed, "mixed", config=AdaptiveCardinalityConfig(policy="exact_only"))
    return spark.createDataFrame([(result.distinct_count, result.non_null_count)], "distinct_count bigint, non_null_count bigint")


#: (family, expression here, expression of the other engine) of one column of every family that is counted.
_FAMILIES = (
    ("boolean", "user_id % 2 = 0", "user_id % 2 = 0"), ("integer", "cast(user_id % 100 as tinyint)", "user_id % 100"), ("floating", "cast(user_id % 1000 as float)", "user_id % 1000"),
    ("decimal", "cast(user_id as decimal(14, 2))", "user_id::DECIMAL(14, 2)"), ("string", "event_type", "event_type"), ("binary", "cast(event_type as binary)", "event_type"),
    ("date", "to_date(ts)", "ts::DATE"), ("timestamp", "cast(ts as timestamp)", "ts"), ("timestamp_ntz", "cast(ts as timestamp_ntz)", "ts"),
    ("daytime_interval", "make_dt_interval(0, 0, cast(user_id % 50 as int))", "user_id % 50"), ("yearmonth_interval", "make_ym_interval(0, cast(user_id % 50 as int))", "user_id % 50"),
    ("null", "null", "NULL"),
)


@_query(" UNION ALL ".join(f"SELECT '{name}' AS \"column\", '{name}' AS family, count({sql})::BIGINT AS non_null_count, count(DISTINCT {sql})::BIGINT AS distinct_count FROM events" for name, _, sql in _FAMILIES))
def every_family_events(spark, sf_dir):
    df = _read(spark, sf_dir, "events").selectExpr(*[f"{here} AS `{name}`" for name, here, _ in _FAMILIES])
    report = cardinality.profile_cardinality(df, config=AdaptiveCardinalityConfig(policy="exact_only"))
    rows = [(c.column, family_of(df.schema[c.column].dataType).value, c.result.non_null_count, c.result.distinct_count) for c in report.columns]
    return spark.createDataFrame(rows, "column string, family string, non_null_count bigint, distinct_count bigint")


@_query(_union("SELECT '{0[1]}' AS \"column\", {0[0]}::INT AS position, 'ok' AS status, count(*)::BIGINT AS row_count, (count(*) - count({0[1]}))::BIGINT AS null_count, count(DISTINCT {0[1]})::BIGINT AS distinct_count FROM orders", list(enumerate(ORDERS))))
def json_report_orders(spark, sf_dir):
    text = cardinality.profile_cardinality_json(_read(spark, sf_dir, "orders").select(*ORDERS), config=AdaptiveCardinalityConfig(policy="exact_only"))
    fields = "row_count bigint, columns array<struct<column: string, position: int, status: string, result: struct<output: struct<distinct_count: bigint>, row_metrics: struct<null_count: bigint>>>>"
    parsed = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", fields).alias("r")).select("r.row_count", F.explode("r.columns").alias("c"))
    return parsed.select("c.column", "c.position", "c.status", "row_count", "c.result.row_metrics.null_count", "c.result.output.distinct_count")


@_query(_union("SELECT '{0}' AS \"column\", 'pandas' AS backend, count(*)::BIGINT AS row_count, count({0})::BIGINT AS non_null_count, count(DISTINCT {0})::BIGINT AS distinct_count FROM nation", ("n_nationkey", "n_name", "n_regionkey")))
def pandas_intake_nation(spark, sf_dir):
    """``nation`` has 25 rows at every scale."""
    local = _read(spark, sf_dir, "nation").toPandas()
    report = cardinality.profile_cardinality(local)
    schema = discover_physical_schema(local)
    rows = [(c.column, schema.backend.name.value, schema.dimensions.row_count, c.result.non_null_count, c.result.distinct_count) for c in report.columns]
    return spark.createDataFrame(rows, "column string, backend string, row_count bigint, non_null_count bigint, distinct_count bigint")


@_query("""SELECT 'exact' AS mode, count(*)::BIGINT AS row_count, 'executed_query' AS source FROM orders UNION ALL SELECT 'metadata_only', NULL, 'not_computed' UNION ALL SELECT 'stream', NULL, 'unbounded'""")
def row_count_modes(spark, sf_dir):
    df = _read(spark, sf_dir, "orders")
    stream = spark.readStream.schema(df.schema).parquet(f"{sf_dir}/orders.parquet*")
    cases = (("exact", df, RowCountMode.EXACT), ("metadata_only", df, RowCountMode.METADATA_ONLY), ("stream", stream, RowCountMode.EXACT))
    found = [(name, discover_physical_schema(frame, row_count_mode=mode).as_dict()["dimensions"]) for name, frame, mode in cases]
    return spark.createDataFrame([(name, d["row_count"], d["row_count_source"]) for name, d in found], "mode string, row_count bigint, source string")


@_query(ORACLES["promotion_position_ordered"])
def promotion_telemetry_ordered(spark, sf_dir):
    df, config = _stored(_read(spark, sf_dir, "lineitem")), AdaptiveCardinalityConfig(exact_unique_threshold=100)
    p = cardinality.profile_cardinality(df, "l_partkey", config=config, order_by=LINE_ORDER).promotion
    row = (p.row_position, p.non_null_position, p.unique_count, p.exact_state_bytes, p.reason.value)
    return spark.createDataFrame([row], "row_position bigint, non_null_position bigint, unique_count bigint, state_bytes bigint, reason string")


@_query("""WITH n AS (""" + _union("SELECT count(DISTINCT {0}) > 100 AS promoted FROM orders", ORDERS) + """)
SELECT count(*)::BIGINT AS profiled_columns, round(avg((NOT promoted)::INT), 6)::DOUBLE AS exact_completion_rate, round(avg(promoted::INT), 6)::DOUBLE AS hll_promotion_rate,
       count(*) FILTER (promoted)::BIGINT AS by_threshold, (count(*) FILTER (promoted) * 16384)::BIGINT AS sketch_bytes FROM n""")
def telemetry_rates_orders(spark, sf_dir):
    found = cardinality.profile_cardinality(_read(spark, sf_dir, "orders").select(*ORDERS), config=AdaptiveCardinalityConfig(exact_unique_threshold=100)).telemetry()
    row = (found["profiled_columns"], round(found["exact_completion_rate"], 6), round(found["hll_promotion_rate"], 6), found["promotion_reasons"].get("exact_unique_threshold", 0), found["sketch_bytes"])
    return spark.createDataFrame([row], "profiled_columns bigint, exact_completion_rate double, hll_promotion_rate double, by_threshold bigint, sketch_bytes bigint")


@_query("SELECT 'embedding' AS \"column\", 'unsupported' AS status, count(*)::BIGINT AS row_count FROM embeddings")
def all_unsupported_embeddings(spark, sf_dir):
    return cardinality.profile_cardinality(_read(spark, sf_dir, "embeddings").select("embedding")).as_frame(spark).select("column", "status", "row_count")
