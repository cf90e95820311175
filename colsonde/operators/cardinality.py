"""Adaptive distinct counts of whole frames in a few fused jobs."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import replace
from typing import Any, Protocol

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colsonde import errors
from colsonde import vocabulary as V
from colsonde.functions.families import SLOT_BYTES, Kernel, named
from colsonde.functions.hashes import HashConfiguration
from colsonde.operators.registers import estimated, registers
from colsonde.plans.report import AdaptiveCardinalityConfig, AdaptiveCardinalityResult, ColumnCardinalityOutcome, DataFrameCardinalityResult, PromotionMetadata
from colsonde.sources.intake import DEFAULT_BACKEND_REGISTRY, BackendRegistry, DataFrameInput, resolve_dataframe_input, to_spark
from colsonde.sources.schema import whole_number

ALL = object()
#: Columns that one job profiles; wider frames take more jobs.
WIDTH = 32
#: What is run under each policy, as lineage states it.
STRATEGIES = {"two_stage": "routed_by_sketch_then_exact_or_hll", "exact_only": "exact_only", "hll_only": "hll_only"}
#: Precision, and so error, of the sketch that only routes.
ROUTE_PRECISION = 14
ROUTE_MARGIN = 6 * 1.04 / math.sqrt(1 << ROUTE_PRECISION)


def promotion_reason(unique_exceeded: bool, memory_exceeded: bool) -> V.PromotionReason | None:
    table = {(True, True): V.PromotionReason.BOTH, (True, False): V.PromotionReason.UNIQUE_THRESHOLD, (False, True): V.PromotionReason.MEMORY_THRESHOLD}
    return table.get((unique_exceeded, memory_exceeded))


def state_bytes(raw: float, factor: float) -> int:
    return math.ceil(raw * factor)


def _projected(df: DataFrame, kernels: dict[int, Kernel], config: AdaptiveCardinalityConfig) -> DataFrame:
    """Values v<k> and hashes of the columns c<k>, once, before any aggregate reads them.

    h<k> follow the contract and make the sketches that are reported; r<k> only route, so they
    are always the cheapest hash. Each job reads one kind and the other is pruned.
    """
    values = df.select(*[k.value(F.col(f"c{i}")).alias(f"v{i}") for i, k in kernels.items()])
    routing = HashConfiguration()
    hashes = [(f"{name}{i}", contract.hash(F.col(f"v{i}"))) for i in kernels for name, contract in (("r", routing), ("h", config.hash_configuration))]
    return values.select("*", *[h.alias(name) for name, h in hashes])


def _route(rows: DataFrame, kernels: dict[int, Kernel]) -> dict:
    """Job A: rows, values that count, an approximate distinct count and the mean size, of all columns."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, k in kernels.items():
        aggs += [
            F.count(f"v{i}").alias(f"n{i}"),
            F.hll_sketch_estimate(F.hll_sketch_agg(f"r{i}", F.lit(ROUTE_PRECISION))).alias(f"e{i}"),
            F.sum(k.size(F.col(f"v{i}"))).alias(f"b{i}"),
        ]
    return rows.agg(*aggs).first().asDict()


def _exact(rows: DataFrame, kernels: dict[int, Kernel], limit: int | None) -> dict[int, tuple[int, int]]:
    """Job B: (distinct values, their bytes) of columns that may be few-valued.

    With a ``limit`` a column has at most limit + 1 of either, as no more are looked at.
    """
    found = {}
    for i, k in kernels.items():
        distinct = rows.select(f"v{i}").where(f"v{i} IS NOT NULL").distinct()
        if limit is not None:
            distinct = distinct.limit(limit + 1)
        found[i] = distinct.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(k.size(F.col(f"v{i}"))), F.lit(0)).alias("b"))
    frames = list(found.values())
    if not frames:
        return {}
    all_of = frames[0]
    for f in frames[1:]:
        all_of = all_of.unionByName(f)
    return {r.i: (r.n, r.b) for r in all_of.collect()}


def _exact_fused(rows: DataFrame, kernels: dict[int, Kernel]) -> dict[int, tuple[int, int]]:
    """Job B for columns whose few values are certain, all in one aggregate.

    Values of one width need only be counted; texts and binaries are grouped as bytes, keyed by
    their column, so that the bytes of distinct values are summed.
    """
    plain = {i: k for i, k in kernels.items() if k.family not in (V.DtypeFamily.STRING, V.DtypeFamily.BINARY)}
    found = {}
    if plain:
        counts = rows.agg(*[F.count_distinct(f"v{i}").alias(f"v{i}") for i in plain]).select(*[F.struct(F.col(f"v{i}").alias("n"), (F.col(f"v{i}") * k.size(F.lit(None))).alias("b")).alias(f"v{i}") for i, k in plain.items()])
        found = {int(name[1:]): (x.n, x.b) for name, x in counts.first().asDict().items()}
    rest = [i for i in kernels if i not in plain]
    if rest:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").cast("binary").alias("v")) for i in rest]))
        distinct = rows.select(each.alias("p")).select("p.i", "p.v").where("v IS NOT NULL").distinct()
        sums = distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("v") + SLOT_BYTES).alias("b"))
        got = {r.i: (r.n, r.b) for r in sums.collect()}
        found |= {i: got.get(i, (0, 0)) for i in rest}
    return found


def _sketched(rows: DataFrame, columns: Iterable[int], p: int) -> dict[int, tuple[int, float]]:
    """Job C: (zero registers, estimate) of promoted columns: at most 2**p groups each, estimated in SQL."""
    columns = list(columns)
    if not columns:
        return {}
    hashes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"h{i}").alias("h")) for i in columns]))
    pairs = rows.select(hashes.alias("p"))
    table = registers(pairs, F.col("p.h"), p, [F.col("p.i").alias("i")])
    got = {r.i: (r.zero_registers, r.estimate) for r in estimated(table, p, ["i"]).collect()}
    return {i: got.get(i, (1 << p, 0.0)) for i in columns}


def _profile(df: DataFrame, positions: list[int], config: AdaptiveCardinalityConfig) -> tuple[int, dict[int, dict]]:
    """Row count, and by position the plain numbers of a result, of a frame with columns c0, c1, ..."""
    out: dict[int, dict] = {}
    total, limit = None, config.exact_unique_threshold
    for at in range(0, len(positions), WIDTH):
        kernels = {i: Kernel.of(df.schema[f"c{i}"].dataType) for i in positions[at : at + WIDTH]}
        rows = _projected(df, kernels, config)
        routed = _route(rows, kernels)
        total = routed["rows"]
        sure, unsure, over = {}, {}, set()
        for i, k in kernels.items():
            about = routed[f"e{i}"] or 0
            if config.policy == "hll_only" or (config.policy == "two_stage" and about > limit * (1 + ROUTE_MARGIN) + 1):
                over.add(i)
            elif config.policy == "exact_only" or about < limit * (1 - ROUTE_MARGIN):
                sure[i] = k
            else:
                unsure[i] = k
        exact = _exact_fused(rows, sure) | _exact(rows, unsure, limit)
        promoted: dict[int, tuple] = {}
        for i in kernels:
            if i in over:
                mean = (routed[f"b{i}"] or 0) / max(1, routed[f"n{i}"])
                seen = min(limit + 1, routed[f"e{i}"] or 0)
                unique, size = seen, state_bytes(mean * seen, config.memory_safety_factor)
            else:
                unique, size = exact[i][0], state_bytes(exact[i][1], config.memory_safety_factor)
            reason = promotion_reason(unique > limit, size > config.exact_memory_budget_bytes)
            if config.policy == "exact_only" or (config.keep_exact and reason is V.PromotionReason.MEMORY_THRESHOLD and i not in over):
                reason = None
            out[i] = {"modelled": i in over, "non_null": routed[f"n{i}"], "unique": unique, "bytes": size, "distinct": unique, "reason": reason}
            if reason is not None or i in over:
                promoted[i] = ()
        for i, (zero, estimate) in _sketched(rows, promoted, config.hll_precision).items():
            out[i] |= {"distinct": round(estimate), "zero": zero, "raw": estimate}
    return (df.count() if total is None else total), out


def _lineage(item: DataFrameInput, spark: SparkSession, label: object, position: int, dtype: Any, nullable: bool, kernel: Kernel, config: AdaptiveCardinalityConfig, pipeline: dict | None) -> dict:
    try:
        zone = spark.conf.get("spark.sql.session.timeZone")
    except Exception:
        zone = None
    return {
        "backend": item.backend.as_dict(),
        "column": {
            "name": errors.json_safe(label), "position": position, "native_dtype": dtype.simpleString(), "native_dtype_class": f"{type(dtype).__module__}.{type(dtype).__qualname__}",
            "nullable": nullable, "dtype_source": "pyspark.sql.DataFrame.schema", "family": kernel.family.value,
        },
        "pipeline": pipeline or {"entrypoint": "profile_cardinality", "input_boundary": "dataframe"},
        "pyspark_version": pyspark.__version__,
        "dataframe_type": item.backend.dataframe_type,
        "dtype_family": kernel.family.value,
        "hash_kernel": {"kernel_id": kernel.kernel_id, "exact_representation": kernel.representation},
        "hash_execution": f"{config.hash_configuration.engine_id.rsplit('.', 1)[-1]}_expression_distributed",
        "spark_session_timezone": zone,
        "distributed_execution": True,
        "adaptive_strategy": STRATEGIES[config.policy],
    }


class SparkCardinalityAdapter:
    """Profiles any frame that can enter Spark."""

    def __init__(self, backend: V.BackendName):
        self.backend = backend

    def profile_all(self, item: DataFrameInput, *, config: AdaptiveCardinalityConfig, batch_size: int | None, only: int | None = None, pipeline: dict | None = None, order_by: list | None = None) -> DataFrameCardinalityResult:
        """``order_by``: columns that order the rows; only then do promoted columns report where they were promoted."""
        order = [f"c{_position(item, x)}" for x in order_by or []]
        df, labels, warnings = to_spark(item)
        spark = df.sparkSession
        if df.isStreaming:
            raise errors.StreamingCardinalityError("distinct values of a stream are counted by colsonde.streaming")
        fields = df.schema.fields
        kernels = [Kernel.of(f.dataType) for f in fields]
        nullable = [f.nullable for f in (item.dataframe.schema.fields if self.backend is V.BackendName.PYSPARK else fields)]
        wanted = range(len(fields)) if only is None else [only]
        total, numbers = _profile(df, [i for i in wanted if kernels[i].countable], config)
        outcomes = []
        for i in wanted:
            kernel, dtype = kernels[i], fields[i].dataType
            if not kernel.countable:
                failure = errors.UnsupportedCardinalityDtypeError(backend=item.backend.name.value, column=labels[i], native_dtype=dtype.simpleString(), dtype_family=kernel.family.value)
                if only is not None:
                    raise failure
                outcomes.append(ColumnCardinalityOutcome(labels[i], i, None, failure.warning))
                continue
            x = numbers[i]
            exact = "raw" not in x
            # The contract of this column's hashes, so that stored sketches can be matched with the report.
            bound = replace(config, hash_configuration=config.hash_configuration.bind(kernel.kernel_id))
            promotion = PromotionMetadata(False) if exact else PromotionMetadata(True, x["reason"], None, None, x["unique"], x["bytes"])
            crossing = promotion_position(df, f"c{i}", order, config).first() if order and not exact else None
            if crossing is not None:
                promotion = PromotionMetadata(True, V.PromotionReason(crossing.reason), crossing.row_position, crossing.non_null_position, crossing.unique_count, crossing.state_bytes)
            outcomes.append(ColumnCardinalityOutcome(labels[i], i, AdaptiveCardinalityResult(
                distinct_count=x["distinct"], final_mode=V.CardinalityMode.EXACT if exact else V.CardinalityMode.HLL, total_row_count=total, non_null_count=x["non_null"], config=bound,
                promotion=promotion,
                unique_seen=x["unique"], state_bytes=x["bytes"], representation=kernel.representation, zero_registers=x.get("zero"), raw_hll_estimate=x.get("raw"),
                execution_parameters={"batch_size": batch_size, "pyspark_execution": "distributed_fused_sql", "exact_state_source": "modelled_from_routing_sketch" if x["modelled"] else "observed", "exact_candidate_limit": config.exact_unique_threshold + 1, "hll_register_aggregation": "spark_sql_groupby_register_max_rho"},
                lineage=_lineage(item, spark, labels[i], i, dtype, bool(nullable[i]), kernel, bound, pipeline), warnings=(warnings[i],) if warnings[i] else (),
            )))
        return DataFrameCardinalityResult(item.backend.as_dict(), total, tuple(outcomes))

    def profile(self, item: DataFrameInput, column: object, *, config: AdaptiveCardinalityConfig, batch_size: int | None, order_by: list | None = None) -> AdaptiveCardinalityResult:
        at = _position(item, column)
        return self.profile_all(item, config=config, batch_size=batch_size, only=at, order_by=order_by).columns[0].result


def _position(item: DataFrameInput, column: object) -> int:
    if item.backend.name is V.BackendName.PYSPARK:
        if not isinstance(column, str):
            raise TypeError("a Spark column is named by a string")
        labels = [f.name for f in item.dataframe.schema.fields]
    else:
        labels = list(item.dataframe.columns)
    found = [i for i, x in enumerate(labels) if type(x) is type(column) and x == column]
    if not found:
        raise KeyError(column)
    if len(found) > 1:
        raise ValueError(f"{len(found)} columns are named {errors.json_safe(column)!r}")
    return found[0]


class CardinalityBackendAdapter(Protocol):
    backend: V.BackendName

    def profile(self, item, column, *, config, batch_size): ...

    def profile_all(self, item, *, config, batch_size): ...


class CardinalityRegistry:
    def __init__(self, adapters: Iterable[CardinalityBackendAdapter] = ()):
        self.adapters = tuple(adapters)
        if len({a.backend for a in self.adapters}) < len(self.adapters):
            raise errors.DuplicateCardinalityAdapterError("two adapters serve one backend")

    def with_adapter(self, adapter: CardinalityBackendAdapter) -> CardinalityRegistry:
        return CardinalityRegistry((*self.adapters, adapter))

    def run(self, item: DataFrameInput, column: object, *, config: AdaptiveCardinalityConfig, batch_size: int | None, **more):
        for a in self.adapters:
            if a.backend == item.backend.name:
                try:
                    if column is ALL:
                        return a.profile_all(item, config=config, batch_size=batch_size, **more)
                    return a.profile(item, column, config=config, batch_size=batch_size, **more)
                except (KeyError, TypeError, ValueError, errors.CardinalityError):
                    raise
                except Exception as cause:
                    raise errors.CardinalityProfilingError(f"{item.backend.dataframe_type} cannot be profiled") from cause
        raise errors.UnsupportedCardinalityBackendError(f"no adapter serves {item.backend.name}")


DEFAULT_CARDINALITY_REGISTRY = CardinalityRegistry([SparkCardinalityAdapter(b) for b in V.BackendName])


def profile_cardinality_from_input(item: DataFrameInput, column: object = ALL, *, config: AdaptiveCardinalityConfig | None = None, batch_size: int | None = None, registry: CardinalityRegistry = DEFAULT_CARDINALITY_REGISTRY, order_by: list | None = None):
    if not isinstance(item, DataFrameInput):
        raise TypeError("a DataFrameInput is needed")
    if batch_size is not None:
        whole_number("batch_size", batch_size, 1)
    more = {} if order_by is None else {"order_by": order_by}
    return registry.run(item, column, config=config or AdaptiveCardinalityConfig(), batch_size=batch_size, **more)


def profile_cardinality(
    dataframe: object, column: object = ALL, *, config: AdaptiveCardinalityConfig | None = None, batch_size: int | None = None,
    backend_registry: BackendRegistry = DEFAULT_BACKEND_REGISTRY, cardinality_registry: CardinalityRegistry = DEFAULT_CARDINALITY_REGISTRY, order_by: list | None = None,
):
    """The distinct count of one column, or of all if none is named (None is a legal label).

    With ``order_by``, columns of the frame, reports hold the positions of promotions in that
    order, which takes one more query a promoted column.
    """
    item = resolve_dataframe_input(dataframe, registry=backend_registry)
    return profile_cardinality_from_input(item, column, config=config, batch_size=batch_size, registry=cardinality_registry, order_by=order_by)


def profile_cardinality_json(dataframe: object, column: object = ALL, *, indent: int | None = 2, **more) -> str:
    return profile_cardinality(dataframe, column, **more).to_json(indent=indent)


def promotion_position(df: DataFrame, column: str, order_by: list[str], config: AdaptiveCardinalityConfig | None = None) -> DataFrame:
    """Where exact state would be given up if rows came in the given order: one row, or none.

    (row_position from 0, non_null_position from 1, unique_count, state_bytes, reason.) Rows that
    tie come by value, those that do not count last. First places of distinct values are found by
    aggregation, and only the first threshold + 1 of them, or those that fill the memory budget,
    take part in the running sums.
    """
    config = config or AdaptiveCardinalityConfig()
    kernel = Kernel.of(df.schema[column].dataType)
    order = F.struct(*[named(x).alias(x) for x in order_by])
    rows = df.select(kernel.value(named(column)).alias("v"), order.alias("o"))
    firsts = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("o").alias("o"))
    bound = config.exact_memory_budget_bytes / config.memory_safety_factor
    most = min(config.exact_unique_threshold + 1, int(bound // SLOT_BYTES) + 1)
    w = Window.orderBy("o", "v").rowsBetween(Window.unboundedPreceding, 0)
    lead = firsts.orderBy("o", "v").limit(most)
    running = lead.select("o", "v", F.count(F.lit(1)).over(w).alias("unique_count"), F.ceil(F.sum(kernel.size(F.col("v"))).over(w) * config.memory_safety_factor).alias("state_bytes"))
    over_unique = F.col("unique_count") > config.exact_unique_threshold
    over_memory = F.col("state_bytes") > config.exact_memory_budget_bytes
    reason = F.when(over_unique & over_memory, V.PromotionReason.BOTH.value).when(over_unique, V.PromotionReason.UNIQUE_THRESHOLD.value).when(over_memory, V.PromotionReason.MEMORY_THRESHOLD.value)
    crossing = running.withColumn("reason", reason).where("reason IS NOT NULL").orderBy("o", "v").limit(1)
    at = crossing.select(F.col("o").alias("at"), F.col("v").alias("new"), F.col("unique_count").cast("bigint"), F.col("state_bytes").cast("bigint"), "reason")
    # The first row with the new value is the one that crosses.
    before = (F.col("o") < F.col("at")) | (F.col("v") < F.col("new"))
    counts = F.count_if(before).alias("row_position"), (F.count_if(before & F.col("v").isNotNull()) + 1).alias("non_null_position")
    told = ["unique_count", "state_bytes", "reason"]
    return rows.join(F.broadcast(at), F.col("o") <= F.col("at")).groupBy(*told).agg(*counts).select("row_position", "non_null_position", *told)
