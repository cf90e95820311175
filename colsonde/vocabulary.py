"""The words that identities, reports and warnings are made of."""

from enum import StrEnum


class BackendName(StrEnum):
    PANDAS = "pandas"
    POLARS = "polars"
    PYSPARK = "pyspark"


class DataFrameApi(StrEnum):
    PANDAS = "pandas"
    POLARS = "polars"
    SPARK_SQL = "spark_sql"


class FrameKind(StrEnum):
    DATAFRAME = "dataframe"
    LAZY_FRAME = "lazy_frame"


class EvaluationMode(StrEnum):
    EAGER = "eager"
    LAZY = "lazy"


class DistributionMode(StrEnum):
    LOCAL = "local"
    DISTRIBUTED = "distributed"


class ConnectionMode(StrEnum):
    IN_PROCESS = "in_process"
    SPARK_CLASSIC = "spark_classic"
    SPARK_CONNECT = "spark_connect"


class RowCountMode(StrEnum):
    METADATA_ONLY = "metadata_only"
    EXACT = "exact"


class RowCountSource(StrEnum):
    FRAME_METADATA = "frame_metadata"
    EXECUTED_QUERY = "executed_query"
    NOT_COMPUTED = "not_computed"
    UNBOUNDED = "unbounded"


class CardinalityMode(StrEnum):
    EXACT = "exact"
    HLL = "hll"


class PromotionReason(StrEnum):
    UNIQUE_THRESHOLD = "exact_unique_threshold"
    MEMORY_THRESHOLD = "exact_memory_budget"
    BOTH = "exact_unique_threshold_and_memory_budget"


class CardinalityWarningCode(StrEnum):
    SCALAR_FALLBACK = "scalar_canonicalization_fallback"
    UNSUPPORTED_SCALAR = "unsupported_cardinality_scalar"
    UNSUPPORTED_DTYPE = "unsupported_cardinality_dtype"
    DRIVER_STREAM_FALLBACK = "distributed_driver_stream_fallback"


class CardinalityWarningSeverity(StrEnum):
    PERFORMANCE = "performance"
    ERROR = "error"


class DtypeFamily(StrEnum):
    BOOLEAN = "boolean"
    INTEGER = "integer"
    FLOATING = "floating"
    DECIMAL = "decimal"
    STRING = "string"
    BINARY = "binary"
    DATE = "date"
    TIMESTAMP = "timestamp"
    TIMESTAMP_NTZ = "timestamp_ntz"
    DAYTIME_INTERVAL = "daytime_interval"
    YEARMONTH_INTERVAL = "yearmonth_interval"
    NULL = "null"
    NESTED = "nested"
    OTHER = "other"


RESULT_SCHEMA_VERSION = "adaptive-cardinality-v6"
ALGORITHM_VERSION = "exact-to-classic-hll-v2"
FRAME_SCHEMA_VERSION = "dataframe-cardinality-v1"
