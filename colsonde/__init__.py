"""colsonde: a Spark-native dataframe profiler (schema, exact and sketched distinct counts)."""

from colsonde.errors import *  # noqa: F403
from colsonde.functions.families import Kernel, family_of
from colsonde.functions.hashes import HashConfiguration, portable
from colsonde.operators.cardinality import (
    DEFAULT_CARDINALITY_REGISTRY,
    CardinalityBackendAdapter,
    CardinalityRegistry,
    profile_cardinality,
    profile_cardinality_from_input,
    profile_cardinality_json,
    promotion_position,
)
from colsonde.operators.registers import Sketch, estimated, merged, nunique, registers
from colsonde.plans.report import AdaptiveCardinalityConfig, AdaptiveCardinalityResult, ColumnCardinalityOutcome, DataFrameCardinalityResult, PromotionMetadata
from colsonde.sources.intake import DEFAULT_BACKEND_REGISTRY, BackendDetector, BackendIdentity, BackendRegistry, DataFrameInput, identify_backend, resolve_dataframe_input
from colsonde.sources.schema import (
    DEFAULT_PHYSICAL_SCHEMA_REGISTRY,
    DataFrameDimensions,
    DataFramePhysicalSchema,
    NativeColumnSchema,
    PhysicalSchemaDiscoverer,
    PhysicalSchemaRegistry,
    discover_physical_schema,
    discover_physical_schema_from_input,
)
from colsonde.streaming.sketches import windowed_registers
from colsonde.vocabulary import *  # noqa: F403

__version__ = "0.1.0"
