"""Distinct counts of event-time windows of a stream, from register tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsonde.functions.families import Kernel, named
from colsonde.functions.hashes import HashConfiguration
from colsonde.operators.registers import DEFAULT, checked_precision, rank_of, register_of


def windowed_registers(stream: DataFrame, column: str, time: str, window: str, lateness: str, p: int = DEFAULT, contract: HashConfiguration | None = None) -> DataFrame:
    """(window, register, rank) of a stream (or a table): state of at most 2**p rows a window.

    Rows later than ``lateness`` are dropped by the watermark. Written with outputMode
    ``append`` or ``update``, the tables are estimated with ``operators.registers.estimated``.
    """
    p = checked_precision(p)
    kernel = Kernel.of(stream.schema[column].dataType)
    h = (contract or HashConfiguration()).bind(kernel.kernel_id).hash(kernel.value(named(column)))
    rows = stream.withWatermark(time, lateness).select(named(time).alias("__time"), h.alias("__hash")).where("__hash IS NOT NULL")
    return rows.groupBy(F.window("__time", window).alias("window"), register_of(F.col("__hash"), p).alias("register")).agg(F.max(rank_of(F.col("__hash"), p)).alias("rank"))
