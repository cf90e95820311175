"""Families of Spark types, and what each contributes to a distinct count as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsonde.vocabulary import DtypeFamily

_BY_TYPE = (
    (T.BooleanType, DtypeFamily.BOOLEAN), (T.IntegralType, DtypeFamily.INTEGER), (T.FractionalType, DtypeFamily.FLOATING),
    (T.StringType, DtypeFamily.STRING), (T.CharType, DtypeFamily.STRING), (T.VarcharType, DtypeFamily.STRING), (T.BinaryType, DtypeFamily.BINARY),
    (T.DateType, DtypeFamily.DATE), (T.TimestampNTZType, DtypeFamily.TIMESTAMP_NTZ), (T.TimestampType, DtypeFamily.TIMESTAMP),
    (T.DayTimeIntervalType, DtypeFamily.DAYTIME_INTERVAL), (T.YearMonthIntervalType, DtypeFamily.YEARMONTH_INTERVAL), (T.NullType, DtypeFamily.NULL),
    (T.ArrayType, DtypeFamily.NESTED), (T.MapType, DtypeFamily.NESTED), (T.StructType, DtypeFamily.NESTED),
)

#: Bytes that a kept value of a fixed-width family takes in the size model.
_WIDTH = {
    DtypeFamily.BOOLEAN: 1, DtypeFamily.INTEGER: 8, DtypeFamily.FLOATING: 8, DtypeFamily.DECIMAL: 16, DtypeFamily.DATE: 4, DtypeFamily.TIMESTAMP: 8,
    DtypeFamily.TIMESTAMP_NTZ: 8, DtypeFamily.DAYTIME_INTERVAL: 8, DtypeFamily.YEARMONTH_INTERVAL: 4, DtypeFamily.NULL: 0,
}
#: And what each value takes besides: a slot of the container that keeps it.
SLOT_BYTES = 24


def family_of(dtype: T.DataType) -> DtypeFamily:
    """Strings under a collation are OTHER: their hashes and their equality disagree."""
    if isinstance(dtype, T.DecimalType):
        return DtypeFamily.DECIMAL
    for kind, family in _BY_TYPE:
        if isinstance(dtype, kind):
            if family is DtypeFamily.STRING and getattr(dtype, "collation", "UTF8_BINARY") not in (None, "UTF8_BINARY"):
                return DtypeFamily.OTHER
            return family
    return DtypeFamily.OTHER


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


@dataclass(frozen=True)
class Kernel:
    """A column's family and the expressions built from it; none of them runs a job."""

    family: DtypeFamily
    dtype: str

    @staticmethod
    def of(dtype: T.DataType) -> Kernel:
        return Kernel(family_of(dtype), dtype.simpleString())

    @property
    def countable(self) -> bool:
        return self.family not in (DtypeFamily.NESTED, DtypeFamily.OTHER)

    @property
    def kernel_id(self) -> str:
        return f"spark-{self.family.value}-v1:{self.dtype}"

    @property
    def representation(self) -> str:
        return f"spark_distinct_native_{self.family.value}"

    def included(self, c: Column) -> Column:
        """Neither null nor NaN."""
        return c.isNotNull() & ~F.isnan(c) if self.family is DtypeFamily.FLOATING else c.isNotNull()

    def value(self, c: Column) -> Column:
        """The value that counts, null if none does; both zeros are one."""
        if self.family is DtypeFamily.NULL:
            return F.lit(None).cast("int")
        if self.family is DtypeFamily.FLOATING:
            c = F.when(c == 0, F.lit(0).cast(self.dtype)).otherwise(c)
        return F.when(self.included(c), c)

    def size(self, value: Column) -> Column:
        """Bytes that keeping a distinct value would take: a model, the same on every machine."""
        width = _WIDTH.get(self.family)
        return (F.octet_length(value) if width is None else F.lit(width)).cast("bigint") + SLOT_BYTES


def tagged(family: DtypeFamily, value: Column) -> Column:
    """Bytes of a value for columns that mix types: equal only if type and text are equal, null for null."""
    return F.concat(F.lit(f"{family.value}:"), value.cast("string")).cast("binary")
