"""Classic HyperLogLog as tables of (register, rank): built, merged, kept and estimated in SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsonde.functions.families import Kernel, named
from colsonde.functions.hashes import HashConfiguration
from colsonde.sources.schema import whole_number

LEAST, MOST, DEFAULT = 4, 20, 14


def checked_precision(p: int) -> int:
    p = whole_number("precision", p)
    if not LEAST <= p <= MOST:
        raise ValueError(f"precision must be {LEAST} to {MOST}")
    return p


def alpha(p: int) -> float:
    """Fixed values of the published estimator for few registers, its formula for more."""
    return {4: 0.673, 5: 0.697, 6: 0.709}.get(p) or 0.7213 / (1 + 1.079 / (1 << p))


def relative_standard_error(p: int) -> float:
    return 1.04 / math.sqrt(1 << p)


def register_of(h: Column, p: int) -> Column:
    """The first p bits."""
    return F.shiftrightunsigned(h, 64 - p).cast("int")


def rest_of(h: Column, p: int) -> Column:
    """The other bits."""
    return h.bitwiseAND(F.lit((1 << (64 - p)) - 1))


def rank_of_rest(rest: Column, p: int) -> Column:
    return F.when(rest == 0, 65 - p).otherwise(65 - p - F.length(F.bin(rest))).cast("int")


def rank_of(h: Column, p: int) -> Column:
    """Leading zeros of the other bits, and one."""
    return rank_of_rest(rest_of(h, p), p)


def registers(df: DataFrame, h: Column, p: int = DEFAULT, by: list | None = None) -> DataFrame:
    """(by..., register, rank) of hash column ``h``: at most 2**p rows a group, aggregated before the shuffle.

    The greatest rank is that of the least rest, so ranks are worked out once a register, not once a row.
    """
    p = checked_precision(p)
    keys = [F.col(x) if isinstance(x, str) else x for x in by or []]
    hashed = df.select(*keys, h.alias("__hash")).where("__hash IS NOT NULL")
    names = hashed.columns[:-1]
    least = hashed.select(*names, register_of(F.col("__hash"), p).alias("register"), rest_of(F.col("__hash"), p).alias("__rest")).groupBy(*names, "register").agg(F.min("__rest").alias("__rest"))
    return least.select(*names, "register", rank_of_rest(F.col("__rest"), p).alias("rank"))


def merged(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Register-wise maximum: the sketch of the union, in any order and however often."""
    return table.groupBy(*(by or []), "register").agg(F.max("rank").alias("rank"))


def estimated(table: DataFrame, p: int = DEFAULT, by: list[str] | None = None) -> DataFrame:
    """(by..., zero_registers, raw, estimate, branch): linear counting up to 2.5 m while registers are zero."""
    p = checked_precision(p)
    m = 1 << p
    sums = table.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("__s"))
    zero = F.lit(m) - F.col("__n")
    raw = F.lit(alpha(p) * m * m) / (F.col("__s") + zero)
    linear = (F.col("raw") <= 2.5 * m) & (F.col("zero_registers") > 0)
    return (
        sums.select(*(by or []), zero.cast("bigint").alias("zero_registers"), raw.alias("raw"))
        .withColumn("branch", F.when(linear, "linear").otherwise("raw"))
        .withColumn("estimate", F.when(linear, m * F.log(m / F.when(F.col("zero_registers") > 0, F.col("zero_registers")).otherwise(1))).otherwise(F.col("raw")))
    )


@dataclass(frozen=True)
class Sketch:
    """A register table with its precision and hash contract."""

    table: DataFrame
    precision: int
    contract: HashConfiguration

    @staticmethod
    def of(df: DataFrame, column: str, precision: int = DEFAULT, contract: HashConfiguration | None = None) -> Sketch:
        kernel = Kernel.of(df.schema[column].dataType)
        bound = (contract or HashConfiguration()).bind(kernel.kernel_id)
        value = kernel.value(named(column))
        return Sketch(registers(df, bound.hash(value), precision), checked_precision(precision), bound)

    def merge(self, other: Sketch) -> Sketch:
        if self.precision != other.precision:
            raise ValueError("sketches of different precision cannot be merged")
        if self.contract != other.contract:
            raise ValueError("sketches under different hash contracts cannot be merged")
        return Sketch(merged(self.table.unionByName(other.table)), self.precision, self.contract)

    def absorb(self, df: DataFrame, column: str) -> Sketch:
        """This sketch with the values of a column added: an exact state, or rows that came since."""
        return self.merge(Sketch.of(df, column, self.precision, self.contract.unbound()))

    def is_empty(self) -> bool:
        return self.table.isEmpty()

    def estimate(self) -> float:
        return estimated(self.table, self.precision).first().estimate

    def zero_registers(self) -> int:
        return (1 << self.precision) - self.table.count()

    def write(self, path: str, column: str) -> None:
        """Append to a Parquet table of sketches, partitioned by column."""
        labels = {k: F.lit(v).cast("bigint" if k in ("width_bits",) else "string") for k, v in self.contract.as_dict().items()}
        out = self.table.select(*[v.alias(k) for k, v in labels.items()], F.lit(self.precision).alias("precision"), F.lit(column).alias("column"), "register", "rank")
        out.write.mode("append").partitionBy("column").parquet(path)

    @staticmethod
    def read(spark, path: str, column: str) -> Sketch:
        """The merged sketch of all that was written for a column; mixed contracts are an error."""
        rows = spark.read.parquet(path).where(F.col("column") == column)
        names = list(HashConfiguration().as_dict())
        kinds = rows.select(*names, "precision").distinct().take(2)
        if len(kinds) != 1:
            raise ValueError(f"{len(kinds)} hash contracts are stored for {column}")
        found = kinds[0].asDict()
        precision = found.pop("precision")
        contract = HashConfiguration(**{**found, "seed": int(found["seed"]), "width_bits": int(found["width_bits"])})
        return Sketch(merged(rows.select("register", "rank")), precision, contract)


def merge_states(left: DataFrame | Sketch, right: DataFrame | Sketch, column: str, threshold: int, precision: int = DEFAULT, contract: HashConfiguration | None = None, policy: str = "two_stage") -> DataFrame | Sketch:
    """The state of the union of two states, each a frame with the values of ``column`` or a sketch.

    Two exact states stay exact, as a frame of distinct values, up to ``threshold`` values;
    beyond it, and where either side is a sketch, the result is a sketch. Under the policy
    exact_only the result is exact at any size, and sketches are an error.
    """
    if policy not in ("two_stage", "exact_only"):
        raise ValueError("policy must be two_stage or exact_only")
    states = sorted((left, right), key=lambda x: isinstance(x, DataFrame))
    if isinstance(states[0], Sketch):
        if policy == "exact_only":
            raise ValueError("a sketch cannot become an exact state")
        return states[0].absorb(states[1], column) if isinstance(states[1], DataFrame) else states[0].merge(states[1])
    value = Kernel.of(left.schema[column].dataType).value(named(column)).alias(column)
    both = left.select(value).unionByName(right.select(value)).where(named(column).isNotNull()).distinct()
    if policy == "exact_only" or both.limit(threshold + 1).count() <= threshold:
        return both
    return Sketch.of(both, column, precision, contract)


def nunique(df: DataFrame, column: str, precision: int = DEFAULT) -> int:
    return round(Sketch.of(df, column, precision).estimate())
