"""Hash contracts, and 64-bit hash expressions under them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the hash contracts.
XXHASH = ("spark-xxhash64-column-v1", "pyspark.sql.functions.xxhash64")
MD5 = ("md5-64-text-v1", "pyspark.sql.functions.md5")
CANONICAL = "spark-sql-native-dtype-v1"


@dataclass(frozen=True)
class HashConfiguration:
    """What must be equal for two sketches to be merged."""

    seed: int = 0
    algorithm_id: str = XXHASH[0]
    engine_id: str = XXHASH[1]
    width_bits: int = 64
    canonicalisation_version: str = CANONICAL
    null_policy: str = "exclude"
    runtime_id: str | None = None
    runtime_version: str | None = None
    kernel_id: str | None = None

    def __post_init__(self):
        if isinstance(self.seed, bool) or not hasattr(self.seed, "__index__"):
            raise TypeError("seed must be an integer")
        if not 0 <= self.seed < 1 << 64:
            raise ValueError("seed must have 64 bits")
        if self.width_bits != 64:
            raise ValueError("hashes have 64 bits")
        if self.null_policy != "exclude":
            raise ValueError("nulls are always excluded")
        for name in ("algorithm_id", "engine_id", "canonicalisation_version", "runtime_id", "runtime_version", "kernel_id"):
            given = getattr(self, name)
            if given is None and name in ("runtime_id", "runtime_version", "kernel_id"):
                continue
            if not isinstance(given, str):
                raise TypeError(f"{name} must be text")
            if not given.strip():
                raise ValueError(f"{name} must not be empty")
        if len({x is None for x in (self.runtime_id, self.runtime_version, self.kernel_id)}) > 1:
            raise ValueError("runtime_id, runtime_version and kernel_id go together")

    def bind(self, kernel_id: str, runtime_id: str = "pyspark", runtime_version: str = pyspark.__version__) -> HashConfiguration:
        """This contract for one kernel; binding again changes nothing, to another kernel is an error."""
        bound = replace(self, kernel_id=kernel_id, runtime_id=runtime_id, runtime_version=runtime_version)
        if self.kernel_id is not None and self != bound:
            raise ValueError(f"already bound to {self.kernel_id}")
        return bound

    def unbound(self) -> HashConfiguration:
        return replace(self, kernel_id=None, runtime_id=None, runtime_version=None)

    def as_dict(self) -> dict:
        return asdict(self)

    def hash(self, value: Column) -> Column:
        """Signed 64 bits of a value, null for null. The seed is hashed before the value."""
        seed = self.seed - (1 << 64) if self.seed >= 1 << 63 else self.seed
        if self.algorithm_id == MD5[0]:
            prefix = "" if seed == 0 else f"{seed}:"
            digest = F.md5(F.concat(F.lit(prefix), value.cast("string")))
            return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")
        return F.when(value.isNotNull(), F.xxhash64(F.lit(seed).cast("bigint"), value))


def portable(seed: int = 0) -> HashConfiguration:
    """A contract that any engine with md5 can follow: the first 64 bits of the md5 of the text."""
    return HashConfiguration(seed=seed, algorithm_id=MD5[0], engine_id=MD5[1])
