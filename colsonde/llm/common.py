"""Shared plumbing: scratch tables in the shared folder, and text expressions."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separator of words: space, \t, \n, \v, \f, \r.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch between Spark and a worker; whole batches are held on both sides.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()
_used: set[str] = set()


def _base(spark: SparkSession) -> str:
    """The shared folder that the session or its context names.

    Only a local session that names none gets a folder of its own: on a cluster each machine
    would write to its own disk, and reads would come back short.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        found = context._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="colsonde-")
        context.setCheckpointDir(named)
        return _base(spark)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, where nothing is created yet; deleted when the driver ends.

    Results are read from such tables until then. :func:`sweep` deletes them earlier.
    """
    mine = f"{_base(spark)}/colsonde/{spark.sparkContext.applicationId}"
    if mine not in _used:
        _used.add(mine)
        atexit.register(_forget, mine)
    return f"{mine}/{label}-{uuid.uuid4().hex}"


def _forget(uri: str) -> None:
    with contextlib.suppress(OSError):
        discard(uri)


def sweep() -> None:
    """Delete all scratch tables of this driver; frames that read from them cannot be run any more."""
    for uri in _used:
        _forget(uri)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder, on the driver or an executor."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        path = uri[5:]
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def discard(uri: str) -> None:
    """Delete a scratch table that nothing will read any more."""
    files, path = open_fs(uri)
    if files.get_file_info(path).type.name == "Directory":
        files.delete_dir(path)


def give_back() -> None:
    """Hand memory that this worker has freed back to the system, for the executor's other processes."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """``run``, a function for mapInArrow, with its memory given back when a task's rows end.

    Idle workers outlive their task, so what they keep would count against the next stage.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def tidy_group(of, least: int = 1 << 20):
    """``of``, a function for applyInArrow, with memory given back after each group of ``least`` bytes."""

    def whole(group):
        out = of(group)
        if group.nbytes >= least:
            give_back()
        return out

    return whole


def map_rows(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name; ``run`` sees stand-ins for names with dots or backticks."""
    names = dict.fromkeys([*df.columns, *schema.names])
    odd = {name: f"__name{i}" for i, name in enumerate(names) if "." in name or "`" in name}
    inner = T.StructType([T.StructField(odd.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
    return df.toDF(*[odd.get(c, c) for c in df.columns]).mapInArrow(tidy(run), inner).toDF(*schema.names)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, unless the session sets their bound itself.

    By default a batch is 10,000 rows: of texts that is tens of megabytes, doubled while they
    are gathered, for each running task. The setting stays, as frames are run after we return.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as it may not be installed there."""
    small_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(prefix="colsonde-"), "colsonde-src.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "colsonde")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between runs of ASCII white space, unchanged."""
    return F.array_remove(F.split(text, WHITE_RUN, -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; a plain ``lower`` where the text is ASCII anyway."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )
