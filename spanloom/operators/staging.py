"""Cutting lineage with tables in the folder all executors share, and broadcasts of measured tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if its measured rows take at most so many bytes.
BROADCAST_BYTES = 16 << 20
_OWN: dict[str, str] = {}
_SCRATCH: set[str] = set()


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or where it is unset and all runs in one process, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _OWN.setdefault(app, _OWN.get(app) or f"file://{tempfile.mkdtemp(prefix='spanloom-')}")
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of this application's own that goes when its driver ends."""
    own = f"{stage_dir(spark)}/spanloom/{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH.add(own)
        atexit.register(_clear, spark._jvm, spark._jsc.hadoopConfiguration(), own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _clear(jvm, conf, path: str) -> None:
    """Deletes a folder while the driver's JVM is still there; else it stays for whoever tidies the shared folder."""
    with contextlib.suppress(Exception):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost no recomputation beyond it. What unstage() does not
    delete earlier goes with the application."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Deletes what staged() wrote, for tables that no later step reads."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets tasks hand rows to Python in Arrow batches of at most so many bytes: the default of 64 MB is held several times, in the JVM and in Python.

    Only Spark's own default is lowered; a session that says something else keeps it. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == f"{64 << 20}b":
        spark.conf.set(name, f"{most}b")


def _width(c: Column, kind: T.DataType) -> Column:
    """The bytes that a value takes in memory, nested values by their number of elements and the elements' fixed parts."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType)) or isinstance(inner, T.StructType) and any(not isinstance(f.dataType, T.NumericType) for f in inner.fields):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + _width(x, inner)), F.lit(16).cast("long"))
        each = 8 * len(inner.fields) + 24 if isinstance(inner, T.StructType) else 8
        return F.coalesce(F.size(c), F.lit(0)) * each + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """The bytes that the rows of df take in memory, by one aggregate over them."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if its measured rows are within the limit of bytes, else df as it is."""
    return F.broadcast(df) if table_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df


shared_dir = stage_dir
