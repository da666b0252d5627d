"""Session set-up, shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# Largest table that is sent whole to every executor, in rows and in bytes.  Callers check the real
# size against them (see `bounded_broadcast`) instead of trusting an estimate.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


def build_session(app_name: str = "seriesmill", cores: str = "8", partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Capturing the call site of every Python column call costs more than small jobs.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stored intermediate tables.

    The cluster names it in `spark.checkpoint.dir`.  Only a local session, where driver
    and executors are one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = configured or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


# What each application has written under its scratch folder.
_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Removes the stored steps of this application, and returns how many there were.

    To be called when the results are written: until then frames read these steps.  Checkpoints
    are removed by Spark itself (`spark.cleaner.referenceTracking.cleanCheckpoints`).
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(value: Column, kind: DataType) -> Column:
    """About the bytes of a value: texts and binaries by their length, arrays and maps by their elements."""
    eight = F.lit(8).cast("long")
    if isinstance(kind, (StringType, BinaryType)):
        return eight + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, StructType):
        return sum((row_bytes(value[f.name], f.dataType) for f in kind.fields), start=eight)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StringType, BinaryType)):
        return eight + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, v: n + F.lit(8) + F.coalesce(F.octet_length(v), F.lit(0))), F.lit(0))
    if isinstance(kind, (ArrayType, MapType)):
        return eight + F.lit(32) * F.greatest(F.size(value), F.lit(0))
    return eight


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the table really is small, in rows and bytes; otherwise a shuffled join.

    The table is evaluated for the check: one that is not stored yet should be cheap.
    """
    width = sum((row_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), start=F.lit(0).cast("long"))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def folder_values(spark: SparkSession, root: str, column: str) -> list[str]:
    """Values of the partition folders `<root>/<column>=...`, from a listing of the folder alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(path))
    return [n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}=")]
