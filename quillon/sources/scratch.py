"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session, else the checkpoint folder that was set on
the context. Where neither is set, a local session (driver and tasks in one process, as in tests)
gets a temporary folder of its own; on a cluster it is an error, as a machine's own folder would
hold only what its own tasks write. Intermediate tables cut lineage: when an executor is lost, its
tasks reread them.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    context = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own[context.applicationId]


def register(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the session's process ends."""
    _made.append((spark, path))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a registered folder now."""
    drop(spark, path)
    _made[:] = [x for x in _made if x[1] != path]


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    register(spark, path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch: what a Python worker and its executor hold at once of a table with long texts.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ``BATCH_BYTES``, if it is above."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = spark.conf.get(name).strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(value[-1:], 1)
    size = int(value.rstrip("kmg") or -1) * unit
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def paths(df: DataFrame) -> list[str]:
    """Folders in the shared folder that ``df`` itself reads."""
    found = set()
    for f in df.inputFiles():
        found |= {p for s, p in _made if p.split("://")[-1].rstrip("/") in f}
    return sorted(found)


def release(df: DataFrame) -> None:
    """Delete the table that ``keep`` wrote; only when nothing reads it any more."""
    for p in paths(df):
        forget(df.sparkSession, p)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and its folder with it
            return
