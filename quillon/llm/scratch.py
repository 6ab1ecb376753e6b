"""Intermediate tables of the operators in the folder that driver and executors share, and joins with hot keys."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import drop, forget, keep, register, release, shared_dir

__all__ = ["bound_batches", "columns", "hot_keys", "keep", "keep_bucketed", "named", "release", "salted_join", "shared_dir", "sized", "unused"]

_tables: list[tuple[SparkSession, str]] = []


def keep_bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """Like ``keep``, in as many buckets of ``key`` as the session has shuffle partitions: joined by it, the table isn't moved.

    Returns the table and a function that deletes it; what isn't deleted goes with the session.
    Buckets need a name in the session's catalogue. Where ``key`` numbers batches of a task, the table
    has a file for each batch at most.
    """
    spark = df.sparkSession
    own = f"quillon_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quillon/{own}"
    register(spark, path)
    _tables.append((spark, own))
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    writer.saveAsTable(own)

    def delete() -> None:
        spark.sql(f"drop table if exists {own}")
        forget(spark, path)
        _tables[:] = [x for x in _tables if x[1] != own]

    return spark.table(own), delete


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until none is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [named(c) for c in df.columns]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


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


#: Rows of a narrow table (ids, digests, numbers) up to which it is broadcast: some 50 MB.
BROADCAST_ROWS = 500_000


def sized(small: DataFrame, name: str) -> DataFrame:
    """``small``, a narrow table, kept and counted: to be broadcast if it is small enough, else to be joined by shuffling."""
    held = keep(small, name)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


#: A key is hot with more rows than the first number and than all rows over the second: so there are fewer hot keys than that.
HOT_ROWS, HOT_KEYS = 512, 20_000


def hot_keys(rows: DataFrame, key: str, name: str) -> DataFrame | None:
    """key and _salts for the keys of ``rows``, a kept table, with so many rows that they must be split; None if there are none."""
    limit = max(HOT_ROWS, rows.count() // HOT_KEYS)
    found = keep(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")), name)
    return F.broadcast(found) if found.limit(1).count() else None  # fewer than HOT_KEYS rows


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` with the row of their key in ``table``, which has one for each: rows of a hot key are dealt by ``by`` to copies of it."""
    if hot is None:
        return rows.join(table, key)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


@atexit.register
def _clean() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"drop table if exists {name}")
        except Exception:  # noqa: BLE001  the session is gone, and its catalogue with it
            return
