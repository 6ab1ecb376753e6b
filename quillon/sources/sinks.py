"""Point tables: creation, validation, upserts and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from quillon.functions.ids import UUID_PATTERN
from quillon.functions.vectors import is_valid
from quillon.sources.scratch import drop, keep, release


def last_per_id(rows: DataFrame, id_col: str, seq: str) -> DataFrame:
    """The last write of each id."""
    rest = [c for c in rows.columns if c != id_col]
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(id_col, "_r.*")


def upserted(existing: DataFrame, new: DataFrame, id_col: str, seq: str) -> DataFrame:
    """``existing`` with the rows of ``new``: equal ids are replaced by their last write."""
    latest = last_per_id(new, id_col, seq)
    return existing.join(latest.select(id_col), id_col, "left_anti").unionByName(latest, allowMissingColumns=True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, id_col: str, seq: str, partition_by: str = "language") -> int:
    """Upsert into the Parquet table at ``path``. Returns the ids written.

    Only partitions that hold the new rows, or held their ids before, are rewritten. They are made
    ready beside the table first, so that a run that ends in between is finished by the next one.
    """
    _finish_upsert(spark, path, partition_by)
    latest = keep(last_per_id(new, id_col, seq), "upsert")
    written = latest.count()
    if not table_exists(spark, path):
        latest.write.partitionBy(partition_by).parquet(path)
        return written
    held = _read_partitioned(spark, path, latest.schema)
    before = held.join(latest.select(id_col), id_col, "left_semi").select(partition_by)
    touched = keep(latest.select(partition_by).union(before).distinct(), "touched")  # partitions, not rows
    own = held.alias("h").join(F.broadcast(touched.withColumnRenamed(partition_by, "_value")), F.col(f"h.{partition_by}").eqNullSafe(F.col("_value")), "left_semi")
    merged = own.join(latest.select(id_col), id_col, "left_anti").unionByName(latest, allowMissingColumns=True)
    merged.write.mode("overwrite").parquet(f"{path}.next/rows")
    touched.write.mode("overwrite").parquet(f"{path}.next/touched")
    _finish_upsert(spark, path, partition_by)
    release(latest)
    return written


def _read_partitioned(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table with the types of ``schema``, which its folders' names don't tell, and its further columns."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([*schema.fields, *(f for f in found.fields if f.name not in schema.names)])).parquet(path)


def _finish_upsert(spark: SparkSession, path: str, partition_by: str) -> None:
    """Put partitions that were made ready into the table; those that have no rows any more go."""
    ready = f"{path}.next"
    if not table_exists(spark, f"{ready}/touched/_SUCCESS"):
        return
    rows = spark.read.parquet(f"{ready}/rows")
    value = F.col(partition_by)
    empty = [r[0] for r in spark.read.parquet(f"{ready}/touched").join(rows.select(value.alias("_v")), value.eqNullSafe(F.col("_v")), "left_anti").collect()]
    held = _read_partitioned(spark, path, rows.schema)
    folders = {r[0].rsplit("/", 1)[0] for v in empty for r in held.where(value.eqNullSafe(F.lit(v))).select(F.input_file_name()).distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    for folder in [*folders, ready]:
        drop(spark, folder)


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def vector_size_errors(points: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """One row: how many vectors have another length, or values that aren't finite."""
    v = F.col(vector)
    return points.agg(F.count_if(F.coalesce(F.size(v), F.lit(0)) != size).alias("wrong_size"), F.count_if((F.size(v) == size) & ~is_valid(v, size)).alias("not_finite"))


def valid_points(points: DataFrame, size: int, id_col: str = "point_id", vector: str = "vector") -> DataFrame:
    """Rows with a UUID, a vector of finite values of the right length and a payload."""
    return points.where(F.col(id_col).rlike(UUID_PATTERN) & is_valid(F.col(vector), size))


def create_collection(points: DataFrame, path: str, size: int, reset: bool = False, partition_by: str = "language") -> None:
    """Write a new table after checking its vectors; an existing one is an error unless ``reset``."""
    check_target(points, size)
    points.write.mode("overwrite" if reset else "errorifexists").partitionBy(partition_by).parquet(path)


def lookup(points: DataFrame, ids: DataFrame, id_col: str, strict: bool = False) -> DataFrame:
    """Payloads of the asked ids; an id that isn't there has a null payload and ``found`` false, or is an error if ``strict``."""
    absent = F.raise_error(F.concat(F.lit("no such point: "), F.col(id_col).cast("string"))).cast("boolean") if strict else F.lit(False)
    return ids.join(points.withColumn("_found", F.lit(True)), id_col, "left").withColumn("found", F.when(F.col("_found"), True).otherwise(absent)).drop("_found")


def points_of(points: DataFrame, query_id: object, column: str = "query_id") -> DataFrame:
    """All points of one record, by a filter that is pushed down into the scan."""
    return points.where(F.col(column) == query_id)


def check_target(points: DataFrame, size: int, vector: str = "vector") -> None:
    """An error unless ``points`` has one dense vector column, ``vector``, all of whose values have ``size`` finite numbers."""
    dense = [f.name for f in points.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (FloatType, DoubleType))]
    if dense != [vector]:
        raise ValueError(f"one dense vector column {vector!r} is expected, not {dense}")
    wrong = vector_size_errors(points, size, vector).first()
    if wrong["wrong_size"] or wrong["not_finite"]:
        raise ValueError(f"{wrong['wrong_size']} vectors of another size, {wrong['not_finite']} with values that aren't finite")


def after(points: DataFrame, seq: str, checkpoint: int | None, most: int | None = None) -> DataFrame:
    """Rows after a checkpoint, in order; a filter that Parquet's statistics prune by."""
    rows = points if checkpoint is None else points.where(F.col(seq) > checkpoint)
    return rows.orderBy(seq).limit(most) if most is not None else rows


def copy_points(spark: SparkSession, source: str, target: str, checkpoint: str, seq: str = "seq", most: int | None = None, dry_run: bool = False) -> int:
    """Copy the next ``most`` points of a table after the checkpoint; returns how many there are, copied or, in a dry run, not.

    The checkpoint names source and target, and one of others is refused. A copy that ended before
    its checkpoint was written is written anew into the same folder, so nothing is doubled.
    """
    last = None
    if table_exists(spark, checkpoint):
        held = spark.read.schema("source string, target string, last long").json(checkpoint).agg(F.max("last").alias("last"), F.count_if((F.col("source") != source) | (F.col("target") != target)).alias("foreign")).first()
        if held["foreign"]:
            raise ValueError(f"{checkpoint} is the checkpoint of another copy")
        last = held["last"]
    rows = after(spark.read.parquet(source), seq, last, most)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(seq).alias("last")).first()
    if dry_run or not found["n"]:
        return found["n"]
    rows.write.mode("overwrite").parquet(f"{target}/after={'start' if last is None else last}")
    spark.range(1).select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(found["last"]).alias("last")).write.mode("append").json(checkpoint)
    return found["n"]


def first_text(index: DataFrame, texts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key and the first text that isn't blank of each key in the index."""
    w = Window.partitionBy(key).orderBy(order)
    filled = texts.where(F.trim(F.coalesce(text, F.lit(""))) != "").join(index.select(key).distinct(), key, "left_semi")
    return filled.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(key, text)


def json_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)
