"""Parquet tables of points with an index: files in ranges of language and record, Bloom filters on ids.

A record's points lie in few neighbouring files, which the least and greatest values in the files'
footers find; a point's id is looked up in the Bloom filters of row groups, and row groups without it
are never read. A record with very many points is cut by id into several files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids up to which a lookup is a filter that reaches the files; more are joined.
PUSHED = 64
#: Bytes of a row group before compression: the least that a lookup reads.
ROW_GROUP = 16 << 20


def write(rows: DataFrame, path: str, id_col: str = "point_id", keys: tuple[str, ...] = ("language", "query_id"), files: int | None = None, row_group: int = ROW_GROUP, ids_in_group: int = 100_000) -> None:
    """Write ``rows`` in as many ``files`` as shuffle partitions by default; ``ids_in_group`` sizes the Bloom filters."""
    n = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, id_col]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    writer = dealt.write.option("parquet.block.size", str(row_group)).option(f"parquet.bloom.filter.enabled#{id_col}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{id_col}", str(ids_in_group)).parquet(path)


def any_of(column: str, values: list) -> Column:
    """Whether the column is one of ``values``, as equalities: each is looked up in the index, which a long ``IN`` list is not."""
    return reduce(lambda a, b: a | b, (F.col(column) == v for v in values), F.lit(False))


def find(spark: SparkSession, path: str, asked: DataFrame, id_col: str = "point_id") -> DataFrame:
    """The points whose ids are in ``asked``: up to ``PUSHED`` ids by the Bloom filters, more by a join."""
    wanted = asked.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    few = wanted.limit(PUSHED + 1).collect()
    table = spark.read.parquet(path)
    return table.where(any_of(id_col, [r[0] for r in few])) if len(few) <= PUSHED else table.join(wanted, id_col, "left_semi")


def of_record(spark: SparkSession, path: str, language: str, record: object, keys: tuple[str, str] = ("language", "query_id")) -> DataFrame:
    """All points of one record, from the files in whose range it lies."""
    return spark.read.parquet(path).where((F.col(keys[0]) == language) & (F.col(keys[1]) == record))


def check(spark: SparkSession, path: str, keys: tuple[str, ...] = ("language", "query_id")) -> DataFrame:
    """A row for each file of a written table: file, rows, first and last keys, in_order: whether it begins where the file before ends, or later."""
    key = F.struct(*keys)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    before = F.lag("last").over(Window.orderBy("first", "last"))  # a row for each file
    return files.select("file", "rows", "first", "last", F.coalesce(before <= F.col("first"), F.lit(True)).alias("in_order"))
