"""Operator 3, exact deduplication with a heavy-hitter split.

1. Every text is replaced by its SHA-256 digest in a table (id, digest) in the shared folder.
2. Misra-Gries summaries of ``counters`` entries, one for each task, find candidates for frequent
   digests; their lower bounds are added up by digest and the ``counters`` largest kept.
3. The candidates are verified: one pass with map-side sums counts them exactly and finds their
   winner. Those with more than 2 / counters of all rows, fewer than ``counters`` / 2, are broadcast.
4. Rows with a broadcast digest get their winner on the map side, without a shuffle; all other
   rows are shuffled by digest, where no group is larger than 2 / counters of all rows.

Defined results
  null text counts as empty; texts are equal when identical, with no normalisation.
  the row with the largest id stays; among repeated ids each row with the largest id is kept.
  null id: smaller than any other; a group of null ids only keeps its rows.
  empty table: empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.scratch import keep, named, sized, unused

COUNTERS = 4096


def misra_gries(batches: Iterator[list], counters: int) -> dict:
    """Misra-Gries summary of all items: at most ``counters`` entries with lower bounds of counts.

    An entry's bound is at most n / (counters + 1) below its count, so every item that is more
    frequent than that is in the summary.
    """
    held: Counter = Counter()
    for items in batches:
        held.update(items)
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = Counter({x: c - cut for x, c in held.items() if c > cut})
    return held


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Frequent digests of (id, digest): digest, keep_id, group_size; fewer than ``counters`` / 2 rows."""
    spark = digests.sparkSession

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((b.column(0).to_pylist() for b in batches), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "bound"])

    bounds = digests.select("digest").mapInArrow(summary, "digest binary, bound long").groupBy("digest").agg(F.sum("bound").alias("bound"))
    top = bounds.orderBy(F.desc("bound"), "digest").limit(counters).where("bound > 1").select("digest").collect()
    total = digests.count()
    schema = T.StructType([T.StructField("digest", T.BinaryType())])
    asked = F.broadcast(spark.createDataFrame([(bytes(r.digest),) for r in top], schema))
    exact = digests.join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = exact.where(F.col("group_size") * counters > 2 * total).collect()
    return spark.createDataFrame([(bytes(r.digest), r.keep_id, r.group_size) for r in found], T.StructType([*schema.fields, T.StructField("keep_id", digests.schema["id"].dataType), T.StructField("group_size", T.LongType())]))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``df``: id_col, keep_id, group_size, kept, text_sha256."""
    digests = keep(df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")), "digests")
    heavy = heavy_digests(digests, counters)
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    mapped = marked.where("group_size is not null")
    same = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(heavy), "digest", "left_anti").withColumn("keep_id", F.max("id").over(same)).withColumn("group_size", F.count(F.lit(1)).over(same))
    return mapped.unionByName(rest).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of rows with equal id and text, one.

    Only ids and digests are joined: broadcast if they are few, else with the texts shuffled once.
    """
    groups = keep(exact_groups(df, id_col, text_col, counters).select(named(id_col).alias("id"), "kept", F.unhex("text_sha256").alias("digest")), "groups")
    own_id, own_digest = unused(df, "_id", "_digest")
    narrow = lambda rows: rows.select(F.col("id").alias(own_id), F.col("digest").alias(own_digest))
    digest = F.unhex(F.sha2(F.coalesce(named(text_col), F.lit("")), 256))
    same = named(id_col).eqNullSafe(F.col(own_id)) & (digest == F.col(own_digest))
    kept = df.join(sized(narrow(groups.where(~F.col("kept")).distinct()), "gone"), same, "left_anti")
    repeated = sized(narrow(groups.where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, same, "left_semi").withColumn(own_digest, digest).dropDuplicates([id_col, own_digest]).drop(own_digest)
    return kept.join(repeated, same, "left_anti").unionByName(once)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all ``documents``."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
