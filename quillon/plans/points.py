"""Queries on point files that are made of the tables: scans, upserts and resumed copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources import points
from quillon.sources.scratch import register, shared_dir
from quillon.sources.tables import table

BUCKETS = 16


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with the session."""
    path = f"{shared_dir(spark)}/quillon/points-{uuid.uuid4().hex}"
    register(spark, path)
    return path


def document_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as points: the source as record, the text as payload, without vectors."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc-"), "doc_id").alias("point_id"), F.col("source").alias("query_id"), F.col("lang").alias("language"), F.col("text").alias("payload"), F.lit(None).cast("array<float>").alias("vector"))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark)
    points.upsert(document_points(spark, sf_dir), path, BUCKETS)
    return path


@query("SELECT doc_id AS seq, 'doc-' || doc_id AS point_id, source AS query_id, md5(text) AS payload FROM documents WHERE doc_id > (SELECT max(doc_id) // 2 FROM documents) AND lang = 'en'")
def point_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English points of the upper half of the ids, where both conditions are met in the files."""
    path = _stored(spark, sf_dir)
    half = points.read(spark, path, ["seq"]).agg(F.max("seq")).first()[0] // 2
    found = points.read(spark, path, ["seq", "point_id", "query_id", "language", "payload"]).where((F.col("seq") > half) & (F.col("language") == "en"))
    return found.select("seq", "point_id", "query_id", F.md5("payload").alias("payload"))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000 ELSE doc_id END AS seq, 'doc-' || doc_id AS point_id, CASE WHEN doc_id % 3 = 0 THEN 'moved' ELSE lang END AS language FROM documents
UNION ALL SELECT doc_id + 2000000, 'new-' || doc_id, NULL FROM documents WHERE doc_id % 7 = 0""")
def point_file_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points after a second write: every third replaced, every third tried with an older one, every seventh added."""
    path = _stored(spark, sf_dir)
    rows = document_points(spark, sf_dir)
    newer = rows.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000).withColumn("language", F.lit("moved"))
    older = rows.where("seq % 3 = 1").withColumn("seq", F.col("seq") - 1_000_000).withColumn("language", F.lit("late"))
    added = rows.where("seq % 7 = 0").withColumn("point_id", F.concat(F.lit("new-"), "seq")).withColumn("seq", F.col("seq") + 2_000_000).withColumn("language", F.lit(None).cast("string"))
    points.upsert(newer.unionByName(older).unionByName(added), path)
    return points.read(spark, path, ["seq", "point_id", "language"])


@query("SELECT doc_id AS seq, 'doc-' || doc_id AS point_id, md5(text) AS payload FROM documents")
def point_file_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy made by a stream in two runs, the second of which goes on where the first was stopped."""
    source, target, checkpoint = _stored(spark, sf_dir), _folder(spark), _folder(spark)
    n = sum(f["rows"] for f in points.snapshot(source)["files"])
    for _ in range(2):
        points.copy(spark, source, target, checkpoint, max_points=n // 2 + 1, buckets=BUCKETS)
    return points.read(spark, target, ["seq", "point_id", "payload"]).select("seq", "point_id", F.md5("payload").alias("payload"))


@query("SELECT k.point_id, CAST(d.doc_id AS BIGINT) AS seq, length(d.text) AS n FROM (SELECT 'doc-' || item_id * 3 AS point_id, item_id * 3 AS doc_id FROM benchmark UNION SELECT 'none-' || item_id, -1 FROM benchmark) k LEFT JOIN documents d ON d.doc_id = k.doc_id")
def point_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked ids with their points, null where there is none: asked for in the files of their buckets alone."""
    path = _stored(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.concat(F.lit("doc-"), F.col("item_id") * 3), F.concat(F.lit("none-"), "item_id"))).alias("point_id")).distinct()
    return asked.join(points.lookup(asked, path, ["seq", "point_id", "payload"]), "point_id", "left").select("point_id", "seq", F.length("payload").alias("n"))
