"""Queries on whole flows: records to stored points, a second language beside a first, indexed tables, measured answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import answers, indexing, measure
from quillon.plans.corpus import _UUID_SQL, _chunks_sql
from quillon.plans.points import _folder, document_points
from quillon.plans.registry import query
from quillon.plans.retrieval import COMPOSE_SQL, _composed
from quillon.sources import indexed, points
from quillon.sources.tables import records, table

_SELECTED = "EXISTS (FROM pas p WHERE p.query_id = ch.query_id AND p.passage_index = ch.passage_index AND p.is_selected = 1)"


def _points_sql(size: int, code: str, where: str) -> str:
    """Chunks as points with the identifiers of the two-language store."""
    return rf"""WITH {_chunks_sql(size)}, co AS (SELECT ch.*, {code} AS language, {_SELECTED} AS chosen FROM ch JOIN rec ON rec.doc_id = ch.query_id WHERE {where}),
h AS (SELECT *, sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode('msmarco-xi-bilingual-compact:language=' || language || '|query_id=' || query_id || '|passage_index=' || passage_index || '|chunk_index=' || chunk_index || '|chunk_strategy=' || chunk_strategy)) AS h FROM co)
SELECT {_UUID_SQL} AS point_id, CAST(query_id AS VARCHAR) AS query_id, language, CAST(chosen AS INTEGER) AS is_selected, token_count, md5(text) AS text_md5, 768 AS dimension FROM h"""


def _read(spark: SparkSession, path: str) -> DataFrame:
    p = F.from_json("payload", indexing.PAYLOAD)
    held = points.read(spark, path, ["point_id", "query_id", "language", "payload", "vector"]).withColumn("_p", p)
    return held.select("point_id", "query_id", "language", "_p.is_selected", "_p.token_count", F.md5("_p.text").alias("text_md5"), F.size("vector").alias("dimension"))


@query(_points_sql(64, "'en'", "len(lines) % 5 <> 0"))
def index_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents chunked, embedded and upserted in one flow, read back from the store; records with 5, 10, ... lines are malformed."""
    rows = records(spark, sf_dir)
    rows = rows.withColumn("is_selected", F.when(F.size("passages") % 5 == 0, F.slice("is_selected", F.lit(1), F.size("passages") - 1)).otherwise(F.col("is_selected")))
    path = _folder(spark)
    indexing.index(rows, path, F.lit("en"), max_tokens=64, size=768)
    return _read(spark, path)


@query(f"FROM ({_points_sql(256, chr(39) + 'en' + chr(39) + ' ', 'lang = ' + chr(39) + 'en' + chr(39))}) WHERE is_selected = 1 UNION ALL FROM ({_points_sql(64, chr(39) + 'hi' + chr(39), 'lang <> ' + chr(39) + 'en' + chr(39))}) WHERE is_selected = 1")
def index_two_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected points of a first language, here all but English, copied with their vectors, and English embedded beside them."""
    rows = records(spark, sf_dir)
    source, target = _folder(spark), _folder(spark)
    indexing.index(rows.where("source_lang <> 'en'"), source, F.lit("hi"), max_tokens=64, size=768)
    indexing.add_language(spark, source, target, rows.where("source_lang = 'en'"), "en", bytes_per_point=4096, limit_gib=float(1 << 20), size=768)
    return _read(spark, target)


@query("SELECT 'doc-' || doc_id AS point_id, doc_id AS seq, lang AS language, source AS query_id FROM documents WHERE doc_id % 20 = 0")
def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all ids that 20 divides, and of as many that aren't there, from a table with an index."""
    path = _folder(spark)
    rows = document_points(spark, sf_dir).drop("vector")
    indexed.write(rows, path)
    asked = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.explode(F.array(F.concat(F.lit("doc-"), "doc_id"), F.concat(F.lit("none-"), "doc_id"))).alias("point_id"))
    return indexed.find(spark, path, asked).select("point_id", "seq", "language", "query_id")


@query("SELECT count(*) AS rows, count(DISTINCT (lang, source)) AS records, TRUE AS in_order FROM documents")
def indexed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table as its files have it: rows, records, and whether the files' ranges follow each other."""
    path = _folder(spark)
    indexed.write(document_points(spark, sf_dir).drop("vector"), path)
    files = indexed.check(spark, path).agg(F.sum("rows").alias("rows"), F.bool_and("in_order").alias("in_order"))
    return files.crossJoin(spark.read.parquet(path).select(F.count_distinct(F.struct("language", "query_id")).alias("records"))).select("rows", "records", "in_order")  # a row each


@query(f"""WITH {COMPOSE_SQL}, r AS (SELECT count(*) AS n FROM ans)
SELECT 'retrieve' AS stage, n AS rows_written, TRUE AS measured, 0::BIGINT AS no_answers FROM r UNION ALL SELECT 'compose', n, TRUE, (SELECT count(*) FILTER (is_no_answer) FROM ans) FROM r""")
def measured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval and composition of all benchmark queries in one measured pass: rows of each, and whether times and bytes were told."""
    done, report = measure.measured(spark, {"retrieve": lambda _: _composed(spark, sf_dir), "compose": answers.compose})
    told = (F.col("write_ms") > 0) & (F.col("ms") >= F.col("write_ms")) & (F.col("bytes_written") > 0) & (F.col("rows_read") > 0)
    none = done.agg(F.count_if("is_no_answer").alias("no_answers"), F.lit("compose").alias("stage"))
    return report.select("stage", "rows_written", told.alias("measured")).join(none, "stage", "left").na.fill(0, ["no_answers"])
