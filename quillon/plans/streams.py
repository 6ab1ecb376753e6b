"""Queries that run as streams over the tables, to their end, and give what batches would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import lexical, maturity
from quillon.plans.points import _folder
from quillon.plans.registry import query
from quillon.plans.retrieval import BM25_SQL, KEYS, QUERIES_SQL
from quillon.plans.sessions import GATE_SQL, partials
from quillon.sources.scratch import keep
from quillon.sources.scratch import paths as kept_paths
from quillon.sources.tables import benchmark_queries, documents, table
from quillon.streaming import state, validation


def _read_stream(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a stream of files."""
    held = keep(df, name)
    (path,) = kept_paths(held)
    return df.sparkSession.readStream.schema(held.schema).parquet(path)


def _drained(stream: DataFrame) -> DataFrame:
    """All rows that a stream gives until its input ends."""
    spark = stream.sparkSession
    out, check = _folder(spark), _folder(spark)
    with state.state_store(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {GATE_SQL} SELECT session_id, seq, decision, count(*) OVER p AS received, count(*) FILTER (decision = 'prefiltered') OVER p AS prefiltered FROM gate WINDOW p AS (PARTITION BY session_id ORDER BY seq)")
def partials_gate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate as keyed state, with the counters as they stood at each partial."""
    rows = partials(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("seq")))
    found = _drained(state.session_stream(_read_stream(rows, "partials"), late="1 day"))
    return found.where("decision <> 'closed'").select("session_id", "seq", "decision", "received", "prefiltered")


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'error') AS a, min(ts) FILTER (value > 90) AS b FROM events GROUP BY 1),
n AS (SELECT *, coalesce(abs(epoch_us(a) - epoch_us(b)) <= 86400000000, false) AS near FROM f)
SELECT user_id, a AS first_a, b AS first_b, greatest(a, b) AS both_at FROM n WHERE near UNION ALL SELECT user_id, a, NULL, NULL FROM n WHERE a IS NOT NULL AND NOT near UNION ALL SELECT user_id, NULL, b, NULL FROM n WHERE b IS NOT NULL AND NOT near""")
def dual_condition_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first error and first value above 90 as two streams, together if they are within a day, else each alone."""
    events = table(spark, sf_dir, "events")
    kind = events.schema["ts"].dataType

    def first(condition: str, name: str) -> DataFrame:
        own = events.where(condition).groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("at"))
        last = spark.range(1).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.timestamp_seconds(F.lit(32_503_680_000)).alias("at"))  # ends the waiting of all others
        return _read_stream(own.unionByName(last), name)

    found = _drained(state.release_join(first("event_type = 'error'", "errors"), first("value > 90", "values"), within="1 day", session="user_id"))
    return found.where("user_id >= 0").select("user_id", *(F.col(a).cast(kind).alias(b) for a, b in (("speech_end_at", "first_a"), ("mature_at", "first_b"), ("both_at", "both_at"))))


_HALF = "array_to_string(list_slice(string_split(query, ' '), 1, CAST(ceil(len(string_split(query, ' ')) / 2.0) AS BIGINT)), ' ')"


@query(f"""WITH {QUERIES_SQL.replace("q AS (", "q0 AS (", 1)},
q AS (SELECT 't' || query_key AS query_key, query FROM q0 UNION ALL SELECT 'f' || query_key, {_HALF} FROM q0 WHERE query_key % 2 = 0 AND contains(query, ' ')){BM25_SQL[len(QUERIES_SQL):]},
ls AS (SELECT query_key, list(doc_id ORDER BY rank) AS ids, arg_min(lang, rank) AS top_lang FROM lex JOIN documents USING (doc_id) GROUP BY 1),
j AS (SELECT q0.query_key, q0.query_key % 2 = 0 AND contains(query, ' ') AS changed, coalesce(a.ids, []) AS ti, coalesce(b.ids, []) AS fi, a.top_lang AS tl, b.top_lang AS fl FROM q0 LEFT JOIN ls a ON a.query_key = 't' || q0.query_key LEFT JOIN ls b ON b.query_key = 'f' || q0.query_key),
k AS (SELECT *, NOT changed OR (len(ti) > 0 AND len(fi) > 0 AND (ti[1] = fi[1] OR (tl IS NOT DISTINCT FROM fl AND len(list_intersect(ti, fi)) > 0))) AS trusted_reused FROM j)
SELECT query_key, changed, trusted_reused, array_to_string(CASE WHEN trusted_reused THEN ti ELSE fi END, ',') AS evidence FROM k""")
def final_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as sessions whose trusted list is that of the whole text, with every second final half as long: a stream retrieves for these alone."""
    docs, path = documents(spark, sf_dir), _folder(spark)
    lexical.save_index(docs, path, KEYS)
    retrieve = validation.index_lists(path, docs, "doc_id", "lang")
    items = benchmark_queries(spark, sf_dir)
    lists = retrieve(items).withColumnRenamed("final", "trusted")
    trusted = keep(items.join(lists, "query_key", "left").select(F.col("query_key").alias("session_id"), F.col("query").alias("partial"), F.coalesce("trusted", F.expr(f"cast(array() as {maturity.LIST})")).alias("trusted")), "trusted")
    words = F.split("query", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.ceil(F.size(words) / 2).cast("int")), " ")
    finals = items.select(F.col("query_key").alias("session_id"), F.when(F.col("query_key") % 2 == 0, half).otherwise(F.col("query")).alias("transcript"))
    out = _folder(spark)
    validation.validation_stream(_read_stream(finals, "finals"), lambda: trusted, retrieve, out, _folder(spark)).awaitTermination()
    evidence = F.array_join(F.transform("evidence", lambda r: r["provenance"]), ",")
    return spark.read.parquet(out).select(F.col("session_id").alias("query_key"), "changed", "trusted_reused", evidence.alias("evidence"))
