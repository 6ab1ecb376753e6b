"""Final transcripts against what their sessions already trust: only changed ones are retrieved for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillon.functions.text import normalize_space
from quillon.operators import lexical, maturity
from quillon.sources.scratch import keep, release

Retrieve = Callable[[DataFrame], DataFrame]


def said(text: Column | str) -> Column:
    return F.lower(F.coalesce(normalize_space(text), F.lit("")))


def index_lists(path: str, docs: DataFrame, key: str, family: str, k: int = 5) -> Retrieve:
    """Retrieval from an index that ``lexical.save_index`` wrote: query_key and ``final``, the list of each query; ``docs`` gives the families."""
    families = docs.select(key, F.col(family).alias("_family"))

    def retrieve(queries: DataFrame) -> DataFrame:
        found = lexical.search_index(queries, path, [key], k).select("query_key", key, "rank")
        row = F.struct("rank", F.col("_family").alias("query_id"), F.col(key).cast("string").alias("provenance"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("semantic_score"))
        return found.join(families, key).groupBy("query_key").agg(F.array_sort(F.collect_list(row)).alias("final"))

    return retrieve


def validate_finals(finals: DataFrame, trusted: DataFrame, retrieve: Retrieve) -> DataFrame:
    """session_id, changed, trusted_reused, evidence.

    finals: session_id, transcript. trusted: session_id, partial (what the trusted list was retrieved
    for), trusted (the list). A final that says what the trusted partial said keeps the trusted list
    and asks nothing. Any other, and that of a session without a trusted list, is retrieved for: the
    trusted list stays only if the new one confirms it.
    """
    none = F.expr(f"cast(array() as {maturity.LIST})")
    rows = finals.select("session_id", "transcript").join(trusted.select("session_id", "partial", "trusted"), "session_id", "left")
    marked = keep(rows.withColumn("changed", F.col("partial").isNull() | F.col("trusted").isNull() | (said("transcript") != said("partial"))), "finals")
    asked = marked.where("changed").select(F.col("session_id").alias("query_key"), F.col("transcript").alias("query"))
    found = retrieve(asked).select(F.col("query_key").alias("session_id"), "final")
    again = marked.where("changed").join(found, "session_id", "left").withColumns({"trusted": F.coalesce("trusted", none), "final": F.coalesce("final", none)})
    checked = maturity.validated(again).select("session_id", "changed", "trusted_reused", "evidence")
    same = marked.where("not changed").select("session_id", "changed", F.lit(True).alias("trusted_reused"), F.col("trusted").alias("evidence"))
    return checked.unionByName(same)


def validation_stream(finals: DataFrame, trusted: Callable[[], DataFrame], retrieve: Retrieve, target: str, checkpoint: str) -> StreamingQuery:
    """Validate the finals of each micro-batch in one retrieval, into ``target``; ``trusted`` gives the table as it stands then.

    A batch that is run again writes its own folder again.
    """

    def each(batch: DataFrame, number: int) -> None:
        own = keep(batch, "batch")
        validate_finals(own, trusted(), retrieve).write.mode("overwrite").parquet(f"{target}/batch={number}")
        release(own)

    return finals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
