"""Records into stored points in one flow, and a second language beside a first one.

A flow keeps its chunks as a table, embeds each of them once, in the write itself, and upserts all
points in one commit of the store: a flow that is stopped has changed nothing, and run again it
writes the same points. Counts are taken from the kept tables, not from counters of tasks, which
would count a task twice that a lost executor repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.operators import chunking, dense, ingest, policies
from quillon.sources import points
from quillon.sources.scratch import keep, release

Load = Callable[[], Callable[[list[str]], np.ndarray]]
#: What a payload holds beside the columns of the store.
PAYLOAD = "text string, query_id string, passage_index int, chunk_index int, chunk_strategy string, is_selected int, token_count long, language string, target_lang string"


def _next_seq(path: str) -> int:
    """Above every seq of the store, so that the points of a flow are newer than all that is there."""
    state = points.snapshot(path)
    return max((f["last"] for f in state["files"]), default=-1) + 1 if state else 0


def as_points(chunks: DataFrame, first_seq: int) -> DataFrame:
    """Chunks under the payload contract (language and provenance) as points without vectors; ``chunks`` is a kept table."""
    held = ingest.bilingual_payload(chunks).withColumn("query_id", F.col("query_id").cast("string"))
    own = ids.bilingual_point_id(F.col("language"), F.col("query_id"), F.col("passage_index"), F.col("chunk_index"), F.col("chunk_strategy"))
    rest = [c.split(" ")[0] for c in PAYLOAD.split(", ")]
    json = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return held.select((F.monotonically_increasing_id() + F.lit(first_seq)).alias("seq"), own.alias("point_id"), "query_id", "language", json.alias("payload"), "text")


def embedded(rows: DataFrame, load: Load, batch: int = 16) -> DataFrame:
    """Points with the vectors of their texts, in the columns of the store."""
    return dense.encode(rows, "text", load, batch=batch).withColumnRenamed("embedding", "vector").select(*points.COLUMNS)


def index(records: DataFrame, path: str, language: Column, load: Load = dense.load_projection, max_tokens: int = 256, buckets: int = 16, size: int | None = None) -> dict[str, int]:
    """Chunk, embed and upsert ``records``; returns counts: records, malformed, documents, chunks, points (of the whole store).

    Malformed records are counted and left out. A vector that hasn't ``size`` finite numbers is an error, and nothing is written.
    """
    bad = ingest.is_malformed(F.col("passages"), F.col("is_selected"))
    read = records.agg(F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("malformed")).first()
    chunks = keep(chunking.chunk(ingest.passages(records).withColumn("language", language), max_tokens), "chunks")
    made = chunks.agg(F.count_if(F.col("chunk_index") == 0).alias("documents"), F.count(F.lit(1)).alias("chunks")).first()
    stored = points.upsert(as_points(chunks, _next_seq(path)), path, buckets, size, finish=lambda rows: embedded(rows, load)) if made["chunks"] else points.stored(path)
    release(chunks)
    return {**read.asDict(), **made.asDict(), "points": stored}


def add_language(
    spark: SparkSession, source: str, target: str, records: DataFrame, language: str, bytes_per_point: float, limit_gib: float,
    load: Load = dense.load_projection, max_tokens: int = 256, buckets: int = 16, size: int | None = None,
) -> dict[str, int]:
    """One store of two languages: the selected points of ``source`` with the vectors they have, and ``records`` in ``language``, embedded.

    Both are what policy A keeps. Whether they fit ``limit_gib`` is counted before anything is embedded
    or written; if they don't, that is an error. Returns counts: copied, embedded, points (of the target).
    """
    fields = F.from_json("payload", PAYLOAD)
    selected = (F.col("_p.is_selected") == 1) & (F.trim(F.coalesce("_p.text", F.lit(""))) != "")
    own = ids.bilingual_point_id(F.col("language"), F.col("_p.query_id"), F.col("_p.passage_index"), F.col("_p.chunk_index"), F.col("_p.chunk_strategy"))
    # Vectors are read of the selected points alone, by their ids, and go straight into the target.
    chosen = keep(points.read(spark, source, ["point_id", "payload"]).withColumn("_p", fields).where(selected).select("point_id"), "chosen")
    copied = points.lookup(chosen, source).withColumn("_p", fields).where(selected).withColumn("point_id", own).select(*points.COLUMNS)
    kept = policies.choose(ingest.passages(records), "POLICY_A_SELECTED_ONLY").withColumn("language", F.lit(language))
    chunks = keep(chunking.chunk(kept, max_tokens), "chunks")
    counts = {"copied": chosen.count(), "embedded": chunks.count()}
    policies.gated_union(chosen, chunks.select(F.col("text").alias("point_id")), bytes_per_point, limit_gib)
    first = max(_next_seq(target), _next_seq(source))
    both = copied.unionByName(embedded(as_points(chunks, first), load))
    stored = points.upsert(both, target, buckets, size)
    for t in (chosen, chunks):
        release(t)
    return {**counts, "points": stored}
