"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but
the last return the columns of ``documents``.

Defined results
  null and empty texts: one text for exact copies; near copies of nothing; no words for the mix, which
  leaves them out; the end token alone where they are packed. The classifier scores them like others.
  null ids: an exact copy with an id stays before one without; near copies of nothing; packed.
  repeated rows: exact copies, of which one stays.
  null sources: a source of its own. Ties: by id, or by a seeded hash.
  an empty table, or one that a stage leaves empty: an empty result. Without labels that are not held
  out, nothing is known, and a score of 0.5 rejects all.
  further columns, whatever their names, go through to the last stage, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, mixing, ngram_join, packing, quality
from quillon.llm.scratch import keep, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels``, doesn't reject."""
    model = quality.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs, "_score")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated, left out or, at a quota's end, cut; ``n_chars``, if there, is that of the text as cut."""
    mixed = mixing.apply_mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(mixed.schema["n_chars"].dataType)) if "n_chars" in mixed.columns else mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of tokens."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mix", mix_sources), ("pack", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the components or the packing program.
ORACLE_SQL = None
