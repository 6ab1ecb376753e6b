"""From nested records to passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_space


def is_selected(label: Column) -> Column:
    """Labels 1 and true count; null doesn't."""
    return F.coalesce(label.cast("int") == 1, F.lit(False))


def is_malformed(passages: Column, labels: Column) -> Column:
    """Parallel arrays of different lengths. A record without passages isn't malformed: it has no documents."""
    return F.coalesce(F.size(passages), F.lit(0)) != F.coalesce(F.size(labels), F.lit(0))


def passages(records: DataFrame, passages_col: str = "passages", labels_col: str = "is_selected", strict: bool = False) -> DataFrame:
    """One row a passage that isn't blank: the record's columns, passage_index, text, is_selected.

    The index is the place in the record, counted before blank passages go. Malformed records are
    left out, or are an error if ``strict``.
    """
    p, s = F.col(passages_col), F.col(labels_col)
    rest = [c for c in records.columns if c not in (passages_col, labels_col)]
    if strict:
        records = records.withColumn(labels_col, F.when(is_malformed(p, s), F.raise_error(F.lit("passages and is_selected must have the same length"))).otherwise(s))
    kept = records.where(~is_malformed(p, s)) if not strict else records
    zipped = F.arrays_zip(p.alias("t"), s.alias("s"))
    rows = kept.select(*rest, F.posexplode(zipped).alias("passage_index", "_pair"))
    pair = F.col("_pair")
    named = rows.select(*rest, "passage_index", normalize_space(pair.getItem("t")).alias("text"), F.coalesce(pair.getItem("s"), F.lit(0)).alias("is_selected"))
    return named.where("text <> ''")


def translated_view(raw: DataFrame) -> DataFrame:
    """Records of a nested raw table, in the target language."""
    return raw.select("query_id", "query_type", "source_lang", "target_lang", F.col("passages.Translated_passages").alias("passages"), F.col("passages.is_selected").alias("is_selected"))


def english_view(raw: DataFrame) -> DataFrame:
    """The English passages of the same table; no second corpus is stored."""
    return raw.select("query_id", "query_type", F.lit("eng_Latn").alias("source_lang"), F.lit("eng_Latn").alias("target_lang"), F.col("passages.English_passages").alias("passages"), F.col("passages.is_selected").alias("is_selected"))


def payload_errors(required: list[str]) -> Column:
    """Names of required fields that are null, in order."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))


def bilingual_payload(chunks: DataFrame) -> DataFrame:
    """The payload contract: language, target_lang and provenance; a null in it is an error."""
    from quillon.sources.tables import target_language

    required = ["query_id", "passage_index", "chunk_index", "chunk_strategy", "is_selected", "token_count"]
    checked = chunks.withColumn("_missing", payload_errors(required))
    bad = F.size("_missing") > 0
    first = F.when(bad, F.raise_error(F.concat(F.lit("missing payload fields: "), F.array_join("_missing", ", ")))).otherwise(F.lower(F.trim("language")))
    return checked.select(first.alias("language"), target_language(F.col("language")).alias("target_lang"), *required, "text")


def corpus_of(payloads: DataFrame, target_lang: str, text_col: str = "text") -> DataFrame:
    """The texts of one target language that aren't blank, as the lexical corpus reads them from stored payloads."""
    if not target_lang.strip():
        raise ValueError("target_lang must not be blank")
    trimmed = F.trim(F.regexp_replace(text_col, r"(?U)^\s+|\s+$", ""))
    return payloads.where(F.col("target_lang") == target_lang).withColumn(text_col, trimmed).where(F.col(text_col) != "")


def payload(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """point_id (if there is one) and payload: the text and all metadata of a chunk as one JSON object without nulls' loss."""
    rest = [c for c in chunks.columns if c != "point_id"]
    ids = ["point_id"] if "point_id" in chunks.columns else []
    return chunks.select(*ids, F.to_json(F.struct(text_col, *(c for c in rest if c != text_col)), {"ignoreNullFields": "false"}).alias("payload"))


def from_payload(points: DataFrame, schema: str) -> DataFrame:
    """The inverse of ``payload``: the columns of ``schema`` (a DDL string) from each payload."""
    ids = [c for c in points.columns if c != "payload"]
    return points.select(*ids, F.from_json("payload", schema).alias("_p")).select(*ids, "_p.*")
