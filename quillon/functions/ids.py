"""Deterministic identifiers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The RFC 4122 namespace for URLs, and the prefixes of names.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
LEGACY, FULL, BILINGUAL = "msmarco-xi-hindi:", "msmarco-xi-hindi-full:", "msmarco-xi-bilingual-compact:"

UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (version 5) from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _named(*parts: tuple[str, Column]) -> Column:
    out = []
    for k, (name, value) in enumerate(parts):
        out += [F.lit(("|" if k else "") + name + "="), value.cast("string")]
    return F.concat(*out)


def legacy_point_id(query_id: Column, passage_index: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat(F.lit(LEGACY), F.concat_ws(":", query_id.cast("string"), passage_index.cast("string"), chunk_index.cast("string"))))


def strategy_point_id(query_id: Column, passage_index: Column, chunk_index: Column, chunk_strategy: Column) -> Column:
    return uuid5(F.concat(F.lit(FULL), _named(("query_id", query_id), ("passage_index", passage_index), ("chunk_index", chunk_index), ("chunk_strategy", chunk_strategy))))


def bilingual_point_id(language: Column, query_id: Column, passage_index: Column, chunk_index: Column, chunk_strategy: Column) -> Column:
    """Only for hi and en; another language is an error."""
    code = F.lower(F.trim(language))
    known = F.when(code.isin("hi", "en"), code).otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(language, F.lit("null")))))
    return uuid5(F.concat(F.lit(BILINGUAL), _named(("language", known), ("query_id", query_id), ("passage_index", passage_index), ("chunk_index", chunk_index), ("chunk_strategy", chunk_strategy))))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)
