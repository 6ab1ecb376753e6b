"""JSON of any depth: every value with its path, key frequencies, and redaction by key name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import keep

#: Words in key names whose values are secret.
SECRET = r"api[_ -]?key|token|secret|password"


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean, null or other."""
    name = F.schema_of_variant(value)
    return (
        F.when(F.startswith(name, F.lit("OBJECT")), "object").when(F.startswith(name, F.lit("ARRAY")), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), "number").otherwise("other")
    )


def walk(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, depth, path, name, kind, value (text, of scalars) of every value in the JSON texts, at any depth.

    A path is ``$``, then ``.name`` or ``[place]`` for each step. Texts that are no JSON have one row of
    kind ``invalid``; null texts have none. Each round goes one level down, in the containers of the
    last alone, until there are none; a level is a table.
    """
    spark = rows.sparkSession
    parsed = rows.where(F.col(json).isNotNull()).select(F.col(key).alias("_key"), F.try_parse_json(json).alias("v"))
    invalid = parsed.where("v is null").select("_key", F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.lit("invalid").alias("kind"), F.lit(None).cast("string").alias("value"))
    level = parsed.where("v is not null").select("_key", F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), "v")
    out = invalid
    while True:
        held = keep(level.withColumn("kind", kind_of(F.col("v"))), "level")
        text = F.when(~F.col("kind").isin("object", "array", "null"), F.try_variant_get("v", "$", "string"))
        out = out.unionByName(held.select("_key", "depth", "path", "name", "kind", text.alias("value")))
        open_ = held.where("kind in ('object', 'array')")
        if not open_.limit(1).count():
            return out.select(F.col("_key").alias(key), "depth", "path", "name", "kind", "value")
        level = spark.sql(
            "select p._key, p.depth + 1 as depth, case when e.key is null then concat(p.path, '[', e.pos, ']') else concat(p.path, '.', e.key) end as path, e.key as name, e.value as v from {p} p, lateral variant_explode(p.v) e", p=open_
        )


def key_report(walked: DataFrame) -> DataFrame:
    """path (places in arrays as ``[*]``), kind and how often they occur together."""
    return walked.groupBy(F.regexp_replace("path", r"\[[0-9]+\]", "[*]").alias("path"), "kind").agg(F.count(F.lit(1)).alias("n"))


def redact_keys(json: Column | str, secret: str = SECRET) -> Column:
    """JSON text with the scalar values of keys whose names hold a secret word replaced, at any depth."""
    pattern = rf'(?i)("(?:[^"\\]|\\.)*(?:{secret})(?:[^"\\]|\\.)*"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false)'
    return F.regexp_replace(F.col(json) if isinstance(json, str) else json, pattern, '$1"[REDACTED]"')
