"""Reconciliation of identifiers: collisions, missing and unexpected ones, final status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import normalize_space
from quillon.operators import evaluate
from quillon.operators.ingest import is_selected, payload_errors


def collisions(rows: DataFrame, id_col: str, order: str, content: list[str]) -> DataFrame:
    """Rows after the first of their id, with the first one's content as ``first_<column>`` and whether it is the same."""
    w = Window.partitionBy(id_col).orderBy(order)
    paired = rows.withColumn("_i", F.row_number().over(w)).withColumn("_f", F.first(F.struct(*content)).over(w))
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"_f.{c}"))
    return paired.where("_i > 1").select(*rows.columns, *(F.col(f"_f.{c}").alias(f"first_{c}") for c in content), same.alias("identical"))


def collision_report(rows: DataFrame, id_col: str, content: str) -> DataFrame:
    """One row: ids, repeated ids, rows beyond the first, and how many repeated ids have one content or several."""
    per = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(content).alias("kinds"))
    many = F.col("n") > 1
    return per.agg(
        F.count(F.lit(1)).alias("ids"), F.count_if(many).alias("repeated_ids"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("extra_rows"),
        F.count_if(many & (F.col("kinds") <= 1)).alias("identical"), F.count_if(many & (F.col("kinds") > 1)).alias("different"),
    )


def repeated_keys(rows: DataFrame, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """key, n of keys on several rows, the most frequent first."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), key)
    found = found.offset(offset) if offset else found
    return found.limit(limit) if limit is not None else found


def missing(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    return expected.join(actual.select(id_col), id_col, "left_anti")


def unexpected(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    return missing(actual, expected, id_col)


def reconcile(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    """One row: expected, actual, matched, missing, unexpected: one pass over both sets of ids."""
    e, a = (df.select(id_col).distinct().select(F.col(id_col).alias("i"), F.lit(side).alias("s")) for df, side in ((expected, 1), (actual, 2)))
    both = e.unionByName(a).groupBy("i").agg(F.sum("s").alias("s"))
    return both.agg(
        F.count_if(F.col("s") != 2).alias("expected"), F.count_if(F.col("s") != 1).alias("actual"), F.count_if(F.col("s") == 3).alias("matched"),
        F.count_if(F.col("s") == 1).alias("missing"), F.count_if(F.col("s") == 2).alias("unexpected"),
    )


def final_status(report: DataFrame, size: int = 768) -> DataFrame:
    """A report (expected, actual, missing, unexpected, payload_errors, vector_size, failed_class) with unexplained and status.

    Collisions of different content are known overwrites and don't decide; an index that was never
    asked for its vectors' size (null) isn't safe.
    """
    safe = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("payload_errors") == 0) & (F.col("vector_size") == size) & (F.col("failed_class") != "INDEXING_BUG")
    status = F.when(F.coalesce(safe, F.lit(False)), "INDEX_SAFE_FOR_BENCHMARKING").otherwise("INDEX_REQUIRES_FIX")
    return report.withColumn("unexplained", F.greatest(F.lit(0), F.col("expected") - F.col("actual"))).withColumn("status", status)


def failed_query_class(rows: DataFrame) -> DataFrame:
    """Why a query found nothing: rows of found (its record exists), query, asked, passages, is_selected and indexed with ``class``.

    indexed: passage indices of the record's points. The first of these counts: no record; lists
    that are missing or differ in length, or a blank query; another query than the one asked; a
    selected passage without a point. Else the evidence is there, and retrieval missed it.
    """
    query = F.coalesce(normalize_space("query"), F.lit(""))
    indexed = F.coalesce("indexed", F.array().cast("array<int>"))
    relevant = F.array_compact(F.transform("is_selected", lambda s, i: F.when(is_selected(s) & (F.coalesce(normalize_space(F.get("passages", i)), F.lit("")) != ""), i)))
    malformed = F.col("passages").isNull() | F.col("is_selected").isNull() | (F.size("passages") != F.size("is_selected"))
    kind = (
        F.when(~F.coalesce("found", F.lit(False)), "INDEXING_BUG")
        .when(malformed | (query == ""), "AMBIGUOUS_GROUND_TRUTH")
        .when(~query.eqNullSafe(F.col("asked")), "SMOKE_TEST_EXPECTATION_BUG")
        .when((F.size(indexed) == 0) | (F.size(F.array_except(relevant, indexed)) > 0), "INDEXING_BUG")
        .otherwise("RETRIEVAL_MISS")
    )
    return rows.withColumn("class", kind)


def reconcile_samples(expected: DataFrame, actual: DataFrame, id_col: str, most: int = 10) -> DataFrame:
    """kind, id: the ``most`` smallest missing and unexpected ids, for a report to name."""
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(id_col)).distinct().orderBy(id_col).limit(most)
    return named(missing(expected, actual, id_col), "missing").unionByName(named(unexpected(expected, actual, id_col), "unexpected"))


def integrity_sample(rows: DataFrame, id_col: str, required: list[str], m: int) -> DataFrame:
    """id_col, place and errors (names of required fields that are null) of ``m`` rows at even distances in the order of ids."""
    sample = evaluate.evenly_spaced(rows.select(id_col), id_col, m)
    return sample.join(rows, id_col).select(id_col, "place", payload_errors(required).alias("errors"))


def foreign_rows(rows: DataFrame, language: str, expected: str) -> DataFrame:
    """How many rows are of another language than the one asked for."""
    return rows.agg(F.count_if(F.col(language) != F.col(expected)).alias("foreign_rows"))
