"""Reciprocal-rank fusion of ranked lists, and comparisons of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.lexical import rank

K = 60


def rrf_scores(lists: dict[str, DataFrame], keys: list[str], k: int = K, carry: tuple[str, ...] = ()) -> DataFrame:
    """query_key, keys, fused, and each list's score as ``<name>_score`` and rank as ``<name>_rank``.

    Lists are (query_key, keys, score, rank); they are united and summed in one aggregation.
    ``carry`` names further columns (a text, say), taken from the first list that has the row.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = [df.select("query_key", *keys, F.lit(name).alias("_from"), F.col("score").cast("double").alias("_score"), F.col("rank").alias("_rank"), F.lit(n).alias("_order"), *carry) for n, (name, df) in enumerate(lists.items())]
    both = reduce(DataFrame.unionByName, rows)
    own = [F.max(F.when(F.col("_from") == n, F.col(f"_{what}"))).alias(f"{n}_{what}") for n in lists for what in ("score", "rank")]
    return both.groupBy("query_key", *keys).agg(F.sum(1.0 / (k + F.col("_rank"))).alias("fused"), *own, *(F.min_by(c, "_order").alias(c) for c in carry))


def rrf_topk(lists: dict[str, DataFrame], keys: list[str], top: int = 5, k: int = K) -> DataFrame:
    """The ``top`` best rows of each query by fused score, then by keys as strings."""
    return rank(rrf_scores(lists, keys, k), top, keys, score="fused", digits=12)


def evidence_only(fused: DataFrame, semantic: str = "semantic_score") -> DataFrame:
    """Rows with a semantic score, which becomes their score."""
    return fused.where(F.col(semantic).isNotNull()).withColumn("score", F.col(semantic))


def margin(ranked: DataFrame, score: str = "fused") -> DataFrame:
    """query_key, margin of the first over the second row; null with one row."""
    order = Window.partitionBy("query_key").orderBy("rank")
    return ranked.withColumn("_next", F.lead(score).over(order)).where("rank = 1").select("query_key", (F.col(score) - F.col("_next")).alias("margin"))


def overlap_ratio(a: Column, b: Column, limit: int) -> Column:
    """Shared entries among the first ``limit`` of two lists, over the shortest; null if one is empty."""
    left, right = F.slice(a, 1, limit), F.slice(b, 1, limit)
    return F.size(F.array_intersect(left, right)) / F.nullif(F.least(F.lit(limit), F.size(left), F.size(right)), F.lit(0))


def signature(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """query_key and a digest of its list (places, keys, scores in whole billionths): equal if two plans give the same rows in the same order."""
    row = F.struct("rank", F.concat_ws("|", *(F.col(c).cast("string") for c in keys), F.round(F.col("score") * 1e9).cast("long").cast("string")).alias("key"))
    return ranked.groupBy("query_key").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["key"]), "\n"), 256).alias("signature"))


def as_lists(ranked: DataFrame, key: Column, name: str) -> DataFrame:
    """query_key and the keys of its rows in the order of their ranks."""
    return ranked.groupBy("query_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key.alias("key")))), lambda r: r["key"]).alias(name))


def equivalence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: queries, and how many agree in the first row, in all rows; mean overlap; largest score difference."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in keys))
    la, lb = as_lists(a, key, "la"), as_lists(b, key, "lb")
    both = la.join(lb, "query_key", "full")
    lists = both.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.get("la", F.lit(0)) == F.get("lb", F.lit(0))).alias("same_first"), F.count_if(F.col("la") == F.col("lb")).alias("same_list"),
        F.avg(F.coalesce(F.size(F.array_intersect("la", "lb")) / F.greatest(F.size("la"), F.size("lb")), F.lit(0.0))).alias("mean_overlap"),
    )
    scores = a.select("query_key", *keys, F.col("score").alias("sa")).join(b.select("query_key", *keys, F.col("score").alias("sb")), ["query_key", *keys]).agg(F.max(F.abs(F.col("sa") - F.col("sb"))).alias("max_difference"))
    return lists.crossJoin(scores)


def rank_of(ranked: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """query_key and the best rank at which its expected key (query_key, expected) stands; null if it doesn't."""
    found = expected.join(ranked, (expected["query_key"] == ranked["query_key"]) & (expected["expected"].cast("string") == ranked[key].cast("string")), "left")
    return found.groupBy(expected["query_key"]).agg(F.min("rank").alias("rank"))
