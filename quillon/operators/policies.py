"""Which passages of a record a compact corpus keeps, and which policy its measurements favour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import normalize_space, policy_prefix
from quillon.operators import chunking, ingest

#: Names of the policies, and how many passages that aren't selected each may add.
POLICIES = {
    "POLICY_A_SELECTED_ONLY": 0,
    "POLICY_B_SELECTED_PLUS_1": 1,
    "POLICY_C_SELECTED_PLUS_2": 2,
    "POLICY_D_SELECTED_PLUS_QUERY_COVERAGE": 0,
    "POLICY_E_SELECTED_PLUS_1_WITH_ZERO_SELECTED_FALLBACK": 1,
}
RELEVANCE = ("expected_evidence_in_top_k_rate", "top1_expected_evidence_rate", "correct_evidence_family_rate")
COSTS = ("chunk_count", "p50", "p70", "p95", "p100")
UNRESOLVED = "COMPACT_POLICY_TRADE_OFF_UNRESOLVED"


def choose(passages: DataFrame, policy: str, record: str = "query_id") -> DataFrame:
    """Passages (record, passage_index, is_selected, ...) that ``policy`` keeps, with their place in its output.

    Selected passages come first, then others by distance to the nearest selected one and index;
    in a record without selected passages, by index.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    return _placed(passages, record).where(_keeps(policy)).drop("_n")


def _placed(passages: DataFrame, record: str) -> DataFrame:
    """Passages with their place (selected ones first) and the number of selected ones in their record."""
    own = Window.partitionBy(record)
    line, index = own.orderBy("passage_index"), F.col("passage_index")
    hit = F.col("is_selected") == 1
    at = F.when(hit, index)
    before = F.last(at, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(at, ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = passages.withColumn("_b", before).withColumn("_a", after).withColumn("_n", F.count(at).over(own))
    distance = F.when(hit, F.lit(-1)).otherwise(F.coalesce(F.least(index - F.col("_b"), F.col("_a") - index), index))
    return rows.withColumn("_d", distance).withColumn("place", F.row_number().over(own.orderBy("_d", "passage_index"))).drop("_b", "_a", "_d")


def _keeps(policy: str) -> Column:
    if policy.startswith("POLICY_D"):
        return F.col("place") <= F.greatest(F.col("_n"), F.lit(1))
    return F.col("place") <= F.col("_n") + POLICIES[policy]


def all_policies(passages: DataFrame, record: str = "query_id") -> DataFrame:
    """The rows of every policy, with its name as ``policy``."""
    names = F.array_compact(F.array(*(F.when(_keeps(name), F.lit(name)) for name in POLICIES)))
    return _placed(passages, record).withColumn("policy", F.explode(names)).drop("_n")


def policy_stats(chosen: DataFrame, passages: DataFrame, record: str = "query_id") -> DataFrame:
    """policy, rows covered and dropped, passages, selected, averages and reduction against all passages."""
    whole = passages.agg(F.count_distinct(record).alias("all_rows"), F.count(F.lit(1)).alias("all_passages"), F.sum("is_selected").cast("long").alias("all_selected"))
    per = chosen.groupBy("policy").agg(F.count_distinct(record).alias("rows_covered"), F.count(F.lit(1)).alias("passages"), F.sum("is_selected").cast("long").alias("selected"))
    return per.crossJoin(F.broadcast(whole)).select(
        "policy", "rows_covered", (F.col("all_rows") - F.col("rows_covered")).alias("rows_dropped"), "passages", "selected",
        F.round(F.col("passages") / F.col("rows_covered"), 6).alias("passages_per_row"), F.round(100 * (1 - F.col("passages") / F.col("all_passages")), 6).alias("reduction_percent"),
        F.round(100 * F.col("selected") / F.nullif("all_selected", F.lit(0)), 6).alias("representation_percent"),
    )


def policy_chunk_stats(chosen: DataFrame, records: int, max_tokens: int = 256, record: str = "query_id") -> DataFrame:
    """policy, and of its chunks: how many, by strategy, on average and at most of a record; ``records`` is the number of all records."""
    own = chunking.chunk(chosen, max_tokens)
    per = own.groupBy("policy", record).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("chunk_strategy") == s).alias(s) for s in chunking.STRATEGIES))
    return per.groupBy("policy").agg(
        F.sum("n").alias("chunks"), F.max("n").alias("max_chunks_of_row"), F.round(F.sum("n") / records, 6).alias("chunks_per_row"), F.count_distinct(record).alias("records_kept"),
        *(F.sum(s).alias(s) for s in chunking.STRATEGIES),
    )


def english_stats(records: DataFrame, max_tokens: int = 256) -> DataFrame:
    """One row: records, passages, filled and selected ones, records without a selected one, and the chunks that policy A keeps."""
    one = records.select(F.size("passages").alias("p"), F.size(F.filter("passages", lambda t: normalize_space(t) != "")).alias("f"), F.size(F.filter("is_selected", lambda s: s == 1)).alias("s"))
    counts = one.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("p").alias("passages"), F.sum("f").alias("non_empty_passages"), F.sum("s").alias("selected_passages"), F.count_if(F.col("s") == 0).alias("zero_selected_rows"))
    kept = choose(ingest.passages(records), "POLICY_A_SELECTED_ONLY")
    return counts.crossJoin(chunking.chunk(kept, max_tokens).agg(F.count(F.lit(1)).alias("compact_chunks")))  # a row each


def storage_report(chunks: Column, bytes_per_point: float, languages: int = 1, price_per_gib: float | None = None, limit_gib: float | None = None) -> Column:
    """struct(gib, bilingual_gib, monthly_cost, is_safe): what points take, what that costs, and whether both languages fit the limit."""
    one, both = storage_gib(chunks, bytes_per_point), storage_gib(chunks, bytes_per_point, languages)
    cost = F.lit(None).cast("double") if price_per_gib is None else one * price_per_gib
    return F.struct(one.alias("gib"), both.alias("all_gib"), cost.alias("monthly_cost"), (F.lit(True) if limit_gib is None else both <= limit_gib).alias("is_safe"))


def gated_union(first: DataFrame, second: DataFrame, bytes_per_point: float, limit_gib: float) -> DataFrame:
    """Two languages' points as one collection; an error, before anything is written, if they don't fit the limit."""
    points = first.count() + second.count()
    if (gib := points * bytes_per_point / (1 << 30)) > limit_gib:
        raise ValueError(f"{points} points need {gib:.3f} GiB, more than the limit of {limit_gib}")
    return first.unionByName(second)


def storage_gib(chunks: Column, bytes_per_point: float, languages: int = 1) -> Column:
    return chunks * F.lit(float(bytes_per_point)) * languages / F.lit(float(1 << 30))


def dominates(a: str, b: str, relevance: tuple = RELEVANCE, costs: tuple = COSTS) -> Column:
    """Whether row ``a`` of a join is no worse than row ``b`` in everything and better in something."""
    no_worse, better = F.lit(True), F.lit(False)
    for names, sign in ((relevance, 1), (costs, -1)):
        for c in names:
            x, y = F.col(f"{a}.{c}") * sign, F.col(f"{b}.{c}") * sign
            no_worse, better = no_worse & (x >= y), better | (x > y)
    return no_worse & better


def recommend(metrics: DataFrame, relevance: tuple = RELEVANCE, costs: tuple = COSTS) -> DataFrame:
    """One row, recommendation: the one policy that dominates all others, if there is one.

    metrics has a row for each policy (five of them), so comparing all pairs is a fixed amount of work.
    """
    pairs = metrics.alias("a").join(metrics.alias("b"), F.col("a.policy") != F.col("b.policy"), "left")
    over_all = pairs.groupBy(F.col("a.policy").alias("policy")).agg(F.bool_and(F.coalesce(F.col("b.policy").isNull() | dominates("a", "b", relevance, costs), F.lit(False))).alias("wins"))
    best = over_all.agg(F.count_if("wins").alias("n"), F.max(F.when(F.col("wins"), F.col("policy"))).alias("policy"))
    return best.select(F.when(F.col("n") == 1, F.concat(policy_prefix("policy"), F.lit("_RECOMMENDED"))).otherwise(UNRESOLVED).alias("recommendation"))


def interpretation(recommendation: DataFrame) -> DataFrame:
    """The recommendation with its caveats: coverage of records without selected passages isn't relevance, local latency isn't deployment."""
    for_a = F.col("recommendation") == "POLICY_A_RECOMMENDED"
    return recommendation.select(
        "recommendation", F.lit("pareto_dominance_without_acceptance_thresholds").alias("method"), F.lit(False).alias("zero_selected_coverage_is_labeled_relevance"),
        for_a.alias("zero_selected_coverage_caveat"), F.when(for_a, "Policy A leaves out passages of rows without selected evidence, so these rows don't cover their own query.").alias("caveat_reason"),
        F.lit(False).alias("final_deployment_latency_validated"),
    )


def marginal_quality(metrics: DataFrame, quality: str = RELEVANCE[0]) -> DataFrame:
    """policy and the quality gained per 10,000 chunks more than the next smaller policy."""
    order = Window.orderBy("chunk_count", "policy")  # a row for each policy
    more = F.col("chunk_count") - F.lag("chunk_count").over(order)
    return metrics.select("policy", ((F.col(quality) - F.lag(quality).over(order)) / F.nullif(more / 10000.0, F.lit(0.0))).alias("per_10k_chunks"))


def english_policy_a(raw: DataFrame) -> DataFrame:
    """The English passages of nested raw records that policy A keeps."""
    return choose(ingest.passages(ingest.english_view(raw)), "POLICY_A_SELECTED_ONLY")


def preflight(classified: DataFrame) -> None:
    """An error if a missing chunk isn't a known overwrite: such an index isn't measured."""
    if n := classified.where("class <> 'KNOWN_OVERWRITE'").count():
        raise ValueError(f"{n} missing chunks are unexplained")


def classify_missing(missing: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Missing chunks as KNOWN_OVERWRITE if ``known`` lists them, else UNEXPLAINED."""
    return missing.join(known.select(*keys, F.lit("KNOWN_OVERWRITE").alias("_known")).distinct(), keys, "left").withColumn("class", F.coalesce("_known", F.lit("UNEXPLAINED"))).drop("_known")
