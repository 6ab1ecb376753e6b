"""Statistics, percentiles, hit rates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import keep

#: Upper ends of the length histogram's buckets; the last one is open.
LENGTH_BUCKETS = (50, 100, 150, 200, 250, 300, 400, 500, 1000)


def placed(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, value, _place, _all: every value that isn't null with its place, from 0, among those of its group, and their number.

    The rows are range-partitioned by group and value and kept; places come from counts by partition,
    so that no group is sorted in one task, however many different values it has.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = keep(rows.where(F.col(value).isNotNull()).select(*by, value).repartitionByRange(parts, *by, value).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = sorted_rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each group and partition
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    own = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(value)) - 1
    same = F.lit(True)
    for c in [*by, "_p"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = sorted_rows.withColumn("_i", own).alias("a").join(base.alias("b"), same)
    return joined.select(*(F.col(f"a.{c}") for c in by), F.col(f"a.{value}").alias(value), (F.col("_i") + F.col("_base")).alias("_place"), F.col("_all"))


def nearest_rank(rows: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """by, percent, value: the value at place ceil(percent / 100 * n) in ascending order."""
    asked = placed(rows, value, by).withColumn("percent", F.explode(F.array(*(F.lit(p) for p in percents))))
    return asked.where(F.col("_place") + 1 == F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("_all") / 100.0))).select(*(by or []), F.col("percent").cast("long").alias("percent"), F.col(value).alias("value"))


def interpolated(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, k, value: for the k-th of ``shares`` (0 to 1) the value at that share of the way from the first to the last, between two linearly."""
    found = placed(rows, value, by).withColumn("_k", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(shares)))))
    at = F.round(F.col("_k.s") * (F.col("_all") - 1), 9)
    weight = 1 - F.abs(F.col("_place") - at)
    return found.withColumn("_w", weight).where("_w > 0").groupBy(*(by or []), F.col("_k.k").alias("k")).agg(F.sum(F.col(value) * F.col("_w")).alias("value"))


def linear_percentiles(rows: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """by, and p<percent> for each: exact percentiles with linear interpolation."""
    found = interpolated(rows, value, [p / 100 for p in percents], by)
    return found.groupBy(*(by or [])).agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"p{p}") for k, p in enumerate(percents)))


def inclusive_quantiles(rows: DataFrame, value: str, n: int = 100) -> DataFrame:
    """k, q: the n - 1 inclusive quantiles."""
    return interpolated(rows, value, [k / n for k in range(1, n)]).select((F.col("k") + 1).cast("long").alias("k"), F.col("value").alias("q"))


def half_up(value: Column) -> Column:
    """Rounding with halves upward, as browsers do."""
    return F.floor(value + 0.5)


def histogram(rows: DataFrame, value: str, ends: tuple = LENGTH_BUCKETS) -> DataFrame:
    """bucket, n for every bucket, empty ones too."""
    names, low = [], 0
    for end in ends:
        names.append(f"{low}-{end}")
        low = end + 1
    names.append(f"{ends[-1]}+")
    which = F.lit(len(ends))
    for k in range(len(ends) - 1, -1, -1):
        which = F.when(F.col(value) <= ends[k], k).otherwise(which)
    counted = rows.where(F.col(value).isNotNull()).groupBy(which.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("k"), F.get(F.array(*(F.lit(x) for x in names)), F.col("id").cast("int")).alias("bucket"))
    return every.join(counted, "k", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def length_stats(rows: DataFrame, length: str) -> DataFrame:
    """rows, empty, shortest, longest and mean of a column of lengths; null counts as malformed."""
    n = F.col(length)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(n.isNull()).alias("malformed"), F.count_if(n == 0).alias("empty"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg(length).alias("mean"))


def source_stats(records: DataFrame) -> DataFrame:
    """Rows, distinct and repeated ids, passages, non-empty and selected ones, rows without a selected one."""
    selected = F.size(F.filter("is_selected", lambda s: s == 1))
    full = F.size(F.filter("passages", lambda p: F.trim(p) != ""))
    one = records.select("query_id", F.size("passages").alias("p"), full.alias("f"), selected.alias("s"))
    return one.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("query_id").alias("ids"), (F.count("query_id") - F.count_distinct("query_id")).alias("repeated_ids"),
        F.sum("p").alias("passages"), F.sum("f").alias("non_empty"), F.sum("s").alias("selected"), F.count_if(F.col("s") == 0).alias("zero_selected"),
    )


def selected_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy(F.size(F.filter("is_selected", lambda s: s == 1)).cast("long").alias("selected")).agg(F.count(F.lit(1)).alias("n_rows"))


def hit_rates(ranked: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: how many queries have an expected key in first place, or in the list.

    expected: query_key, expected; several per query may be right. Queries without rows count as misses.
    """
    hits = ranked.join(expected, (ranked["query_key"] == expected["query_key"]) & (ranked[key].cast("string") == expected["expected"].cast("string")), "left_semi")
    best = hits.groupBy("query_key").agg(F.min("rank").alias("best"))
    queries = expected.select("query_key").distinct().join(best, "query_key", "left")
    return queries.agg(F.count(F.lit(1)).alias("queries"), F.avg((F.coalesce("best", F.lit(0)) == 1).cast("int")).alias("top1_rate"), F.avg(F.col("best").isNotNull().cast("int")).alias("topk_rate"))


def policy_hit_rates(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row of a policy's measures: of queries with selected evidence, and of those without.

    queries: query_key, query_id (its own record), expected (provenances of its selected evidence,
    perhaps none). ranked: query_key, rank, query_id, provenance. A rate over no queries is 0.
    """
    lists = ranked.groupBy("query_key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("query_id").cast("string").alias("query_id"), F.col("provenance").cast("string").alias("provenance")))).alias("_l"))
    rows = queries.join(lists, "query_key", "left").withColumn("_l", F.coalesce("_l", F.expr("cast(array() as array<struct<rank:int,query_id:string,provenance:string>>)")))
    own, top = F.col("query_id").cast("string"), F.get("_l", F.lit(0))
    expected = F.transform("expected", lambda x: x.cast("string"))
    selected = F.size("expected") > 0

    def rate(condition: Column, among: Column) -> Column:
        return F.coalesce(F.count_if(among & F.coalesce(condition, F.lit(False))) / F.nullif(F.count_if(among), F.lit(0)), F.lit(0.0))

    in_list = F.exists("_l", lambda r: r["query_id"] == own)
    return rows.agg(
        F.count_if(selected).alias("selected_query_count"), F.count_if(~selected).alias("zero_selected_query_count"),
        rate(F.array_contains(expected, top["provenance"]), selected).alias("top1_expected_evidence_rate"), rate(F.arrays_overlap(expected, F.transform("_l", lambda r: r["provenance"])), selected).alias("expected_evidence_in_top_k_rate"),
        rate(top["query_id"] == own, selected).alias("top1_expected_query_id_rate"), rate(in_list, selected).alias("expected_query_id_in_top_k_rate"), rate(in_list, selected).alias("correct_evidence_family_rate"),
        rate(F.size("_l") > 0, ~selected).alias("zero_query_representation_rate"), rate(top["query_id"] == own, ~selected).alias("zero_top1_same_query_id_rate"), rate(in_list, ~selected).alias("zero_same_query_id_in_top_k_rate"),
    )


def dominant(rows: DataFrame, key: str, by: str = "query_key", rank: str = "rank") -> DataFrame:
    """by, dominant, count, ratio: the commonest key of each list; ties to the smaller last rank, then the key."""
    counts = rows.groupBy(by, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k")).agg(F.count(F.lit(1)).alias("_c"), F.max(rank).alias("_r"))
    order = Window.partitionBy(by).orderBy(F.desc("_c"), "_r", "_k")
    return counts.withColumn("_all", F.sum("_c").over(Window.partitionBy(by))).withColumn("_i", F.row_number().over(order)).where("_i = 1").select(by, F.col("_k").alias("dominant"), F.col("_c").alias("count"), (F.col("_c") / F.col("_all")).alias("ratio"))


def first_match(rows: DataFrame, by: str, at: str, condition: Column) -> DataFrame:
    """by, first: the earliest ``at`` where the condition holds; null if nowhere."""
    return rows.groupBy(by).agg(F.min(F.when(condition, F.col(at))).alias("first"))


def second_in_a_row(rows: DataFrame, by: str, at: str, condition: Column, order: list[str] | None = None) -> DataFrame:
    """by, second: the earliest ``at`` at which the condition holds for the second time running."""
    w = Window.partitionBy(by).orderBy(*(order or [at]))
    held = rows.withColumn("_c", F.coalesce(condition, F.lit(False))).withColumn("_before", F.lag("_c", 1, False).over(w))
    return held.groupBy(by).agg(F.min(F.when(F.col("_c") & F.col("_before"), F.col(at))).alias("second"))


def latest(rows: DataFrame, n: int, by: str, at: str, tie: str) -> DataFrame:
    """The ``n`` latest rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def last_values(rows: DataFrame, by: str, at: str, tie: str, fields: list[str]) -> DataFrame:
    """by and each field's latest value that isn't null."""
    when = F.struct(at, tie)
    return rows.groupBy(by).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), when)).alias(f) for f in fields))


def rms_level(frames: DataFrame, by: str, sample: str) -> DataFrame:
    """by, level: root mean square of samples around 128, four-fold, at most 1."""
    part = F.pow((F.col(sample) - 128) / 128.0, 2)
    return frames.groupBy(by).agg(F.least(F.lit(1.0), 4 * F.sqrt(F.avg(part))).alias("level"))


def smallest_hashes(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """``n`` rows of each group with the smallest SHA-256 of "group:key"; a sample that doesn't change."""
    h = F.sha2(F.concat_ws(":", F.col(by).cast("string"), F.col(key).cast("string")), 256)
    w = Window.partitionBy(by).orderBy("_h", key)
    return rows.withColumn("_h", h).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_h", "_i")


def reservoir(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, each as likely as any other: those with the smallest seeded hash of their key, so a rerun gives the same ones."""
    return rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).orderBy("_h", key).limit(n).drop("_h")


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each provenance, in a stated order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def evenly_spaced(rows: DataFrame, key: str, m: int) -> DataFrame:
    """``m`` rows at even distances in the order of ``key``: places round(i (n - 1) / (m - 1)), halves to even."""
    found = placed(rows, key)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (F.col("_all") - 1) / max(1, m - 1)).cast("long"))
    return found.where(F.array_contains(wanted, F.col("_place"))).select(key, F.col("_place").alias("place"))


def first_rows(rows: DataFrame, order: list[str], n: int, condition: Column) -> DataFrame:
    """The first ``n`` rows in a stated order that meet the condition."""
    return rows.where(condition).orderBy(*order).limit(n)
