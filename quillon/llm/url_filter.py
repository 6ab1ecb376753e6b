"""Operator 1, URL filters: sort-merge range join of URLs with nested prefix rules.

A rule (host, path) fits a URL whose host is the rule's host or one of its
subdomains and whose path starts with the rule's path. With the labels of the
host reversed, ``org.example<sep>/es/`` becomes a canonical key; all paths below
it form one interval of keys, and the intervals of a host's rules nest.

Each URL probes with one key for each suffix of its host (the host itself and
its parent domains) that has no more labels than any rule's host, so that a host
of very many labels makes few probes. Probes and the starts of rules are dealt by the top label
and a salt, sorted by key, and swept once by a window: the last rule that
started carries the stack of rules it is nested in, and the rules that contain
the probe are those of this stack that the probe's key starts with. Probes of a
URL share a partition, so its longest rule is found without another shuffle.

Only DataFrame and SQL functions are used.

Defined results
  null URL, or one without ``://``: host and path are empty, no rule fits.
  repeated rows: every row is kept. Equal rules: once; if their verdicts differ, block wins.
  longest: most characters of host and path together, then of the host.
  empty table: empty result. Rules with a null or empty host or a null path fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEP = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a DataFrame made of literals."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(SEP), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row a rule: top, key, and the stack of rules it is nested in, outermost first, itself last."""
    own = (
        rules.where("host <> '' and path is not null and verdict is not null")
        .groupBy("host", "path").agg(F.max((F.col("verdict") == "block").cast("int")).alias("b"))
        .select("host", "path", F.when(F.col("b") == 1, "block").otherwise("allow").alias("verdict"))
    )
    # A rule's stack: rules of its host whose path is one of the prefixes of its path.
    prefixes = own.select("host", F.col("path").alias("own_path"), F.explode(F.expr("transform(sequence(0, length(path)), n -> left(path, n))")).alias("path"))
    entry = F.struct(F.length("path").alias("n"), F.concat("host", "path").alias("rule"), F.col("verdict"), F.length("host").alias("host_n"), _key(F.split("host", r"\."), F.col("path")).alias("key"))
    return (
        prefixes.join(own, ["host", "path"])
        .groupBy("host", "own_path").agg(F.array_sort(F.collect_list(entry)).alias("stack"))
        .select(F.element_at(F.split("host", r"\."), -1).alias("top"), F.element_at("stack", -1)["key"].alias("key"), "stack")
    )


def filter_urls(df: DataFrame, rules: DataFrame, ids: list[str], url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Rows of ``df`` (columns ``ids`` and ``url``) with host, path, rule and verdict.

    rule: host and path of the longest fitting rule, else null. verdict: its verdict, else ``default``.
    salts: parts into which every top label is dealt, at least as many as there are tasks to use;
    the rules are repeated in each. Default: the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [*ids, *([] if url in ids else [url])]
    rows = df.select(*names).withColumn("_host", url_host(F.col(url))).withColumn("_path", url_path(F.col(url)))
    labels = F.split("_host", r"\.")
    most = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 1
    first = F.greatest(F.lit(1), F.size(labels) - (most - 1))
    probes = (
        rows.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
        .withColumn("_top", F.element_at(labels, -1))
        .withColumn("_n", F.size(labels) - first + 1)
        .withColumn("_key", F.explode(F.transform(F.sequence(first, F.size(labels)), lambda i: _key(F.slice(labels, i, F.size(labels)), F.col("_path")))))
    )
    stacks = rule_stacks(rules)
    stack_type = stacks.schema["stack"].dataType
    starts = stacks.select(F.col("top").alias("_top"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col("key").alias("_key"), F.lit(0).alias("_kind"), F.col("stack").alias("_stack"))
    events = probes.withColumn("_kind", F.lit(1)).withColumn("_stack", F.lit(None).cast(stack_type)).unionByName(starts, allowMissingColumns=True)
    sweep = Window.partitionBy("_top", "_salt").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("_stack", F.last("_stack", ignorenulls=True).over(sweep)).where("_kind = 1")
    fitting = F.filter("_stack", lambda r: F.startswith(F.col("_key"), r["key"]))
    best = F.expr("_fit[size(_fit) - 1]")
    swept = swept.withColumn("_fit", fitting).withColumn(
        "_best", F.when(F.size("_fit") > 0, F.struct(F.length(best["rule"]).alias("n"), best["host_n"].alias("h"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))
    )
    found = swept.groupBy("_top", "_salt", *names, "_host", "_path", "_n").agg(F.max("_best").alias("_best"), (F.count(F.lit(1)) / F.col("_n")).cast("int").alias("_rows"))
    once = found.withColumn("_rows", F.explode(F.expr("sequence(1, _rows)")))
    return once.select(*names, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: The rules of query op1: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` judged by ``RULES``; URLs that no rule fits are allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rules_frame(spark, RULES), ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), n AS (
  SELECT row_number() OVER () AS k, * FROM u
), m AS (
  SELECT n.*, rule_host || rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS i
  FROM n LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE i = 1
"""
