"""Operator 8, mixing sources to target weights by Sainte-Laguë apportionment.

Words are counted in blocks of ``BLOCK`` words. The mix's blocks are seats, given to the sources by
the highest quotients target / (2 seats + 1), and each source's seats in the same way to its shards
by their words: integer quotas for every shard. A document's shard comes from a seeded hash of its
id, and a source has more shards the more words it has, so a hot source is spread over many tasks.

In a shard the documents stand in a seeded order on a line of words. A quota of q blocks takes the
line's first q * BLOCK words, going round as often as needed, ``repeat`` times at most; the last
block of a shard that is taken so often in full may be short. Sources with targets below
``SMALL_BLOCKS`` blocks have seats of one word among themselves, and so have the shards of a source
that has one as small, so that a long tail of small sources is taken as near to its targets.

Targets: the sources by code point, null last, weigh 5, 2, 1, repeating, and share ``share`` times
all words. No target is above ``repeat`` times its source's words; the excess is shared again by
weight among the others until none is above.

Defined results
  null text: size 0. null source: a source of its own, last. null ids: documents like others.
  repeated rows: each is a document. A source without words: target 0, nothing taken.
  empty table: empty result. The same rows always give the same result, in whatever order.

The driver holds a row for each source and each shard (``MAX_SHARDS`` of a source at most), but none
for each document.
"""

from __future__ import annotations

import heapq
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.scratch import columns, keep, named, sized, unused

WEIGHTS = (5, 2, 1)
SHARE, REPEAT = 1.5, 2
#: Words in a block; words that make a shard; shards of a source, at most.
BLOCK, SHARD_WORDS, MAX_SHARDS = 64, 1 << 19, 4096
#: Targets of fewer blocks are met word by word.
SMALL_BLOCKS = 16
SEED = 8
#: Rows up to which the per-source and per-shard tables are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 20_000


def count_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeat: float = REPEAT) -> list[float]:
    """Target words of each source: ``share`` of all by weight, none above ``repeat`` times its size."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > repeat * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
        left -= sum(out[i] for i in over)
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 n + 1), none above its cap; ties to the first.

    The number of seats may be huge: halving finds a divisor that surely gives no more than there are,
    counted so that rounding can only leave seats out, and the rest go to the highest quotients one by
    one, compared as fractions.
    """
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    def given(divisor: float, sign: int) -> list[int]:
        """Seats at a divisor: with sign 1 at least as many as exact division gives, with -1 at most."""
        return [max(0, min(c, int(v / divisor * (1 + sign * 1e-12) + 0.5 + sign * 1e-9))) for v, c in zip(votes, caps, strict=True)]

    low, high = 0.0, 4.0 * max(votes) + 1
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if middle == 0 or sum(given(middle, 1)) > seats else (low, middle)
    out = given(high, -1)
    exact = [Fraction(v) for v in votes]
    best = [(-exact[i] / (2 * n + 1), i) for i, n in enumerate(out) if n < caps[i] and votes[i] > 0]
    heapq.heapify(best)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(best)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(best, (-exact[i] / (2 * out[i] + 1), i))
    return out


def word_quotas(votes: list[float], total: float, unit: int, sizes: list[int], repeat: float) -> list[int]:
    """``total`` words, given in seats of ``unit`` words; none gets more than ``repeat`` times its size."""
    most = [int(repeat * n) for n in sizes]
    return [min(g * unit, m) for g, m in zip(sainte_lague(votes, round(total / unit), [-(-m // unit) for m in most]), most, strict=True)]


def source_quotas(sizes: list[int], wanted: list[float], repeat: float) -> list[int]:
    """Words to take of each source: seats of one word for small targets, of a block for the others."""
    out = [0] * len(sizes)
    for unit in (1, BLOCK):
        own = [i for i, t in enumerate(wanted) if (t < SMALL_BLOCKS * BLOCK) == (unit == 1)]
        votes = [wanted[i] for i in own]
        for i, q in zip(own, word_quotas(votes, sum(votes), unit, [sizes[i] for i in own], repeat), strict=True):
            out[i] = q
    return out


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """One row a document: id_col, source_col, size, source_size, target, taken, and _text, a hash of the text."""
    spark = docs.sparkSession
    sizes = keep(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_text")), "sizes")
    found = sorted(((r["_source"], r["n"]) for r in sizes.groupBy("_source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    words = [n for _, n in found]
    wanted = targets(words, [weights[i % len(weights)] for i in range(len(words))], share, repeat)
    taken = source_quotas(words, wanted, repeat)
    shards = [max(1, min(MAX_SHARDS, -(-n // SHARD_WORDS))) for n in words]
    by_source = spark.createDataFrame(
        [(s, n, t, k) for (s, n), t, k in zip(found, wanted, shards, strict=True)],
        T.StructType([T.StructField("_s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_shards", T.IntegerType())]),
    )
    sharded = sizes.join(_sized(by_source, len(found)), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_hash", F.xxhash64(F.lit(seed), "_id")).withColumn("_shard", F.pmod(F.col("_hash"), F.col("_shards")).cast("int"))
    held: dict = {}
    for r in sharded.groupBy("_source", "_shard").agg(F.sum("size").alias("n")).collect():
        held.setdefault(r["_source"], []).append((r["_shard"], r["n"]))
    quotas = []
    for (s, _), q in zip(found, taken, strict=True):
        own = sorted(held[s])
        unit = 1 if min(q, *(n for _, n in own)) < SMALL_BLOCKS * BLOCK else BLOCK
        given = word_quotas([float(n) for _, n in own], q, unit, [n for _, n in own], repeat)
        quotas += [(s, k, n, g) for (k, n), g in zip(own, given, strict=True)]
    by_shard = spark.createDataFrame(quotas, T.StructType([T.StructField("_s", T.StringType()), T.StructField("_k", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_quota", T.LongType())]))
    joined = sharded.join(_sized(by_shard, len(quotas)), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")), "left")
    # A second hash, since all documents of a shard agree in the first one's remainder.
    line = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "_hash"), "_id", "size")
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = joined.withColumn("_end", end).withColumn("_rounds", F.when(F.col("_n") > 0, F.expr("_quota div _n")).otherwise(0))
    rest = F.col("_quota") - F.col("_rounds") * F.col("_n")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("size")))
    return placed.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", (F.col("_rounds") * F.col("size") + part).alias("taken"), "_text")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as its words are taken, with all its columns.

    The one document of a shard where its quota ends has its text cut after the last word taken.
    Rows that agree in id and text share what they take.
    """
    found = mix(docs, id_col, text_col, source_col, **options)
    own_id, own_text, taken, size, copy = unused(docs, "_id", "_hash", "_taken", "_size", "_copy")
    share = found.groupBy(named(id_col).alias(own_id), F.col("_text").alias(own_text)).agg(F.floor(F.sum("taken") / F.count(F.lit(1))).alias(taken), F.max("size").alias(size)).where(F.col(taken) > 0)
    here = named(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(named(text_col)) == F.col(own_text))

    def cut(text: pd.Series, words: pd.Series) -> pd.Series:
        def one(t: str, n: int) -> str:
            for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", t), 1):
                if k == n:
                    return t[: m.end()]
            return t

        return pd.Series([one(t, n) for t, n in zip(text, words, strict=True)])

    whole = docs.join(sized(share.where(F.col(taken) >= F.col(size)), "whole"), here).withColumn(copy, F.explode(F.expr(f"sequence(1, cast({taken} div {size} as int))"))).select(*columns(docs))
    rest = F.expr(f"{taken} % {size}")
    ends = docs.join(sized(share.where(rest > 0), "ends"), here).withColumn(text_col, F.pandas_udf(cut, "string")(named(text_col), rest)).select(*columns(docs))
    return whole.unionByName(ends)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
