"""Operator 10, exact top-k search by vector-approximation files.

1. Every vector gets an approximation file entry: one byte for each component names one of at most
   2 ** ``BITS`` equal cells between the least and the largest component. These codes are kept once.
   Of equal vectors only the k + 1 rows of smallest id can be among the k best, so only those are
   candidates.
2. Codes and queries are dealt into blocks. In a pair of blocks the codes are scanned: the cells'
   middles give an approximate score, and half a cell times the query's absolute sum is how far it
   can be off, which makes a lower and an upper bound. A code is passed on if its upper bound reaches
   the k-th largest lower bound, first of the block and then of all blocks. Where nothing can be off
   (a query of zeros, or whole numbers that have a cell each), ties are settled by id at once.
   If the bounds leave more than ``MANY`` vectors of a block in doubt for a query, as in a large
   cluster of nearly equal vectors, the block as a whole is passed on for it instead.
3. Exact vectors are read for what is left, by row: first the ``FIRST`` beyond k of highest upper
   bounds, then those whose upper bound still reaches the k-th exact score. No other can be among
   the k best. Of blocks passed on as a whole, all exact vectors are read, and the k best go on.

Scanning grows with queries times codes, as exact search asks; memory is a pair of blocks. Exact
vectors are read only where the bounds leave a doubt.

Defined results
  vectors null or with null or non-finite components, and null ids, take no part.
  repeated ids: each row is a candidate of every other row's search, and asks for itself if its id does.
  Ties go to the smaller id. Vectors of different lengths have no score with each other.
  scores must fit 64 bits. Fewer than k other vectors: all of them. An empty table: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.scratch import bound_batches, hot_keys, keep, salted_join

BITS = 8
#: Codes and queries in a block, and queries that are scanned at a time.
VECTORS, QUERIES, AT_ONCE = 32768, 2048, 128
#: Exact vectors read for a query at first, beyond k.
FIRST = 4
#: Vectors of a block that one query may leave in doubt before the block is read as a whole.
MANY = 64
#: Stands for a row where a block is meant.
WHOLE = -1


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, taken as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def cells(low: int, high: int) -> int:
    """Whole numbers in a cell: at most 2 ** BITS cells hold all from ``low`` to ``high``."""
    return -(-(high - low + 1) // (1 << BITS))


def scan(queries: np.ndarray, query_rows: np.ndarray, codes: np.ndarray, rows: np.ndarray, ids: np.ndarray, low: int, width: int, k: int, many: int = MANY) -> Iterator[tuple[np.ndarray, ...]]:
    """(query row, row, lower bound, upper bound) of the codes whose upper bound reaches the k-th largest lower bound, in parts.

    A query's own row takes no part. Bounds are wide enough for the rounding of floating numbers,
    and whole numbers below 2 ** 53 have none.
    """
    order = np.lexsort((rows, ids))
    rows, middles = rows[order], low + codes[order].astype(np.float64) * width + (width - 1) / 2
    weight = np.abs(queries).sum(axis=1)
    top = weight * np.abs(middles).max(initial=0)
    reach = weight * ((width - 1) / 2) + np.where(top < 2**52, 0.0, top * 1e-12 * max(1, queries.shape[1]))
    for at in range(0, len(queries), AT_ONCE):
        about = queries[at : at + AT_ONCE] @ middles.T
        about[query_rows[at : at + AT_ONCE, None] == rows[None, :]] = -np.inf
        own_reach = reach[at : at + AT_ONCE, None]
        least = np.partition(about, -k, axis=1)[:, -k, None] - own_reach if about.shape[1] > k else np.full_like(own_reach, -np.inf)
        some = (about + own_reach >= least) & (about > -np.inf)
        for n in np.flatnonzero((own_reach[:, 0] == 0) & (some.sum(axis=1) > k)):  # all scores are known: k of the smallest ids among equals
            some[n, np.flatnonzero(some[n] & (about[n] == least[n]))[k - np.count_nonzero(about[n] > least[n]) :]] = False
        n, m = np.nonzero(some & (some.sum(axis=1) <= max(many, k))[:, None])
        yield query_rows[at + n], rows[m], about[n, m] - reach[at + n], about[n, m] + reach[at + n]
        n = np.flatnonzero(some.sum(axis=1) > max(many, k))  # the block: the bound that k of its vectors reach, and the highest one
        yield query_rows[at + n], np.full(len(n), WHOLE), least[n, 0], about[n].max(axis=1, initial=-np.inf) + reach[at + n]


def best_of(queries: np.ndarray, query_rows: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query row, query id, id, score) of each query's k best vectors by exact scores, in parts."""
    order = np.lexsort((rows, ids))
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    # Products and sums below 2 ** 53 are exact in floating numbers.
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if top < 2**53 else object
    held = vectors.astype(kind).T
    for at in range(0, len(queries), AT_ONCE):
        scores = queries[at : at + AT_ONCE].astype(kind) @ held
        for n, row in enumerate(query_rows[at : at + AT_ONCE]):
            others = np.flatnonzero(rows != row)
            best = others[np.argsort(-scores[n, others], kind="stable")[:k]]
            yield np.full(len(best), row), np.full(len(best), query_ids[at + n]), ids[best], scores[n, best].astype(np.int64)


def coded(rows: DataFrame, low: int, width: int) -> DataFrame:
    """row, id, d, code: a byte for each component."""
    wide = width > 1 << 54  # beyond, differences may not fit 64 bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes = [], []
            for v in batch.column(2):
                own = v.values.to_numpy()
                codes.append((((own.astype(object) if wide else own) - low) // width).astype(np.uint8).tobytes())
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary())], ["row", "id", "d", "code"])

    return rows.select("row", "id", "v").mapInArrow(build, "row long, id long, d int, code binary")


def _dealt(row: str, n: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(n)).cast("int")


def _matrix(column: pa.ChunkedArray, d: int, kind: type) -> np.ndarray:
    """The lists of ``d`` whole numbers each as a matrix."""
    return column.combine_chunks().flatten().to_numpy().astype(kind).reshape(-1, d) if d else np.zeros((len(column), 0), kind)


def bounds(codes: DataFrame, asked: DataFrame, across: int, down: int, low: int, width: int, k: int) -> DataFrame:
    """q, x, row, lower, upper: what the scans of all pairs of blocks pass on; row is ``WHOLE`` for a block x as a whole."""
    many = MANY
    none = lambda kind: F.lit(None).cast(kind)
    held = codes.select("d", "row", "id", "code", none("array<long>").alias("v"), _dealt("row", across).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"))
    queries = asked.select(F.size("v").alias("d"), "row", "id", none("binary").alias("code"), "v", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), _dealt("row", down).alias("y"))

    def search(table: pa.Table) -> pa.Table:
        d, rows, ids = table["d"][0].as_py(), table["row"].to_numpy(), table["id"].to_numpy()
        mask = table["code"].is_valid()
        is_code = mask.to_numpy()
        codes_ = np.frombuffer(b"".join(table["code"].filter(mask).to_pylist()), np.uint8).reshape(is_code.sum(), d)
        queries_ = _matrix(table["v"].filter(pa.array(~is_code)), d, np.float64)
        got = list(zip(*scan(queries_, rows[~is_code], codes_, rows[is_code], ids[is_code], low, width, k, many), strict=True)) if is_code.any() else []
        q, row, lower, upper = [np.concatenate(x) for x in got] or [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table({"q": q, "x": pa.array(np.full(len(q), table["x"][0].as_py()), pa.int32()), "row": row, "lower": lower, "upper": upper})

    return held.unionByName(queries).groupBy("d", "x", "y").applyInArrow(search, "q long, x int, row long, lower double, upper double")


def whole_blocks(blocks: DataFrame, candidates: DataFrame, asked: DataFrame, across: int, down: int, k: int) -> DataFrame:
    """q, query_id, vec_id, score: the k best in each of ``blocks`` (q, x), a kept table, by all its exact vectors."""
    own = asked.select(F.col("row").alias("q"), F.col("id"), "v")
    queries = blocks.join(own, "q").select(F.size("v").alias("d"), "x", _dealt("q", down).alias("y"), F.col("q").alias("row"), "id", "v", F.lit(True).alias("asks"))
    needed = blocks.select("x", _dealt("q", down).alias("y")).distinct()
    held = candidates.withColumn("x", _dealt("row", across)).join(needed, "x").select(F.size("v").alias("d"), "x", "y", "row", "id", "v", F.lit(False).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        d, asks, rows, ids = table["d"][0].as_py(), table["asks"].to_numpy(), table["row"].to_numpy(), table["id"].to_numpy()
        values = _matrix(table["v"], d, np.int64)
        got = list(zip(*best_of(values[asks], rows[asks], ids[asks], values[~asks], rows[~asks], ids[~asks], k), strict=True)) if asks.any() else []
        return pa.table(dict(zip(("q", "query_id", "vec_id", "score"), [np.concatenate(x) for x in got] or [np.zeros(0, np.int64)] * 4, strict=True)))

    return held.unionByName(queries).groupBy("d", "x", "y").applyInArrow(search, "q long, query_id long, vec_id long, score long")


def exact(pairs: DataFrame, candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """``pairs`` (q, row), a kept table, with vec_id and score: the only place where candidates' exact vectors are read."""
    read = salted_join(pairs, candidates.select("row", F.col("id").alias("vec_id"), "v"), "row", "q", hot_keys(pairs, "row", "hot"))
    both = read.join(asked.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("asking")), "q")
    score = F.aggregate(F.zip_with("v", "asking", lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x)
    return both.select("q", "query_id", "vec_id", score.alias("score"))


def kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """q and its k-th largest value, or null if it has fewer."""
    order = Window.partitionBy("q").orderBy(F.desc(value))
    best = rows.select("q", value).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k)
    return best.groupBy("q").agg(F.min(F.when(F.col("_i") == k, F.col(value))).alias(name))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best other vectors of every query by integer inner product: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    bound_batches(spark)
    usable_rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = keep(usable_rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), scaled(F.col(vector_col), scale).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    equal = Window.partitionBy("v").orderBy("id", "row")
    candidates = keep(rows.withColumn("_i", F.row_number().over(equal)).where(F.col("_i") <= k + 1).select("row", "id", "v"), "candidates")
    size = candidates.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low, high = size["low"] or 0, size["high"] or 0
    width = cells(low, high)
    asked = rows.where("asks").select("row", "id", "v")
    codes = keep(coded(candidates, low, width), "codes")
    across, down = max(1, -(-codes.count() // VECTORS)), max(1, -(-asked.count() // QUERIES))
    found = keep(bounds(codes, asked, across, down, low, width, k), "bounds")
    single, block = found.where(F.col("row") != WHOLE), found.where(F.col("row") == WHOLE)
    # What reaches the k-th largest lower bound of all, in the order of upper bounds.
    least = kth(single, "lower", k, "_single").join(block.groupBy("q").agg(F.max("lower").alias("_block")), "q", "full").select("q", F.greatest("_single", "_block").alias("_least"))
    reaching = F.col("_least").isNull() | (F.col("upper") >= F.col("_least"))
    order = Window.partitionBy("q").orderBy(F.desc("upper"), "row")
    doubtful = keep(single.join(least, "q").where(reaching).select("q", "row", "upper").withColumn("_i", F.row_number().over(order)), "doubtful")
    blocks = keep(block.join(least, "q").where(reaching).select("q", "x"), "blocks")
    first = keep(exact(keep(doubtful.where(F.col("_i") <= k + FIRST).select("q", "row"), "first"), candidates, asked), "scores")
    more = doubtful.where(F.col("_i") > k + FIRST).join(kth(first, "score", k, "_kth"), "q").where(F.col("upper") >= F.col("_kth"))
    scores = first.unionByName(exact(keep(more.select("q", "row"), "more"), candidates, asked)).unionByName(whole_blocks(blocks, candidates, asked, across, down, k))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best others of every vector of ``embeddings`` whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.k <> c.k AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
