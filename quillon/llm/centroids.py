"""Operator 11, centroid clustering with Hamerly's bounds, in whole numbers.

1. Components become whole numbers. Vectors lie in blocks of ``BLOCK`` rows, each a matrix of bytes,
   in a table bucketed by block, so that it is shuffled once and never again.
2. For every vector a table keeps its centroid, an upper bound of the distance to it and a lower
   bound of the distance to the second-nearest. After a round the upper bound grows by how far its
   own centroid moved, and the lower one shrinks by how far any other moved. If the upper bound is
   still below the lower one, or below half the distance from its centroid to the next, the vector
   stays. If not, the exact distance to its centroid takes the upper bound's place, and vectors that
   are still ambiguous are scanned against all centroids in exact whole numbers, ties to the smaller
   number. Bounds are widened by more than floating numbers can be off, and equal ones are ambiguous.
3. A block hands on its state and, as (place, change) pairs, by how much the sums and counts of the
   centroids change for vectors that moved. These are added up by Spark with map-side sums; the
   driver gets one number for each centroid and component. State and vectors are bucketed alike, so
   a round shuffles the pairs and nothing else.

Defined results
  vectors that are null, of other than ``dimensions`` components, or with null or non-finite ones
  take no part. repeated ids: each row is a vector of its own. null ids: clustered, but never a start.
  Fewer vectors with ids than ``k``: as many centroids. Rows of equal id: the smaller vector starts first.
  No vector: an empty result. Components beyond ``MOST`` as whole numbers are an error, as
  distances would not fit 64 bits. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm.scratch import bound_batches, keep, keep_bucketed
from quillon.llm.topk_search import scaled, usable

K, ROUNDS, DIMENSIONS, SALT = 40, 5, 64, 2
#: Vectors in a block, and vectors that are scanned against all centroids at a time.
BLOCK, AT_ONCE = 4096, 256
#: The largest whole number of a component; beyond, a squared distance of 64 components may not fit 64 bits.
MOST = 1 << 27


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    top = int(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    exact = 4 * top * top * max(1, vectors.shape[1]) < 2**53  # then all sums are exact in floating numbers
    for at in range(0, len(vectors), AT_ONCE):
        own = vectors[at : at + AT_ONCE]
        if exact:
            v, c = own.astype(np.float64), centroids.astype(np.float64)
            out[at : at + AT_ONCE] = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
        else:
            for k, c in enumerate(centroids):
                out[at : at + AT_ONCE, k] = ((own - c) ** 2).sum(1)
    return out


def own_distances(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((vectors - centroids[cluster]) ** 2).sum(1)


#: Bounds are widened by this share of themselves at each step: thousands of times what rounding can do.
SLACK = 1e-9


def above(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def below(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


class Bounds:
    """What a round needs to know of the centroids: they, how far each moved, and half the way to its next."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        between = np.sqrt(distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.half = below(between.min(axis=1, initial=np.inf) / 2)
        moved = above(np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64))) if before is not None else np.zeros(k)
        order = np.argsort(-moved)
        self.moved = moved
        self.others = np.full(k, moved[order[0]])  # the furthest that any other centroid moved
        self.others[order[0]] = moved[order[1]] if k > 1 else 0.0

    def scan(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, and bounds: exact distances to it and to the second-nearest."""
        found = distances(vectors, self.centroids)
        cluster = found.argmin(axis=1)  # the first of equals
        rows = np.arange(len(vectors))
        upper = above(np.sqrt(found[rows, cluster].astype(np.float64)))
        if len(self.centroids) == 1:
            return cluster, upper, np.full(len(vectors), np.inf)
        found[rows, cluster] = np.iinfo(np.int64).max
        return cluster, upper, below(np.sqrt(found.min(axis=1).astype(np.float64)))

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The new state, and how many vectors were scanned."""
        upper, lower = above(upper + self.moved[cluster]), np.maximum(0.0, below(lower - self.others[cluster]))
        limit = np.maximum(lower, self.half[cluster])
        doubt = np.flatnonzero(upper >= limit)
        upper[doubt] = above(np.sqrt(own_distances(vectors[doubt], self.centroids, cluster[doubt]).astype(np.float64)))
        doubt = doubt[upper[doubt] >= limit[doubt]]
        cluster = cluster.copy()
        if len(doubt):
            cluster[doubt], upper[doubt], lower[doubt] = self.scan(vectors[doubt])
        return cluster, upper, lower, len(doubt)


def changes(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and changes of the counts (the first place of a centroid) and sums of the centroids; only those that change."""
    d = vectors.shape[1]
    total = np.zeros((k, d + 1), np.int64)
    moved = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    rows = np.concatenate([np.ones((len(moved), 1), np.int64), vectors[moved]], axis=1)
    np.add.at(total, new[moved], rows)
    if old is not None:
        np.subtract.at(total, old[moved], rows)
    flat = total.ravel()
    at = np.flatnonzero(flat)
    return at, flat[at]


def blocks(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dimensions: int) -> DataFrame:
    """block, ids, vectors (a matrix of 64-bit whole numbers, or shorter ones where all fit): ``BLOCK`` rows each at most."""
    v = scaled(F.col(vector_col), scale)
    fit = F.forall(v, lambda x: F.abs(x) <= MOST)
    rows = vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) == dimensions)).select(
        F.spark_partition_id().cast("long").alias("part"), F.col(id_col).alias("id"), F.when(fit, v).otherwise(F.raise_error(F.lit(f"components beyond {MOST}")).cast("array<long>")).alias("v")
    )
    ids = T.ArrayType(vectors.schema[id_col].dataType)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", ids), T.StructField("vectors", T.BinaryType())])
    names = to_arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                values = own.column(2).flatten().to_numpy()
                low, high = int(values.min()), int(values.max())
                kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
                block = (own.column(0)[0].as_py() << 32) + number
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(1)).cast(names.field(1).type), pa.array([values.astype(kind).tobytes()], pa.binary())], schema=names)

    return rows.mapInArrow(build, schema)


def _matrix(data: bytes, rows: int, dimensions: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (rows * dimensions)]
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, dimensions)


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, salt: int, scale: int, dimensions: int) -> np.ndarray:
    """The vectors whose ids have the smallest SHA-256 after the salt, ``k`` at most."""
    rows = vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) == dimensions) & F.col(id_col).isNotNull())
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")), 256).alias("h"), scaled(F.col(vector_col), scale).alias("v"))
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dimensions)


_STATE = "block long, cluster binary, upper binary, lower binary, scanned long, changes array<struct<place: int, change: long>>"


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, dimensions: int = DIMENSIONS, salt: int = SALT, counted: list[int] | None = None) -> DataFrame:
    """One row a vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256. ``counted`` gets each round's scanned vectors."""
    spark = vectors.sparkSession
    bound_batches(spark)
    centroids = first_centroids(vectors, id_col, vector_col, k, salt, scale, dimensions)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held, drop_blocks = keep_bucketed(blocks(vectors, id_col, vector_col, scale, dimensions).repartition(parts, "block"), "blocks", "block")
    k = len(centroids)
    matrix, before, state, drop_state = held.select("block", F.size("ids").alias("n"), "vectors"), None, None, None
    sums = np.zeros((k, dimensions + 1), object)
    for turn in range(rounds + 1 if k else 0):
        known = Bounds(centroids, before)

        def assign(batches: Iterator[pa.RecordBatch], known: Bounds = known, first: bool = turn == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    block, n, data, *old = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
                    own = _matrix(data, n, dimensions)
                    if first:
                        was, (now, upper, lower), scanned = None, known.scan(own), n
                    else:
                        was = np.frombuffer(old[0], np.int32)
                        now, upper, lower, scanned = known.assign(own, was, np.frombuffer(old[1]), np.frombuffer(old[2]))
                    at, by = changes(own, was, now, len(known.centroids))
                    pairs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(by)], ["place", "change"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (now.astype(np.int32), upper, lower)), pa.array([scanned], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pairs)],
                        ["block", "cluster", "upper", "lower", "scanned", "changes"],
                    )

        rows = matrix if state is None else matrix.join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block")
        new, drop_new = keep_bucketed(rows.mapInArrow(assign, _STATE), "state", "block")
        if drop_state:
            drop_state()
        state, drop_state = new, drop_new
        if counted is not None:
            counted.append(state.agg(F.sum("scanned")).first()[0] or 0)
        if turn < rounds:
            # At most a number for each component and count of the centroids.
            found = state.select(F.inline("changes")).groupBy("place").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect()
            for r in found:
                sums[divmod(r["place"], dimensions + 1)] += int(r["change"])
            before = centroids
            centroids = np.array([[int(x) // int(row[0]) for x in row[1:]] if row[0] else list(old) for row, old in zip(sums, centroids, strict=True)], np.int64)
    kind = vectors.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    last = centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, data, own = batch.column(0)[row].values, batch.column(1)[row].as_py(), np.frombuffer(batch.column(2)[row].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(own_distances(_matrix(data, len(own), dimensions), last, own))], ["id", "cluster", "distance"])

    if not k:
        drop_blocks()
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), *out.fields[1:], T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]))
    both = held.join(state.select("block", "cluster").hint("merge"), "block").select("ids", "vectors", "cluster")
    measured = keep(both.mapInArrow(measure, out), "clusters")
    drop_state()
    drop_blocks()
    inertia = {r["cluster"]: r["s"] for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values(), Decimal(0))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in last.tolist()]
    per = spark.createDataFrame([(c, int(s), int(total), digests[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` in ``K`` clusters after ``ROUNDS`` rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(n: int) -> str:
    """Assignment number ``n``, and the centroids that follow from it."""
    squares = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"""a{n} AS MATERIALIZED (SELECT k, m % 64 AS c, m // 64 AS d FROM (SELECT v.k, min(CAST({squares} AS BIGINT) * 64 + c.c) AS m FROM v CROSS JOIN c{n} c GROUP BY v.k)),
u{n} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS j FROM v JOIN a{n} a ON a.k = v.k) GROUP BY c, j),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(w.e, c{n}.e) AS e FROM c{n} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM u{n} GROUP BY c) w ON w.c = c{n}.c)"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('{SALT}:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {K})),
{", ".join(_round_sql(n) for n in range(ROUNDS + 1))}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a ON a.k = v.k JOIN c{ROUNDS} c ON c.c = a.c
"""
