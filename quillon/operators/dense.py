"""Vector retrieval: a word projection as sparse vectors, and cosine top-k over arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions.text import normalize_space
from quillon.functions.vectors import DECAY, DIMENSION, norm
from quillon.operators.lexical import rank
from quillon.operators.local_topk import BATCH, ROWS, Best
from quillon.sources.scratch import bound_batches, keep
from quillon.sources.tables import LANGUAGES

PASSAGE, QUERY = "passage:", "query:"
#: Words whose hashes a worker keeps before it forgets them.
KNOWN_WORDS = 50_000


def _hashed(word: str) -> tuple[int, float]:
    h = int.from_bytes(hashlib.md5(word.encode()).digest(), "big")
    return h % DIMENSION, (h >> 16) % 1000 / 500.0 - 1.0


#: Words of texts whose numbers are held at once.
HELD_WORDS = 1 << 17


class _Known(dict):
    """word -> bucket * 1000 + its value in 500ths above -1."""

    def __missing__(self, word: str) -> int:
        bucket, value = _hashed(word)
        self[word] = code = bucket * 1000 + round((value + 1.0) * 500.0)
        return code


class Projector:
    """Vectors of texts, with the hashes of words kept."""

    def __init__(self, prefix: str):
        self.prefix, self.known = prefix, _Known()

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """All buckets' sums of one text, and the buckets that words fall into."""
        sums, used = self.matrix([text])
        return sums[0], np.flatnonzero(used[0])

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of all buckets' sums a text, and whether words fall into a bucket. Sums that are all zero become the first unit vector."""
        sums, used = np.zeros((len(texts), DIMENSION)), np.zeros((len(texts), DIMENSION), bool)
        codes, sizes, first = [], [], 0
        for n, text in enumerate(texts, 1):
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            before = len(codes)
            codes.append(self.known[self.prefix])
            codes.extend(map(self.known.__getitem__, text.split(" ")))
            sizes.append(len(codes) - before)
            if len(codes) >= HELD_WORDS or n == len(texts):
                bucket, part = np.divmod(np.array(codes, np.int64), 1000)
                size = np.array(sizes)
                place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
                cell = np.repeat(np.arange(n - first), size) * DIMENSION + bucket
                weights = (part / 500.0 - 1.0) / (1.0 + DECAY * place)
                sums[first:n] = np.bincount(cell, weights, (n - first) * DIMENSION).reshape(-1, DIMENSION)
                used[first:n].reshape(-1)[cell] = True
                codes, sizes, first = [], [], n
        zero = ~sums.any(axis=1)
        sums[zero, 0], used[zero], used[zero, 0] = 1.0, False, True
        return sums, used


def projected_text(text_col: str) -> Column:
    return F.lower(normalize_space(text_col))


def prefixed(text: Column, prefix: str) -> Column:
    """The text as a model reads it; a blank text is an error."""
    spaced = normalize_space(text)
    return F.when(F.coalesce(spaced, F.lit("")) == "", F.raise_error(F.lit("texts to embed must not be blank")).cast("string")).otherwise(F.concat(F.lit(prefix + " "), spaced))


def query_tokens(queries: DataFrame, query: str = "query") -> DataFrame:
    """query_key, tokens: how many words a model reads for each query, its prefix among them."""
    return queries.select("query_key", F.size(F.split(prefixed(F.col(query), QUERY), " ")).cast("long").alias("tokens"))


def projection(rows: DataFrame, keys: list[str], text_col: str, prefix: str) -> DataFrame:
    """keys, idx, v, norm: each text's sparse vector, not yet normalised, with its length; blank texts have none.

    A text's vector needs that text alone, so nothing is shuffled: Arrow batches of texts, with the
    hashes of words kept in each worker. ``functions.vectors`` has the same as columns, which would
    hash every word anew and shuffle every bucket.
    """
    source = rows.select(*keys, projected_text(text_col).alias("_t")).where("_t <> ''")
    schema = T.StructType([*(source.schema[k] for k in keys), T.StructField("idx", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("norm", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projector = Projector(prefix)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sums, used = projector.matrix(batch.column(len(keys)).to_pylist())
            at, idx = np.nonzero(used)
            norms = np.sqrt((sums * sums).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(len(keys))), pa.array(idx.astype(np.int32)), pa.array(sums[at, idx]), pa.array(norms[at])], schema.names)

    bound_batches(rows.sparkSession)
    return source.mapInArrow(run, schema)


def sparse_cosine(queries: DataFrame, docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """query_key, keys, score of every query and document that share a bucket, joined by bucket."""
    q, d = projection(queries, ["query_key"], "query", QUERY), projection(docs, keys, text_col, PASSAGE)
    asked = q.select("query_key", "idx", (F.col("v") / F.col("norm")).alias("a"))
    unit = d.select(*keys, "idx", (F.col("v") / F.col("norm")).alias("b"))
    return unit.join(asked, "idx").groupBy("query_key", *keys).agg(F.sum(F.col("a") * F.col("b")).alias("score"))


def _units(projector: Projector, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of length 1 a text, and a row with 1 where its words fall."""
    sums, used = projector.matrix(texts)
    return sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True)), used.astype(np.float32)


def sparse_topk(queries: DataFrame, docs: DataFrame, keys: list[str], k: int = 5, text_col: str = "text") -> DataFrame:
    """query_key, keys, score, rank: the ``k`` documents of every query with the most similar projection.

    Up to ``BATCH`` queries are sent to all tasks as a matrix; a task makes the vectors of its texts,
    multiplies, and passes on its best alone. More queries are joined by bucket.
    """
    if queries.count() > BATCH:
        return rank(sparse_cosine(queries, docs, keys, text_col), k, keys, positive=False)
    own = queries.select("query_key", projected_text("query").alias("_t")).where("_t <> ''").collect()
    matrix, used = (m.T for m in _units(Projector(QUERY), [r["_t"] for r in own]))
    query_type = queries.schema["query_key"].dataType
    shared = docs.sparkSession.sparkContext.broadcast((matrix, used, pa.array([r["query_key"] for r in own], to_arrow_type(query_type))))
    source = docs.select(*keys, projected_text(text_col).alias("_t")).where("_t <> ''")
    key_fields = [source.schema[c] for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix_, used_, query_keys = shared.value
        best, passages = Best(len(query_keys), k), Projector(PASSAGE)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, marks = _units(passages, part.column(len(keys)).to_pylist())
                best.add(list(zip(*(part.column(c).to_pylist() for c in range(len(keys))), strict=True)), rows @ matrix_, marks @ used_ > 0)
        yield from best.batches(query_keys, [to_arrow_type(f.dataType) for f in key_fields], ["query_key", *keys, "score"])

    bound_batches(docs.sparkSession)
    found = source.mapInArrow(run, T.StructType([T.StructField("query_key", query_type), *key_fields, T.StructField("score", T.DoubleType())]))
    return rank(found, k, keys, positive=False)


def of_language(points: DataFrame, target_lang: str | None, language_col: str = "language", target_col: str = "target_lang") -> DataFrame:
    """Points of one target language alone, by both of its codes; all points without one. It is pushed down into the scan."""
    if not target_lang:
        return points
    known = {target: name for name, (target, _) in LANGUAGES.items()}
    if target_lang.strip() not in known:
        raise ValueError(f"unknown target language: {target_lang}")
    return points.where((F.col(language_col) == known[target_lang.strip()]) & (F.col(target_col) == target_lang.strip()))


def _unit(vector: Column) -> Column:
    """The vector as doubles of length 1; null where it has none: null, of zeros, or with nulls or values that aren't finite."""
    length = norm(vector)
    return F.when((length > 0) & (length < float("inf")), F.transform(vector, lambda x: x.cast("double") / length))


def cosine_topk(queries: DataFrame, points: DataFrame, keys: list[str], vector: str = "embedding", k: int = 5, threshold: float | None = None) -> DataFrame:
    """query_key, keys, score, rank: the ``k`` most similar points of every query (query_key, vector), among those of its size.

    Queries are dealt into blocks of about ``BATCH``. A block is sent to all tasks as matrices, one for each
    size; a task multiplies its points by them and passes on its best alone, so points are never moved.
    The work is queries times points, but a task and the driver hold one block at a time.
    """
    asked = queries.select("query_key", _unit(F.col(vector)).alias("_q")).where("_q is not null")
    held = points.select(*keys, _unit(F.col(vector)).alias("_p")).where("_p is not null")
    blocks = -(-asked.count() // BATCH)
    if blocks > 1:
        asked = keep(asked.withColumn("_b", F.pmod(F.xxhash64("query_key"), F.lit(blocks))).repartition(blocks, "_b"), "queries")
        held = keep(held, "vectors")
    parts = [_block_topk(asked.where(F.col("_b") == n).drop("_b") if blocks > 1 else asked, held, keys, k, threshold) for n in range(max(blocks, 1))]
    return rank(reduce(DataFrame.unionByName, parts), k, keys, positive=False)


def _block_topk(asked: DataFrame, held: DataFrame, keys: list[str], k: int, threshold: float | None) -> DataFrame:
    """query_key, keys, score of each task's ``k`` best points (keys, _p) of every query (query_key, _q), all of length 1."""
    own = asked.collect()  # a block
    query_type = to_arrow_type(asked.schema["query_key"].dataType)
    of_size = {n: [r for r in own if len(r["_q"]) == n] for n in {len(r["_q"]) for r in own}}
    matrices = {n: (np.array([r["_q"] for r in rows]).T, pa.array([r["query_key"] for r in rows], query_type)) for n, rows in of_size.items()}
    shared = asked.sparkSession.sparkContext.broadcast(matrices)
    key_fields = [held.schema[c] for c in keys]
    names = ["query_key", *keys, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(query_keys), k) for n, (_, query_keys) in shared.value.items()}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(len(keys))).to_numpy(zero_copy_only=False)
            for n in np.intersect1d(sizes, list(best)):
                alike = batch.take(pa.array(np.flatnonzero(sizes == n)))
                for at in range(0, alike.num_rows, ROWS):
                    part = alike.slice(at, ROWS)
                    scores = part.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) @ shared.value[n][0]
                    valid = np.ones_like(scores, bool) if threshold is None else scores >= threshold
                    best[n].add(list(zip(*(part.column(c).to_pylist() for c in range(len(keys))), strict=True)), scores, valid)
        for n, found in best.items():
            yield from found.batches(shared.value[n][1], [to_arrow_type(f.dataType) for f in key_fields], names)

    bound_batches(asked.sparkSession)
    return held.mapInArrow(run, T.StructType([asked.schema["query_key"], *key_fields, T.StructField("score", T.DoubleType())]))


def encode(rows: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = PASSAGE, batch: int = 16) -> DataFrame:
    """``rows`` with an ``embedding`` by a model of the caller's, of unit length; blank texts are an error.

    ``load`` runs once in each Python worker and returns a function from texts to a matrix.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    place = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [" ".join((t or "").split()) for t in part.column(place).to_pylist()]
            if not all(texts):
                raise ValueError("texts to embed must not be blank")
            matrix = np.concatenate([np.asarray(model([f"{prefix} {t}" for t in texts[i : i + batch]]), dtype=np.float64) for i in range(0, len(texts), batch)])
            unit = matrix / np.clip(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12, None)
            offsets = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1], pa.int32())
            vectors = pa.ListArray.from_arrays(offsets, pa.array(unit.astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*part.columns, vectors], schema.names)

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def load_projection() -> Callable[[list[str]], np.ndarray]:
    """The word projection as a model for ``encode``: the first word of a text is its prefix."""
    projectors: dict[str, Projector] = {}

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSION))
        parts = [t.partition(" ") for t in texts]
        for prefix in {p for p, _, _ in parts}:
            at = [i for i, p in enumerate(parts) if p[0] == prefix]
            out[at] = projectors.setdefault(prefix, Projector(prefix)).matrix([parts[i][2].lower() for i in at])[0]
        return out

    return model
