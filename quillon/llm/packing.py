"""Operator 6, packing by cutting-stock column generation.

1. One pass tokenizes every document, adds the end token, and cuts it into pieces of ``SEQUENCE``
   tokens and a rest. Only the pieces' places, lengths and checksums are kept.
2. The pieces of each length are counted: at most ``SEQUENCE`` numbers go to the driver.
3. Cutting stock on this histogram: the linear program over patterns (which lengths share a
   sequence) is solved by column generation; a knapsack dynamic program over all lengths prices
   new patterns. The solution is rounded down, and the pieces left over are packed by best fit.
4. The pieces of each length are ranked, and a rank's slot in the patterns gives its sequence and
   offset. Ranks are made of counts by (length, bucket) and numbers in a bucket, so that a length
   which most pieces have is spread over all buckets.

Defined results
  null or empty text: the end token alone. null ids and repeated rows: documents like others.
  empty table: empty result. Very long texts: as many pieces as they need.
  The text of the tokenizer's special token is that token, as the tokenizer's encode() has it.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.scratch import bound_batches, keep

SEQUENCE, END = 1024, 0
#: The linear program stops this close to its lower bound.
GAP = 2e-4
#: Steps of the linear program at most, for its time on the driver; it stands still long before its end.
STEPS = 500
#: Rows of the table of ranks by (length, bucket) up to which it is broadcast; beyond, it is joined by shuffling.
BASE_ROWS = 1 << 18

#: White space of this length in a row is left to tokenizers. Python's white space includes the pattern's.
LONG_SPACE = 1 << 16
_LONG_SPACE = re.compile(rf"(?:\A|(?<=\S))\s{{{LONG_SPACE}}}")

_encoders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, others as U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


def encoder(path: str):
    """A function text -> token ids, equal to tokenizers' encode() with the byte-level BPE file ``path``.

    tiktoken runs the merges, several times faster than tokenizers. Texts that it can't take go to
    tokenizers itself: those that hold the string of a special token, and those with a run of white
    space of ``LONG_SPACE`` characters or more, in which its search for words goes too deep.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(path)

        def encode(text: str) -> list[int]:
            if not any(s in text for s in special) and not (len(text) >= LONG_SPACE and _LONG_SPACE.search(text)):
                try:
                    return fast.encode_ordinary(text)
                except (KeyboardInterrupt, SystemExit, GeneratorExit):
                    raise
                except BaseException:  # noqa: BLE001  a panic of the encoder, which isn't an Exception; the ids are the same
                    pass
            return slow.encode(text, add_special_tokens=False).ids

        _encoders[path] = encode
    return _encoders[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    at.append(k)
                    out.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            numbers = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(numbers[:, c]) for c in range(4))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of the largest value: sum of values, and index -> copies. lengths ascend."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    limits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = limits[c]
        best[c] = best[c - 1]
        if n:
            totals = best[c - lengths[:n]] + values[:n]
            k = int(totals.argmax())
            if totals[k] > best[c] + 1e-12:
                best[c], took[c] = totals[k], k
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[int(took[c])] = pattern.get(int(took[c]), 0) + 1
            c -= int(lengths[took[c]])
    return float(best[capacity]), pattern


def first_basis(lengths: list[int], demand: list[int], capacity: int) -> tuple[list[dict[int, int]], list[float]]:
    """As many patterns as lengths, and the amount of each; together they meet the demand.

    Every pattern starts with the longest length that is left, adds the longest that still fit, and
    lasts until one of its lengths has run out. Ordered by the lengths that run out, the patterns
    are a triangular basis; a length that runs out along with another has a pattern of its own, unused.
    """
    left, alive = [float(n) for n in demand], list(range(len(lengths)))
    basis: list[dict[int, int]] = [{} for _ in lengths]
    amounts = [0.0] * len(lengths)
    while alive:
        pattern: dict[int, int] = {}
        room, at = capacity, len(alive)
        while room and at:
            at = bisect_left(alive, room + 1, 0, at, key=lambda i: lengths[i])
            if at:
                i = alive[at - 1]
                pattern[i] = n = min(room // lengths[i], math.ceil(left[i]))
                room -= n * lengths[i]
                at -= 1
        out = min(pattern, key=lambda i: left[i] / pattern[i])
        amount = left[out] / pattern[out]
        basis[out], amounts[out] = pattern, amount
        for i, n in pattern.items():
            left[i] = 0.0 if i == out else left[i] - amount * n
            if i != out and left[i] < 1e-7:
                left[i] = 0.0
                basis[i] = {i: capacity // lengths[i]}
        alive = [i for i in alive if left[i]]
    return basis, amounts


def matrix(basis: list[dict[int, int]]) -> np.ndarray:
    out = np.zeros((len(basis), len(basis)))
    for k, pattern in enumerate(basis):
        for i, n in pattern.items():
            out[i, k] = n
    return out


def solve(lengths: list[int], demand: list[int], capacity: int, gap: float = GAP, steps: int = STEPS) -> list[tuple[dict[int, int], float]]:
    """Linear program of cutting stock: patterns (index -> copies) with their amounts.

    Revised simplex from ``first_basis``; every step prices by the knapsack program. It ends when no
    pattern has a value above 1, when the sequences are within ``gap`` of a lower bound (their volume,
    or the sequences over the best pattern's value), or after ``steps``.
    """
    ls, d = np.array(lengths), np.array(demand, dtype=float)
    basis, amounts = first_basis(lengths, demand, capacity)
    x = np.array(amounts)
    bound = float(ls @ d) / capacity
    inverse = None
    for step in range(steps):
        if x.sum() <= max(bound * (1 + gap), bound + 1):
            break
        if step % 250 == 0:  # from the basis itself, which takes rounding errors out
            inverse = np.linalg.inv(matrix(basis))
            x = np.maximum(inverse @ d, 0)
        dual = inverse.sum(axis=0)
        value, pattern = knapsack(np.maximum(dual, 0), ls, capacity)
        bound = max(bound, x.sum() / max(value, 1.0))
        if value <= 1 + 1e-9:
            break
        column = np.zeros(len(ls))
        for i, n in pattern.items():
            column[i] = n
        way = inverse @ column
        rises = way > 1e-9
        ratio = np.where(rises, x / np.where(rises, way, 1), np.inf)
        out = int(ratio.argmin())
        theta = max(0.0, float(ratio[out]))
        x = np.maximum(x - theta * way, 0)
        x[out] = theta
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        basis[out] = pattern
    return [(p, float(a)) for p, a in zip(basis, x, strict=True) if a > 1e-9]


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Bins of items (lengths), largest first, each into the fullest bin that it fits."""
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    bins: list[list[int]] = []
    for n in sorted(items, reverse=True):
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(n)
        if free > n:
            insort(room, (free - n, b))
    return bins


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Whole patterns (length -> copies) and how often each is used; together exactly the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[dict[int, int], int]] = []
    if capacity in left:
        out.append(({capacity: 1}, left.pop(capacity)))
    if left:
        lengths = sorted(left)
        for pattern, amount in sorted(solve(lengths, [left[n] for n in lengths], capacity), key=lambda x: -x[1]):
            own = {lengths[i]: n for i, n in pattern.items()}
            times = min([int(amount + 1e-6), *(left[n] // k for n, k in own.items())])
            if times > 0:
                out.append((own, times))
                for n, k in own.items():
                    left[n] -= k * times
    for held in best_fit([n for n, c in left.items() for _ in range(c)], capacity):
        out.append(({n: held.count(n) for n in sorted(set(held), reverse=True)}, 1))
    return out


def slots(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For ranks of a length: (length, first rank, end rank, first sequence, copies in it, first offset)."""
    out, seen, sequence = [], {}, 0
    for pattern, times in plans:
        offset = 0
        for n, copies in pattern.items():
            first = seen.get(n, 0)
            seen[n] = first + copies * times
            out.append((n, first, seen[n], sequence, copies, offset))
            offset += n * copies
        sequence += times
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, buckets: int | None = None) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = keep(pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), size), "pieces").withColumn("_bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = slots(plan(histogram, size))
    long = ("length", "_first", "_end", "_sequence", "_copies", "_offset")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in long])
    # Bounded: a pattern or best-fit bin holds at most ``size`` lengths, and the linear program has at most ``size`` patterns.
    slot = F.broadcast(spark.createDataFrame(rows, schema))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("length", "_bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")
    small = len(histogram) * buckets <= BASE_ROWS
    numbered = cut.withColumn("_no", F.row_number().over(order))
    ranked = numbered.join(F.broadcast(base) if small else base, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_no") - 1)
    placed = ranked.join(slot, (slot["length"] == ranked["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))).drop(slot["length"])
    place = F.col("_rank") - F.col("_first")
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(place / F.col("_copies"))).alias("sequence_id"),
        (F.col("_offset") + (place % F.col("_copies")) * F.col("length")).alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most ``SEQUENCE`` tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
