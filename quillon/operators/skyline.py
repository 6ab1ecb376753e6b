"""The Pareto set of a table: rows that no other row is as good as in every measure and better than in one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.scratch import keep

#: Candidates in a block; two blocks are compared in a task.
BLOCK = 1 << 13


def dominated(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows are dominated by one of ``by``; more is better in every column."""
    out = np.zeros(len(rows), bool)
    for best in by:
        left = np.flatnonzero(~out)
        own = rows[left]
        out[left] = (best >= own).all(axis=1) & (best > own).any(axis=1)
    return out


def best_rows(rows: np.ndarray) -> np.ndarray:
    """Places of the rows that no other dominates, equal ones all.

    In falling order by the columns a row stands after all that dominate it, so each row found is one of
    the result, and takes those that it dominates out of the rest.
    """
    left = np.lexsort(tuple(-rows[:, c] for c in range(rows.shape[1] - 1, -1, -1)))
    found = []
    while len(left):
        first = rows[left[0]]
        same = (rows[left] == first).all(axis=1)
        found.append(left[same])
        left = left[~same]
        left = left[~((first >= rows[left]).all(axis=1))]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _measure(name: str, sign: int) -> Column:
    """A measure of which more is better; null and NaN are worse than anything."""
    value = F.col(name).cast("double") * sign
    return F.when(value.isNull() | F.isnan(value), F.lit(float("-inf"))).otherwise(value)


def skyline(rows: DataFrame, most: list[str], least: list[str]) -> DataFrame:
    """The rows of the Pareto set, ties included: ``most`` is to be large, ``least`` small.

    Each task first reduces its rows to their own Pareto set. What is left of all tasks lies in blocks
    by range of the first measure, and a block is compared with itself and those above it, as no other
    can hold what dominates its rows. A null or NaN measure is the worst.
    """
    measures = [_measure(c, 1) for c in most] + [_measure(c, -1) for c in least]
    if not measures:
        raise ValueError("a Pareto set needs a measure")
    names = [f"_m{k}" for k in range(len(measures))]
    wide = rows.select("*", *(m.alias(n) for m, n in zip(measures, names, strict=True)))
    at = [wide.columns.index(n) for n in names]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            values = np.stack([both.column(c).to_numpy() for c in at], axis=1)
            held = both.take(pa.array(np.sort(best_rows(values))))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    left = keep(wide.mapInArrow(local, wide.schema).withColumn("_id", F.monotonically_increasing_id()), "candidates")
    blocks = max(1, -(-left.count() // BLOCK))
    placed = keep(left.select("_id", F.array(*names).alias("m")).repartitionByRange(blocks, F.desc(F.col("m")[0])).withColumn("block", F.spark_partition_id()), "blocks")
    below = placed.select("_id", "m", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("a"), F.col("block").alias("b"), F.lit(True).alias("asked"))
    above = placed.select("_id", "m", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("b"), F.lit(False).alias("asked"))

    def compare(table: pa.Table) -> pa.Table:
        asked = table["asked"].to_numpy()
        values = table["m"].combine_chunks().flatten().to_numpy().reshape(len(asked), -1)
        by = values[~asked]
        gone = dominated(values[asked], by[best_rows(by)]) if len(by) else np.zeros(asked.sum(), bool)
        return pa.table({"_id": pa.array(table["_id"].to_numpy()[asked][gone])})

    gone = below.unionByName(above).groupBy("a", "b").applyInArrow(compare, T.StructType([T.StructField("_id", T.LongType())])).distinct()
    return left.join(gone, "_id", "left_anti").select(*rows.columns)
