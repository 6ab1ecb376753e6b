"""The best rows of each query within a task, so that no scores but those are moved."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are scored at a time.
ROWS = 1024
#: Queries up to which they are sent to all tasks; more are joined by shuffling.
BATCH = 4096


class Best:
    """For each query the ``k`` best of all rows seen, by falling rounded score and then by keys as strings."""

    def __init__(self, queries: int, k: int, digits: int = 9):
        self.k, self.digits = k, digits
        self.held: list[list[tuple]] = [[] for _ in range(queries)]
        self.floor = np.full(queries, -np.inf)  # the k-th score of what is held

    def add(self, keys: list[tuple], scores: np.ndarray, valid: np.ndarray) -> None:
        """Scores (rows x queries) of rows with these keys; only where ``valid``."""
        # Nearly all scores are below the k-th that is held, and are only compared with it.
        near = valid & (scores >= self.floor - 10.0**-self.digits)
        seen = np.flatnonzero(near.any(axis=1))
        if not len(seen):
            return
        names = [tuple("" if x is None else str(x) for x in keys[i]) for i in seen]
        order = seen[np.array(sorted(range(len(seen)), key=names.__getitem__))]
        name = dict(zip(seen.tolist(), names, strict=True))
        for q in np.flatnonzero(near.any(axis=0)):
            rows = order[near[order, q]]
            rounded = np.round(scores[rows, q], self.digits)
            best = np.argsort(-rounded, kind="stable")[: self.k]
            new = [(-rounded[i], name[rows[i]], float(scores[rows[i], q]), keys[rows[i]]) for i in best if rounded[i] >= self.floor[q] and rounded[i] > -np.inf]
            held = self.held[q] = heapq.nsmallest(self.k, self.held[q] + new, key=lambda row: row[:2])
            if len(held) == self.k:
                self.floor[q] = -held[-1][0]

    def batches(self, query_keys: pa.Array, key_types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
        """query key, keys, score of all that is held."""
        at = [q for q, held in enumerate(self.held) for _ in held]
        rows = [row for held in self.held for row in held]
        columns = [pa.array([row[3][c] for row in rows], kind) for c, kind in enumerate(key_types)]
        yield pa.RecordBatch.from_arrays([query_keys.take(pa.array(at, pa.int64())), *columns, pa.array([row[2] for row in rows], pa.float64())], names)
