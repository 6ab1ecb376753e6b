"""Answers of a model outside the engine, with the extractive answer wherever it doesn't give one.

A model is made by each task and called for a row at a time, several calls at once. A call that fails is
tried again after growing pauses; one that isn't done by its deadline is given up. Threads that hang
can't be ended, so once ``LOST`` times as many as run at once have been given up, a task calls no more.
A row without an answer keeps its fallback, and says why; no row is lost and no task fails for a model.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[str], str | None]
#: The harness's limit for an answer, tries, the first pause, and calls at once.
DEADLINE, ATTEMPTS, PAUSE, AT_ONCE = 30.0, 3, 0.2, 8
LOST = 4


class Calls:
    """Calls of one task's model."""

    def __init__(self, model: Model, deadline: float = DEADLINE, attempts: int = ATTEMPTS, pause: float = PAUSE, at_once: int = AT_ONCE):
        if deadline <= 0 or attempts < 1 or at_once < 1:
            raise ValueError("a deadline above 0, an attempt and a call at least are needed")
        self.model, self.deadline, self.attempts, self.pause, self.at_once = model, deadline, attempts, pause, at_once
        self.lost = 0

    def _try(self, number: int, prompt: str, done: queue.Queue, ends: float) -> None:
        error = "error"
        for k in range(self.attempts):
            try:
                answer = self.model(prompt)
                done.put((number, answer if answer and answer.strip() else None, None if answer and answer.strip() else "empty"))
                return
            except Exception as e:  # noqa: BLE001  whatever a model raises, the row has a fallback
                error = type(e).__name__
            rest = self.pause * 2**k
            if k + 1 == self.attempts or time.monotonic() + rest >= ends:
                break
            time.sleep(rest)
        done.put((number, None, error))

    def all(self, prompts: list[str | None]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each prompt; one of them is null."""
        out: list[tuple[str | None, str | None]] = [(None, "no_prompt")] * len(prompts)
        done: queue.Queue = queue.Queue()
        waiting, running = [k for k, p in enumerate(prompts) if p is not None][::-1], {}
        while waiting or running:
            while waiting and len(running) < self.at_once:
                if running and self.lost + len(running) >= LOST * self.at_once:
                    break
                k = waiting.pop()
                if self.lost >= LOST * self.at_once:
                    out[k] = None, "given_up"
                    continue
                running[k] = time.monotonic() + self.deadline
                threading.Thread(target=self._try, args=(k, prompts[k], done, running[k]), daemon=True).start()
            if not running:
                continue
            try:
                k, answer, error = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
                if running.pop(k, None) is not None:  # else it had been given up
                    out[k] = answer, error
            except queue.Empty:
                for k in [k for k, ends in running.items() if ends <= time.monotonic()]:
                    del running[k]
                    out[k] = None, "timeout"
                    self.lost += 1
        return out


def compose_with(rows: DataFrame, make_model: Callable[[], Model], prompt_col: str = "prompt", fallback_col: str = "answer", **limits: float) -> DataFrame:
    """``rows`` with composed_answer, composed_by (model or fallback) and composer_error; ``limits`` are those of ``Calls``."""
    Calls(lambda _: None, **limits)  # wrong limits are an error here
    made = [("_model_answer", T.StringType()), ("composer_error", T.StringType())]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in made)])
    at = rows.columns.index(prompt_col)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls = None
        for batch in batches:
            calls = calls or Calls(make_model(), **limits)
            found = calls.all(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], schema.names)

    found = rows.mapInArrow(call, schema)
    own = F.col("_model_answer")
    return found.withColumn("composed_answer", F.coalesce(own, F.col(fallback_col))).withColumn("composed_by", F.when(own.isNotNull(), "model").otherwise("fallback")).drop("_model_answer")
