"""Sessions as keyed state with timers, and release as a join of two streams.

``session_stream`` keeps for each session its counters (a value), the terms of its last queued partial
(a list, so that they are read and written at once) and its last partials (a list of at most ``RECENT``), and closes it by an event-time timer once
the watermark is ``idle`` beyond its last event. ``release_join`` waits for speech end and maturity as
two streams with watermarks, and gives those that never met once no partner can come any more.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.functions.text import PARTIAL_STOP_TERMS, tokenize

#: Partials that a session's list keeps.
RECENT = 200
SESSION = "session_id string, seq long, decision string, received long, prefiltered long, queued long, recent array<long>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state needs, for queries that are started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Sessions(StatefulProcessor):
    """The gate of one session's partials, a row for each and one, ``closed``, at its end."""

    def __init__(self, min_terms: int, idle_ms: int, recent: int):
        self.min_terms, self.idle, self.most = min_terms, idle_ms, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "received long, prefiltered long, queued long, timer long")
        self.terms = handle.getListState("terms", "term string")
        self.recent = handle.getListState("recent", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        received, prefiltered, queued, timer = self.counts.get() if self.counts.exists() else (0, 0, 0, -1)
        known = {term for (term,) in self.terms.get()}
        told, out, latest = known, [], 0
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, tokens, at in zip(batch["seq"], batch["tokens"], batch["at_ms"], strict=True):
            own = set(tokens) - set(PARTIAL_STOP_TERMS)
            good = len(own) >= self.min_terms and bool(own - told)
            received, prefiltered, queued, latest = received + 1, prefiltered + (not good), queued + good, max(latest, int(at))
            if good:
                told = own
            out.append((key[0], int(seq), "queued" if good else "prefiltered", received, prefiltered, queued, None))
        if told != known:
            self.terms.put([(term,) for term in sorted(told)])
        self.recent.put([*self.recent.get(), *((int(s),) for s in batch["seq"])][-self.most :])
        if latest + self.idle > timer:  # the session lives on from its latest event
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = latest + self.idle
            self.handle.registerTimer(timer)
        self.counts.update((received, prefiltered, queued, timer))
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        received, prefiltered, queued, _ = self.counts.get()
        row = (key[0], None, "closed", received, prefiltered, queued, [seq for (seq,) in self.recent.get()])
        for state in (self.counts, self.terms, self.recent):
            state.clear()
        yield pd.DataFrame([row], columns=_NAMES).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


_NAMES = [c.split()[0] for c in SESSION.split(", ")]


def session_stream(partials: DataFrame, at: str = "at", late: str = "1 minute", idle_ms: int = 600_000, min_terms: int = 2, recent: int = RECENT) -> DataFrame:
    """Partials (session_id, seq, transcript, and their time ``at``) with decision and counters so far, and a row for each session that ends.

    Events that are more than ``late`` behind the latest are dropped. The query must be started inside
    ``state_store``.
    """
    rows = partials.select("session_id", "seq", F.col(at).alias("at"), tokenize("transcript").alias("tokens")).withWatermark("at", late)
    timed = rows.withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("session_id").transformWithStateInPandas(Sessions(min_terms, idle_ms, recent), SESSION, "Append", "EventTime")


def release_join(ends: DataFrame, matures: DataFrame, late: str = "1 minute", within: str = "30 minutes", session: str = "session_id") -> DataFrame:
    """session_id, speech_end_at, mature_at, both_at of two streams (session, at): when both had come, at most ``within`` apart.

    One that has no partner comes out with nulls once the watermarks say that none can come; until
    then, and no longer, it is state.
    """
    a = ends.select(F.col(session).alias("_a"), F.col("at").alias("speech_end_at")).withWatermark("speech_end_at", late)
    b = matures.select(F.col(session).alias("_b"), F.col("at").alias("mature_at")).withWatermark("mature_at", late)
    near = F.expr(f"_a = _b and mature_at >= speech_end_at - interval {within} and mature_at <= speech_end_at + interval {within}")
    both = F.when(F.col("speech_end_at").isNotNull() & F.col("mature_at").isNotNull(), F.greatest("speech_end_at", "mature_at"))
    return a.join(b, near, "full_outer").select(F.coalesce("_a", "_b").alias(session), "speech_end_at", "mature_at", both.alias("both_at"))
