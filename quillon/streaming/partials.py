"""Structured Streaming over growing transcripts: gates, trusted candidates, releases and copies.

Retrieval can't run inside a state processor, so a stream has stages: a stateful gate emits the
partials worth retrieving for; ``foreachBatch`` retrieves for a micro-batch at once; another
stateful step keeps the trusted candidate of each session.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from quillon.functions.text import PARTIAL_STOP_TERMS, tokenize
from quillon.sources.events import parse_event

GATED = "session_id string, seq long, transcript string, decision string"
_GATE_STATE = "last string, received long, prefiltered long, queued long"


def parse_stream(raw: DataFrame, session: str = "session_id", seq: str = "seq", value: str = "value") -> DataFrame:
    """session_id, seq, kind, transcript, request_id of a stream of JSON events; events that say nothing go."""
    rows = raw.select(F.col(session).cast("string").alias("session_id"), F.col(seq).cast("long").alias("seq"), parse_event(F.col(value)).alias("_e"))
    return rows.where("_e is not null").select("session_id", "seq", "_e.*")


def _terms(tokens: list[str]) -> set[str]:
    return set(tokens) - set(PARTIAL_STOP_TERMS)


def gate_stream(partials: DataFrame, min_terms: int = 2, idle: str | None = None) -> DataFrame:
    """Partials (session_id, seq, transcript) with their decision, as ``sessions.gate`` gives in batch.

    State is the last queued partial's terms and three counters. Tokens are made by Spark before the
    rows reach Python. Within a micro-batch partials are taken by seq.
    """
    tokens = partials.select("session_id", "seq", "transcript", tokenize("transcript").alias("tokens"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, received, prefiltered, queued = state.get if state.exists else ("", 0, 0, 0)
        known = set(last.split("\x01")) if last else set()
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        decisions = []
        for words in rows["tokens"]:
            terms = _terms(list(words))
            good = len(terms) >= min_terms and bool(terms - known)
            known = terms if good else known
            received, prefiltered, queued = received + 1, prefiltered + (not good), queued + good
            decisions.append("queued" if good else "prefiltered")
        state.update(("\x01".join(sorted(known)), received, int(prefiltered), int(queued)))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"session_id": key[0], "seq": rows["seq"], "transcript": rows["transcript"], "decision": decisions})

    return tokens.groupBy("session_id").applyInPandasWithState(step, GATED, _GATE_STATE, "append", _timeout(idle))


def latest_only(batch: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Of a micro-batch the newest partial of each session: older ones are stale when retrieval starts."""
    rest = [c for c in batch.columns if c != session]
    return batch.groupBy(session).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_l"), (F.count(F.lit(1)) - 1).alias("stale_dropped")).select(session, "_l.*", "stale_dropped")


@dataclass(frozen=True)
class Trust:
    """What decides whether a candidate replaces the trusted one."""

    query_id: str | None
    provenances: frozenset
    confidence: float | None
    semantic_count: int
    semantic_ratio: float
    hybrid_count: int
    hybrid_ratio: float
    top1_in_both: bool


def transition(trusted: Trust | None, new: Trust) -> str:
    """created, conflict (other evidence), retained (weaker) or updated."""
    if trusted is None:
        return "created"
    if trusted.query_id != new.query_id or not trusted.provenances & new.provenances:
        return "conflict"
    if new.confidence is None or trusted.confidence is None or new.confidence < trusted.confidence:
        return "retained"
    stronger = all(getattr(new, f) >= getattr(trusted, f) for f in ("semantic_count", "semantic_ratio", "hybrid_count", "hybrid_ratio"))
    return "updated" if stronger and (new.top1_in_both or not trusted.top1_in_both) else "retained"


CANDIDATE = "session_id string, seq long, query_id string, provenances array<string>, confidence double, semantic_count long, semantic_ratio double, hybrid_count long, hybrid_ratio double, top1_in_both boolean"
TRUSTED = "session_id string, seq long, outcome string, trusted_seq long, updates long, conflicts long"
_TRUST_STATE = "seq long, query_id string, provenances string, confidence double, semantic_count long, semantic_ratio double, hybrid_count long, hybrid_ratio double, top1_in_both boolean, updates long, conflicts long"


def _trust_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle: str | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held, at, updates, conflicts = None, None, 0, 0
    if state.exists:
        s = state.get
        at, updates, conflicts = s[0], s[9], s[10]
        held = Trust(s[1], frozenset(s[2].split("\x01")) if s[2] else frozenset(), s[3], s[4], s[5], s[6], s[7], s[8])
    out = []
    for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
        new = Trust(r.query_id, frozenset(r.provenances), None if pd.isna(r.confidence) else float(r.confidence), int(r.semantic_count), float(r.semantic_ratio), int(r.hybrid_count), float(r.hybrid_ratio), bool(r.top1_in_both))
        outcome = transition(held, new)
        conflicts, updates = conflicts + (outcome == "conflict"), updates + (outcome == "updated")
        if outcome in ("created", "updated"):
            held, at = new, int(r.seq)
        out.append((key[0], int(r.seq), outcome, at, updates, conflicts))
    state.update((at, held.query_id, "\x01".join(sorted(held.provenances)), held.confidence, held.semantic_count, held.semantic_ratio, held.hybrid_count, held.hybrid_ratio, held.top1_in_both, updates, conflicts))
    if idle:
        state.setTimeoutDuration(idle)
    yield pd.DataFrame(out, columns=["session_id", "seq", "outcome", "trusted_seq", "updates", "conflicts"])


def _timeout(idle: str | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


def trusted_stream(candidates: DataFrame, idle: str | None = None) -> DataFrame:
    """Mature candidates (the columns of ``CANDIDATE``) with what each did to its session's trusted one.

    A session without candidates for as long as ``idle`` is forgotten. A stream that never ends must set
    it, or its state grows; one that ends with the data at hand must not, as it would wait for the timeout.
    """
    step = lambda key, batches, state: _trust_step(key, batches, state, idle)
    return candidates.groupBy("session_id").applyInPandasWithState(step, TRUSTED, _TRUST_STATE, "append", _timeout(idle))


def release_stream(events: DataFrame, idle: str | None = None) -> DataFrame:
    """session_id, speech_end_at, mature_at, both_at: emitted once, when both have been seen.

    events: session_id, kind, at_ms; a session's second maturity or speech end changes nothing. idle
    is as in ``trusted_stream``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end, mature, done = state.get if state.exists else (None, None, False)
        for r in pd.concat(list(batches)).sort_values("at_ms", kind="stable").itertuples():
            end = float(r.at_ms) if end is None and r.kind == "speech_end" else end
            mature = float(r.at_ms) if mature is None and r.kind == "mature" else mature
        now = not done and end is not None and mature is not None
        state.update((end, mature, done or now))
        if idle:
            state.setTimeoutDuration(idle)
        if now:
            yield pd.DataFrame([(key[0], end, mature, max(end, mature))], columns=["session_id", "speech_end_at", "mature_at", "both_at"])

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, speech_end_at double, mature_at double, both_at double", "speech_end double, mature double, done boolean", "append", _timeout(idle))


def silence_stream(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """key, starts, ends, n: runs of events without a gap, by a session window."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(key, F.session_window("_at", gap).alias("_w")).agg(F.min("_at").alias("starts"), F.max("_at").alias("ends"), F.count(F.lit(1)).alias("n")).select(key, "starts", "ends", "n")


def retrieve_batches(partials: DataFrame, retrieve: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each micro-batch: the newest partial of each session, retrieved for in one batch, and handed to ``write``."""

    def each(batch: DataFrame, number: int) -> None:
        newest = latest_only(batch.where("decision = 'queued'")).select(F.concat_ws("#", "session_id", "seq").alias("query_key"), F.col("transcript").alias("query"), "session_id", "seq", "stale_dropped")
        write(retrieve(newest), number)

    return partials.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def copy_stream(source: DataFrame, target: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Copy a Parquet stream into another table, from where the checkpoint left off.

    A batch that is run again writes its own folder again, so nothing is doubled. A checkpoint of
    another source is refused by Spark, which keeps the source's identity in it.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = keep(batch) if keep else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(records: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> tuple[StreamingQuery, list[dict]]:
    """Build index rows for each micro-batch, and a list that gets each batch's number, records and rows."""
    metrics: list[dict] = []

    def each(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Observation

        seen, made = Observation(f"records_{number}"), Observation(f"rows_{number}")
        rows = build(batch.observe(seen, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        metrics.append({"batch": number, "records": seen.get["n"], "rows": made.get["n"]})

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), metrics


def redacted_error(message: str) -> str:
    """An error text without the values of keys and tokens."""
    return re.sub(r"(?i)((?:api[_ -]?key|token|secret)\s*[:=]\s*)([^\s,;]+)", r"\1[REDACTED]", message)
