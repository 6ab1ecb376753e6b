"""Keyed state and joined streams against the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.operators import sessions
from quillon.plans.sessions import partials
from quillon.streaming import state

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "session_id string, seq long, transcript string, at timestamp"


def said(session, seq, text, minute):
    return session, seq, text, START + dt.timedelta(minutes=minute)


class Feed:
    """A folder read as a stream, one written batch after the other."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        (rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def run(query_of, check, out):
    """Run a stream on what is there and add its rows to ``out``; the checkpoint says where the next run goes on."""
    with state.state_store(query_of().sparkSession):
        q = query_of().writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(check)).start()
        q.processAllAvailable()
        progress = q.recentProgress
        q.stop()
    return progress


def test_sessions_equal_the_batch_fold(spark, data, tmp_path):
    rows = partials(spark, data).where("length(session_id) < 9").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))).select("session_id", "seq", "transcript", "at").cache()
    feed, out = Feed(spark, tmp_path / "in", SCHEMA), []
    for part in ("seq <= 5", "seq > 5 and seq <= 20", "seq > 20"):
        feed.add(rows.where(part))
        run(lambda: state.session_stream(feed.stream(), idle_ms=3_600_000), tmp_path / "check", out)  # stopped and started again each time
    feed.add([said("end", 1, "the end of it", 10_000_000)])
    run(lambda: state.session_stream(feed.stream(), idle_ms=3_600_000), tmp_path / "check", out)
    expected = {(r.session_id, r.seq): r.decision for r in sessions.gate(rows).collect()}
    got = {(r.session_id, r.seq): r.decision for r in out if r.decision != "closed" and r.session_id != "end"}
    assert got == expected and len(expected) == sum(r.decision != "closed" and r.session_id != "end" for r in out)
    counters = {r.session_id: tuple(r)[1:] for r in sessions.gate_counters(sessions.gate(rows)).collect()}
    closed = {r.session_id: r for r in out if r.decision == "closed"}
    assert {s: (r.received, r.prefiltered, r.queued) for s, r in closed.items()} == counters
    seqs = {s: sorted(q for t, q in expected if t == s)[-state.RECENT :] for s in counters}
    assert {s: r.recent for s, r in closed.items()} == seqs


def test_late_events_idle_sessions_and_the_ring(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in", SCHEMA), []
    query_of = lambda: state.session_stream(feed.stream(), late="5 minutes", idle_ms=600_000, recent=2)
    feed.add([said("s", 1, "one two", 0), said("s", 2, "one two three", 1), said("s", 3, "one two three", 2)])
    run(query_of, tmp_path / "check", out)
    feed.add([said("t", 1, "x y", 8)])  # the watermark is at minute 3 after it
    run(query_of, tmp_path / "check", out)
    feed.add([said("s", 4, "too late", 1), said("s", 5, "in time new", 4)])
    run(query_of, tmp_path / "check", out)
    assert [(r.seq, r.decision) for r in out if r.session_id == "s" and r.seq] == [(1, "queued"), (2, "queued"), (3, "prefiltered"), (5, "queued")]
    assert not [r for r in out if r.decision == "closed"]
    feed.add([said("t", 2, "x y z", 25)])  # minute 20: both sessions have been idle since before minute 10
    run(query_of, tmp_path / "check", out)
    closed = {r.session_id: (r.received, r.queued, r.recent) for r in out if r.decision == "closed"}
    assert closed["s"] == (4, 3, [3, 5]) and set(closed) <= {"s", "t"}
    feed.add([said("s", 6, "one two", 26)])  # a new session of the name: nothing is known of the old one
    run(query_of, tmp_path / "check", out)
    last = next(r for r in out if r.session_id == "s" and r.seq == 6)
    assert (last.decision, last.received) == ("queued", 1)


def test_release_join(spark, tmp_path):
    schema = "session_id string, at timestamp"
    ends, matures, out = Feed(spark, tmp_path / "a", schema), Feed(spark, tmp_path / "b", schema), []
    at = lambda minute: START + dt.timedelta(minutes=minute)
    query_of = lambda: state.release_join(ends.stream(), matures.stream(), "1 minute", "30 minutes")
    ends.add([("a", at(1)), ("b", at(2)), ("alone", at(3))])
    matures.add([("a", at(4)), ("early", at(0))])
    first = run(query_of, tmp_path / "check", out)
    assert [(r.session_id, r.both_at) for r in out] == [("a", at(4).replace(tzinfo=None))]
    matures.add([("b", at(6))])
    run(query_of, tmp_path / "check", out)
    held = max(p.stateOperators[0].numRowsTotal for p in first if p.stateOperators)
    ends.add([("x", at(600))])
    matures.add([("y", at(600))])
    last = run(query_of, tmp_path / "check", out)
    left = [p.stateOperators[0].numRowsTotal for p in last if p.stateOperators][-1]
    assert left < held
    batch = spark.createDataFrame([("a", "e", 1), ("b", "e", 2), ("alone", "e", 3), ("a", "m", 4), ("early", "m", 0), ("b", "m", 6)], "s string, kind string, t int")
    want = {r.s: None if r.both_at is None else at(r.both_at).replace(tzinfo=None) for r in sessions.dual_condition(batch, "s", "t", F.col("kind") == "e", F.col("kind") == "m").collect()}
    assert {r.session_id: r.both_at for r in out if r.session_id not in "xy"} == want


def test_store_is_put_back(spark):
    before = spark.conf.get(state._PROVIDER)
    with pytest.raises(ValueError), state.state_store(spark):
        assert "RocksDB" in spark.conf.get(state._PROVIDER)
        raise ValueError
    assert spark.conf.get(state._PROVIDER) == before


def test_terms_of_a_session_are_written_at_once():
    """Each call of a state goes to the JVM and back: their number must not grow with a session's terms."""
    import pandas as pd

    from quillon.streaming import state

    class Held:
        value, calls = None, 0

        def __getattr__(self, name):
            def call(*given):
                Held.calls += 1
                if name in ("put", "update"):
                    self.value = given[0]
                return self.value is not None if name == "exists" else (self.value if self.value is not None else [])

            return call

    class Handle:
        def __getattr__(self, name):
            return lambda *_: Held()

    def calls(words):
        Held.calls, own = 0, state.Sessions(2, 1000, 5)
        own.init(Handle())
        rows = pd.DataFrame({"seq": [1], "tokens": [[f"w{i}" for i in range(words)]], "at_ms": [0]})
        assert [d["decision"].tolist() for d in own.handleInputRows(("s",), iter([rows]), None)] == [["queued"]]
        return Held.calls

    assert calls(300) == calls(3)
