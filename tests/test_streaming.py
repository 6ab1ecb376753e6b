"""Streams give what the batch functions give."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import sessions
from quillon.plans.sessions import partials, turns
from quillon.streaming import partials as streams


def drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.sql(f"select * from {name}").collect()


def split(df, path, parts=3, key="seq"):
    """A folder of Parquet files in the order of ``key``, read as a stream one file at a time."""
    spark = df.sparkSession
    rows = df.orderBy(key).collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_gate_stream_equals_batch(spark, data, tmp_path):
    rows = partials(spark, data).where("length(session_id) < 9")
    expected = {(r.session_id, r.seq): r.decision for r in sessions.gate(rows).collect()}
    got = {(r.session_id, r.seq): r.decision for r in drain(streams.gate_stream(split(rows, tmp_path / "in")), "gated")}
    assert got == expected and "queued" in got.values()


def test_growing_gate_is_the_gate_of_all_prefixes(spark, data):
    rows = {(r.session_id, r.seq): r.decision for r in sessions.gate(partials(spark, data)).collect()}
    found = sessions.growing_gate(turns(spark, data)).collect()
    assert {(r.session_id, r.seq): r.decision for r in found} == rows and len(found) == len(rows)
    said = spark.createDataFrame([("a", ["से", "से", "x", "x,", "y", "x", "से"]), ("b", [""]), ("c", ["one-two"]), ("d", ["ß", "SS", "ss", "t"])], "session_id string, w array<string>")
    steps = said.select("session_id", F.explode(F.sequence(F.lit(1), F.ceil(F.size("w") / 2).cast("int"))).alias("seq"), "w").select("session_id", "seq", F.array_join(F.slice("w", F.lit(1), 2 * F.col("seq")), " ").alias("transcript"))
    assert sorted(map(tuple, sessions.growing_gate(said).collect())) == sorted((r.session_id, r.seq, r.decision) for r in sessions.gate(steps).collect())


def test_gate_of_one_session(spark):
    said = ["विला डेल", "विला डेल", "विला डेल सिया", "से", "सिया डेल", "दूर विला"]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(said)], "session_id string, seq long, transcript string")
    got = [r.decision for r in sessions.gate(rows).orderBy("seq").collect()]
    assert got == ["queued", "prefiltered", "queued", "prefiltered", "prefiltered", "queued"]
    assert tuple(sessions.gate_counters(sessions.gate(rows)).first())[1:] == (6, 3, 3)


def test_trusted_stream(spark, tmp_path):
    row = lambda seq, q, keys, c, n, both: ("s", seq, q, keys, c, n, n / 5, n, n / 5, both)
    rows = [row(0, "a", ["a/1"], 0.5, 3, True), row(1, "b", ["b/1"], 0.9, 5, True), row(2, "a", ["a/1", "a/2"], 0.4, 4, True), row(3, "a", ["a/2"], 0.9, 5, True), row(4, "a", ["a/1"], 0.6, 4, True), row(5, "a", ["a/1"], 0.7, 4, False)]
    df = spark.createDataFrame(rows, streams.CANDIDATE)
    got = sorted(drain(streams.trusted_stream(split(df, tmp_path / "in", 2)), "trusted"), key=lambda r: r.seq)
    assert [r.outcome for r in got] == ["created", "conflict", "retained", "conflict", "updated", "retained"]
    assert (got[-1].trusted_seq, got[-1].updates, got[-1].conflicts) == (4, 1, 2)


def test_release_stream_equals_batch(spark, tmp_path):
    rows = [("s", 1, "partial", 10.0), ("s", 2, "mature", 40.0), ("s", 3, "speech_end", 30.0), ("s", 4, "mature", 90.0), ("t", 5, "mature", 5.0), ("u", 6, "speech_end", 7.0), ("u", 7, "mature", 9.0)]
    df = spark.createDataFrame(rows, "session_id string, seq long, kind string, at_ms double")
    got = {r.session_id: r.both_at for r in drain(streams.release_stream(split(df, tmp_path / "in", 3)), "released")}
    batch = sessions.dual_condition(df, "session_id", "at_ms", F.col("kind") == "speech_end", F.col("kind") == "mature")
    assert got == {"s": 40.0, "u": 9.0} == {r.session_id: r.both_at for r in batch.where("both_at is not null").collect()}


def test_parse_and_finals(spark, tmp_path):
    raw = [("s", 1, '{"text":"one"}'), ("s", 2, '{"text":"one two"}'), ("s", 3, '{"event":"session.end"}'), ("t", 4, '{"text":"x","is_final":true}'), ("u", 5, "{}"), ("v", 6, '{"event":"session.end"}')]
    df = spark.createDataFrame(raw, "session_id string, seq long, value string")
    rows = drain(streams.parse_stream(split(df, tmp_path / "in", 2)), "parsed")
    got = {r.session_id: (r.transcript, r.source) for r in sessions.finals(spark.createDataFrame(rows, "session_id string, seq long, kind string, transcript string, request_id string")).collect()}
    assert got == {"s": ("one two", "promoted_partial"), "t": ("x", "final"), "v": (None, "error")}


def test_silence_stream(spark, tmp_path):
    rows = [("u", 1, "2024-01-01 00:00:00"), ("u", 2, "2024-01-01 00:00:20"), ("u", 3, "2024-01-01 00:05:00"), ("z", 4, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "u string, seq long, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = drain(streams.silence_stream(split(df, tmp_path / "in", 2), "u", "ts", "30 seconds", "1 minute"), "silence")
    assert sorted((r.u, r.n) for r in got) == [("u", 1), ("u", 2)]  # the last session stays open
    batch = sessions.silence_sessions(df, "u", "ts", 30).collect()
    assert sorted((r.u, r.n) for r in batch) == [("u", 1), ("u", 2), ("z", 1)]


def test_copy_resumes(spark, tmp_path):
    df = spark.range(30).withColumn("seq", F.col("id"))
    source = split(df, tmp_path / "in", 3)
    for _ in range(2):  # the second run finds nothing new
        streams.copy_stream(source, str(tmp_path / "out"), str(tmp_path / "check"), lambda b: b.where("id % 2 = 0")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    df.limit(4).write.mode("append").parquet(str(tmp_path / "in"))
    streams.copy_stream(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 19


def test_index_stream_counts(spark, tmp_path):
    q, metrics = streams.index_stream(split(spark.range(10).withColumn("seq", F.col("id")), tmp_path / "in", 2), lambda b: b.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert [(m["records"], m["rows"]) for m in metrics] == [(5, 10), (5, 10)]


def test_retrieval_of_batches(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "a b", "queued"), ("s", 2, "a b c", "queued"), ("t", 3, "x", "prefiltered")], "session_id string, seq long, transcript string, decision string")
    out = []
    q = streams.retrieve_batches(split(rows, tmp_path / "in", 1), lambda df: df.withColumn("hits", F.length("query")), lambda df, n: out.extend(df.collect()), str(tmp_path / "check"))
    q.awaitTermination()
    assert [(r.query_key, r.query, r.stale_dropped, r.hits) for r in out] == [("s#2", "a b c", 1, 5)]


def test_early_release_report(spark):
    rows = spark.createDataFrame([("a", 100.0, 80.0, 400.0, 500.0, True, 5.0, "p", "p"), ("b", 100.0, 120.0, 400.0, 500.0, True, 5.0, "p", "q"), ("c", 100.0, 120.0, 400.0, 500.0, False, 5.0, "p", "p"), ("d", None, 1.0, 2.0, 3.0, False, None, None, "p")], "session_id string, speech_end_ms double, maturity_ms double, final_ms double, answer_ms double, safe boolean, validation_ms double, early_provenance string, final_provenance string")
    got = {r.session_id: r for r in sessions.early_release_report(rows).collect()}
    assert (got["a"].latency_saved_ms, got["a"].happened_first, got["a"].false_early_release) == (495.0, "maturity", False)
    assert got["b"].false_early_release and got["b"].estimated_ms == 25.0 and got["c"].missed_opportunity and got["d"].dual_condition_ms is None


def test_recovery_summary(spark):
    obs = [("s", t, [(1, q, f"{q}/1", "x", 0.5)], q, True, q, True, ["f"]) for t, q in ((10.0, "e"), (20.0, "f"), (30.0, "f"))]
    observations = spark.createDataFrame(obs, "session_id string, offset_ms double, hybrid array<struct<rank:int,query_id:string,provenance:string,text:string,semantic_score:double>>, semantic_dominant_id string, semantic_concentrated boolean, hybrid_dominant_id string, hybrid_concentrated boolean, lexical_ids array<string>")
    final = spark.createDataFrame([("s", "f", "f/1", 90.0)], "session_id string, final_query_id string, final_provenance string, maturity_ms double")
    got = sessions.recovery_summary(observations, final).first()
    assert (got.first_query_id_ms, got.first_exact_ms, got.first_consecutive_ms, got.first_defensible_ms, got.conclusion) == (20.0, 20.0, 30.0, 20.0, "POLICY_LIMITED")


@pytest.mark.parametrize("text", ["token: abc", "secret=xyz rest"])
def test_redacted_error(text):
    assert "[REDACTED]" in streams.redacted_error(text)


def test_growing_lifecycle_equals_the_fold_over_prefixes(spark):
    import random

    from quillon.functions.text import tokenize
    from quillon.operators import sessions

    r = random.Random(5)
    words = ["aa", "bb", "cc", "Dd", "dd", "ee,ff", "की", "से", "...", "gg", "hh", "ii", "jj", "kk"]
    rows = [(f"s{i}", [r.choice(words) for _ in range(r.randint(1, 40))]) for i in range(60)] + [("blank", [""])]
    turns = spark.createDataFrame(rows, "session_id string, w array<string>")
    steps = turns.select("session_id", "w", F.explode(F.sequence(F.lit(1), F.ceil(F.size("w") / 2).cast("int"))).alias("k"))
    partials = steps.select("session_id", F.col("k").cast("long").alias("seq"), F.array_join(F.slice("w", F.lit(1), 2 * F.col("k")), " ").alias("transcript"), (F.col("k") % 6 == 3).alias("mature"))
    told = lambda df: sorted((x.session_id, x.seq, x.mature, x.decision) for x in df.collect())
    assert told(sessions.growing_lifecycle(turns, F.col("seq") % 6 == 3)) == told(sessions.lifecycle(partials))
    first = turns.select("session_id", sessions.first_growing(F.col("w"), tokenize, 4).alias("first"))
    slow = partials.where(F.size(F.array_distinct(tokenize("transcript"))) >= 4).groupBy("session_id").agg(F.min("seq").alias("first"))
    assert {x.session_id: x.first for x in first.collect() if x.first is not None} == {x.session_id: x.first for x in slow.collect()}
