"""Request checks, failures and diagnostics."""

from pyspark.sql import functions as F

from quillon.functions.text import NO_ANSWER
from quillon.operators import guardrails


def test_pre_check(spark):
    rows = [("AI?", "en", "text", None), ("  ", "en", "text", "QUERY_INVALID"), (None, "en", "text", "QUERY_INVALID"), ("?!", "en", "text", "QUERY_INVALID"), ("x", "fr", "text", "UNSUPPORTED_LANGUAGE"), ("x" * 4001, "en", "text", "QUERY_INVALID"), ("x" * 4001, "en", "voice", None), ("दिल्ली", "hi", "text", None)]
    got = spark.createDataFrame([r[:3] for r in rows], "q string, l string, m string").select(guardrails.pre_check(F.col("q"), F.col("l"), F.col("m")).alias("c")).collect()
    assert [r.c for r in got] == [r[3] for r in rows]


def test_harness_and_no_answer(spark):
    rows = [("q", "en", "text", "a", False, 1, None, 5.0), ("q", "en", "text", " ", False, 1, None, 5.0), ("q", "xx", "text", None, None, None, None, 5.0), ("q", "en", "text", "a", False, 1, "qdrant_query_error", 5.0), ("q", "en", "text", "a", False, 1, None, 31_000.0)]
    df = spark.createDataFrame(rows, "query string, language string, input_mode string, answer string, is_no_answer boolean, evidence_count int, error_category string, elapsed_ms double")
    got = guardrails.harness(df).collect()
    assert [(r.status, r.guardrail_code) for r in got] == [(200, None), (200, "INSUFFICIENT_EVIDENCE"), (422, "UNSUPPORTED_LANGUAGE"), (503, None), (504, None)]
    replaced = guardrails.with_no_answer(guardrails.harness(df).withColumn("confidence", F.lit(0.5))).collect()
    assert replaced[1].answer == NO_ANSWER and replaced[1].confidence is None and replaced[0].confidence == 0.5


def test_safe_diagnostics(spark):
    df = spark.createDataFrame([("en", "text", "QUERY_INVALID", -1.0), ("zz", "smell", "OTHER", 4.0), ("hi", "voice", None, float("nan"))], "language string, input_mode string, guardrail_code string, rag_ms double")
    assert [tuple(r) for r in guardrails.safe_diagnostics(df, ["rag_ms"]).collect()] == [("en", "text", "QUERY_INVALID", None), (None, None, None, 4.0), ("hi", "voice", None, None)]


def test_readiness_and_uploads(spark):
    flags = spark.createDataFrame([({"a": True, "b": True},), ({"a": True, "b": False},), ({},)], "f map<string,boolean>")
    assert [r[0] for r in flags.select(guardrails.readiness(F.col("f"))).collect()] == [True, False, False]
    webm = bytes.fromhex("1A45DFA3")
    rows = [
        ("a.webm", "audio/webm; codecs=opus", webm, 9, None), ("a", "video/webm", webm, 9, None), (None, "audio/webm", webm, 9, None), ("a.WEBM", " AUDIO/WEBM", webm, 9, None), ("a.exe", "audio/webm", webm, 9, "container"), ("a.wav", "audio/wav", b"RIFF", 9, "container"),
        ("a.webm", None, webm, 9, "container"), ("a.webm", "audio/webm", webm, 10 * 1024 * 1024, "size"), ("a.webm", "audio/webm", b"nope", 9, "content"), ("a.webm", "audio/webm", None, None, "content"), (".webm", "audio/webm", webm, 9, None),
    ]
    got = spark.createDataFrame([r[:4] for r in rows], "n string, t string, c binary, s long").select(guardrails.upload_error(F.col("n"), F.col("t"), F.col("c"), F.col("s")).alias("e")).collect()
    assert [r.e for r in got] == [r[4] for r in rows]


def test_failures(spark):
    rows = [("timeout", None, None, False, (504, "RAG_TIMEOUT", True)), ("validation_error", 404, None, False, (404, "INVALID_REQUEST", False)), ("validation_error", 500, None, False, (422, "INVALID_REQUEST", False)), ("stt_error", 503, "busy", False, (503, "STT_UNAVAILABLE", True)), ("stt_error", None, "<x>", False, (502, "STT_UNAVAILABLE", False)),
            ("stt_error", 504, None, False, (504, "RAG_TIMEOUT", True)), ("internal_error", None, "index Unavailable", True, (503, "RAG_UNAVAILABLE", True)), ("internal_error", None, "index Unavailable", False, (500, "RAG_INTERNAL_ERROR", False)), ("qdrant_connection_error", None, None, False, (503, "RAG_UNAVAILABLE", True)), ("bm25_error", None, None, False, (500, "RAG_INTERNAL_ERROR", False))]
    got = spark.createDataFrame([r[:4] for r in rows], "c string, s int, m string, r boolean").select(guardrails.failure(F.col("c"), F.col("s"), F.col("m"), F.col("r")).alias("f")).collect()
    assert [(r.f.status, r.f.code, r.f.retryable) for r in got] == [r[4] for r in rows]
    assert got[3].f.message == "busy" and got[4].f.message.startswith("Voice") and got[5].f.category == "timeout"
