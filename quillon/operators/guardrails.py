"""Checks of requests before and after retrieval, error categories and safe diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import NO_ANSWER, media_type, normalize_space
from quillon.sources.tables import LANGUAGES

# ---- Fixed values ---------------------------------------------------------------------------------
MAX_TYPED_CHARS, DEADLINE_MS = 4000, 30_000
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
#: Category -> status, code, message, whether a retry may help.
FAILURES = {
    "timeout": (504, "RAG_TIMEOUT", "The request could not be completed in time.", True),
    "validation_error": (422, "INVALID_REQUEST", "The request is invalid.", False),
    "stt_error": (502, "STT_UNAVAILABLE", "Voice transcription is currently unavailable.", False),
    "qdrant_connection_error": (503, "RAG_UNAVAILABLE", "The answer service is temporarily unavailable.", True),
    "qdrant_query_error": (503, "RAG_UNAVAILABLE", "The answer service is temporarily unavailable.", True),
}
OTHER_FAILURE = (500, "RAG_INTERNAL_ERROR", "The request could not be completed.", False)
GUARDRAIL_CODES = ("QUERY_INVALID", "UNSUPPORTED_LANGUAGE", "INSUFFICIENT_EVIDENCE")
AUDIO_TYPES, AUDIO_EXTENSION, AUDIO_START = ("audio/webm", "video/webm"), "webm", "1A45DFA3"
#: Why an upload is refused -> status.
UPLOAD_STATUS = {"container": 415, "size": 413, "content": 422}
# ---------------------------------------------------------------------------------------------------


def pre_check(query: Column, language: Column, mode: Column) -> Column:
    """The code that rejects a request, or null."""
    text = normalize_space(query)
    return (
        F.when(~F.coalesce(language.isin(*LANGUAGES), F.lit(False)), "UNSUPPORTED_LANGUAGE")
        .when(F.coalesce(text, F.lit("")) == "", "QUERY_INVALID")
        .when((mode == "text") & (F.length(text) > MAX_TYPED_CHARS), "QUERY_INVALID")
        .when(~text.rlike(r"[\p{L}\p{N}]"), "QUERY_INVALID")
    )


def post_check(answer: Column, is_no_answer: Column, evidence_count: Column) -> Column:
    nothing = F.coalesce(is_no_answer, F.lit(True)) | (F.trim(F.coalesce(answer, F.lit(""))) == "") | (F.coalesce(evidence_count, F.lit(0)) == 0)
    return F.when(nothing, "INSUFFICIENT_EVIDENCE")


def with_no_answer(answers: DataFrame) -> DataFrame:
    """Rows that the post check rejects get the fixed text, no evidence and no confidence."""
    bad = F.col("guardrail_code") == "INSUFFICIENT_EVIDENCE"
    return answers.withColumn("answer", F.when(bad, NO_ANSWER).otherwise(F.col("answer"))).withColumn("confidence", F.when(~F.coalesce(bad, F.lit(False)), F.col("confidence"))).withColumn("is_no_answer", F.coalesce(bad, F.lit(False)))


def error_category(name: Column, module: Column, message: Column, status: Column) -> Column:
    """A category from an error's type, module, text and status, by the first rule that fits."""
    n, m, t = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, module, message))

    def has(c: Column, *words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(c, F.lit(w))
        return out

    store = has(n, "qdrant") | has(m, "qdrant") | has(t, "qdrant")
    return (
        F.when(has(n, "stt", "sarvam") | has(m, "stt"), "stt_error")
        .when(status.isNotNull() & status.between(400, 499), "validation_error")
        .when(status.isNotNull(), "internal_error")
        .when(has(n, "timeouterror"), "timeout")
        .when(store & has(t, "connection", "transport", "dns", "timeout"), "qdrant_connection_error")
        .when(store, "qdrant_query_error")
        .when(has(n, "bm25") | has(m, "bm25"), "bm25_error")
        .when(has(n, "embedding", "embedder") | has(m, "torch"), "embedding_error")
        .when(has(n, "composer") | has(m, "answer_composer"), "composition_error")
        .when(has(n, "valueerror"), "validation_error")
        .when(has(n, "retriev") | has(m, "retriev"), "retrieval_error")
        .otherwise("internal_error")
    )


def failure(category: Column, status: Column | None = None, message: Column | None = None, is_runtime: Column | None = None) -> Column:
    """struct(category, status, code, message, retryable) of an error.

    status and message are the error's own; is_runtime: whether it is a runtime error, which is
    "unavailable" if its message says so.
    """
    own = F.lit(None).cast("int") if status is None else status
    said = F.coalesce(F.lit(None).cast("string") if message is None else message, F.lit(""))

    def row(v: tuple, kind: Column = category, code: Column | None = None, text: Column | None = None, again: Column | None = None) -> Column:
        return F.struct(kind.alias("category"), (F.lit(v[0]) if code is None else code).alias("status"), F.lit(v[1]).alias("code"), (F.lit(v[2]) if text is None else text).alias("message"), (F.lit(v[3]) if again is None else again).alias("retryable"))

    timeout, invalid, speech, store = (FAILURES[k] for k in ("timeout", "validation_error", "stt_error", "qdrant_query_error"))
    speech_status = F.when(own.isin(422, 502, 503), own).otherwise(speech[0])
    speech_message = F.when((said != "") & ~F.startswith(said, F.lit("<")), said).otherwise(speech[2])
    gone = (category == "internal_error") & (F.lit(False) if is_runtime is None else F.coalesce(is_runtime, F.lit(False))) & F.contains(F.lower(said), F.lit("unavailable"))
    return (
        F.when(category == "timeout", row(timeout))
        .when(category == "validation_error", row(invalid, code=F.when(own.between(400, 499), own).otherwise(invalid[0])))
        .when((category == "stt_error") & (own == 504), row(timeout, kind=F.lit("timeout")))
        .when(category == "stt_error", row(speech, code=speech_status, text=speech_message, again=F.coalesce(speech_status == 503, F.lit(False))))
        .when(category.isin("qdrant_connection_error", "qdrant_query_error") | gone, row(store))
        .otherwise(row(OTHER_FAILURE))
    )


#: Seconds before the second and the third attempt of a read.
BACK_OFF = (0.5, 1.0)


def retry_after(message: Column, attempt: Column) -> Column:
    """Seconds to wait before a failed read's next attempt; null if there is none, as only connection failures are tried again."""
    again = F.lower(F.coalesce(message, F.lit(""))).rlike("dns|connection|timeout|timed out")
    return F.when(again, F.get(F.array(*(F.lit(x) for x in BACK_OFF)), attempt - 1))


def harness(requests: DataFrame) -> DataFrame:
    """Requests (query, language, input_mode, answer, is_no_answer, evidence_count, error_category, elapsed_ms) with code and outcome."""
    pre = pre_check(F.col("query"), F.col("language"), F.col("input_mode"))
    post = post_check(F.col("answer"), F.col("is_no_answer"), F.col("evidence_count"))
    late = F.when(F.col("elapsed_ms") > DEADLINE_MS, "timeout")
    rows = requests.withColumn("_category", F.coalesce("error_category", late)).withColumn("guardrail_code", F.coalesce(pre, F.when(F.col("_category").isNull(), post)))
    status = F.when(pre.isNotNull(), 422).when(F.col("_category").isNotNull(), failure(F.col("_category"))["status"]).otherwise(200)
    return rows.withColumn("status", status).withColumn("error_category", F.col("_category")).drop("_category")


def safe_latency(value: Column) -> Column:
    return F.when((value >= 0) & ~F.isnan(value) & (value < float("inf")), value)


def safe_diagnostics(rows: DataFrame, latencies: list[str]) -> DataFrame:
    """Only known fields: latencies that are numbers from 0 on, known codes, languages and modes."""
    return rows.select(
        F.when(F.col("language").isin(*LANGUAGES), F.col("language")).alias("language"), F.when(F.col("input_mode").isin("text", "voice"), F.col("input_mode")).alias("input_mode"),
        F.when(F.col("guardrail_code").isin(*GUARDRAIL_CODES), F.col("guardrail_code")).alias("guardrail_code"), *(safe_latency(F.col(c)).alias(c) for c in latencies),
    )


def readiness(flags: Column) -> Column:
    """Whether all of a map's flags are true; not if there are none."""
    values = F.map_values(flags)
    return (F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(v, F.lit(False)))


def extension(name: Column) -> Column:
    """A file name's extension in lower case, empty if it has none; a leading period begins no extension."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/]\.([^./]+)$", 1))


def upload_error(name: Column, content_type: Column, content: Column, size: Column | None = None) -> Column:
    """Why an audio upload is refused: its container by name or type, its size, its first bytes; null if it isn't. The name may lack an extension."""
    ext, bytes_ = extension(name), F.length(content) if size is None else size
    return (
        F.when(~ext.isin("", AUDIO_EXTENSION) | ~F.coalesce(media_type(content_type), F.lit("")).isin(*AUDIO_TYPES), "container")
        .when(bytes_ >= MAX_UPLOAD_BYTES, "size")
        .when(~F.coalesce(F.startswith(F.hex(F.substring(content, 1, 4)), F.lit(AUDIO_START)), F.lit(False)), "content")
    )


def counters(requests: DataFrame) -> DataFrame:
    """One row: successes, failures, and counts of each guardrail code."""
    return requests.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("success")).alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        *(F.count_if(F.col("guardrail_code") == c).alias(c.lower()) for c in GUARDRAIL_CODES),
    )
