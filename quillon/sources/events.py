"""Event and report formats: speech recognition events, latency artefacts and answer responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "event string, type string, transcript string, text string, request_id string, finalized string, is_final string"
EVENT_SCHEMA = f"{_FIELDS}, data struct<{_FIELDS.replace(' string', ':string').replace(', ', ',')}>"

#: Names of event kinds.
STARTS, ENDS = ("vad.speech_start", "speech_start", "start_speech"), ("vad.speech_end", "speech_end", "end_speech")
ERRORS, FINALS = ("error", "session.error"), ("final", "final_transcript", "transcript.final")

LATENCIES, SCOPES = ("p50_ms", "p70_ms", "p100_ms"), ("benchmark_scope", "benchmark_environment")
PENDING = {"benchmark_scope": "final_bilingual_text_rag", "benchmark_environment": "pending"}


def parse_event(raw: Column) -> Column:
    """struct(kind, transcript, request_id) of a JSON event, nested or not; null if it says nothing."""
    o = F.from_json(raw, EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    broken = F.get_json_object(raw, "$").isNull()
    d = o["data"]

    def both(*names: str) -> Column:
        return F.coalesce(*(F.nullif(c[n], F.lit("")) for n in names for c in (d, o)))

    kind = F.lower(F.coalesce(F.nullif(o["event"], F.lit("")), F.nullif(o["type"], F.lit("")), F.nullif(d["event"], F.lit("")), F.nullif(d["type"], F.lit("")), F.lit("")))
    source = lambda n: F.when(d.isNotNull(), d[n]).otherwise(o[n])
    said = F.nullif(F.trim(F.coalesce(F.nullif(source("transcript"), F.lit("")), source("text"), F.lit(""))), F.lit(""))
    final = F.coalesce(F.lower(source("finalized")) == "true", F.lit(False)) | F.coalesce(F.lower(source("is_final")) == "true", F.lit(False)) | kind.isin(*FINALS)
    name = (
        F.when(broken, "error").when(kind.isin(*STARTS), "speech_start").when(kind.isin(*ENDS), "speech_end").when(kind == "session.end", "session_end")
        .when(kind.isin(*ERRORS), "error").when(said.isNotNull() & final, "final").when(said.isNotNull(), "partial")
    )
    text = F.when(name.isin("final", "partial"), said).when(broken, "invalid realtime event").when(name == "error", F.coalesce(said, F.lit("realtime error")))
    return F.when(name.isNotNull(), F.struct(name.alias("kind"), text.alias("transcript"), both("request_id").alias("request_id")))


def artefact_error(raw: Column) -> Column:
    """Why a JSON text is no latency artefact, or null: a field is missing, or its value is of the wrong kind.

    Latencies are numbers from 0 on or null, the sample count a whole number from 1 on or null, scope
    and environment strings that aren't blank. The percentiles' order isn't asked for.
    """
    value = F.try_parse_json(raw)
    kind = lambda c: F.schema_of_variant(F.try_variant_get(value, f"$.{c}", "variant"))
    number = lambda c: kind(c).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    fields = (*LATENCIES, "sample_count", *SCOPES)
    absent = F.concat_ws(", ", *(F.when(F.try_variant_get(value, f"$.{c}", "variant").isNull(), F.lit(c)) for c in fields))
    wrong = [F.when((kind(c) != "VOID") & (~number(c) | (F.try_variant_get(value, f"$.{c}", "double") < 0)), F.lit(c)) for c in LATENCIES]
    wrong.append(F.when((kind("sample_count") != "VOID") & ((kind("sample_count") != "BIGINT") | (F.try_variant_get(value, "$.sample_count", "long") < 1)), F.lit("sample_count")))
    wrong += [F.when((kind(c) != "STRING") | (F.trim(F.try_variant_get(value, f"$.{c}", "string")) == ""), F.lit(c)) for c in SCOPES]
    return (
        F.when(value.isNull() | ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), "no JSON object")
        .when(absent != "", F.concat(F.lit("missing fields: "), absent))
        .otherwise(F.concat(F.lit("invalid field: "), F.coalesce(*wrong)))
    )


def latency_artefact(spark: SparkSession, path: str | None) -> DataFrame:
    """One row of the artefact's fields; without a path the pending one, which has no figures. A malformed artefact is an error."""
    schema = ", ".join([*(f"{c} double" for c in LATENCIES), "sample_count long", *(f"{c} string" for c in SCOPES)])
    if path is None:
        return spark.range(1).select(*(F.lit(PENDING.get(c.split()[0])).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")))
    raw = spark.read.text(path, wholetext=True)
    if error := raw.select(artefact_error(F.col("value")).alias("e")).first()["e"]:
        raise ValueError(f"{path}: {error}")
    return raw.select(F.from_json("value", schema).alias("a")).select("a.*")


def _transcript(o: Column) -> Column:
    return F.trim(F.coalesce(o["transcript"], F.lit("")))


def transcription(raw: Column) -> Column:
    """struct(transcript, confidence, duration_ms) of a speech recognition response.

    confidence, else the language's probability, is cut to 0 to 1; what isn't a number is 0. The
    duration is given, or is the last word's end. Without a transcript both are 0.
    """
    o = F.from_json(raw, "transcript string, confidence string, language_probability string, duration_ms string, duration string, timestamps struct<end_time_seconds:array<string>>")
    number = lambda c: c.try_cast("double")
    told = F.try_variant_get(F.try_parse_json(raw), "$.confidence", "variant").isNotNull()
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(told, number(o["confidence"])).otherwise(number(o["language_probability"])), F.lit(0.0))))
    last = number(F.element_at(o["timestamps"]["end_time_seconds"], -1))
    ends = F.when(F.size(o["timestamps"]["end_time_seconds"]) > 0, last * 1000)
    duration = F.greatest(F.lit(0).cast("long"), F.coalesce(number(o["duration_ms"]), number(o["duration"]) * 1000, ends, F.lit(0.0)).cast("long"))
    said = _transcript(o) != ""
    return F.struct(_transcript(o).alias("transcript"), F.when(said, confidence).otherwise(0.0).alias("confidence"), F.when(said, duration).otherwise(0).alias("duration_ms"))


_SOURCE = "struct<id:string,query_id:string,passage_index:int,chunk_index:int,text:string,parent_text:string,source:string,chunk_type:string,score:double,retrieval_score:double,rerank_score:double,strategy:string>"
_TIMES = "stt_ms total_ms rag_total_ms total_rag retrieval_ms retrieval generation_ms generation guardrail_ms guardrails embedding_ms embedding qdrant_ms dense bm25_ms bm25 rrf_ms fusion".split()
_TIME = "struct<" + ",".join(f"{n}:double" for n in _TIMES) + ">"
RESPONSE_SCHEMA = (
    "transcript string, query string, answer string, no_answer boolean, explanation string, reasoning string, rationale string, input_mode string, "
    f"citations array<{_SOURCE}>, sources array<{_SOURCE}>, evidence array<{_SOURCE}>, latency {_TIME}, latency_ms {_TIME}, voice_latency struct<stt_ms:double,total_voice_pipeline_ms:double>"
)


def response_fields(raw: Column, fallback: Column | None = None) -> Column:
    """struct(transcript, answer, no_answer, explanation, citations, latencies, input_mode) of an API response with older and newer field names.

    Each value is the first of its names that is there. Citations without a label or text are named by their place.
    """
    o = F.from_json(raw, RESPONSE_SCHEMA)
    filled = lambda c: F.when(F.trim(c) != "", c)
    citations = F.transform(
        F.coalesce(o["citations"], o["sources"], o["evidence"], F.array().cast(f"array<{_SOURCE}>")),
        lambda c, i: F.struct(
            F.coalesce(c["id"], c["query_id"], (i + 1).cast("string")).alias("id"),
            F.coalesce(c["text"], c["parent_text"], F.concat(F.lit("Retrieved passage "), (i + 1).cast("string"))).alias("text"),
            F.coalesce(F.nullif(c["source"], F.lit("")), F.concat(F.lit("Query "), c["query_id"], F.lit(" (P"), F.coalesce(c["passage_index"], F.lit(0)).cast("string"), F.lit(")")), F.nullif(c["chunk_type"], F.lit("")), F.concat(F.lit("Passage "), (i + 1).cast("string"))).alias("source"),
            F.coalesce(c["score"], c["retrieval_score"], c["rerank_score"], F.lit(0.0)).alias("score"),
            F.coalesce(c["strategy"], F.concat(F.lit("chunk-"), c["chunk_index"].cast("string"))).alias("strategy"),
        ),
    )
    time, voice = F.coalesce(o["latency"], o["latency_ms"]), o["voice_latency"]
    either = lambda *names: F.coalesce(*(time[n] for n in names), F.lit(0.0))
    speech = F.coalesce(voice["stt_ms"], time["stt_ms"], F.lit(0.0))
    whole_rag = F.coalesce(time["rag_total_ms"], time["total_rag"], time["total_ms"], either("retrieval_ms") + either("generation_ms"))
    total = F.coalesce(time["total_ms"], voice["total_voice_pipeline_ms"], speech + whole_rag)
    return F.struct(
        F.coalesce(filled(o["transcript"]), filled(o["query"]), F.lit("") if fallback is None else fallback, F.lit("")).alias("transcript"), F.coalesce(o["answer"], F.lit("")).alias("answer"),
        F.coalesce(o["no_answer"], F.lit(False)).alias("no_answer"), F.coalesce(*(filled(o[c]) for c in ("explanation", "reasoning", "rationale"))).alias("explanation"), citations.alias("citations"),
        speech.alias("stt_ms"), either("retrieval_ms", "retrieval").alias("retrieval_ms"), either("generation_ms", "generation").alias("generation_ms"), either("guardrail_ms", "guardrails").alias("guardrail_ms"),
        either("embedding_ms", "embedding").alias("embedding_ms"), either("qdrant_ms", "dense").alias("qdrant_ms"), either("bm25_ms", "bm25").alias("bm25_ms"), either("rrf_ms", "fusion").alias("rrf_ms"),
        whole_rag.alias("rag_total_ms"), F.coalesce(voice["total_voice_pipeline_ms"], total).alias("total_voice_pipeline_ms"), F.when(total > 0, total).otherwise(1.0).alias("total_ms"),
        F.coalesce(o["input_mode"], F.when(voice.isNotNull(), "voice").otherwise("text")).alias("input_mode"),
    )


def response(rows: DataFrame) -> DataFrame:
    """Answers (query, answer, is_no_answer, used, rag_ms, stt_ms, total_ms) as the service's response: one JSON object a row.

    Voice latencies are there only where both are; the input mode says whether it was spoken.
    """
    spoken = F.col("stt_ms").isNotNull() & F.col("total_ms").isNotNull()
    evidence = F.transform("used", lambda u: F.struct(u["query_id"].alias("query_id"), u["passage_index"].alias("passage_index"), u["chunk_index"].alias("chunk_index"), u["score"].alias("retrieval_score")))
    body = F.struct(
        F.col("query").alias("transcript"), "answer", F.col("is_no_answer").alias("no_answer"), evidence.alias("evidence"), F.struct(F.col("rag_ms").alias("rag_total_ms")).alias("latency"),
        F.when(spoken, F.struct("stt_ms", F.col("total_ms").alias("total_voice_pipeline_ms"))).alias("voice_latency"), F.when(F.col("stt_ms").isNotNull(), "voice").otherwise("text").alias("input_mode"),
    )
    return rows.withColumn("response", F.to_json(body))
