"""Report queries: lengths, latencies, counters, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import token_count
from quillon.operators import composer, evaluate, guardrails, nested
from quillon.plans.registry import query
from quillon.sources.tables import documents, table

_WORDS = r"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("lang", F.when(F.col("text").isNotNull(), token_count("text")).alias("n"))


@query(f"WITH l AS (SELECT {_WORDS} AS n FROM documents) SELECT count(*) AS n_rows, count(*) FILTER (n IS NULL) AS malformed, count(*) FILTER (n = 0) AS empty, CAST(min(n) AS BIGINT) AS shortest, CAST(max(n) AS BIGINT) AS longest, round(avg(n), 6) AS mean FROM l")
def len_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.length_stats(_lengths(spark, sf_dir), "n").withColumn("mean", F.round("mean", 6))


_ENDS = evaluate.LENGTH_BUCKETS
_BUCKETS = [f"{a}-{b}" for a, b in zip((0, *(e + 1 for e in _ENDS)), _ENDS, strict=False)] + [f"{_ENDS[-1]}+"]
_CASE = " ".join(f"WHEN n <= {e} THEN '{b}'" for e, b in zip(_ENDS, _BUCKETS, strict=False))


@query(f"WITH l AS (SELECT {_WORDS} AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT CASE {_CASE} ELSE '{_BUCKETS[-1]}' END AS bucket, count(*) AS n FROM l GROUP BY 1), b AS (SELECT unnest({_BUCKETS!r}) AS bucket) SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)")
def len_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(_lengths(spark, sf_dir), "n")


def _rank_sql(rows: str, value: str, by: str = "") -> str:
    part, col = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"r AS (SELECT {col}{value} AS value, row_number() OVER ({part} ORDER BY {value}) AS i, count(*) OVER ({part}) AS n FROM {rows}) SELECT {col}CAST(p AS BIGINT) AS percent, value FROM r, (SELECT unnest([50, 75, 90, 95, 99]) AS p) WHERE i = greatest(1, ceil(p * n / 100.0))"


@query(f"WITH l AS (SELECT lang, CAST({_WORDS} AS BIGINT) AS n FROM documents WHERE text IS NOT NULL), {_rank_sql('l', 'n', 'lang').replace('count(*) OVER (PARTITION BY lang) AS n', 'count(*) OVER (PARTITION BY lang) AS c').replace('p * n / 100.0', 'p * c / 100.0')}")
def len_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(_lengths(spark, sf_dir), "n", [50, 75, 90, 95, 99], ["lang"])


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 70, 95, 100)) + " FROM events GROUP BY event_type")
def latency_percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.linear_percentiles(table(spark, sf_dir, "events"), "value", [50, 70, 95, 100], ["event_type"])
    return found.select("event_type", *(F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 70, 95, 100)))


@query(f"WITH {_rank_sql('(SELECT event_type, value FROM events WHERE value IS NOT NULL)', 'value', 'event_type')}")
def latency_percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf_dir, "events"), "value", [50, 75, 90, 95, 99], ["event_type"])


@query(f"SELECT unnest(range(1, 100)) AS k, unnest(list_transform(q, lambda x: round(x, 6))) AS q FROM (SELECT quantile_cont(value, {[k / 100 for k in range(1, 100)]!r}) AS q FROM events)")
def inclusive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.inclusive_quantiles(table(spark, sf_dir, "events"), "value").withColumn("q", F.round("q", 6))


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_state_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.last_values(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_type", "value"])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 200")
def recent_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring buffer of the last 200 samples of each user."""
    return evaluate.latest(table(spark, sf_dir, "events"), 200, "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents), w AS (SELECT DISTINCT CAST(round_even(i * (SELECT count(*) - 1 FROM documents) / 99.0, 0) AS BIGINT) AS place FROM (SELECT unnest(range(100)) AS i)) SELECT doc_id, place FROM r JOIN w USING (place)")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents at even distances in the order of ids."""
    return evaluate.evenly_spaced(documents(spark, sf_dir), "doc_id", 100)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(lang || ':' || doc_id), doc_id) AS i FROM documents) WHERE i <= 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents of each language with the smallest hashes."""
    return evaluate.smallest_hashes(documents(spark, sf_dir), "lang", "doc_id", 100).select("lang", "doc_id")


_ERRORS = "list_extract(['timeout', 'validation_error', 'stt_error', 'qdrant_connection_error', 'qdrant_query_error', 'internal_error', 'bm25_error'], CAST(1 + event_id % 7 AS INTEGER))"


@query(f"""WITH e AS (SELECT event_id, {_ERRORS} AS c, list_extract([404, 422, 502, 503, 504, 700, NULL], CAST(1 + user_id % 7 AS INTEGER)) AS s, list_extract(['service unavailable', '<html>', ''], CAST(1 + event_id % 3 AS INTEGER)) AS m FROM events)
SELECT event_id, CASE WHEN c = 'stt_error' AND s = 504 THEN 'timeout' ELSE c END AS category,
  CASE WHEN c = 'timeout' OR (c = 'stt_error' AND s = 504) THEN 504 WHEN c = 'validation_error' THEN CASE WHEN s BETWEEN 400 AND 499 THEN s ELSE 422 END WHEN c = 'stt_error' THEN CASE WHEN s IN (422, 502, 503) THEN s ELSE 502 END
    WHEN c LIKE 'qdrant%' OR (c = 'internal_error' AND m LIKE '%unavailable%' AND event_id % 2 = 0) THEN 503 ELSE 500 END AS status,
  CASE WHEN c = 'timeout' OR (c = 'stt_error' AND s = 504) THEN 'RAG_TIMEOUT' WHEN c = 'validation_error' THEN 'INVALID_REQUEST' WHEN c = 'stt_error' THEN 'STT_UNAVAILABLE'
    WHEN c LIKE 'qdrant%' OR (c = 'internal_error' AND m LIKE '%unavailable%' AND event_id % 2 = 0) THEN 'RAG_UNAVAILABLE' ELSE 'RAG_INTERNAL_ERROR' END AS code,
  CASE WHEN c = 'timeout' OR (c = 'stt_error' AND s = 504) THEN true WHEN c = 'stt_error' THEN coalesce(s = 503, false) ELSE c LIKE 'qdrant%' OR (c = 'internal_error' AND m LIKE '%unavailable%' AND event_id % 2 = 0) END AS retryable,
  CASE WHEN c = 'stt_error' AND coalesce(s, 0) <> 504 AND m = 'service unavailable' THEN m END AS own_message FROM e""")
def error_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as errors of all categories, statuses and messages; every second one is a runtime error."""
    pick = lambda key, n, *values: F.get(F.array(*(F.lit(v) for v in values)), (F.col(key) % n).cast("int"))
    category = pick("event_id", 7, "timeout", "validation_error", "stt_error", "qdrant_connection_error", "qdrant_query_error", "internal_error", "bm25_error")
    message = pick("event_id", 3, "service unavailable", "<html>", "")
    f = guardrails.failure(category, pick("user_id", 7, 404, 422, 502, 503, 504, 700, None), message, F.col("event_id") % 2 == 0)
    rows = table(spark, sf_dir, "events").select("event_id", message.alias("_m"), f.alias("f"))
    own = F.when((F.col("f.code") == "STT_UNAVAILABLE") & (F.col("f.message") == F.col("_m")), F.col("_m"))
    return rows.select("event_id", "f.category", "f.status", "f.code", "f.retryable", own.alias("own_message"))


_NAMES = ("SttError", "HttpError", "TimeoutError", "ResponseError", "Bm25Failure", "EmbedderError", "ComposerError", "ValueError", "RetrievalError", "KeyError")
_MODULES = ("app", "app.stt", "qdrant_client", "torch.nn", "app.answer_composer", "builtins", None)
_MESSAGES = ("connection refused", "", "bad filter", "qdrant dns", None)


def _listed(values: tuple, key: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"lower(coalesce(list_extract([{items}], CAST(1 + {key} % {len(values)} AS INTEGER)), ''))"


@query(f"""WITH e AS (SELECT event_id, {_listed(_NAMES, "event_id")} AS n, {_listed(_MODULES, "user_id")} AS m, {_listed(_MESSAGES, "CAST(floor(value) AS BIGINT)")} AS t, CASE WHEN event_type = 'error' THEN 400 + event_id % 200 END AS s FROM events),
k AS (SELECT *, contains(n, 'qdrant') OR contains(m, 'qdrant') OR contains(t, 'qdrant') AS store FROM e)
SELECT event_id, CASE WHEN contains(n, 'stt') OR contains(n, 'sarvam') OR contains(m, 'stt') THEN 'stt_error' WHEN s BETWEEN 400 AND 499 THEN 'validation_error' WHEN s IS NOT NULL THEN 'internal_error' WHEN contains(n, 'timeouterror') THEN 'timeout'
  WHEN store AND (contains(t, 'connection') OR contains(t, 'transport') OR contains(t, 'dns') OR contains(t, 'timeout')) THEN 'qdrant_connection_error' WHEN store THEN 'qdrant_query_error' WHEN contains(n, 'bm25') OR contains(m, 'bm25') THEN 'bm25_error'
  WHEN contains(n, 'embedding') OR contains(n, 'embedder') OR contains(m, 'torch') THEN 'embedding_error' WHEN contains(n, 'composer') OR contains(m, 'answer_composer') THEN 'composition_error' WHEN contains(n, 'valueerror') THEN 'validation_error'
  WHEN contains(n, 'retriev') OR contains(m, 'retriev') THEN 'retrieval_error' ELSE 'internal_error' END AS category FROM k""")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as errors of many types, modules and texts; those of type error have a status."""
    pick = lambda values, key: F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))
    status = F.when(F.col("event_type") == "error", 400 + F.col("event_id") % 200)
    category = guardrails.error_category(pick(_NAMES, F.col("event_id")), pick(_MODULES, F.col("user_id")), pick(_MESSAGES, F.floor("value")), status)
    return table(spark, sf_dir, "events").select("event_id", category.alias("category"))


@query(r"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'xx' ELSE 'en' END AS language, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN language <> 'en' THEN 'UNSUPPORTED_LANGUAGE' WHEN coalesce(t, '') = '' THEN 'QUERY_INVALID' WHEN length(t) > 4000 THEN 'QUERY_INVALID' WHEN NOT regexp_matches(t, '[\p{L}\p{N}]') THEN 'QUERY_INVALID' END AS code FROM r""")
def guardrail_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a typed request; each seventh in a language that isn't known."""
    rows = table(spark, sf_dir, "conversations").withColumn("language", F.when(F.col("turn") % 7 == 6, "xx").otherwise("en"))
    return rows.select("conv_id", "turn", guardrails.pre_check(F.col("text"), F.col("language"), F.lit("text")).alias("code"))


@query("SELECT user_id, round(least(1, 4 * sqrt(avg(pow((value - 128) / 128.0, 2)))), 6) AS level FROM events GROUP BY user_id")
def rms_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rms_level(table(spark, sf_dir, "events"), "user_id", "value").withColumn("level", F.round("level", 6))


@query(r"""WITH r AS (SELECT event_id, CASE WHEN user_id % 5 = 4 THEN 'xx' ELSE 'en' END AS language, event_type, value, trim(coalesce(json_extract_string(props, '$.k'), '')) AS answer FROM events),
p AS (SELECT *, CASE WHEN language <> 'en' THEN 'UNSUPPORTED_LANGUAGE' WHEN NOT regexp_matches(event_type, '[a-z]') THEN 'QUERY_INVALID' END AS pre, CASE WHEN event_type = 'error' THEN 'internal_error' WHEN value * 1000 > 30000 THEN 'timeout' END AS category FROM r)
SELECT event_id, CASE WHEN pre IS NOT NULL THEN 422 WHEN category = 'timeout' THEN 504 WHEN category IS NOT NULL THEN 500 ELSE 200 END AS status, coalesce(pre, CASE WHEN category IS NULL AND answer = '' THEN 'INSUFFICIENT_EVIDENCE' END) AS guardrail_code FROM p""")
def harness_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: the type as query, a property as answer, the value in seconds as time."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("query"), F.when(F.col("user_id") % 5 == 4, "xx").otherwise("en").alias("language"), F.lit("text").alias("input_mode"),
        F.get_json_object("props", "$.k").alias("answer"), F.lit(False).alias("is_no_answer"), F.lit(1).alias("evidence_count"),
        F.when(F.col("event_type") == "error", "internal_error").alias("error_category"), (F.col("value") * 1000).alias("elapsed_ms"),
    )
    return guardrails.harness(rows).select("event_id", "status", "guardrail_code")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'en' END AS language, CASE WHEN value - 50 >= 0 THEN value - 50 END AS rag_ms FROM events")
def safe_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown languages and negative times are dropped from diagnostics."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "en").otherwise("zz").alias("language"), F.lit("text").alias("input_mode"), F.lit(None).cast("string").alias("guardrail_code"), (F.col("value") - 50).alias("rag_ms"))
    safe = guardrails.safe_diagnostics(rows.withColumn("input_mode", F.lit("text")), ["rag_ms", "event_id"])
    return safe.select(F.col("event_id"), "language", "rag_ms")


@query("SELECT item_id, text FROM benchmark WHERE trim(text) <> '' ORDER BY item_id LIMIT 10")
def first_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten benchmark items that aren't blank."""
    return evaluate.first_rows(table(spark, sf_dir, "benchmark"), ["item_id"], 10, F.trim("text") != "").select("item_id", "text")


_EVENT_JSON = """'{"id":' || event_id || ',"type":"' || event_type || '","user":{"id":' || user_id || ',"api_key":"k' || user_id || '","tags":["t",{"odd":' || CASE WHEN user_id % 2 = 1 THEN 'true' ELSE 'false' END || ',"Token":' || event_id || '},[],null]},"props":' || props || '}'"""


def _event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested JSON texts around the JSON that they hold."""
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.expr(_EVENT_JSON).alias("j"))


@query(f"""WITH e AS (SELECT event_id, {_EVENT_JSON} AS j FROM events WHERE props IS NOT NULL)
SELECT regexp_replace(fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n FROM e, json_tree(CAST(e.j AS JSON)) t GROUP BY 1, 2""")
def json_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the events' nested JSON, with the kinds of its values."""
    return nested.key_report(nested.walk(_event_json(spark, sf_dir), "event_id", "j"))


@query(f"""WITH e AS (SELECT event_id, {_EVENT_JSON} AS j FROM events WHERE props IS NOT NULL)
SELECT event_id, replace(replace(j, '"api_key":"k' || regexp_extract(j, '"k([0-9]+)"', 1) || '"', '"api_key":"[REDACTED]"'), '"Token":' || event_id, '"Token":"[REDACTED]"') AS j FROM e""")
def json_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same JSON without the values of secret keys, wherever they stand."""
    return _event_json(spark, sf_dir).select("event_id", nested.redact_keys("j").alias("j"))


@query("""SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN 'model ' || length(text) ELSE source END AS composed_answer, CASE WHEN length(text) % 3 = 0 THEN 'model' ELSE 'fallback' END AS composed_by,
CASE WHEN text IS NULL THEN 'no_prompt' WHEN length(text) % 3 = 1 THEN 'ConnectionError' WHEN length(text) % 3 = 2 THEN 'empty' END AS composer_error FROM documents""")
def composed_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts of a scripted model that answers a third, fails for a third and has nothing to say to the others."""

    def make() -> composer.Model:
        def model(prompt: str) -> str:
            if len(prompt) % 3 == 1:
                raise ConnectionError
            return f"model {len(prompt)}" if len(prompt) % 3 == 0 else " "

        return model

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("prompt"))
    return composer.compose_with(rows, make, fallback_col="source", pause=0.001).select("doc_id", "composed_answer", "composed_by", "composer_error")
