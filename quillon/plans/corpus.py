"""Corpus queries: passages, policies, chunks, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions.text import answer_sentences, chunk_sentences, devanagari_language, estimated_tokens, normalize_space, preview, redact, without_fillers
from quillon.operators import audit, chunking, evaluate, ingest, policies, skyline, token_chunks
from quillon.plans.registry import query
from quillon.plans.retrieval import _answer_sentences_sql
from quillon.sources import sinks
from quillon.sources.scratch import keep
from quillon.sources.tables import documents, records, seed_passages, table

RECORDS_SQL = """lb AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS quality FROM labels GROUP BY doc_id),
rec AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines, coalesce(quality, 0) AS quality FROM documents LEFT JOIN lb USING (doc_id)),
pas AS (SELECT * FROM (SELECT doc_id AS query_id, lang, CAST(i AS INTEGER) AS passage_index, trim(regexp_replace(lines[i + 1], '\\s+', ' ', 'g')) AS text, CASE WHEN quality = 1 AND i % 3 = 0 THEN 1 ELSE 0 END AS is_selected
  FROM (SELECT *, unnest(range(len(lines))) AS i FROM rec)) WHERE text <> '')"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.passages(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT query_id, passage_index, text, is_selected FROM pas")
def explode_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("query_id", "passage_index", "text", "is_selected")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", normalize_space("text").alias("text"))


@query("SELECT count(*) FILTER (len(string_split(text, chr(10))) % 5 = 0) AS malformed, count(*) FILTER (len(string_split(text, chr(10))) % 5 <> 0) AS well_formed FROM documents")
def malformed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose labels are one short, here those with 5, 10, ... passages, and the others."""
    rows = records(spark, sf_dir).withColumn("is_selected", F.when(F.size("passages") % 5 == 0, F.slice("is_selected", F.lit(1), F.size("passages") - 1)).otherwise(F.col("is_selected")))
    bad = ingest.is_malformed(F.col("passages"), F.col("is_selected"))
    return rows.agg(F.count_if(bad).alias("malformed"), F.count_if(~bad).alias("well_formed"))


def _policy_sql(kind: str) -> str:
    extra = {"A": "0", "B": "1", "C": "2", "D": "CASE WHEN s = 0 THEN 1 ELSE 0 END", "E": "1"}[kind]
    only = "WHERE is_selected = 1" if kind == "A" else ""
    return f"""WITH {RECORDS_SQL}, sel AS (SELECT query_id, list(passage_index) AS chosen FROM pas WHERE is_selected = 1 GROUP BY 1),
m AS (SELECT pas.*, coalesce(len(chosen), 0) AS s, CASE WHEN is_selected = 1 THEN -1 WHEN chosen IS NULL THEN passage_index ELSE list_min(list_transform(chosen, lambda x: abs(x - passage_index))) END AS d FROM pas LEFT JOIN sel USING (query_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, passage_index) AS INTEGER) AS place FROM m {only})
SELECT query_id, passage_index, is_selected, place FROM r WHERE place <= s + {extra}"""


def _policy(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        full = next(p for p in policies.POLICIES if p.startswith(f"POLICY_{name}"))
        return policies.choose(_passages(spark, sf_dir), full).select("query_id", "passage_index", "is_selected", "place")

    run.__name__ = f"policy_{name.lower()}"
    return query(_policy_sql(name))(run)


for _name in "ABCDE":
    _policy(_name)


@query(f"""WITH {RECORDS_SQL}, one AS (SELECT doc_id, len(lines) AS p, len(list_filter(lines, lambda x: trim(x) <> '')) AS f, CASE WHEN quality = 1 THEN len(list_filter(range(len(lines)), lambda i: i % 3 = 0)) ELSE 0 END AS s FROM rec)
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS ids, count(doc_id) - count(DISTINCT doc_id) AS repeated_ids, CAST(sum(p) AS BIGINT) AS passages, CAST(sum(f) AS BIGINT) AS non_empty, CAST(sum(s) AS BIGINT) AS selected, count(*) FILTER (s = 0) AS zero_selected FROM one""")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.source_stats(records(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL}, one AS (SELECT CASE WHEN quality = 1 THEN len(list_filter(range(len(lines)), lambda i: i % 3 = 0)) ELSE 0 END AS s FROM rec)
SELECT CAST(s AS BIGINT) AS selected, count(*) AS n_rows FROM one GROUP BY s""")
def selected_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.selected_distribution(records(spark, sf_dir))


_POLICY_UNION = " UNION ALL ".join(f"SELECT '{name}' AS policy, query_id, is_selected FROM ({_policy_sql(name[7])})" for name in policies.POLICIES)


@query(f"""WITH u AS ({_POLICY_UNION}), w AS (WITH {RECORDS_SQL} SELECT count(DISTINCT query_id) AS ar, count(*) AS ap, sum(is_selected) AS asel FROM pas),
p AS (SELECT policy, count(DISTINCT query_id) AS rows_covered, count(*) AS passages, CAST(sum(is_selected) AS BIGINT) AS selected FROM u GROUP BY 1)
SELECT policy, rows_covered, ar - rows_covered AS rows_dropped, passages, selected, round(passages / rows_covered, 6) AS passages_per_row, round(100 * (1 - passages / ap), 6) AS reduction_percent, round(100 * selected / asel, 6) AS representation_percent FROM p, w""")
def policy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's coverage and size against all passages."""
    passages = _passages(spark, sf_dir)
    return policies.policy_stats(policies.all_policies(passages), passages)


_MEASURES_SQL = f"""u AS ({_POLICY_UNION}), w AS (WITH {RECORDS_SQL} SELECT sum(is_selected) AS asel FROM pas),
m AS (SELECT policy, count(DISTINCT query_id) AS rows_covered, count(*) AS passages, round(100 * CAST(sum(is_selected) AS BIGINT) / any_value(asel), 6) AS representation_percent FROM u, w GROUP BY 1)"""


@query(f"""WITH {_MEASURES_SQL},
b AS (SELECT policy FROM m x WHERE NOT EXISTS (FROM m y WHERE y.policy <> x.policy AND NOT (x.rows_covered >= y.rows_covered AND x.representation_percent >= y.representation_percent AND x.passages <= y.passages
  AND (x.rows_covered > y.rows_covered OR x.representation_percent > y.representation_percent OR x.passages < y.passages))))
SELECT CASE WHEN count(*) = 1 THEN array_to_string(list_slice(string_split(max(policy), '_'), 1, 2), '_') || '_RECOMMENDED' ELSE 'COMPACT_POLICY_TRADE_OFF_UNRESOLVED' END AS recommendation FROM b""")
def pareto_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy, if there is one, that covers as many records and selected passages as any other with as few passages."""
    return policies.recommend(policy_stats(spark, sf_dir), ("rows_covered", "representation_percent"), ("passages",))


@query(f"""WITH {_MEASURES_SQL}, l AS (SELECT *, lag(representation_percent) OVER o AS q, lag(passages) OVER o AS c, lag(rows_covered) OVER o AS r FROM m WINDOW o AS (ORDER BY passages, policy))
SELECT policy, round((rows_covered - r)::DOUBLE / NULLIF((passages - c) / 10000.0, 0), 6) AS rows_per_10k, round((representation_percent - q)::DOUBLE / NULLIF((passages - c) / 10000.0, 0), 6) AS percent_per_10k FROM l""")
def marginal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy gains over the next smaller one: records and selected passages covered, per 10,000 passages more."""
    metrics = keep(policy_stats(spark, sf_dir).withColumnRenamed("passages", "chunk_count"), "measures")
    rows, percent = (policies.marginal_quality(metrics, c).select("policy", F.round("per_10k_chunks", 6).alias(name)) for c, name in (("rows_covered", "rows_per_10k"), ("representation_percent", "percent_per_10k")))
    return rows.join(percent, "policy")


_GROUPS_SQL = "g AS (SELECT lang, source, count(*) AS docs, max(n_chars) AS longest, min(n_chars) AS shortest, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY 1, 2)"


@query(f"""WITH {_GROUPS_SQL} SELECT * FROM g x WHERE NOT EXISTS (FROM g y WHERE y.docs >= x.docs AND y.longest >= x.longest AND y.shortest <= x.shortest AND y.lengths >= x.lengths AND (y.docs > x.docs OR y.longest > x.longest OR y.shortest < x.shortest OR y.lengths > x.lengths))""")
def skyline_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of sources that no other exceeds in documents, in their longest, shortest and different lengths at once."""
    n = F.col("n_chars")
    groups = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.max(n).alias("longest"), F.min(n).alias("shortest"), F.count_distinct(n).alias("lengths"))
    return skyline.skyline(groups, ["docs", "longest", "lengths"], ["shortest"])


@query("""WITH d AS (SELECT doc_id, n_chars, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL)
SELECT * FROM d x WHERE NOT EXISTS (FROM d y WHERE y.spaces >= x.spaces AND y.n_chars <= x.n_chars AND (y.spaces > x.spaces OR y.n_chars < x.n_chars))""")
def skyline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents than which none has as many spaces in as few characters."""
    docs = table(spark, sf_dir, "documents").where("text is not null and n_chars is not null")
    return skyline.skyline(docs.select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("spaces")), ["spaces"], ["n_chars"])


_SPLIT_SQL = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([।.!?]+)( |$)', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len({_SPLIT_SQL}) AS BIGINT) AS n, md5(array_to_string({_SPLIT_SQL}, chr(10))) AS sentences_md5 FROM documents WHERE text IS NOT NULL")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).where("text is not null").select("doc_id", chunk_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query(f"WITH s AS (SELECT doc_id, {_answer_sentences_sql('text')} AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s")
def answer_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).select("doc_id", answer_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


def _chunks(spark: SparkSession, sf_dir: str, max_tokens: int = 64) -> DataFrame:
    return chunking.chunk(_passages(spark, sf_dir), max_tokens)


def _chunks_sql(size: int = 64) -> str:
    """Chunks by the same fold in SQL: a state of finished chunks and open sentences, over each passage's sentences."""
    kind, none, step = "STRUCT(t VARCHAR, s VARCHAR)[]", "CAST([] AS VARCHAR[])", size - min(chunking.WINDOW_OVERLAP, size - 1)

    def n(x: str) -> str:
        return f"len(string_split({x}, ' '))"

    flush = "CASE WHEN len(a.open) > 0 THEN list_append(a.done, {'t': array_to_string(a.open, ' '), 's': 'sentence_overlap'}) ELSE a.done END"
    new = "b.open[1]"
    windows = f"list_transform(range(greatest(1, CAST(ceil(({n(new)} - {size}) / {step}.0) AS BIGINT) + 1)), lambda i: {{'t': array_to_string(list_slice(string_split({new}, ' '), i * {step} + 1, i * {step} + {size}), ' '), 's': 'token_window_fallback'}})"
    fold = f"""list_reduce(list_transform(s, lambda x: {{'done': CAST([] AS {kind}), 'open': [x]}}), lambda a, b: CASE
 WHEN {n(new)} > {size} THEN {{'done': list_concat({flush}, {windows}), 'open': {none}}}
 WHEN len(a.open) = 0 THEN {{'done': a.done, 'open': [{new}]}}
 WHEN {n("array_to_string(a.open, ' ')")} + {n(new)} <= {size} THEN {{'done': a.done, 'open': list_append(a.open, {new})}}
 ELSE {{'done': {flush}, 'open': CASE WHEN {n("a.open[-1]")} + {n(new)} <= {size} THEN [a.open[-1], {new}] ELSE [{new}] END}} END, {{'done': CAST([] AS {kind}), 'open': {none}}})"""
    return f"""{RECORDS_SQL}, sp AS (SELECT query_id, passage_index, text, {_SPLIT_SQL} AS s FROM pas), fo AS (SELECT query_id, passage_index, text, {fold} AS a FROM sp),
ca AS (SELECT query_id, passage_index, CASE WHEN {n("text")} <= {size} THEN [{{'t': text, 's': 'whole_passage'}}] ELSE {flush} END AS c FROM fo),
cu AS (SELECT query_id, passage_index, CAST(i AS INTEGER) AS chunk_index, c[i + 1] AS k FROM (SELECT *, unnest(range(len(c))) AS i FROM ca)),
ch AS (SELECT query_id, passage_index, chunk_index, k.s AS chunk_strategy, CAST({n("k.t")} AS BIGINT) AS token_count, k.t AS text FROM cu)"""


@query(f"WITH {_chunks_sql()} SELECT query_id, passage_index, chunk_index, chunk_strategy, token_count, sha256(text) AS text_sha256 FROM ch")
def chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of at most 64 words."""
    return _chunks(spark, sf_dir).select("query_id", "passage_index", "chunk_index", "chunk_strategy", "token_count", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {_chunks_sql()} SELECT query_id, passage_index, chunk_index, chunk_strategy, token_count, sha256(text) AS text_sha256 FROM ch")
def chunks_as_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks as slices of their passages, cut where the tokens of a pluggable tokenizer, here words, lie."""
    found = token_chunks.chunk(_passages(spark, sf_dir), "words", 64)
    return found.select("query_id", "passage_index", "chunk_index", "chunk_strategy", "token_count", F.sha2("text", 256).alias("text_sha256"))


@query()
def chunks_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in chunks of at most 256 tokens of a byte-level vocabulary, with the tokens' ids."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return token_chunks.chunk(docs, public_tokenizers.path("byte_bpe_50k.json"), 256).select("doc_id", "chunk_index", "start", "end", "chunk_strategy", "token_count", F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"))


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT len(string_split(text, ' ')) AS n FROM pas)
SELECT count(*) AS passages, count(*) FILTER (n <= 64) AS whole_passages, CAST(max(n) AS BIGINT) AS longest FROM c""")
def chunk_whole_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages, those that are one chunk, and the longest passage."""
    from quillon.functions.text import token_count

    p = _passages(spark, sf_dir).select(token_count("text").alias("n"), F.size(chunking.chunks_of(F.col("text"), 64)).alias("c"), F.get(chunking.chunks_of(F.col("text"), 64), F.lit(0))["strategy"].alias("s"))
    return p.agg(F.count(F.lit(1)).alias("passages"), F.count_if((F.col("s") == "whole_passage") & (F.col("c") == 1)).alias("whole_passages"), F.max("n").alias("longest"))


@query(f"WITH {_chunks_sql()} SELECT chunk_strategy, count(*) AS chunks, max(token_count) AS longest, round(avg(token_count), 6) AS mean FROM ch GROUP BY 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("chunk_strategy").agg(F.count(F.lit(1)).alias("chunks"), F.max("token_count").alias("longest"), F.round(F.avg("token_count"), 6).alias("mean"))


_UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def _ids_sql(name: str) -> str:
    return rf"""WITH {RECORDS_SQL}, h AS (SELECT query_id, passage_index, sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode({name})) AS h FROM pas)
SELECT query_id, passage_index, {_UUID_SQL} AS point_id FROM h"""


@query(_ids_sql("'msmarco-xi-hindi:' || query_id || ':' || passage_index || ':0'"))
def point_ids_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("query_id", "passage_index", ids.legacy_point_id(F.col("query_id"), F.col("passage_index"), F.lit(0)).alias("point_id"))


@query(_ids_sql("'msmarco-xi-hindi-full:query_id=' || query_id || '|passage_index=' || passage_index || '|chunk_index=0|chunk_strategy=whole_passage'"))
def point_ids_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("query_id", "passage_index", ids.strategy_point_id(F.col("query_id"), F.col("passage_index"), F.lit(0), F.lit("whole_passage")).alias("point_id"))


@query(_ids_sql("'msmarco-xi-bilingual-compact:language=en|query_id=' || query_id || '|passage_index=' || passage_index || '|chunk_index=0|chunk_strategy=whole_passage'"))
def point_ids_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("query_id", "passage_index", ids.bilingual_point_id(F.lit("en"), F.col("query_id"), F.col("passage_index"), F.lit(0), F.lit("whole_passage")).alias("point_id"))


@query(f"WITH {_chunks_sql()} SELECT count(DISTINCT query_id) AS records, (SELECT count(*) FROM pas) AS documents, count(*) AS chunks, count(DISTINCT (query_id, passage_index, chunk_index, chunk_strategy)) AS points FROM ch")
def index_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexing flow as one row of counts: records, passages, chunks, distinct points."""
    passages = _passages(spark, sf_dir)
    chunks = chunking.chunk(passages, 64)
    point = ids.strategy_point_id(F.col("query_id"), F.col("passage_index"), F.col("chunk_index"), F.col("chunk_strategy"))
    counts = chunks.select("query_id", point.alias("point_id")).agg(F.count_distinct("query_id").alias("records"), F.count(F.lit(1)).alias("chunks"), F.count_distinct("point_id").alias("points"))
    return counts.crossJoin(passages.agg(F.count(F.lit(1)).alias("documents"))).select("records", "documents", "chunks", "points")


@query("SELECT * FROM (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'bigint')) t(name, type), (SELECT least(count(*), 100) AS present FROM documents)")
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, types and how many of the first 100 rows have a value."""
    from quillon.sources.tables import schema_report as report

    return report(table(spark, sf_dir, "documents"), 100)


@query("SELECT k AS doc_id, n_chars, doc_id IS NOT NULL AS found FROM (SELECT unnest([doc_id, -1 - doc_id]) AS k FROM documents WHERE doc_id % 20 = 0) LEFT JOIN documents ON doc_id = k")
def lookup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all ids that 20 divides, and of as many that aren't there, which is said."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    wanted = docs.where("doc_id % 20 = 0").select(F.explode(F.array(F.col("doc_id"), -1 - F.col("doc_id"))).alias("doc_id"))
    return sinks.lookup(docs, wanted, "doc_id")


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND vec_id % 2 = 0")
def valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a UUID and a sound vector; here every second one has no UUID."""
    uuid = ids.uuid5(F.col("vec_id").cast("string"))
    points = table(spark, sf_dir, "embeddings").withColumn("point_id", F.when(F.col("vec_id") % 2 == 0, uuid).otherwise("none"))
    return sinks.valid_points(points, 64, vector="embedding").select("vec_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'KNOWN_OVERWRITE' ELSE 'UNEXPLAINED' END AS class FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def classify_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, as known or unexplained; those divisible by 3 are known."""
    docs = documents(spark, sf_dir)
    return policies.classify_missing(audit.missing(docs, table(spark, sf_dir, "labels"), "doc_id").select("doc_id"), docs.where("doc_id % 3 = 0"), ["doc_id"]).select("doc_id", "class")


@query("""WITH e AS (SELECT lang, count(*) AS expected, count(l.doc_id) AS actual, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (lang = 'fr') AS payload_errors FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang
  UNION ALL SELECT 'labelled', count(*), count(*), 0, 0 FROM (SELECT DISTINCT doc_id FROM labels)
  UNION ALL SELECT 'unmeasured', count(*), count(*), 0, 0 FROM documents UNION ALL SELECT 'unexplained', count(*), 0, 0, 0 FROM documents)
SELECT lang, expected, actual, missing, greatest(0, expected - actual) AS unexplained,
  CASE WHEN missing = 0 AND payload_errors = 0 AND lang <> 'unmeasured' AND lang <> 'unexplained' THEN 'INDEX_SAFE_FOR_BENCHMARKING' ELSE 'INDEX_REQUIRES_FIX' END AS status FROM e""")
def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's labels as its index; and the labelled documents as a whole one, one whose vectors were never measured, and one with an indexing error."""
    docs, labelled = documents(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    per = docs.join(labelled, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("expected"), F.count("l").alias("actual"), F.count_if(F.col("l").isNull()).alias("missing"), F.count_if(F.col("lang") == "fr").alias("payload_errors"))
    zero = F.lit(0).cast("long")
    whole = [df.agg(F.count(F.lit(1)).alias("expected")).select(F.lit(name).alias("lang"), "expected", (zero if name == "unexplained" else F.col("expected")).alias("actual"), zero.alias("missing"), zero.alias("payload_errors")) for df, name in ((labelled, "labelled"), (docs, "unmeasured"), (docs, "unexplained"))]
    report = reduce(DataFrame.unionByName, whole, per).withColumn("unexpected", F.lit(0))
    report = report.withColumn("vector_size", F.when(F.col("lang") != "unmeasured", 768)).withColumn("failed_class", F.when(F.col("lang") == "unexplained", "INDEXING_BUG").otherwise("RETRIEVAL_MISS"))
    return audit.final_status(report).select("lang", "expected", "actual", "missing", "unexplained", "status")


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT doc_id, doc_id % 11 <> 0 AS found, CASE WHEN doc_id % 13 <> 0 THEN lines END AS lines, trim(regexp_replace(lines[1], '\\s+', ' ', 'g')) AS q, quality, lines AS every FROM rec)
SELECT doc_id, CASE WHEN NOT found THEN 'INDEXING_BUG' WHEN lines IS NULL OR doc_id % 17 = 0 OR q = '' THEN 'AMBIGUOUS_GROUND_TRUTH' WHEN doc_id % 5 = 0 THEN 'SMOKE_TEST_EXPECTATION_BUG'
  WHEN doc_id % 7 = 0 OR (doc_id % 3 = 0 AND quality = 1 AND q <> '') THEN 'INDEXING_BUG' ELSE 'RETRIEVAL_MISS' END AS class FROM r""")
def failed_query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records whose first line is the query; some are not found, malformed, asked otherwise, not indexed or without their first point."""
    rows = records(spark, sf_dir).withColumn("i", F.col("query_id"))
    whole = F.sequence(F.lit(0), F.size("passages") - 1).cast("array<int>")
    rows = rows.select(
        F.col("i").alias("doc_id"), (F.col("i") % 11 != 0).alias("found"), F.get("passages", F.lit(0)).alias("query"), F.when(F.col("i") % 13 != 0, F.col("passages")).alias("passages"),
        F.when(F.col("i") % 17 == 0, F.slice("is_selected", 1, F.size("is_selected") - 1)).otherwise(F.col("is_selected")).alias("is_selected"),
        F.when(F.col("i") % 7 != 0, F.when(F.col("i") % 3 == 0, F.array_append(F.filter(whole, lambda k: k > 0), F.lit(-1))).otherwise(whole)).alias("indexed"),
    )
    asked = normalize_space("query")
    return audit.failed_query_class(rows.withColumn("asked", F.when(F.col("doc_id") % 5 == 0, F.concat(asked, F.lit("?"))).otherwise(asked))).select("doc_id", "class")


@query("""WITH u AS (SELECT DISTINCT 'unexpected' AS kind, doc_id FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id) ORDER BY doc_id LIMIT 10), m AS (SELECT DISTINCT 'missing' AS kind, doc_id FROM documents ANTI JOIN labels USING (doc_id) WHERE lang = 'en' ORDER BY doc_id LIMIT 10)
SELECT * FROM m UNION ALL SELECT * FROM u""")
def reconcile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ids that a reconciliation report names."""
    return audit.reconcile_samples(documents(spark, sf_dir).where("lang = 'en'"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH r AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN text END AS text, lang, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents), w AS (SELECT DISTINCT CAST(round_even(i * (SELECT count(*) - 1 FROM documents) / 19.0, 0) AS BIGINT) AS place FROM (SELECT unnest(range(20)) AS i))
SELECT doc_id, place, CASE WHEN text IS NULL THEN '[text]' ELSE '[]' END AS errors FROM r JOIN w USING (place)""")
def integrity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty payloads at even distances; those of an odd length have lost their text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("text")).alias("text"), "lang")
    return audit.integrity_sample(rows, "doc_id", ["text", "lang"], 20).select("doc_id", "place", F.concat(F.lit("["), F.array_join("errors", ", "), F.lit("]")).alias("errors"))


@query(f"WITH {RECORDS_SQL} SELECT query_id, passage_index FROM pas WHERE query_id = (SELECT max(doc_id) FROM documents)")
def points_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of one record, the last."""
    last = documents(spark, sf_dir).agg(F.max("doc_id")).first()[0]
    return sinks.points_of(_passages(spark, sf_dir), last).select("query_id", "passage_index")


@query("SELECT doc_id, lang, sha256(text) AS text_hash, n_chars FROM documents")
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON payloads, and read back from them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text", "lang", "n_chars")
    back = ingest.from_payload(ingest.payload(docs), "text string, lang string, n_chars long")
    return back.select(F.col("point_id").alias("doc_id"), "lang", ids.text_hash(F.col("text")).alias("text_hash"), "n_chars")


@query(f"""WITH u AS ({_POLICY_UNION.replace("is_selected FROM", "passage_index FROM")}), c AS (WITH {_chunks_sql(64)} SELECT query_id, passage_index, chunk_strategy FROM ch), j AS (SELECT policy, query_id, chunk_strategy FROM u JOIN c USING (query_id, passage_index)),
p AS (SELECT policy, query_id, count(*) AS n, count(*) FILTER (chunk_strategy = 'whole_passage') AS w, count(*) FILTER (chunk_strategy = 'sentence_overlap') AS s, count(*) FILTER (chunk_strategy = 'token_window_fallback') AS t FROM j GROUP BY ALL)
SELECT policy, CAST(sum(n) AS BIGINT) AS chunks, max(n) AS max_chunks_of_row, round(sum(n) / (SELECT count(*) FROM documents), 6) AS chunks_per_row, count(*) AS records_kept, CAST(sum(w) AS BIGINT) AS whole_passage, CAST(sum(s) AS BIGINT) AS sentence_overlap, CAST(sum(t) AS BIGINT) AS token_window_fallback FROM p GROUP BY policy""")
def policy_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's chunks of at most 64 words."""
    chosen = policies.all_policies(_passages(spark, sf_dir)).select("policy", "query_id", "passage_index", "text", "is_selected")
    return policies.policy_chunk_stats(chosen, documents(spark, sf_dir).count(), 64)


@query(f"""WITH {RECORDS_SQL}, one AS (SELECT len(lines) AS p, len(list_filter(lines, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')) AS f, CASE WHEN quality = 1 THEN len(list_filter(range(len(lines)), lambda i: i % 3 = 0)) ELSE 0 END AS s FROM rec WHERE lang = 'en'),
c AS (WITH {_chunks_sql(64)} SELECT count(*) AS n FROM ch JOIN (SELECT query_id, passage_index FROM pas WHERE is_selected = 1 AND lang = 'en') USING (query_id, passage_index))
SELECT count(*) AS n_rows, CAST(sum(p) AS BIGINT) AS passages, CAST(sum(f) AS BIGINT) AS non_empty_passages, CAST(sum(s) AS BIGINT) AS selected_passages, count(*) FILTER (s = 0) AS zero_selected_rows, (SELECT n FROM c) AS compact_chunks FROM one""")
def english_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English view's counters, with the chunks that policy A keeps of it."""
    return policies.english_stats(records(spark, sf_dir).where("source_lang = 'en'"), 64)


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, round(n * 9193.472 / 1073741824.0, 9) AS gib, round(2 * n * 9193.472 / 1073741824.0, 9) AS all_gib, round(n * 9193.472 / 1073741824.0 * 0.35, 9) AS monthly_cost, 2 * n * 9193.472 / 1073741824.0 <= 0.002 AS is_safe FROM c""")
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each language's points take and cost, and whether two such languages fit 0.002 GiB."""
    counts = documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    r = counts.select("lang", policies.storage_report(F.col("n"), 9193.472, 2, 0.35, 0.002).alias("r"))
    return r.select("lang", *(F.round(f"r.{c}", 9).alias(c) for c in ("gib", "all_gib", "monthly_cost")), "r.is_safe")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS i FROM documents) WHERE i = 1")
def first_of_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows of one provenance (here a language) the first in a stated order."""
    rows = table(spark, sf_dir, "documents").withColumn("_o", -F.col("n_chars"))
    return evaluate.first_of_each(rows, ["lang"], ["_o", "doc_id"]).select("lang", "doc_id")


@query(f"""WITH {RECORDS_SQL} SELECT 'seed-' || l || '-' || i AS query_id, l AS language, t AS text FROM (VALUES ('en', 0, 'A seed.'), ('en', 1, 'Another.'), ('hi', 0, 'बीज')) s(l, i, t) UNION ALL SELECT CAST(query_id AS VARCHAR), lang, text FROM pas""")
def seeded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed passages and the corpus as one bag."""
    seeds = seed_passages(spark, {"en": ["A seed.", "Another."], "hi": ["बीज"]}).select("query_id", "language", "text")
    return seeds.unionByName(_passages(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), F.col("source_lang").alias("language"), "text"))


@query("WITH i AS (SELECT DISTINCT source AS k FROM documents WHERE doc_id % 2 = 0) SELECT source, text FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents JOIN i ON k = source WHERE trim(text) <> '') WHERE n = 1")
def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index keys (here sources) with their first text that isn't blank."""
    docs = table(spark, sf_dir, "documents")
    return sinks.first_text(docs.where("doc_id % 2 = 0"), docs, "source", "text", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id > (SELECT max(doc_id) // 2 FROM documents)")
def resumed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a checkpoint in the middle of the ids."""
    docs = documents(spark, sf_dir)
    return sinks.after(docs, "doc_id", docs.agg(F.max("doc_id")).first()[0] // 2).select("doc_id")


@query("SELECT doc_id, list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END], lambda x: x IS NOT NULL)::VARCHAR AS errors FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields that are null, of documents joined with their labels."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = documents(spark, sf_dir).join(labels, "doc_id", "left")
    return rows.select("doc_id", F.concat(F.lit("["), F.array_join(ingest.payload_errors(["quality", "toxic"]), ", "), F.lit("]")).alias("errors"))


@query("SELECT count(*) FILTER (lang <> 'en') AS foreign_rows FROM documents")
def foreign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.foreign_rows(documents(spark, sf_dir).withColumn("asked", F.lit("en")), "lang", "asked")


@query("SELECT lang, round(count(*) * 9193.472 / 1073741824.0, 9) AS gib FROM documents GROUP BY lang")
def storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", F.round(policies.storage_gib(F.col("n"), 9193.472), 9).alias("gib"))


@query("SELECT doc_id, sha256(text) AS text_hash, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS preview FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", ids.text_hash(F.col("text")).alias("text_hash"), preview("text").alias("preview"))


@query("SELECT text_hash, count(*) AS n FROM (SELECT sha256(text) AS text_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def dup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_keys(documents(spark, sf_dir).select(ids.text_hash(F.col("text")).alias("text_hash")), "text_hash")


@query("""WITH r AS (SELECT doc_id, lang, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS i, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS f, first_value(lang) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS fl FROM documents)
SELECT doc_id, f AS first_doc_id, lang = fl AS same_lang FROM r WHERE i > 1""")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the text of an earlier one, by the hash as identifier."""
    rows = documents(spark, sf_dir).select(ids.text_hash(F.col("text")).alias("h"), "doc_id", "lang")
    found = audit.collisions(rows, "h", "doc_id", ["doc_id", "lang"])
    return found.select("doc_id", "first_doc_id", (F.col("lang") == F.col("first_lang")).alias("same_lang"))


@query("""WITH p AS (SELECT sha256(text) AS h, count(*) AS n, count(DISTINCT source) AS k FROM documents GROUP BY 1)
SELECT count(*) AS ids, count(*) FILTER (n > 1) AS repeated_ids, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS extra_rows, count(*) FILTER (n > 1 AND k <= 1) AS identical, count(*) FILTER (n > 1 AND k > 1) AS different FROM p""")
def collision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(ids.text_hash(F.col("text")).alias("h"), "source")
    return audit.collision_report(rows, "h", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unexpected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other languages' documents that the good labels don't name."""
    return audit.unexpected(table(spark, sf_dir, "labels").where("quality = 1"), documents(spark, sf_dir).where("lang <> 'en'"), "doc_id").select("doc_id")


@query("""WITH e AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), a AS (SELECT DISTINCT doc_id FROM labels)
SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM a) AS actual, (SELECT count(*) FROM e SEMI JOIN a USING (doc_id)) AS matched, (SELECT count(*) FROM e ANTI JOIN a USING (doc_id)) AS missing, (SELECT count(*) FROM a ANTI JOIN e USING (doc_id)) AS unexpected""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reconcile(documents(spark, sf_dir).where("lang = 'en'"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) AS i FROM documents) WHERE i = 1")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several writes to one point (here a language), the last one."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", F.struct("n_chars", "doc_id").alias("seq"))
    return sinks.last_per_id(rows, "lang", "seq").select("doc_id", "lang", "n_chars")


@query("SELECT count(*) FILTER (len(embedding) <> 64) AS wrong_size, 0::BIGINT AS not_finite FROM embeddings")
def vector_size_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.vector_size_errors(table(spark, sf_dir, "embeddings"), 64, "embedding")


@query(r"""SELECT doc_id, regexp_replace(text, '((?:api[_ -]?key|token|secret)\s*[:=]\s*)([^\s,;]+)', '\1[REDACTED]', 'gi') AS text FROM documents""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", redact("text").alias("text"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '\b(?:um|uh|hmm)\b', ' ', 'g'), '\s+', ' ', 'g')) AS text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, 'en' AS language FROM conversations")
def normalize_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", without_fillers("text").alias("text"), estimated_tokens("text").alias("tokens"), devanagari_language("text").alias("language"))
