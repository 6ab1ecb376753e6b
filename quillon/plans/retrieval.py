"""Retrieval queries: BM25, projection and vector search, fusion, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import ABBREVIATIONS, ANSWER_STOP_TERMS, NO_ANSWER, TITLES, tokenize
from quillon.operators import answers, dense, evaluate, fusion, ingest, lexical, maturity
from quillon.plans.registry import query
from quillon.sources.scratch import keep
from quillon.sources.tables import benchmark_queries, documents, table

KEYS = ["doc_id"]


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def tokens_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(replace(lower({text}), 'ß', 'ss'), '[\p{{P}}\p{{S}}]', ' ', 'g'), '\s+'), lambda x: x <> '')"


QUERIES_SQL = r"""q AS (
  SELECT item_id AS query_key, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM benchmark WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''
)"""
BM25_SQL = f"""{QUERIES_SQL}, t AS (SELECT doc_id, {tokens_sql("coalesce(text, '')")} AS w FROM documents),
tok AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
qt AS (SELECT DISTINCT query_key, unnest({tokens_sql("query")}) AS term FROM q),
bm AS (
  SELECT query_key, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term), stats GROUP BY ALL
),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(score, 9) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM bm),
lex AS (SELECT * FROM bmr WHERE rank <= 5 AND score > 0)"""


def _projected(source: str, keys: str, prefix: str, where: str) -> str:
    words = rf"string_split('{prefix} ' || lower(trim(regexp_replace({source}, '\s+', ' ', 'g'))), ' ')"
    return f"""SELECT {keys}, CAST(h % 768 AS INTEGER) AS idx, sum((CAST((h // 65536) % 1000 AS INTEGER) / 500.0 - 1) / (1 + 0.1 * i)) AS v
  FROM (SELECT {keys}, i, ('0x' || md5(word))::UHUGEINT AS h FROM (SELECT {keys}, unnest({words}) AS word, unnest(range(len({words}))) AS i FROM {where})) GROUP BY ALL"""


_FILLED = r"trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''"
DENSE_SQL = f"""dv AS ({_projected("text", "doc_id", "passage:", f"documents WHERE {_FILLED}")}),
qv AS ({_projected("query", "query_key", "query:", "q")}),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS nd FROM dv GROUP BY doc_id), qn AS (SELECT query_key, sqrt(sum(v * v)) AS nq FROM qv GROUP BY query_key),
cs AS (SELECT query_key, doc_id, sum(qv.v / nq * dv.v) / any_value(nd) AS score FROM qv JOIN dv USING (idx) JOIN dn USING (doc_id) JOIN qn USING (query_key) GROUP BY ALL),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(score, 9) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM cs) WHERE rank <= 5)"""
RRF_SQL = f"""{BM25_SQL}, {DENSE_SQL},
both_lists AS (SELECT query_key, doc_id, score AS s, NULL AS l, rank FROM sem UNION ALL SELECT query_key, doc_id, NULL, score, rank FROM lex),
fz AS (SELECT query_key, doc_id, sum(1.0 / (60 + rank)) AS fused, max(s) AS semantic_score, max(l) AS lexical_score FROM both_lists GROUP BY ALL),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(fused, 12) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fz) WHERE rank <= 5)"""


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries, and their semantic, lexical and fused lists; the first two are kept, as several plans read them."""
    queries, docs = benchmark_queries(spark, sf_dir), documents(spark, sf_dir)
    semantic, lex = keep(dense.sparse_topk(queries, docs, KEYS), "semantic"), keep(lexical.bm25_topk(queries, docs, KEYS), "lexical")
    return queries, semantic, lex, fusion.rrf_topk({"semantic": semantic, "lexical": lex}, KEYS)


@query(f"WITH {BM25_SQL} SELECT query_key, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(lexical.bm25_topk(benchmark_queries(spark, sf_dir), documents(spark, sf_dir), KEYS), "score")


@query(f"WITH {BM25_SQL} SELECT query_key, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lex")
def bm25_fullscan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(lexical.bm25_scan_topk(benchmark_queries(spark, sf_dir), documents(spark, sf_dir), KEYS), "score")


@query(f"""WITH {QUERIES_SQL}, t AS (SELECT lang, doc_id, {tokens_sql("coalesce(text, '')")} AS w FROM documents),
tok AS (SELECT lang, doc_id, len(w) AS dl, unnest(w) AS term FROM t), post AS (SELECT lang, doc_id, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM post GROUP BY ALL), stats AS (SELECT lang, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY lang),
langs AS (SELECT DISTINCT lang FROM documents), qt AS (SELECT DISTINCT lang, query_key, unnest({tokens_sql("query")}) AS term FROM q, langs),
bm AS (SELECT query_key, lang, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN post USING (lang, term) JOIN df USING (lang, term) JOIN stats USING (lang) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(score, 9) DESC, lang, CAST(doc_id AS VARCHAR)) AS rank FROM bm)
SELECT query_key, lang, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def bm25_lang_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language is a corpus of its own; the lists of a query are ranked together."""
    docs = documents(spark, sf_dir)
    queries = benchmark_queries(spark, sf_dir).crossJoin(F.broadcast(docs.select("lang").distinct()))
    return _round(lexical.bm25_topk(queries, docs, KEYS, group=["lang"]), "score")


@query(f"""WITH {BM25_SQL} SELECT query_key, count(DISTINCT term) AS terms, count(tf) AS postings, count(DISTINCT doc_id) AS candidates FROM qt LEFT JOIN post USING (term) GROUP BY query_key""")
def bm25_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_profile(benchmark_queries(spark, sf_dir), documents(spark, sf_dir), KEYS)


@query(f"WITH {BM25_SQL} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 50")
def term_df_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 terms in most documents."""
    index = lexical.postings(documents(spark, sf_dir), KEYS)
    return lexical.document_frequencies(index).orderBy(F.desc("df"), "term").limit(50)


@query(f"WITH {BM25_SQL} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(lexical.corpus_stats(documents(spark, sf_dir)), "avgdl")


@query(f"WITH {QUERIES_SQL}, {DENSE_SQL} SELECT doc_id, idx, round(v + 1e-9, 6) + 0.0 AS v FROM dv")
def proj_embedding_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.projection(documents(spark, sf_dir), KEYS, "text", dense.PASSAGE).select("doc_id", "idx", (F.round(F.col("v") + 1e-9, 6) + 0.0).alias("v"))


@query(f"WITH {QUERIES_SQL}, {DENSE_SQL} SELECT query_key, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sem")
def proj_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(dense.sparse_topk(benchmark_queries(spark, sf_dir), documents(spark, sf_dir), KEYS), "score")


@query(f"WITH {RRF_SQL} SELECT query_key, doc_id, round(fused, 9) AS fused, round(semantic_score, 6) AS semantic_score, round(lexical_score, 6) AS lexical_score, CAST(rank AS INTEGER) AS rank FROM hyb")
def rrf_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cosine and BM25 lists fused by reciprocal rank."""
    fused = lists(spark, sf_dir)[3]
    return fused.select("query_key", "doc_id", F.round("fused", 9).alias("fused"), F.round("semantic_score", 6).alias("semantic_score"), F.round("lexical_score", 6).alias("lexical_score"), "rank")


@query(f"WITH {RRF_SQL} SELECT query_key, round(max(fused) FILTER (rank = 1) - max(fused) FILTER (rank = 2), 9) AS margin FROM hyb GROUP BY query_key")
def rrf_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.margin(lists(spark, sf_dir)[3]), "margin", digits=9)


@query(f"WITH {RRF_SQL} SELECT query_key, doc_id, round(semantic_score, 6) AS score FROM hyb WHERE semantic_score IS NOT NULL")
def evidence_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.evidence_only(lists(spark, sf_dir)[3]).select("query_key", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {RRF_SQL}, a AS (SELECT query_key, list(doc_id) AS x FROM sem GROUP BY 1), b AS (SELECT query_key, list(doc_id) AS y FROM lex GROUP BY 1)
SELECT query_key, round(len(list_intersect(x, y)) / least(5, len(x), len(y)), 6) AS overlap FROM a JOIN b USING (query_key)""")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, semantic, lex, _ = lists(spark, sf_dir)
    a, b = fusion.as_lists(semantic, F.col("doc_id"), "a"), fusion.as_lists(lex, F.col("doc_id"), "b")
    return a.join(b, "query_key").select("query_key", F.round(fusion.overlap_ratio(F.col("a"), F.col("b"), 5), 6).alias("overlap"))


@query(f"WITH {BM25_SQL} SELECT count(DISTINCT query_key) AS queries, count(DISTINCT query_key) AS same_first, count(DISTINCT query_key) AS same_list, 1.0::DOUBLE AS mean_overlap FROM lex")
def ranking_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index and the full scan must agree in all lists."""
    queries, docs = benchmark_queries(spark, sf_dir), documents(spark, sf_dir)
    a, b = lexical.bm25_topk(queries, docs, KEYS), lexical.bm25_scan_topk(queries, docs, KEYS)
    return fusion.equivalence(a, b, KEYS).select("queries", "same_first", "same_list", "mean_overlap")


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the whole text of a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_key"), "text")
    return lexical.containing(items, documents(spark, sf_dir), "query_key", "doc_id").withColumnRenamed("doc_id", "expected")


EXPECTED_SQL = "ex AS (SELECT DISTINCT item_id AS query_key, doc_id AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE trim(b.text) <> '')"


@query("SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE trim(b.text) <> ''")
def containing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the whole text of a benchmark item, by the rarest word within it."""
    return lexical.containing(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir), "item_id", "doc_id")


@query(f"""WITH {RRF_SQL}, {EXPECTED_SQL}, best AS (SELECT query_key, min(rank) AS best FROM hyb JOIN ex ON hyb.query_key = ex.query_key AND doc_id = expected GROUP BY ALL),
qs AS (SELECT DISTINCT query_key FROM ex)
SELECT count(*) AS queries, round(avg(CASE WHEN best = 1 THEN 1.0 ELSE 0 END), 6) AS top1_rate, round(avg(CASE WHEN best IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS topk_rate FROM qs LEFT JOIN best USING (query_key)""".replace("SELECT query_key, min(rank)", "SELECT hyb.query_key AS query_key, min(rank)"))
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.hit_rates(lists(spark, sf_dir)[3], _expected(spark, sf_dir), "doc_id"), "top1_rate", "topk_rate")


@query(f"WITH {RRF_SQL}, {EXPECTED_SQL} SELECT ex.query_key AS query_key, CAST(min(rank) AS INTEGER) AS rank FROM ex LEFT JOIN hyb ON hyb.query_key = ex.query_key AND doc_id = expected GROUP BY ALL")
def rank_of_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rank_of(lists(spark, sf_dir)[3], _expected(spark, sf_dir), "doc_id")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every point is searched for by those whose id 20 divides."""
    points = table(spark, sf_dir, "embeddings")
    return points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_key"), "embedding"), points


COSINE_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM e),
c AS (SELECT a.vec_id AS query_key, b.vec_id AS vec_id, b.label AS label, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] / a.nv) * (p[2] / b.nv))) AS score FROM n a, n b WHERE a.vec_id % 20 = 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(score, 9) DESC, CAST(vec_id AS VARCHAR)) AS rank FROM c) WHERE rank <= 5)"""


@query(f"WITH {COSINE_SQL} SELECT query_key, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def emb_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(dense.cosine_topk(*_vectors(spark, sf_dir), ["vec_id"]), "score")


@query("""WITH e AS (SELECT vec_id, label, vec_id % 2 AS half, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM e),
c AS (SELECT a.vec_id AS query_key, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] / a.nv) * (p[2] / b.nv))) AS score FROM n a, n b WHERE a.vec_id % 20 = 0 AND b.half = 0 AND b.label % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(score, 9) DESC, CAST(vec_id AS VARCHAR)) AS rank FROM c) SELECT query_key, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def emb_cosine_lang_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among points of one target language: here the even ids are English, and even labels agree in the other code."""
    queries, points = _vectors(spark, sf_dir)
    told = points.withColumn("language", F.when(F.col("vec_id") % 2 == 0, "en").otherwise("hi")).withColumn("target_lang", F.when(F.col("label") % 2 == 0, "eng_Latn").otherwise("hin_Deva"))
    return _round(dense.cosine_topk(queries, dense.of_language(told, "eng_Latn"), ["vec_id"]), "score")


@query(f"""WITH {BM25_SQL.replace("FROM documents)", "FROM documents WHERE lang = 'en' AND trim(text) <> '')")} SELECT query_key, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lex""")
def bm25_en_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of one target language, without blank texts."""
    docs = ingest.corpus_of(documents(spark, sf_dir).withColumn("language", F.col("lang")).withColumn("target_lang", F.when(F.col("lang") == "en", "eng_Latn")), "eng_Latn")
    return _round(lexical.bm25_topk(benchmark_queries(spark, sf_dir), docs, KEYS), "score")


@query(f"WITH {COSINE_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY round(score, 9) DESC, CAST(vec_id AS VARCHAR)) AS r FROM c WHERE score >= 0.2) SELECT query_key, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM f WHERE r <= 5")
def emb_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(dense.cosine_topk(*_vectors(spark, sf_dir), ["vec_id"], threshold=0.2), "score")


@query(f"""WITH {COSINE_SQL}, g AS (SELECT query_key, CAST(label AS VARCHAR) AS dominant, count(*) AS count, max(rank) AS r FROM top GROUP BY ALL),
w AS (SELECT *, sum(count) OVER (PARTITION BY query_key) AS n, row_number() OVER (PARTITION BY query_key ORDER BY count DESC, r, dominant) AS i FROM g)
SELECT query_key, dominant, count, round(count / n, 6) AS ratio FROM w WHERE i = 1""")
def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, points = _vectors(spark, sf_dir)
    found = dense.cosine_topk(queries, points, ["vec_id"]).join(points.select("vec_id", "label"), "vec_id")
    return _round(evaluate.dominant(found, "label"), "ratio")


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _, _, fused = lists(spark, sf_dir)
    evidence = fusion.evidence_only(fused)
    found = answers.with_evidence(queries.withColumn("language", F.lit("en")), evidence, documents(spark, sf_dir), KEYS)
    # Few rows, each with much to compute: dealt by number, so that they aren't put together again for being small.
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_key")


def _answer_sentences_sql(text: str) -> str:
    """Sentences for answers, word by word: abbreviations and single letters keep their period, decimals too."""
    edge = "[\"''“”‘’()\\[\\]{}<>,;:!?]+"
    bare = f"lower(regexp_replace(regexp_replace(w, '^{edge}', ''), '{edge}$', ''))"
    kept = ", ".join(f"'{a}'" for a in (*TITLES, *ABBREVIATIONS))
    decimals = "regexp_replace(regexp_replace(w, '([0-9])\\.([0-9])', '\\1' || chr(3) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(3) || '\\2', 'g')"
    by_period = f"CASE WHEN {bare} IN ({kept}) OR regexp_matches({bare}, '^[a-z]\\.$') OR regexp_matches({bare}, '^([a-z]\\.){{2,}}$') THEN w ELSE replace(replace({decimals}, '.', '.' || chr(2)), chr(3), '.') END"
    words = rf"string_split(trim(regexp_replace({text}, '\s+', ' ', 'g')), ' ')"
    marked = f"array_to_string(list_transform({words}, lambda w: regexp_replace({by_period}, '([।?!])', '\\1' || chr(2), 'g')), ' ')"
    return f"list_filter(list_transform(string_split({marked}, chr(2)), lambda x: trim(x)), lambda x: x <> '')"


def _terms_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_]+|[\\x{{0900}}-\\x{{0963}}\\x{{0966}}-\\x{{097F}}]+'), lambda x: lower(x)))"


_ANSWER_STOPS = "['" + "', '".join(ANSWER_STOP_TERMS) + "']"
_HIT = "len(list_filter(qt, lambda a: len(list_filter(own, lambda b: b = a OR (length(a) >= 3 AND (starts_with(b, a) OR starts_with(a, b))))) > 0))"
_CAND = "STRUCT(direct INTEGER, relevance DOUBLE, chunk BIGINT, place BIGINT, sentence VARCHAR, score DOUBLE, own VARCHAR[])[]"
COMPOSE_SQL = f"""{RRF_SQL}, evi AS (SELECT query_key, semantic_score AS score, text, row_number() OVER (PARTITION BY query_key ORDER BY rank) - 1 AS chunk FROM hyb JOIN documents USING (doc_id) WHERE semantic_score IS NOT NULL),
snt AS (SELECT query_key, score, chunk, x[j + 1] AS sentence, j AS place FROM (SELECT *, unnest(range(len(x))) AS j FROM (SELECT *, {_answer_sentences_sql("text")} AS x FROM evi WHERE score >= 0.001))),
qq AS (SELECT query_key, query, list_filter({_terms_sql("query")}, lambda x: NOT list_contains({_ANSWER_STOPS}, x)) AS qt, list_distinct(regexp_extract_all(query, '[0-9]+(?:\\.[0-9]+)?')) AS qn, len(list_filter(['how far', 'how many', 'how much', 'how old'], lambda m: contains(lower(query), m))) > 0 AS numeric_q FROM q),
sc AS (SELECT *, {_HIT} AS hit FROM (SELECT *, {_terms_sql("sentence")} AS own, list_distinct(regexp_extract_all(sentence, '[0-9]+(?:\\.[0-9]+)?')) AS sn FROM snt JOIN qq USING (query_key))),
cd AS (SELECT query_key, chunk, place, {{'direct': CASE WHEN len(qt) >= 2 AND (hit = len(qt) OR (numeric_q AND len(sn) > 0 AND hit >= 2)) THEN 0 ELSE 1 END,
  'relevance': -(0.5 * score + 1.5 * hit / len(qt) + 0.1 * len(list_intersect(qn, sn)) + 0.01 / (chunk + 1)), 'chunk': chunk, 'place': place, 'sentence': sentence, 'score': score, 'own': own}} AS c FROM sc WHERE hit >= 1),
al AS (SELECT query_key, list([c] ORDER BY chunk, place) AS cs FROM cd GROUP BY 1),
ac AS (SELECT query_key, list_sort(list_reduce(cs, lambda a, b: CASE WHEN len(list_filter(a, lambda o: lower(o.sentence) = lower(b[1].sentence) OR (len(b[1].own) > 0 AND len(list_intersect(o.own, b[1].own)) / len(list_distinct(list_concat(o.own, b[1].own))) >= 0.85))) > 0 THEN a ELSE list_concat(a, b) END, CAST([] AS {_CAND}))) AS cs FROM al),
us AS (SELECT query_key, list_reduce(list_transform(cs, lambda x: {{'sel': [x], 'chars': 0, 'over': false}}), lambda s, b: CASE WHEN NOT s.over AND s.chars + CASE WHEN len(s.sel) > 0 THEN 1 ELSE 0 END + length(b.sel[1].sentence) <= 600
  THEN {{'sel': list_concat(s.sel, b.sel), 'chars': s.chars + CASE WHEN len(s.sel) > 0 THEN 1 ELSE 0 END + length(b.sel[1].sentence), 'over': b.sel[1].direct = 0 OR len(s.sel) + 1 >= 3}} ELSE s END, {{'sel': CAST([] AS {_CAND}), 'chars': 0, 'over': false}}).sel AS used FROM ac),
ans AS (SELECT query_key, query, CASE WHEN coalesce(len(used), 0) = 0 THEN '{NO_ANSWER}' ELSE array_to_string(list_transform(used, lambda x: x.sentence), ' ') END AS answer,
  round(CASE WHEN len(used) > 0 THEN list_sum(list_transform(used, lambda x: x.score)) / len(used) END, 6) AS confidence, coalesce(len(used), 0) = 0 AS is_no_answer, CAST(coalesce(len(used), 0) AS INTEGER) AS sentences FROM qq LEFT JOIN us USING (query_key))"""


@query(f"WITH {COMPOSE_SQL} SELECT query_key, query, answer, confidence, is_no_answer, sentences, answer AS formatted_answer, 'unchanged' AS format_kind FROM ans")
def compose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers of all benchmark queries."""
    done = answers.format_answers(answers.compose(_composed(spark, sf_dir)))
    return done.select("query_key", "query", "answer", F.round("confidence", 6).alias("confidence"), "is_no_answer", F.size("used").alias("sentences"), "formatted_answer", "format_kind")


_BLOCK = "'[Evidence ' || (len(s.blocks) + 1) || ']' || chr(10) || 'query_id: ' || b.keys[1] || chr(10) || 'passage_index: 0' || chr(10) || 'chunk_index: 0' || chr(10) || 'text: ' || b.texts[1]"
_JOINED = "array_to_string(list_append(s.blocks, " + _BLOCK + "), chr(10) || chr(10))"
CONTEXT_SQL = f"""{RRF_SQL}, el AS (SELECT query_key, list({{'k': CAST(doc_id AS VARCHAR), 't': trim(text)}} ORDER BY rank) AS l FROM hyb JOIN documents USING (doc_id) WHERE semantic_score IS NOT NULL GROUP BY 1),
cx AS (SELECT query_key, list_reduce(list_transform(l, lambda x: {{'blocks': [x.t], 'texts': [x.t], 'keys': [x.k], 'over': false}}), lambda s, b: CASE WHEN s.over OR b.texts[1] = '' OR list_contains(s.texts, b.texts[1]) OR list_contains(s.keys, b.keys[1]) THEN s
  WHEN ceil(length({_JOINED}) / 4.0) <= 2000 THEN {{'blocks': list_append(s.blocks, {_BLOCK}), 'texts': list_concat(s.texts, b.texts), 'keys': list_concat(s.keys, b.keys), 'over': false}}
  ELSE {{'blocks': s.blocks, 'texts': s.texts, 'keys': s.keys, 'over': true}} END, {{'blocks': CAST([] AS VARCHAR[]), 'texts': CAST([] AS VARCHAR[]), 'keys': CAST([] AS VARCHAR[]), 'over': false}}).blocks AS blocks FROM el),
ct AS (SELECT query_key, coalesce(len(blocks), 0) AS n, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS context FROM q LEFT JOIN cx USING (query_key))"""


@query(f"WITH {CONTEXT_SQL} SELECT query_key, CAST(n AS INTEGER) AS evidence_count, CAST(ceil(length(context) / 4.0) AS BIGINT) AS estimated_tokens, sha256(context) AS context_sha256 FROM ct")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.context(_composed(spark, sf_dir), 2000).select("query_key", "evidence_count", "estimated_tokens", F.sha2("context", 256).alias("context_sha256"))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k, regexp_extract(text, '[A-Za-z]{3,}') AS w, lang, n_chars AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL)
SELECT doc_id, CASE k WHEN 0 THEN 'quantity' WHEN 1 THEN 'date' WHEN 2 THEN 'location' WHEN 3 THEN 'distance' WHEN 5 THEN CASE WHEN contains(lower(lang || ' has lines.'), lower(w)) THEN 'quantity' END END AS kind,
  CASE k WHEN 0 THEN format('{} has {} lines.', w, n) WHEN 1 THEN format('{} happened in {}.', w, 1500 + n % 600) WHEN 2 THEN format('{} is in {}.', w, lang) WHEN 3 THEN format('{} is about {} miles ({} km) from {}.', w, n, 2 * n, lang)
  WHEN 5 THEN CASE WHEN contains(lower(lang || ' has lines.'), lower(w)) THEN format('{} has {} lines.', w, n) END END AS answer FROM d WHERE w <> ''""")
def format_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and a fact about each document's first word: a number, a year, a place, a distance, two distances that disagree, and a fact about something else."""
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null and n_chars is not null")
    d = docs.select("doc_id", (F.col("doc_id") % 6).alias("k"), F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("w"), "lang", F.col("n_chars").alias("n")).where("w <> ''")
    far = ("How far is %s from %s?", ("w", "lang"))
    pairs = [
        (("How many lines does %s have?", ("w",)), ("%s has %d lines.", ("w", "n"))), (("When did %s happen?", ("w",)), ("%s happened in %d.", ("w", F.col("n") % 600 + 1500))), (("Where is %s?", ("w",)), ("%s is located in %s.", ("w", "lang"))),
        (far, ("Distance from %s to %s is %d miles or %d km.", ("lang", "w", "n", F.col("n") * 2))), (far, ("Distance from %s to %s is %d miles or %d km, another route is 5 miles.", ("lang", "w", "n", F.col("n") * 2))),
        (("How many lines does %s have?", ("w",)), ("%s has %d lines.", ("lang", "n"))),
    ]
    said = [F.get(F.array(*(F.format_string(pair[side][0], *pair[side][1]) for pair in pairs)), F.col("k").cast("int")) for side in (0, 1)]
    f = answers.formatted_answer(F.col("q"), F.col("s"), F.lit("en"))
    return d.select("doc_id", said[0].alias("q"), said[1].alias("s")).select("doc_id", f["kind"].alias("kind"), f["answer"].alias("answer"))


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_key, query and its three lists as arrays, with the document's language as query id; texts are joined once."""
    queries, semantic, lex, fused = lists(spark, sf_dir)
    rows = [df.select("query_key", "doc_id", "rank", (F.col(score) if score else F.lit(None).cast("double")).alias("semantic_score"), F.lit(name).alias("list")) for name, df, score in (("semantic", semantic, "score"), ("lexical", lex, None), ("hybrid", fused, "semantic_score"))]
    found = reduce(DataFrame.unionByName, rows).join(documents(spark, sf_dir), "doc_id")
    row = F.struct("rank", F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("provenance"), "text", "semantic_score")
    own = found.groupBy("query_key").agg(*(F.array_sort(F.collect_list(F.when(F.col("list") == name, row))).alias(name) for name in ("semantic", "lexical", "hybrid")))
    out = queries.join(own, "query_key", "left")
    return out.withColumns({name: F.coalesce(name, F.expr(f"cast(array() as {maturity.LIST})")) for name in ("semantic", "lexical", "hybrid")})


def _dominant_sql(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT query_key, id, c, n FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY c DESC, r, id) AS i, sum(c) OVER (PARTITION BY query_key) AS n
  FROM (SELECT query_key, lang AS id, count(*) AS c, max(rank) AS r FROM {rows} JOIN documents USING (doc_id) GROUP BY ALL)) WHERE i = 1)"""


@query(f"""WITH {RRF_SQL}, {_dominant_sql("sd", "sem")}, {_dominant_sql("hd", "hyb")},
first AS (SELECT query_key, lang AS top_id, text AS top_text FROM hyb JOIN documents USING (doc_id) WHERE rank = 1),
lx AS (SELECT query_key, list(DISTINCT lang) AS ls FROM lex JOIN documents USING (doc_id) GROUP BY 1), sx AS (SELECT query_key, list(DISTINCT lang) AS ss FROM sem JOIN documents USING (doc_id) GROUP BY 1),
j AS (SELECT q.query_key AS query_key, top_id, sd.id AS s_id, sd.c AS s_c, sd.c / sd.n AS s_r, hd.id AS h_id, hd.c AS h_c, hd.c / hd.n AS h_r, coalesce(ls, []) AS ls, coalesce(ss, []) AS ss,
  len(list_intersect({tokens_sql("query")}, {tokens_sql("coalesce(top_text, '')")})) AS common FROM q LEFT JOIN first USING (query_key) LEFT JOIN sd USING (query_key) LEFT JOIN hd USING (query_key) LEFT JOIN lx USING (query_key) LEFT JOIN sx USING (query_key)),
p AS (SELECT *, CASE WHEN top_id IS NULL OR common < 1 THEN NULL WHEN s_c >= 3 AND s_r >= 0.6 AND list_contains(ls, s_id) AND top_id = s_id THEN 'semantic_concentration'
  WHEN h_c >= 3 AND h_r >= 0.6 AND list_contains(ss, h_id) AND list_contains(ls, h_id) THEN 'hybrid_concentration' END AS path FROM j)
SELECT query_key, path IS NOT NULL AS mature, path, s_id AS semantic_dominant_id, h_id AS hybrid_dominant_id FROM p""")
def maturity_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each query's retrieval would be trusted, with the language of documents as evidence family."""
    found = maturity.assess(ranked_lists(spark, sf_dir), partial="query")
    return found.select("query_key", "mature", "path", "semantic_dominant_id", "hybrid_dominant_id")


@query(f"SELECT doc_id, CAST(len({tokens_sql('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({tokens_sql('text')}, ' ')) AS tokens_md5 FROM documents WHERE text IS NOT NULL")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).where("text is not null").select("doc_id", tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))
