"""BM25, fusion, maturity and answers on small corpora."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import answers, dense, evaluate, fusion, ingest, lexical, maturity

CORPUS = [
    ("hi-1", "फिलाडेल्फिया लैंकेस्टर दूरी यात्रा"), ("hi-2", "लैंकेस्टर फिलाडेल्फिया मार्ग दूरी"), ("hi-3", "दिल्ली भारत की राजधानी"),
    ("en-1", "Philadelphia Lancaster travel distance"), ("en-2", "Lancaster Philadelphia route distance"), ("en-3", "Delhi is the capital of India"),
]
ASKED = ["फिलाडेल्फिया लैंकेस्टर", "लैंकेस्टर दूरी", "दिल्ली राजधानी", "Philadelphia Lancaster", "Lancaster distance distance", "capital India", "अनुपस्थित"]


def brute(query, k1=1.5, b=0.75):
    docs = {d: t.casefold().split() for d, t in CORPUS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for d, words in docs.items():
        tf, s = Counter(words), 0.0
        for t in set(query.casefold().split()):
            df = sum(t in w for w in docs.values())
            if tf[t]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(words) / avg))
        if s > 0:
            out[d] = s
    return [d for d, s in sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))][:5], out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_key int, query string"), spark.createDataFrame(CORPUS, "doc_id string, text string")


def test_bm25_equals_brute_force_and_full_scan(tables):
    queries, docs = tables
    fast = {(r.query_key, r.rank): (r.doc_id, r.score) for r in lexical.bm25_topk(queries, docs, ["doc_id"]).collect()}
    slow = {(r.query_key, r.rank): (r.doc_id, r.score) for r in lexical.rank(lexical.bm25_by_scan(queries, docs, ["doc_id"]), 5, ["doc_id"]).collect()}
    assert fast.keys() == slow.keys() and all(fast[k][0] == slow[k][0] and abs(fast[k][1] - slow[k][1]) < 1e-12 for k in fast)
    for n, q in enumerate(ASKED):
        order, scores = brute(q)
        assert [fast[n, i + 1][0] for i in range(len(order))] == order
        assert all(abs(fast[n, i + 1][1] - scores[d]) < 1e-12 for i, d in enumerate(order))


def test_bm25_parameters_are_checked(tables):
    with pytest.raises(ValueError):
        lexical.bm25(*tables, ["doc_id"], k1=0)
    with pytest.raises(ValueError):
        lexical.rank(tables[0], 0, [])


def test_bm25_memory_does_not_grow_with_the_queries(spark):
    """500 queries that ask for the same 40 terms, which 512 documents have: 10 million pairs, which as whole arrays would take some 400 MB."""
    words = [f"w{i:02d}" for i in range(40)]
    sent = lexical._Batch(spark.createDataFrame([(q, " ".join(words)) for q in range(500)], "query_key int, query string"), [])

    class Held:
        schema = spark.createDataFrame([], "doc_id int, dl int, _g int, terms array<int>, tfs array<int>").schema

        def mapInArrow(self, run, _):
            return run

    run = sent.scores(Held(), ["doc_id"], 5, np.full(40, 100.0), np.array([1000.0]), np.array([40.0]), 1.5, 0.75)
    tf = np.arange(512 * 40).reshape(512, 40) % 7 + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(512), pa.int32()), pa.array([40] * 512, pa.int32()), pa.array([0] * 512, pa.int32()), pa.array([list(range(40))] * 512, pa.list_(pa.int32())), pa.array(tf.tolist(), pa.list_(pa.int32()))], Held.schema.names)
    assert len(sent.shared.value[3]) == 500  # read before memory is measured
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = (math.log(1 + 900.5 / 100.5) * 2.5 * tf / (tf + 1.5)).sum(axis=1)
    best = sorted(range(512), key=lambda d: (-round(score[d], 9), str(d)))[:5]
    by_query = {q: [r for r in found if r["query_key"] == q] for q in range(500)}
    assert all([r["doc_id"] for r in rows] == best and np.allclose([r["score"] for r in rows], score[best], atol=1e-9, rtol=0) for rows in by_query.values())
    assert peak < 120e6


def test_bm25_without_queries(tables):
    assert lexical.bm25_topk(tables[0].limit(0), tables[1], ["doc_id"]).count() == 0


def test_bm25_profile(tables):
    got = {r.query_key: (r.terms, r.postings, r.candidates) for r in lexical.bm25_profile(*tables, ["doc_id"]).collect()}
    assert got[3] == (2, 4, 2) and got[6] == (1, 0, 0)


def test_rrf_prefers_the_shared_document(spark):
    s = spark.createDataFrame([(0, "doc2", 0.9, 1), (0, "doc1", 0.8, 2)], "query_key int, doc string, score double, rank int")
    x = spark.createDataFrame([(0, "doc3", 4.0, 1), (0, "doc1", 3.0, 2)], "query_key int, doc string, score double, rank int")
    got = fusion.rrf_topk({"semantic": s, "lexical": x}, ["doc"]).orderBy("rank").collect()
    assert [r.doc for r in got] == ["doc1", "doc2", "doc3"]
    assert got[0].fused == pytest.approx(2 / 62) and got[0].semantic_score == 0.8 and got[2].semantic_score is None
    assert fusion.margin(fusion.rrf_topk({"semantic": s, "lexical": x}, ["doc"])).first().margin == pytest.approx(2 / 62 - 1 / 61)
    with pytest.raises(ValueError):
        fusion.rrf_scores({"semantic": s}, ["doc"], k=0)


def test_cosine_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, [math.sin(i * (k + 1)) for k in range(8)]) for i in range(60)]
    points = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    queries = points.where("vec_id < 12").select(F.col("vec_id").alias("query_key"), "embedding")
    whole = sorted(map(tuple, dense.cosine_topk(queries, points, ["vec_id"]).select("query_key", "vec_id", "rank").collect()))
    monkeypatch.setattr(dense, "BATCH", 5)
    assert sorted(map(tuple, dense.cosine_topk(queries, points, ["vec_id"]).select("query_key", "vec_id", "rank").collect())) == whole


def test_cosine_of_odd_vectors_against_brute_force(spark, monkeypatch):
    """Null, empty and zero vectors, and such with nulls or without finite values, take no part; others meet those of their size."""
    monkeypatch.setattr(dense, "ROWS", 7)
    good = [(i, [math.sin(i * (k + 1)) for k in range(3 if i % 4 == 0 else 5)]) for i in range(1, 80)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(9)]
    odd = [(200, None), (201, []), (202, [0.0] * 5), (203, [1.0, None, 1.0]), (204, [float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0])]
    points = spark.createDataFrame(good + odd, "vec_id int, embedding array<double>").repartition(3)
    queries = points.where("vec_id % 5 = 0 or vec_id > 200").select(F.col("vec_id").alias("query_key"), "embedding")

    def brute(threshold):
        out = []
        for q, a in good:
            scored = [(-round(sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b), 9), str(i), i) for i, b in good if len(a) == len(b)] if q % 5 == 0 else []
            out += [(q, i, r + 1) for r, (s, _, i) in enumerate(sorted(x for x in scored if -x[0] >= threshold)[:5])]
        return sorted(out)

    for threshold in (None, 0.3):
        got = dense.cosine_topk(queries, points, ["vec_id"], threshold=threshold).select("query_key", "vec_id", "rank")
        assert sorted(map(tuple, got.collect())) == brute(-2 if threshold is None else threshold)
    assert dense.cosine_topk(queries.limit(0), points, ["vec_id"]).collect() == dense.cosine_topk(queries, points.limit(0), ["vec_id"]).collect() == []


def compose(spark, query, evidence, **options):
    rows = spark.createDataFrame([(0, query, "en", [(i + 1, s, t, "232017", str(i), "0") for i, (s, t) in enumerate(evidence)])], "query_key int, query string, language string, evidence array<struct<rank:int,score:double,text:string,query_id:string,passage_index:string,chunk_index:string>>")
    return answers.format_answers(answers.compose(rows, **options)).first()


def test_compose_takes_the_direct_answer_alone(spark):
    got = compose(spark, "How far is Philadelphia from Lancaster?", [(0.84, "Distance from Philadelphia, PA to Lancaster, PA is 80 Miles or 129 Km."), (0.95, "Lancaster population and family history are widely discussed.")])
    assert got.answer == "Distance from Philadelphia, PA to Lancaster, PA is 80 Miles or 129 Km." and len(got.used) == 1 and got.confidence == 0.84
    assert got.formatted_answer == "Philadelphia is about 80 miles (129 km) from Lancaster." and got.format_kind == "distance"


def test_compose_numeric_beats_score(spark):
    got = compose(spark, "How far is Philadelphia from Lancaster?", [(0.99, "Philadelphia has a large population."), (0.7, "Distance from Philadelphia to Lancaster is 80 miles.")], max_sentences=1)
    assert got.answer == "Distance from Philadelphia to Lancaster is 80 miles."


def test_compose_drops_copies_and_gives_no_answer(spark):
    assert compose(spark, "दूरी", [(0.5, "दूरी बीस किलोमीटर है। दूरी बीस किलोमीटर है।")]).answer == "दूरी बीस किलोमीटर है।"
    none = compose(spark, "मंगल ग्रह पर सबसे पहले कौन गया था?", [(0.77, "Unrelated words here."), (0.76, "Other things.")])
    assert none.is_no_answer and none.confidence is None and none.used == []


def test_compose_respects_the_budget(spark):
    got = compose(spark, "alpha beta", [(0.9, "alpha " + "x" * 100 + "."), (0.8, "alpha y.")], max_chars=20)
    assert got.answer == "alpha y."


@pytest.mark.parametrize(
    ("query", "source", "language", "answer"),
    [
        ("How far is Lancaster from Philadelphia?", "Distance from Philadelphia, PA to Lancaster, PA is 80 Miles or 129 Km.", "en", "Lancaster is about 80 miles (129 km) from Philadelphia."),
        ("फिलाडेल्फिया लैंकेस्टर से कितनी दूर है?", "फिलाडेल्फिया, पी.ए. से लैंकेस्टर, पी.ए. तक की दूरी 80 मील या 129 किमी है।", "hi", "फिलाडेल्फिया लैंकेस्टर से लगभग 80 मील (129 किमी) दूर है।"),
        ("How many moons does Mars have?", "Mars has 2 moons.", "en", "Mars has 2 moons."),
        ("When did Apollo 11 landing happen?", "Apollo 11 landing happened in 1969.", "en", "Apollo 11 landing happened in 1969."),
        ("Where is Paris?", "Paris is located in France.", "en", "Paris is in France."),
        ("पेरिस कहाँ है?", "पेरिस फ्रांस में स्थित है।", "hi", "पेरिस फ्रांस में स्थित है।"),
        ("How far is Philadelphia from Lancaster?", "Distance is 80 miles or 129 km, while another route is 100 miles.", "en", None),
    ],
)
def test_formats(spark, query, source, language, answer):
    row = spark.createDataFrame([(query, source, language)], "q string, s string, l string").select(answers.formatted_answer(F.col("q"), F.col("s"), F.col("l")).alias("f")).first().f
    assert (row and row.answer) == answer


def test_context_stops_at_the_budget(spark):
    rows = spark.createDataFrame([(0, "q", [(1, 0.9, "one", "1", "0", "0"), (2, 0.8, "one", "2", "0", "0"), (3, 0.7, "other", "1", "0", "0"), (4, 0.6, "three", "3", "0", "0")])], "query_key int, query string, evidence array<struct<rank:int,score:double,text:string,query_id:string,passage_index:string,chunk_index:string>>")
    got = answers.context(rows, 1000).first()
    assert got.evidence_count == 2 and "[Evidence 2]\nquery_id: 3" in got.context
    block = len("[Evidence 1]\nquery_id: 1\npassage_index: 0\nchunk_index: 0\ntext: one")
    assert answers.context(rows, -(-block // 4)).first().evidence_count == 1


def test_dominant_breaks_ties_by_last_rank(spark):
    rows = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "b", 3), (0, "a", 4), (0, "c", 5)], "query_key int, k string, rank int")
    got = evaluate.dominant(rows, "k").first()
    assert (got.dominant, got["count"], got.ratio) == ("b", 2, 0.4)


def lists(spark, partial, semantic, lexical_, hybrid):
    row = lambda rows: [(i + 1, q, f"{q}/{p}", t, s) for i, (q, p, t, s) in enumerate(rows)]
    df = spark.createDataFrame([(partial, row(semantic), row(lexical_), row(hybrid))], f"partial string, semantic {maturity.LIST}, lexical {maturity.LIST}, hybrid {maturity.LIST}")
    return maturity.assess(df).first()


EVIDENCE = "लैंकेस्टर से फिलाडेल्फिया बहुत दूर नहीं है"


def test_maturity_paths(spark):
    five = [("232017", i, EVIDENCE, 0.8) for i in range(5)]
    mixed = [("1", 0, "x", 0.1), ("232017", 0, EVIDENCE, None), ("3", 0, "z", 0.1)]
    got = lists(spark, "विला डेल सिया लैंकेस्टर से कितनी दूर", five, mixed, five)
    assert got.mature and got.path == "semantic_concentration" and got.overlap_terms == ["दूर", "लैंकेस्टर"]
    spread = [("232017", 0, EVIDENCE, 0.8), ("2", 0, "b", 0.7), ("3", 0, "c", 0.6)]
    hybrid = [("232017", 0, EVIDENCE, 0.8), ("232017", 1, EVIDENCE, 0.8), ("232017", 2, EVIDENCE, 0.8), ("4", 0, "d", 0.1), ("5", 0, "e", 0.1)]
    assert lists(spark, "विला लैंकेस्टर से कितनी दूर", spread, spread, hybrid).path == "hybrid_concentration"
    assert not lists(spark, "विला लैंक", spread, spread, spread).mature
    assert lists(spark, "कुछ", [], [], []).reason == "no_evidence"


def test_material_change(spark):
    def changed(a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(maturity.material_change(F.col("a"), F.col("b"))).first()[0]

    assert not changed("x y", "x y") and not changed("x y", "x y z") and changed("p q r", "x y z") and not changed("x y z w", "x y z")


def test_equivalence_and_overlap(spark):
    a = spark.createDataFrame([(0, "a", 1.0, 1), (0, "b", 0.5, 2)], "query_key int, d string, score double, rank int")
    b = spark.createDataFrame([(0, "a", 1.0, 1), (0, "c", 0.4, 2)], "query_key int, d string, score double, rank int")
    got = fusion.equivalence(a, b, ["d"]).first()
    assert (got.queries, got.same_first, got.same_list, got.mean_overlap, got.max_difference) == (1, 1, 0, 0.5, 0.0)
    assert a.select(fusion.overlap_ratio(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)), 5)).first()[0] == 1.0


def test_saved_index_gives_the_same(tables, tmp_path):
    queries, docs = tables
    lexical.save_index(docs, str(tmp_path), ["doc_id"])
    got, direct = ({(r.query_key, r.rank): (r.doc_id, round(r.score, 9)) for r in df.collect()} for df in (lexical.search_index(queries, str(tmp_path), ["doc_id"]), lexical.bm25_topk(queries, docs, ["doc_id"])))
    assert got == direct


def test_encode_makes_unit_vectors(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "a  b c")], "i int, text string")
    got = dense.encode(rows, "text", lambda: lambda texts: [[len(t), 1.0] for t in texts], batch=1).orderBy("i").collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in got) and got[0].embedding[0] == pytest.approx(11 / math.sqrt(122))
    with pytest.raises(Exception, match="blank"):
        dense.encode(spark.createDataFrame([(" ",)], "text string"), "text", lambda: lambda texts: [[1.0] for _ in texts]).collect()


def test_fusion_carries_the_first_lists_text(spark):
    a = spark.createDataFrame([(0, "x", "semantic text", 1.0, 1)], "query_key int, d string, text string, score double, rank int")
    b = spark.createDataFrame([(0, "x", "lexical text", 1.0, 1), (0, "y", "other", 0.5, 2)], "query_key int, d string, text string, score double, rank int")
    got = {r.d: r.text for r in fusion.rrf_scores({"semantic": a, "lexical": b}, ["d"], carry=("text",)).collect()}
    assert got == {"x": "semantic text", "y": "other"}


def test_fast_and_joined_scores_agree(tables, monkeypatch):
    """Scores within tasks and scores by joins, which more queries than BATCH need, are the same; so are lists with and without adaptive plans."""
    queries, docs = tables
    fast = [f(queries, docs, ["doc_id"]) for f in (lexical.bm25_topk, dense.sparse_topk)]
    signatures = [sorted(map(tuple, fusion.signature(df, ["doc_id"]).collect())) for df in fast]
    monkeypatch.setattr(lexical, "BATCH", 0)
    monkeypatch.setattr(dense, "BATCH", 0)
    joined = [f(queries, docs, ["doc_id"]) for f in (lexical.bm25_topk, dense.sparse_topk)]
    assert [sorted(map(tuple, fusion.signature(df, ["doc_id"]).collect())) for df in joined] == signatures
    spark = docs.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(map(tuple, fusion.signature(f(queries, docs, ["doc_id"]), ["doc_id"]).collect())) for f in (lexical.bm25_topk, dense.sparse_topk)] == signatures
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_are_not_shuffled(tables):
    """One scan, of what is kept of each document, and one exchange, of each task's best."""
    queries, docs = tables
    for df in (lexical.bm25_topk(queries, docs, ["doc_id"]), dense.sparse_topk(queries, docs, ["doc_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "WindowGroupLimit" in plan


def test_language_filter(spark):
    rows = spark.createDataFrame([(1, "en", "eng_Latn", "a"), (2, "hi", "hin_Deva", "b"), (3, "en", "hin_Deva", "c"), (4, "en", "eng_Latn", "  ")], "i int, language string, target_lang string, text string")
    assert sorted(r.i for r in dense.of_language(rows, "eng_Latn").collect()) == [1, 4] and dense.of_language(rows, None).count() == 4
    assert [r.i for r in ingest.corpus_of(rows, "eng_Latn").collect()] == [1]
    with pytest.raises(ValueError, match="unknown target language"):
        dense.of_language(rows, "fra_Latn")
    with pytest.raises(ValueError):
        ingest.corpus_of(rows, " ")


def test_containing_texts(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "wo th"), (3, " "), (4, "none of these"), (5, "two  three")], "k int, text string")
    docs = spark.createDataFrame([(10, "zone two threes"), (11, "one two three"), (12, None), (13, "two  three"), (14, "wo th")], "d int, text string")
    got = sorted(map(tuple, lexical.containing(items, docs, "k", "d").collect()))
    assert got == [(1, 10), (1, 11), (2, 10), (2, 11), (2, 14), (5, 13)]


def test_zero_projection_is_the_first_unit_vector(monkeypatch):
    monkeypatch.setattr(dense, "_hashed", lambda word: (7, 0.0))
    sums, used = dense.Projector("q:").vector("a b")
    assert sums[0] == 1.0 and sums.sum() == 1.0 and used.tolist() == [0]


def test_scan_profile_and_groups_move_no_scores(spark, tables):
    queries, docs = tables
    slow = {(r.query_key, r.rank): (r.doc_id, round(r.score, 9)) for r in lexical.bm25_topk(queries, docs, ["doc_id"]).collect()}
    assert {(r.query_key, r.rank): (r.doc_id, round(r.score, 9)) for r in lexical.bm25_scan_topk(queries, docs, ["doc_id"]).collect()} == slow
    told = docs.withColumn("lang", F.when(F.col("doc_id") > "doc2", "b").otherwise("a"))
    both = queries.crossJoin(told.select("lang").distinct())
    rows = lambda df: sorted((r.query_key, r.rank, r.lang, r.doc_id, round(r.score, 9)) for r in df.collect())
    found = lexical.bm25_topk(both, told, ["doc_id"], group=["lang"])
    assert rows(found) == rows(lexical.rank(lexical.bm25(both, told, ["doc_id"], group=["lang"]), 5, ["lang", "doc_id"]))
    assert "Aggregate" not in found._jdf.queryExecution().sparkPlan().toString()  # scores are summed in the tasks


def test_saved_index_has_a_row_a_document(tables, tmp_path, spark):
    queries, docs = tables
    lexical.save_index(docs, str(tmp_path), ["doc_id"])
    assert spark.read.parquet(f"{tmp_path}/postings").count() == docs.count()
    assert "Exchange hashpartitioning(doc_id" not in lexical.search_index(queries, str(tmp_path), ["doc_id"])._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_queries_are_multiplied_and_not_joined(spark, monkeypatch):
    monkeypatch.setattr(dense, "BATCH", 5)
    points = spark.createDataFrame([(i, [math.cos(i * (k + 1)) for k in range(8)]) for i in range(40)], "vec_id int, embedding array<double>")
    found = dense.cosine_topk(points.select(F.col("vec_id").alias("query_key"), "embedding"), points, ["vec_id"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 1 and found.count() == 200


def test_projections_of_many_texts_are_one_matrix(monkeypatch):
    monkeypatch.setattr(dense, "HELD_WORDS", 9)
    texts = ["a b a", "", "c", "a " * 20, "हिन्दी b", "b"] * 3
    sums, used = dense.Projector("q:").matrix(texts)
    for n, text in enumerate(texts):
        own, buckets = np.zeros(768), set()
        for place, word in enumerate(["q:", *text.split(" ")]):
            bucket, value = dense._hashed(word)
            own[bucket] += value / (1.0 + dense.DECAY * place)
            buckets.add(bucket)
        assert (sums[n] == own).all() and set(np.flatnonzero(used[n]).tolist()) == buckets
    none, _ = dense.Projector("q:").matrix([])
    assert none.shape == (0, 768)
