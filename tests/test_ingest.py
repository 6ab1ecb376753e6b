"""Passages, chunks, policies, audits and sinks."""

import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import audit, chunking, evaluate, ingest, policies
from quillon.sources import events, sinks, tables


def passages(spark, texts, labels, **options):
    rows = spark.createDataFrame([(7, texts, labels)], "query_id int, passages array<string>, is_selected array<int>")
    return [(r.passage_index, r.text, r.is_selected) for r in ingest.passages(rows, **options).orderBy("passage_index").collect()]


def test_passages(spark):
    assert passages(spark, ["first", "second", "third"], [1, 0, 1]) == [(0, "first", 1), (1, "second", 0), (2, "third", 1)]
    assert passages(spark, ["  नमस्ते\n\t दुनिया  "], [1]) == [(0, "नमस्ते दुनिया", 1)]
    assert passages(spark, ["one", " \t\n ", "three"], [1, 0, 1]) == [(0, "one", 1), (2, "three", 1)]
    assert passages(spark, ["one", "two"], [1]) == [] and passages(spark, None, None) == []
    with pytest.raises(Exception, match="same length"):
        passages(spark, ["one", "two"], [1], strict=True)


def test_english_view(spark):
    raw = spark.createDataFrame([("q", "Q", "1", "t", "hin_Deva", "hin_Deva", (["अ"], ["  selected English text  "], [1]))], tables.RAW_SCHEMA)
    got = ingest.passages(ingest.english_view(raw)).first()
    assert got.text == "selected English text" and got.target_lang == "eng_Latn"
    assert ingest.passages(ingest.translated_view(raw)).first().text == "अ"


def chunks(spark, text, size):
    rows = spark.createDataFrame([(text,)], "text string")
    return [(r.text, r.chunk_strategy, r.token_count) for r in chunking.chunk(rows, size).orderBy("chunk_index").collect()]


def test_chunks(spark):
    assert chunks(spark, "छोटा passage.", 256) == [("छोटा passage.", "whole_passage", 2)]
    assert [c[0] for c in chunks(spark, "one two. three four. five six.", 4)] == ["one two. three four.", "three four. five six."]
    assert [c[0] for c in chunks(spark, "one two three. four five six. seven eight nine.", 5)] == ["one two three.", "four five six.", "seven eight nine."]
    windows = chunks(spark, "one two three four five six seven", 3)
    assert len(windows) > 1 and all(s == "token_window_fallback" and n <= 3 for _, s, n in windows)
    assert chunks(spark, " \t\n ", 256) == []
    assert all(n <= 256 for _, _, n in chunks(spark, " ".join(f"word{i}" for i in range(600)), 256))


def fold(text, size):
    """Chunks by a plain loop."""
    import re

    words = text.split()
    if not words:
        return []
    if len(words) <= size:
        return [" ".join(words)]
    out, held = [], []
    for s in (x.strip() for x in re.findall(r"(?s).+?(?:[।.!?]+(?=\s|$)|$)", " ".join(words))):
        if not s:
            continue
        n = len(s.split())
        if n > size:
            if held:
                out.append(" ".join(held))
            held, at, w = [], 0, s.split()
            while True:
                out.append(" ".join(w[at : at + size]))
                if at + size >= len(w):
                    break
                at += size - min(32, size - 1)
        elif sum(len(x.split()) for x in held) + n <= size:
            held.append(s)
        else:
            out.append(" ".join(held))
            held = [held[-1], s] if len(held[-1].split()) + n <= size else [s]
    return out + ([" ".join(held)] if held else [])


def test_chunks_equal_a_plain_loop(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    for size in (7, 40):
        got = {r.doc_id: list(r.c) for r in rows.select("doc_id", F.transform(chunking.chunks_of(F.col("text"), size), lambda c: c["text"]).alias("c")).collect()}
        for r in rows.select("doc_id", "text").collect():
            assert got[r.doc_id] == fold(r.text, size)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c d.", "e!", "f g h", "।"]), max_size=12).map(" ".join), st.integers(1, 6))
def test_chunks_of_any_text(spark, text, size):
    assert [c[0] for c in chunks(spark, text, size)] == fold(text, size)


@pytest.mark.parametrize(("labels", "policy", "expected"), [("0101", "A", [1, 3]), ("000", "D", [0]), ("00100", "B", [2, 1]), ("00100", "C", [2, 1, 3]), ("00", "E", [0]), ("0100", "D", [1])])
def test_policies(spark, labels, policy, expected):
    rows = spark.createDataFrame([(42, i, int(x)) for i, x in enumerate(labels)], "query_id int, passage_index int, is_selected int")
    name = next(p for p in policies.POLICIES if p.startswith(f"POLICY_{policy}"))
    assert [r.passage_index for r in policies.choose(rows, name).orderBy("place").collect()] == expected


METRICS = [("POLICY_A_X", 0.7698, 0.5397, 0.7698, 58427, 161.7, 170.98, 189.56, 243.54), ("POLICY_D_X", 0.7143, 0.5, 0.7143, 103502, 269.5, 278.28, 297.4, 357.6), ("POLICY_E_X", 0.6746, 0.4365, 0.7302, 158537, 439.08, 445.6, 463.89, 513.56)]
SCHEMA = "policy string, expected_evidence_in_top_k_rate double, top1_expected_evidence_rate double, correct_evidence_family_rate double, chunk_count long, p50 double, p70 double, p95 double, p100 double"


def test_recommendation(spark):
    recommend = lambda rows: policies.recommend(spark.createDataFrame(rows, SCHEMA)).first()[0]
    assert recommend(METRICS) == "POLICY_A_RECOMMENDED"
    assert recommend([(*METRICS[0][:1], 0.1, *METRICS[0][2:]), *METRICS[1:]]) == policies.UNRESOLVED
    assert policies.interpretation(policies.recommend(spark.createDataFrame(METRICS, SCHEMA))).first().zero_selected_coverage_caveat
    assert policies.marginal_quality(spark.createDataFrame(METRICS, SCHEMA)).count() == 3


def test_audit(spark):
    e, a = spark.createDataFrame([(1,), (2,), (3,)], "i int"), spark.createDataFrame([(2,), (3,), (4,), (4,)], "i int")
    got = audit.reconcile(e, a, "i").first()
    assert tuple(got) == (3, 3, 2, 1, 1)
    assert [r.i for r in audit.missing(e, a, "i").collect()] == [1]
    rows = spark.createDataFrame([("x", 1, "t"), ("x", 2, "t"), ("x", 3, "u"), ("y", 4, "t")], "id string, n int, t string")
    found = audit.collisions(rows, "id", "n", ["t"]).orderBy("n").collect()
    assert [(r.n, r.first_t, r.identical) for r in found] == [(2, "t", True), (3, "t", False)]
    assert tuple(audit.collision_report(rows, "id", "t").first()) == (2, 1, 2, 0, 1)
    status = audit.final_status(spark.createDataFrame([(5, 5, 0, 0, 0, 768, "RETRIEVAL_MISS"), (5, 4, 1, 0, 0, 768, "RETRIEVAL_MISS"), (5, 5, 0, 0, 0, None, "RETRIEVAL_MISS"), (5, 5, 0, 0, 0, 768, "INDEXING_BUG")], "expected int, actual int, missing int, unexpected int, payload_errors int, vector_size int, failed_class string")).collect()
    assert [r.status for r in status] == ["INDEX_SAFE_FOR_BENCHMARKING", *["INDEX_REQUIRES_FIX"] * 3] and status[1].unexplained == 1


def test_failed_query_class(spark):
    p, s = ["a", "b"], [1, 0]
    rows = [
        (False, "q", "q", p, s, [0, 1], "INDEXING_BUG"), (True, "q", "q", None, s, [0], "AMBIGUOUS_GROUND_TRUTH"), (True, "q", "q", p, [1], [0], "AMBIGUOUS_GROUND_TRUTH"), (True, " ", "other", p, s, [], "AMBIGUOUS_GROUND_TRUTH"), (True, "q", "other", p, s, [], "SMOKE_TEST_EXPECTATION_BUG"),
        (True, " q ", "q", p, s, None, "INDEXING_BUG"), (True, "q", "q", p, s, [1], "INDEXING_BUG"), (True, "q", "q", [" ", "b"], s, [1], "RETRIEVAL_MISS"), (True, "q", "q", p, s, [0], "RETRIEVAL_MISS"),
    ]
    got = audit.failed_query_class(spark.createDataFrame([r[:6] for r in rows], "found boolean, query string, asked string, passages array<string>, is_selected array<int>, indexed array<int>")).collect()
    assert [r["class"] for r in got] == [r[6] for r in rows]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=40), st.sampled_from([1, 50, 75, 95, 100]))
def test_nearest_rank(spark, values, p):
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    assert evaluate.nearest_rank(rows, "v", [p]).first().value == sorted(values)[max(1, math.ceil(p / 100 * len(values))) - 1]


def test_evenly_spaced(spark):
    rows = spark.range(101)
    got = sorted(r.place for r in evaluate.evenly_spaced(rows, "id", 5).collect())
    assert got == [0, 25, 50, 75, 100]


def test_upsert_table(spark, tmp_path):
    path = str(tmp_path / "points")
    row = "point_id string, text string, language string, seq int"
    assert sinks.upsert_table(spark, path, spark.createDataFrame([("a", "old", "hi", 1), ("a", "new", "hi", 2), ("b", "x", "en", 1)], row), "point_id", "seq") == 2
    assert sinks.upsert_table(spark, path, spark.createDataFrame([("a", "newer", "hi", 3), ("c", "y", "hi", 1)], row), "point_id", "seq") == 2
    assert {r.point_id: r.text for r in spark.read.parquet(path).collect()} == {"a": "newer", "b": "x", "c": "y"}


def test_collection_checks_vectors(spark, tmp_path):
    points = spark.createDataFrame([("a", [1.0, 2.0], "en"), ("b", [1.0], "en")], "point_id string, vector array<double>, language string")
    with pytest.raises(ValueError, match="1 vectors of another size"):
        sinks.create_collection(points, str(tmp_path / "c"), 2)
    sinks.create_collection(points.limit(1), str(tmp_path / "c"), 2)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.create_collection(points.limit(1), str(tmp_path / "c"), 2)


def test_events(spark):
    raw = ['{"event":"vad.speech_start"}', '{"type":"transcript","data":{"transcript":" hi ","is_final":true,"request_id":"r1"}}', '{"text":"par"}', "not json", '{"event":"session.end"}', '{"event":"error"}', "{}"]
    got = [r.e and (r.e.kind, r.e.transcript, r.e.request_id) for r in spark.createDataFrame([(x,) for x in raw], "v string").select(events.parse_event(F.col("v")).alias("e")).collect()]
    assert got == [("speech_start", None, None), ("final", "hi", "r1"), ("partial", "par", None), ("error", "invalid realtime event", None), ("session_end", None, None), ("error", "realtime error", None), None]


def test_latency_artefact(spark, tmp_path):
    pending = events.latency_artefact(spark, None).first()
    assert pending.p50_ms is None and pending.sample_count is None and pending.benchmark_environment == "pending"
    (tmp_path / "a.json").write_text('{"p50_ms": 9, "p70_ms": 2,\n"p100_ms": null, "sample_count": 5, "benchmark_scope": "local", "benchmark_environment": "x"}')
    got = events.latency_artefact(spark, str(tmp_path / "a.json")).first()
    assert (got.p50_ms, got.p70_ms, got.p100_ms, got.sample_count, got.benchmark_scope) == (9.0, 2.0, None, 5, "local")
    (tmp_path / "b.json").write_text('{"p50": 5, "p70": 2, "p100": 3, "sample_count": 5, "scope": "local"}')
    with pytest.raises(ValueError, match="missing fields: p50_ms"):
        events.latency_artefact(spark, str(tmp_path / "b.json"))


def test_upsert_moves_ids_between_partitions(spark, tmp_path):
    path = str(tmp_path / "points")
    row = "point_id string, text string, language string, seq int"
    write = lambda *rows: sinks.upsert_table(spark, path, spark.createDataFrame(rows, row), "point_id", "seq")
    read = lambda: sorted(((r.point_id, r.text, r.language) for r in spark.read.schema(row).parquet(path).collect()), key=repr)
    assert write(("a", "1", None, 1)) == 1 and read() == [("a", "1", None)]
    write(("b", "1", "hi", 1), ("c", "1", None, 1))
    write(("a", "2", "en", 2))
    assert read() == [("a", "2", "en"), ("b", "1", "hi"), ("c", "1", None)]
    write(("b", "2", None, 2), ("c", "2", None, 2))
    assert read() == [("a", "2", "en"), ("b", "2", None), ("c", "2", None)] and not (tmp_path / "points.next").exists() and not (tmp_path / "points/language=hi").exists()


def test_upsert_that_ended_early_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "points")
    row = "point_id string, text string, language string, seq int"
    frame = lambda *rows: spark.createDataFrame(rows, row)
    sinks.upsert_table(spark, path, frame(("a", "1", "hi", 1)), "point_id", "seq")
    finish = sinks._finish_upsert
    calls = []
    monkeypatch.setattr(sinks, "_finish_upsert", lambda *x: calls.append(x) or (finish(*x) if len(calls) == 1 else None))
    sinks.upsert_table(spark, path, frame(("a", "2", "en", 2)), "point_id", "seq")
    assert [r.text for r in spark.read.parquet(path).collect()] == ["1"]
    monkeypatch.setattr(sinks, "_finish_upsert", finish)
    sinks.upsert_table(spark, path, frame(("b", "1", "en", 1)), "point_id", "seq")
    assert sorted((r.point_id, r.text, r.language) for r in spark.read.parquet(path).collect()) == [("a", "2", "en"), ("b", "1", "en")]


def test_copy_in_steps(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("s", "t", "c"))
    spark.range(10).selectExpr("id as seq", "id * 2 as x").write.parquet(source)
    copy = lambda **more: sinks.copy_points(spark, source, target, checkpoint, **more)
    assert copy(dry_run=True) == 10 and not (tmp_path / "t").exists()
    assert copy(most=4) == 4 and copy(most=4) == 4 and copy() == 2 and copy() == 0
    assert sorted(r.seq for r in spark.read.parquet(target).collect()) == list(range(10))
    with pytest.raises(ValueError, match="another copy"):
        sinks.copy_points(spark, source, str(tmp_path / "other"), checkpoint)


def test_strict_lookup_targets_and_gates(spark, tmp_path):
    points = spark.createDataFrame([(1, [1.0, 2.0], "en")], "point_id int, vector array<double>, language string")
    with pytest.raises(Exception, match="no such point: 2"):
        sinks.lookup(points, spark.createDataFrame([(1,), (2,)], "point_id int"), "point_id", strict=True).collect()
    sinks.check_target(points, 2)
    for bad, size in ((points, 3), (points.withColumn("more", points.vector), 2), (points.drop("vector"), 2)):
        with pytest.raises(ValueError):
            sinks.check_target(bad, size)
    assert policies.gated_union(points, points, 100, 1.0).count() == 2
    with pytest.raises(ValueError, match="GiB"):
        policies.gated_union(points, points, 1 << 30, 1.0)
    sinks.json_report(points.drop("vector"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().language == "en"
    with pytest.raises(ValueError, match="1 missing"):
        policies.preflight(policies.classify_missing(points.select("point_id"), points.select("point_id").limit(0), ["point_id"]))


def test_english_policy_a(spark):
    raw = spark.createDataFrame([("q", "e", "1", "t", "s", "h", (["x", "y"], ["A b", " ", ], [1, 1]))], tables.RAW_SCHEMA)
    assert [(r.query_id, r.text, r.target_lang) for r in policies.english_policy_a(raw).collect()] == [("1", "A b", "eng_Latn")]


def test_another_tokenizer(spark):
    rows = spark.createDataFrame([(1, "Ab cd. Ef gh. Ij.")], "i int, text string")
    assert [r.text for r in chunking.chunk(rows, 4).orderBy("chunk_index").collect()] == ["Ab cd. Ef gh.", "Ef gh. Ij."]
    assert [(r.text, r.token_count) for r in chunking.chunk(rows, 6, count=F.length).orderBy("chunk_index").collect()] == [("Ab cd.", 6), ("Ef gh.", 6), ("Ij.", 3)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=40))
def test_interpolated_quantiles(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.k: r.q for r in evaluate.inclusive_quantiles(rows, "v", 4).collect()}
    assert [got[k] for k in (1, 2, 3)] == pytest.approx(statistics.quantiles(values, n=4, method="inclusive"), abs=1e-6, rel=1e-9)


def test_catalog(spark, data):
    catalog = tables.Catalog(data, {("hi", "validation"): "documents.parquet"})
    assert catalog.read(spark, "HI", columns=["doc_id"]).columns == ["doc_id"] and catalog.row_count(spark, "hi", "validation") == 200
    with pytest.raises(ValueError):
        catalog.path("fr", "validation")
    assert tables.schema_report(catalog.read(spark)).count() == 5
