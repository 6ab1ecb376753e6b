"""The pipeline's stages on a small set of documents."""

import random
import re
from collections import Counter

import pytest
from test_dedup_and_join import brute_components, brute_exact

import corpus_pipeline
from quillon.llm import mixing, packing, quality
from quillon.llm.queries import ORACLE_SQL, QUERIES

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, _id string, _Score long, `text.x` int"


def documents(spark, seed=3):
    """Nulls, empty, very long, repeated and near texts, null sources and ids, and clashing names."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    base = [word() for _ in range(60)]
    texts = [None, "", " ", "one", "one", " ".join(base), " ".join([*base[:-1], "x"]), " ".join(base[:30]), " ".join(word() for _ in range(30_000)), "\n" * 70_000 + "a"]
    texts += [" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(40)]
    rows = [(k, t, "en", r.choice(["a", "b", None]), len(t or ""), 1, 2, "q", 3, 4) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, " ".join(base), "en", "a", 1, 1, 2, "q", 3, 4)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_exact_stage_equals_brute_force(spark):
    rows, docs = documents(spark)
    with_ids = [r for r in rows if r[0] is not None]
    out = STAGES["exact_dedup"](spark, docs, None)
    kept = Counter(x.doc_id for x in out.collect())
    expected = {i for i, keep_id, _, kept_, _ in brute_exact([(r[0], r[1]) for r in with_ids]) if kept_}
    assert out.columns == docs.columns and set(kept) == expected and set(kept.values()) == {1}


def test_near_stage_equals_brute_force(spark):
    rows, docs = documents(spark)
    unique = {r[0]: r for r in rows if r[0] is not None}
    frame = spark.createDataFrame(list(unique.values()), SCHEMA)
    out = STAGES["near_dedup"](spark, frame, None)
    expected = {c for _, _, c in brute_components([(k, r[1]) for k, r in unique.items()])}
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == expected and len(expected) < len(unique)


def test_mix_stage_takes_what_the_mix_says(spark):
    rows, docs = documents(spark)
    unique = list({r[0]: r for r in rows if r[0] is not None}.values())
    frame = spark.createDataFrame(unique, SCHEMA)
    taken = {x.doc_id: x.taken for x in mixing.mix(frame).collect()}
    out = STAGES["mix"](spark, frame, None)
    words = Counter()
    for x in out.collect():
        words[x.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", x.text))
        assert x.n_chars == len(x.text)
    assert out.columns == docs.columns and dict(words) == {k: n for k, n in taken.items() if n}
    # Targets by their definition: a level for each unit of weight, at which sources that are full stop.
    sizes = Counter()
    for r in unique:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in order) < 1.5 * sum(sizes.values()) else (low, level)
    by_source = Counter()
    for r in unique:
        by_source[r[3]] += taken[r[0]]
    for s in order:
        assert abs(by_source[s] - min(2 * sizes[s], low * weight[s])) <= 64


def test_pack_stage_holds_every_token_once(spark):
    rows, docs = documents(spark)
    encode = packing.encoder(packing.default_tokenizer())
    out = STAGES["pack"](spark, docs, None).collect()
    assert sum(x.length for x in out) == sum(len(encode(r[1] or "")) + 1 for r in rows)
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for held in by.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(n for _, n in held) <= 1024


def test_quality_stage_keeps_what_scores_well(spark, tmp_path):
    rows, docs = documents(spark)
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") % 2), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = STAGES["quality"](spark, docs, str(tmp_path))
    model = quality.fit_labelled(docs, labels)
    good = Counter(x.text for x in quality.score(docs, model).where("score >= 0.7").collect())
    assert out.columns == docs.columns and Counter(x.text for x in out.collect()) == good


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_of_nothing(spark, tmp_path, name):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert STAGES[name](spark, docs, str(tmp_path)).collect() == []


def test_run_on_odd_documents(spark, tmp_path):
    """The whole pipeline over texts of long white space, nulls, copies and null ids, all of which score well."""
    rows, docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({x.doc_id for x in out}) > 30 and all(0 < x.length <= 1024 for x in out)


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, data)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now < left and len(now) > 0.7 * len(left), name
        left = now
    assert docs.select("text").distinct().count() == docs.count()


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 100


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
