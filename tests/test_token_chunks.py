"""Chunks as slices: the same as by columns for words, and by their rules for another vocabulary."""

import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import byte_bpe
from quillon.functions.text import normalize_space
from quillon.operators import chunking, token_chunks

BPE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["one", " two", ". ", "!? ", "\n", " ", "। ", "हिन्दी", "漢字漢字", "😀😀", "a" * 30, ".5", "é", " ", "word " * 12]


def test_words_equal_the_column_expressions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id", "lang", normalize_space("text").alias("text")).repartition(4)
    for most in (7, 64):
        columns = ("doc_id", "lang", "chunk_index", "text", "chunk_strategy", "token_count")
        by_columns = {tuple(r) for r in chunking.chunk(docs, most).select(*columns).collect()}
        assert {tuple(r) for r in token_chunks.chunk(docs, "words", most).select(*columns).collect()} == by_columns


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.integers(1, 12), st.sampled_from(["words", BPE]))
def test_slices(text, most, tokenizer):
    starts, ends, _ = token_chunks.tokenizer_of(tokenizer)(text)
    found = token_chunks.slices(text, starts, ends, most)
    covered = {i for a, b, _ in found for i in range(a, b)}
    assert covered >= {i for i, c in enumerate(text) if not c.isspace()}
    for a, b, strategy in found:
        assert text[a:b].strip() == text[a:b] or strategy == "token_window_fallback"
        held = [e for e in ends if a < e <= b]
        assert len(held) <= most or len(set(held)) == 1  # but for one character of many tokens
        assert strategy != "whole_passage" or len(found) == 1
    if strategies := {s for *_, s in found}:
        assert strategies == {"whole_passage"} or sum(found[0][0] < e <= found[-1][1] for e in ends) > most


def test_rows_and_schema(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, " \n ", "k"), (4, "one two. three", "k"), (4, "one two. three", "k"), (5, "w " * 30_000, "k")], "id long, body string, start string").withColumnRenamed("start", "own")
    got = token_chunks.chunk(docs, "words", 2, "body")
    assert got.columns == ["id", "own", "chunk_index", "start", "end", "body", "chunk_strategy", "token_count"]
    rows = got.where("id < 5").collect()
    assert sorted((r.id, r.start, r.end, r.body, r.token_count) for r in rows) == sorted([(4, 0, 8, "one two.", 2), (4, 9, 14, "three", 1)] * 2)
    assert got.where("id = 5").count() == 29_999
    ids = token_chunks.chunk(docs.where("id = 4").limit(1), BPE, 100, "body").first()
    from tokenizers import Tokenizer

    assert ids.ids == Tokenizer.from_file(BPE).encode("one two. three", add_special_tokens=False).ids and ids.token_count == len(ids.ids)
    for bad in ({"max_tokens": 0}, {"text_col": "none"}):
        with pytest.raises(ValueError):
            token_chunks.chunk(docs, **{"text_col": "body", **bad})
    assert token_chunks.chunk(docs.limit(0), text_col="body").count() == 0


def test_subword_query_by_brute_force(spark, data):
    from quillon.plans.catalogue import QUERIES

    encode, want = token_chunks.tokenizer_of(BPE), set()
    for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id", "text").collect():
        starts, ends, _ = encode(r.text)
        want |= {(r.doc_id, k, a, b, s, sum(a < e <= b for e in ends)) for k, (a, b, s) in enumerate(token_chunks.slices(r.text, starts, ends, 256))}
    got = QUERIES["chunks_subword"](spark, data)
    assert {tuple(r)[:6] for r in got.collect()} == want and got.agg(F.max("token_count")).first()[0] <= 256


def _library(path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)

    def tokens(text):
        found = model.encode(text, add_special_tokens=False)
        return [a for a, _ in found.offsets], [b for _, b in found.offsets], found.ids

    return tokens


EXACT, ASKED = _library(BPE), []
FAST = byte_bpe.encoder(BPE, lambda text: ASKED.append(text) or EXACT(text))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.sampled_from([*PARTS, "<|endoftext|>", "\u3000", "'s", "\x00"]), st.text(st.characters(exclude_categories=["Cs"]), max_size=4)), max_size=14).map("".join))
def test_fast_tokens_equal_the_library(text):
    ASKED.clear()
    assert FAST(text) == EXACT(text) and bool(ASKED) == ("<|endoftext|>" in text)


def test_what_is_left_to_the_library(tmp_path):
    text = "a" + " " * byte_bpe.LONG_SPACE + "b"
    ASKED.clear()
    assert FAST(text) == EXACT(text) and ASKED == [text]
    with open(BPE, encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(file), encoding="utf-8")
    assert byte_bpe.encoder(str(tmp_path / "other.json"), EXACT) is None
    assert token_chunks.tokenizer_of(str(tmp_path / "other.json"))("one")[2] == EXACT(" one")[2]
