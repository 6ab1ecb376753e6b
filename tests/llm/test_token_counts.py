"""Token counts from distinct pre-tokens against the library's own encoding."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing, token_counts

PATH = token_counts.default_tokenizer()
LIBRARY, CUTTER = Tokenizer.from_file(PATH), token_counts.PreTokens(PATH)
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "'s", "'", "LL", "don't", "'D", "we'Ve", "a1b2", "$5.00", "<b>x</b>", "_a_", "\x7f", "\x01", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u0085", " ", " ", "　", "é", "́", "İ", "ΑΣ", "ß", "ﬁ", "१२", "हिन्दी", "漢字", "😀", "a", "B", "9", "-", ".", "x" * 70]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def counted(text, cutter=CUTTER):
    ends, names, token, n = cutter.frequencies(pa.array(["x y", text, "", "z"]))
    return sum(int(n[k]) * cutter.pieces(names[token[k]].as_py()) for k in range(ends[1], ends[2]))


@settings(deadline=None, max_examples=600)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=40), st.text(st.characters(min_codepoint=0x21, max_codepoint=0x250), max_size=12)))
def test_frequencies_times_pieces_are_the_librarys_tokens(text):
    assert counted(text) == library(text)


def test_long_texts():
    for text in ("a" * 200_000, "漢" * 50_000, "ab, " * 60_000, "<|endoftext|>" * 9_000, " x" * 50_000):
        assert counted(text) == library(text)


def test_tokenizer_that_keeps_white_space_is_given_whole_texts():
    path = packing.default_tokenizer()
    cutter, own = token_counts.PreTokens(path), Tokenizer.from_file(path)
    assert CUTTER.by_word and not cutter.by_word
    for text in ("a b  c\n\nd", " lead", "<|endoftext|> x"):
        assert counted(text, cutter) == len(own.encode(text, add_special_tokens=False).ids)


ROWS = [(1, None), (2, ""), (None, "null id"), (3, "twice the same"), (3, "twice the same"), (3, "other text of the id"), (4, "word " * 5000), (5, "a<|endoftext|>b"), (6, "É" * 100_000), *((10 + k, f"common words and {k} of its own") for k in range(300))]


@pytest.mark.parametrize("hot", [None, 1])
def test_rows(spark, monkeypatch, hot):
    if hot:  # every pre-token in more than one row is broadcast
        monkeypatch.setattr(token_counts, "HOT_ROWS", 1)
    docs = spark.createDataFrame([(t, i, "x", 7) for i, t in ROWS], "text string, doc_id long, row string, n_tokens int").repartition(3)
    got = token_counts.count_tokens(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), library(t or "")) for i, t in ROWS]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()))) == sorted(map(repr, want))
    assert {r.over_limit == (r.n_tokens > 2048) for r in got.collect()} == {True}


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = token_counts.op13_token_counts(spark, data).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {(i, len(t.encode()), library(t), library(t) > 2048) for i, t in texts.items()} and len(got) == len(texts)
