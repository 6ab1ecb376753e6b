"""Text functions and identifiers on literal cases."""

import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from quillon.functions import ids, text, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


def test_tokenize(spark):
    assert one(spark, "लैंकेस्टर,  कितनी दूर?", text.tokenize("t")) == ["लैंकेस्टर", "कितनी", "दूर"]
    assert one(spark, "Straße – $5!", text.tokenize("t")) == ["strasse", "5"]
    assert one(spark, None, text.tokenize("t")) == []


def test_fold_case_is_full_folding(spark):
    """Every character by itself, and some in words: ligatures, a final sigma, a capital sharp s, a letter that becomes two."""
    every = [chr(k) for k in (*range(1, 0xD800), *range(0xE000, 0x1E944))]
    assigned = [c for c in every if unicodedata.category(c)[0] in "LMNPSZ"]
    texts = ["ﬁnal ﬂow", "ΟΔΟΣ ὈΔΟΣ", "STRAẞE Straße", "ŉ µm ſ İ ǰ", "plain", "", *("a".join(assigned[k : k + 500]) for k in range(0, len(assigned), 500))]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.fold_case("t").alias("f")).collect()
    assert {r.k: r.f for r in got} == {k: t.casefold() for k, t in enumerate(texts)}
    assert one(spark, None, text.fold_case("t")) is None


def test_tokenize_is_casefold_without_punctuation(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").limit(100).select("text", text.tokenize("text").alias("got")).collect()
    for r in rows:
        plain = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in r.text.casefold())
        assert r.got == plain.split()


def test_answer_sentences(spark):
    assert one(spark, "Dr. J. R. Smith lives in the U.S. He travels to the U.K. often.", text.answer_sentences("t")) == ["Dr. J. R. Smith lives in the U.S.", "He travels to the U.K. often."]
    assert one(spark, "Pi लगभग 3.14 है। दूरी 1.5 और गति 79.9 km है।", text.answer_sentences("t")) == ["Pi लगभग 3.14 है।", "दूरी 1.5 और गति 79.9 km है।"]
    assert one(spark, "See e.g. this. Ok? Yes!", text.answer_sentences("t")) == ["See e.g. this.", "Ok?", "Yes!"]
    assert one(spark, "  ", text.answer_sentences("t")) == []


def test_terms_numbers_and_questions(spark):
    assert one(spark, "Größe of the_A 12", text.answer_terms("t")) == ["gr", "e", "of", "the_a", "12"]
    assert one(spark, "३.५ km, 12", text.numbers("t")) == ["३.५", "12"]
    assert one(spark, "How  MANY moons?", text.is_numeric_question("t"))
    assert not one(spark, "What moons?", text.is_numeric_question("t"))


def test_small_functions(spark):
    assert one(spark, "Um, hello uh  there hmm", text.without_fillers("t")) == ", hello there"
    assert one(spark, "x" * 81, text.preview("t")) == "x" * 80 + "…"
    assert one(spark, "api_key= abc, Token:xyz", text.redact("t")) == "api_key= [REDACTED], Token:[REDACTED]"
    assert one(spark, " Audio/WebM; codecs=opus", text.media_type("t")) == "audio/webm"
    assert one(spark, "नमस्ते abc", text.devanagari_language("t")) == "hi"
    assert one(spark, "12345", text.estimated_tokens("t")) == 2
    assert one(spark, "POLICY_A_SELECTED_ONLY", text.policy_prefix("t")) == "POLICY_A"
    assert one(spark, "Moons of Mars", text.all_tokens_in("t", F.lit("mars moons")))


@pytest.mark.parametrize("name", ["a", "query_id=7|passage_index=2", "हिंदी"])
def test_uuid5(spark, name):
    assert one(spark, name, ids.uuid5(F.col("t"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_point_ids(spark):
    c = [F.lit(7), F.lit(2), F.lit(0)]
    assert one(spark, "", ids.legacy_point_id(*c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, "msmarco-xi-hindi:7:2:0"))
    a, b = (one(spark, "", ids.strategy_point_id(*c, F.lit(s))) for s in ("whole_passage", "sentence_overlap"))
    assert a != b and re.match(ids.UUID_PATTERN, a)
    hi, en = (one(spark, "", ids.bilingual_point_id(F.lit(x), *c, F.lit("whole_passage"))) for x in ("hi", "en"))
    assert hi != en
    with pytest.raises(Exception, match="unsupported language"):
        one(spark, "", ids.bilingual_point_id(F.lit("fr"), *c, F.lit("whole_passage")))


def test_projection_of_words(spark):
    import hashlib

    for word in ("query:", "a", "größe", "दूरी"):
        h = int(hashlib.md5(word.encode()).hexdigest(), 16)
        assert one(spark, word, vectors.bucket(F.col("t"))) == h % 768
        assert one(spark, word, vectors.bucket_value(F.col("t"))) == ((h >> 16) % 1000) / 500.0 - 1.0


def test_folding_tries_no_list_of_characters_for_each_character(spark):
    from quillon.functions import text

    df = spark.createDataFrame([("ΣΊΣΥΦΟΣ ﬁn ŉ",), ("यह है ß",)], "t string")
    plan = df.select(text.fold_case("t").alias("f"))
    assert "RLIKE" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [r.f for r in plan.collect()] == ["σίσυφοσ fin ʼn", "यह है ss"]
