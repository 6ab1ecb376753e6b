"""Token-bounded chunks of passages, as column expressions.

Sentences are packed up to ``max_tokens`` words with the last sentence repeated in the next chunk
if it fits; an overlong sentence becomes overlapping windows of words. The packing is a fold over
the array of sentences inside one row, so no rows move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import chunk_sentences, normalize_space

#: Words that a window repeats from the one before, at most.
WINDOW_OVERLAP = 32

#: How a chunk came about.
STRATEGIES = ("whole_passage", "sentence_overlap", "token_window_fallback")

_CHUNK = "struct<text:string,strategy:string>"


def _words(text: Column) -> Column:
    return F.size(F.split(text, " "))


def token_windows(sentence: Column, max_tokens: int) -> Column:
    """Windows of ``max_tokens`` words; each starts ``min(WINDOW_OVERLAP, max_tokens - 1)`` words before the last one's end."""
    words = F.split(sentence, " ")
    step = max_tokens - min(WINDOW_OVERLAP, max_tokens - 1)
    count = F.greatest(F.lit(1), F.ceil((F.size(words) - max_tokens) / F.lit(float(step))) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(max_tokens)), " "))


def packed_sentences(sentences: Column, max_tokens: int, count: Callable[[Column], Column] = _words) -> Column:
    """Chunks of an array of sentences."""
    start = F.struct(F.array().cast(f"array<{_CHUNK}>").alias("done"), F.array().cast("array<string>").alias("open"))

    def flush(state: Column) -> Column:
        whole = F.struct(F.array_join(state["open"], " ").alias("text"), F.lit("sentence_overlap").alias("strategy"))
        return F.when(F.size(state["open"]) > 0, F.array_append(state["done"], whole)).otherwise(state["done"])

    def step(state: Column, sentence: Column) -> Column:
        n = count(sentence)
        held = F.aggregate(state["open"], F.lit(0), lambda a, s: a + count(s).cast("int"))
        last = F.element_at(state["open"], -1)
        windows = F.transform(token_windows(sentence, max_tokens), lambda w: F.struct(w.alias("text"), F.lit("token_window_fallback").alias("strategy")))
        nothing = F.array().cast("array<string>")
        repeat = F.when(count(last) + n <= max_tokens, F.array(last, sentence)).otherwise(F.array(sentence))
        return (
            F.when(n > max_tokens, F.struct(F.concat(flush(state), windows).alias("done"), nothing.alias("open")))
            .when(F.size(state["open"]) == 0, F.struct(state["done"].alias("done"), F.array(sentence).alias("open")))
            .when(held + n <= max_tokens, F.struct(state["done"].alias("done"), F.array_append(state["open"], sentence).alias("open")))
            .otherwise(F.struct(flush(state).alias("done"), repeat.alias("open")))
        )

    return F.aggregate(sentences, start, step, flush)


def chunks_of(text: Column, max_tokens: int = 256, count: Callable[[Column], Column] = _words) -> Column:
    """Array of (text, strategy): the whole passage if it is short enough, else packed sentences.

    ``count`` gives the tokens of a text, by words unless another tokenizer is asked for; windows of
    overlong sentences are cut by words.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    spaced = normalize_space(text)
    whole = F.array(F.struct(spaced.alias("text"), F.lit("whole_passage").alias("strategy")))
    return (
        F.when(F.coalesce(spaced, F.lit("")) == "", F.array().cast(f"array<{_CHUNK}>"))
        .when(count(spaced) <= max_tokens, whole)
        .otherwise(packed_sentences(chunk_sentences(spaced), max_tokens, count))
    )


def chunk(documents: DataFrame, max_tokens: int = 256, text_col: str = "text", count: Callable[[Column], Column] = _words) -> DataFrame:
    """One row a chunk: the document's columns with the chunk's text, chunk_index, chunk_strategy, token_count."""
    rest = [c for c in documents.columns if c != text_col]
    rows = documents.select(*rest, F.posexplode(chunks_of(F.col(text_col), max_tokens, count)).alias("chunk_index", "_chunk"))
    return rows.select(*rest, "chunk_index", F.col("_chunk.text").alias(text_col), F.col("_chunk.strategy").alias("chunk_strategy"), count(F.col("_chunk.text")).cast("long").alias("token_count"))
