"""Chunks as slices of their text, for any tokenizer that says where its tokens lie.

A table function gets passages in Arrow batches and gives a row a chunk. Its result's columns come
from the input's and from the tokenizer, when the plan is made: one that has ids adds them. Tokenizers are named by a string,
so that every worker makes its own: ``words`` (between white space), or the path of a tokenizers file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import byte_bpe
from quillon.operators.chunking import WINDOW_OVERLAP
from quillon.sources.scratch import bound_batches

#: Ends of tokens with their starts, and ids if the tokenizer has them.
Tokens = tuple[list[int], list[int], list[int] | None]
_SENTENCE = re.compile(r".+?(?:[।.!?]+(?=\s|$)|\Z)", re.S)
_WORD = re.compile(r"\S+")
#: Passages whose chunks go out together.
ROWS = 512
_made: dict[str, Callable[[str], Tokens]] = {}


def has_ids(tokenizer: str) -> bool:
    return tokenizer != "words"


def tokenizer_of(name: str) -> Callable[[str], Tokens]:
    """text -> starts, ends and ids of its tokens."""
    if name not in _made:
        if name == "words":

            def words(text: str) -> Tokens:
                spans = [m.span() for m in _WORD.finditer(text)]
                return [a for a, _ in spans], [b for _, b in spans], None

            _made[name] = words
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(name)
            model.no_truncation()

            def pieces(text: str) -> Tokens:
                found = model.encode(text, add_special_tokens=False)
                offsets = found.offsets  # made anew whenever it is asked for
                return [a for a, _ in offsets], [b for _, b in offsets], found.ids

            _made[name] = byte_bpe.encoder(name, pieces) or pieces
    return _made[name]


def spans(text: str) -> list[tuple[int, int]]:
    """Sentences without the white space around them."""
    out = []
    for m in _SENTENCE.finditer(text):
        own = m[0].strip()
        if own:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append((start, start + len(own)))
    return out


def slices(text: str, starts: list[int], ends: list[int], most: int) -> list[tuple[int, int, str]]:
    """(start, end, strategy) of the chunks: the whole text if it is short enough, else packed sentences.

    A token belongs to the slice that it ends in. The last sentence of a chunk is repeated in the next
    if both fit; an overlong sentence becomes windows of tokens that overlap.
    """

    def tokens(a: int, b: int) -> int:
        return bisect_right(ends, b) - bisect_right(ends, a)

    sentences = spans(text)
    if not sentences:
        return []
    if tokens(sentences[0][0], sentences[-1][1]) <= most:
        return [(sentences[0][0], sentences[-1][1], "whole_passage")]
    out: list[tuple[int, int, str]] = []
    open_: list[tuple[int, int]] = []

    def flush() -> None:
        if open_:
            out.append((open_[0][0], open_[-1][1], "sentence_overlap"))

    for a, b in sentences:
        if tokens(a, b) > most:
            flush()
            open_ = []
            first, last = bisect_right(ends, a), bisect_right(ends, b)
            overlap = min(WINDOW_OVERLAP, most - 1)
            while True:
                stop = min(first + most, last)
                while first + 1 < stop < last and ends[stop] == ends[stop - 1]:  # tokens of one character stay together
                    stop -= 1
                while stop < last and ends[stop] == ends[stop - 1]:  # unless it has more of them than a chunk
                    stop += 1
                out.append((max(a, starts[first]), ends[stop - 1], "token_window_fallback"))
                if stop == last:
                    break
                again = max(stop - overlap, first + 1)
                while again < stop and ends[again] == ends[again - 1]:
                    again += 1
                first = again
        elif not open_ or tokens(open_[0][0], b) <= most:
            open_.append((a, b))
        else:
            flush()
            open_ = [open_[-1], (a, b)] if tokens(open_[-1][0], b) <= most else [(a, b)]
    flush()
    return out


def _rest(columns: list[str], text: str) -> list[str]:
    return [c for c in columns if c != text]


def result_schema(passages: T.StructType, text_col: str, tokenizer: str) -> T.StructType:
    """The passage's columns but its text, and those of a chunk."""
    if text_col not in passages.names:
        raise ValueError(f"no column {text_col!r}")
    own = [("chunk_index", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), (text_col, T.StringType()), ("chunk_strategy", T.StringType()), ("token_count", T.LongType())]
    ids = [("ids", T.ArrayType(T.IntegerType()))] if has_ids(tokenizer) else []
    return T.StructType([*(f for f in passages.fields if f.name != text_col), *(T.StructField(n, t) for n, t in own + ids)])


class TokenChunks:
    """The table function: passages, the name of the text column, a tokenizer and the most tokens of a chunk."""

    def eval(self, passages: pa.RecordBatch, text: pa.Array, tokenizer: pa.Array, most: pa.Array) -> Iterator[pa.Table]:
        if not passages.num_rows:
            return
        for at in range(0, passages.num_rows, ROWS):
            yield self.part(passages.slice(at, ROWS), text[0].as_py(), tokenizer[0].as_py(), most[0].as_py())

    def part(self, passages: pa.RecordBatch, column: str, name: str, size: int) -> pa.Table:
        encode, rest = tokenizer_of(name), _rest(passages.schema.names, column)
        at, rows, ids_of, counts = [], [], [], []
        for n, value in enumerate(passages.column(column)):
            own = value.as_py() or ""
            starts, ends, ids = encode(own)
            ids = np.asarray(ids, np.int32) if has_ids(name) else None
            for k, (a, b, strategy) in enumerate(slices(own, starts, ends, size)):
                first, last = bisect_right(ends, a), bisect_right(ends, b)
                at.append(n)
                rows.append((k, a, b, own[a:b], strategy, last - first))
                if ids is not None:
                    ids_of.append(ids[first:last])
                    counts.append(last - first)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        made = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)]
        taken = [passages.column(c).take(pa.array(at, pa.int64())) for c in rest]
        names = [*rest, "chunk_index", "start", "end", column, "chunk_strategy", "token_count"]
        if has_ids(name):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            made.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *ids_of]))))
            names.append("ids")
        return pa.table([*taken, *made], names=names)


def chunk(passages: DataFrame, tokenizer: str = "words", max_tokens: int = 256, text_col: str = "text") -> DataFrame:
    """One row a chunk: the passage's columns, chunk_index, start, end, the text between them, chunk_strategy, token_count and, if the tokenizer has them, ids."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    bound_batches(passages.sparkSession)
    function = F.arrow_udtf(TokenChunks, returnType=result_schema(passages.schema, text_col, tokenizer))
    return function(passages.asTable(), F.lit(text_col), F.lit(tokenizer), F.lit(max_tokens))
