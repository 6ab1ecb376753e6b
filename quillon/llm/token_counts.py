"""Operator 13, token counts from distinct pre-tokens.

1. Every text becomes its pre-token frequencies: pre-tokens are what the tokenizer's own normalizer
   and pre-tokenizer cut a text into before its model runs, and a piece never crosses their borders.
   The table of frequencies is kept in the shared folder, a batch of documents together, so that a
   pre-token is written once for all documents of the batch.
2. Pre-tokens in more than 1 / ``HOT_TOKENS`` of all (document, pre-token) pairs are found by adding
   up the batches in which they are that frequent, without the many pre-tokens that nowhere are. They
   are fewer than ``HOT_TOKENS``; the model counts the pieces of each once, and they are broadcast, so
   that the words of nearly every document are not shuffled.
3. All other frequencies are shuffled by pre-token once. Where they meet, the model counts the pieces
   of each distinct pre-token once; none has more than 2 / ``HOT_TOKENS`` of all pairs.
4. Frequencies times pieces are summed by document, with map-side sums. Ids are never kept, nor is any
   list of a document's pieces.

Text is split at ASCII white space first where the tokenizer lets no pre-token reach across it, so
that each distinct word of a task is cut once; else whole texts are. The library cuts, but for words
in Latin letters, which the tokenizer's pattern cuts likewise.

Defined results
  null or empty text: no bytes and no tokens. null or repeated ids: each row has its own result.
  strings of special tokens inside a text: one token each, as the library's default has it.
  pre-tokens of more than ``LONG`` characters are counted where they stand: their number has no
  bound by words, and as keys they could be as long as a text.
  an empty table: an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm.packing import byte_letters
from quillon.llm.scratch import bound_batches, keep

LIMIT = 2048
#: Characters of a pre-token that is joined; fewer than so many pre-tokens are broadcast: at most some 30 MB, and a few in practice.
LONG, HOT_TOKENS = 64, 250_000
#: Rows up to which a pre-token isn't hot, and words that a task remembers the pre-tokens of.
HOT_ROWS, REMEMBERED = 64, 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PreTokens:
    """Pre-tokens of texts, and pieces of pre-tokens, by the library's own parts of the tokenizer in ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        self.special = {t["content"] for t in added}
        self.cut = re.compile("|".join(["(?!)", *(re.escape(s) for s in sorted(self.special, key=len, reverse=True))]))
        self.by_word = self._of("a b") == self._of("a") + self._of("b")
        self.plain = plain_pattern(model)
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, text: str) -> list[str]:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [t for t, _ in self.pre_tokenizer.pre_tokenize_str(text)] if self.pre_tokenizer else [text]

    def of(self, text: str) -> list[str]:
        """Pre-tokens of a text; the string of a special token is one of its own."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._of(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._of(text[at:]) if at < len(text) else out

    def of_word(self, word: str) -> tuple[str, ...]:
        """Pre-tokens of a word that isn't remembered."""
        if self.plain and _LATIN.fullmatch(word) and not self.cut.search(word):
            low = word.lower()
            got = (low,) if low.isalpha() else tuple(self.plain.findall(low))
            if not word.isascii():
                got = tuple(t.encode().decode("latin-1").translate(_LETTERS) for t in got)
        else:
            got = tuple(self.of(word))
        if len(word) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def frequencies(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Pre-tokens of an array of texts: where each text's begin in the next three; names; numbers of names; how often."""
        words = pc.ascii_split_whitespace(texts) if self.by_word else pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        held = words.flatten().dictionary_encode()
        rows = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        row, word, n = _sums(rows, held.indices.to_numpy(), np.ones(len(rows), np.int64), len(held.dictionary))
        known = self.known
        each = [known.get(w) or self.of_word(w) for w in held.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = pa.array(itertools.chain.from_iterable(each), pa.string()).dictionary_encode()
        # The tokens of all (text, word) pairs, one after the other.
        many = sizes[word]
        at = np.arange(many.sum()) + np.repeat((np.cumsum(sizes) - sizes)[word] - (np.cumsum(many) - many), many)
        row, token, n = _sums(np.repeat(row, many), flat.indices.to_numpy()[at], np.repeat(n, many), len(flat.dictionary))
        return np.searchsorted(row, np.arange(len(texts) + 1)), flat.dictionary, token, n

    def pieces(self, token: str) -> int:
        return 1 if token in self.special else len(self.model.tokenize(token))


#: Words of printable ASCII and Latin letters and signs, of which none is composed further or lower-cased by its neighbours.
_LATIN = re.compile("[!-~\u00a1-\u012f\u0132-\u024f]*")
#: How byte-level pre-tokenizers write bytes that aren't printable Latin-1.
_LETTERS = {b: c for c, b in byte_letters().items()}


def plain_pattern(model: dict) -> regex.Pattern | None:
    """What cuts a lower-cased word of Latin letters into pre-tokens, if the tokenizer lower-cases and takes a pattern's matches."""
    normalizer, pre = model["normalizer"] or {}, model["pre_tokenizer"] or {}
    steps, parts = [x["type"] for x in normalizer.get("normalizers", [])], pre.get("pretokenizers", [])
    whole = [x.get("pattern") == {"Regex": r"\s+"} for x in normalizer.get("normalizers", []) if x["type"] == "Replace"]
    if steps != ["NFC", "Replace", "Lowercase"] or whole != [True] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return None
    split, letters = parts
    if "Regex" not in split["pattern"] or split["behavior"] != "Removed" or not split["invert"] or letters["add_prefix_space"] or letters["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


def _sums(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts by (row, code < width), in that order."""
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    keys = rows.astype(np.int64) * max(1, width) + codes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first] // max(1, width), keys[first] % max(1, width), np.add.reduceat(counts[order], first)


def frequencies(docs: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """Frequencies of the documents, a batch at a time.

    A row a document: row, id, n_bytes, own (tokens of its long pre-tokens). And a row for each
    pre-token of a batch: its token, the batch's first row, and ``held``: for each document of the batch
    with it, the document's place in the batch times 2 ** 32 plus how often it stands there. ``often`` says whether at least
    1 / ``HOT_TOKENS`` of the batch's (document, pre-token) pairs are of this pre-token.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("own", T.LongType()), T.StructField("token", T.StringType()), T.StructField("held", T.ArrayType(T.LongType())), T.StructField("often", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(tokenizer)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(2).fill_null("")
            ends, names, token, n = cutter.frequencies(texts)
            place = np.repeat(np.arange(len(texts)), np.diff(ends))
            long = {int(k): cutter.pieces(names[k].as_py()) for k in np.flatnonzero(pc.greater(pc.utf8_length(names), LONG).to_numpy(zero_copy_only=False))}
            own = np.zeros(len(texts), np.int64)
            if long:
                is_long = np.isin(token, list(long))
                np.add.at(own, place[is_long], n[is_long] * np.array([long[k] for k in token[is_long]], np.int64))
                token, n, place = token[~is_long], n[~is_long], place[~is_long]
            none = lambda k, size: pa.nulls(size, arrow.field(k).type)
            yield pa.RecordBatch.from_arrays([rows, batch.column(1), pc.binary_length(texts).cast(pa.int64()), pa.array(own), *(none(k, len(texts)) for k in (4, 5, 6))], schema=arrow)
            order = np.argsort(token, kind="stable")
            used, first = np.unique(token[order], return_index=True)
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array((place[order] << 32) + n[order])).cast(arrow.field(5).type)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), rows[0].as_py() if len(rows) else 0, np.int64)), *(none(k, len(used)) for k in (1, 2, 3)), names.take(pa.array(used)), held, pa.array(np.diff(first, append=len(order)) * HOT_TOKENS >= len(order))], schema=arrow)

    return docs.select(F.monotonically_increasing_id(), F.col(id_col), F.col(text_col)).mapInArrow(count, schema)


def piece_counts(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """token and pieces of distinct pre-tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cutter.pieces(t) for t in batch.column(0).to_pylist()], pa.int64())], ["token", "pieces"])

    return tokens.select("token").mapInArrow(count, "token string, pieces long")


def met_pieces(of_batches: DataFrame, tokenizer: str) -> DataFrame:
    """row and tokens: the frequencies (token, row, held) meet by pre-token, whose pieces are counted once where they do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, pieces = PreTokens(tokenizer), None, 0
        for batch in batches:
            each = []
            for token in batch.column(0).to_pylist():
                if token != last:
                    last, pieces = token, cutter.pieces(token)
                each.append(pieces)
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            held = batch.column(2).flatten().to_numpy()
            rows = np.repeat(batch.column(1).to_numpy(), sizes) + (held >> 32)
            order = np.argsort(rows, kind="stable")
            found, first = np.unique(rows[order], return_index=True)
            tokens = ((held & _COUNT) * np.repeat(np.array(each, np.int64), sizes))[order]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.add.reduceat(tokens, first) if len(found) else tokens)], ["row", "tokens"])

    return of_batches.repartition("token").sortWithinPartitions("token").mapInArrow(count, "row long, tokens long")


#: The lower half of a held number.
_COUNT = (1 << 32) - 1


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row a row of ``docs``: id_col, n_bytes, n_tokens, over_limit."""
    bound_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    held = keep(frequencies(docs, id_col, text_col, path), "frequencies", "zstd")
    of_batches = held.where("token is not null")
    total = of_batches.agg(F.sum(F.size("held"))).first()[0] or 0
    often = of_batches.where("often").groupBy("token").agg(F.sum(F.size("held")).alias("docs")).where(F.col("docs") > max(HOT_ROWS, total // HOT_TOKENS))
    hot = F.broadcast(keep(piece_counts(often, path), "hot"))  # fewer than HOT_TOKENS rows of at most LONG characters
    rows = of_batches.select("token", "row", "held")
    mapped = rows.join(hot, "token").select("row", "pieces", F.explode("held").alias("x")).select((F.col("row") + F.shiftright("x", 32)).alias("row"), (F.col("x").bitwiseAND(F.lit(_COUNT)) * F.col("pieces")).alias("tokens"))
    met = met_pieces(rows.join(hot, "token", "left_anti"), path)
    # A task's documents have one row each when they are shuffled.
    sums = mapped.unionByName(met).groupBy("row").agg(F.sum("tokens").alias("tokens"))
    n_tokens = F.col("own") + F.coalesce("tokens", F.lit(0))
    return held.where("token is null").select("row", "id", "n_bytes", "own").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
