"""Text functions as Spark columns (no Python workers)."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: word lists, markers and patterns that decide results -------------------------
#: Words that an answer's query terms leave out.
ANSWER_STOP_TERMS = (
    "और", "का", "की", "के", "को", "कौन", "क्या", "कितनी", "पर", "पहले", "में", "मुझे", "यह", "वह", "से", "सबसे", "था", "थे", "है", "हैं", "हो",
    "the", "a", "an", "and", "are", "did", "do", "does", "for", "how", "in", "is", "of", "on", "to", "was", "were", "what", "when", "where", "who",
)
#: Words that a partial transcript's meaningful terms leave out.
PARTIAL_STOP_TERMS = ("और", "का", "की", "के", "को", "कितनी", "में", "पर", "से", "है", "हैं", "क्या")
#: Abbreviations after which a period ends no sentence; the first group not even before a capital.
TITLES = ("dr.", "mr.", "mrs.", "ms.", "prof.", "sr.", "jr.", "डॉ.", "श्री.")
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "पी.ए.", "यू.एस.", "यू.के.", "सं.")
NUMERIC_QUESTIONS = ("how far", "how many", "how much", "how old", "कितनी", "कितना", "कितने")
FILLERS = ("um", "uh", "hmm")
TERM = "[A-Za-z0-9_]+|[\u0900-\u0963\u0966-\u097F]+"
NUMBER = r"(?U)\d+(?:\.\d+)?"
NO_ANSWER = "मुझे उपलब्ध संदर्भ में पर्याप्त जानकारी नहीं मिली।"
# -------------------------------------------------------------------------------------------------

SPACE = r"(?U)[\s\x1c-\x1f]+"
_MARK = "\x02"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_of(values: tuple | list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def normalize_space(text: Column | str) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), SPACE, " "))


_CHARACTERS = [chr(k) for k in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))]
#: Lower-case characters that full case folding changes, some into several, and what they become. Sharp s is apart, as it is frequent.
FOLDED = {c: c.casefold() for c in _CHARACTERS if c.lower() == c != c.casefold() and c != "ß"}
#: Those of them that become one character, and those that become several.
_SINGLE, _SEVERAL = {c: f for c, f in FOLDED.items() if len(f) == 1}, {c: f for c, f in FOLDED.items() if len(f) > 1}
#: Characters whose lower case has one of these; a capital sigma becomes a final one at a word's end.
_TO_FOLD = "".join(c for c in _CHARACTERS if c == "Σ" or any(x in FOLDED for x in c.lower()))


def _has(text: Column, characters: str) -> Column:
    """Whether a text has one of the characters, by a hash table; a class of a pattern would try them all for each character."""
    return F.translate(text, characters, "") != text


def fold_case(text: Column | str) -> Column:
    """Full case folding. Texts without characters of ``FOLDED``, nearly all, only go to lower case."""
    source = _col(text)
    low = F.replace(F.lower(source), F.lit("ß"), F.lit("ss"))
    single = F.translate(low, "".join(_SINGLE), "".join(_SINGLE.values()))
    known = F.create_map(*(F.lit(x) for pair in _SEVERAL.items() for x in pair))
    several = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(known[c], c)), "")
    folded = F.when(_has(low, "".join(_SEVERAL)), several).otherwise(single)
    return F.when((F.length(source) < F.octet_length(source)) & _has(source, _TO_FOLD), folded).otherwise(low)


def tokenize(text: Column | str) -> Column:
    """Case-folded words, with punctuation and symbols as white space."""
    plain = F.regexp_replace(fold_case(text), r"[\p{P}\p{S}]", " ")
    return F.filter(F.split(F.coalesce(plain, F.lit("")), SPACE), lambda w: w != "")


def token_count(text: Column | str) -> Column:
    """Words between white space."""
    spaced = normalize_space(text)
    return F.when(F.coalesce(spaced, F.lit("")) == "", 0).otherwise(F.size(F.split(spaced, " "))).cast("long")


def answer_terms(text: Column | str) -> Column:
    """Distinct lower-cased terms: Latin letters, digits and underscores, or Devanagari."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"({TERM})"), F.lit(1)), F.lower))


def query_terms(text: Column | str) -> Column:
    return F.array_except(answer_terms(text), words_of(ANSWER_STOP_TERMS))


def meaningful_terms(text: Column | str) -> Column:
    """Distinct tokens of a partial transcript without stop words."""
    return F.array_except(F.array_distinct(tokenize(text)), words_of(PARTIAL_STOP_TERMS))


def numbers(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"({NUMBER})"), F.lit(1))


def is_numeric_question(query: Column | str) -> Column:
    folded = fold_case(normalize_space(query))
    return F.exists(words_of(NUMERIC_QUESTIONS), lambda m: F.contains(folded, m))


def chunk_sentences(text: Column | str) -> Column:
    """Sentences for chunking: they end with a run of terminators before white space or the end."""
    spaced = F.coalesce(normalize_space(text), F.lit(""))
    found = F.regexp_extract_all(spaced, F.lit(r"((?s).+?(?:[।.!?]+(?=\s|$)|$))"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def answer_sentences(text: Column | str) -> Column:
    """Sentences for answers, which abbreviations, initials and decimals don't end.

    Every word gets marks after those of its characters that end a sentence; the marked text is
    split. A period's say depends on its word alone, but for initials as in ``U.S. He``: these end
    a sentence if the next word begins with a capital.
    """
    words = F.split(F.coalesce(normalize_space(text), F.lit("")), " ")
    dots = rf"(?<![0-9])\.|\.(?![0-9])|(?<=^)\."
    edges = "^[\"'“”‘’()\\[\\]{}<>,;:!?]+|[\"'“”‘’()\\[\\]{}<>,;:!?]+$"

    def marked(p: Column) -> Column:
        word, bare = p["word"], p["bare"]
        initials = bare.rlike(r"^(?:[a-z]\.){2,}$")
        other = bare.rlike("^(?:[\u0900-\u097F]+\\.){2,}$") | bare.isin(*ABBREVIATIONS)
        after = F.regexp_replace(F.concat(F.regexp_extract(word, r"\.([^.]*)$", 1), F.lit(" "), p["next"]), "^[\"'“”‘’)\\]} ]+", "")
        by_period = (
            F.when(bare.isin(*TITLES) | bare.rlike(r"^[a-z]\.$"), word)
            .when(initials & after.rlike(r"^\p{Lu}"), F.regexp_replace(word, r"\.(?=[^.]*$)", "." + _MARK))
            .when(initials | other, word)
            .otherwise(F.regexp_replace(word, dots, "." + _MARK))
        )
        return F.regexp_replace(F.when(F.contains(word, F.lit(".")), by_period).otherwise(word), "([।?!])", "$1" + _MARK)

    # The words are made a few times a text, not once a word, and what a word needs is made once.
    pairs = F.arrays_zip(words.alias("word"), F.concat(F.slice(words, F.lit(2), F.size(words)), F.array(F.lit(""))).alias("next"))
    named = F.transform(pairs, lambda p: F.struct(p["word"].alias("word"), p["next"].alias("next"), F.lower(F.regexp_replace(p["word"], edges, "")).alias("bare")))
    parts = F.split(F.array_join(F.transform(named, marked), " "), _MARK)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def devanagari_language(text: Column | str, share: float = 0.15) -> Column:
    """hi if more than ``share`` of the characters are Devanagari, else en."""
    c = _col(text)
    count = F.length(c) - F.length(F.regexp_replace(c, "[ऀ-ॿ]", ""))
    return F.when(count > share * F.length(c), "hi").otherwise("en")


def without_fillers(text: Column | str) -> Column:
    return normalize_space(F.regexp_replace(F.lower(_col(text)), rf"\b(?:{'|'.join(FILLERS)})\b", " "))


def preview(text: Column | str, size: int = 80) -> Column:
    c = normalize_space(text)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def estimated_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(_col(text), F.lit(""))) / 4.0).cast("long")


def redact(text: Column | str) -> Column:
    """Values given to key names such as api key, token or secret, replaced."""
    return F.regexp_replace(_col(text), r"(?i)((?:api[_ -]?key|token|secret)\s*[:=]\s*)([^\s,;]+)", "$1[REDACTED]")


def media_type(content_type: Column | str) -> Column:
    return F.lower(F.trim(F.split_part(_col(content_type), F.lit(";"), F.lit(1))))


def all_tokens_in(source: Column | str, value: Column | str) -> Column:
    """Whether every word of ``value`` occurs in ``source``; false without words."""
    folded = fold_case(source)
    words = F.regexp_extract_all(fold_case(value), F.lit("([A-Za-z0-9]+|[ऀ-ॿ]+)"), F.lit(1))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(folded, w))


def evidence_block(number: Column, text: Column, query_id: Column, passage_index: Column, chunk_index: Column) -> Column:
    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    return F.concat(
        F.lit("[Evidence "), number.cast("string"), F.lit("]\nquery_id: "), shown(query_id), F.lit("\npassage_index: "), shown(passage_index),
        F.lit("\nchunk_index: "), shown(chunk_index), F.lit("\ntext: "), text,
    )


def prompt(system: str, passages: Column, question: Column) -> Column:
    """System text, numbered passages and the question, for a language model outside this engine."""
    listed = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    return F.concat(F.lit(system + "\n\nContext:\n"), listed, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union of two arrays; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def policy_prefix(policy: Column | str) -> Column:
    return F.substring_index(_col(policy), "_", 2)
