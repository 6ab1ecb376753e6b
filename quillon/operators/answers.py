"""Extractive answers: sentences chosen from ranked evidence, formatted, and given as context.

All of it is column expressions over one row a query, which holds its few ranked chunks as an
array; order-dependent steps are folds over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import (
    NO_ANSWER,
    all_tokens_in,
    answer_sentences,
    answer_terms,
    estimated_tokens,
    evidence_block,
    is_numeric_question,
    normalize_space,
    numbers,
    query_terms,
)

MIN_SCORE, NEAR_DUPLICATE, MIN_MATCHES = 0.001, 0.85, 1
MAX_SENTENCES, MAX_CHARS = 3, 600

_CANDIDATE = "struct<direct:int,relevance:double,chunk:int,place:int,sentence:string,score:double,query_id:string,passage_index:string,chunk_index:string,terms:array<string>>"


def with_evidence(queries: DataFrame, ranked: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Queries with ``evidence``: their ranked chunks (rank, score, text, keys as query_id, passage_index, chunk_index)."""
    names = [*keys, *[None] * (3 - len(keys))]
    provenance = [(F.col(c).cast("string") if c else F.lit("0")).alias(n) for c, n in zip(names, ("query_id", "passage_index", "chunk_index"), strict=True)]
    rows = ranked.join(texts.select(*keys, "text"), keys).select("query_key", F.struct("rank", F.col("score").cast("double").alias("score"), "text", *provenance).alias("e"))
    return queries.join(rows.groupBy("query_key").agg(F.array_sort(F.collect_list("e")).alias("evidence")), "query_key", "left")


def matches(terms: Column, sentence_terms: Column) -> Column:
    """Query terms that a sentence has, as a whole or one a prefix of the other (from three letters on)."""
    return F.size(F.filter(terms, lambda q: F.exists(sentence_terms, lambda s: (s == q) | ((F.length(q) >= 3) & (F.startswith(s, q) | F.startswith(q, s))))))


def compose(queries: DataFrame, max_sentences: int = MAX_SENTENCES, max_chars: int = MAX_CHARS, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of (query, evidence, ...) with answer, confidence, is_no_answer and used: the sentences with their provenance."""
    if max_sentences < 1 or max_chars < 1:
        raise ValueError("max_sentences and max_chars must be at least 1")
    terms, asked, numeric = F.col("_terms"), F.col("_numbers"), F.col("_numeric")
    base = queries.withColumn("_q", normalize_space("query")).withColumn("_terms", query_terms("_q")).withColumn("_numbers", F.array_distinct(numbers("_q"))).withColumn("_numeric", is_numeric_question("_q"))

    def of_chunk(e: Column, i: Column) -> Column:
        def one(p: Column, j: Column) -> Column:
            sentence, own, found, hit = p["s"]["sentence"], p["s"]["own"], p["s"]["found"], p["hit"]
            direct = (F.size(terms) >= 2) & ((hit == F.size(terms)) | (numeric & (F.size(found) > 0) & (hit >= 2)))
            overlap = F.when(F.size(terms) > 0, hit / F.size(terms)).otherwise(F.lit(0.0))
            relevance = 0.5 * e["score"] + 1.5 * overlap + 0.1 * F.size(F.array_intersect(asked, found)) + 0.01 / (i + 1)
            return F.struct(
                F.when(direct, 0).otherwise(1).alias("direct"), (-relevance).alias("relevance"), i.alias("chunk"), j.alias("place"), sentence.alias("sentence"), e["score"].alias("score"),
                e["query_id"].alias("query_id"), e["passage_index"].alias("passage_index"), e["chunk_index"].alias("chunk_index"), own.alias("terms"), hit.alias("hits"),
            )

        sentences = F.when((e["score"] >= min_score) & e["text"].isNotNull(), answer_sentences(e["text"])).otherwise(F.array().cast("array<string>"))
        # Terms and matches are made once a sentence: inside one expression they would be made anew wherever they stand.
        read = F.transform(sentences, lambda s: F.struct(s.alias("sentence"), answer_terms(s).alias("own"), numbers(s).alias("found")))
        return F.transform(F.transform(read, lambda p: F.struct(p.alias("s"), matches(terms, p["own"]).alias("hit"))), one)

    seen = base.withColumn("_all", F.filter(F.flatten(F.transform(F.coalesce("evidence", F.expr("cast(array() as array<struct<rank:int,score:double,text:string,query_id:string,passage_index:string,chunk_index:string>>)")), of_chunk)), lambda c: c["hits"] >= MIN_MATCHES))
    # In order: a sentence is left out if an accepted one is the same or nearly so.
    lower = "lower(a.sentence) = lower(c.sentence)"
    near = f"size(c.terms) > 0 and size(array_intersect(a.terms, c.terms)) / size(array_union(a.terms, c.terms)) >= {NEAR_DUPLICATE}"
    fields = "'direct', c.direct, 'relevance', c.relevance, 'chunk', c.chunk, 'place', c.place, 'sentence', c.sentence, 'score', c.score, 'query_id', c.query_id, 'passage_index', c.passage_index, 'chunk_index', c.chunk_index, 'terms', c.terms"
    accepted = seen.withColumn("_accepted", F.expr(f"aggregate(_all, cast(array() as array<{_CANDIDATE}>), (acc, c) -> case when exists(acc, a -> {lower} or ({near})) then acc else array_append(acc, cast(named_struct({fields}) as {_CANDIDATE})) end)"))
    # Best first; a sentence too long for what is left is passed over, and a direct answer ends the choice.
    fits = f"not s.over and s.chars + if(size(s.sel) > 0, 1, 0) + length(c.sentence) <= {max_chars}"
    grown = f"named_struct('sel', array_append(s.sel, c), 'chars', s.chars + if(size(s.sel) > 0, 1, 0) + length(c.sentence), 'over', c.direct = 0 or size(s.sel) + 1 >= {max_sentences})"
    chosen = accepted.withColumn("used", F.expr(f"aggregate(array_sort(_accepted), named_struct('sel', cast(array() as array<{_CANDIDATE}>), 'chars', 0, 'over', false), (s, c) -> case when {fits} then {grown} else s end, s -> s.sel)"))
    none = F.size("used") == 0
    return chosen.select(
        *queries.columns,
        F.when(none, F.lit(NO_ANSWER)).otherwise(F.array_join(F.transform("used", lambda c: c["sentence"]), " ")).alias("answer"),
        F.when(~none, F.aggregate("used", F.lit(0.0), lambda a, c: a + c["score"]) / F.size("used")).alias("confidence"),
        none.alias("is_no_answer"),
        F.transform("used", lambda c: F.struct(c["query_id"].alias("query_id"), c["passage_index"].alias("passage_index"), c["chunk_index"].alias("chunk_index"), c["score"].alias("score"), c["sentence"].alias("sentence"))).alias("used"),
    )


# ---- Fixed values: question patterns by language and kind, and how their answers read ------------
#: Units of distance in the order in which they are tried, and which of them are miles.
UNITS = "miles?|mi|kilometers?|kms?|km|मील|किमी|किलोमीटर"
MILES = ("mile", "miles", "mi", "मील")
_AMOUNT = r"\d+(?:[.,]\d+)?"
QUESTIONS = {
    ("en", "distance"): (r"(?i)^how\s+far\s+is\s+(.+?)\s+from\s+(.+?)[?.!]*$", r"(?i)^what\s+is\s+the\s+distance\s+between\s+(.+?)\s+and\s+(.+?)[?.!]*$"),
    ("hi", "distance"): (r"^(.+?)\s+(.+?)\s+से\s+कितनी\s+दूर\s+है[?।!]*$", r"^(.+?)\s+और\s+(.+?)\s+के\s+बीच\s+कितनी\s+दूरी\s+है[?।!]*$"),
    ("en", "quantity"): (r"(?i)^how\s+many\s+([a-z][a-z -]*?)\s+(?:does|do|is|are)\s+(.+?)(?:\s+have)?[?.!]*$",),
    ("hi", "quantity"): (r"^(.+?)\s+के\s+कितने\s+(.+?)\s+हैं[?।!]*$",),
    ("en", "date"): (r"(?i)^(?:when|what\s+year)\s+did\s+(.+?)\s+happen[?.!]*$",),
    ("hi", "date"): (r"^(.+?)\s+कब\s+हुआ[?।!]*$",),
    ("en", "location"): (r"(?i)^where\s+is\s+(.+?)[?.!]*$",),
    ("hi", "location"): (r"^(.+?)\s+कहाँ\s+है[?।!]*$",),
}
ANSWERS = {
    ("en", "distance"): "%s is about %s miles (%s km) from %s.",
    ("hi", "distance"): "%s %s से लगभग %s मील (%s किमी) दूर है।",
    ("en", "quantity"): "%s has %s %s.",
    ("hi", "quantity"): "%s के %s %s हैं।",
    ("en", "date"): "%s happened in %s.",
    ("hi", "date"): "%s %s में हुआ।",
    ("en", "location"): "%s is in %s.",
    ("hi", "location"): "%s %s में स्थित है।",
}
_YEAR = r"\b(?:1[5-9]\d{2}|20\d{2}|21\d{2})\b"
# -------------------------------------------------------------------------------------------------


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def formatted_answer(query: Column, source: Column, language: Column) -> Column:
    """struct(answer, kind) by the first kind whose question pattern and single fact fit; else null."""
    q, s = normalize_space(query), normalize_space(source)
    distances = _all(s, rf"(?i){_AMOUNT}\s*(?:{UNITS})")
    in_miles = lambda d: F.lower(F.regexp_extract(d, rf"^{_AMOUNT}\s*(.*)$", 1)).isin(*MILES)
    miles, kilometres = F.filter(distances, in_miles), F.filter(distances, lambda d: ~in_miles(d))
    mile, kilometre = (F.regexp_extract(F.get(x, F.lit(0)), f"^({_AMOUNT})", 1) for x in (miles, kilometres))
    amounts, years = _all(s, _AMOUNT), F.array_distinct(_all(s, _YEAR))

    def made(lang: str, kind: str, fits: Column, *parts: Column) -> Column:
        return F.when((language == lang) & fits, F.struct(F.format_string(ANSWERS[lang, kind], *parts).alias("answer"), F.lit(kind).alias("kind")))

    tried = []
    for lang in ("en", "hi"):
        for pattern in QUESTIONS[lang, "distance"]:
            a, b = F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2)
            first = ~q.rlike(QUESTIONS[lang, "distance"][0]) if pattern != QUESTIONS[lang, "distance"][0] else F.lit(True)
            fits = first & q.rlike(pattern) & (F.size(miles) == 1) & (F.size(kilometres) == 1) & all_tokens_in(s, a) & all_tokens_in(s, b)
            tried.append(made(lang, "distance", fits, *((a, mile, kilometre, b) if lang == "en" else (a, b, mile, kilometre))))
    for lang in ("en", "hi"):
        (pattern,) = QUESTIONS[lang, "quantity"]
        a, b = F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2)
        entity, concept = (b, a) if lang == "en" else (a, b)
        tried.append(made(lang, "quantity", q.rlike(pattern) & all_tokens_in(s, entity) & all_tokens_in(s, concept) & (F.size(amounts) == 1), entity, F.get(amounts, F.lit(0)), concept))
    for lang in ("en", "hi"):
        (pattern,) = QUESTIONS[lang, "date"]
        event = F.regexp_extract(q, pattern, 1)
        tried.append(made(lang, "date", q.rlike(pattern) & (F.size(years) == 1) & all_tokens_in(s, event), event, F.get(years, F.lit(0))))
    place_en = r"(?i)\b(?:is|was)\s+(?:located\s+)?in\s+([^.?!]+)"
    (pattern,) = QUESTIONS["en", "location"]
    entity = F.regexp_extract(q, pattern, 1)
    tried.append(made("en", "location", q.rlike(pattern) & all_tokens_in(s, entity) & s.rlike(place_en), entity, F.trim(F.regexp_extract(s, place_en, 1))))
    (pattern,) = QUESTIONS["hi", "location"]
    entity = F.regexp_extract(q, pattern, 1)
    after = F.regexp_extract(F.substring(s, F.position(entity, s) + F.length(entity), F.length(s)), r"^\s+([^।!?]+?)\s+में\s+स्थित\s+है", 1)
    tried.append(made("hi", "location", q.rlike(pattern) & all_tokens_in(s, entity) & (F.position(entity, s) > 0) & (after != ""), entity, F.trim(after)))
    return F.coalesce(*tried)


def format_answers(composed: DataFrame, language: str = "language") -> DataFrame:
    """Composed rows with formatted_answer and format_kind: only where one sentence, close to the answer, supports it."""
    source = F.get("used", F.lit(0))["sentence"]
    words = F.slice(F.split(normalize_space("answer"), " "), 1, 3)
    close = ~F.col("is_no_answer") & (F.size("used") == 1) & F.exists(words, lambda w: F.contains(source, w))
    found = composed.withColumn("_f", F.when(close, formatted_answer(F.col("query"), source, F.col(language))))
    return found.withColumn("formatted_answer", F.coalesce("_f.answer", "answer")).withColumn("format_kind", F.coalesce("_f.kind", F.lit("unchanged"))).drop("_f")


def context(queries: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """Rows of (query, evidence, ...) with context, evidence_count and estimated_tokens.

    Blocks in the order of ranks; repeated texts and provenances are passed over; the first block
    that goes over the budget ends the context.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    empty = "named_struct('blocks', cast(array() as array<string>), 'texts', cast(array() as array<string>), 'keys', cast(array() as array<string>), 'over', false)"

    def step(s: Column, e: Column) -> Column:
        text = F.trim(e["text"])
        named = e["query_id"].isNotNull() | e["passage_index"].isNotNull() | e["chunk_index"].isNotNull()
        key = F.to_json(F.struct(e["query_id"], e["passage_index"], e["chunk_index"]))
        skip = s["over"] | (F.coalesce(text, F.lit("")) == "") | F.array_contains(s["texts"], text) | (named & F.array_contains(s["keys"], key))
        grown = F.array_append(s["blocks"], evidence_block(F.size(s["blocks"]) + 1, text, e["query_id"], e["passage_index"], e["chunk_index"]))
        within = estimated_tokens(F.array_join(grown, "\n\n")) <= max_tokens
        added = F.struct(grown.alias("blocks"), F.array_append(s["texts"], text).alias("texts"), F.when(named, F.array_append(s["keys"], key)).otherwise(s["keys"]).alias("keys"), F.lit(False).alias("over"))
        ended = F.struct(s["blocks"].alias("blocks"), s["texts"].alias("texts"), s["keys"].alias("keys"), F.lit(True).alias("over"))
        return F.when(skip, s).when(within, added).otherwise(ended)

    blocks = queries.withColumn("_blocks", F.aggregate("evidence", F.expr(empty), step, lambda s: s["blocks"]))
    text = F.array_join(F.coalesce("_blocks", F.array().cast("array<string>")), "\n\n")
    return blocks.withColumn("context", text).withColumn("evidence_count", F.coalesce(F.size("_blocks"), F.lit(0))).withColumn("estimated_tokens", estimated_tokens("context")).drop("_blocks")
