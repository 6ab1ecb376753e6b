"""Operator 7, personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs and digits, schemes,
and cue words of identifiers. A local parser for each kind expands an anchor to its boundaries and
validates it. Every parser looks at each character a bounded number of times, so a very long run
of letters or digits costs no more than any other text.

Base kinds, as the leftmost non-overlapping matches of their pattern; failing matches are dropped:
  email  local part, at-sign, domain of two labels or more
  ip     four numbers of at most 255 with dots between
  card   12 to 19 digits, single spaces or hyphens between them, that pass Luhn's check
  phone  plus sign and 9 to 15 digits with spaces, dots, hyphens and brackets
Kinds that the method adds:
  address  a URL with user information before its host, or a mailto: address
  account  a valid IBAN after the cue word, or the value given to a cue word (``token = "..."``)

Defined results
  null or empty text: no spans. null ids and repeated rows: each row has its own result.
  offsets are code points, the end is exclusive; spans of different kinds may overlap.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm.scratch import bound_batches

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
#: Cue words of identifiers; a value of 6 characters or more with a digit follows after = or :.
CUES = ("account", "acct", "api_key", "apikey", "iban", "passport", "passwd", "password", "secret", "ssn", "tax id", "token", "user id", "user_id")

_DIGITS = "0123456789"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_VALUE = re.compile(r"(?:\s+(?:number|no\.?|id))?\s*[=:]\s*[\"']?([A-Za-z0-9_-]{6,})")
_IBAN = re.compile(r"[\s:=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_MAILTO = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """Lower-cased for cue words, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, ("digit", 1))
    for word, what in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("mailto:", "mailto"), *((c, "cue") for c in CUES)):
        found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, begin: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at`` that starts at ``begin`` or later."""
    start = at
    while start > begin and _LOCAL.match(text, start - 1):
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain and start < at else None


def _scheme(text: str, at: int) -> int:
    """Where the scheme that ends before ``at`` starts, a letter; ``at`` if there is none."""
    start = at
    while start and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and text[start] not in string.ascii_letters:
        start += 1
    return start


def _ips(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Four numbers each from a run of digits and dots, also those out of range."""
    held: list[tuple[int, int]] = []
    at = start
    while at < end:
        stop = text.find(".", at, end)
        stop = end if stop < 0 else stop
        if stop == at:
            held = []
        else:
            held.append((at, stop))
            if len(held) == 4:
                yield held[0][0], stop
                held = []
        at = stop + 1


def find_spans(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Spans (start, index of kind, end), sorted."""
    out: list[tuple[int, int, int]] = []
    email_end = card_end = dotted_end = phone_end = account_end = 0
    for last, (what, size) in words.iter(fold(text)):
        at = last - size + 1
        if what == "digit":
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card_end))
            elif at >= card_end:
                card_end = at + 1
            if at >= dotted_end:
                dotted_end = _DOTTED.match(text, at).end()
                for s, e in _ips(text, at, dotted_end):
                    if all(len(p := n.lstrip("0")) <= 3 and int(p or 0) <= 255 for n in text[s:e].split(".")):
                        out.append((s, 1, e))
        elif what == "at":
            if at >= email_end and (found := _email(text, at, email_end)):
                out.append((found[0], 0, found[1]))
                email_end = found[1]
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, phone_end))
        elif what == "scheme":
            if (m := _USERINFO.match(text, last + 1)) and (start := _scheme(text, at)) < at:
                out.append((start, 4, m.end()))
        elif what == "mailto":
            if m := _MAILTO.match(text, last + 1):
                out.append((at, 4, m.end()))
        elif at >= account_end and (at == 0 or not text[at - 1].isalnum()):
            if (m := _IBAN.match(text, last + 1)) and (end := iban_end(text, m.start(1), m.end(1))):
                out.append((m.start(1), 5, end))
                account_end = end
            elif (m := _VALUE.match(text, last + 1)) and any(c in _DIGITS for c in m[1]):
                out.append((m.start(1), 5, m.end(1)))
                account_end = m.end(1)
    return sorted(out)


def iban_end(text: str, start: int, end: int) -> int | None:
    """The longest end at which text[start:end] is an IBAN of 15 to 34 characters with the right remainder."""
    for stop in range(end, start + 14, -1):
        code = text[start:stop].replace(" ", "")
        if text[stop - 1] != " " and 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return stop
    return None


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id_col, n_email, n_ip, n_card, n_phone, n_address, n_account, base_sha256, spans."""
    bound_batches(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            rows = [find_spans(t.as_py() or "", words) for t in batch.column(1)]
            said = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in row] for row in rows]
            base = [hashlib.sha256(",".join(x for x, (_, k, _) in zip(names, row, strict=True) if k < 4).encode()).hexdigest() for names, row in zip(said, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([sum(x[1] == k for x in row) for row in rows], pa.int64()) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array([",".join(names) for names in said], pa.string())],
                schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_address", "n_account")
