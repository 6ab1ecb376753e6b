"""Ids and places of the tokens of a byte-level BPE vocabulary, some times faster than its own library gives them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

#: How a byte-level pre-tokenizer finds words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of this length in a row is left to the library: the search for words would go too deep.
LONG_SPACE = 1 << 16
_LONG_SPACE = re.compile(rf"(?:\A|(?<=\S))\s{{{LONG_SPACE}}}")

Tokens = tuple[list[int], list[int], list[int]]


def letters() -> dict[str, int]:
    """How such a vocabulary writes bytes: printable ones of Latin-1 as themselves, others as U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(others)}}


def ranks_of(file: dict) -> dict[bytes, int] | None:
    """Words of a tokenizers file with their ids, if these tell the order of its merges and nothing else changes a text; else None."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = not any(file.get(k) for k in ("normalizer", "post_processor")) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or not plain:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"].get("".join(p), -1) for p in pairs]
    special, own = {t["content"] for t in file["added_tokens"]}, letters()
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    # Every word but the bytes comes from one merge, in the order of ids.
    if order != sorted(set(order)) or set(order) | {words.get(c) for c in own} != set(words.values()):
        return None
    return {bytes(own[c] for c in w): i for w, i in words.items()}


def encoder(path: str, exact: Callable[[str], Tokens]) -> Callable[[str], Tokens] | None:
    """text -> starts, ends and ids of its tokens, as ``exact`` gives them from the tokenizers file ``path``; None if the file isn't one of plain byte-level BPE.

    tiktoken runs the merges; where a token's bytes begin and end tells its characters. Texts that
    hold an added token's string or very long white space go to ``exact``.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    ranks = ranks_of(file)
    if ranks is None:
        return None
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    size, added = np.zeros(max(ranks.values()) + 1, np.int64), [t["content"] for t in file["added_tokens"]]
    for word, i in ranks.items():
        size[i] = len(word)

    def encode(text: str) -> Tokens:
        if any(s in text for s in added) or (len(text) >= LONG_SPACE and _LONG_SPACE.search(text)):
            return exact(text)
        try:
            ids = fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # noqa: BLE001  a panic of the encoder, which isn't an Exception; the tokens are the same
            return exact(text)
        lengths = size[ids] if ids else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if not text.isascii():
            # Bytes that continue a character are 10xxxxxx; a token has all characters that it has a byte of.
            character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
            starts, ends = character[starts], character[ends - 1] + 1
        return starts.tolist(), ends.tolist(), ids

    return encode
