"""A small, forgiving HTML parser: elements as ranges of tokens.

It follows the rules of HTML that decide where elements end (void elements, raw text, end tags
that may be left out) and keeps no tree of objects: an element is (tag, attributes, parent, first
token, end token), so that nesting of any depth costs no recursion.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import xxhash

#: Fixed values of HTML: elements without content; those whose content is plain text; block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
#: A start tag ends the open element of these, up to an element at which the search stops.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
_P_STOPS = frozenset("table td th caption button object template".split())
_END_STOPS = frozenset("article aside section nav main table td th body html".split())

# A quote opens a value only after "=", and only in a value may ">" stand.
_TAG = re.compile(r"<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|(?P<other>[!?])[^>]*>|(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>)", re.S)
_ATTR = re.compile(r"[\s/]*([^\s/=][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S*)))?")


def attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name, as they stand between a tag's name and its end; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v), ""))
    return out


MASK = (1 << 61) - 1
_BASE = 1_000_003_000_017


class Page:
    """tokens: texts and tag marks in page order; elements: [tag, attributes, parent, first, end]."""

    __slots__ = ("tokens", "owner", "elements", "_sums", "_powers")

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.owner: list[int] = []
        self.elements: list[list] = [["", "", -1, 0, 0]]
        self._read(source)

    def _read(self, source: str) -> None:
        tokens, owner, elements = self.tokens, self.owner, self.elements
        stack, at, n = [0], 0, len(source)

        opened: Counter = Counter()  # so that the stack is searched only for what is in it

        def close(depth: int) -> None:
            while len(stack) > depth:
                ended = elements[stack.pop()]
                ended[4] = len(tokens)
                opened[ended[0]] -= 1

        def close_open(tags: tuple | frozenset, stops: tuple | frozenset) -> None:
            if not any(opened[t] for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                tag = elements[stack[k]][0]
                if tag in tags:
                    close(k)
                    return
                if tag in stops:
                    return

        def text(upto: int) -> None:
            if upto > at:
                tokens.append(source[at:upto])
                owner.append(stack[-1])

        last = source.rfind(">")
        while at < n:
            m = _TAG.search(source, at, last + 1) if at <= last else None
            if m is None:
                cut = source.find("<!--", at)  # a comment that never ends
                text(n if cut < 0 else cut)
                break
            text(m.start())
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["comment"] is not None and not m[0].endswith(("-->", "--!>")):  # it never ends
                    break
                continue
            tag = tag.lower()
            if m["end"]:
                for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                    open_tag = elements[stack[k]][0]
                    if open_tag == tag:
                        close(k)
                        break
                    if open_tag in _END_STOPS and tag not in BLOCK:
                        break
                continue
            if tag in BLOCK:
                close_open(("p",), _P_STOPS)
            if tag in _ENDS:
                close_open(*_ENDS[tag])
            elements.append([tag, m["attrs"], stack[-1], len(tokens), len(tokens) + 1])
            tokens.append("<" + tag)
            owner.append(len(elements) - 1)
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            stack.append(len(elements) - 1)
            opened[tag] += 1
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                text(end.start() if end else n)
                close(len(stack) - 1)
                if not end:
                    break
                skip = source.find(">", end.end())
                at = n if skip < 0 else skip + 1
        close(0)

    def attributes(self, k: int) -> dict[str, str]:
        return attributes(self.elements[k][1]) if self.elements[k][1] else {}

    def subtree_hash(self, k: int) -> int:
        """Hash of an element's tags and texts, without attributes, from sums over all tokens."""
        if not hasattr(self, "_sums"):
            sums, powers = [0], [1]
            for t in self.tokens:
                sums.append((sums[-1] * _BASE + xxhash.xxh3_64_intdigest(" ".join(t.split()))) & MASK)
                powers.append(powers[-1] * _BASE & MASK)
            self._sums, self._powers = sums, powers
        _, _, _, first, end = self.elements[k]
        value = (self._sums[end] - self._sums[first] * self._powers[end - first]) & MASK
        return (value ^ (value >> 29)) * 0x9E3779B97F4A7C15 % (1 << 63)

    def runs(self, keeps: list[bool] | None = None) -> list[tuple[int, str]]:
        """Texts of blocks in page order, each with its nearest block element: references decoded,
        white space one space, trimmed, none empty.

        keeps: for each element, whether its own texts belong to the result.
        """
        out, parts, block = [], [], -1
        elements = self.elements
        above: list[int] = []  # for each element, its nearest block element
        for k, (tag, _, parent, _, _) in enumerate(elements):
            above.append(k if tag in BLOCK or not k else above[parent])

        def flush() -> None:
            if parts and (joined := " ".join("".join(parts).split())):
                out.append((block, joined))
            parts.clear()

        for i, (t, k) in enumerate(zip(self.tokens, self.owner, strict=True)):
            if above[k] != block:
                flush()
                block = above[k]
            if i == elements[k][3] and k:
                if elements[k][0] in BLOCK:
                    flush()
                elif t == "<br":
                    parts.append(" ")
            elif keeps is None or keeps[k]:
                parts.append(entities.unescape(t))
        flush()
        return out

    def blocks(self, keeps: list[bool] | None = None) -> list[str]:
        """The texts of ``runs``."""
        return [t for _, t in self.runs(keeps)]
