"""Operator 2, main text of web pages by site template removal.

1. Every page is parsed once, into the blocks of its text and the element subtrees that may be a
   template, each with a hash of its tags and texts (without attributes). That is kept, bucketed by
   batches of pages; the pages themselves are not read again, and neither HTML nor text is shuffled.
2. Spark counts, for each host and hash, on how many pages with different main content the subtree
   stands. Copies of a page, also under other headings, count once, so that they don't look like a
   template.
3. Subtrees that recur on ``MIN_PAGES`` such pages or more, and on ``MIN_SHARE`` of the host's, are
   the host's template. A page's own template hashes are joined back to it and the blocks in its
   subtrees deleted, but not where they hold more than ``MOST`` times the text that would be left.

A page of a small host shows no template; so menus, footers, notices, adverts, forms, comments and
the like are also deleted where the markup names them: by tag, role, hidden, or a class or id all
of whose words are such names or words of layout (``ad-slot``, but not ``notice-period``). A name
never deletes running text itself (paragraphs, headings, lists, tables), unless most of it is links,
nor an element that holds most of the paragraphs, unless they are comments. If an article (or else
main) element holds at least half of the page's running text, the text is what is left in it, else
what is left in the page. Elements that hold an article, main or h1 are never deleted, nor, in an
article, is an element that holds running text at any depth, however often it recurs.

Defined results
  null or empty html: empty text. null url or one without a host: the host is empty, one like others.
  null ids and repeated rows: each row has its own result. Unclosed elements end with their parent.
  br is white space, as it lies inside a block. Empty table: empty result.
  kept columns may have any names; text and n_chars are the result's own and replace kept ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.html_tree import BLOCK, RAW, Page
from quillon.llm.scratch import bound_batches, keep_bucketed

#: A template subtree stands on so many pages of its host, and on such a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Template subtrees may hold so many times the text that is left on a page (links and headings don't count).
MOST = 2

#: Elements that never hold main text; those that do so only inside an article.
NOT_TEXT = RAW | frozenset("nav aside form footer menu dialog button select datalist fieldset object embed audio video canvas svg math head search input".split())
ARTICLE_ONLY = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in class and id names of what is not main text; those of comments; words that may stand beside them.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
NAMES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent cookie cookies copyright "
    "footer footnav gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promos promotion recommended recommendations related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
LAYOUT = frozenset(
    "area article articles aside bar block body bottom box btn button buttons card cards col column container content entry foot footer form global group head holder home icon icons in inner item items js "
    "layer left link links list location lower main message middle mobile module news outer page panel placeholder post posts primary reader readers region right row secondary section shell site slot slots "
    "sticky stories story strip sub tab text thread title top unit upper us user users wp wrap wrapper zone".split()
)
_TOKEN = re.compile(r"[^\s]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Running text, which in an article no recurrence deletes.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hgroup center summary details".split())


def page_host(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def is_name(value: str, names: frozenset = NAMES) -> bool:
    """Whether one of a class or id value's tokens consists of such names and words of layout alone."""
    for token in _TOKEN.findall(value):
        words = {w.lower() for w in _WORD.findall(token)}
        if words & names and words <= NAMES | LAYOUT:
            return True
    return False


class Marked:
    """A parsed page with, for each element: in the main region, fixed (never deleted), named as no main text."""

    def __init__(self, source: str):
        self.page = page = Page(source)
        elements = page.elements
        n = len(elements)
        tags, parents = [e[0] for e in elements], [e[2] for e in elements]
        self.fixed = [False] * n
        inside = [False] * n
        self.heading, self.holds = [False] * n, [False] * n
        self.size = [0] * n  # characters of own text outside links and headings
        link, prose, linked, paragraphs = [False] * n, [False] * n, [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if self.fixed[k] or tags[k] in ("article", "main", "h1", "body", "html"):
                self.fixed[k] = self.fixed[k] or tags[k] != "h1"
                self.fixed[parents[k]] = True
        for k in range(1, n):
            parent = parents[k]
            inside[k] = inside[parent] or tags[k] == "article"
            self.heading[k] = self.heading[parent] or tags[k] in HEADINGS
            link[k] = link[parent] or tags[k] == "a"
            prose[k] = prose[parent] or tags[k] in PROSE
        for i, (t, k) in enumerate(zip(page.tokens, page.owner, strict=True)):
            if i != elements[k][3] and tags[k] not in RAW:
                if link[k]:
                    linked[k] += len(t.strip())
                elif not self.heading[k]:
                    self.size[k] += len(t.strip())
        whole = list(self.size)  # of the subtree, without what is never text
        for k in range(n - 1, 0, -1):
            parent = parents[k]
            self.holds[k] = self.holds[k] or tags[k] in PROSE
            self.holds[parent] |= self.holds[k]
            paragraphs[k] += tags[k] == "p"
            if tags[k] not in NOT_TEXT or tags[k] == "form":
                whole[parent] += whole[k]
                paragraphs[parent] += paragraphs[k]
            linked[parent] += linked[k]

        def most(k: int, of: int) -> bool:
            return paragraphs[k] > 1 and 2 * paragraphs[k] >= paragraphs[of] and 2 * whole[k] >= whole[of]

        self.named = [False] * n
        article = [0] * n  # the outermost article, or the page
        for k in range(1, n):
            tag, attrs = tags[k], elements[k][1]
            article[k] = article[parents[k]] or (k if tag == "article" else 0)
            if tag == "form":
                self.named[k] = not self.fixed[k] and not most(k, article[k])
            elif tag in NOT_TEXT or tag in ARTICLE_ONLY and not inside[k] and not self.fixed[k]:
                self.named[k] = True
            elif attrs and not self.fixed[k] and tag not in ("html", "body", "article", "main"):
                got = page.attributes(k)
                if got.get("role", "").strip().lower() in ROLES or "hidden" in got or got.get("aria-hidden", "").strip().lower() == "true":
                    self.named[k] = True
                elif is_name(value := got.get("class", "") + " " + got.get("id", "")):
                    own = linked[k] > whole[k] if tag in PROSE else True
                    self.named[k] = own and (is_name(value, COMMENTS) or not most(k, article[k]))
        self.gone = [False] * n
        for k in range(1, n):
            self.gone[k] = self.gone[parents[k]] or self.named[k]
        running = [s if p and not g else 0 for s, p, g in zip(self.size, prose, self.gone, strict=True)]
        self.region, self.main = "", [True] * n
        for region in ("article", "main"):
            main = [False] * n
            for k in range(1, n):
                main[k] = main[parents[k]] or tags[k] == region
            if any(m and not g for m, g in zip(main, self.gone, strict=True)) and 2 * sum(s for s, m in zip(running, main, strict=True) if m) >= sum(running):
                self.region, self.main = region, main
                break

    def subtrees(self) -> dict[int, int]:
        """Hashes of the subtrees that may be a template: element -> hash."""
        out = {}
        for k, (tag, _, _, first, end) in enumerate(self.page.elements):
            if k and tag in BLOCK and not self.fixed[k] and end > first + 1 and not (self.region and self.main[k] and self.holds[k]):
                out[k] = self.page.subtree_hash(k)
        return out

    def parts(self) -> Parts:
        """The page's text in blocks, and the subtrees that its host's template may take from it."""
        elements = self.page.elements
        hashes = self.subtrees()
        inner = [0] * len(elements)  # the innermost subtree that an element is in, by its place in ``places``
        places, sizes = {0: 0}, [0]
        for k in range(1, len(elements)):
            inner[k] = inner[elements[k][2]]
            if k in hashes:
                places[k] = inner[k] = len(places)
                sizes.append(0)
        kept = [m and not g for m, g in zip(self.main, self.gone, strict=True)]
        for k, own in enumerate(kept):
            if own:
                sizes[inner[k]] += self.size[k]
        runs = self.page.runs(kept)
        return Parts(
            [t for _, t in runs], [inner[k] for k, _ in runs], [self.heading[k] for k, _ in runs],
            [0, *hashes.values()], [0, *(inner[elements[k][2]] for k in hashes)], [False, *(self.holds[k] for k in hashes)], sizes,
        )

    def text(self) -> str:
        """The page's text as far as its own markup shows it."""
        return self.parts().text()


@dataclass
class Parts:
    """Blocks of text, each with the innermost subtree it is in and whether it is a heading; and subtrees in
    page order, the first of which is the page itself: hash, parent, whether it holds running text, its own text's size."""

    texts: list[str]
    inner: list[int]
    heading: list[bool]
    hashes: list[int]
    parent: list[int]
    holds: list[bool]
    size: list[int]

    def main(self) -> str:
        """What tells a page from its copies: its text without headings."""
        return "\n".join(t for t, h in zip(self.texts, self.heading, strict=True) if not h)

    def text(self, template: set[int] | None = None) -> str:
        gone = self._tops({k for k, h in enumerate(self.hashes) if k and h in template}) if template else [0] * len(self.hashes)
        return "\n".join(t for t, k in zip(self.texts, self.inner, strict=True) if not gone[k])

    def _tops(self, doomed: set[int]) -> list[int]:
        """For each subtree, the outermost one to delete that it is in, or 0; without those that hold most of the text."""
        tops = [0] * len(self.hashes)
        for holds in (True, False, None):
            lost = left = 0
            for k in range(len(tops)):
                tops[k] = k and (tops[self.parent[k]] or (k if k in doomed else 0))
                if not tops[k]:
                    left += self.size[k]
                elif self.holds[tops[k]] == holds:
                    lost += self.size[k]
            if lost > MOST * left:
                doomed = {k for k in doomed if self.holds[k] != holds}
        return tops


#: What ``Parts`` holds, as columns.
_PARTS = "texts array<string>, inner array<int>, heading array<boolean>, hashes array<long>, parent array<int>, holds array<boolean>, size array<long>"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]


def extract(pages: DataFrame, keep_cols: list[str], url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Main text of every page: the columns ``keep_cols``, text, n_chars."""
    bound_batches(pages.sparkSession)
    own_names = [c for c in keep_cols if c.lower() not in ("text", "n_chars")]
    carried = [f"_{k}" for k in range(len(own_names))]  # names that can't clash with those of Parts
    source = pages.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(own_names, carried, strict=True)), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    added = T.StructType.fromDDL(_PARTS)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    of_page = T.StructType([*(source.schema[c] for c in carried), *added.fields])
    schema = T.StructType.fromDDL("part long, host array<long>, main array<long>, hashes array<array<long>>").add("pages", T.ArrayType(of_page))
    n = len(carried)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches, TaskContext.get().partitionId() << 33):
            found = [Marked(html.as_py() or "").parts() for html in batch.column(n + 1)]
            hosts = [xxhash.xxh3_64_intdigest(page_host(url)) >> 1 for url in batch.column(n).to_pylist()]
            mains = [xxhash.xxh3_64_intdigest(parts.main()) >> 1 for parts in found]
            columns = [pa.array([getattr(parts, c) for parts in found], kind) for c, kind in zip(_NAMES, kinds, strict=True)]
            rows = pa.StructArray.from_arrays([*batch.columns[:n], *columns], of_page.names)
            narrow = [pa.array([x], pa.list_(kind)) for x, kind in ((hosts, pa.int64()), (mains, pa.int64()), ([list(dict.fromkeys(parts.hashes)) for parts in found], kinds[3]))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *narrow, pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], schema.names)

    # A row for each batch of pages. Kept, as both the counts and the texts read it. Hash 0 stands for a page itself.
    held, _ = keep_bucketed(source.mapInArrow(parsed, schema), "parts", "part")
    subtrees = held.select("part", F.posexplode(F.arrays_zip("host", "main", "hashes")).alias("place", "page")).select("part", "place", "page.host", "page.main", F.explode("page.hashes").alias("hash"))
    seen = subtrees.groupBy("host", "hash", "main").agg(F.lit(1)).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    often = seen.where(F.col("n") >= min_pages)
    whole = often.where("hash = 0").select("host", F.col("n").alias("whole"))
    template = often.where("hash <> 0").join(whole, "host").where(F.col("n") >= min_share * F.col("whole")).select("host", "hash")
    own = subtrees.join(template, ["host", "hash"]).groupBy("part").agg(F.collect_list(F.struct("place", "hash")).alias("template"))

    result = T.StructType([*(of_page[c] for c in carried), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages_, templates in zip(*batch.columns, strict=True):
                doomed: dict[int, set[int]] = {}
                for x in templates.as_py() or []:
                    doomed.setdefault(x["place"], set()).add(x["hash"])
                fields = pages_.values.flatten()
                found = [Parts(*(x.as_py() for x in row)).text(doomed.get(place)) for place, row in enumerate(zip(*fields[n:], strict=True))]
                yield pa.RecordBatch.from_arrays([*fields[:n], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], result.names)

    # The templates are hashed, not sorted with the pages: so no page is moved or sorted.
    joined = held.join(own.hint("shuffle_hash"), "part", "left").select("pages", "template").mapInArrow(texts, result)
    return joined.select(*(F.col(x).alias(c) for x, c in zip(carried, own_names, strict=True)), "text", "n_chars")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
