"""URL filters, HTML extraction and WARC derivatives."""

import gzip
import random
import re
import zlib

import pytest
import zstandard

from quillon.llm import html_extract, html_tree, url_filter, warc


def judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, default)


def test_urls_equal_brute_force(spark):
    r = random.Random(5)
    hosts = ["org", "example.org", "www.example.org", "a.b.example.org", "xexample.org", "com", "x.com", "example.org.", "ORG", "Example.ORG:80", "", "net", "a..org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/#a", "/de/x", "?q=//y://z/", "/es/a/b", "#f/es/", "/é"]
    urls = [None, "", "no scheme", "://", "http://", *(f"{s}://{h}{p}" for s in ("http", "a://b", "") for h in hosts for p in paths)] + ["http://x.com/fr/" + "y" * 5000] * 40
    rules = [*url_filter.RULES, ("example.org", "/", "block"), ("example.org", "/es/a", "allow"), ("b.example.org", "/es", "allow"), ("x.com", "", "allow"), ("com", "/fr/", "block"), ("", "/", "block")]
    r.shuffle(urls)
    df = spark.createDataFrame([(i % 50 or None, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = sorted(map(repr, map(tuple, url_filter.filter_urls(df, url_filter.rules_frame(spark, rules), ["page_id"]).collect())))
    own = [x for x in rules if x[0]]
    assert got == sorted(repr((i % 50 or None, u, *judge(u, own))) for i, u in enumerate(urls))
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_frame(spark, rules), ["page_id"]).count() == 0
    assert url_filter.filter_urls(df, url_filter.rules_frame(spark, []), ["page_id"], default="block").where("verdict = 'allow'").count() == 0


def test_url_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string").repartition(2)
    plan = url_filter.filter_urls(df, url_filter.rules_frame(spark, url_filter.RULES), ["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("<p>One<p>two <b>bold</b>&amp;<br>x", ["One", "two bold& x"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
        ("<p>a<!-- <p>no</p> -->b</p>", ["ab"]),
        ('<p title="a>b">x</p><p>1 < 2 &lt; 3</p>', ["x", "1 < 2 < 3"]),
        ("<div>a<p>b</div>c", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a &nbsp; b &#233; &eacute;", ["a b é é"]),
        ("<!-- never ends <p>x", []),
        ("", []),
    ],
)
def test_blocks(source, blocks):
    assert html_tree.Page(source).blocks() == blocks


def test_subtree_hash_ignores_attributes_only():
    def h(source):
        page = html_tree.Page(source)
        return page.subtree_hash(1)

    assert h("<div class=a><i>x</i> y</div>z") == h("<div id='q'><i>x</i> y</div>")
    assert len({h(x) for x in ("<div>x y</div>", "<div><i>x</i> y</div>", "<div><b>x</b> y</div>", "<nav>x y</nav>", "<div>x z</div>")}) == 5


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{nav}<div id="main-menu">M</div>
<article><header><h1>Head {n}</h1></header><p>Text {n} &amp; more.<p>Again.</p><div class="share">Share</div><aside>side</aside><form>f</form>
<section class="comments"><p>nice</p></section></article><footer>foot</footer></body></html>"""


def test_article_without_its_surroundings(spark):
    rows = [(n, f"http://h{n % 2}.org/{n}", PAGE.format(nav="<nav>N</nav>", n=n)) for n in range(6)] + [(6, None, None), (7, "x", ""), (7, "x", "")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect())
    expected = [(n, f"Head {n}\nText {n} & more.\nAgain.") for n in range(6)] + [(6, ""), (7, ""), (7, "")]
    assert got == [(i, t, len(t)) for i, t in expected]


def test_template_of_a_site_is_removed(spark):
    """Unnamed blocks that recur over a host's pages go; the same block on another host's few pages stays, and prose in articles always."""
    page = "<body><div><div>Our motto</div></div><div><p>Story {n}</p><p>Told often.</p></div><div>Bye</div></body>"
    article = "<body><div>Our motto</div><article><p>Told often.</p><p>{n}</p></article></body>"
    rows = [(n, "http://a.org/", page.format(n=n)) for n in range(8)] + [(100, "http://b.org/", page.format(n=100))] + [(200 + n, "http://c.org", article.format(n=n)) for n in range(8)] + [(300 + n, "http://d.org", page.format(n="same")) for n in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert all(got[n] == f"Story {n}" for n in range(8))
    assert got[100] == "Our motto\nStory 100\nTold often.\nBye"
    assert all(got[200 + n] == f"Told often.\n{n}" for n in range(8))
    assert got[300] == "Our motto\nStory same\nTold often.\nBye"  # copies of one page are no template


def test_recurring_article_text_stays(spark):
    """Near copies of an article, also without an article element, and text that a few of many pages share."""
    same = "The same text in all copies of this article, told once more."
    article = "<body><article><h1>Title {n}</h1><div class='body'><p>" + same + "</p></div></article></body>"
    bare = "<body><h1>Title {n}</h1><div><p>" + same + "</p></div><p>No. {n}</p></body>"
    few = "<body><h1>Title {n}</h1><p>Own story {n}, long enough to stand beside what is quoted.</p>{quote}</body>"
    teaser = "<body><h1>Title {n}</h1><div><p>" + same + "</p><p>It goes on for page {n}.</p></div><article><p>Read on</p></article></body>"
    rows = [(n, "http://a.org/", article.format(n=n)) for n in range(5)] + [(100 + n, "http://b.org/", bare.format(n=n)) for n in range(5)]
    rows += [(200 + n, "http://c.org/", few.format(n=n, quote=f"<p>{same}</p>" if n < 5 else "")) for n in range(20)] + [(300, "http://d.org/", teaser.format(n=1))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert all(got[n] == f"Title {n}\n{same}" for n in range(5))
    assert all(got[100 + n] == f"Title {n}\n{same}\nNo. {n}" for n in range(5))
    assert all(got[200 + n].endswith(same) == (n < 5) for n in range(20))
    assert got[300] == f"Title 1\n{same}\nIt goes on for page 1.\nRead on"


def test_deep_and_broken_pages_end():
    assert html_extract.Marked("<div>" * 100_000 + "x").text() == "x"
    assert html_extract.Marked("<a " * 2000 + "'" + "<p>y").text() is not None


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.org/x", "<html><head><title> T  t</title></head><body><a href='/y?a=1'>l</a><p>A &amp; B</p><script>s</script></body></html>"), (2, None, None), (3, "http://b.org", "é\r\n\r\nWARC/1.1\r\n"), (3, "http://b.org", "é\r\n\r\nWARC/1.1\r\n")]
    sources = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    made = warc.derive(sources)
    by = {(r.page_id, r.warc_type): r for r in made.collect()}
    ids = {r.page_id: r for r in sources.collect()}
    assert made.count() == 8 and all(r.refers_to == ids[k[0]].record_id and r.date == ids[k[0]].date for k, r in by.items())
    conversion, meta = by[1, "conversion"], by[1, "metadata"]
    assert conversion.payload.decode() == "l\nA & B" and conversion.headers["WARC-Source-Payload-Digest"] == ids[1].headers["WARC-Payload-Digest"]
    assert "title: T t\r\n" in meta.payload.decode() and "outlink: http://a.org/y?a=1\r\n" in meta.payload.decode() and "http-status: HTTP/1.1 200 OK" in meta.payload.decode()
    for r in by.values():
        assert r.headers["WARC-Block-Digest"] == warc.digest(r.payload)
    everything = sources.unionByName(made)
    members = [r.member for r in warc.serialise(everything).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    back = warc.parse(spark, str(tmp_path)).collect()
    key = lambda r: (r.warc_type, r.record_id, r.target_uri, r.date, r.refers_to, sorted(r.headers.items()), r.http_headers, bytes(r.payload))
    assert sorted(map(repr, map(key, back))) == sorted(map(repr, map(key, everything.collect())))
    assert warc.derive(made).count() == 0 and warc.derive(sources.limit(0)).count() == 0


def test_broken_warc_is_an_error():
    for data in (b"nonsense", b"WARC/1.1\r\nWARC-Type: x\r\n\r\nabc", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError, match="at byte 0"):
            list(warc.from_bytes(data))


def test_text_payloads_and_others():
    def made(kind, payload=b"x"):
        return warc.derive_one(("response", "<urn:uuid:1>", "http://a", "d", None, [], f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n", payload))

    assert [r[0] for r in made("text/plain")] == ["metadata", "conversion"] and [r[0] for r in made("image/png")] == ["metadata"]
    assert made("text/plain; charset=latin-1", b"\xe9")[1][7].decode() == "é" and made("text/plain; charset=zzz")[1][7] == b"x"


def test_repeated_and_further_fields_are_kept():
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nSet-Cookie: a=1\r\nVary: x\r\nSet-Cookie: b=2\r\n\r\n"
    block = http.encode() + b"hello"
    source = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a\r\nWARC-Date: d\r\nWARC-Concurrent-To: <urn:uuid:2>\r\nWARC-Concurrent-To: <urn:uuid:3>\r\n"
    source += b"WARC-Truncated: length\r\nX-Own: y\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (read,) = warc.from_bytes(source)
    again = warc.to_bytes(read)
    assert again.count(b"WARC-Concurrent-To: ") == 2 and list(warc.from_bytes(again)) == [read]
    metadata, conversion = warc.derive_one(read)
    assert b"http-header-set-cookie: a=1\r\nhttp-header-vary: x\r\nhttp-header-set-cookie: b=2\r\n" in metadata[7]
    for made in (metadata, conversion):
        fields = dict(made[5])
        assert fields["X-Own"] == "y" and fields["WARC-Source-Truncated"] == "length" and "WARC-Truncated" not in fields
        assert warc.to_bytes(made).count(b"WARC-Concurrent-To: ") == 2


TEXT = "<p>Grüße an alle</p>" * 9


@pytest.mark.parametrize(
    ("fields", "payload"),
    [
        ("Content-Encoding: gzip", gzip.compress(TEXT.encode())),
        ("Content-Encoding: gzip", gzip.compress(TEXT[:40].encode()) + gzip.compress(TEXT[40:].encode())),
        ("Content-Encoding: deflate", zlib.compress(TEXT.encode())),
        ("Content-Encoding: deflate", zlib.compress(TEXT.encode())[2:-4]),
        ("Content-Encoding: zstd", zstandard.compress(TEXT.encode())),
        ("Transfer-Encoding: chunked", b"5;x=y\r\n" + TEXT.encode()[:5] + b"\r\n%x\r\n" % (len(TEXT.encode()) - 5) + TEXT.encode()[5:] + b"\r\n0\r\n\r\n"),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n" % len(gzip.compress(TEXT.encode(), mtime=0)) + gzip.compress(TEXT.encode(), mtime=0) + b"\r\n0\r\n\r\n"),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", TEXT.encode()),
    ],
)
def test_encodings_are_undone(fields, payload):
    made = warc.derive_one(("response", "<urn:uuid:1>", "http://a", "d", None, [], f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{fields}\r\n\r\n", payload))
    assert made[1][7].decode() == "\n".join(["Grüße an alle"] * 9)


def test_unknown_encoding_gives_no_text():
    made = warc.derive_one(("response", "<urn:uuid:1>", "http://a", "d", None, [], "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: br\r\n\r\n", b"\x8b\x01"))
    assert [r[0] for r in made] == ["metadata"]


@pytest.mark.parametrize(
    "body",
    [
        '<div style="overflow: hidden"><p>Kept words.</p></div>',
        '<p title="the hidden key">Kept words.</p>',
        '<p title="role=menu">Kept words.</p>',
        '<p class="notice-period">Kept words.</p>',
        '<p id="social-history">Kept words.</p>',
        '<section class="related-work"><p>Kept words.</p></section>',
        '<table class="promo"><tr><td>Kept words.</td></tr></table>',
        '<h2 class="banner">Kept words.</h2>',
        '<div class="content sidebar"><p>Kept</p><p>words.</p></div>',
        "<p title=it's data-x='class=ad'>Kept words.</p>",
    ],
)
@pytest.mark.parametrize("page", ["<body><nav>N</nav><article><h1>Head</h1>{}</article><footer>F</footer></body>", "<body><nav>N</nav><h1>Head</h1>{}<footer>F</footer></body>", "<form><article><h1>Head</h1>{}</article></form>"])
def test_text_is_not_lost_to_names(body, page):
    assert " ".join(html_extract.Marked(page.format(body)).text().split()) == "Head Kept words."


@pytest.mark.parametrize(
    "extra",
    [
        '<div class="ad">Buy</div>', '<div class="ad-slot ad-12">Buy</div>', '<div id="cookieNotice"><p>Cookies</p></div>', '<ul class="share-buttons"><li><a href="x">Share</a></ul>', "<div class='sidebar left'><p>Side</p></div>",
        "<section id=reader-comments><p>One</p><p>Two</p><p>Three</p><p>Four</p></section>", "<div hidden><p>H</p></div>", '<div role="navigation">M</div>', "<aside><h1>S</h1></aside>", '<p class="newsletter"><a href="/n">Sign up</a></p>',
    ],
)
def test_named_extras_go(extra):
    for page in ("<body><article><h1>Head</h1><p>Words.</p>{}<p>More.</p></article></body>", "<body><h1>Head</h1><p>Words.</p>{}<p>More.</p></body>"):
        assert html_extract.Marked(page.format(extra)).text() == "Head\nWords.\nMore."


def test_attributes():
    assert html_tree.attributes(" class = 'a b' ID=x hidden data-id=\"y\" class=z checked/") == {"class": "a b", "id": "x", "hidden": "", "data-id": "y", "checked": ""}


def test_extract_of_nothing_and_with_clashing_names(spark):
    names = ["key", "_key", "host", "main", "texts", "inner", "size", "_html", "_0", "template", "text", "n_chars", "page_id"]
    df = spark.createDataFrame([(*range(12), None, "u", "<p>a</p>"), (*range(12), 1, None, None)], ", ".join(f"`{n}` long" for n in names) + ", url string, html string")
    got = html_extract.extract(df, names)
    assert sorted(got.columns) == sorted(names) and sorted((r.page_id or 0, r.text, r.n_chars, r.key, r._html, r["_0"]) for r in got.collect()) == [(0, "a", 1, 0, 7, 8), (1, "", 0, 0, 7, 8)]
    assert html_extract.extract(df.limit(0), names).collect() == []


def brute_template(pages, most=html_extract.MOST):
    """Pages are (host, heading, divs), a div a text or a list of such; gives each page's text by definition."""
    def subtrees(divs):
        for d in divs:
            yield repr(d)
            if isinstance(d, list):
                yield from subtrees(d)

    def flat(divs, doomed=frozenset()):
        return [t for d in divs if repr(d) not in doomed for t in ([d] if isinstance(d, str) else flat(d, doomed))]

    out = []
    for host, heading, divs in pages:
        own = {(tuple(flat(x)), tuple(set(subtrees(x)))) for h, _, x in pages if h == host}
        distinct = {main for main, _ in own}
        on = {s: len({main for main, has in own if s in has}) for s in subtrees(divs)}
        template = {s for s, n in on.items() if n >= html_extract.MIN_PAGES and n >= html_extract.MIN_SHARE * len(distinct)}
        left, every = flat(divs, template), flat(divs)
        lost = sum(map(len, every)) - sum(map(len, left))
        out.append("\n".join([heading, *(every if lost > most * sum(map(len, left)) else left)]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_equal_brute_force(spark, seed):
    r = random.Random(seed)
    banners = [f"banner {k}" for k in range(6)] + [["menu", ["deep", f"d{k}"]] for k in range(3)]

    def html(d):
        return f"<div>{d}</div>" if isinstance(d, str) else "<div>" + "".join(map(html, d)) + "</div>"

    pages = []
    for k in range(80):
        divs = r.sample(banners, r.randint(0, 4)) + [r.choice([f"own text of page {k}", f"text {k % 3}", f"a longer text of page number {k} with more words"])]
        r.shuffle(divs)
        pages.append((f"h{r.randrange(4)}.org", f"Page {k}", divs))
    rows = [(k, f"http://{h}/{k}", f"<body><h1>{t}</h1>{''.join(map(html, d))}</body>") for k, (h, t, d) in enumerate(pages)]
    got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert [got[k] for k in range(len(pages))] == brute_template(pages)


def test_warc_files_are_read_in_pieces():
    rows = [("response", f"<urn:uuid:{k}>", "http://a", "d", None, [("X", "y")], "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", bytes([k % 256]) * (k * 997 % 200_000)) for k in range(40)]
    plain = b"".join(map(warc.to_bytes, rows))
    for data in (plain, gzip.compress(plain), b"".join(gzip.compress(warc.to_bytes(r)) for r in rows)):
        got = [(*r[:5], [("Content-Type", "x")][:0] + r[5], r[6], r[7]) for r in warc.from_bytes(data)]
        assert [r[1] for r in got] == [r[1] for r in rows]
        assert [(r[6] or "").encode() + r[7] for r in got] == [(r[6] or "").encode() + r[7] for r in rows]
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.from_bytes(plain[:-300_000]))
    assert list(warc.from_bytes(b"")) == []


def test_hosts_of_many_labels_make_few_probes(spark):
    host = ".".join("abcde"[k % 5] for k in range(5000)) + ".example.org"
    df = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, f"http://{host}/q")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, url_filter.RULES), ["page_id"]).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow")}


def test_warc_names_in_any_case_folded_lines_and_kept_digests():
    block = b"HTTP/1.1 200 OK\r\nContent-TYPE: text/html;\r\n charset=utf-8\r\nX-Long: a\r\n\tb\r\n\r\n<head><title>A &amp; B</title></head><a href='/x?a=1&amp;b=2'>Caf&eacute;</a>"
    head = f"WARC/1.1\r\nwarc-type: response\r\nWarc-Record-Id: <urn:uuid:1>\r\nwarc-TARGET-uri: http://h.org/\r\nwarc-date: 2024-01-01T00:00:00Z\r\ncontent-type: Application/HTTP; msgtype=response\r\nwarc-payload-digest: sha1:KEPT\r\nX-Own: one\r\n two\r\nx-own: three\r\nCONTENT-length: {len(block)}\r\n\r\n"
    (record,) = warc.from_bytes(head.encode() + block + b"\r\n\r\n")
    assert record[:5] == ("response", "<urn:uuid:1>", "http://h.org/", "2024-01-01T00:00:00Z", None)
    assert dict(record[5]) == {"Content-Type": "Application/HTTP; msgtype=response", "WARC-Payload-Digest": "sha1:KEPT", "X-Own": "one two\nthree"}
    metadata, conversion = warc.derive_one(record)
    lines = metadata[7].decode().splitlines()
    assert "title: A & B" in lines and "outlink: http://h.org/x?a=1&b=2" in lines and "http-header-x-long: a b" in lines and "payload-digest: sha1:KEPT" in lines
    assert all(dict(r[5])["WARC-Source-Payload-Digest"] == "sha1:KEPT" and r[4] == "<urn:uuid:1>" for r in (metadata, conversion)) and conversion[7].decode() == "Café"
    spelt = (*record[:5], [("Content-Type", "application/http"), ("warc-payload-digest", "sha1:LOWER")], *record[6:])
    assert dict(warc.derive_one(spelt)[0][5])["WARC-Source-Payload-Digest"] == "sha1:LOWER"
    assert [warc.to_bytes(r) for r in warc.from_bytes(warc.to_bytes(record))] == [warc.to_bytes(record)]


def test_warc_query_by_brute_force(spark, data):
    """Ids, digests, lengths and links of every record, worked out again from the pages."""
    import base64
    import hashlib
    import html as markup
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()}
    got = warc.op5_warc(spark, data).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        page = pages[r.page_id]
        block, source = r.content.encode(), (page.html or "").encode()
        sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        fields = dict(line.split(": ", 1) for line in r.headers.split("\n"))
        assert (r.target_uri, fields["WARC-Block-Digest"], fields["WARC-Source-Payload-Digest"], r.content_length) == (page.url, sha1(block), sha1(source), len(block))
        if r.warc_type == "metadata":
            title = re.search(r"(?is)<title[^>]*>(.*?)</title", page.html or "")
            assert f"payload-length: {len(source)}" in r.content and (not title or f"title: {' '.join(markup.unescape(title[1]).split())}" in r.content)
