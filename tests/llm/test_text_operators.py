"""Operators that look at one text at a time: token counts, language, quality, pages, archives."""

import gzip
import random
import re
from collections import Counter

import pytest
from framescope.llm import html_extract, language_id, quality, token_counts, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, extra string, Size long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)


# -- token counts

@pytest.fixture(scope="module")
def pieces():
    from framescope.llm.common import public_tokenizer
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizer(token_counts.DEFAULT_MODEL)
    return token_counts.PrefixCounter(path), SentencePieceProcessor(model_file=path)


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "   a\n\n  b", "é\tß 漢字 x", "\n", "▁a▁▁b", "aaaaaaa aaaa", "<s> </s> <unk>", " " * 40 + "x", "\x00a", "😀😀 a"]


def test_counts_and_prefixes_are_the_librarys(pieces):
    counter, library = pieces
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab eti\n▁é漢 .<sn/>") for _ in range(rng.randint(1, 25))) for _ in range(400)]
    for t in texts:
        assert counter.count(t) == len(library.encode(t)), t
    for t in texts[:120]:
        assert counter.prefixes(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)], t


def test_token_counts_rows(spark, pieces):
    _, library = pieces
    long_text = "word of many " * 20_000
    rows = [(1, None, None, None), (1, "", "en", "a"), (None, "some text", "en", None), (4, long_text, None, "a"), (4, long_text, None, "a")]
    found = token_counts.token_counts(docs(spark, rows)).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _, _ in rows]
    assert Counter(map(tuple, found)) == Counter(want)
    assert token_counts.token_counts(docs(spark, [])).collect() == []


def test_truncation_reads_the_prefix_table(spark, pieces):
    counter, library = pieces
    text = "Einst lichlich chkeit achieung, schenge schheit. " * 5
    cut = token_counts.truncate(docs(spark, [(1, text, None, None), (2, None, None, None)]), 17).collect()
    want = max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 17)
    assert (cut[0].text, cut[1].text, cut[1].n_tokens) == (text[:want], None, 0)
    ends = token_counts.budget_positions(docs(spark, [(1, text, None, None)]), 10).first().ends
    assert ends[-1] == len(text) and all(len(library.encode(text[:e])) <= 10 * (k + 1) for k, e in enumerate(ends))


# -- language

def test_language_of_held_out_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(table.filter("doc_id % 5 != 0"))
    found = language_id.predict(table.filter("doc_id % 5 = 0"), model, keep=(table.lang, table.doc_id)).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all() and sorted(model) == ["de", "en", "es", "fr"]


def test_language_of_odd_rows(spark):
    rows = [(1, "the thing of and the", "en", None), (2, "le la des eaux queue", "fr", None), (3, None, "en", "a"), (4, "12 !! 34", None, "a"), (None, "the thing", None, None), (None, "the thing", None, None), (6, "", "fr", None)]
    table = docs(spark, rows)
    model = language_id.train(table)
    found = {(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.predict(table, model, keep=(table.doc_id,)).collect()}
    assert found == {(1, "en", True), (2, "fr", True), (3, "und", False), (4, "und", False), (None, "en", True), (6, "und", False)}
    empty = language_id.train(docs(spark, []))
    assert empty == {} and [r.lang_pred for r in language_id.predict(table.filter("doc_id = 1"), empty).collect()] == ["und"]


def test_profile_is_the_bundle_of_bound_letters():
    import numpy as np

    maker = language_id.Profiles()
    text = "Ab ca"
    letters = [0, *(maker.number[ord(c)] for c in "ab"), 0, *(maker.number[ord(c)] for c in "ca"), 0]
    want = sum(maker.rotated[2][letters[k]].astype(int) * maker.rotated[1][letters[k + 1]] * maker.rotated[0][letters[k + 2]] for k in range(len(letters) - 2))
    assert (maker.profiles([text])[0] == want).all() and not maker.profiles(["1 2"]).any()
    assert np.abs(maker.rotated[0][1] @ maker.rotated[1][1].astype(int)) < 200


# -- quality

def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(lines), len(covered)


def test_quality_counts_are_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "\n\n", "a", "a b", "a b c a b c", "x y #|<>", "a\x0bb\x1cc\x85d", "same\nsame\n\n same\nsame"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "$%&"]) for _ in range(60)]
    table = docs(spark, [(k, t, None, "s") for k, t in enumerate(texts)])
    counted, named = quality.with_counts(table)
    got = {r.doc_id: tuple(r[named[c]] for c in quality.COUNTS) for r in counted.collect()}
    assert got == {k: brute_counts(t) for k, t in enumerate(texts)}


def test_fences_follow_their_group(spark):
    rng = random.Random(3)

    def prose(length):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(length)) for _ in range(80))

    rows = [(k, prose(5), "en", "plain") for k in range(120)] + [(1000 + k, prose(12), None, None) for k in range(120)]
    rows += [(2000, prose(12), "en", "plain"), (2001, "### " * 80, "en", "plain"), (2002, "few words", "en", "plain"), (2003, None, "en", "plain"), (2004, prose(12), "xx", "rare")]
    table = docs(spark, rows)
    kept = {r.doc_id for r in quality.quality(table).collect() if r.kept}
    # long words are odd in one group (2000) and usual in the other; a small group (2004) takes the fences of all
    assert kept == {k for k in range(120)} | {1000 + k for k in range(120)} | {2004}
    again = quality.keep_good(table)
    assert again.columns == table.columns and {r.doc_id for r in again.collect()} == kept
    assert quality.quality(docs(spark, [])).collect() == []


# -- pages

PAGE = """<!doctype html><html><head><title>x</title><style>p{}</style></head><body class="home"><header><a href=/>Site</a><p>Tagline here for the site.</p></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies to improve your experience. Accept all of them now please.</p></div>
<main><article><header><h1>The title</h1></header><p>First paragraph with <a href=x>a link</a> &amp; entity&nbsp;x.<p>Second<br>line.<ul><li>item one<li>item two</ul>
<div class="ad">Buy now! This is great and very long text to fool the classifier. Indeed it is.</div><p>Third.</p><table><tr><td>a<td>b</table><aside>Related stuff.</aside></article>
<section id="comments"><h2>Comments</h2><p>I liked this article very much, thanks for writing it all down so well!</p></section></main>
<div class="sidebar"><p>Popular posts this week are these ones, long text long text.</p></div><form><label>Email</label><input><button>Go</button></form>
<footer><p>Copyright by nobody. All rights reserved, and so on.</p></footer><script>var x="<p>no</p>"</script></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "<p>unclosed <b>bold"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<"), (6, "u", "<article>" + "<p>long text.</p>" * 3000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    found = html_extract.extract(table).collect()
    texts = Counter((r.page_id, r.text) for r in found)
    want = "The title\nFirst paragraph with a link & entity x.\nSecond line.\nitem one\nitem two\nThird.\na\nb"
    assert texts[(1, want)] == 1 and texts[(2, "")] == 1 and texts[(None, "")] == 1 and texts[(4, "unclosed bold")] == 2 and texts[(5, "")] == 1
    assert texts[(6, "\n".join(["long text."] * 3000))] == 1 and all(r.n_chars == len(r.text) for r in found)


def test_minimum_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 7)
        ends = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        joined = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(n)]
        joined = [(a, b, c) for a, b, c in joined if a != b]

        def cost(side):
            return sum(b if s else a for s, (a, b) in zip(side, ends)) + sum(c for a, b, c in joined if side[a] != side[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert cost(html_extract.minimum_cut(ends, joined)) == best


def test_templates_of_the_pages_table(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html_extract.unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert found[r.page_id] == "\n".join(x for x in parts if x)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div><svg viewBox='0 0 1 1'/>one<p>two</p></div><p>three</p>", ["one", "two", "three"]),
        ("<p>a <math/> b</p><svg><path d='x'/><g/></svg><p>c", ["a b", "c"]),
        ("<p>a <svg><title>no</title><g><text>no</text></g></svg> b</p>", ["a b"]),
        ("<p>a <script>if (x < 1) y('<p>no</p>')</script>b <noscript><img src=x></noscript>c</p><p>d", ["a b c", "d"]),
        ("<div><noscript>no</div><p>a</p><noscript>no</noscript><p>b", ["a", "b"]),
        ("<div><iframe src=x></div><p>a</p>", ["a"]),
        ("<div><template><p>no</div><p>a</p>", ["a"]),
        ("<div><script>no</div><p>a</p>", ["a"]),
        ("<p>a</p><svg><path d=x><p>b</p><svg><svg></svg></svg><p>c", ["a", "b", "c"]),
        ("<p>a <svg><path d=x></p><p>b</p>", ["a", "b"]),
        ("<svg><foreignObject><p>no</p></foreignObject></svg><p>a", ["a"]),
        ("<p>x <a href=1><svg></svg>y</a> z <canvas>no</canvas></p>", ["x y z"]),
        ("<html><head><title>no<body><p>a", ["a"]),
        ("<p>a <b>b<template>no</b> c</p><p>d", ["a b c", "d"]),
    ],
)
def test_unshown_parts_swallow_nothing_else(html, want):
    found = html_extract.blocks(html)
    assert [b.text for b in found] == want
    assert all(b.tag != "html" for b in found if b.text in ("a b", "a b c", "x y z", "d"))


PROSE = "A sentence of an article that says something at some length, with a comma and an end. " * 3


@pytest.mark.parametrize(
    "layout",
    [
        "<article class='post has-sidebar'>{}</article>", "<div id='content' class='sidebar-right'>{}</div>", "<main class='page with-comments'>{}</main>", "<div id='content-with-sidebar'>{}</div>",
        "<article data-hidden='false'>{}</article>", "<article title='hidden gems'>{}</article>", "<article data-id='comments-4'>{}</article>", "<div data-testid='x' data-class='sidebar' data-role='banner'>{}</div>",
        "<div class='sidebar-layout'><article>{}</article></div>", "<div class='related notice'><main>{}</main></div>", "<div class='social-page'><div class='entry-content'>{}</div></div>",
        "<article class='post'><div class='post-header'>{}</div></article>",
    ],
)
def test_names_do_not_hide_articles(layout):
    assert html_extract.main_text(layout.format(f"<p>{PROSE}</p><p>{PROSE}</p>")) == "\n".join([PROSE.strip()] * 2)


@pytest.mark.parametrize("name", ["class='main-header'", "id='header-content'", "class='sidebar-right'", "class='comment-body'", "class='footer'", "hidden", "aria-hidden='true'", "role='banner'", "class='cookieNotice'"])
def test_names_still_tell_boilerplate(name):
    page = f"<div {name}><p>All the topics of this site, day by day.</p></div><article><p>{PROSE}</p></article>"
    assert html_extract.main_text(page) == PROSE.strip()


def test_a_link_goes_on_behind_a_picture():
    block, = html_extract.blocks("<p><a href=1>one<svg><g/></svg>two</a> end</p>")
    assert (block.text, block.linked, block.tag) == ("onetwo end", 6, "p")


def test_the_query_joins_blocks_by_two_line_breaks(spark):
    from framescope.llm import queries

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op9_html_extraction(spark, SF).collect()}
    want = {r.page_id: html_extract.main_text(r.html).replace("\n", "\n\n") for r in pages.collect()}
    assert {i: r.text for i, r in got.items()} == want and any("\n\n" in t for t in want.values())
    assert all(r.n_chars == len(r.text) for r in got.values())


# -- archives

def test_archive_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>Text &amp; more</p>"), (2, None, None), (None, "http://c", ""), (4, "http://d", "<p>x"), (4, "http://d", "<p>x")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string")
    records = warc.responses(pages)
    made = warc.derive(records)
    every = records.unionByName(made)
    members = [r.member for r in warc.archive_members(every).collect()]
    want = [{k: bytes(v) if k == "block" else v for k, v in r.asDict().items() if k != "page_id"} for r in every.collect()]
    got = warc.read_members(b"".join(members))
    assert sorted(map(repr, map(lambda d: sorted(d.items()), got))) == sorted(map(repr, map(lambda d: sorted(d.items()), want)))
    sources = {r.record_id: r for r in records.collect()}
    derived = made.collect()
    assert len(derived) == 2 * len(rows) and all(r.refers_to in sources and r.payload_digest == sources[r.refers_to].payload_digest for r in derived)
    about = next(bytes(r.block).decode() for r in derived if r.page_id == 1 and r.warc_type == "metadata")
    assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in about and "http-status: HTTP/1.1 200 OK" in about
    assert [bytes(r.block) for r in derived if r.page_id == 1 and r.warc_type == "conversion"] == [b"Text & more"]
    assert warc.derive(warc.responses(pages.filter("page_id = 99"))).collect() == [] and warc.derive(made).collect() == []


def test_bodies_are_decoded():
    body = gzip.compress("<p>é</p>".encode("latin-1"))
    chunked = b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX-Long: a\r\n b\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + chunked
    about, text = warc.derived("<urn:uuid:1>", "http://a", "2020-01-01T00:00:00Z", block, None)
    assert text[-1] == "é".encode() and b"http-header: X-Long: a b" in about[-1]
    assert warc.plain_text("image/png", b"\x89PNG") == "" and warc.plain_text("text/plain", b"a\nb") == "a\nb"
    assert warc.decoded([("Content-Encoding", "gzip")], b"broken")[0] == b"broken"


# -- plain layouts and long or broken pages

@pytest.mark.parametrize("page, want", [
    ("<body><nav><a href=/>Home</a></nav><div id=c>{0}</div><footer>Imprint</footer></body>", 1),
    ("<body>" + "<p>A first sentence that stands here.</p><div><a href=x>Read more</a></div>" * 6 + "</body>", 6),
    ("<body><form action=/><div class=top><a href=/>Home</a></div><p>{0}</p><p>{0}</p><input name=q></form></body>", 2),
    ("<body><p>{0}</p><form><label>Your name, please.</label><p>Write to us, we answer soon.</p></form></body>", 1),
])
def test_plain_layouts_keep_their_text(page, want):
    sentences = "One sentence follows another here, and no name says so. " * 5
    got = html_extract.main_text(page.format(sentences)).split("\n")
    assert len(got) == want and all(t in (sentences.strip(), "A first sentence that stands here.") for t in got)


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a x " * 200_000 + "\">\"", "<a '\">" * 100_000, "<div>" * 50_000 + "text" + "</span>" * 50_000, "<b><div>" + "<div>" * 50_000 + "</b>" * 50_000 + "x",
    "".join(f"<p>Short {k}.</p><div>x</div>" if k % 3 else f"<li>A longer one that stays {k}.</li>" for k in range(25_000)),
    "".join(f"<div>{'word ' * (k % 37)}</div>" for k in range(50_000)),
    "<b>" * 50_000 + "<p>x</p>" * 10_000, "<!-- " * 100_000, "<title>" * 50_000,
])
def test_reading_takes_time_in_proportion(page):
    import time

    start = time.time()
    html_extract.main_text(page)
    assert time.time() - start < 15
