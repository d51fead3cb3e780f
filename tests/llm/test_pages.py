"""Main text of pages: against a plain version, and page by page."""

import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

from rivulet.llm.htmltext import extracted, main_text

SMALL = "/root/testdata/sf0.001"
P = "<p>The first paragraph has some words, and then <a href='/x'>a link</a>, and then some more of them.</p><p>Another one follows, of words &amp; marks, with <b>bold</b> ones.</p>"
TEXT = "The first paragraph has some words, and then a link, and then some more of them.\nAnother one follows, of words & marks, with bold ones."
JUNK = [
    "<nav><ul><li><a href=/>Home page of the site</a></li></ul></nav>",
    "<header><h1>Name of the whole site</h1><p>Its motto in a few words</p></header>",
    "<div id='cookie-notice'>We use cookies for many things, and more of them, and you may agree.</div>",
    "<aside class=right><p>A sidebar with several words of its own about other matters.</p></aside>",
    "<div class='sidebarLeft'><p>Another sidebar with several words of its own about other matters.</p></div>",
    "<form action=/s><label>Search</label><input name=q><button>Go</button></form>",
    "<div class='ad-slot'>Buy two of these and get another one for free, today and tomorrow only.</div>",
    "<section id='comments'><h2>Comments</h2><article class='comment'><p>I do not agree with any of this at all.</p></article></section>",
    "<div role=dialog>Sign in to read more of it, please, it takes a minute.</div>",
    "<div hidden>Not shown to anyone, but it has many words, so it would count.</div>",
    "<div style='color: red; display : none'>Not shown either, and it has many words too.</div>",
    "<noscript>Please switch scripts on to see this page as it should be.</noscript>",
    "<script>var x = '<p>no text</p>';</script><style>p { margin: 0 }</style><!-- <p>no text</p> -->",
    "<footer>Rights reserved, imprint, <a href=/c>contact</a></footer>",
]


@pytest.mark.parametrize("body", [f"<article>{P}</article>", f"<main><div>{P}</div></main>", f"<div id=content>{P}</div>", f"<div class='page with-sidebar'><div><div>{P}</div></div></div>", f"<form method=post><div>{P}</div></form>"])
def test_junk_goes_wherever_it_stands(body):
    rng = random.Random(body)
    for k in (0, 1, 4, len(JUNK)):
        for _ in range(6):
            parts = [body, *rng.sample(JUNK, k)]
            rng.shuffle(parts)
            page = f"<!DOCTYPE html><html><head><title>Title</title></head><body>{''.join(parts)}</body></html>"
            assert main_text(page) == TEXT, page
            if "<article>" in body:
                inner = page.replace(P, P + "".join(j for j in rng.sample(JUNK, k) if "<header>" not in j))
                assert main_text(inner) == TEXT, inner


CASES = {
    "null": (None, ""),
    "empty": ("", ""),
    "no element": ("just\n some  words", "just some words"),
    "less than": ("<p>a < b and c <3 d</p>", "a < b and c <3 d"),
    "references": ("<p>&lt;p&gt; &eacute;&#233;&#xe9; &nbsp; x&amp;amp; &copy &unknown; &#55296;&#0;</p>", "<p> ééé x&amp; © &unknown; ��"),
    "space": ("<div>a\n\t b<br>c</div><div>d<span>e</span>f</div>", "a b c\ndef"),
    "open ends": ("<p>one<p>two<ul><li>three<li>four</ul><table><tr><td>five<td>six<tr><td>seven</table>", "one\ntwo\nthree\nfour\nfive\nsix\nseven"),
    "cut": ("<p>one two three</p><p>four <b", "one two three\nfour <b"),
    "open comment": ("<p>one two three</p><!-- four", "one two three"),
    "attributes": ("<p title='a > b' data-x=\"</p>\" class=x>one two</p>", "one two"),
    "upper case": ("<BODY><DIV CLASS=AD>buy this</DIV><ARTICLE><P>one two</P></ARTICLE></BODY>", "one two"),
    "header of article": ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Text of it.</p></article></body>", "Title\nText of it."),
    "short article, long advert": ("<div class=ad>" + "buy this now " * 50 + "</div><article><p>Few words.</p></article>", "Few words."),
    "sections": ("<div><div>" + P + "</div><div>" + P + "</div></div>", TEXT + "\n" + TEXT),
    "two articles": (f"<main><article>{P}</article><article>{P}</article></main>", None),
    "only links": ("<p><a href=/a>one</a> <a href=/b>two</a></p>", "one two"),
    "deep": ("<div>" * 5000 + "one two" + "</div>" * 5000, "one two"),
}


@pytest.mark.parametrize("case", CASES)
def test_page(case):
    page, want = CASES[case]
    if want is not None:
        assert main_text(page) == want
    else:
        assert main_text(page).startswith(TEXT)


class Tree(HTMLParser):
    """Nested lists of well-formed pages: [name, class, children], texts as strings."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["#page", "", []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class", ""), []]
        self.open[-1][2].append(node)
        if tag not in ("br", "img"):
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


INLINE = {"b", "i", "span", "#page"}


def plain_main_text(page):
    """Composite text density, each measure by its own walk."""
    root = Tree(page).root

    def texts(node, linked=False):
        for c in node[2]:
            if isinstance(c, str):
                yield " ".join(c.split()), linked
            else:
                yield from texts(c, linked or c[0] == "a")

    def tags(node):
        return sum(int(c[0] not in INLINE and c[0] != "br") + tags(c) for c in node[2] if not isinstance(c, str))

    def link_tags(node, linked):
        return sum(int((linked or c[0] == "a") and c[0] not in INLINE and c[0] != "br") + link_tags(c, linked or c[0] == "a") for c in node[2] if not isinstance(c, str))

    size = sum(len(t) for t, _ in texts(root))
    share = sum(len(t) for t, a in texts(root) if a) / size if size else 0

    def composite(c, t, lc, lt):
        if not c:
            return 0.0
        base = 1 + math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / max(1, t) * max(0.0, math.log(c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)

    def dense(node, linked):
        linked = linked or node[0] == "a"
        return composite(sum(len(t) for t, _ in texts(node)), tags(node), sum(len(t) for t, a in texts(node, linked) if a), link_tags(node, linked))

    def total(node, linked):
        linked = linked or node[0] == "a"
        own = sum(len(" ".join(c.split())) for c in node[2] if isinstance(c, str))
        return composite(own, 1, own * linked, 1) / max(1, tags(node)) + sum(dense(c, linked) for c in node[2] if not isinstance(c, str))

    def walk(node, linked=False, path=()):
        yield node, linked, (*path, node)
        for c in node[2]:
            if not isinstance(c, str):
                yield from walk(c, linked or node[0] == "a", (*path, node))

    every = list(walk(root))
    value = {id(n): total(n, a) for n, a, _ in every}
    density = {id(n): dense(n, a) for n, a, _ in every}
    best = max((n for n, _, _ in every), key=lambda n: value[id(n)])
    path = next(p for n, _, p in every if n is best)
    above = [density[id(n)] for n in path if density[id(n)] > 0 and n[0] not in ("html", "#page")]
    least = min(above, default=0)
    keep = set()
    for n, _, _ in every:
        if density[id(n)] >= least:
            keep.add(id(max((m for m, _, _ in walk(n)), key=lambda m: value[id(m)])))
    blocks = [""]

    def collect(node, kept):
        kept = kept or id(node) in keep
        block = node[0] not in INLINE and node[0] not in ("a", "br")
        if block:
            blocks.append("")
        for c in node[2]:
            if isinstance(c, str):
                blocks[-1] += c * kept
            else:
                collect(c, kept)
        if block:
            blocks.append("")
        elif node[0] == "br":
            blocks[-1] += " " * kept

    collect(root, False)
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x) if size else ""


def random_page(rng):
    def node(depth):
        name = rng.choice(["div", "div", "section", "ul", "blockquote"] if depth else ["p", "a", "b", "li", "span", "br", "h2"])
        if name == "br":
            return "<br>"
        inner = "".join(node(depth - 1) for _ in range(rng.randrange(0, 4))) if depth else " ".join(rng.choice(["word", "a", "longerword", "x"]) for _ in range(rng.randrange(0, 25)))
        return f"<{name}>{inner}</{name}>" + rng.choice(["", "", " loose words "])

    return "<html><body>" + "".join(node(rng.randrange(0, 4)) for _ in range(rng.randrange(1, 5))) + "</body></html>"


def test_random_pages_against_a_plain_version():
    rng = random.Random(6)
    some = 0
    for _ in range(1500):
        page = random_page(rng)
        assert main_text(page) == plain_main_text(page), page
        some += bool(main_text(page))
    assert some > 1000


def article_of(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_supplied_pages_give_their_articles(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extracted(pages).collect()}
    assert got == {r.page_id: (t := article_of(r.html), len(t)) for r in pages.collect()}


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, block int"
    rows = [(1, "u", P, "x", "y", 1), (1, "u", P, "x", "y", 1), (None, None, None, None, None, None), (2, None, "", None, None, 0)]
    got = sorted(map(tuple, extracted(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=str)
    assert extracted(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<b>" * 50_000 + "<p>x" * 1000, "<a " * 50_000, "<!--" * 50_000, "<script>" * 50_000, "<b><p>" * 30_000 + "x", "<a href='" * 30_000, "x &amp; y<br>" * 100_000])
def test_long_pages_take_time_in_proportion(page):
    begun = time.time()
    main_text(page)
    assert time.time() - begun < 20
