"""HTML extraction: pages with a known article, densities against their definition, and hostile markup."""

import math
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from molspark.llm import html

LONG = "Some long text of the article. " * 9


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<html><head><title>t</title><script>if (a<b) x()</script></head><body><nav><a href=1>Home</a></nav><article><h1>A  title</h1><p>One\n two &eacute;<b>bold</b><p>Three<br>four</article>"
     "<div class='sidebar'>side text here</div><footer>foot</footer></body></html>", "A title One two ébold Three four"),
    (f"<body><div id=main><p>{LONG}</p></div><div class='comments'><p>I disagree with it.</p></div><form><p>Sign up now</p></form></body>", LONG.strip()),
    ("<body><main><header><h1>Own header</h1></header><p>Text</p></main><header>Site</header></body>", "Own header Text"),
    ("<p>a</p></p><div>b", "a b"), ("<!-- x --><p>unclosed <i>tags", "unclosed tags"),
    # self-closed and unclosed elements that hold no text don't swallow what follows
    ('<p>First..</p><svg width="1"/><p>Second..</p>', "First.. Second.."), ("<p>First</p><select><option>o<p>Second</p>", "First Second"),
    ('<p>First</p><svg><path d=""><p>Second</p>', "First Second"), ("<p>First</p><iframe src=x><p>Second</p>", "First Second"), ("<p>First</p><math><p>Second</p>", "First Second"),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>", "a x=1 b"),
    # names don't delete what an article holds
    ('<article><div class="post-header"><h1>T</h1><p>Lead..</p></div><section class="social-history"><p>Long text of history here.</p></section><p>Body text.</p></article>',
     "T Lead.. Long text of history here. Body text."),
    ('<p class="share-price">Price rose.</p><p>And more text here.</p>', "Price rose. And more text here."),
    ('<article><h2 id="related-work">Related work</h2><section id="discussion"><p>A discussion of all that was found.</p></section></article>', "Related work A discussion of all that was found."),
    ("<body class='has-sidebar'><div class='page no-sidebar'><p>Long text here of it.</p></div></body>", "Long text here of it."),
    (f"<body><article><p>{LONG}</p><div class='cookie-notice'>We use cookies.</div><div class='reader-comments'><p>{LONG}</p></div></article></body>", LONG.strip()),
    (f"<body><article><p>{LONG}</p><ul class='related'><li><a href=1>One more</a><li><a href=2>Two more</a></ul></article></body>", LONG.strip()),
    # without landmarks, short paragraphs beside the centre stay, thin blocks go
    (f"<body><div><h1>T</h1><p>Lead.</p><div><p>{LONG}</p><p>{LONG}</p></div><p>End.</p></div><div>(c) 2020</div></body>", f"T Lead. {LONG}{LONG}End."),
    ("<form action=x><div><p>All of it in a form.</p><input value=1><p>More.</p></div></form>", "All of it in a form. More."),
    ("a < b and c > d", "a < b and c > d"), ('<p title="a > b">x</p>', "x"), ('<p>x</p><a "', 'x <a "'), ("<p>&am<b>p;</b> x</p>", "&amp; x"),
    ("<p title='the hidden truth'>seen</p><p hidden>unseen</p><p style='Display : none'>unseen</p>", "seen"),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


HOSTILE = {
    "open tags": "<a " * 350_000, "open quotes": '<a "' * 260_000, "end tags": "</b>" * 250_000, "blanks": " " * 1_000_000, "quoted ends": '<a x="><a" x="><a" ' * 50_000,
    "comments": "<!--" * 250_000, "raw": "<iframe>" * 120_000, "nested": "<p><button>" + "<div>" * 100_000, "attributes": "<p " + "a " * 500_000 + ">x", "names": "<a b" + " " * 1_000_000 + ">",
    "quotes": '<a b="' * 180_000, "links": "<a href=x>" * 100_000, "items": "<li>" * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_in_proportion(name):
    """A megabyte takes seconds at most; a quadratic reader takes minutes."""
    began = time.perf_counter()
    html.main_text(HOSTILE[name])
    assert time.perf_counter() - began < 8


class Plain(HTMLParser):
    """A tree of (tag, children) of a well-formed page, without what never holds text."""

    def __init__(self):
        super().__init__()
        self.root = ("#root", [])
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            while any(t == "p" for t, _ in self.stack):
                self.stack.pop()
        node = (tag, [])
        self.stack[-1][1].append(node)
        if tag not in html.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def below(node):
    """All elements below one, by recursion."""
    return [x for c in node[1] if not isinstance(c, str) for x in (c, *below(c))]


def chars(node):
    return sum(len(" ".join(c.split())) if isinstance(c, str) else chars(c) for c in node[1])


def pruned(node):
    return (node[0], [c if isinstance(c, str) else pruned(c) for c in node[1] if isinstance(c, str) or c[0] not in ("head", "nav", "footer", "script", "style", "ad")])


def density(node, body):
    """Composite text density as it is defined, each count taken anew."""
    def links(n):
        return chars(n) if n[0] == "a" else sum(links(c) for c in n[1] if not isinstance(c, str))

    c, t, lc, lt = chars(node), len(below(node)), links(node), sum(x[0] == "a" for x in below(node))
    base = math.log(math.log(c / max(1, c - lc) * lc + links(body) / max(1, chars(body)) * c + math.e))
    return 0.0 if not c else c / max(1, t) if base <= 0 else c / max(1, t) * math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / base


def test_densities_and_texts_of_pages_against_their_definition(spark):
    """Every page of the table: densities and the densest element by recursion, and the blocks of its article as the text."""
    got = {r.page_id: r.text for r in html.extract_main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy(F.col("page_id")).collect():
        plain = Plain()
        plain.feed(r.html.replace('<div class="ad">', "<ad>").replace("</div>", "</ad>"))
        body = next(n for n in below(pruned(plain.root)) if n[0] == "body")
        nodes = [n for n in html.measure(html.parse(r.html)) if n.tag not in ("#root", "html")]
        slow = [body, *below(body)]
        if r.page_id % 5 == 0:
            assert [n.tag for n in nodes] == [n[0] for n in slow]
            assert all(math.isclose(n.density, density(s, body), abs_tol=1e-9) for n, s in zip(nodes, slow, strict=True))
            sums = [sum(density(c, body) for c in s[1] if not isinstance(c, str)) for s in slow]
            assert slow[sums.index(max(sums))][0] == max(nodes, key=lambda n: n.total).tag

        def blocks(node):
            out = [""]
            for c in node[1]:
                if isinstance(c, str):
                    out[-1] += c
                elif c[0] in html.BLOCK:
                    out += [*blocks(c), ""]
                else:
                    inner = blocks(c)
                    out[-1] += inner[0]
                    out += inner[1:]
            return out

        article = next(n for n in slow if n[0] == "article")
        assert got[r.page_id] == " ".join(" ".join(b.split()) for b in blocks(article) if b.strip())
