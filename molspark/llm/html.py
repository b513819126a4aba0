"""HTML extraction by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

# HTML's void elements, raw-text elements, and the elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
#: Elements that a block's start tag leaves, as browsers do, so that an unclosed one doesn't swallow the page.
ISLANDS = frozenset("svg math select".split())
#: Elements in which a paragraph outside isn't ended.
SCOPES = frozenset("td th button object table caption foreignobject".split())
#: Elements that never hold main text.
NEVER = frozenset("head nav footer aside form button input script style template iframe noscript noembed noframes menu dialog svg select textarea object canvas title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words that name what surrounds an article: a class or id does if it has one of them, and no other parts than such words, weak ones and FRAMES.
STRONG = frozenset("advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comentarios comment commentaires commentlist comments cookie cookies disqus "
                   "gdpr kommentare masthead menubar navbar navigation newsletter pagination popup sidebar sponsored subscribe toolbar".split())
#: Classes and ids that do so if they are nothing but the word.
EXACT = frozenset("ad ads banner consent footer menu modal nav notice notices promo".split())
#: Parts that do so only of an element that is thin, mostly links, or outside the article.
WEAK = frozenset("ad ads banner consent disclaimer discussion footer header menu modal nav notice notices promo promoted promotion reactions recommended "
                 "related replies reply respond share sharing signup social sponsor subscription widget".split())
#: Parts that say nothing of what an element holds.
FRAMES = frozenset("area bar block body bottom box btn card cell col column container content count entry feed field fixed form full global group head holder html icon "
                   "inner item items js label left link links list load main middle mobile module nav outer page pane panel post primary reader readers right root row secondary "
                   "section site slot small stack text thread title top unit user users view wp wrap wrapper x xl xs".split())
#: First parts of a class that tells a state of the page.
STATES = frozenset("has hide is no not show with without".split())
_FRAME_WORDS = STRONG | WEAK | EXACT | FRAMES
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r">|=\s*+([\"'])")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A start tag of the first ends an open element of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "body": {"head"}, "a": {"a"}}
_LANDMARKS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT_BLOCKS = _HEADINGS | frozenset("p blockquote pre figcaption".split())


class Node:
    """An element with the counts that its density needs.

    ``around``: surely no part of an article; ``weak``: perhaps none.  ``p`` and ``island`` are the paragraph and the island
    that a block among its children ends, ``holds`` whether a landmark or a first heading is below it.
    """

    __slots__ = ("tag", "parent", "around", "named", "weak", "link", "p", "island", "landmark", "holds", "items", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.p, self.island, self.landmark = (parent.p, parent.island, parent.landmark) if parent else (None, None, False)
        if tag == "p":
            self.p = self
        elif tag in SCOPES:
            self.p = self.island = None
        elif tag in ISLANDS:
            self.island = self
        self.around = tag in NEVER or tag == "header" and not self.landmark
        self.named = self.weak = self.holds = False
        self.link = tag == "button"
        if attrs and not self.around:
            self._read(attrs)
        self.landmark |= tag in _LANDMARKS or tag == "section"
        self.items: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0

    def _read(self, attrs: str) -> None:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                if self.tag in ("html", "body", *_LANDMARKS):
                    continue
                for token in value.split():
                    parts = [p.lower() for p in _PARTS.findall(token)]
                    if name == "role":
                        self.named |= token.lower() in ROLES
                    elif parts and parts[0] not in STATES:
                        self.named |= self.tag not in _HEADINGS and (not STRONG.isdisjoint(parts) and _FRAME_WORDS.issuperset(parts) or len(parts) == 1 and parts[0] in EXACT)
                        self.weak |= not WEAK.isdisjoint(parts)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in "".join(value.lower().split()):
                self.around = self.tag not in ("html", "body")
            elif name == "href":
                self.link |= self.tag == "a"


def tags(page: str, skip_to: list[int]) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, whether it ends an element) of each tag and, with an empty name, comment.

    The reader may raise ``skip_to[0]``: nothing before it is a tag.

    Every character is passed over a bounded number of times: a tag ends at the first ``>`` outside quoted values; once one
    doesn't, quotes are ignored from there on, and text after the last ``>`` holds no tag.
    """
    at, quoted = 0, True
    last = page.rfind(">")
    while (at := page.find("<", max(at, skip_to[0]))) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?") and after:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", at)
                end = len(page) if end < 0 else end + 1
            yield at, end, "", "", False
            at = end
            continue
        closes = after == "/"
        if not (name := _NAME.match(page, at + 1 + closes)) or at > last:
            at += 1
            continue
        stop = name.end()
        while quoted:
            m = _TAG_STOP.search(page, stop)
            if not m or m[1] and (stop := page.find(m[1], m.end()) + 1) == 0:
                quoted = False
            elif not m[1]:
                stop = m.start()
                break
        if not quoted and (stop := page.find(">", name.end())) < 0:
            return
        yield at, stop + 1, name[0].lower(), page[name.end() : stop], closes
        at = stop + 1


def parse(page: str, forms: bool = False) -> Node:
    """The element tree of a page; unclosed and stray tags are tolerated, any depth is.  ``forms``: what forms hold may be text."""
    root = node = Node("#root", None)
    opened: Counter[str] = Counter()
    done, skip_to = 0, [0]

    def text(until: int) -> None:
        if until > done:
            piece = page[done:until]
            node.items.append(html.unescape(piece) if "&" in piece else piece)

    def leave(top: Node) -> Node:
        """Close the open elements up to ``top``."""
        up = node
        while up is not top.parent:
            opened[up.tag] -= 1
            up = up.parent
        return up

    for start, end, tag, attrs, closes in tags(page, skip_to):
        text(start)
        done = end
        if not tag:
            continue
        if closes:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
            elif tag in ("p", "br"):
                node.items.append(Node("br", node))
            continue
        if tag in BLOCK:
            if node.island and tag not in ("option", "optgroup"):
                node = leave(node.island)
            if node.p and tag != "br":  # a block ends an open paragraph
                node = leave(node.p)
        if (ends := _ENDS.get(tag)) and node.tag in ends:
            node = leave(node)
        new = Node(tag, node, attrs)
        if forms and tag == "form":
            new.around = False
        node.items.append(new)
        if tag in _LANDMARKS or tag == "h1":
            up = node
            while up and not up.holds:
                up.holds = True
                up = up.parent
        if tag in VOID or attrs.endswith("/") and attrs[-2:-1] in ("", " ", "\t", "\n", '"', "'"):
            continue
        if tag in RAW:
            if close := re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, end) if opened["/" + tag] == 0 else None:
                done = skip_to[0] = close.start()
                opened[tag] += 1  # its end tag closes it
                node = new
            elif tag in ("script", "style"):
                done = skip_to[0] = len(page)
            else:
                opened["/" + tag] = 1  # none is closed from here on
            continue
        opened[tag] += 1
        node = new
    text(len(page))
    return root


def _in_order(root: Node) -> list[Node]:
    """Elements, parents first, without what surrounds the article."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.items) if isinstance(c, Node) and not _is_around(c)]
    return out


def _is_around(n: Node) -> bool:
    """Whether an element surely surrounds the article: by its tag, or by a name if it isn't a wrapper of the article."""
    return n.around or n.named and not n.holds


def measure(root: Node) -> list[Node]:
    """Set counts, composite density and density sums; returns the elements, parents first.

    An element of C characters, L of them in links, and T tags, K of them links, has the density C/T * log_b(C/L * T/K) with
    b = ln(C/(C-L) * L + C * (the body's L/C) + e).
    """
    nodes = _in_order(root)
    below = {id(n): [c for c in n.items if isinstance(c, Node) and not _is_around(c)] for n in nodes}
    for n in reversed(nodes):  # children before parents
        inner = below[id(n)]
        n.chars = sum(len(" ".join(c.split())) for c in n.items if isinstance(c, str)) + sum(c.chars for c in inner)
        n.tags = len(inner) + sum(c.tags for c in inner)
        n.links = n.chars if n.link else sum(c.links for c in inner)
        n.link_tags = sum(c.link_tags + c.link for c in inner)
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.links / max(1, body.chars)
    for n in nodes:
        n.density = _density(n.chars, n.links, n.tags, n.link_tags, share)
    for n in nodes:
        n.total = sum(c.density for c in below[id(n)])
    return nodes


def _density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    per_tag = chars / max(1, tags)
    base = math.log(math.log(chars / max(1, chars - links) * links + share * chars + math.e))
    if base <= 0:  # no link on the page
        return per_tag
    return per_tag * math.log(max(1.0, chars / max(1, links) * max(1, tags) / max(1, link_tags))) / base


def main_text(page: str | None) -> str:
    """The main text of a page; empty if it has none.

    The element with the largest sum of its children's densities (ties: the first) is the centre; the threshold is the smallest
    density on its path up to body.  The article is the centre, and every element beside the path that reaches the threshold.  An
    ``article`` or ``main`` element on the path moves that bar: what it holds stays, what is outside must be as dense as the
    element itself.  Without one, headings and paragraphs beside the path stay, but for those right below body.  Elements other than paragraphs that are mostly
    links and thinner than the threshold go, and so do elements with a weak name that are mostly links, or outside the article.  Where
    nothing is left without the forms of a page, what they hold is looked at too.
    """
    if not page:
        return ""
    root = parse(page)
    nodes = measure(root)
    if not root.chars and "<form" in page.lower():
        root = parse(page, forms=True)
        nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    within = nodes if body is root else _in_order(body)
    centre = max(within, key=lambda n: n.total)
    if centre.total <= 0:
        centre = body
    path = [centre]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    bound = next((n for n in path if n.tag in _LANDMARKS), None)
    return " ".join(_blocks(body, path, bound, threshold))


def _blocks(body: Node, path: list[Node], bound: Node | None, threshold: float) -> list[str]:
    """Texts of the article's blocks in page order, of the elements below ``body`` that ``main_text`` keeps."""
    out: list[str] = []
    line: list[str] = []
    on_path = set(map(id, path))
    outer = set(map(id, path[path.index(bound) + 1 :])) if bound else set()  # path elements outside the bound
    bar = max(threshold, bound.density) if bound else threshold

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    def stays(n: Node, inside: bool) -> bool:
        if id(n) in on_path:
            return True
        block = n.tag in BLOCK
        thin = n.density < threshold
        # outside the article a weak name is enough, unless the element reaches the bar; inside, no name takes away what isn't mostly links
        if n.weak and not n.holds and block and n.chars and (n.links > 0.5 * n.chars or not inside and n.tag not in _HEADINGS and (thin or n.density < bar or not bound)):
            return False
        beside = n.parent
        if not block or not n.chars:
            return not n.link or id(beside) not in on_path or beside is path[0] or bound is not None
        if thin and n.links > 0.5 * n.chars and n.tag not in _TEXT_BLOCKS and n.tag not in ("li", "dd", "dt", "tr", "td", "th", "tbody"):
            return False
        if id(beside) not in on_path or beside is path[0]:
            return True
        if bound:
            return id(beside) not in outer or n.density >= bar
        return not thin or n.tag in _TEXT_BLOCKS and (beside is not body or n.tag in _HEADINGS)

    todo: list = [(body, bound is None and body is path[0])]
    while todo:
        n, inside = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif not _is_around(n) and (n is body or stays(n, inside)):
            inside = inside or n is bound or n is path[0]
            if n.tag in BLOCK:
                flush()
                todo.append((None, False))
            # of what stands outside the bound only blocks can reach the bar
            todo += [(c, inside) for c in reversed(n.items) if id(n) not in outer or isinstance(c, Node) and (c.tag in BLOCK or id(c) in on_path)]
    flush()
    return out


def extract_main_text(pages: DataFrame, *, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The main text of every whole page.

    Returns the id columns, ``text`` (empty if there is none) and ``n_chars``, its code points.  A null page counts
    as empty.  Character references are decoded; white space inside a block becomes one space; blocks
    are trimmed and joined in page order by one space.  Broken markup is tolerated; time and memory are in proportion to the
    page.  One row a row, no shuffle.  Other columns are not read; ids may be null.  No rows give no rows.
    """
    src = small_batches(pages).select(*(F.col(f"`{c}`") for c in id_cols), F.col(f"`{html_col}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(id_cols))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*id_cols, "text", "n_chars"])

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(id_cols)])
    return src.mapInArrow(tidy(run), f"{ids}, text string, n_chars long")
