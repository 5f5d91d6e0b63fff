"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read as *blocks*: text between the borders of block elements, without
scripts, styles, comments in the markup and other parts that are never shown.  A
linear classifier gives each block two costs: of calling it content (it stands in
navigation, a footer, a form, an advert, among links ...) and of calling it
boilerplate (it stands in the article, is a paragraph, is long ...).  They are the
capacities from and to the two terminals of a graph; neighbours in the page and
neighbours under the same parent are joined by edges whose capacity falls with
their distance in the tree, and where one is certain boilerplate or mostly links
and the other is not.  The maximum flow's cut is the cheapest labelling.  A form
that holds most of the text of a page is its frame and says nothing about blocks.

References are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by ``separator`` (the query op9 gives two line
breaks); nothing is capped.  Broken
markup is read as far as it goes: an element left open ends with its parent, also
one that is not shown.  Parts that are not shown end neither a block nor a
paragraph around them; in svg and math, ``/>`` closes and page elements break out.
A tag that does not end outside quotation marks ends at its first ``>``, as do all
that follow on such a page; without any ``>`` ahead, ``<`` is text.  Reading takes
time in proportion to the page.

Null, empty and tagless input without a text worth it give an empty text.  Other
columns are not read; repeated rows are extracted each; an empty table gives no
rows.  Pages are independent: one page is one small graph in one task.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_QUOTED_END = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A value without quotation marks that ends the tag: a slash at its end is its own.
_BARE_VALUE = re.compile(r"""=\s*[^\s"'=]+$""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names and naming habits of web pages.
UNSHOWN = frozenset("script style template noscript iframe object svg math canvas audio video head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter q s samp small span strike strong sub sup time tt u var wbr".split())
FOREIGN = frozenset("svg math".split())
#: Elements in svg and math that hold page elements again, and page elements that end svg and math.
PAGE_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside button select textarea fieldset dialog menu header".split())
CONTENT = frozenset("article main".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner alert popup modal overlay"
    " sidebar side rail aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot colophon copyright legal"
    " comment comments reply replies respond disqus discussion related recommended recommendations share sharing social follow newsletter subscribe subscription signup"
    " login search form widget skip".split()
)
CONTENT_NAMES = frozenset("article post entry story content main body text".split())
IN_ARTICLE = frozenset(["header", "head"])
ARTICLE_NAMES = frozenset("article post entry story".split())
#: Words of a name that say what an element has or lacks, not what it is; and those that say where something beside it is.
MODIFIERS = frozenset("has have with without no not hide hides show shows".split())
SIDES = frozenset("left right top bottom both none on off".split())

#: Weights of the classifier and of the edges, in thousandths.
PLACED_BOILERPLATE, NAMED_BOILERPLATE, PLACED_CONTENT, NAMED_CONTENT = 14000, 4200, 4000, 1500
PRIOR, TEXTUAL_TAG, SENTENCE, LONGEST, LINKS = 600, 1000, 500, 3000, 3500
SAME_PARENT, NEAR, FAR, UNLIKE = 700, 300, 100, 50
#: Text as long as this that ends like a sentence is a paragraph, whatever its element is called.
PARAGRAPH = 80


class Block:
    __slots__ = ("boilerplate", "content", "doubted", "form", "linked", "named", "place", "tag", "text")

    def __init__(self, text: str, linked: int, place: Element, innermost: Element) -> None:
        self.text, self.linked, self.place, self.tag = text, linked, place, place.tag
        self.content, self.named = place.content, place.named
        self.boilerplate = place.boilerplate or innermost.boilerplate
        self.doubted = place.doubted or innermost.doubted
        self.form = innermost.form

    @property
    def certain(self) -> bool:
        """Placed in boilerplate, or more link than text."""
        return self.boilerplate or 2 * self.linked > len(self.text)

    @property
    def sentence(self) -> bool:
        return self.text[-1] in ".!?:;…\"'”»"


def said(value: str, article: bool) -> tuple[bool, bool, bool]:
    """Whether a class or an id calls an element boilerplate, the same only by a name with a side, and content.

    Each name speaks for itself, up to a word like "with": in a compound, words
    for boilerplate outweigh words for content.  A header within an article, or
    of one, holds its title.
    """
    boilerplate = beside = content = False
    for name in value.split():
        words = [x.lower() for x in _PART.findall(name)]
        words = words[: next((k for k, w in enumerate(words) if w in MODIFIERS), len(words))]
        against = BOILERPLATE_NAMES.intersection(words)
        if article or ARTICLE_NAMES.intersection(words):
            against -= IN_ARTICLE
        if not against:
            content |= not CONTENT_NAMES.isdisjoint(words)
        elif words[-1] in SIDES:
            beside = True
        else:
            boilerplate = True
    return boilerplate, beside, content


class Element:
    """An open element, with what it inherits from those around it."""

    __slots__ = ("above", "blocks", "boilerplate", "content", "depth", "doubted", "foreign", "form", "named", "place", "shown", "tag", "unshown")

    def __init__(self, tag: str, attributes: str, above: Element | None) -> None:
        self.tag, self.above = tag, above
        self.depth = above.depth + 1 if above else 0
        self.unshown = tag in UNSHOWN or bool(above and above.unshown)
        # the nearest elements, this one included, that are shown, and that are shown blocks; and how many blocks are open
        block = tag not in INLINE and not self.unshown
        self.shown = self if above is None or not self.unshown else above.shown
        self.place = self if above is None or block else above.place
        self.blocks = (above.blocks if above else 0) + block
        self.form = self if tag == "form" else above.form if above else None
        self.foreign = tag in FOREIGN or bool(above and above.foreign and tag not in PAGE_AGAIN)
        self.content = tag in CONTENT or bool(above and above.content)
        self.named = bool(above and above.named)
        marked = tag in BOILERPLATE and not (tag == "header" and self.content)
        own = tag in CONTENT
        doubted = beside = named = False
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    against, at_side, for_it = said(value, self.content)
                    doubted, beside, named = doubted or against, beside or at_side, named or for_it
                elif name == "role":
                    marked |= value.lower() in BOILERPLATE_ROLES
                    own |= value.lower() in ("main", "article")
                elif name == "style":
                    marked |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif name == "hidden" or name == "aria-hidden":
                    marked |= name == "hidden" or value.lower() == "true"
        self.content |= own
        self.named |= named
        # "sidebar-right" names a sidebar, but on what is the content it says where that is
        doubted |= beside and not (own or named)
        doubted &= tag not in ("html", "body")
        # names are evidence only: an article below them, or below what they cost, can be content
        self.doubted = doubted or bool(above and above.doubted and not own)
        self.boilerplate = marked or bool(above and above.boilerplate)


#: What an opening tag ends when it is found open nearest to it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose content is no markup: to the first end tag, or only if their next tag is an end tag (else they were left open).
_RAW = {t: re.compile(f"<(/){t}(?=[\\s/>])", re.I) for t in ("script", "style")} | {t: re.compile(f"<(/?){t}(?=[\\s/>])", re.I) for t in ("title", "noscript", "iframe")}


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = Element("html", "", None)
    stack, found, at = [root], [], 0
    opened: dict[str, list[int]] = {}  # where in the stack elements of a name stand
    text: list[str] = []
    linked, links = 0, 0
    endless: set[str] = set()  # raw elements without an end tag in what is left
    quoted, last = True, html.rfind(">")

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                found.append(Block(whole, linked, stack[-1].place, stack[-1].shown))
            text.clear()
            linked = 0

    def push(tag: str, attributes: str) -> None:
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, attributes, stack[-1]))

    def pop_to(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag].pop()

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].unshown:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if links:
                linked += len(raw.strip())

    end = len(html)
    while at < end:
        token = _MARK.search(html, at)
        if token is None:
            add(html[at:])
            break
        tag, closing, attributes, after = token[2], token[1], "", token.end()
        if tag is not None:
            if after > last:  # no tag ends any more
                add(html[at:after])
                at = after
                continue
            ends_at = _QUOTED_END.match(html, after) if quoted else None
            quoted = ends_at is not None
            close = ends_at.end(1) if ends_at else html.find(">", after)
            attributes, after = html[token.end() : close], close + 1
        if token.start() > at:
            add(html[at : token.start()])
        at = after
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if opened.get(tag):
                k = opened[tag][-1]
                if tag in INLINE:
                    if stack[-1].blocks > stack[k - 1].blocks:
                        continue  # an inline end does not end the blocks in it
                elif not stack[k].unshown:
                    end_block()
                pop_to(k)
            continue
        bare = attributes.rstrip()
        shut = bare.endswith("/") and not _BARE_VALUE.search(bare)
        if stack[-1].foreign and tag in BREAKS_OUT:
            while stack[-1].foreign:
                pop_to(len(stack) - 1)
        if shut and (tag in FOREIGN or stack[-1].foreign):
            continue
        if tag == "br":
            if not stack[-1].unshown:
                text.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID and not shut:
                links += tag == "a"
                push(tag, attributes)
            continue
        if tag == "body":  # ends the head and what was left open in it
            pop_to(opened["head"][0] if opened.get("head") else len(stack))
        if tag not in UNSHOWN and not stack[-1].unshown:
            end_block()
            links = 0
            if tag in VOID:
                continue
            while len(stack) > 1 and stack[-1].tag in INLINE:
                pop_to(len(stack) - 1)
            if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
                pop_to(len(stack) - 1)
            ends = _ENDS.get(tag)
            while ends and stack[-1].tag in ends and len(stack) > 1:
                pop_to(len(stack) - 1)
        elif tag in VOID:
            continue
        push(tag, attributes)
        if tag in _RAW and tag not in endless:
            close = _RAW[tag].search(html, at)
            if close is None:
                endless.add(tag)
            elif close[1]:
                at = close.start()
    end_block()
    inside: dict[Element, int] = {}
    for block in found:
        if block.form and not block.boilerplate:
            inside[block.form] = inside.get(block.form, 0) + len(block.text)
    everything = sum(len(b.text) for b in found if not b.boilerplate)
    for block in found:
        block.boilerplate |= block.form is not None and 2 * inside.get(block.form, 0) <= everything
    return found


def costs(block: Block) -> tuple[int, int]:
    """What it costs to call the block content, and to call it boilerplate."""
    length = len(block.text)
    content = PRIOR + LINKS * min(length, block.linked) // length
    boilerplate = min(LONGEST, 20 * length) + TEXTUAL_TAG * (block.tag in TEXTUAL) + SENTENCE * block.sentence
    if block.boilerplate:
        content += PLACED_BOILERPLATE
    elif block.doubted:
        content += NAMED_BOILERPLATE
        boilerplate += NAMED_CONTENT * block.named
    elif block.content:
        boilerplate += PLACED_CONTENT
    elif block.named:
        boilerplate += NAMED_CONTENT
    elif block.tag not in TEXTUAL and not (block.sentence and length >= PARAGRAPH):
        boilerplate //= 2
    return content, boilerplate


def _within(a: Element | None, b: Element | None, steps: int) -> bool:
    """Whether the way from one element to the other has no more than ``steps`` steps."""
    while a is not b:
        if not steps:
            return False
        steps -= 1
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
    return True


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity) of page neighbours and of neighbours under one parent."""
    out, last = [], {}
    for k, block in enumerate(found):
        if k:
            alike = found[k - 1].certain == block.certain
            out.append((k - 1, k, UNLIKE if not alike else NEAR if _within(found[k - 1].place, block.place, 3) else FAR))
        above = block.place.above
        if above in last:
            alike = found[last[above]].certain == block.certain
            out.append((last[above], k, SAME_PARENT if alike else UNLIKE))
        last[above] = k
    return out


def minimum_cut(terminals: list[tuple[int, int]], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source (the fewest, where several cuts cost the same).

    ``terminals``: capacity from the source and to the sink of each node.  What
    can flow straight through a node does at once.  A node whose own capacity
    outweighs all its edges is decided, and its edges become capacity of its
    neighbours.  The rest is a maximum flow in phases: distances to the sink, then
    paths that go nearer with each step, until none is left.
    """
    n = len(terminals)
    own = [a - b for a, b in terminals]  # to the source if positive, else to the sink
    room: list[dict[int, int]] = [{} for _ in terminals]
    for a, b, capacity in joined:
        room[a][b] = room[a].get(b, 0) + capacity
        room[b][a] = room[b].get(a, 0) + capacity
    around = [sum(r.values()) for r in room]
    stays: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        k = waiting.popleft()
        if stays[k] is not None or -around[k] < own[k] <= around[k]:
            continue
        stays[k] = own[k] > around[k]
        for other, capacity in room[k].items():
            own[other] += capacity if stays[k] else -capacity
            around[other] -= capacity
            del room[other][k]
            waiting.append(other)
        room[k] = {}
    rest = [k for k in range(n) if stays[k] is None]
    while True:
        level = {k: 0 for k in rest if own[k] < 0}
        queue = deque(level)
        while queue:
            k = queue.popleft()
            for other in room[k]:
                if other not in level and room[other][k] > 0:
                    level[other] = level[k] + 1
                    queue.append(other)
        sources = [k for k in rest if own[k] > 0 and k in level]
        if not sources:
            break
        steps = {k: iter(list(room[k])) for k in level}
        for source in sources:
            path = [source]
            while path and own[source] > 0:
                k = path[-1]
                if own[k] < 0:
                    flow = min(own[source], -own[k], *(room[a][b] for a, b in zip(path, path[1:], strict=False)))
                    own[source] -= flow
                    own[k] += flow
                    for a, b in zip(path, path[1:], strict=False):
                        room[a][b] -= flow
                        room[b][a] += flow
                    first = next((i for i in range(len(path) - 1) if not room[path[i]][path[i + 1]]), len(path) - 1)
                    del path[first + 1 :]
                    if own[path[-1]] < 0 or first < len(path) - 1:
                        continue
                    if path[-1] == k:  # the sink of this path is full
                        path.pop()
                    continue
                for other in steps[k]:
                    if level.get(other, n) == level[k] - 1 and room[k][other] > 0:
                        path.append(other)
                        break
                else:
                    path.pop()
    reached = deque(k for k in rest if own[k] > 0)
    for k in reached:
        stays[k] = True
    while reached:
        k = reached.popleft()
        for other, capacity in room[k].items():
            if capacity > 0 and not stays[other]:
                stays[other] = True
                reached.append(other)
    return [bool(s) for s in stays]


def main_text(html: str | None, separator: str = "\n") -> str:
    """The content blocks of a page, joined by ``separator``."""
    found = blocks(html or "")
    if not found:
        return ""
    # the source's side is content: leaving it costs what calling the block boilerplate costs
    stays = minimum_cut([(c[1], c[0]) for c in (costs(b) for b in found)], edges(found))
    return separator.join(b.text for b, content in zip(found, stays, strict=True) if content)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", separator: str = "\n") -> DataFrame:
    """One row a page: ``page_id``, ``url``, ``text`` and ``n_chars`` (its code points)."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:2])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, separator) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(rows, f"{kinds}, text string, n_chars long")
