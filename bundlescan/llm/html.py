"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is read into blocks: runs of text between block-level tags, each with its open elements.
A linear classifier over the block's place and text gives the cost of calling it content and of
calling it boilerplate; these are the capacities to the two terminals. Successive blocks, and
successive blocks of one parent, are joined by smoothness edges, the stronger the fewer elements
lie between them. The minimum cut labels the blocks.

A block whose terminals differ by more than all its edges together has the better label in every
minimum cut, so it is settled first and its edges go to its neighbours' terminals; maximum flow
runs on the blocks that are left.

What a wrapper's class or id says is evidence, not a verdict: a word that stands alone or beside words
of place is strong, one in another compound weak, and notes about the page (``has-sidebar``,
``no-comments``, ``tags-page``) say nothing. A wrapper or form that holds most of the page's text, and
the page's article if it has one, is no boilerplate; article and main begin anew unless they are
comments or lie in a nav, aside or footer.

Reading a page takes time in proportion to its length: a page with a tag that no ``>`` ends is read
on as text, one with a quote that nothing ends without regard to quotes from there. An end tag whose
element is more than REACH levels up is left out.

Defined results: a null, empty or text-free page gives an empty text. Character references are
decoded, white space inside a block becomes one space, and content blocks are joined by one line
feed. Columns that clash with ``text_out`` give way.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from bundlescan.llm.common import prepare, with_columns

# Fixed values of HTML: elements by what they do to the text flow.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg math iframe object textarea select button title head datalist "
                   "canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
                  "option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
#: An element that ends where one of these begins, if it is open below the given limit.
ENDS_AT = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Fixed values of the classifier: elements, roles and words of class or id that stand for boilerplate.
BOILER_TAG = frozenset("nav footer aside form menu dialog".split())
BOILER_ROLE = frozenset("navigation complementary banner contentinfo search dialog alert menu menubar toolbar form".split())
BOILER_WORD = frozenset("ad ads adv sponsor sponsored nav navbar navigation menu menubar footer header masthead topbar sidebar aside "
                        "banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
                        "login share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments "
                        "commentlist respond reply replies disqus promo promotion widget toolbar copyright legal search form tags "
                        "hidden".split())
BOILER_PREFIX = ("advert", "sponsor", "comment", "cookie", "breadcrumb", "newsletter", "sidebar")
CONTENT_WORD = frozenset("article content post entry story body main text".split())
COMMENT_WORD = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words of place and shape beside a boilerplate word; words that make a name a note about the page.
PLACE_WORD = frozenset("site page global top bottom left right main container wrapper wrap area box list bar block section inner outer primary "
                       "secondary item items group links link posts col column row panel module region zone slot unit content".split())
NOTE_FIRST = frozenset("has no with without is not single hide show enable disable".split())
NOTE_LAST = frozenset("page layout template view archive single theme enabled disabled".split())

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?>[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
_STRONG = 14.0
_WEAK = 5.0
_SMOOTH = 1.5
REACH = 512
_HARD = frozenset("nav footer aside menu dialog".split())


def evidence(names: str) -> tuple[float, bool, bool]:
    """(cost, whether it speaks of comments, whether it speaks of content) of a class or id."""
    cost, comments, content = 0.0, False, False
    for name in names.split():
        parts = [w.lower() for w in _NAME.findall(name)]
        if not parts or len(parts) > 1 and (parts[0] in NOTE_FIRST or parts[-1] in NOTE_LAST):
            continue
        bad = [w for w in parts if w in BOILER_WORD or w.startswith(BOILER_PREFIX)]
        good = [w for w in parts if w in CONTENT_WORD]
        if not bad:
            content = content or bool(good)
        elif bad == ["header"] and good and parts[0] in CONTENT_WORD - {"main", "content"}:
            cost = max(cost, 1.0)  # an article's own header
        else:
            rest = [w for w in parts if w not in bad and not w.isdigit()]
            cost = max(cost, _STRONG if all(w in PLACE_WORD for w in rest) else _WEAK)
            comments = comments or any(w in COMMENT_WORD or w.startswith("comment") for w in bad)
    return cost, comments, content


class Element:
    """An open element and what it says about the blocks in it."""

    __slots__ = ("article", "block", "chars", "comments", "cost", "depth", "gain", "hard", "hidden", "holds_article", "link", "main", "parent", "score",
                 "starts_article", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.chars, self.cost, self.gain, self.score = 0, 0.0, 0.0, 0.0
        self.comments = parent.comments if parent else False
        self.hard = (parent.hard if parent else False) or tag in _HARD
        self.hidden = (parent.hidden if parent else False) or tag in HIDDEN
        self.link = (parent.link if parent else False) or tag == "a"
        self.main = tag == "main"
        self.starts_article = tag in ("article", "main")
        if tag in BOILER_TAG:
            self.cost = _STRONG
        if attributes and tag not in ("html", "body"):
            for m in _ATTR.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    cost, comments, content = evidence(value)
                    self.cost = max(self.cost, cost)
                    self.comments = self.comments or comments
                    self.gain = max(self.gain, 1.5 * content)
                elif name == "role":
                    if value.lower() in BOILER_ROLE:
                        self.cost, self.hard = _STRONG, self.hard or value.lower() != "form"
                    elif value.lower() in ("main", "article"):
                        self.starts_article, self.main = True, self.main or value.lower() == "main"
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.hidden = True
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.hidden = True
        # a comment may be an article of its own, and so may a card in an aside
        self.starts_article = self.starts_article and not self.comments and not self.hard
        self.article = (parent.article if parent else False) or self.starts_article
        self.main = self.main and self.starts_article
        self.holds_article = False


def weigh(elements: list[Element]) -> None:
    """Scores of elements, in the order in which they were opened, from what they and those around
    them say and from the share of the page's text that they hold."""
    for e in reversed(elements):
        if e.parent:
            e.parent.chars += e.chars
    total = elements[0].chars
    # articles are the page's if they hold much of it, one or all together; else they are cards
    inside = sum(e.chars for e in elements if e.starts_article and not e.parent.article)
    for e in elements:
        e.starts_article = e.starts_article and (e.main or 4 * e.chars >= total or 2 * inside >= total)
        e.article = e.starts_article or (e.parent is not None and e.parent.article)
        if e.tag == "header":
            e.cost = 1.0 if e.article or e.cost == 1.0 else _STRONG
    for e in reversed(elements):
        if e.parent:
            e.parent.holds_article |= e.holds_article or e.starts_article
    any_article = elements[0].holds_article
    for e in elements:
        cost = e.cost
        most = 2 * e.chars > total
        if cost and most and not e.hard and not e.comments and (e.holds_article or e.starts_article or not any_article):
            cost = 0.0
        base = e.parent.score if e.parent else 0.0
        if e.starts_article and (base > -_STRONG or e.main or most):
            base = max(base, 0.0)
        e.score = base - cost + (e.gain if not cost else 0.0)


class Block:
    __slots__ = ("link", "text", "within")

    def __init__(self, text: str, link: int, within: Element):
        self.text, self.link, self.within = text, link, within


def blocks(page: str) -> list[Block]:
    """The visible text blocks of a page, in order."""
    out: list[Block] = []
    top = here = Element("", "", None)
    elements, opened = [top], Counter()
    parts: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, link, here.block))
                here.block.chars += len(text)
            parts.clear()
        link = 0

    def close(tags: set[str], limit: set[str]) -> None:
        """End the innermost open element of these tags, with all in it, unless a limit is nearer."""
        nonlocal here
        if not any(opened[t] for t in tags):
            return
        at, steps = here, 0
        while at.parent and at.tag not in tags:
            if at.tag in limit or steps == REACH:
                return
            at, steps = at.parent, steps + 1
        if at.parent:
            while here is not at.parent:
                opened[here.tag] -= 1
                here = here.parent

    def say(text: str) -> None:
        nonlocal link
        if text and not here.hidden:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if here.link:
                link += len(text)

    at, n, quotes = 0, len(page), True
    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if page.startswith("<!--", start):
            say(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = _TAG.match(page, start + 1)
        if m is None and page[start + 1:start + 2] not in ("!", "?", "/"):
            say(page[at:start + 1])
            at = start + 1
            continue
        end = page.find(">", start + 1)
        if end < 0:  # no tag ends any more
            say(page[at:])
            break
        if m is not None and quotes:
            whole = _QUOTED.match(page, m.end())
            quotes = whole is not None
            end = whole.end() - 1 if whole else end
        say(page[at:start])
        at = end + 1
        if m is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            if tag == "p" or tag not in VOID:
                limit = {"table"} if tag in BLOCK and tag not in ("table", "body", "html") else BLOCK if tag not in BLOCK else set()
                close({tag}, limit - {tag})
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button"} | (BLOCK - {"p"}))
        if tag in ENDS_AT:
            close(*ENDS_AT[tag])
        raw = _RAW_END.get(tag)
        if raw is not None:
            found = raw.search(page, at)
            end = page.find(">", found.end()) if found else -1
            at = end + 1 if end >= 0 else n
            continue
        if tag == "body":
            here = top
            opened.clear()
        here = Element(tag, page[m.end():end], here)
        elements.append(here)
        opened[tag] += 1
    flush()
    weigh(elements)
    return out


def score(block: Block, has_article: bool) -> float:
    """Above 0: more likely content."""
    words = block.text.count(" ") + 1
    tag, e = block.within.tag, block.within
    s = e.score - 0.3 + min(words, 60) / 15
    s += 1.0 if block.text[-1] in ".!?…\"”»'" else 0.0
    s += 1.5 if tag in ("p", "blockquote", "pre") else 1.0 if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0
    s += 0.6 if tag in ("li", "dd", "td") and not block.link else 0.0
    s -= 5.0 * min(1.0, block.link / len(block.text)) * (0.3 if e.article else 1.0)
    s += 3.0 if e.article else -5.0 if has_article else 0.0
    return s


def cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is content in the minimum cut. costs: of calling it content, and boilerplate."""
    n = len(costs)
    prefer = [b - c for c, b in costs]  # above 0: content is cheaper
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(prefer[i]) >= sum(near[i].values()):
            label[i] = prefer[i] > 0
            for j, w in near[i].items():
                prefer[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    if None in label:
        for i, side in _max_flow([i for i in range(n) if label[i] is None], prefer, near).items():
            label[i] = side
    return label


def _max_flow(nodes: list[int], prefer: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Labels of the nodes by maximum flow along shortest paths; those that the source still reaches
    are content."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        room[source][i], room[i][source] = max(prefer[i], 0.0), 0.0
        room[i][sink], room[sink][i] = max(-prefer[i], 0.0), 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, w in room[a].items():
                if w > 1e-9 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return {i: i in came for i in nodes}
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow


def _between(a: Element, b: Element) -> int:
    """Elements on the way from one to the other, 64 at most."""
    steps = 0
    while a is not b and steps < 64:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    has_article = any(b.within.article for b in found)
    costs = []
    for b in found:
        s = score(b, has_article)
        costs.append((log1p(exp(-s)) if s > -30 else -s, log1p(exp(s)) if s < 30 else s))
    edges, last = [], {}
    for i, b in enumerate(found):
        before = last.get(b.within.parent)
        if i:
            edges.append((i - 1, i, _SMOOTH / (1 + _between(found[i - 1].within, b.within))))
        if before is not None and before != i - 1:
            edges.append((before, i, _SMOOTH / 3))
        last[b.within.parent] = i
    return "\n".join(b.text for b, keep in zip(found, cut(costs, edges)) if keep)


def extract(pages: DataFrame, html: str = "html", text_out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns in keep) with the main text."""
    prepare(pages.sparkSession)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(h) for h in batch.column(html).to_pylist()], pa.string())]

    return with_columns(pages, make, f"`{text_out}` string", keep)
