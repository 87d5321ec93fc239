"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text (a run of inline content inside one block
element). A small linear classifier gives each block a cost for being called
content and one for being called boilerplate; these become capacities from the
source and to the sink. Neighbouring blocks, and blocks that follow one another
under the same parent element, are joined by smoothness edges that are stronger
the closer the blocks are in the element tree. The minimum cut, found by
augmenting paths, separates content from boilerplate. What can never be content
(scripts, styles, titles, comments, templates, controls, drawings) makes no
block at all.

Defined cases. Null or empty html gives an empty text. Unclosed or stray tags
are accepted: a block element ends an open paragraph, an end tag without its
start is ignored, and the end of the page closes everything and drops a tag that it
cuts off. Work grows with the page's length, however deep its elements are nested. A template, control
or drawing whose end tag is missing hides its own text only, not the headings,
paragraphs, sections and other such elements that come to lie inside it. Character
references are decoded after the tags are found. Repeated rows give repeated
answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import mapped, slices, table

#: A comment, a tag (a quote counts in a value only, and one that is never closed does not) or a declaration.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*>", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
SPACE = re.compile(r"\s+")
OPEN_END = re.compile(r"<[A-Za-z/!?]")  # a tag or comment that the page ends in
RAW = {"script", "style", "title", "textarea", "iframe"}  # HTML reads these up to their end tag
#: Elements whose blocks are boilerplate; their tags are read as any others.
NEVER = {"noscript", "template", "svg", "object", "select", "datalist", "optgroup", "option", "button", "math", "canvas", "audio", "video"}
#: Elements that are content of their own, even in one of NEVER that was left open.
FLOW = {"article", "main", "section", "div", "p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "figure", "details", "address", "hgroup", "li", "dt", "dd", "tr", "td", "th", "caption", "figcaption", "summary", "fieldset", "center", "nav", "header", "footer", "aside", "form", "dialog", "menu"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that close an open element of the given kinds when they start.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SECTIONS = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
WORDS_AGAINST = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|menu\w*|nav\w*|breadcrumbs?|sidebar\w*|widget\w*|footer|masthead|complementary|contentinfo|cookies?|consent|gdpr|notice\w*|alert|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|respond|disqus|pagination|pager|search|toolbar|copyright|legal|disclaimer)(?:[^a-z]|$)|(?:^|\s)side(?:\s|$)", re.I)
HEADER = re.compile(r"(?:^|[^a-z])header(?:[^a-z]|$)", re.I)  # boilerplate unless it is the article's own
WORDS_FOR = re.compile(r"(?:^|[^a-z])(?:article\w*|content|entry|post|story|main|body|text|page)(?:[^a-z]|$)", re.I)

#: Weights of the classifier: log odds that a block is content.
BIAS, IN_ARTICLE, IN_MAIN, IN_SECTION, MARKED_AGAINST, MARKED_FOR, LINKED, LONG, LISTED, PARAGRAPH = -0.6, 3.2, 2.4, -6.0, -5.0, 0.8, -3.0, 1.2, -0.2, 1.4
SMOOTH = 0.9


def is_hidden(attrs: str) -> bool:
    """Whether an element's own attributes hide it: hidden, aria-hidden="true", or such a style."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN.search(value)):
            return True
    return False


class Node:
    """An open element other than an inline one. What its ancestors say is carried along, so a block needs no list of
    them: ``odds`` and ``inner`` for the classifier, the depths of the last flow element and article for ``shown``."""

    __slots__ = ("name", "parent", "depth", "border", "inner", "article", "main", "odds", "flow", "story", "ended", "open_never", "ended_never", "never")

    def __init__(self, name: str, marks: str, parent: "Node | None"):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 1
        own = name in ("article", "main")
        against, header = bool(marks and WORDS_AGAINST.search(marks)), bool(marks and HEADER.search(marks))
        self.border = own or name in SECTIONS or against or header
        self.inner = own or bool(parent and parent.inner)  # a section element inside the article may hold its headline
        self.article, self.main = (name == "article" or bool(parent and parent.article)), (name == "main" or bool(parent and parent.main))
        odds = parent.odds if parent else 0.0
        if name in SECTIONS and not (name == "header" and self.inner):
            odds += IN_SECTION
        if against or (header and not self.inner):
            odds += MARKED_AGAINST
        elif marks and WORDS_FOR.search(marks):
            odds += MARKED_FOR
        self.odds = odds
        self.flow = self.depth if name in FLOW or "-" in name else (parent.flow if parent else 0)
        self.story = self.depth if own else (parent.story if parent else 0)
        self.ended = False

    def settle(self) -> None:
        """Once the page is read: the depths of the deepest ancestors of NEVER without and with an end tag, and whether
        one of those hides whatever it holds. Parents are settled first."""
        up = self.parent
        self.open_never, self.ended_never, self.never = (up.open_never, up.ended_never, up.never) if up else (0, 0, False)
        if self.name in NEVER:
            if not self.ended:
                self.open_never = self.depth
            else:
                self.ended_never = self.depth
                self.never |= self.name in ("noscript", "template")

    def shown(self) -> bool:
        """Whether a block here may be content: not in an element of NEVER before its end tag, nor in the own text of one
        without. An article that an end tag far behind would enclose is not part of a control or drawing."""
        return not self.never and (not self.open_never or self.flow > self.open_never) and (not self.ended_never or self.story > self.ended_never)


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, in time that grows with its length whatever its tags."""
    out: list[Block] = []
    nodes: list[Node] = []
    stack: list[tuple[str, Node | None]] = []  # open elements; an inline one has no node
    solid: list[int] = []  # places in the stack of those that are not inline
    inline: list[dict[str, int]] = [{}]  # open inline elements since the last of those, by name
    count: dict[str, int] = {}  # open elements that are not inline, by name
    parts: list[str] = []
    links, link_chars, at, last = 0, 0, 0, page.rfind(">")

    def top() -> Node | None:
        return stack[solid[-1]][1] if solid else None

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Block(text, top(), link_chars))
        link_chars = 0

    def close(k: int) -> None:
        nonlocal links
        for name, node in reversed(stack[k:]):
            if node:
                solid.pop()
                inline.pop()
                count[name] -= 1
            else:
                inline[-1][name] -= 1
                links -= name == "a"
        del stack[k:]

    while True:
        m = TOKEN.search(page, at) if at <= last else None
        end = m.start() if m else len(page)
        if not m and (cut := OPEN_END.search(page, at)):
            end = cut.start()
        if end > at:
            chunk = page[at:end]
            parts.append(chunk)
            if links:
                link_chars += len(chunk.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            if name in INLINE:
                if inline[-1].get(name):
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    close(k)
                continue
            flush()
            if count.get(name):
                k = len(solid) - 1
                while stack[solid[k]][0] != name:
                    k -= 1
                stack[solid[k]][1].ended = True
                close(solid[k])
            continue
        if name in RAW and not attrs.endswith("/"):
            if name not in INLINE:
                flush()
            over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        if name == "br":
            parts.append(" ")
        elif name not in INLINE:
            flush()
            if solid and (((above := stack[solid[-1]][0]) == "p" and name not in NEVER) or above in IMPLIED.get(name, ())):
                close(solid[-1])
        if name in VOID or attrs.endswith("/"):
            continue
        if name in INLINE:
            inline[-1][name] = inline[-1].get(name, 0) + 1
            stack.append((name, None))
            links += name == "a"
            continue
        marks = " ".join(x for y in MARKS.findall(attrs) for x in y if x) if attrs else ""
        if attrs and is_hidden(attrs):
            marks += " popup"
        node = Node(name, marks, top())
        nodes.append(node)
        solid.append(len(stack))
        stack.append((name, node))
        inline.append({})
        count[name] = count.get(name, 0) + 1
    flush()
    for node in nodes:
        node.settle()
    return [b for b in out if b.node is None or b.node.shown()]


def log_odds(block: Block) -> float:
    """The classifier: above 0 a block looks like content."""
    x, node, n = BIAS, block.node, len(block.text)
    if node:
        x += node.odds + IN_ARTICLE * node.article + IN_MAIN * node.main
    x += LINKED * min(1.0, block.linked / n) + LONG * min(n, 200) / 200
    tag = node.name if node else ""
    if tag == "li":
        x += LISTED
    if tag in ("p", "pre", "blockquote") or (tag[:1] == "h" and tag[1:].isdigit()):
        x += PARAGRAPH
    return x


def _near(a: Block, b: Block) -> float:
    """The strength of the edge between two blocks: SMOOTH over the steps between their parents in the tree, and
    none across the border of a section, article or marked element."""
    if (a.node and a.node.border) or (b.node and b.node.border):
        return 0.0
    x, y, steps = a.node and a.node.parent, b.node and b.node.parent, 0
    while x is not y:  # up from the deeper one until the paths meet
        if y is None or (x is not None and x.depth >= y.depth):
            x, left = x.parent, x
        else:
            y, left = y.parent, y
        if left.border:
            return 0.0
        steps += 1
    return SMOOTH / (1 + steps)


def minimum_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes end on the source's side: node i pays -gain[i] (if below 0) there, gain[i] (if above) on the
    other, and every edge whose ends are parted costs its capacity. Shortest augmenting paths."""
    n = len(gain)
    excess = [max(g, 0.0) for g in gain]
    room = [max(-g, 0.0) for g in gain]
    flow: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        if c > 0:
            flow[i][j] = flow[i].get(j, 0.0) + c
            flow[j][i] = flow[j].get(i, 0.0) + c
    tiny, dead = 1e-12, bytearray(n)
    for source in range(n):
        # Nodes that an exhausted source reaches can reach no sink, now or later: they are on the source's side.
        while excess[source] > tiny and not dead[source]:
            before, work, goal, at = {source: -1}, [source], -1, 0
            while at < len(work):
                i = work[at]
                at += 1
                if room[i] > tiny:
                    goal = i
                    break
                for j, c in flow[i].items():
                    if c > tiny and j not in before and not dead[j]:
                        before[j] = i
                        work.append(j)
            if goal < 0:
                for i in work:
                    dead[i] = 1
                break
            path = [goal]
            while before[path[-1]] >= 0:
                path.append(before[path[-1]])
            push = min([room[goal], excess[source], *(flow[path[k + 1]][path[k]] for k in range(len(path) - 1))])
            room[goal] -= push
            excess[source] -= push
            for k in range(len(path) - 1):
                flow[path[k + 1]][path[k]] -= push
                flow[path[k]][path[k + 1]] = flow[path[k]].get(path[k + 1], 0.0) + push
    return [bool(x) for x in dead]


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbours and between blocks that follow one another under one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[Node | None, int] = {}
    for i, b in enumerate(found):
        parent = b.node.parent if b.node else None
        for j in {i - 1, last.get(parent, -1)}:
            if j >= 0:
                edges[j, i] = _near(found[j], b)
        last[parent] = i
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by a space."""
    found = blocks(page or "")
    if not found:
        return ""
    gains = [log_odds(b) for b in found]
    if min(gains) > 0 or max(gains) < 0:
        label = [g > 0 for g in gains]  # the cut that parts no edge
    else:
        label = minimum_cut(gains, smoothness(found))
    return " ".join(b.text for b, content in zip(found, label, strict=True) if content)


def _extract(batches):
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; a map over the table, without a shuffle."""
    return mapped(pages.selectExpr("cast(page_id as bigint) as page_id", "url", "html"), _extract, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extract": op3_html_extract}
ORACLES: dict[str, str] = {}
