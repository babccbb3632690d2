"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a list of text blocks. A linear classifier gives each block a cost for
being content or boilerplate; the costs are the capacities of its edges to the two
terminals. Blocks that follow each other or hang close together in the document tree
are tied by smoothness edges. The minimum cut labels all blocks of a page at once.

Only elements whose kind settles it (forms, menus, footers, scripts, what is hidden) lie
outside whatever surrounds them. Names in class, id and role are evidence of a bounded
weight: more where a name is the whole token, little where it is part of one that also says
what a wrapper has or lacks, and next to none on elements that hold the page's principal
article or most of its text. What they leave open, a heading of two words or a list among
paragraphs, a long sentence among links, the edges decide.

Tags are read in one pass; both kinds of quotes are paired, and a tag that is never closed
ends before the next one begins. A null or empty page has no text.
"""

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements by what they do to the text around them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main "
    "menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead "
    "tr ul".split()
)
# What stands inside is no text of the page. The second kind is left alone if it never ends.
RAW_TAGS = frozenset(
    "script style noscript template textarea title iframe noembed noframes".split()
)
EMBEDDED_TAGS = frozenset("object svg math canvas audio video".split())
VOID_TAGS = frozenset("hr".split())
OUTSIDE_TAGS = frozenset(
    "nav aside footer form head menu button select dialog search fieldset option optgroup".split()
)
PRINCIPAL_TAGS = frozenset(["article", "main"])
# Words in class, id and role that speak of parts that are not the article.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment "
    "comments cookie cookies consent complementary contentinfo discussion disqus dialog footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination "
    "pager popup promo promoted recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget alert".split()
)
HEADER_WORDS = frozenset(["header", "topbar"])
INSIDE_WORDS = frozenset(
    "article content entry main post story text body prose".split()
)
# Beside these, a word tells what a wrapper has, lacks or encloses.
STATE_WORDS = frozenset(
    "no has have with without status open closed enabled disabled allow is on off left right wrap "
    "wrapper layout page results site single template type format category tag".split()
)
SAME_CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
# Weights of the block classifier, as log-odds of being content.
WEIGHTS = {
    "bias": -0.6, "article": 3.0, "outside": -8.0, "named_inside": 0.8, "paragraph": 1.2,
    "heading": 0.6, "item": -0.4, "words": 0.6, "sentence": 0.5, "links": -3.5,
}
# What an element's names add: a whole token, part of one, part of one that tells a state; the
# least they add up to along the path; and the share that counts on wrappers of the article.
NAMED, NAMED_PART, NAMED_STATE, NAMED_LEAST, WRAPPER = -5.0, -3.0, -1.0, -6.0, 0.1
# Smoothness: neighbours, less by their distance in the tree; blocks of one parent; blocks
# between which a name or an article begins or ends are tied less.
ADJACENT, SIBLING, ACROSS = 1.6, 1.0, 0.25
SCALE = 1000  # capacities are whole numbers

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_QUOTED = re.compile(
    r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|"[^"<>]*+<[^">]*+"|'[^'<>]*+<[^'>]*+')*+>""")
_RAW_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS | EMBEDDED_TAGS}
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")


class Element:
    """An element of the tree; sizes and names are settled when the page has been read."""

    __slots__ = ("tag", "parent", "depth", "outside", "inside", "principal", "words", "cost",
                 "helps", "size")

    def __init__(self, tag: str, parent: "Element | None"):
        self.tag = tag
        self.parent = parent
        self.depth = parent.depth + 1 if parent else 0
        self.outside = bool(parent and parent.outside)
        self.inside = tag in PRINCIPAL_TAGS or bool(parent and parent.inside)
        self.principal = False
        self.words = self.cost = 0.0
        self.helps = 0.0
        self.size = 0


class Block:
    """Text of one block and what the classifier and the edges need to know of it."""

    __slots__ = ("text", "linked", "place")

    def __init__(self, text: str, linked: int, place: Element):
        self.text = text
        self.linked = linked
        self.place = place


def _hidden(attributes: str) -> bool:
    """Whether an element's attributes keep it from being seen."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for m in _ATTRIBUTES.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not value.lower().startswith(("false", "until")):
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _UNSEEN.search(value):
            return True
    return False


def _named(attributes: str, inside: bool) -> tuple[float, float]:
    """What the names in the attributes say against an element, and for it."""
    against = helps = 0.0
    bad = OUTSIDE_WORDS if inside else OUTSIDE_WORDS | HEADER_WORDS
    for m in _NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _PARTS.findall(token)]
            if not bad.isdisjoint(words):
                state = not STATE_WORDS.isdisjoint(words) or not INSIDE_WORDS.isdisjoint(words)
                against += (NAMED if len(words) == 1 else NAMED_STATE if state else NAMED_PART)
            elif not INSIDE_WORDS.isdisjoint(words):
                helps = WEIGHTS["named_inside"]
    return max(against, NAMED), helps


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; white space within one is a single space."""
    found: list[Block] = []
    pieces: list[str] = []
    linked = 0
    in_link = False
    root = Element("", None)
    elements = [root]
    stack = [root]
    open_tags: dict[str, int] = {}
    never: set[str] = set()  # ends that the rest of the page does not hold
    at, length = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                found.append(Block(text, linked, stack[-1]))
                stack[-1].size += len(text)
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if in_link:
            linked += len(text)

    def close(i: int) -> None:
        for element in stack[i:]:
            open_tags[element.tag] -= 1
        del stack[i:]

    def end_of(mark: str, start: int) -> int:
        """Place of a mark from a start on, or -1; a mark that is missing is sought once."""
        if mark in never:
            return -1
        place = page.find(mark, start)
        if place < 0:
            never.add(mark)
        return place

    while at < length:
        start = end_of("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        at = start + 1
        if page.startswith("!--", at):
            end = end_of("-->", at + 3)
            at = end + 3 if end >= 0 else length
            continue
        if at < length and page[at] in "!?":
            end = end_of(">", at)
            if end < 0:
                add("<")
            else:
                at = end + 1
            continue
        closing = page.startswith("/", at)
        m = _NAME.match(page, at + closing)
        if m is None:
            add("<")
            continue
        tag = m[0].lower()
        whole = _QUOTED.match(page, m.end())
        if whole:
            attributes, at = page[m.end() : whole.end() - 1], whole.end()
        else:  # an open quote or no end: up to the next mark of either kind
            end, after = end_of(">", m.end()), end_of("<", m.end())
            end = min([e for e in (end, after) if e >= 0], default=length)
            attributes, at = page[m.end() : end], end + (page[end : end + 1] == ">")
        if tag in RAW_TAGS or tag in EMBEDDED_TAGS:
            if not closing and not attributes.endswith("/") and tag not in never:
                end = _RAW_ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW_TAGS:
                    at = length
                else:
                    never.add(tag)
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            pieces.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if closing:
            if open_tags.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag not in ("td", "th", "tr", "option") and stack[-1].tag == "p":
            close(len(stack) - 1)
        if stack[-1].tag in SAME_CLOSES.get(tag, ()):
            close(len(stack) - 1)
            if tag == "tr" and stack[-1].tag == "tr":
                close(len(stack) - 1)
        if tag in VOID_TAGS:
            continue
        element = Element(tag, stack[-1])
        if not element.outside and tag not in ("html", "body"):
            element.outside = (
                tag in OUTSIDE_TAGS or tag == "header" and not element.inside
                or bool(attributes) and _hidden(attributes))
            if "=" in attributes:
                element.words, element.helps = _named(attributes, element.inside)
        elements.append(element)
        stack.append(element)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    _weigh(elements)
    return found


def _weigh(elements: list[Element]) -> None:
    """Sums text over the tree, finds the principal article and settles what names add."""
    for element in reversed(elements):
        if element.parent and not element.outside:
            element.parent.size += element.size
    for element in elements[1:]:
        element.cost = element.parent.cost + element.words
    articles = [e for e in elements
                if e.tag in PRINCIPAL_TAGS and not e.outside and e.cost > NAMED_PART]
    # The largest article; of nested ones the innermost that holds most of the outer one's text.
    article = max(articles, key=lambda e: (e.size, -e.depth), default=None)
    for element in articles:
        if article and element.depth > article.depth and 2 * element.size > article.size and (
                _within(element, article)):
            article = element
    at = article
    while at:
        at.principal = True
        at = at.parent
    most = (article or elements[0]).size / 2
    for element in elements:
        parent = element.parent
        if parent is None:
            continue
        element.helps = max(element.helps, parent.helps)
        wraps = element.principal or element.size > most and (
            article is None or _within(element, article))
        own = element.words * (WRAPPER if wraps else 1.0)
        element.cost = max(NAMED_LEAST, parent.cost + own)


def _within(element: Element, other: Element) -> bool:
    while element and element.depth > other.depth:
        element = element.parent
    return element is other


def score(block: Block) -> float:
    """Log-odds that a block is part of the article."""
    w, place, text = WEIGHTS, block.place, block.text
    total = w["bias"] + place.helps + w["links"] * min(1.0, block.linked / len(text))
    if place.outside:
        return total + w["outside"]
    tag = place.tag
    evidence = w["words"] * (math.log2(1 + text.count(" ")) - 2)
    if place.inside:
        evidence += w["article"]
    if tag in ("p", "pre", "blockquote"):
        evidence += w["paragraph"]
    elif len(tag) == 2 and tag[0] == "h":
        evidence += w["heading"]
    elif tag in ("li", "td", "th", "dt", "dd"):
        evidence += w["item"]
    if _SENTENCE.search(text):
        evidence += w["sentence"]
    # In a part that names speak against, text that looks like an article's says less.
    doubt = 1 + place.cost / NAMED_LEAST
    return max(-9.0, min(9.0, total + place.cost + evidence / doubt))


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours in the page, and the last block of the same parent."""
    edges = []
    last: dict[int, int] = {}
    for j, block in enumerate(blocks):
        place = block.place
        if j:
            a, b, apart, bounds = blocks[j - 1].place, place, 0, False
            while a is not b:  # up to the element both hang below
                if a.depth >= b.depth:
                    bounds |= _bounds(a)
                    a = a.parent
                else:
                    bounds |= _bounds(b)
                    b = b.parent
                apart += 1
            tie = ADJACENT / (1 + apart / 2) * (ACROSS if bounds else 1.0)
            edges.append((j - 1, j, int(SCALE * tie)))
        parent = id(place.parent or place)
        i = last.get(parent)
        if i is not None:
            edges.append((i, j, int(SCALE * SIBLING)))
        last[parent] = j
    return edges


def _bounds(element: Element) -> bool:
    """Whether a part of another kind begins with the element."""
    parent = element.parent
    return (element.tag in PRINCIPAL_TAGS or element.words <= NAMED_PART
            or element.outside != parent.outside)


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Sides of a minimum cut: true where a node stays with the source.

    A positive score is the capacity from the source, a negative one to the sink. A node
    whose score outweighs all its edges lies on that side in every minimum cut, so it is
    folded into its neighbours' scores first; flow is sent through the rest.
    """
    n = len(scores)
    scores = list(scores)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, capacity in edges:
        if i != j and capacity:
            around[i][j] = around[i].get(j, 0) + capacity
            around[j][i] = around[j].get(i, 0) + capacity
    tied = [sum(a.values()) for a in around]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(scores[i]) < tied[i]:
            continue
        side[i] = scores[i] > 0
        for j, capacity in around[i].items():
            if side[j] is None:
                scores[j] += capacity if side[i] else -capacity
                tied[j] -= capacity
                queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, kept in zip(rest, _max_flow(rest, scores, around)):
            side[i] = kept
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], scores: list[int], around: list[dict[int, int]]) -> list[bool]:
    """Side of each node after a maximum flow (shortest paths by level, as Dinic does)."""
    place = {node: k for k, node in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    heads: list[int] = []
    caps: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def connect(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(heads))
        heads.append(b)
        caps.append(forth)
        out[b].append(len(heads))
        heads.append(a)
        caps.append(back)

    for node, k in place.items():
        if scores[node] > 0:
            connect(source, k, scores[node], 0)
        elif scores[node] < 0:
            connect(k, sink, -scores[node], 0)
        for other, capacity in around[node].items():
            if place.get(other, -1) > k:
                connect(k, place[other], capacity, capacity)
    while True:
        level = [-1] * (sink + 1)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if caps[e] and level[heads[e]] < 0:
                    level[heads[e]] = level[a] + 1
                    queue.append(heads[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        turn = [0] * (sink + 1)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                amount = min(caps[e] for e in path)
                for e in path:
                    caps[e] -= amount
                    caps[e ^ 1] += amount
                cut = next(i for i, e in enumerate(path) if not caps[e])
                a = heads[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if caps[e] and level[heads[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = heads[path[-1]]
            elif a == source:
                break
            else:
                level[a] = -1
                a = heads[path.pop() ^ 1]


def main_text(page: str | None) -> str:
    """Blocks of the article, one per line; empty if a page has none."""
    blocks = blocks_of(page) if page else []
    kept = minimum_cut([int(score(b) * SCALE) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


@F.arrow_udf(StringType())
def extract(page: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in page], pa.string())


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url",
               page: str | Column = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; a null page has an empty text."""
    return pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), extract(page).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
