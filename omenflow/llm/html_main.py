"""Main text of web pages: a minimum cut between content and boilerplate blocks."""

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe"}
#: No part of a text either, but only up to their end tag: without one, or where a text block begins before it, the tag alone goes.
ASIDE = {"noscript", "template", "svg", "object", "select", "button"}
#: Tags that no button, list of choices or drawing holds, and that end a formula.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "blockquote", "ul", "ol", "table", "figure", "pre"}
INLINE = {
    "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element that opens ends these open ones first.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BAD_WORDS = {
    "nav", "navbar", "navigation", "menu", "header", "masthead", "topbar", "footer", "foot", "sidebar", "aside", "rail", "ad", "ads", "adv", "advert",
    "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promotion", "promoted", "sponsor", "sponsored", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "dialog", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "share", "sharing", "social", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget",
    "toolbar", "copyright", "legal", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "form", "login", "search", "hidden",
    "contentinfo", "complementary", "skip", "trending", "popular",
}
#: Bad words that say where a box lies: on an article itself they describe the page around it.
LAYOUT_WORDS = {"sidebar", "header", "footer", "nav", "navbar", "navigation", "menu", "aside", "rail", "topbar", "toolbar"}
#: Bad words that on an article itself tell what it is about or where it was found.
TOPIC_WORDS = {"search", "form", "login", "legal", "popular", "trending", "notice", "notices"}
#: Words that stand beside "comment" in the name of a comment; with any other word the name is one of an article.
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "div", "item", "list", "body", "thread", "depth", "even", "odd", "alt", "user", "reader", "byuser", "bypostauthor", "parent", "author", "box", "section"}
#: A class name with one of these tells what a box has beside it, not what it is.
BESIDE_WORDS = {"has", "no", "with", "without", "is"}
GOOD_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text", "maincontent"}
TAG_WEIGHT = {
    "article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -5.0, "menu": -9.0, "dialog": -9.0, "head": -20.0,
    "figure": -0.5, "figcaption": -0.5, "address": -2.0, "fieldset": -9.0,
}
BAD_WEIGHT, GOOD_WEIGHT = -9.0, 2.0
#: Smoothness: next to each other under one parent, next to each other in different ones, and across the edge of a marked region.
SIBLING, NEIGHBOUR, CROSSING = 0.8, 0.4, 0.05

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S
)
_NAMED = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = {"class", "id", "role", "aria-label", "hidden", "aria-hidden", "style"}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Element:
    __slots__ = ("tag", "weight", "region", "parent", "inside")

    def __init__(self, tag, weight, region, parent):
        self.tag, self.region, self.parent = tag, region, parent
        self.weight = weight + (parent.weight if parent else 0.0)  # that of all around it included
        self.inside = 0  # open elements of the same tag in an inline one


def _evidence(tag: str, attributes: str) -> float:
    """What an element says about everything inside it."""
    weight = TAG_WEIGHT.get(tag, 0.0)
    if attributes and tag not in ("html", "body"):
        words = set()
        for name, a, b, c in _NAMED.findall(attributes):
            name, value = name.lower(), a or b or c
            if name not in _TELLING:
                continue
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                weight += BAD_WEIGHT
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    weight += BAD_WEIGHT
            else:
                for name in value.split():
                    own = set(_WORDS.findall(_CAMEL.sub(" ", name).lower()))
                    if tag in ("article", "main"):
                        own -= LAYOUT_WORDS | TOPIC_WORDS
                        own -= set() if own <= COMMENT_WORDS else COMMENT_WORDS - GOOD_WORDS
                    words |= set() if own & BESIDE_WORDS else own
        bad = words & BAD_WORDS
        if bad:
            weight += BAD_WEIGHT
        elif words & GOOD_WORDS:
            weight += GOOD_WEIGHT
    return weight


def page_blocks(page: str) -> list[tuple[str, float, int, int, bool]]:
    """(text, score, parent, region, plain) of each text block in page order; the score is above 0 for likely content.

    Blocks end where an element that is not inline begins or ends. `region` numbers the nearest element around the
    block that tells for or against content; `plain` says that nothing around the block tells against it.
    """
    root = _Element("", 0.0, 0, None)
    stack, blocks, parts = [root], [], []
    links = chars = regions = 0
    in_link = in_formula = False
    numbers = {id(root): 0}
    kept = [root]
    opened: Counter = Counter()
    ends: dict[str, re.Pattern] = {}

    def close(at):
        """Close the elements from this place of the stack on."""
        for e in stack[at:]:
            opened[e.tag] -= 1
        del stack[at:]

    def skipped(tag, start):
        """Where an element that is no text ends; its start if it has no end of its own."""
        if tag not in ends:
            ends[tag] = re.compile(rf"<(/?)({tag}|{'|'.join(sorted(BLOCKS))})\b[^>]*>" if tag in ("button", "select", "svg") else rf"<(/?)({tag})\b[^>]*>", re.I)
        end = ends[tag].search(page, start)
        return end.end() if end and end[1] and end[2].lower() == tag else start

    def flush():
        nonlocal links, chars
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1]
                score = top.weight
                density = links / max(1, chars)
                score += -0.4 + min(2.0, len(text) / 60) - 5.0 * (density > 0.5) - density
                score += 0.4 * min(3, sum(text.count(c) for c in ".!?,;"))
                if top.tag in HEADINGS:
                    score += 2.5
                elif top.tag == "p":
                    score += 1.0
                elif top.tag == "li" and density > 0.3:
                    score -= 1.5
                blocks.append((text, score, numbers[id(top.parent or top)], top.region, top.weight > -0.6 and density <= 0.5))
            links = chars = 0

    def add(text):
        nonlocal links, chars
        if text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            size = len(text.strip())
            chars += size
            links += size if in_link else 0

    def marked(tag):
        """The place of the nearest open inline element of this tag within the current block, or 0."""
        at = len(stack) - 1
        while stack[at].tag in INLINE and stack[at].tag != tag:
            at -= 1
        return at if stack[at].tag == tag else 0

    pos, size = 0, len(page)
    while pos < size:
        found = _TAG.search(page, pos)
        if not found:
            add(page[pos:])
            break
        add(page[pos:found.start()])
        pos = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = end.end() if end else size
            continue
        if tag in ASIDE:
            if not closing and not attributes.endswith("/"):
                pos = skipped(tag, pos)
            continue
        if tag == "math" or (in_formula and tag not in BLOCKS):
            in_formula = not (tag == "math" and closing)
            continue
        in_formula = False
        if tag == "a":
            in_link = not closing
        elif tag in ("br", "wbr", "img", "hr"):
            if tag != "wbr":
                parts.append(" ")
        elif tag in VOID or tag in RAW:
            pass
        elif tag in INLINE and closing:
            at = marked(tag)
            if at and stack[at].inside:
                stack[at].inside -= 1
            elif at:
                flush()
                close(at)
        elif tag in INLINE and _evidence(tag, attributes) >= 0:
            at = marked(tag)
            if at:
                stack[at].inside += 1
        elif closing:
            flush()
            in_link = False
            if opened[tag]:
                at = len(stack) - 1
                while stack[at].tag != tag:
                    at -= 1
                close(at)
        else:
            flush()
            in_link = in_link and tag in INLINE
            while len(stack) > 1 and stack[-1].tag in ENDS.get(tag, ()):
                close(len(stack) - 1)
            weight = _evidence(tag, attributes)
            region = stack[-1].region
            if weight:
                regions += 1
                region = regions
            element = _Element(tag, weight, region, stack[-1])
            numbers[id(element)] = len(numbers)
            kept.append(element)  # keeps id() unique
            stack.append(element)
            opened[tag] += 1
    flush()
    return blocks


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    A positive score is the capacity from the source, a negative one that to the sink; an edge has
    its capacity both ways. Each round numbers the nodes by their distance from the source and pushes flow along
    growing numbers until nothing gets through, never trying an arc twice; what the source still reaches in the
    end is content.
    """
    n, least = len(scores), 1e-9
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    give, take = [max(0.0, s) for s in scores], [max(0.0, -s) for s in scores]
    while True:
        level = [0 if g > least else -1 for g in give]
        queue = [i for i in range(n) if not level[i]]
        starts, open_ = list(queue), False
        for a in queue:  # grows while it is read
            open_ = open_ or take[a] > least
            for e in arcs[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if not open_:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in starts:
            path, at = [], start
            while give[start] > least:
                if take[at] > least:
                    flow = min([give[start], take[at], *(room[e] for e in path)])
                    give[start] -= flow
                    take[at] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, at = [], start
                    continue
                while tried[at] < len(arcs[at]):
                    e = arcs[at][tried[at]]
                    if room[e] > least and level[to[e]] == level[at] + 1:
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                    continue
                path.append(e)
                at = to[e]


def main_text(page: str) -> str:
    blocks = page_blocks(page)
    edges = []
    last: dict[int, int] = {}
    for i, (_, _, parent, region, _) in enumerate(blocks):
        if i:
            same = region == blocks[i - 1][3]
            edges.append((i - 1, i, CROSSING if not same else NEIGHBOUR))
        if parent in last and region == blocks[last[parent]][3]:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    content = minimum_cut([b[1] for b in blocks], edges)
    if not any(content):  # a few words, and nothing that tells against them
        content = [b[4] for b in blocks]
    return " ".join(b[0] for b, keep in zip(blocks, content) if keep)


def _extracted(batches):
    for batch in batches:
        texts = [main_text(p or "") for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`, from the whole html.

    Text blocks are nodes. A classifier over their surroundings, links and wording gives the capacity to
    content or to boilerplate; blocks that stand next to each other or under one parent are tied. The
    minimum cut says what is content; character references are decoded, white space is single.

    Null or empty html, or a page without content, gives an empty text. Null ids and urls stay;
    repeated rows each give their row; an empty table gives none.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(_extracted, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
