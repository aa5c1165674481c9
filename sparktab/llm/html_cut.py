"""Main text of web pages by minimum-cut labelling.

A page becomes blocks: runs of text between block-level tags, each with its open elements. A linear classifier gives every block a chance of being
content from its elements, their class and id words, its length, links and punctuation; the costs -log p and -log (1 - p) are the
capacities from the source and to the sink. Smoothness edges join neighbouring blocks, stronger the more open elements they share, and each block
with the one before it under the same parent. The minimum cut of this graph labels all blocks at once; content blocks are the main text.

The weights are fixed parameters, so a page's text depends on the page alone. Scripts, styles, comments and the head are no blocks. A <br> is
white space. Null and empty pages have the empty text. Broken markup never fails: an unclosed comment or script runs to the end, other stray
signs are text. Repeated rows are extracted each for itself. An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")
#: Elements whose inside is not markup and no text of the page.
RAW = frozenset("script style noscript template iframe textarea title svg math select object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul label".split()
)
#: A start tag closes an open element of these kinds, if it is the innermost block.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements and class words of page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset legend label option summary".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright "
    "disclaimer discussion disqus donate footer gdpr login masthead menu modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination "
    "paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "toolbar topbar warning alert complementary responses widget widgets aside feedback form".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Weights of the classifier (log odds).
WEIGHTS = {
    "start": -0.6, "article": 3.0, "furniture": -9.0, "furniture_word": -7.0, "header": -5.0, "content_word": 1.0, "heading": 0.6, "paragraph": 1.0, "item": -0.4,
    "words": 0.06, "links": -4.0, "sentence": 0.6, "hidden": -9.0,
}
MOST_WORDS = 40
#: Smoothness of neighbouring blocks, for each shared share of open elements, and of siblings.
NEAR, SIBLING = 0.5, 0.4
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Element:
    __slots__ = ("tag", "parent", "depth", "furniture", "word", "content", "article", "header", "hidden", "last")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        words = {w.lower() for m in _MARK.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")} if attributes and "=" in attributes else ()
        root = tag in ("html", "body", "main", "article")
        inside = bool(parent and parent.article)
        self.article = inside or tag in ("article", "main") or "main" in words and not root
        self.furniture = bool(parent and parent.furniture) or tag in FURNITURE
        self.header = bool(parent and parent.header) or not inside and (tag == "header" or not root and "header" in words)
        self.word = bool(parent and parent.word) or not root and any(w in FURNITURE_WORDS for w in words)
        self.content = bool(parent and parent.content) or any(w in CONTENT_WORDS for w in words)
        self.hidden = bool(parent and parent.hidden) or bool(attributes and _HIDDEN.search(attributes))
        self.last: int | None = None  # the latest block right under this element


def blocks_of(page: str) -> list[tuple[str, Element, int]]:
    """(text, innermost block element, letters inside links) of all blocks with text, in page order."""
    out: list[tuple[str, Element, int]] = []
    here = Element("#page", "", None)
    parts: list[str] = []
    in_link, linked, in_head = 0, 0, False

    def close():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, here, min(linked, len(text))))
            parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            piece, at = page[at:], n
        else:
            piece = page[at:m.start()]
            at = m.end()
        if piece and not in_head:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if m is None:
            break
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if tag in RAW and not ends:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = n if stop < 0 else stop + 1
            if tag not in ("script", "style"):
                parts.append(" ")
            continue
        if tag == "head":
            in_head = not ends
            continue
        if in_head:
            if tag != "body":
                continue
            in_head = False
        if tag == "a":
            in_link = 0 if ends else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            close()
            in_link = 0
            if ends:
                up = here
                while up.parent is not None and up.tag != tag:
                    up = up.parent
                if up.parent is not None:
                    here = up.parent
            elif tag not in VOID:
                if here.tag in CLOSES.get(tag, ()) or here.tag == "p":
                    here = here.parent
                    if tag == "tr" and here is not None and here.tag == "tr":
                        here = here.parent
                here = Element(tag, m[3] or m[6] or "", here)
    close()
    return out


def log_odds(text: str, element: Element, linked: int) -> float:
    w = WEIGHTS
    words = text.count(" ") + 1
    score = w["start"] + w["words"] * min(words, MOST_WORDS) + w["links"] * linked / len(text)
    score += w["article"] * element.article + w["furniture"] * element.furniture + w["furniture_word"] * element.word + w["header"] * element.header + w["hidden"] * element.hidden
    score += w["content_word"] * element.content + w["heading"] * (element.tag in _HEADINGS) + w["paragraph"] * (element.tag in ("p", "pre", "blockquote")) + w["item"] * (element.tag in ("li", "td", "th"))
    return score + w["sentence"] * (text[-1] in ".!?…。»”")


def shared(a: Element, b: Element) -> float:
    """Share of open elements that both have, of the deeper one's."""
    most = max(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth / most if most else 1.0


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut; ``edges`` are undirected. Augments along shortest paths, phase by phase."""
    n = len(source)
    s, t = n, n + 1
    to, room, nodes = [], [], [[] for _ in range(n + 2)]

    def add(a, b, forth, back):
        nodes[a].append(len(to))
        nodes[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i in range(n):
        both = min(source[i], sink[i])  # what flows straight through
        if source[i] > both:
            add(s, i, source[i] - both, 0.0)
        elif sink[i] > both:
            add(i, t, sink[i] - both, 0.0)
    for a, b, weight in edges:
        add(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for a in queue:
            for e in nodes[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            own = nodes[a]
            while nexts[a] < len(own):
                e = own[nexts[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                continue
            path.append(own[nexts[a]])
            a = to[own[nexts[a]]]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    source, sink, edges = [], [], []
    for i, (text, element, linked) in enumerate(blocks):
        odds = max(-30.0, min(30.0, log_odds(text, element, linked)))
        p = 1 / (1 + math.exp(-odds))
        source.append(-math.log(max(1 - p, 1e-12)))  # cut when the block is called boilerplate
        sink.append(-math.log(max(p, 1e-12)))
        if i:
            edges.append((i - 1, i, NEAR * shared(blocks[i - 1][1], element)))
        parent = element.parent
        if parent is not None:
            if parent.last is not None and parent.last != i - 1:
                edges.append((parent.last, i, SIBLING))
            parent.last = i
    if all(a > b for a, b in zip(source, sink)):
        content = [True] * len(blocks)
    else:
        content = minimum_cut(source, sink, edges)
    return "\n\n".join(text for (text, _, _), good in zip(blocks, content) if good)


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, then ``text`` and ``n_chars``."""
    names = pages.columns
    at = names.index(html_column)
    rest = [i for i in range(len(names)) if i != at]
    source = pages.toDF(*(f"x{i}" for i in range(len(names)))).select(*(F.col(f"x{i}").alias(f"c{k}") for k, i in enumerate(rest)), F.col(f"x{at}").cast("string").alias("html"))
    schema = StructType([*source.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts = [main_text(p) for p in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema).toDF(*(names[i] for i in rest), "text", "n_chars")
