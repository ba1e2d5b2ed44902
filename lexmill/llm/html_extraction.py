"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, each with its open elements. A
classifier gives every block a log-odds of being content, from its elements (article or navigation,
class names, forms), links, length and punctuation. That is the capacity of its edge to the source (content) or
to the sink (boilerplate). Blocks that follow each other, and blocks that are neighbours in the DOM tree, are
tied by smoothness edges, the weaker the farther apart. The minimum cut between source and sink
labels all blocks of a page at once: a short line between paragraphs goes with them, a sentence among links does not.

Blocks inside elements that can't hold article text (nav, aside, footer and the like) or that are hidden have a capacity that no cut of smoothness edges outweighs; so have those in a form, unless it holds half of the page's
text or more, as where a server puts a form around each page, or they are in an article within the form. Buttons and labels are inline: in a sentence they are a part of it, text that is theirs alone is no block. Class names and ids (adverts, comments, sidebars) only lower the log-odds, much if that is all they say,
or all but words for a part's kind or place (`reader-comments`, `ad-slot`) on an element that doesn't hold nine tenths of the text; scripts, styles and comments of markup are not blocks. Inline elements that are hidden or named as adverts lose their text. A page of which
the cut would keep nothing is cut once more with all its log-odds raised, so that a page of a few words is not empty.

The cut is exact. Blocks whose terminal outweighs all their edges are labelled first and folded into
their neighbours, which settles most pages; augmenting paths settle the rest.

Defined results. Null or empty html has an empty text. Damaged markup is read as far as it goes:
unclosed elements end with their parent, an unclosed head with the first tag or text that can't be in it, stray end tags are ignored, an unclosed tag ends the page. Text is
whole: character references are decoded, white space within a block becomes one space, blocks are joined by
one line feed. Rows are independent; repeated rows repeat; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*"|'[^']*')*+)[^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements whose text is not shown, read up to their end tag.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes", "object", "svg", "math", "canvas", "audio", "video"}
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag in the first set ends an open p; items end the item before them.
ENDS_P = BLOCK - {"br", "option", "body", "html", "head", "td", "th", "tr", "caption"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSED_IN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Elements that an item's start tag looks for: the nearest of a set is ended, or is where the search ends.
SETS = tuple(frozenset(SAME[x] | CLOSED_IN[x]) for x in ("li", "dt", "option", "tr"))
SET_OF = {"li": 0, "dt": 1, "dd": 1, "option": 2, "tr": 3, "td": 3, "th": 3}
IN_SETS = frozenset().union(*SETS)
#: An open p beyond one of these is not ended.
P_SCOPE = {"button", "td", "th", "article", "body"}
#: What a head may hold; all else ends it.
IN_HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Elements and roles that never hold article text, and words of class names or ids that speak against it.
NOT_TEXT = {"nav", "aside", "select", "menu", "dialog", "search", "head", "datalist", "footer"}
CONTROLS = {"button", "label"}
#: A form with this share of a page's text is around the page; so is a part with that one, whatever its name.
PAGE_FORM, PAGE_PART = 0.5, 0.9
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar", "form", "alert", "tablist"}
WORDS = set(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright cta disclaimer disqus "
    "dropdown footer footnav gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination "
    "paywall popup promo promoted promotion recommend recommended recommendations related replies reply respond search share sharing sidebar signup sitemap skip social sponsor sponsored "
    "subscribe subscription taboola tagcloud toolbar trending widget".split()
)
#: Of these, what takes an inline element's text out of the block it is in, as being hidden does.
ADVERTS = {"ad", "ads", "advert", "advertisement", "advertising", "adsense", "outbrain", "promo", "promoted", "promotion", "sponsor", "sponsored", "taboola"}
#: A name with one of these tells of the layout around a part (has-sidebar, comments-open), not of the part.
LAYOUT = {"has", "no", "with", "without", "open", "closed", "enabled", "disabled"}
#: Beside the words above: whose part it is, of what kind, and where; with these a name still says no more than that.
FILLERS = set(
    "area areas articles bar block body bottom box btn button buttons card cards col column container count entries feed fixed float form global group head header holder icon icons inline inner "
    "item items js label large latest left link links list lists mobile module more news outer panel posts primary reader readers rail right row secondary section site slot small sticky stories tab tabs text "
    "thread title top unit user users view wrap wrapper zone".split()
)
GOOD = {"article", "content", "entry", "main", "post", "story", "articlebody", "body", "text"}

#: The classifier: log-odds of content. Ties between neighbours of distance d in the tree weigh TIE / (1 + d).
BIAS, IN_ARTICLE, PARAGRAPH, HEADING, LENGTH, STOPS, LINKS, GOOD_NAME, OUTSIDE, NEVER = -2.0, 4.0, 1.2, 0.4, 0.5, 0.8, 4.0, 1.0, 3.0, 1e6
#: Against names of words in WORDS alone, and names that have other words as well.
BAD_NAME, PART_NAME = 9.0, 2.0
FOLLOW, TIE = 2.4, 3.6
#: What all blocks of a page gain where nothing would be kept: a page of a few words is these words.
SPARSE = 3.0


class _Element:
    """An open element; what its ancestors are is handed down, so no tag looks up the tree."""

    __slots__ = ("good", "article", "links", "name", "named", "never", "unseen", "number", "parent", "depth", "block", "head", "p", "near", "control", "form", "part", "began", "held")

    def __init__(self, name: str, attributes: str, parent: _Element | None, number: int):
        self.name, self.parent, self.number = name, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.article = bool(parent and parent.article) or name in ("article", "main")
        self.good = bool(parent and parent.good)
        self.named = parent.named if parent else 0.0
        self.never = bool(parent and parent.never) or name in NOT_TEXT or (name == "header" and not self.article)
        self.unseen = bool(parent and parent.unseen and name not in BLOCK)
        # the nearest block-level element, the head it is in, the p that a block would end, and the nearest of each of SETS
        self.block = self if not parent or name in BLOCK else parent.block
        self.head = self if name == "head" else parent.head if parent else None
        self.p = self if name == "p" else None if name in P_SCOPE else parent.p if parent else None
        self.near = parent.near if parent else (None,) * len(SETS)
        if name in IN_SETS:
            self.near = tuple(self if name in names else old for names, old in zip(SETS, self.near, strict=True))
        self.links = bool(parent and parent.links) or name == "a"
        # a button or label around it, the form it is in, the nearest element named after a part of a kind; characters of text before it and in it
        self.control = bool(parent and parent.control) or name in CONTROLS
        self.form = self if name == "form" else parent.form if parent else None
        self.part = parent.part if parent else None
        self.began = self.held = 0
        if attributes and not self.never and name not in ("html", "body"):
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id"):
                    for one in value.split():
                        words = {w.lower() for w in _NAME.findall(one)}
                        self.unseen |= name not in BLOCK and bool(words) and words <= ADVERTS
                        if words & WORDS and not words & LAYOUT:
                            self.named = max(self.named, BAD_NAME if words <= WORDS else PART_NAME)
                            if not words <= WORDS and words <= WORDS | FILLERS and name in BLOCK:
                                self.part = self
                        self.good |= bool(words & GOOD)
                elif key == "role":
                    self.never |= value.lower() in ROLES
                    self.article |= value.lower() in ("main", "article")
                elif key == "itemprop":
                    self.article |= value.lower() == "articlebody"
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                    self.never = True
                    self.unseen |= name not in BLOCK
        if self.article and not (parent and parent.article):
            self.form = None


def blocks(html: str) -> list[tuple[str, _Element, float, str]]:
    """(text, element, share of its characters in links, nearest block-level name) of every block that has text."""
    out: list[tuple[str, _Element, float, str]] = []
    top = here = _Element("", "", None, 0)
    parts: list[str] = []
    linked, free, place, number, seen = 0, False, here, 0, 0
    in_block = ""
    opened: defaultdict[str, list[_Element]] = defaultdict(list)

    def end_block() -> None:
        nonlocal linked, free, seen
        if parts:
            text = " ".join("".join(parts).split())
            if text and free:
                out.append((text, place, min(1.0, linked / len(text)), in_block))
                seen += 0 if place.never else len(text)
            parts.clear()
            linked, free = 0, False

    def leave(e: _Element) -> None:
        """Close e and all that is open in it."""
        nonlocal here
        while here is not e:
            opened[here.name].pop()
            here.held = seen - here.began
            here = here.parent
        opened[e.name].pop()
        e.held = seen - e.began
        here = e.parent

    def end_head() -> None:
        if here.head is not None:
            end_block()
            leave(here.head)

    def add(text: str) -> None:
        nonlocal linked, free, place, in_block
        if here.name == "head" and not text.isspace():
            end_head()
        if here.unseen:
            return
        if "&" in text:
            text = unescape(text)
        if not parts:
            if text.isspace():
                return
            place = here.block
            in_block = place.name
        parts.append(text)
        free = free or not (here.control or text.isspace())
        if here.links:
            linked += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK and (opened[name] or name in ("p", "br")):
                end_block()
            if opened[name]:
                e = opened[name][-1]
                # an inline end tag does not close the blocks in it
                if name in BLOCK or here.block.depth <= e.depth:
                    leave(e)
            continue
        if name not in IN_HEAD:
            end_head()
        if name in RAW:
            if name in ("svg", "math") and m[0].endswith("/>"):
                continue
            close = html.find("</", at)
            low = name
            while close >= 0 and html[close + 2 : close + 2 + len(low)].lower() != low:
                close = html.find("</", close + 2)
            at = n if close < 0 else (html.find(">", close) + 1 or n)
            continue
        if name in BLOCK:
            end_block()
            if name in ENDS_P and here.p is not None:
                leave(here.p)
            if name in SAME:
                e = here.near[SET_OF[name]]
                if e is not None and e.name in SAME[name]:
                    leave(e)
        if name not in VOID:
            if not m[0].endswith("/>") or name in BLOCK:
                number += 1
                here = _Element(name, m[3], here, number)
                here.began = seen
                opened[name].append(here)
    end_block()
    while here is not None:  # what the page leaves open; the top holds all
        here.held = seen - here.began
        here = here.parent
    return out


def _apart(element: _Element | None, held: int, share: float) -> bool:
    """Whether there is such an element and it holds less than this share of the page's characters."""
    return element is not None and element.held < share * held


def log_odds(text: str, element: _Element, links: float, kind: str, page_has_article: bool, held: int = 0) -> float:
    """held: the characters of all the page's blocks that aren't ruled out by their element."""
    if element.never or _apart(element.form, held, PAGE_FORM):
        return -NEVER
    words = text.count(" ") + 1
    score = BIAS + LENGTH * math.log(words) - LINKS * links - (BAD_NAME if _apart(element.part, held, PAGE_PART) else element.named)
    if element.article:
        score += IN_ARTICLE
    elif page_has_article:
        score -= OUTSIDE
    if element.good:
        score += GOOD_NAME
    if kind in ("p", "blockquote", "pre"):
        score += PARAGRAPH
    elif kind in ("h1", "h2", "h3", "h4"):
        score += HEADING
    if text[-1] in ".!?…。:;\"'”’)":
        score += STOPS
    return score


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(found: list[tuple[str, _Element, float, str]]) -> dict[tuple[int, int], float]:
    """Edges (i, j), i < j: each block to the next, and to the next with the same parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (_, e, _, _) in enumerate(found):
        if i:
            edges[i - 1, i] = FOLLOW / (1 + _distance(found[i - 1][1], e))
        parent = e.parent.number if e.parent else -1
        if parent in last:
            pair = (last[parent], i)
            edges[pair] = edges.get(pair, 0.0) + TIE / (1 + _distance(found[last[parent]][1], e))
        last[parent] = i
    return edges


def min_cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the source's side of the least cut (of the least such side).

    A node with score s > 0 has an edge of capacity s from the source, with s < 0 one of -s to the sink.
    """
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    need = list(score)
    todo = deque(range(n))
    while todo:  # a node that outweighs its edges has its side; its edges become its neighbours' capacity
        i = todo.popleft()
        if label[i] is not None:
            continue
        ties = sum(near[i].values())
        if need[i] > ties:
            label[i] = True
        elif -need[i] >= ties:
            label[i] = False
        else:
            continue
        for j, w in near[i].items():
            need[j] += w if label[i] else -w
            del near[j][i]
            if label[j] is None:
                todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, need, near)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], score: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches when no augmenting path (shortest first) is left."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    left[source], left[sink] = {}, {}
    for i in nodes:
        if score[i] > 0:
            left[source][i] = score[i]
            left[i][source] = 0.0
        elif score[i] < 0:
            left[i][sink] = -score[i]
            left[sink][i] = 0.0
    while True:
        came: dict[int, int] = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, w in left[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return set(came) - {source}
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(left[i][j] for i, j in path)
        for i, j in path:
            left[i][j] -= flow
            left[j][i] = left[j].get(i, 0.0) + flow


def main_text(html: str | None) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    held = sum(len(text) for text, e, _, _ in found if not e.never)
    article = any(e.article and not e.never and e.named < BAD_NAME and not _apart(e.part, held, PAGE_PART) for _, e, _, _ in found)
    score = [log_odds(*b, article, held) for b in found]
    edges = smoothness(found)
    keep = min_cut(score, edges)
    if not any(keep):
        keep = min_cut([s + SPARSE for s in score], edges)
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(_extract, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
