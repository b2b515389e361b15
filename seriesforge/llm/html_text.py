"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks of text, each with its root-to-leaf path
of block tags. Text length and punctuation outside links are gathered per
distinct path; their ratios to the number of blocks on the path are smoothed
along the page, fused with what the path has itself, and paths are thresholded
by the spread of these scores. Blocks on the chosen paths are the article,
with what stands amid them in the same element (or in the same article
element) and is not links, the paragraphs, lists, tables and headings of that
element that follow or precede them without a break, and the headings right
before any of these.

Names in markup (nav, comments, adverts, forms and the like) never delete text
by themselves: a faint hint lowers the score of a path, a clear one lets the
elements of that name go if enough of the content is outside of them. So a
form or a "with-sidebar" around the whole page stays.

Each page is handled alone inside its task, so nothing is shuffled and a host
with a third of all pages is no hot group.

Defined results: a null or empty page gives an empty text; a page without
markup is its own text; a page of links or headings alone gives them; unclosed
and stray tags are tolerated; null and repeated ids are returned as they are;
an empty table gives an empty result; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seriesforge.llm.common import map_rows, table, texts_of

def _tags(attrs: str) -> re.Pattern:
    """Comments, elements without markup inside, tags, and other markup; ``attrs`` says how far a tag goes."""
    return re.compile(
        r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
        rf"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title|select|object|annotation)\b{attrs}>.*?(?:</(?P=raw)\s*>|\Z)"
        rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{attrs})>"
        r"|<[!?/][^>]*+>",
        re.S | re.I,
    )


#: Tags end at the first ``>`` outside quotes; on pages where that runs to the end once, at the first ``>``.
TOKEN, PLAIN = _tags(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"), _tags(r"[^>]*+")
OPENS = re.compile(r"<!--|<!\[CDATA\[", re.I)


def tokens(page: str) -> Iterator[re.Match]:
    """Markup in order, in one pass: a search that finds no end is not repeated."""
    last, pattern, at = page.rfind(">"), TOKEN, 0
    while (at := page.find("<", at)) >= 0:
        if at > last:  # no tag can end; what opens a comment hides the rest
            if m := OPENS.search(page, at):
                yield TOKEN.match(page, m.start())
            return
        m = pattern.match(page, at)
        if m is None and pattern is TOKEN and page[at + 1 : at + 2].isalpha():
            pattern = PLAIN
            m = pattern.match(page, at)
        if m is None:
            at += 1
        else:
            yield m
            at = m.end()


ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that are named for what is not article text.
DROPPED = frozenset("head nav footer aside form button menu dialog select textarea fieldset script style".split())
#: What a start tag closes when it is still open.
CLOSES = {x: ("p",) for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: An implied end tag reaches no further than these.
SCOPE = frozenset("html body article section main div table ul ol dl nav aside footer header form td th".split())
#: Names that classes and ids give to what is not article text.
HINT = (
    "ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|"
    "alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|sidebar|side-bar|rail|menu|nav|navbar|navigation|topbar|"
    "breadcrumb|breadcrumbs|footer|masthead|share|sharing|social|"
    "related|recommended|recommendations|trending|widget|widgets|toolbar|pagination|pager|login|search|searchbox|form|skip|skip-link|copyright|tags|toc"
)
REMARKS = "comment|comments|commentlist|responses|reply|replies|respond|disqus|discussion"
WHOLE = re.compile(rf"(?:{HINT}|{REMARKS}|header|site-header|page-header|.*[-_](?:{REMARKS}))\Z", re.I)
LAST = re.compile(rf".*[-_](?:{HINT})\Z", re.I)
FIRST = re.compile(rf"(?:{HINT}|{REMARKS})[-_].*\Z", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Weights of the smoothing window around a block.
WINDOW = [math.exp(-(d * d) / 2) for d in range(-2, 3)]
#: Weight of a path without punctuation.
UNMARKED = 0.2
#: A path is content from this many standard deviations of the fused scores on.
SPREADS = 0.5
#: How sure a name is: HIDDEN text is never shown; the others only lower a score or give way to better text.
FAINT, LIKELY, SURE, HIDDEN = 1, 2, 3, 4
#: Score of a path whose element's name faintly hints that it is no article text, as a share.
FAINT_SHARE = 0.5
#: Elements of one name go if at least this share of the content is outside them.
OUTSIDE = {LIKELY: 0.3, SURE: 0.03}
HEADING = re.compile(r"h[1-6]\Z")
#: What text is made of: blocks of these elements alone, right before or after the content in its element, go on with it.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tr td th caption figure figcaption".split())
#: A path whose score is less than this share of the best path's is no content.
LEAST_SHARE = 0.1


def _named(tag: str, attrs: str, inside_article: bool) -> int:
    """How surely the markup says that this is no article text."""
    found = SURE if tag in DROPPED or tag == "header" and not inside_article else 0
    if not attrs or tag in ("html", "body", "main"):
        return HIDDEN if tag == "head" else found
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HIDDEN
        if name == "role" and value.lower() in ROLES:
            found = SURE
        elif name in ("class", "id"):
            for x in value.split():
                found = max(found, SURE if WHOLE.match(x) else LIKELY if LAST.match(x) else FAINT if FIRST.match(x) else 0)
    return found


class Element:
    """A block element: its parent, its tag with a mark for what its names hint at, and the blocks that it holds."""

    __slots__ = ("base", "faint", "first", "heading", "last", "parent", "path", "sure", "tag", "title")

    def __init__(self, parent: Element | None, tag: str, how: int, path: int, first: int) -> None:
        self.parent, self.tag, self.path, self.first, self.last = parent, tag, path, first, -1
        self.sure = how >= SURE or parent is not None and parent.sure
        self.faint = (how == FAINT) + (parent.faint if parent else 0)
        self.base = parent.base if parent is not None and tag in FLOW else self  # the element that the running text stands in
        self.title = tag == "h1" and not how or parent is not None and parent.title
        self.heading = bool(HEADING.match(tag)) and not how or parent is not None and parent.heading


@dataclass
class Block:
    """Text between two borders of blocks."""

    element: Element
    text: str
    own: int  # characters outside links
    marks: int  # punctuation outside links

    @property
    def path(self) -> int:
        return self.element.path

    @property
    def linked(self) -> bool:
        return 2 * self.own < len(self.text)


def blocks_of(page: str) -> tuple[list[Block], list[tuple[int, str, Element]], list[Element]]:
    """The page's blocks, how surely which elements (with their start tags) are named as no article text, and its articles.

    An element holds blocks that follow each other, so it says which with two
    numbers; paths are numbered as they appear. Nothing is copied for a block.
    """
    out: list[Block] = []
    hints: list[tuple[int, str, Element]] = []
    in_articles: list[Element] = []
    paths: dict[tuple[int, str, int], int] = {}
    root = Element(None, "", 0, 0, 0)
    stack: list[tuple[str, int, Element]] = []  # tag, hint, the innermost block element
    run: list[tuple[str, bool]] = []
    open_: Counter[str] = Counter()  # tags on the stack
    scopes: list[tuple[int, Counter[str]]] = [(-1, Counter())]  # where a scope begins on the stack, and the tags open in it
    at, hidden, articles, links = 0, 0, 0, 0

    def text(raw: str) -> None:
        if raw and not hidden:
            run.append((html.unescape(raw) if "&" in raw else raw, links > 0))

    def border() -> None:
        if run:
            joined = " ".join("".join(x for x, _ in run).split())
            if joined:
                own = joined if not any(is_link for _, is_link in run) else " ".join("".join(x for x, is_link in run if not is_link).split())
                out.append(Block(stack[-1][2] if stack else root, joined, len(own), len(PUNCTUATION.findall(own))))
            run.clear()

    def closed(i: int) -> None:
        nonlocal hidden, articles, links
        for tag, how, element in reversed(stack[i:]):
            if tag in SCOPE:
                scopes.pop()
            else:
                scopes[-1][1][tag] -= 1
            hidden -= how == HIDDEN
            articles -= tag in ("article", "main")
            links -= tag == "a"
            open_[tag] -= 1
            if tag not in INLINE:
                element.last = len(out) - 1
        del stack[i:]

    def implied(closes: tuple[str, ...]) -> None:
        """Closes what a start tag ends; only elements that go are looked at."""
        while True:
            begins, counts = scopes[-1]
            if n := sum(counts[x] for x in closes):
                i = len(stack)
                while n:
                    i -= 1
                    n -= stack[i][0] in closes
                closed(i)
            if begins < 0 or stack[begins][0] not in closes:
                return
            closed(begins)

    for m in tokens(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            border()
        if tag in VOID:
            continue
        if m["end"]:
            if scopes[-1][1][tag] if tag == "p" else open_[tag]:
                closed(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in CLOSES:
            implied(CLOSES[tag])
        if m["attrs"].endswith("/") and tag not in INLINE:
            continue
        how = _named(tag, m["attrs"], articles > 0)
        around = stack[-1][2] if stack else root
        if tag not in INLINE:
            around = Element(around, tag, how, paths.setdefault((around.path, tag, how), len(paths) + 1), len(out))
            if how in (LIKELY, SURE):
                hints.append((how, m[0], around))
            if tag == "article":
                in_articles.append(around)
        stack.append((tag, how, around))
        open_[tag] += 1
        if tag in SCOPE:
            scopes.append((len(stack) - 1, Counter()))
        else:
            scopes[-1][1][tag] += 1
        hidden += how == HIDDEN
        articles += tag in ("article", "main")
        links += tag == "a"
    text(page[at:])
    border()
    closed(0)
    root.last = len(out) - 1
    return out, hints, in_articles


def smoothed(x: list[float]) -> list[float]:
    n = len(x)
    out = []
    for i in range(n):
        a, b = max(0, i - 2), min(n, i + 3)
        w = WINDOW[a - i + 2 : b - i + 2]
        out.append(sum(p * q for p, q in zip(w, x[a:b], strict=True)) / sum(w))
    return out


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """The ratios of each path, before smoothing: text and punctuation outside links for each block on it, the spread of their lengths, and all its text."""
    sums: dict[int, list[int]] = {}
    for x in blocks:
        s = sums.setdefault(x.path, [0, 0, 0, 0, x.element.faint])
        s[0] += 1
        s[1] += x.own
        s[2] += x.marks
        s[3] += x.own * x.own
    out = {}
    for p, (k, n, marks, squares, faint) in sums.items():
        spread = math.sqrt(max(0.0, squares / k - (n / k) ** 2))
        out[p] = FAINT_SHARE**faint * math.sqrt(n / k) * math.log1p(UNMARKED + marks / k) * math.log1p(1 + spread) * math.log1p(n)
    return out


def content_paths(blocks: list[Block]) -> set[int]:
    """Paths whose scores, fused with the smoothed scores around their blocks, reach the threshold."""
    score = path_scores(blocks)
    own = [score[x.path] for x in blocks]
    fused = [math.sqrt(a * b) for a, b in zip(own, smoothed(own), strict=True)]
    if not any(fused):
        return set()
    mean = sum(fused) / len(fused)
    by_path: dict[int, list[float]] = {}
    for x, f in zip(blocks, fused, strict=True):
        by_path.setdefault(x.path, []).append(f)
    means = {p: sum(f) / len(f) for p, f in by_path.items()}
    cut = max(SPREADS * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)), LEAST_SHARE * max(means.values()))
    return {p for p, f in means.items() if 0 < f and f >= cut}


def without_named(blocks: list[Block], hints: list[tuple[int, str, Element]]) -> np.ndarray:
    """Which blocks stand outside elements whose names rule them out, where enough content is left outside."""
    chosen = content_paths(blocks)
    alive = np.ones(len(blocks), bool)
    weight = np.array([len(x.text) if x.path in chosen else 0 for x in blocks], np.int64)
    total, left = int(weight.sum()), int(weight.sum())
    groups: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for how, label, element in hints:
        own = groups.setdefault((how, label), [])
        if element.first <= element.last and not (own and element.last < own[-1][1]):  # elements come in order; one inside another of its name adds nothing
            own.append((element.first, element.last + 1))
    sums = np.concatenate([[0], np.cumsum(weight)])
    inside = {g: int(sum(sums[b] - sums[a] for a, b in own)) for g, own in groups.items()}
    for how, label in sorted(groups, key=lambda g: (inside[g], g)):
        own = groups[how, label]
        gone = int(sum(weight[a:b].sum() for a, b in own))
        if left - gone >= OUTSIDE[how] * total and (left - gone or not total):
            left -= gone
            for a, b in own:
                weight[a:b] = 0
                alive[a:b] = False
    return alive


def main_text(page: str) -> str:
    whole, hints, articles = blocks_of(page)
    alive = without_named(whole, hints) if hints else np.ones(len(whole), bool)
    if not alive.any():
        alive = np.array([not x.element.sure for x in whole], bool)
    places = np.flatnonzero(alive).tolist()
    blocks = [whole[i] for i in places]
    chosen = content_paths(blocks)
    keep = [x.path in chosen for x in blocks]
    if not any(keep):  # nothing but links or headings
        return " ".join(x.text for x in blocks)
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    titles = [k for k in range(first) if blocks[k].element.title]
    first = titles[-1] if titles else first
    # What stands amid the content, in the element that holds it or in its articles, belongs to it unless it is links.
    holder = blocks[first].element
    while not (holder.first <= places[first] and places[last] <= holder.last) and holder.parent:
        holder = holder.parent
    held = np.concatenate([[0], np.cumsum(np.bincount([i for i, k in zip(places, keep, strict=True) if k], minlength=len(whole)))])
    in_article = np.zeros(len(whole) + 1, np.int64)
    for x in articles:
        if x.first <= x.last and held[x.last + 1] > held[x.first]:
            in_article[x.first] += 1
            in_article[x.last + 1] -= 1
    in_article = np.cumsum(in_article)
    for k, x in enumerate(blocks):
        amid = first <= k <= last and holder.first <= places[k] <= holder.last or in_article[places[k]]
        keep[k] = keep[k] or k in titles[-1:] or bool(amid) and not x.linked

    # Text of the holder itself goes on as long as it stands in paragraphs, lists, tables or headings.
    for order in (range(last + 1, len(blocks)), range(first - 1, -1, -1)):
        for k in order:
            if not keep[k] and not (holder.first <= places[k] <= holder.last and blocks[k].element.base is holder.base and not blocks[k].linked):
                break
            keep[k] = True
    after = False
    for k in range(len(keep) - 1, -1, -1):
        keep[k] = keep[k] or after and blocks[k].element.heading
        after = keep[k]
    return " ".join(x.text for x, k in zip(blocks, keep, strict=True) if k)


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    out = [main_text(x.decode("utf-8", "replace")) for x in texts_of(b["html"])]
    return pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return map_rows(pages.select("page_id", "url", "html"), "html", _batch, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
