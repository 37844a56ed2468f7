"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block elements (tag and classes). Over the page, each
path has a text ratio, its characters a block, and a punctuation ratio, its marks a block. Both series are smoothed along
the blocks in page order and fused by their product. The fused ratio is weighted by what else a page says about a
block: the share of its text outside links, and a small factor if an element around it is of a kind (aside, form, an outer
header) or has a class, id or role that names other than the article, such as an advert or a menu, or if an article, or a main
element with as much weight, stands elsewhere. A name counts as a whole, on elements that group others, not by one word of a longer
name. Only where nothing else of the page could be the article, as no prose stands outside such names, do names of what holds nearly
all of the page say nothing: a thread of comments may be far longer than its article. Paths whose weighted ratio reaches a share of the page's mean
are content; the weights decide only between ratios, so a page all of whose text is so named is extracted like any other.

The deepest element that holds nearly all of the weight of content paths is the article. All blocks of content paths in it or in
what holds it are returned, and those beside it whose path reaches the mean. What lies in it without being weighted down is content too, so short blocks stay; if no article or main element marks it, so are the headings,
paragraphs, list items, quotations and preformatted texts of the rest of the page. Hidden elements, nav, footer and menu elements,
scripts, styles and controls have no text.

Character references are decoded, white space in a block becomes one space, and blocks are joined by a line break. Nothing
else is dropped or capped. Paths are numbered and sums go once up the tree, so time and memory follow the length of the page,
however deep it is nested.

Defined cases: null and empty html give the empty text; a page that is cut off inside a tag, a comment or a script ends
there; stray quotes in a tag belong to it, up to its end; unclosed and misnested tags close as their parents do; repeated rows each
give a row; an empty table gives an empty result; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Comments, tags (an attribute's value ends at its own quote, or unquoted at a space), and declarations. What the page cuts off ends with it.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>="']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
RAW = frozenset("script style textarea title noscript template iframe object svg annotation annotation-xml noembed xmp".split())
NO_TEXT = frozenset("head nav footer menu button select option dialog map audio video canvas".split())
APART = frozenset("aside form fieldset".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LISTED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table body html article section div".split())
# fixed values: words of classes, ids and roles that name other than the article
NAMES = frozenset(
    "ad ads adbox advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies disqus "
    "dialog footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
# fixed values: words that say nothing beside a name, and the elements that are told by names
NEUTRAL = frozenset("area articles bar block bottom box buttons container form global icons inner items left links list outer panel posts right section site top wrap wrapper".split())
CONTAINERS = frozenset("center dd details div dl figure header li ol section summary table tbody td tfoot thead tr ul".split())
# fixed values: elements of running text
TEXTUAL = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre".split())
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？]")
WORD = re.compile(r"[a-z]+")
#: A path is content if its weighted ratio reaches this share of the mean; an element is the article if it holds this share of the weight.
THRESHOLD, HOLDS = 0.3, 0.9
#: So many characters in blocks with punctuation could be an article.
PROSE = 60
#: Factors of the ratio for a block in an element that is named apart, and outside the article or main element of the page.
NAMED, OUTSIDE = 0.0001, 0.01


#: Width of the smoothing in blocks: a neighbour weighs an eighth.
SIGMA = 0.5


class Element:
    """number: place in the page. path: number of its path. apart: its kind or name says that it is not the article. off: has no text. said: it is called an article."""

    __slots__ = ("tag", "path", "parent", "off", "depth", "in_article", "apart", "number", "said")

    def __init__(self, tag: str, name: str, parent: Element | None, apart: bool, off: bool, paths: dict, number: int):
        self.tag, self.parent, self.apart, self.number = tag, parent, apart, number
        self.path = paths.setdefault((parent.path if parent else -1, name), len(paths))
        self.off = off or bool(parent and parent.off)
        self.depth = parent.depth + 1 if parent else 0
        self.said = tag == "article"
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)


def _named(tag: str, attributes: str, parent: Element) -> tuple[str, bool, bool]:
    """The element's name in paths, whether its kind, role, class or id say that it is not the article, and whether it has no text."""
    apart, off = tag in APART or (tag == "header" and not parent.in_article), tag in NO_TEXT
    if not attributes.strip(" /\n\t\r"):
        return tag, apart, off
    found: dict[str, str] = {}
    for k, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), "".join(values))
    off = off or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    apart = apart or (tag in CONTAINERS and any(_other(w, parent.in_article) for k in ("class", "id", "role") for w in html.unescape(found.get(k, "")).split()))
    return ".".join([tag, *sorted(found.get("class", "").split())]), apart, off


@functools.lru_cache(maxsize=10_000)
def _other(token: str, in_article: bool) -> bool:
    """Whether all words of a class, id or role name other than the article; an article may have a header."""
    words = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
    return bool(words & NAMES) and words <= NAMES | NEUTRAL and not (in_article and "header" in words)


def blocks_of(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """All elements, parents first, and (element, text, characters inside links) of each block in page order."""
    at, out, text, links, in_link = 0, [], [], 0, 0
    paths: dict = {}
    top = Element("", "", None, False, False, paths, 0)
    elements, is_open = [top], Counter()

    def flush():
        nonlocal text, links
        joined = " ".join(html.unescape("".join(text)).split()) if text else ""
        if joined:
            out.append((top, joined, links))
        text, links = [], 0

    def close(e: Element):
        """Leave e and all that is open in it."""
        nonlocal top
        while top is not e:
            is_open[top.tag] -= 1
            top = top.parent
        is_open[e.tag] -= 1
        top = e.parent

    for m in TOKEN.finditer(page):
        if m.start() < at:  # inside a raw element
            continue
        if m.start() > at:
            part = page[at : m.start()]
            text.append(part)
            links += len(part) if in_link else 0
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE:
                continue
            flush()
            if is_open[tag]:  # else there is nothing to look for
                e = top
                while e.tag != tag:
                    e = e.parent
                close(e)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag in INLINE or tag in VOID:
            if tag == "br" or tag not in INLINE:
                text.append(" ")
            if tag not in INLINE:
                flush()
            in_link += tag == "a"
            continue
        flush()
        in_link = 0
        closes = {"p"} if tag in ENDS_P else LISTED.get(tag, ())
        e = top
        while any(is_open[c] for c in closes) and e.parent and e.tag not in SCOPES:
            above = e.parent
            if e.tag in closes:
                close(e)
                if tag != "tr":
                    break
            e = above
        name, apart, off = _named(tag, m[3], top)
        top = Element(tag, name, top, apart, off, paths, len(elements))
        elements.append(top)
        is_open[tag] += 1
    if at < len(page):
        text.append(page[at:])
    flush()
    return elements, out


def smooth(x: np.ndarray) -> np.ndarray:
    """Each value with its two neighbours on either side, by narrow Gaussian weights; ends weigh what there is."""
    kernel = np.exp(-np.arange(-2, 3) ** 2 / (2 * SIGMA**2))
    return np.convolve(x, kernel)[2:-2] / np.convolve(np.ones(len(x)), kernel)[2:-2]


def path_ratios(blocks: list[tuple[Element, str, int]]) -> np.ndarray:
    """The fused ratio at each block: the product of the smoothed text and punctuation ratios of the paths."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, text, _ in blocks:
        chars[e.path] += len(text)
        marks[e.path] += len(PUNCTUATION.findall(text))
        count[e.path] += 1
    paths = [e.path for e, _, _ in blocks]
    text_ratio = smooth(np.array([chars[p] / count[p] for p in paths]))
    mark_ratio = smooth(np.array([(marks[p] + 0.5) / count[p] for p in paths]))
    return text_ratio * mark_ratio


def _held(elements: list[Element], blocks: list[tuple[Element, str, int]], weight: np.ndarray) -> np.ndarray:
    """The weight that each element holds."""
    held = np.zeros(len(elements))
    for (e, _, _), w in zip(blocks, weight, strict=True):
        held[e.number] += w
    for e in reversed(elements):
        if e.parent:
            held[e.parent.number] += held[e.number]
    return held


def _factors(elements: list[Element], void: np.ndarray) -> np.ndarray:
    """The product of the factors of names around and on each element; void ones count as none."""
    factor = np.ones(len(elements))
    for e in elements[1:]:
        factor[e.number] = factor[e.parent.number] * (NAMED if e.apart and not void[e.number] else 1)
    return factor


def _prose(blocks: list[tuple[Element, str, int]], factor: np.ndarray) -> bool:
    """Whether blocks outside all names could be an article: they are in one, or have enough text outside links, with punctuation."""
    return any(e.in_article for e, _, _ in blocks if factor[e.number] == 1) or sum(len(text) - links for e, text, links in blocks if factor[e.number] == 1 and PUNCTUATION.search(text)) >= PROSE


def main_text(page: str | None) -> str:
    elements, blocks = blocks_of(page or "")
    blocks = [b for b in blocks if not b[0].off]
    if not blocks:
        return ""
    ratio, length = path_ratios(blocks), np.array([len(b[1]) for b in blocks])
    ratio *= np.array([1 - min(1.0, links / len(text)) * (not _running(e)) for e, text, links in blocks])
    factor = _factors(elements, np.zeros(len(elements), bool))
    if not _prose(blocks, factor):  # names of what holds the page are void
        held, total = _held(elements, blocks, ratio * length), float((ratio * length).sum())
        factor = _factors(elements, held >= HOLDS * total)
    plain = np.array([factor[e.number] == 1 for e, _, _ in blocks])
    in_article = np.array([e.in_article for e, _, _ in blocks])
    # a main element that holds less than what stands beside it marks a part, not the article
    said = any(e.said for e in elements)
    article_text = bool((plain & in_article).any()) and (said or (ratio * length)[plain & in_article].sum() >= (ratio * length)[plain & ~in_article].sum())
    weighted = ratio * np.array([factor[e.number] * (1 if e.in_article or not article_text else OUTSIDE) for e, _, _ in blocks])
    best: dict[int, float] = {}
    for (e, _, _), w in zip(blocks, weighted, strict=True):
        best[e.path] = max(best.get(e.path, 0.0), w)
    content = [best[b[0].path] >= THRESHOLD * weighted.mean() for b in blocks]
    if not any(content):
        content = [True] * len(blocks)
    held = _held(elements, blocks, weighted * length * content)
    article = max((e for e in elements if held[e.number] >= HOLDS * held[0]), key=lambda e: (e.depth, held[e.number]))
    if article.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "b") and article.parent:
        article = article.parent  # one paragraph is not an article yet
    named = article
    while named.parent and named.tag not in ("article", "main"):
        named = named.parent
    marked = named.parent is not None and article_text
    if marked:
        article = named
    inside = np.zeros(len(elements), bool)
    for e in elements:
        inside[e.number] = e is article or bool(e.parent and inside[e.parent.number])
    around, e = inside.copy(), article  # the article and what holds it
    while e:
        around[e.number], e = True, e.parent
    level = factor[article.number]

    def stays(b: tuple[Element, str, int]) -> bool:
        e = b[0]
        return factor[e.number] >= level and (inside[e.number] or (not marked and e.tag in TEXTUAL and not _mostly_links(b)))

    far = [best[b[0].path] >= weighted.mean() for b in blocks]  # beside the article a block needs more
    return "\n".join(b[1] for b, on, high in zip(blocks, content, far, strict=True) if (on and (high or around[b[0].number])) or stays(b))


def _running(e: Element) -> bool:
    """Running text may consist of a link."""
    return e.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6")


def _mostly_links(block: tuple[Element, str, int]) -> bool:
    """A menu without a name, on a page that does not mark its article."""
    e, text, links = block
    return links > 0.6 * len(text) and not _running(e)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
