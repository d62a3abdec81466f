"""Main text of web pages by tag-path ratios.

Every text node belongs to a root-to-leaf tag path. Per path, characters and punctuation marks are counted per node; both ratios
are smoothed along the page, fused by their product and compared with the spread of all paths of the page. The nodes of the paths above it are the
content; the smallest container that holds nearly all of it is the article. Its blocks and the content outside it are put out without what the markup
itself names as surroundings (menus, adverts, forms, comments and so on). A class or id, or a form, only marks a candidate: it stays when it
holds an article or the better part of the content.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from joulemill.llm.registry import query, table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q s samp small span strike strong sub sup time tt u var wbr".split())
FORMULA = set("maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
INLINE |= FORMULA
NONE: frozenset[str] = frozenset()
SILENT = set("annotation annotation-xml audio button canvas datalist dialog head iframe input noscript object option script select style svg template textarea title video".split())
AROUND = set("aside footer header menu nav search".split())
ROLES = set("banner navigation complementary contentinfo search alert dialog menu menubar".split())
#: Words of a class or id that may name surroundings.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus feedback "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget".split()
)
TITLE = set("banner header masthead".split())  # with a first heading, these are the article's own
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
MAIN = set("article main".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CONTAINERS = set("html body div section article main table tbody tr td center form".split())
MARKS = re.compile(r"[.,;:!?…。，；：！？、।؟]")
SHARE = 0.9  # of the content's characters that the article's container holds
MOST = 0.5  # of the content's characters; what holds so many is not surroundings, whatever it is called
SMOOTH = np.array([1.0, 2.0, 4.0, 2.0, 1.0])


class Page(HTMLParser):
    """Elements and text nodes in page order. An element is (parent, tag, path, outside, marks); elements open in ``stack``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[int, str, int, bool, frozenset]] = [(-1, "", 0, False, frozenset())]
        self.stack = [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[list] = []  # [element, block number, text]
        self.block = 0
        self.open: Counter[str] = Counter()  # tags in the stack

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are of no use here

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.end({"p"}, {"table", "button", "object"})
        if tag in SIBLINGS:
            self.end(SIBLINGS[tag], SCOPES[tag])
        up = self.stack[-1]
        parent = self.elements[up]
        outside = parent[3] or tag in SILENT or (tag in AROUND and not (tag == "header" and self.within(MAIN))) or bool(attrs and self.stated_outside(dict(attrs)))
        key = (parent[2], tag if tag not in INLINE else "")  # inline markup does not part a path
        path = parent[2] if tag in INLINE else self.paths.setdefault(key, len(self.paths) + 1)
        self.elements.append((up, tag, path, outside, self.marks(tag, dict(attrs)) if attrs or tag == "form" else NONE))
        self.stack.append(len(self.elements) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        self.end({tag}, set() if tag not in INLINE else CLOSES_P | {"td", "th", "li"})

    def handle_data(self, data: str) -> None:
        self.texts.append([self.stack[-1], self.block, data])

    @staticmethod
    def stated_outside(named: dict[str, str | None]) -> bool:
        """Whether role or state say that the element is not part of the article."""
        return (named.get("role") or "").lower() in ROLES or "hidden" in named

    @staticmethod
    def marks(tag: str, named: dict[str, str | None]) -> frozenset[str]:
        """Words that make the element a candidate for surroundings."""
        words = f"{named.get('class') or ''} {named.get('id') or ''}"
        found = NAMES.intersection(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower())) if words != " " and tag not in ("html", "body") else NONE
        return frozenset(found | {"form"} if tag == "form" or (named.get("role") or "").lower() == "form" else found)

    def kind(self, element: int) -> str:
        """Tag of the element, or of what holds it when it is inline."""
        while self.elements[element][1] in INLINE:
            element = self.elements[element][0]
        return self.elements[element][1]

    def within(self, tags: set[str]) -> bool:
        return any(self.open[t] for t in tags)

    def end(self, tags: set[str], scope: set[str]) -> None:
        """Ends the innermost open element of ``tags`` and all within it, unless one of ``scope`` lies between."""
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.elements[self.stack[at]][1]
            if tag in tags:
                self.open.subtract(self.elements[e][1] for e in self.stack[at:])
                del self.stack[at:]
                return
            if tag in scope:
                return


def smoothed(x: np.ndarray) -> np.ndarray:
    half = len(SMOOTH) // 2
    weight = np.convolve(np.ones(len(x)), SMOOTH)[half : half + len(x)]
    return np.convolve(x, SMOOTH)[half : half + len(x)] / weight


def main_text(html: str | None) -> str:
    """The article of a page; empty where there is none."""
    page = Page()
    page.feed(html or "")
    HTMLParser.close(page)  # what is left in its buffer
    blocks: list[list] = []  # [element of the first text, path, pieces]
    last = -1
    for element, block, text in page.texts:
        if page.elements[element][3]:
            continue
        if block != last:
            blocks.append([element, page.elements[element][2], []])
            last = block
        blocks[-1][2].append(text)
    blocks = [(e, p, t) for e, p, pieces in blocks if (t := " ".join("".join(pieces).split()))]
    if any(e[4] for e in page.elements):
        out = surroundings(page, blocks, chosen(blocks))
        blocks = [b for b in blocks if not out[b[0]]]
    return " ".join(t for _, _, t in inside(page, blocks, chosen(blocks)))


def chosen(blocks: list[tuple]) -> np.ndarray:
    """Whether each block's path is above the threshold."""
    if not blocks:
        return np.zeros(0, dtype=bool)
    _, path = np.unique([p for _, p, _ in blocks], return_inverse=True)
    nodes = np.bincount(path)
    chars, marks = (np.bincount(path, weights=[f(t) for _, _, t in blocks]) / nodes for f in (len, lambda t: len(MARKS.findall(t))))
    score = smoothed(chars[path]) * (1 + smoothed(marks[path])) * np.sqrt(chars[path])
    return score >= min(score.std(), score.max())


def summed(page: Page, values: dict[int, int]) -> list[int]:
    """Per element, the sum over it and all below it."""
    total = [0] * len(page.elements)
    for e in range(len(page.elements) - 1, 0, -1):  # an element comes after its parent, so sums go up in one pass from the end
        total[e] += values.get(e, 0)
        total[page.elements[e][0]] += total[e]
    total[0] += values.get(0, 0)
    return total


def surroundings(page: Page, blocks: list[tuple], content: np.ndarray) -> list[bool]:
    """Per element, whether it lies in a marked one that is surroundings: none that holds a main element, an article that isn't marked itself, or
    (where no such element lies outside all marked ones) the better part of the content, alone or with the others of its name; nor a header with
    the first heading."""
    held: Counter[int] = Counter()
    texts: Counter[int] = Counter()
    for (element, _, text), mine in zip(blocks, content):
        texts[element] += 1
        held[element] += len(text) * bool(mine)
    total, filled = summed(page, held), summed(page, texts)
    own = summed(page, {e: 1 for e, x in enumerate(page.elements) if filled[e] and (x[1] == "main" or x[1] == "article" and not x[4])})
    title = summed(page, {e: 1 for e, x in enumerate(page.elements) if filled[e] and x[1] == "h1"})
    marked = [False] * len(page.elements)
    for e, x in enumerate(page.elements[1:], 1):
        marked[e] = marked[x[0]] or bool(x[4]) and x[1] not in MAIN
    stated = any(filled[e] and not marked[e] and (x[1] == "main" or x[1] == "article" and not x[4]) for e, x in enumerate(page.elements))
    least = max(1, MOST * total[0]) if not stated else math.inf
    above, named, stays = [NONE] * len(page.elements), Counter(), [True] * len(page.elements)
    for e, (parent, tag, _, _, marks) in enumerate(page.elements[1:], 1):
        stays[e] = not marks or tag in MAIN or own[e] > 0 or total[e] >= least or (title[e] > 0 and marks <= TITLE)
        above[e] = above[parent]
        if not stays[e]:  # each word once on a way down
            named.update({m: total[e] for m in marks - above[e]})
            above[e] = above[e] | marks
    out = [False] * len(page.elements)
    for e, (parent, _, _, _, marks) in enumerate(page.elements[1:], 1):
        out[e] = out[parent] or not (stays[e] or all(named[m] >= least for m in marks))
    return out


def inside(page: Page, blocks: list[tuple], content: np.ndarray) -> list[tuple]:
    """The blocks below the smallest container with nearly all of the content (an article or main element ends the search), the rest of the
    content wherever it lies, and the headings and list items that stand between or lead to these."""
    held: Counter[int] = Counter()
    for (element, _, text), mine in zip(blocks, content):
        held[element] += len(text) * bool(mine)
    total = summed(page, held)
    root = 0
    for e in range(1, len(page.elements)):  # parents first: a child of the present root that holds enough is the next one
        if page.elements[e][0] == root and page.elements[e][1] in CONTAINERS and total[e] >= SHARE * total[0] and page.elements[root][1] not in MAIN:
            root = e
    below = [False] * len(page.elements)
    for e in range(len(page.elements)):
        below[e] = e == root or (e > 0 and below[page.elements[e][0]])
    kept = [below[b[0]] or bool(mine) for b, mine in zip(blocks, content)]
    if not all(kept) and any(kept):
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        kinds = [page.kind(b[0]) for b in blocks]
        while first and kinds[first - 1] in HEADINGS:
            first -= 1
        kept = [mine or (first <= i <= last and kinds[i] in HEADINGS | {"li"}) for i, mine in enumerate(kept)]
    return [b for b, mine in zip(blocks, kept) if mine]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``, page by page in batches, without a shuffle.

    A null or empty page, or one with surroundings only, gives an empty text; broken markup is read as far as it goes; repeated rows
    give equal rows; other columns are not read."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
