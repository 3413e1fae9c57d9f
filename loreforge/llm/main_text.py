"""Main-text extraction from HTML by tag-path ratios.

A page is read once into its blocks of text, each with its tag path from the root
(block elements with their first class).  For every path, text length (without links)
and punctuation are summed over all blocks on it and below it and divided by their
number.  Both ratios are smoothed along the path, from the outside in, and over
neighbouring blocks; then they are fused, weighed by what the elements say of themselves,
and thresholded: the blocks of the paths above the threshold are the text.

Tags and class words are an input of the scores only: a menu, form, advert or
comment weighs nothing, a marked article weighs more and its paths have at least the
article's own ratios, so that its short headings and lists go with it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import bounded_batches, slices, table

#: Fixed values of HTML: elements without content, of raw text, and those that break a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: What a start tag ends implicitly, within the nearest of the scopes.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never part of an article, and the words in a class, id or role that say so.
NEVER = frozenset("script style noscript template iframe svg math canvas object head title nav footer aside form button select textarea label dialog menu".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar "
    "footer masthead sidebar aside widget widgets cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending comment comments commentlist disqus reply replies respond copyright skip".split()
)
PAGE_HEAD = frozenset("header topbar".split())
#: In "page-with-sidebar" the other words say what an element stands beside.
LAYOUT_WORDS = frozenset("with without has no".split())
ARTICLE = frozenset(("article", "main"))
#: Elements around everything, which say nothing about a path, and headings, which go with what they stand over.
PAGE, HEADINGS = frozenset(("", "html", "body")), frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡؟।]")
_ATTRIBUTES = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*+>""")
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: Elements whose text is never shown.
UNSEEN = frozenset("script style noscript template iframe svg math canvas object head title".split())
#: The weight of what is around a path against its own ratio, of a neighbour against a block; of a marked article against the rest; the threshold's share of the mean.
AROUND, BESIDE, MARKED, SHARE = 0.7, 0.25, 4.0, 0.4


@dataclass(slots=True)
class Element:
    parent: int
    tag: str
    first: str
    #: Its own, until _settle: 0: may be content; 1: its words say that it isn't; 2: its tag does; 3: never shown.
    kind: int
    #: Whether it, or something around it, is an article.
    inside: bool


@dataclass(slots=True)
class Block:
    element: int
    text: str
    links: int


def _kind(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """(kind, first class) by tag and attributes."""
    if tag in NEVER:
        return 3 if tag in UNSEEN else 2, ""
    kind, first = (2, "") if tag == "header" and not inside else (0, "")
    if "=" not in attributes:
        return kind, first
    for name, a, b, c in _NAMED.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            if value.strip().lower() in NEVER_ROLES:
                kind = max(kind, 1)
            continue
        if name.lower() == "class" and value.split():
            first = value.split()[0]
        if tag in ("html", "body", "main"):
            continue
        for token in value.split():
            words = {w.lower() for w in _TOKEN.findall(token)}
            if not words & LAYOUT_WORDS and (words & NEVER_WORDS or not inside and words & PAGE_HEAD):
                kind = max(kind, 1)
    return kind, first


class Reader:
    """One pass over a page: its elements and its blocks in page order."""

    def __init__(self, page: str):
        self.elements = [Element(-1, "", "", 0, False)]
        self.stack = [0]
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.linked = self.in_link = 0
        self._read(page)
        self._break()

    def _break(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(self.stack[-1], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    def _open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            self.in_link += tag == "a"
            return
        if tag == "br":
            self.pieces.append("\n")
            return
        self._break()
        if tag in VOID:
            return
        self.in_link = 0
        if tag in ENDS:
            self._end(*ENDS[tag])
        at = self.elements[self.stack[-1]]
        if at.tag == "p":  # a block element ends a paragraph
            self.stack.pop()
            at = self.elements[self.stack[-1]]
        kind, first = _kind(tag, attributes, at.inside)
        inside = at.inside or (tag in ARTICLE and kind == 0)
        self.elements.append(Element(self.stack[-1], tag, first, kind, inside))
        self.stack.append(len(self.elements) - 1)

    def _end(self, tags: set[str], scopes: set[str]) -> None:
        ends = None  # the outermost within the scope
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.elements[self.stack[i]].tag
            if tag in scopes:
                break
            if tag in tags:
                ends = i
        if ends:
            del self.stack[ends:]

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            self.in_link = max(0, self.in_link - (tag == "a"))
            return
        self._break()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.elements[self.stack[i]].tag == tag:
                del self.stack[i:]
                self.in_link = 0
                return

    def _read(self, page: str) -> None:
        at, n, lower = 0, len(page), None
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                return
            nxt = page[lt + 1 : lt + 2]
            if not (nxt.isalpha() and nxt.isascii()) and nxt not in ("/", "!", "?"):
                self._text(page[at : lt + 1])
                at = lt + 1
                continue
            self._text(page[at:lt])
            if nxt == "!" and page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if nxt in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            name = _NAME.match(page, lt + 1 + (nxt == "/"))
            if name is None:  # "</" before something that is no name
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            tag = name[0].lower()
            attributes = _ATTRIBUTES.match(page, name.end())
            end = attributes.end() if attributes else page.find(">", name.end()) + 1
            if not end:
                return  # an unfinished tag ends the page
            at = end
            if nxt == "/":
                self._close(tag)
                continue
            self._open(tag, page[name.end() : end - 1])
            if tag in RAW:
                if lower is None:
                    lower = page.lower() if len(page.lower()) == n else page
                close = lower.find(f"</{tag}", end)
                at = n if close < 0 else close


def _settle(elements: list[Element]) -> None:
    """Pass exclusion on to what is inside.  An element that only its words exclude stays if it holds the article."""
    hard = [e.kind if e.kind > 1 else 0 for e in elements]
    for i, e in enumerate(elements[1:], 1):
        hard[i] = max(hard[i], hard[e.parent])
    if any(e.kind == 1 for e in elements):
        holds = [e.tag in ARTICLE and e.kind == 0 and not elements[e.parent].inside for e in elements]
        for i in range(len(elements) - 1, 0, -1):
            holds[elements[i].parent] |= holds[i]
        for i, e in enumerate(elements):
            if e.kind == 1 and e.tag not in ARTICLE and holds[i]:
                e.kind = 0
    for i, e in enumerate(elements[1:], 1):
        e.kind = hard[i] or max(e.kind, elements[e.parent].kind)


@dataclass(slots=True)
class Path:
    """A tag path.  n, length, marks: of the blocks on it and below it; here: blocks on it; the ratios are smoothed along the path."""

    parent: int
    tag: str
    weight: float
    inside: bool
    n: int = 0
    length: int = 0
    marks: int = 0
    here: int = 0
    ratios: tuple[float, float] = (0.0, 0.0)
    floor: tuple[float, float] = (0.0, 0.0)


def tag_paths(elements: list[Element], blocks: list[Block]) -> tuple[list[Path], list[int]]:
    """The paths of a page with their ratios, outer ones first, and each element's path."""
    paths: list[Path] = []
    ids: dict[tuple, int] = {}
    of = []
    for e in elements:
        key = (of[e.parent] if of else -1, e.tag, e.first, e.kind > 0, e.inside)
        if key not in ids:
            ids[key] = len(paths)
            paths.append(Path(key[0], e.tag, 0.0 if e.kind else MARKED if e.inside else 1.0, e.inside))
        of.append(ids[key])
    for b in blocks:
        p = paths[of[b.element]]
        p.here += 1
        p.n += 1
        p.length += len(b.text) - b.links
        p.marks += len(PUNCTUATION.findall(b.text))
    for p in reversed(paths[1:]):
        if p.weight:  # what is excluded doesn't tell of what is around it
            up = paths[p.parent]
            up.n, up.length, up.marks = up.n + p.n, up.length + p.length, up.marks + p.marks
    for p in paths:
        own = (p.length / p.n, p.marks / p.n) if p.n else (0.0, 0.0)
        up = paths[p.parent] if p.parent >= 0 else None
        if up and up.tag not in PAGE:
            p.ratios = tuple((x + AROUND * y) / (1 + AROUND) for x, y in zip(own, up.ratios, strict=True))
        else:
            p.ratios = own
        if p.inside:
            p.floor = up.floor if up and up.inside else own
            p.ratios = tuple(map(max, p.ratios, p.floor))
    return paths, of


def _beside(elements: list[Element], blocks: list[Block], ratios: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Ratios of blocks: headings have at least those of the next block that is none; then each is smoothed over its neighbours in the same element."""
    raised = list(ratios)
    for i in range(len(blocks) - 2, -1, -1):
        if elements[blocks[i].element].tag in HEADINGS and elements[blocks[i + 1].element].kind == 0:
            raised[i] = tuple(map(max, raised[i], raised[i + 1]))
    around = [elements[b.element].parent for b in blocks]
    out = []
    for i, own in enumerate(raised):
        near = [raised[j] for j in (i - 1, i + 1) if 0 <= j < len(blocks) and around[j] == around[i] and elements[blocks[j].element].kind == 0]
        out.append(tuple((x + BESIDE * sum(r[k] for r in near)) / (1 + BESIDE * len(near)) for k, x in enumerate(own)))
    return out


def path_scores(elements: list[Element], blocks: list[Block]) -> list[float]:
    """Of each block: the score of its path, the mean over the path's blocks of the weighed geometric mean of length and (one more than) punctuation."""
    paths, of = tag_paths(elements, blocks)
    at = [of[b.element] for b in blocks]
    total = [0.0] * len(paths)
    for i, (length, marks) in zip(at, _beside(elements, blocks, [paths[i].ratios for i in at]), strict=True):
        total[i] += paths[i].weight * (length * (1 + marks)) ** 0.5
    return [total[i] / paths[i].here for i in at]


def chosen(blocks: list[Block], scores: list[float]) -> list[Block]:
    """The blocks whose path's score is at least a share of the mean score of a character."""
    size = [len(b.text) if s > 0 else 0 for b, s in zip(blocks, scores, strict=True)]
    mean = sum(n * s for n, s in zip(size, scores, strict=True)) / max(1, sum(size))
    return [b for b, s in zip(blocks, scores, strict=True) if s > 0 and s >= SHARE * mean]


def main_text(page: str | None) -> str:
    """The content of a page, its blocks joined by an empty line; a null page has none.

    Blocks that stand in links only, on a page without other text, have no length and so no score.
    """
    if not page:
        return ""
    read = Reader(page)
    _settle(read.elements)
    blocks = [b for b in read.blocks if read.elements[b.element].kind < 3]
    return "\n\n".join(b.text for b in chosen(blocks, path_scores(read.elements, blocks)))


def extract(df: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every page.

    Null and empty pages, and pages without an article, have an empty text.  Broken
    markup is read as browsers would read it: open elements end with the page.
    Rows are independent; repeated rows and other columns change nothing.
    """
    n = len(keep)
    src = bounded_batches(df).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(page).cast("string").alias("page"))
    schema = ", ".join([*[f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)], "text string, n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                texts = [main_text(p) for p in part.column("page").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*[f"k{i}" for i in range(n)], "text", "n_chars"])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "text", "n_chars")


def op8_path_ratios(spark, sf_dir):
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
