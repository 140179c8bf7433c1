"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of tags from the root to the leaf. Per path, the lengths of its texts and
their punctuation marks are added up and divided by the number of its nodes. Both ratios are smoothed along the page with a
Gaussian over neighbouring nodes, so that a short paragraph between long ones is not lost, and fused into their product. Paths
whose fused ratio reaches a threshold, the standard deviation of the page's ratios or a share of the greatest if that is less, are
content. The nodes of content paths are the text; whatever stands in the same container as content, or in a container nested in
that one (cells of tables, div, section), inherits its choice. The frame of the page (html, body) passes its choice on only if more than half of
the content found stands right in it. Elements that never belong to an article (menus, headers of the page, footers, asides, controls, by their tag or role) are left out.

Names in class, id, label and itemprop are hints, not proof: a container that is named like a sidebar, an advert, a notice or reader comments, and a form, keeps
a fiftieth of its ratio and inherits nothing from the container around it. So it is left out beside an article, and read where it holds the article itself. A name counts if it
consists of such words and of words for places and boxes only ("sidebar-left", "cookie-notice"; not "no-sidebar", "related-work", "search-algorithms"), on elements other than
paragraphs, headings and tables, and other than sections in an article.

Each page is handled by itself, inside its row: no shuffle. Null and empty pages give an empty text; so do pages without content.
"""

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardspark.llm.shared import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_MARK = re.compile(r"(?:^|[\s\"'])(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")
_WORD = re.compile(r"[a-z]+")

#: Elements whose content is no text at all.
RAW = frozenset("script style template textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address "
    "nav header footer aside form fieldset details summary hgroup center hr br option select button noscript dialog menu".split())
#: Elements that never belong to an article, and roles that say the same.
OUTSIDE = frozenset("head nav footer aside select option button noscript dialog menu svg canvas object audio video map label input".split())
OUTSIDE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar toolbar".split())
#: Elements that are taken as marked whatever their names.
MARKED = frozenset(("form", "fieldset"))
#: What is left of the ratio of marked text.
MARKED_SHARE = 0.02
#: Words of names that mark a container by themselves, that do so only next to another of these, and words for places and boxes that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu nav navbar navigation "
    "newsletter notice notification pager pagination popup promo promoted sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets modal overlay paywall".split())
WEAK_MARKS = frozenset("alert links related replies reply respond rss search share sharing skip tags buttons".split())
PLACES = frozenset(
    "site page main top bottom left right upper lower global primary secondary first second inner outer box boxes area list lists wrap wrapper container block section region bar slot unit holder group "
    "panel pane item items row col column header head foot body reader readers user users form policy fixed sticky floating mobile desktop small large wide block text content".split())
#: Elements whose names are not looked at.
UNNAMED = frozenset("html body article main p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure a b i em strong span code".split())
#: A new one closes an open one of the same kind.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table article section main div body html nav aside header footer form blockquote figure td th li".split())
CONTAINERS = frozenset(("article", "main", "section", "div", "body", "html", "td"))
#: Containers of the whole page: what is nested in them need not belong to a text that stands right in them.
FRAMES = frozenset(("body", "html"))


@dataclass(eq=False)
class Container:
    """An element that holds blocks, and the container around it; a marked one stands by itself."""

    frame: bool
    around: "Container | None"


@dataclass
class Node:
    """One block of text: the number of its path, whether it lies outside the article, whether it is marked, its pieces and the container it stands in."""

    path: int
    outside: bool
    marked: bool
    block: Container
    pieces: list[str]
    text: str = ""


class Open(NamedTuple):
    """An open element."""

    tag: str
    outside: bool
    marked: bool
    container: Container
    path: int
    in_article: bool


@functools.lru_cache(maxsize=65_536)
def names_outside(name: str) -> bool:
    """Whether a class, id or label names a container that holds no article."""
    for token in name.lower().split():
        words = _WORD.findall(token)
        strong = sum(w in MARKS for w in words)
        if words and strong + sum(w in WEAK_MARKS for w in words) >= (1 if strong else 2) and all(w in MARKS or w in WEAK_MARKS or w in PLACES for w in words):
            return True
    return False


def _judged(tag: str, attributes: str, around: Open) -> tuple[bool, bool]:
    """Whether an element lies outside the article, and whether it is marked."""
    if tag in OUTSIDE or (tag == "header" and not around.in_article):
        return True, False
    if tag in MARKED:
        return False, True
    if "=" not in attributes or tag in UNNAMED or (tag == "section" and around.in_article):
        return False, False
    marked = False
    for found in _MARK.finditer(attributes):
        value = found[2] or found[3] or found[4] or ""
        if found[1].lower() == "role":
            if value.strip().lower() in OUTSIDE_ROLES:
                return True, False
        else:
            marked = marked or names_outside(value)
    return False, marked


def nodes(page: str) -> list[Node]:
    """The blocks of text of a page, in order."""
    top = Open("", False, False, Container(True, None), 0, False)
    stack: list[Open] = [top]
    paths: dict[tuple[int, str], int] = {}  # a path is numbered by the path before its last tag
    there: Counter[str] = Counter()
    found: list[Node] = []
    open_block = True  # whether the next piece of text begins a node
    end, position = len(page), 0

    def close_to(depth: int) -> None:
        nonlocal open_block
        for element in stack[depth:]:
            open_block = open_block or element.tag in BLOCKS
            there[element.tag] -= 1
        del stack[depth:]

    def add(piece: str) -> None:
        nonlocal open_block
        if not piece or (open_block and piece.isspace()):
            return
        around = stack[-1]
        if open_block or (found[-1].outside, found[-1].marked) != (around.outside, around.marked):
            found.append(Node(around.path, around.outside, around.marked, around.container, []))
            open_block = False
        found[-1].pieces.append(piece)

    while position < end:
        token = _TOKEN.search(page, position)
        if not token:
            add(page[position:])
            break
        add(page[position : token.start()])
        position = token.end()
        name = token[2]
        if not name:
            continue
        tag = name.lower()
        if token[1]:
            if there[tag]:
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if tag in BLOCKS or not any(element.tag in SCOPES for element in stack[depth + 1 :]):
                    close_to(depth)
            if tag in BLOCKS:
                open_block = True
            continue
        if tag in BLOCKS:
            open_block = True
            closed = ("p",) + CLOSES.get(tag, ())
            if tag != "br" and any(there[t] for t in closed):
                lowest = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in SCOPES and stack[i].tag not in CLOSES.get(tag, ())), 0)
                if (depth := next((i for i in range(lowest + 1, len(stack)) if stack[i].tag in closed), 0)) > 0:
                    close_to(depth)
        if tag in VOID:
            continue
        if tag in RAW:
            if not token[3].endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, position)
                position = close.end() if close else end
            continue
        around = stack[-1]
        outside, marked = _judged(tag, token[3], around)
        container = around.container
        if marked and not around.marked:
            container = Container(False, None)
        elif tag in CONTAINERS:
            container = Container(tag in FRAMES, container)
        path = paths.setdefault((around.path, tag), len(paths) + 1) if tag in BLOCKS else around.path
        stack.append(Open(tag, around.outside or outside, around.marked or marked, container, path, around.in_article or tag in ("article", "main")))
        there[tag] += 1
    for node in found:
        node.text = _SPACE.sub(" ", html.unescape("".join(node.pieces))).strip()
    return [node for node in found if node.text]


def _smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing along the page, at least the value itself."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    kernel /= kernel.sum()
    return np.convolve(np.pad(values, reach, mode="edge"), kernel, mode="valid")


def select(blocks: list[Node], share: float = 0.1) -> list[bool]:
    """Which blocks are content."""
    paths: dict[tuple[bool, bool, int], int] = {}
    place = np.array([paths.setdefault((b.outside, b.marked, b.path), len(paths)) for b in blocks], np.int64)
    inside = np.array([not b.outside for b in blocks])
    if not inside.any():
        return [False] * len(blocks)
    uses = np.bincount(place)
    lengths = (np.bincount(place, [len(b.text) for b in blocks]) / uses)[place]
    marks = (np.bincount(place, [len(_PUNCTUATION.findall(b.text)) for b in blocks]) / uses)[place]
    lengths, marks = _smooth(np.where(inside, lengths, 0.0)), _smooth(np.where(inside, marks, 0.0))
    fused = np.where(inside, lengths * (1.0 + marks), 0.0) * np.where([b.marked for b in blocks], MARKED_SHARE, 1.0)
    per_path = np.bincount(place, fused) / uses
    threshold = min(float(np.std(fused)), share * float(per_path.max()))
    chosen = (per_path >= threshold)[place] & inside & (per_path[place] > 0)
    # what stands in the same container as content, or nested in it, belongs to it
    kept = {b.block for b, c in zip(blocks, chosen) if c}
    framed = sum(len(b.text) * (2 if b.block.frame else 0) - len(b.text) for b, c in zip(blocks, chosen) if c)
    passing = {block: True for block in kept if framed > 0 or not block.frame}
    return [not b.outside and (b.block in kept or _inherits(b.block, passing)) for b in blocks]


def _inherits(block: Container, passing: dict[Container, bool]) -> bool:
    """Whether a container or one around it passes its choice on; ``passing`` remembers what was found."""
    way: list[Container] = []
    at: Container | None = block
    while at is not None and at not in passing:
        way.append(at)
        at = at.around
    found = at is not None and passing[at]
    passing.update((one, found) for one in way)
    return found


def main_text(page: str | None) -> str:
    blocks = nodes(page or "")
    return " ".join(b.text for b, chosen in zip(blocks, select(blocks)) if chosen) if blocks else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) for every page."""
    rows = pages.select(F.col(html_col).alias("_html"), *keep)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
