"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features."""

from __future__ import annotations

import html
import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telesift.llm.common import bounded_batches, numbered

PAGES_AT_ONCE = 64

# Element names of HTML by their part in a page.
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script|style|noscript|template|svg|math|iframe|object|canvas|title|textarea|select|button"
CHROME_TAGS = frozenset("nav aside footer form menu dialog header".split())
MAIN_TAGS = frozenset("article main".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended trending widget pagination pager copyright legal disclaimer".split()
)
MAIN_NAMES = frozenset("article content main post entry story".split())
# Furniture that holds articles of its own: comments, teasers.
GUEST_TAGS = frozenset("nav aside footer".split())
GUEST_NAMES = frozenset("comment comments disqus reply replies respond discussion related recommended trending".split())
# Words of a compound name: with the first kind it says what an element has, with the second it is a container of its first word's kind.
MODIFIERS = frozenset("has no with without not is hide show open closed enabled disabled after before above below supports".split())
HOLDERS = frozenset("list box block area wrap wrapper container inner outer section item items link links text title body bar row form group content widget panel main".split())
HEADED = frozenset("article post entry story".split())
# Behind a word for an article these are a kind of article, not a notice of the site.
TIDINGS, REPORTED = frozenset("alert notice".split()), HEADED | {"news", "breaking"}
FORM_WORDS = 40  # plain words; a form with fewer is furniture

# Comments end at -->, hidden elements at their end tag, all of them at the end of the page if that is missing.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])[^>]*?/>|<({HIDDEN})(?=[\s/>])[^>]*+(?:>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|\Z)|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HREF = re.compile(r"\bhref\s*=", re.I)

FEATURES = "words link_density words_before link_density_before words_after link_density_after in_main in_chrome page_has_main heading".split()

# Labelled blocks: the features in this order, then 1 for main text.
LABELLED = """
    8 0 0 0 40 0 1 0 1 1 1     40 0 8 0 60 0 1 0 1 0 1    60 0 40 0 3 0 1 0 1 0 1     3 0 60 0 25 0 1 0 1 0 1
    1 0 25 0 30 0 1 0 1 0 1    120 .05 30 0 9 0 1 0 1 0 1  9 0 120 .05 0 0 1 0 1 0 1   2 0 0 0 2 0 1 0 1 1 1
    15 .3 20 0 40 .1 1 0 1 0 1  5 0 1 1 12 0 1 0 1 1 1      30 0 10 0 6 1 1 0 1 0 1      1 0 0 0 0 0 1 0 1 0 1
    4 1 60 0 50 0 1 0 1 0 1    6 1 6 1 6 1 1 0 1 0 0       3 1 3 1 4 1 1 0 1 0 0        2 1 3 1 2 1 1 0 1 0 0
    1 1 0 0 1 1 0 1 1 0 0      1 1 1 1 1 1 0 1 1 0 0       2 1 1 1 12 0 0 1 1 0 0       12 0 2 1 8 0 0 1 1 0 0
    45 0 1 1 8 0 0 1 1 0 0     9 .2 50 0 0 0 0 1 1 0 0     30 .1 60 0 9 .2 0 1 1 0 0    80 0 45 0 60 0 0 1 1 0 0
    5 0 0 0 60 0 0 1 1 1 0     70 0 5 0 20 0 0 1 1 0 0     150 0 80 0 3 0 0 1 0 0 0     25 0 25 0 25 0 0 1 1 0 0
    100 0 2 1 5 1 0 1 1 0 0    95 0 20 0 10 0 0 1 1 0 0    110 0 0 0 8 0 0 1 1 1 0     300 0 90 0 70 0 0 1 1 0 0
    100 0 2 1 5 1 0 1 0 0 0    60 0 10 0 80 0 0 1 0 0 0    25 0 40 0 60 0 0 1 0 0 0    90 .05 60 0 40 0 0 1 0 0 0
    8 0 3 1 60 0 0 1 0 1 0     20 .1 80 0 50 0 0 1 0 0 0   200 .1 5 0 5 0 0 1 0 0 0    7 0 50 0 60 0 0 1 0 0 0
    6 .5 9 0 9 0 0 1 0 0 0     3 0 2 1 2 1 0 1 0 1 0       12 0 0 0 9 1 0 1 0 0 0       40 .6 30 .5 30 .5 0 1 0 0 0
    1 1 0 0 1 1 0 0 1 0 0      12 0 1 1 40 0 0 0 1 0 0     60 0 1 1 9 0 0 0 1 0 0       8 0 60 0 5 1 0 0 1 1 0
    20 0 90 0 0 0 0 0 1 0 0    3 1 3 1 3 1 0 0 1 0 0       35 .1 20 0 0 0 0 0 1 0 0     2 0 0 0 30 0 0 0 1 0 0
    150 0 5 0 5 0 0 0 1 0 0    95 0 80 0 40 0 0 0 1 0 0    45 0 30 0 60 0 0 0 1 0 0    110 .1 3 1 9 0 0 0 1 0 0
    100 0 30 0 10 0 0 0 1 0 0  98 0 5 0 15 0 0 0 1 0 0     104 0 90 0 2 0 0 0 1 0 0    101 0 9 .5 20 0 0 0 1 0 0
    200 0 4 0 3 0 1 0 1 0 1    100 0 60 0 5 0 1 0 1 0 1    50 .2 3 0 200 0 1 0 1 0 1   30 0 150 .1 90 0 1 0 1 0 1
    60 0 10 0 80 0 0 0 0 0 1   90 .05 60 0 40 0 0 0 0 0 1  40 0 90 .05 30 .1 0 0 0 0 1  25 0 40 0 60 0 0 0 0 0 1
    8 0 3 1 60 0 0 0 0 1 1     5 0 60 0 70 0 0 0 0 1 1     20 .1 80 0 50 0 0 0 0 0 1    12 0 40 0 45 0 0 0 0 0 1
    30 .2 50 0 30 0 0 0 0 0 1  18 0 30 0 25 .1 0 0 0 0 1   7 0 50 0 60 0 0 0 0 0 1      100 0 2 1 5 1 0 0 0 0 1
    1 1 0 0 1 1 0 0 0 0 0      2 1 1 1 2 1 0 0 0 0 0       4 .8 2 1 60 0 0 0 0 0 0      6 0 0 0 2 1 0 0 0 0 0
    5 .5 60 0 0 0 0 0 0 0 0    9 .9 40 0 8 .9 0 0 0 0 0    30 .9 20 1 20 1 0 0 0 0 0    3 0 2 1 2 1 0 0 0 1 0
    45 0 0 0 0 0 0 0 0 0 1     120 .1 0 0 0 0 0 0 0 0 1    25 0 0 0 0 0 0 0 0 0 1      60 0 0 0 30 0 0 0 0 0 1
    2 0 0 0 60 0 0 0 0 1 1      1 0 5 1 80 0 0 0 0 1 1      3 0 70 0 45 0 0 0 0 1 1       2 0 40 0 25 0 0 0 0 1 1
    14 0 14 0 14 0 0 0 0 0 1    14 0 0 0 14 0 0 0 0 0 1    14 0 14 0 4 .5 0 0 0 0 1    10 0 12 0 12 0 0 0 0 0 1
    16 0 18 0 3 0 0 0 0 0 1     22 0 20 0 24 0 0 0 0 0 1   12 0 3 1 15 0 0 0 0 0 1     9 0 15 0 20 0 0 0 0 0 1
    7 0 70 0 0 0 0 0 0 0 0     4 0 1 1 3 1 0 0 0 0 0       2 0 3 0 3 0 0 0 0 0 0        6 .4 5 1 4 .5 0 0 0 0 0
"""


class Tree(NamedTuple):
    feature: np.ndarray  # -1: a leaf
    border: np.ndarray
    left: np.ndarray  # where the feature is at most the border
    right: np.ndarray
    value: np.ndarray


def grow(x: np.ndarray, y: np.ndarray, deepest: int = 8) -> Tree:
    """A decision tree by Gini impurity; borders half-way between values, ties to the first feature."""
    nodes: list[list] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at, share = len(nodes), y[rows].mean()
        nodes.append([-1, 0.0, -1, -1, share])
        if depth == deepest or share in (0.0, 1.0):
            return at
        best = (2 * share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for feature in range(x.shape[1]):
            order = rows[np.argsort(x[rows, feature], kind="stable")]
            values, ones = x[order, feature], np.cumsum(y[order])
            for k in np.flatnonzero(values[1:] > values[:-1]) + 1:
                a, b = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(rows) - k)
                impure = 2 * a * (1 - a) * k + 2 * b * (1 - b) * (len(rows) - k)
                if impure < best[0]:
                    best = (impure, feature, (values[k] + values[k - 1]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[at][:4] = [best[1], best[2], split(rows[low], depth + 1), split(rows[~low], depth + 1)]
        return at

    split(np.arange(len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def classify(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = np.flatnonzero(tree.feature[node] >= 0)
        if not len(inner):
            return tree.value[node] > 0.5
        here = node[inner]
        low = x[inner, tree.feature[here]] <= tree.border[here]
        node[inner] = np.where(low, tree.left[here], tree.right[here])


@cache
def fitted(table: str = LABELLED) -> Tree:
    """The tree of a labelled table, to which every block that names no region is added twice more, as no main
    text: on a page whose article is elsewhere, and in page furniture."""
    rows = np.array(table.split(), dtype=float).reshape(-1, len(FEATURES) + 1)
    plain = rows[(rows[:, 6] == 0) & (rows[:, 7] == 0) & (rows[:, 8] == 0)]
    outside, furniture = plain.copy(), plain.copy()
    outside[:, [8, 10]], furniture[:, [7, 10]] = (1, 0), (1, 0)
    rows = np.concatenate([rows, outside, furniture])
    return grow(rows[:, :-1], rows[:, -1])


def _named(token: str) -> str:
    """What one name of an element says: a word of CHROME_NAMES or MAIN_NAMES, or nothing."""
    parts = [p for p in _PARTS.split(token) if p]
    if not parts or MODIFIERS.intersection(parts):
        return ""
    last = parts[-1]
    if last == "header" and HEADED.intersection(parts):
        return "article"
    if last in TIDINGS and REPORTED.intersection(parts):
        return ""
    if last in CHROME_NAMES:
        return last
    if parts[0] in CHROME_NAMES and all(p in HOLDERS or p in CHROME_NAMES for p in parts[1:]):
        return parts[0]
    return next((p for p in parts if p in MAIN_NAMES), "")


def _zone(tag: str, rest: str, parent: int) -> int:
    """0: neither, 1: main text, 2: page furniture, 3: furniture with articles of its own. Inside furniture everything is, until an article or main begins."""
    if tag in ("html", "body", "head"):
        return parent
    names: set[str] = set()
    if "=" in rest:
        for value in _NAMES.findall(rest):
            names.update(map(_named, _CAMEL.sub("-", value).lower().strip("\"'").split()))
    if parent >= 2 and not (tag == "main" or tag == "article" and parent == 2):
        return parent
    if tag in MAIN_TAGS and (names & MAIN_NAMES or not names & CHROME_NAMES):
        return 1
    chrome = names & CHROME_NAMES
    if parent == 1:
        chrome -= {"header"}
    if chrome or tag in CHROME_TAGS and tag != "form" and not (tag == "header" and parent == 1):
        return 3 if tag in GUEST_TAGS or chrome & GUEST_NAMES else 2
    return 1 if names & MAIN_NAMES else min(parent, 1)


def text_blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, zone, heading) of every non-empty text block, in page order."""
    out: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = [("", 0)]
    forms: list[tuple[int, int]] = []  # of open forms: height of the stack, number of blocks before
    places: dict[str, list[int]] = {}  # of open elements by tag: their heights in the stack
    in_link = heading = False
    link_height = 0

    def leave(height: int) -> None:
        """Close all elements from this height on; a link ends with the element it began in."""
        nonlocal in_link
        for tag, _ in stack[height:]:
            places[tag].pop()
        del stack[height:]
        in_link = in_link and len(stack) >= link_height

    def innermost(*tags: str) -> int:
        """Height of the last open element of these tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close() -> None:
        words = html.unescape("".join(parts)).split() if parts else ()
        if words:
            out.append((" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), min(stack[-1][1], 2), int(heading)))
        parts.clear()
        linked.clear()

    def end_forms() -> None:
        while forms and forms[-1][0] >= len(stack):
            first = forms.pop()[1]
            if sum(b[1] - b[2] for b in out[first:]) < FORM_WORDS:
                out[first:] = [(*b[:3], 2, b[4]) for b in out[first:]]

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)

    end = 0
    for m in _TOKEN.finditer(page):
        say(page[end : m.start()])
        end = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link, link_height = not m[2] and _HREF.search(m[4]) is not None, len(stack)
        if tag not in BREAKS:
            continue
        close()
        if tag in VOID:
            continue
        if m[2]:
            found = innermost(tag)
            if found:
                leave(found)
                end_forms()
        elif not m[4].endswith("/"):
            if stack[-1][0] == "p":
                leave(len(stack) - 1)
            if tag == "li":
                found = innermost("li", "ul", "ol", "menu")
                if found and stack[found][0] == "li":
                    leave(found)
                    end_forms()
            if tag == "form":
                forms.append((len(stack), len(out)))
            elif tag in MAIN_TAGS:
                forms.clear()  # they hold a page
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, _zone(tag, m[4], stack[-1][1])))
        heading = len(stack[-1][0]) == 2 and stack[-1][0][0] == "h" and stack[-1][0][1].isdigit()
    say(page[end:])
    close()
    del stack[1:]
    end_forms()
    return out


def block_features(pages: list[list[tuple]]) -> np.ndarray:
    """FEATURES of the blocks of several pages, page after page."""
    rows = np.array([(w, lw / w, z == 1, z == 2, h, i) for i, blocks in enumerate(pages) for _, w, lw, z, h in blocks], dtype=float).reshape(-1, 6)
    words, density, page = rows[:, 0], rows[:, 1], rows[:, 5]
    x = np.zeros((len(rows), len(FEATURES)))
    x[:, 0], x[:, 1], x[:, 6], x[:, 7], x[:, 9] = words, density, rows[:, 2], rows[:, 3], rows[:, 4]
    same = page[1:] == page[:-1]
    x[1:, 2], x[1:, 3] = words[:-1] * same, density[:-1] * same
    x[:-1, 4], x[:-1, 5] = words[1:] * same, density[1:] * same
    has_main = np.bincount(page.astype(np.int64), weights=rows[:, 2], minlength=len(pages)) > 0
    x[:, 8] = has_main[page.astype(np.int64)]
    return x


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    blocks = [text_blocks(p or "") for p in pages]
    keep = classify(tree, block_features(blocks)).tolist()
    out, at = [], 0
    for page in blocks:
        out.append(" ".join(b[0] for b, k in zip(page, keep[at : at + len(page)], strict=True) if k))
        at += len(page)
    return out


def extract_main_text(pages: DataFrame, table: str = LABELLED) -> DataFrame:
    """pages with text: the main text of the html column, by a tree fitted on a labelled table of blocks.

    A page is cut into text blocks at block-level tags; character references are decoded, white space
    in a block becomes one space, and the blocks taken for main text are joined by one space in page
    order. Features of a block: words, share of words in links, both of its neighbours too, whether it
    stands in page furniture (by element or name) or in an article, whether the page has one, and headings.
    Null html counts as empty; without main text the text is empty. Every row is worked on by itself, whole;
    other columns stay (text is replaced); an empty table gives no rows.
    """
    rest = [c for c in pages.columns if c != "text"]
    at = rest.index("html")

    def extract(batches):
        tree = fitted(table)
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(lo, PAGES_AT_ONCE)
                texts = main_texts(part.column(at).to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*rest, "text"])

    rows = pages.select(*[F.col(f"`{c}`") for c in rest])
    return numbered(bounded_batches(rows), rest).mapInArrow(extract, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def page_digest(pages: DataFrame) -> DataFrame:
    texts = extract_main_text(pages.select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
