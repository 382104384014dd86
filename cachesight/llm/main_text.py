"""Main text of web pages.

A page becomes a flat list of text blocks. Each is described by its words, its link density, those of its neighbours and
the kind of container that it stands in; a decision tree says which are article. The tree is trained on
``LABELLED`` when the operator is built.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
HINT = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
WORD = re.compile(r"\S+")

#: Fixed values, from the HTML standard: elements whose content is no text of the page; elements that part text blocks.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that are no article by their element, role or a word of their class or id, and words that are as
#: often in the names of layouts that hold the article.
BOILER_TAGS = frozenset("nav footer aside form button dialog menu fieldset label head".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal newsletter subscribe subscription signup login aside nav navigation navbar breadcrumb breadcrumbs "
    "pagination pager footer share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus discussion contentinfo complementary dialog copyright disclaimer".split()
)
LAYOUT_WORDS = frozenset("banner header legal masthead menu search side sidebar tags toolbar topbar widget widgets".split())
#: Words that say of the next one in a name that it is not what the container is: ``no-ads``, ``post-with-comments``.
BESIDE_WORDS = frozenset("has no non with without".split())
ARTICLE_WORDS = frozenset("article main content post story entry body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("container", "words", "links", "words_before", "links_before", "words_after", "links_after", "heading")
OUTSIDE, LAYOUT, NEUTRAL, INSIDE = -2, -1, 0, 1

#: The labelled table: rows of FEATURES and whether the block is article. Containers: -2 boilerplate, -1 a layout that may be
#: either, 0 none that says anything, 1 article or main. Links: share of words that stand in links.
LABELLED = [
    # menus, headers, footers, adverts, notices, comments in containers that say so
    (-2, 1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (-2, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (-2, 2, 1.0, 1, 1.0, 9, 0.0, 0, 0), (-2, 8, 0.0, 1, 1.0, 12, 0.0, 0, 0),
    (-2, 14, 0.0, 1, 1.0, 10, 0.0, 0, 0), (-2, 10, 0.0, 60, 0.0, 0, 0.0, 0, 0), (-2, 40, 0.0, 90, 0.0, 30, 0.0, 0, 0), (-2, 120, 0.0, 60, 0.0, 80, 0.0, 0, 0),
    (-2, 75, 0.1, 12, 0.0, 3, 0.0, 0, 0), (-2, 3, 0.0, 70, 0.0, 35, 0.0, 1, 0), (-2, 25, 0.4, 4, 0.0, 6, 1.0, 0, 0), (-2, 260, 0.0, 3, 0.0, 40, 0.0, 0, 0),
    (-2, 300, 0.0, 20, 0.0, 10, 0.0, 0, 0), (-2, 150, 0.0, 40, 0.0, 2, 1.0, 0, 0), (-2, 22, 0.0, 8, 0.0, 5, 0.0, 0, 0), (-2, 28, 0.0, 45, 0.0, 90, 0.0, 0, 0),
    (-2, 35, 0.0, 80, 0.0, 60, 0.0, 0, 0), (-2, 6, 0.0, 70, 0.0, 66, 0.0, 0, 0), (-2, 18, 0.0, 30, 0.0, 25, 0.0, 0, 0), (-2, 5, 0.0, 60, 0.0, 80, 0.0, 1, 0),
    (-2, 200, 0.3, 5, 0.0, 6, 0.0, 0, 0), (-2, 90, 0.1, 60, 0.0, 45, 0.0, 0, 0),
    # layouts: bars, boxes and teasers; and articles that stand in the wrapper of such a layout
    (-1, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (-1, 3, 0.0, 2, 1.0, 4, 1.0, 1, 0), (-1, 14, 0.0, 3, 0.0, 2, 1.0, 0, 0), (-1, 25, 0.4, 4, 0.0, 6, 1.0, 0, 0),
    (-1, 22, 0.0, 3, 0.0, 20, 0.0, 0, 0), (-1, 30, 0.0, 60, 0.0, 3, 0.0, 0, 0), (-1, 45, 0.7, 50, 0.6, 40, 0.7, 0, 0), (-1, 35, 0.0, 4, 0.0, 30, 0.1, 0, 0),
    (-1, 55, 0.0, 3, 0.0, 2, 1.0, 0, 0), (-1, 60, 0.9, 70, 0.0, 65, 0.0, 0, 0), (-1, 28, 0.0, 30, 0.0, 26, 0.0, 0, 0), (-1, 12, 0.0, 40, 0.0, 35, 0.0, 0, 0),
    (-1, 6, 0.0, 90, 0.0, 5, 1.0, 1, 0), (-1, 70, 0.1, 60, 0.0, 80, 0.0, 0, 1), (-1, 95, 0.0, 75, 0.1, 64, 0.0, 0, 1), (-1, 130, 0.2, 58, 0.0, 110, 0.1, 0, 1),
    (-1, 66, 0.0, 140, 0.0, 72, 0.2, 0, 1), (-1, 82, 0.0, 61, 0.0, 59, 0.0, 0, 1),
    # article containers: paragraphs of any length, headings, lists, quotes, cells
    (1, 11, 0.0, 14, 0.0, 60, 0.0, 1, 1), (1, 1, 0.0, 80, 0.0, 75, 0.0, 0, 1), (1, 1, 0.0, 1, 0.0, 1, 0.0, 0, 1), (1, 64, 0.0, 11, 0.0, 1, 0.0, 0, 1),
    (1, 180, 0.05, 20, 0.0, 90, 0.0, 0, 1), (1, 2, 0.0, 30, 0.0, 10, 0.0, 0, 1), (1, 5, 1.0, 60, 0.0, 50, 0.0, 0, 1), (1, 40, 0.6, 30, 0.1, 55, 0.0, 0, 1),
    (1, 700, 0.0, 0, 0.0, 0, 0.0, 0, 1), (1, 3, 0.0, 0, 0.0, 0, 0.0, 0, 1), (1, 4, 0.0, 120, 0.0, 90, 0.0, 1, 1), (1, 9, 0.0, 1, 1.0, 5, 0.0, 1, 1),
    (1, 3, 0.0, 5, 1.0, 4, 1.0, 0, 1), (1, 60, 0.0, 1, 1.0, 3, 1.0, 0, 1), (1, 1, 1.0, 1, 1.0, 1, 1.0, 0, 1), (1, 2, 0.0, 1, 1.0, 1, 1.0, 0, 1),
    (1, 7, 0.9, 0, 0.0, 2, 1.0, 0, 1), (1, 12, 0.0, 2, 1.0, 9, 1.0, 1, 1), (1, 33, 1.0, 40, 0.9, 8, 0.0, 0, 1), (1, 4, 0.5, 3, 1.0, 0, 0.0, 0, 1),
    # pages without such containers: long blocks with few links, and short ones between them
    (0, 60, 0.0, 10, 0.0, 70, 0.0, 0, 1), (0, 90, 0.1, 60, 0.0, 45, 0.0, 0, 1), (0, 35, 0.0, 80, 0.0, 60, 0.1, 0, 1), (0, 22, 0.05, 50, 0.0, 40, 0.0, 0, 1),
    (0, 6, 0.0, 70, 0.0, 66, 0.0, 0, 1), (0, 3, 0.0, 40, 0.0, 50, 0.0, 0, 1), (0, 8, 0.0, 2, 1.0, 55, 0.0, 1, 1), (0, 5, 0.0, 60, 0.0, 80, 0.0, 1, 1),
    (0, 10, 0.0, 0, 0.0, 44, 0.0, 1, 1), (0, 200, 0.3, 5, 0.0, 6, 0.0, 0, 1), (0, 18, 0.0, 30, 0.0, 25, 0.0, 0, 1), (0, 28, 0.0, 10, 0.0, 4, 0.0, 0, 1),
    (0, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (0, 2, 1.0, 2, 1.0, 3, 1.0, 0, 0), (0, 4, 1.0, 60, 0.0, 4, 1.0, 0, 0), (0, 6, 0.9, 5, 1.0, 70, 0.0, 0, 0),
    (0, 30, 0.9, 10, 1.0, 8, 1.0, 0, 0), (0, 55, 0.8, 8, 0.0, 4, 1.0, 0, 0), (0, 5, 0.0, 1, 1.0, 2, 1.0, 0, 0), (0, 3, 0.0, 0, 0.0, 2, 1.0, 0, 0),
    (0, 7, 0.0, 4, 1.0, 0, 0.0, 0, 0), (0, 4, 0.0, 3, 0.0, 5, 0.0, 0, 0), (0, 2, 0.5, 4, 0.0, 3, 1.0, 0, 0), (0, 4, 0.0, 6, 1.0, 5, 1.0, 1, 0),
]


def train(rows: list[tuple], depth: int = 7, least: int = 1) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, left, right), leaves are booleans. Ties take the first feature."""
    data = np.array(rows, float)
    x, y = data[:, :-1], data[:, -1] > 0.5

    def impurity(v: np.ndarray) -> float:
        p = v.mean()
        return 2 * p * (1 - p) * len(v)

    def grow(at: np.ndarray, left: int):
        own = y[at]
        if left == 0 or len(at) < 2 * least or own.all() or not own.any():
            return bool(own.mean() > 0.5)
        best = (impurity(own) - 1e-9, None, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[at, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[at, f] <= t
                if least <= low.sum() <= len(at) - least and (got := impurity(own[low]) + impurity(own[~low])) < best[0]:
                    best = (got, f, float(t))
        if best[1] is None:
            return bool(own.mean() > 0.5)
        low = x[at, best[1]] <= best[2]
        return (best[1], best[2], grow(at[low], left - 1), grow(at[~low], left - 1))

    return grow(np.arange(len(y)), depth)


def decide(tree, row: tuple) -> bool:
    while not isinstance(tree, bool):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree


def _hidden(attributes: str) -> bool:
    """Whether an element is hidden by its attributes: ``hidden`` itself, a declaration of its style, or for assistive technology."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower().startswith("true") or name == "style" and HIDING.search(value):
            return True
    return False


def _words(value: str) -> set[str]:
    """The words of a class, id, role or label, without those of boilerplate that another word sets beside it. Those of layouts
    stay: who has a bar has to be looked at."""
    own = re.findall(r"[a-z]+|\s", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
    return {w for k, w in enumerate(own) if not (k and own[k - 1] in BESIDE_WORDS and w in BOILER_WORDS)}


def _container(tag: str, attributes: str, outer: int) -> int:
    """What a container says about the text in it; what surrounds it holds where it says nothing."""
    if attributes:
        if _hidden(attributes):
            return OUTSIDE
        words = {w for m in HINT.findall(attributes) for w in _words(m)}
        if tag not in ("html", "body"):
            own = words & ARTICLE_WORDS
            if words & BOILER_WORDS and not (own and tag in ("article", "main")):
                return OUTSIDE
            if words & LAYOUT_WORDS and not (own and tag in ("article", "main")):
                return min(outer, LAYOUT)
            if own and outer >= NEUTRAL:
                return INSIDE
    if tag in BOILER_TAGS or tag == "header" and outer != INSIDE:
        return OUTSIDE
    if tag in ("article", "main") and outer >= NEUTRAL:
        return INSIDE
    return outer


def next_tag(page: str, at: int, quoted: bool) -> tuple[int, int, str, bool, str, bool] | None:
    """(begin, end, name, closing, attributes, quoted) of the first tag from ``at`` on; comments and declarations have no name.

    A tag ends at the first ``>`` outside quotes. Where there is none (a quote that is never closed), it and all later ones end
    at the first ``>``: ``quoted`` is False from then on, so a page is looked through in linear time. A tag without an end takes
    the rest of the page.
    """
    while 0 <= (begin := page.find("<", at)):
        closing = page.startswith("/", begin + 1)
        if name := NAME.match(page, begin + 1 + closing):
            end = name.end()
            if quoted:
                while (stop := STOP.search(page, end)) and stop[0] != ">" and 0 <= (shut := page.find(stop[0], stop.end())):
                    end = shut + 1
                if quoted := bool(stop and stop[0] == ">"):
                    end = stop.start()
            if not quoted and (end := page.find(">", name.end())) < 0:
                end = len(page)
            return begin, min(end + 1, len(page)), name[0].lower(), closing, page[name.end() : end], quoted
        if page.startswith(("<!", "<?"), begin):
            mark, skip = ("-->", 4) if page.startswith("<!--", begin) else (">", 2)
            end = page.find(mark, begin + skip)
            return begin, len(page) if end < 0 else end + len(mark), "", False, "", quoted
        at = begin + 1
    return None


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, container, heading) of each text block, in page order."""
    out: list = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int]] = []
    state, link, heading = NEUTRAL, False, 0

    def text(raw: str) -> None:
        nonlocal linked
        t = html.unescape(raw) if "&" in raw else raw
        parts.append(t)
        if link:
            linked += len(WORD.findall(t))

    def end() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), state, heading))
            parts.clear()
        linked = 0

    at, quoted = 0, True
    opened: Counter[str] = Counter()  # elements of the stack by name
    paragraph: tuple[int, int] | None = None  # state around an open paragraph that has one of its own, elements open at its start
    while m := next_tag(page, at, quoted):
        begin, end_at, tag, closing, attributes, quoted = m
        if begin > at:
            text(page[at:begin])
        at = end_at
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            if tag == "title":
                end()
            continue
        if tag == "a":
            link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end()
            if paragraph:  # any block ends it
                state = paragraph[0]
                for name, _ in stack[paragraph[1] :]:
                    opened[name] -= 1
                del stack[paragraph[1] :]
                paragraph = None
            if tag == "p" and attributes and not closing and (new := _container(tag, attributes, state)) != state:
                paragraph, state = (state, len(stack)), new
        if tag in HEADINGS:
            heading = int(not closing)
        elif tag in BLOCK and heading:
            heading = 0
        if tag in VOID or tag == "p":
            continue
        if closing:
            if not opened[tag]:
                continue
            while True:
                name, outer = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
            if tag not in BLOCK and outer != state:
                end()
            state = outer
        elif tag in BLOCK or attributes or tag in BOILER_TAGS:
            new = _container(tag, attributes, state)
            if new != state:
                end()
            stack.append((tag, state))
            opened[tag] += 1
            state = new
    if at < len(page):
        text(page[at:])
    end()
    return out


def features(found: list[tuple]) -> list[tuple]:
    share = [b[2] / b[1] for b in found]
    out = []
    for k, b in enumerate(found):
        before, after = (found[k - 1][1], share[k - 1]) if k else (0, 0.0), (found[k + 1][1], share[k + 1]) if k + 1 < len(found) else (0, 0.0)
        out.append((b[3], b[1], share[k], *before, *after, b[4]))
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract_text(pages: DataFrame, column: str = "html", labelled: list[tuple] = LABELLED) -> DataFrame:
    """``pages`` without ``column``, with text and n_chars (code points); columns of these names are replaced.

    Null or empty pages have an empty text. Pages are read whole and stay where they are: there is no shuffle.
    """
    tree = train(labelled)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p, tree) for p in b], dtype=object)

    found = pages.withColumn("text", text(column))
    if column != "text":
        found = found.drop(column)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
