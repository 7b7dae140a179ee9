"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block element begins a new line, and the edges of page regions (navigation, footer and the like) leave
a gap of empty lines. Sums of text lengths over a sliding window of lines rise at the first line of a stretch of text and fall
back to zero after its last one. A stretch is text of the article if its sums surge: if the highest of them reaches a fixed number
of characters and a share of the highest on the page. It goes from its surge to its dive, so short lines between long ones stay. All such
stretches are kept, in page order; a page without any surge gives its strongest stretch.

What a line weighs is the tags' part: text of links weighs nothing outside of the article element, text inside of it several times
its length. Elements that never hold the story (by tag, or by a class name of their own) are left out beforehand, but never an article or main
element, nor one that holds most of the text of a page without them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtally.llm.common import Batches

WINDOW = 3
SURGE = 40  # characters (weighed) that the sum of a window must reach
SURGE_SHARE = 0.25  # and the share of the highest sum of the page
INSIDE = 8  # what a character of the article element weighs
MOST = 0.6  # an element with more of the page's text is no side element, whatever its class
# Elements without running text, with all they hold.
MUTE = frozenset("script style noscript template iframe object svg math canvas head select option button textarea audio video title".split())
# Regions of a page beside its article.
ASIDE = frozenset("nav aside footer menu form dialog fieldset".split())
BODY = ("article", "main")  # what holds the article, the first that a page has
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination paywall popup promo promoted promotion recommended related "
    "replies respond share sharing sidebar skyscraper social sponsor sponsored subscribe subscription taboola teaser toolbar widget".split()
)
OUTSIDE = frozenset(("header", "topbar"))  # mark the head of a page, unless inside the article

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|</?[a-z][^>]*\Z",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
PART = re.compile(r"[a-z]+")
# Elements of running text: only a class name that is a mark as a whole tells that one is no part of the story.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre span em strong b i dd dt td figcaption".split())


def tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """``(start, end, name, closing, attributes)`` of each piece of markup; comments and raw elements have no name."""
    out = []
    for m in TOKEN.finditer(page):
        name = m["tag"] or m["tag2"] or ""
        closing = bool(m["end"] or m["end2"])
        out.append((m.start(), m.end(), name.lower(), closing, m["attrs"] or m["attrs2"] or ""))
    return out


def partners(found: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Position of the closing token of each element that has one."""
    open_: dict[str, list[int]] = {}
    out = {}
    for k, (_, _, name, closing, attrs) in enumerate(found):
        if not name or name in VOID or attrs.endswith("/"):
            continue
        if not closing:
            open_.setdefault(name, []).append(k)
        elif open_.get(name):
            out[open_[name].pop()] = k
    return out


def marked(name: str, attrs: str) -> set[str]:
    """The marks among the class names, ids and roles of an element: as a whole, or as the first or last part of one."""
    words: set[str] = set()
    if "=" in attrs:
        for values in ATTRIBUTE.findall(attrs):
            for label in " ".join(values).lower().split():
                words.add(label)
                parts = PART.findall(label)
                if parts and name not in RUNNING:
                    words.update((parts[0], parts[-1]))
    return words


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """Lines as ``(text, characters outside links, number of the article around it or 0)``; empty lines make gaps."""
    found = tokens(page)
    match = partners(found)
    wanted = next((name for name in BODY if any(t[2] == name and not t[3] for t in found)), "")
    bodies = [k for k, t in enumerate(found) if t[2] == wanted and not t[3]] if wanted else []
    starts = set(bodies)
    # Characters between the pieces of markup before each of them, for the share of an element without an article element.
    before = [0]
    for k, t in enumerate(found):
        between = page[found[k - 1][1] if k else 0 : t[0]]
        before.append(before[-1] + len(between) - between.count(" "))
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0
    articles: list[int] = []  # closing positions of the articles around
    number = 0  # of the outermost of them

    def text(raw: str, in_link: bool) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw)
            parts.append(plain)
            if in_link:
                linked += len(SPACE.sub("", plain))

    def close(gap: bool) -> None:
        nonlocal linked
        line = SPACE.sub(" ", "".join(parts)).strip()
        if line:
            lines.append((line, max(0, len(SPACE.sub("", line)) - linked), number))
        if gap:
            lines.extend([("", 0, number)] * WINDOW)
        parts.clear()
        linked = 0

    k, at, link = 0, 0, 0
    while k < len(found):
        start, end, name, closing, attrs = found[k]
        text(page[at:start], link > 0)
        at = end
        if articles and k >= articles[0]:
            close(True)
            articles.clear()
            number = 0
        if name and not closing and name not in VOID:
            last = match.get(k)
            words = marked(name, attrs) if name not in BODY else set()
            beside = name in MUTE or name in ASIDE or bool(words & MARKS)
            if not articles:
                beside = beside or name == "header" or bool(words & OUTSIDE)
            if beside and last is not None and not bodies and name not in MUTE and name not in ASIDE and name != "header":
                beside = before[last + 1] - before[k + 1] <= MOST * before[-1]
            ahead = bisect_right(bodies, k) if beside and last is not None else 0
            if beside and last is not None and name not in ("html", "body") and k not in starts and not (ahead < len(bodies) and bodies[ahead] < last):
                if name in BLOCK:
                    close(name in ASIDE and not articles)
                at, k = found[last][1], last + 1
                continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif k in starts and not articles:
            close(True)
            number = k + 1
            articles.append(match.get(k, len(found)))
        elif name in BLOCK:
            link = 0 if name in ASIDE else link
            close(name in ASIDE and not articles)
        k += 1
    text(page[at:], link > 0)
    close(False)
    return lines


def areas(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """First line and end of each stretch in which the window sums stay above zero."""
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(window, np.int64))[: len(lengths)]  # of each line and those before it
    step = np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True))


def stretches(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """First line, line behind the last one with a weight, and highest window sum of each area."""
    out = []
    for first, end in areas(weights, window):
        sums = np.convolve(weights[first:end], np.ones(window, np.int64))
        out.append((first, first + int(np.flatnonzero(weights[first:end])[-1]) + 1, int(sums.max())))
    return out


def surging(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches whose window sums surge; the strongest (ties: the first) if none does."""
    top = max((peak for _, _, peak in found), default=0)
    kept = [(first, end) for first, end, peak in found if peak >= max(SURGE, SURGE_SHARE * top)]
    return kept or [next((first, end) for first, end, peak in found if peak == top)] if found else []


def main_text(page: str | None) -> str:
    """The article's blocks joined by an empty line; an empty string if there is no text."""
    lines = page_lines(page or "")
    held: Counter[int] = Counter()
    for text, _, number in lines:
        held[number] += len(text)
    inside = [n for n in held if n and held[n]]
    best = max(inside, key=lambda n: (held[n], -n)) if inside else 0
    # Inside the article links are text like any other; elsewhere they are what tells menus from text. Other articles are teasers.
    weights = np.array([INSIDE * len(text) if best and number == best else 0 if number else plain for text, plain, number in lines], np.int64)
    return "\n\n".join(lines[i][0] for first, end in surging(stretches(weights)) for i in range(first, end) if lines[i][0] and lines[i][2] in (0, best))


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars`` (its code points).

    A null or empty html gives an empty text. Rows that repeat are extracted each; extra columns are not read.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                sizes = pa.array(map(len, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
