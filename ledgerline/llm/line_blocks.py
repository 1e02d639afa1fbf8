"""Main text of web pages by line-block distribution.

The page's markup is stripped into *lines*, one per block element. Scripts,
styles and what belongs to the page's frame (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments; known by element, role,
class or id) become lines of length 0, as does a line that is nearly all
links. Text lengths are summed over a sliding window of lines: where the sum
*surges* over the threshold the main text begins, where it *dives* to nothing
it ends, and the lines between are kept whole, short ones too.

Every page goes through the distribution, and every stretch that surges is
kept. The threshold is ``SURGE`` characters, or on a page whose windows all
hold less the fullest window's. Outside marked text a stretch below it is
lost: a closing line of fewer characters, say, behind three lines of links. What a page marks as its article is a weight only: marked lines count
even if they are links, and if the marked text outweighs the rest, a stretch
with marked lines surges however short it is.

Inside a line character references are decoded and white space becomes one
space; kept lines are joined by one space.

Defined results: a null or empty page, or one without main text, gives the
empty text; unclosed elements end with their parent or the page; repeated
rows are extracted one by one; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices_of

#: Lines in the sliding window.
WINDOW = 3
#: Characters in a window at which the text surges.
SURGE = 80
#: Share of link text at which a line is a menu line.
LINKS = 0.8

# Names of the HTML standard.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "head")
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q ruby
rp rt s samp small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav header footer aside form dialog menu button select option fieldset".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of class and id names that mark the page's frame.
FRAME_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion
banner menu nav navbar navigation breadcrumb breadcrumbs sidebar sidenav aside widget widgets footer header masthead
topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription
signup login share sharing social related recommended recommendations comment comments disqus replies respond pager
pagination copyright disclaimer search""".split())
#: Of these, the ones that inside an article name its own title.
TITLE_NAMES = frozenset(("header", "masthead"))
ARTICLE_NAMES = frozenset("articlebody entry-content post-content article-content article-body post-body story-body".split())

_RAW = "|".join(RAW)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*+)>|<[!?][^>]*+>", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


class Line:
    """A block's text, how much of it is link text, and where it stands."""

    __slots__ = ("parts", "linked", "frame", "article")

    def __init__(self, frame: bool, article: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.frame, self.article = frame, article

    def text(self) -> str:
        return " ".join(references.unescape("".join(self.parts)).split())


def element_kind(name: str, attrs: str, in_article: bool) -> str:
    """``frame``, ``article`` or nothing, by the element's name and attributes."""
    if name in FRAME and not (name == "header" and in_article):
        return "frame"
    if name in ("article", "main"):
        return "article"
    if "=" not in attrs or name == "body" or name == "html":
        return ""
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in FRAME_ROLES:
            return "frame"
        if key == "role" and value in ("main", "article") or key == "itemprop" and value == "articlebody":
            return "article"
        if key in ("class", "id"):
            if ARTICLE_NAMES.intersection(value.split()):
                return "article"
            found = FRAME_NAMES.intersection(_WORD.findall(value))
            if found and not (in_article and found <= TITLE_NAMES):
                return "frame"
    return ""


def page_lines(html: str) -> list[Line]:
    """The page as lines, with everything that never shows left out."""
    lines = [Line(False, False)]
    open_elements: list[tuple[str, str]] = []
    depth: Counter[str] = Counter()
    frames = articles = links = 0
    at = 0

    def text(part: str) -> None:
        if part:
            lines[-1].parts.append(part)
            if links:
                lines[-1].linked += len(part)

    for m in _TOKEN.finditer(html):
        text(html[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, closing = name.lower(), m["close"] or m["close2"]
        if name == "a":
            links = 0 if closing else 1
        if name in INLINE:
            continue
        if name not in VOID and not closing and not (m["attrs"] or m["attrs2"] or "").endswith("/"):
            kind = element_kind(name, m["attrs"] or m["attrs2"] or "", articles > 0)
            if name not in ("p", "li", "td", "tr", "th", "dt", "dd") or kind:
                open_elements.append((name, kind))
                depth[name] += 1
                frames += kind == "frame"
                articles += kind == "article"
            links = 0
        elif closing and depth[name]:
            while True:
                other, kind = open_elements.pop()
                depth[other] -= 1
                frames -= kind == "frame"
                articles -= kind == "article"
                if other == name:
                    break
            links = 0
        lines.append(Line(frames > 0, articles > 0))
    text(html[at:])
    return lines


def window_sums(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sum of each line's length and those of the following ``window - 1`` lines."""
    running = np.concatenate([[0], np.cumsum(lengths), np.full(window, lengths.sum())])
    return running[window:window + len(lengths)] - running[:len(lengths)]


def stretches(lengths: np.ndarray, surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, line after the last) between each surge and its dive: the
    largest ranges without an empty window in which some window reaches ``surge``."""
    sums = window_sums(lengths, window)
    full = np.concatenate([[False], sums > 0, [False]])
    begin, end = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(full[:-1] & ~full[1:])
    return [(int(a), int(b)) for a, b in zip(begin, end) if sums[a:b].max() >= surge]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = [(line, line.text()) for line in page_lines(html)]
    lines, texts = [line for line, t in found if t], [t for _, t in found if t]
    lengths = np.zeros(len(lines), np.int64)
    marked = np.zeros(len(lines), bool)
    for i, (line, t) in enumerate(zip(lines, texts)):
        marked[i] = line.article and not line.frame
        if marked[i] or not line.frame and line.linked < LINKS * len("".join(line.parts)):
            lengths[i] = len(t)
    # lines that the page marks surge at once, if the text marked outweighs the rest
    trusted = 2 * lengths[marked].sum() > lengths.sum()
    sums = window_sums(lengths)
    # on a page with little text its fullest windows surge
    surge = min(SURGE, int(sums.max(initial=1)))
    kept = [(a, b) for a, b in stretches(lengths, 1) if sums[a:b].max() >= surge or trusted and marked[a:b].any()]
    return " ".join(texts[i] for a, b in kept for i in range(a, b) if lengths[i])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page; no shuffle."""
    out = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, "html", 4 << 20):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], schema=out)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed(
        {"id": id_col, "url": url_col})
