"""HTML extraction by line-block distribution."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

#: Elements whose content is never text of the page.
HIDDEN = "script style noscript template iframe object svg math canvas video audio select option datalist textarea button head title".split()
#: Elements that hold page furniture.
FURNITURE = "nav header footer aside form menu dialog fieldset".split()
#: Elements without content.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Elements that begin and end a line.
BLOCK = "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
#: Words of class, id and role names that mark page furniture.
MARKS = "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget contentinfo complementary search alert".split()
#: Words that may stand beside a mark in such a name without changing what it says.
BESIDE = "area bar block bottom box button buttons container form global icons inner items left links list main outer page panel right section signup site top unit wrap wrapper".split()
#: Elements whose own lines belong together.
HOLDERS = "div section main article td blockquote".split()
#: Elements that end an open element of the same kind or of these kinds when they begin.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PARTS = re.compile(r"[-_]+")
_LEGAL = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "svg", "template")}
_HIDDEN, _FURNITURE, _VOID, _BLOCK, _MARKS, _BESIDE, _HOLDERS = map(frozenset, (HIDDEN, FURNITURE, VOID, BLOCK, MARKS, BESIDE, HOLDERS))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _named_furniture(name: str) -> bool:
    """Whether a whole class, id or role name says furniture: some part of it is a mark and the rest says nothing else.

    So cookie-notice and site-footer do; with-sidebar, no-comments, search-result and article-header don't.
    """
    parts = [x for x in _PARTS.split(name) if x]
    return any(x in _MARKS for x in parts) and all(x in _MARKS or x in _BESIDE for x in parts)


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """0: no; 1: by its class, id or role; 2: by its element or because it isn't shown."""
    if tag in _HIDDEN or tag in _FURNITURE and not (tag == "header" and in_article):
        return 2
    if tag in ("html", "body", "main") or not attributes:
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _INVISIBLE.search(value):
            return 2
        if name in ("class", "id", "role") and any(map(_named_furniture, value.split())):
            found = 1
    return found


class Line(NamedTuple):
    text: str  # with white space folded
    furniture: bool
    article: bool  # in the article element
    link: bool  # mostly link text
    heading: bool
    holder: int  # which element of HOLDERS it lies in; 0 for none


def lines_of(page: str) -> list[Line]:
    """The page without markup, as lines.

    Furniture by name is no furniture if the first article or a main element lies in it, and an article with such a name is
    furniture only if another one came before (comments are often articles).
    """
    lines: list[Line] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and whether they are furniture
    holders = [0]
    furniture = articles = links = linked = headings = seen = count = 0

    def flush():
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                lines.append(Line(text, furniture > 0, articles > 0, 2 * linked > sum(map(len, buffer)), headings > 0, holders[-1]))
            buffer.clear()
        linked = 0

    def put(part: str):
        nonlocal linked
        buffer.append(part)
        linked += len(part) if links else 0

    def pop_to(n: int):
        nonlocal furniture, articles, links, headings
        while len(stack) > n:
            tag, marked = stack.pop()
            furniture -= marked > 0
            articles -= tag == "article"
            links -= tag == "a"
            headings -= tag in _HEADINGS
            if tag in _HOLDERS:
                holders.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        block = tag in _BLOCK
        if closing:
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if not block:  # a stray end of an inline element doesn't end the blocks in it
                        if any(t in _BLOCK for t, _ in stack[i + 1 :]):
                            break
                    pop_to(i)
                    break
            continue
        if block:
            flush()
        if tag in _RAW_END and not attributes.rstrip().endswith("/"):
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in _VOID or attributes.rstrip().endswith("/"):
            continue
        if kinds := CLOSES.get(tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in kinds:
                    pop_to(i)
                    break
                if stack[i][0] in _BLOCK and stack[i][0] not in ("b", "i"):
                    break
        marked = _furniture(tag, attributes, articles > 0)
        if tag == "article" and marked == 1 and not seen:
            marked = 0
        if tag == "main" or tag == "article" and not marked and not seen:
            furniture -= sum(m == 1 for _, m in stack)
            stack = [(t, 0 if m == 1 else m) for t, m in stack]
        stack.append((tag, marked))
        furniture += marked > 0
        articles += tag == "article"
        seen += tag == "article"
        links += tag == "a"
        headings += tag in _HEADINGS
        if tag in _HOLDERS:
            count += 1
            holders.append(count)
    flush()
    return lines


def stretches(lengths: np.ndarray, window: int = 3, surge: int = 40, dive: int = 1) -> list[tuple[int, int]]:
    """The stretches of lines (begin, end exclusive) between a surge and a dive point.

    Sums the lengths over sliding windows of lines, each window at its first line. A stretch surges at the first line with text
    whose window reaches `surge` characters, or the highest window of a page that has less, and dives before the first
    window with fewer than `dive`; behind it the next one may surge.
    """
    n = len(lengths)
    if not n or not lengths.any():
        return []
    cum = np.r_[0, np.cumsum(lengths)]
    sums = cum[np.minimum(np.arange(n) + window, n)] - cum[:n]
    starts = np.flatnonzero((sums >= min(surge, int(sums.max()))) & (lengths > 0))
    dives = np.flatnonzero(sums < dive)
    out, at = [], 0
    while len(starts := starts[starts >= at]):
        begin = int(starts[0])
        stop = dives[dives > begin]
        at = int(stop[0]) if len(stop) else n
        out.append((begin, at))
    return out


def _prose(line: Line) -> bool:
    """Long, a heading, or ending as a sentence does: what may be the first or last line of a stretch on a page without an article."""
    return not _LEGAL.match(line.text) and (line.heading or len(line.text) >= 40 or line.text[-1] in ".!?…:;\"”»)")


def main_text(page: str) -> str:
    """The article of a page: its lines between surge and dive points of the line-block distribution, joined by a space.

    Furniture has length zero. Where the page marks its article, so has every line outside it; furniture inside leaves no line,
    so that it makes no dive, and a heading just before a surge or a line in the same element belongs to it. On other pages
    mostly-link lines have length zero too; a heading just before a surge belongs to it, short lines at the ends that are no prose (menus, credits) don't, and what lies
    in the same element as the lines before and after, or before the end, of a stretch is part of the article, links included.
    """
    rows: list[Line] = []
    lines = lines_of(page)
    marked = any(x.article and not x.furniture for x in lines)
    for x in lines:
        if not x.furniture or not marked and not (rows and rows[-1].furniture):
            rows.append(x)
    if marked:
        lengths = np.array([len(x.text) if x.article else 0 for x in rows], np.int64)
        inside: list[int] = []
        for begin, stop in stretches(lengths):
            least = inside[-1] + 1 if inside else 0
            while begin > least and lengths[begin - 1] and (rows[begin - 1].heading or rows[begin - 1].holder == rows[begin].holder):
                begin -= 1
            inside += range(begin, stop)
        return " ".join(rows[i].text for i in inside if lengths[i])
    lengths = np.array([0 if x.furniture or x.link or _LEGAL.match(x.text) else len(x.text) for x in rows], np.int64)
    kept: list[int] = []
    for begin, stop in stretches(lengths):
        while begin < stop and not (_prose(rows[begin]) and lengths[begin]):
            begin += 1
        while stop > begin and not (_prose(rows[stop - 1]) and lengths[stop - 1]):
            stop -= 1
        if begin == stop:
            continue
        while begin and rows[begin - 1].heading and lengths[begin - 1]:
            begin -= 1
        gap = range(kept[-1] + 1, begin) if kept else range(0)
        if kept and rows[begin].holder == rows[kept[-1]].holder and not any(rows[i].furniture for i in gap):
            kept += [i for i in gap if rows[i].holder == rows[begin].holder]
        kept += range(max(begin, kept[-1] + 1) if kept else begin, stop)
    if not kept:  # nothing looks like prose: the stretches as they are
        kept = [i for begin, stop in stretches(lengths) for i in range(begin, stop)]
    while kept and rows[kept[-1]].holder and kept[-1] + 1 < len(rows) and rows[kept[-1] + 1].holder == rows[kept[-1]].holder and not rows[kept[-1] + 1].furniture:
        kept.append(kept[-1] + 1)
    return " ".join(rows[i].text for i in kept if not rows[i].furniture)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars. Null or empty html, and pages without text, give an empty string.

    Each page is read whole and on its own; repeated rows give equal results. Other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def extract(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    out = rows.mapInArrow(extract, f"id {kind}, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
