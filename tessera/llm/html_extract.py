"""Operator 8: main text of web pages by line-block distribution.

Markup is stripped to one line per block; lines of menus, headers, footers, sidebars, notices, adverts, forms, scripts
and reader comments are marked as such by their elements. Text lengths without links are summed over sliding windows
of lines; the main text lies between the surge and the dive of the span with most text. Where most of that span lies
within an article element, the span grows or shrinks to the lines of the outermost such element, so short first and
last paragraphs are neither lost nor joined by strangers; failing that, to the outermost main element, or to the
innermost block named as content that holds all that such blocks hold of the span.

Names of boilerplate count on any element, but on those that hold text themselves (paragraphs, headings, table cells,
inline ones) only where they name adverts or notices. Character references are decoded in each text node, not across
tags. Null and empty pages have no text. Pages are handled one by one: repeated rows give equal results, very long or
deep pages take time in proportion, unclosed elements end with their parents, and of other columns none is read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, pieces, table

# Elements without content, elements that start a block, and elements or names around boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption title head".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp noembed".split())
DROPPED = frozenset("head nav footer aside form button select input textarea script style noscript template iframe svg canvas object dialog menu audio video math datalist noframes noembed applet label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices notification notifications alert disclaimer sidebar sidebars menu menus submenu nav navbar navigation topnav subnav breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay login search searchbox searchform widget widgets pagination pager paging skip tags outbrain taboola paywall".split()
)
STRICT = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos cookie cookies consent gdpr notice notices notification notifications disclaimer newsletter paywall".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption caption span b i em strong a abbr cite code mark q small sub sup u s time var kbd samp font ins del".split())
CONTENT = frozenset("article content maincontent main post entry story articlebody postbody".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "option", "optgroup", "title", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "legend", "caption", "summary", "figcaption"}

WINDOW, LEAST = 3, 60

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(?=[\s/>]|$))""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    plain: int  # code points outside links
    within: int  # the innermost content element around it, or -1


class Content(NamedTuple):
    kind: int  # 0 for an article, 1 for main, 2 for a block named as content
    parent: int  # the content element around it, or -1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _boilerplate(tag: str, own: dict[str, str], inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not own or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    names = set(_NAME.findall(f"{own.get('class', '')} {own.get('id', '')}"))
    sought = STRICT if inside and tag in TEXTUAL else NAMES
    return own.get("role") in ROLES or not sought.isdisjoint(names) or (not inside and "header" in names)


def _kind(tag: str, own: dict[str, str]) -> int | None:
    role = own.get("role")
    if tag == "article" or role == "article":
        return 0
    if tag == "main" or role == "main":
        return 1
    named = tag in ("div", "section", "td") and not CONTENT.isdisjoint(_NAME.findall(f"{own.get('class', '')} {own.get('id', '')}"))
    return 2 if named else None


def lines(page: str) -> tuple[list[Line], list[Content]]:
    """The page's blocks outside boilerplate, and its content elements, both in order."""
    out: list[Line] = []
    contents: list[Content] = []
    stack: list[tuple[str, bool, int]] = []  # name, whether it is dropped, content element's number or -1
    opened: Counter[str] = Counter()  # open elements by name
    blocks: list[int] = []  # places of the open blocks in the stack
    parts: list[str] = []
    node: list[str] = []  # the text node so far
    dropped, links, plain, within = 0, 0, 0, -1

    def end() -> None:
        nonlocal plain
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Line(text, min(plain, len(text)), within))
            parts.clear()
        plain = 0

    def add(text: str) -> None:
        nonlocal plain
        if text and not dropped:
            parts.append(text)
            if not links:
                plain += len(text)

    def close_node() -> None:
        if node:
            add(entities.unescape("".join(node)))
            node.clear()

    def pop() -> None:
        nonlocal dropped, within, links
        name, was, number = stack.pop()
        opened[name] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        dropped -= was
        links -= name == "a"
        if number >= 0:
            within = contents[number].parent

    at, low = 0, None
    while True:
        lt = page.find("<", at)
        if lt < 0:
            node.append(page[at:])
            break
        node.append(page[at:lt])
        if page.startswith("<!--", lt):
            close_node()
            gt = page.find("-->", lt + 4)
            if gt < 0:
                break
            at = gt + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            close_node()
            gt = page.find(">", lt)
            if gt < 0:
                break
            at = gt + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                break  # a tag that the page's end cuts off
            node.append("<")
            at = lt + 1
            continue
        close_node()
        at, closing, name, raw = m.end(), bool(m[1] or m[4]), (m[2] or m[5]).lower(), m[3] if m[2] else m[6]
        block = name in BLOCKS
        if block:
            end()
        elif name in ("br", "td", "th"):
            add(" ")
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in RAW:
            low = page.lower() if low is None else low
            if len(low) != len(page):
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            at = low.find(f"</{name}", at)
            if at < 0:
                break
            gt = page.find(">", at)
            if gt < 0:
                break
            at = gt + 1
            continue
        if raw.endswith("/") and not block:
            continue
        if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            k = blocks[-1]
            while len(stack) > k:
                pop()
        elif name == "li":
            while stack and stack[-1][0] == "li":
                pop()
        own = _attributes(raw)
        drop = _boilerplate(name, own, within >= 0)
        number, kind = -1, _kind(name, own)
        if not dropped and not drop and kind is not None:
            number = len(contents)
            contents.append(Content(kind, within))
            within = number
        if block:
            blocks.append(len(stack))
        opened[name] += 1
        stack.append((name, drop, number))
        dropped += drop
        links += name == "a"
    close_node()
    end()
    return out, contents


def span(lengths: list[int], window: int = WINDOW, least: int = LEAST) -> tuple[int, int]:
    """Start and end (exclusive) of the lines between the surge and the dive around most text."""
    n = len(lengths)
    if not n:
        return 0, 0
    sums, total = [], sum(lengths[:window])
    for i in range(n):  # sums[i]: text in lines i to i + window - 1
        sums.append(total)
        total += (lengths[i + window] if i + window < n else 0) - lengths[i]
    best, i = (0, 0, n), 0
    while i < n:
        if sums[i] < least:
            i += 1
            continue
        start = i  # surge: from here each window holds text
        while i < n and sums[i] >= least:
            i += 1
        stop = min(n, i + window - 1)  # dive
        while start < stop and not lengths[start]:
            start += 1
        while stop > start and not lengths[stop - 1]:
            stop -= 1
        best = max(best, (sum(lengths[start:stop]), -start, -stop), key=lambda x: x[0])
    return (-best[1], -best[2]) if best[0] else (0, n)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    every, contents = lines(page)
    start, stop = span([x.plain for x in every])
    mass, last, whole = [0] * len(contents), list(range(len(contents))), 0
    for x in every[start:stop]:
        whole += len(x.text)
        if x.within >= 0:
            mass[x.within] += len(x.text)
    for number in range(len(contents) - 1, -1, -1):  # an element's descendants are number + 1 to last[number]
        if (parent := contents[number].parent) >= 0:
            mass[parent] += mass[number]
            last[parent] = max(last[parent], last[number])
    chosen = None
    for kind in (0, 1):
        if chosen is None:
            chosen = next((n for n, c in enumerate(contents) if c.kind == kind and 10 * mass[n] >= 6 * whole), None)
    if chosen is None and contents and 10 * (most := max(mass)) >= 6 * whole:
        chosen = max(n for n, m in enumerate(mass) if m == most)
    if chosen is None:
        return "\n".join(x.text for x in every[start:stop])
    return "\n".join(x.text for x in every if chosen <= x.within <= last[chosen])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", "html"), run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
