"""Main-text extraction from HTML by line-block distribution.

Markup is stripped into lines (a block-level tag or ``<br>`` ends a line) by a scanner
that reads tags, attributes, comments and raw text as browsers do, in time linear in the
page whatever it holds.  Every line has a weight, the length of its text that may be
content: text inside menus, headers, footers, sidebars, notices, adverts, forms and
reader comments weighs nothing, and link text outside an article weighs nothing.  Weights are summed over a sliding
window of lines; where a window's sum surges over a threshold there is main text.

* If the page marks articles, nothing outside them is kept.  Of several articles, those
  in which a window surges are kept whole (teasers of other stories have none); if no
  article surges, all are.
* On other pages the main run goes from the surge to the dive: from the first to the
  last line with weight, and lines of nothing but link text belong to it unless so many
  of them open or close the page that a window's sum is zero (a menu, a list of links).
  If no window surges, every line is kept.

An element is boilerplate by its tag, its role, by being hidden, or by a class or id
that names it (``ad``, ``share-buttons``, ``site-footer``).  A name that only has such a word in it
(``share-price``, ``search-results``, ``notice-of-motion``) is a hint: such an element goes only if
at least half of its text is link text.  Every other line is kept, in page order, joined by newlines.

Defined cases: null html is empty and gives an empty text; truncated pages and unclosed
tags are read to the end; a tag, comment or script that the page's end cuts off has no
text; repeated rows and null ids pass through row by row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cytolake.llm.common import arrow_map, arrow_schema, columns, table, texts

#: Lines in a window, and the sum that shows main text: the values published with the line-block distribution function (Chen, 2010).
WINDOW, SURGE = 3, 86

#: A comment, a tag or what is read as a comment. No part is tried twice: repeats are possessive, and a tag ends at the page's end at the latest.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]++)(?>\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_SPACE = re.compile(r"\s+")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")

#: Elements whose content is text and not markup, none of it the page's.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Elements whose content isn't shown as text.
UNSEEN = frozenset("noscript template object svg math canvas audio video select datalist".split())
FOREIGN = frozenset({"svg", "math"})
BLOCK = frozenset((
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul").split())
#: Elements without content.
VOID = frozenset({"br", "hr"})
#: Elements that need not be closed, and the tags that close them.
ENDED_BY = {
    "p": BLOCK - VOID, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "tbody": {"tbody", "thead", "tfoot"}, "thead": {"tbody", "tfoot"}, "caption": {"tr", "tbody", "thead", "tfoot"},
}
PLAIN = frozenset("nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Words of a class or id that name boilerplate.
NAMES = frozenset((
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar comment comments disqus respond reply replies "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations pagination pager copyright disclaimer skip search").split())
#: Those of them that are also words of other things' names, even at the end of one (``market-share``).
COMMON = frozenset("share notice notices search alert menu comment related reply replies social skip promotion subscription banner consent copyright".split())
#: Words that may stand beside such a word in a name of the same thing.
BESIDE = frozenset((
    "area bar block body bottom box button buttons card center col column container content div element form global group head header holder icon icons "
    "id inner item items js left link links list main mobile module outer page panel posts primary right row secondary section site slot stories story "
    "text title top unit web wrap wrapper zone").split())
#: Words that make a name say what else an element has or lacks (``has-sidebar``).
STATES = frozenset("has with no is not without non".split())
ARTICLE = frozenset({"article", "main"})
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass
class Line:
    """A line's text, how much of it is link text, its article (0: none), and the hinted element that it is in (0: none)."""

    text: str
    links: int
    article: int
    hint: int


@dataclass(slots=True)
class Element:
    """An open element: each with what it inherits."""

    name: str = ""
    bad: bool = False  # boilerplate
    inline: bool = False  # in boilerplate that doesn't end a line
    article: int = 0
    hint: int = 0


def name_evidence(value: str) -> int:
    """2 if a class or id names boilerplate, 1 if it only has such a word in it, else 0."""
    most = 0
    for token in value.split():
        words = _WORDS.findall(token)
        if not words or words[0] in STATES or NAMES.isdisjoint(words):
            continue
        if NAMES.union(BESIDE).issuperset(words) or words[-1] in NAMES and words[-1] not in COMMON:
            return 2
        most = 1
    return most


def evidence(name: str, attributes: str, in_article: bool) -> int:
    """2 if an element is boilerplate, 1 if its name hints at it, else 0."""
    if name in PLAIN or name in UNSEEN or name == "header" and not in_article:
        return 2
    if not attributes or name in ("html", "body"):
        return 0
    most = 0
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            if name in ARTICLE:
                if not NAMES.isdisjoint(value.split()):
                    return 2
                continue
            most = max(most, name_evidence(value))
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        elif key == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
            return 2
        if most == 2:
            return 2
    return most


def page_lines(page: str) -> tuple[list[Line], list[str]]:
    """The lines that have text and aren't boilerplate, and the tag of each article (``article`` or ``main``, numbered from one)."""
    lines: list[Line] = []
    run: list[str] = []
    links: list[str] = []
    stack = [Element()]
    top = run_of = stack[0]
    is_open: Counter[str] = Counter()
    articles, hints = [], 0
    link, at, size = False, 0, len(page)

    def flush():
        if run:
            text = _SPACE.sub(" ", html_module.unescape("".join(run))).strip()
            if text:
                lines.append(Line(text, len(_SPACE.sub(" ", html_module.unescape("".join(links))).strip()), run_of.article, run_of.hint))
            run.clear()
            links.clear()

    def close(depth: int):
        nonlocal top
        if any(x.name in BLOCK and not x.inline for x in stack[depth:]):
            flush()
        for x in stack[depth:]:
            is_open[x.name] -= 1
        del stack[depth:]
        top = stack[-1]

    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text and not top.bad:
            if not run:
                run_of = top
            run.append(text)
            if link:
                links.append(text)
        if not m:
            break
        at = m.end()
        if not m[2] or not m[4]:
            continue
        closing, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if name in RAW:
            if not closing and top.name not in FOREIGN:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                if end is None:
                    break
                at = end.end()
            continue
        if name == "a":
            link = not closing
            continue
        block = name in BLOCK
        if not block and name not in UNSEEN and name != "span":
            continue
        if block and not closing and top.name in FOREIGN:  # such a tag ends a drawing
            close(len(stack) - 1)
        if block and not top.inline:
            flush()
        if closing:
            if is_open[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                close(depth)
            continue
        while name in ENDED_BY.get(top.name, ()):
            close(len(stack) - 1)
        if name in VOID or name in FOREIGN and _SELF_CLOSED.search(attributes):
            continue
        mark = 0 if top.bad else evidence(name, attributes, top.article > 0)
        if name == "span" and mark < 2 and not is_open[name]:
            continue
        article, hint = top.article, top.hint
        if mark == 1 and block and not hint:
            hints += 1
            hint = hints
        if name in ARTICLE and not top.bad and mark < 2:
            articles.append(name)
            article = len(articles)
        top = Element(name, top.bad or mark == 2, top.inline or mark == 2 and not block, article, hint)
        stack.append(top)
        is_open[name] += 1
    flush()
    return lines, articles


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text; see the module's text."""
    lines, articles = page_lines(page or "")
    # Elements of which a name hints at boilerplate: the share of link text decides.
    linked, whole = Counter(), Counter()
    for x in lines:
        if x.hint:
            linked[x.hint] += x.links
            whole[x.hint] += len(x.text)
    lines = [x for x in lines if not x.hint or 2 * linked[x.hint] < whole[x.hint]]

    def sums(weights: list[int]) -> np.ndarray:
        return np.convolve(np.array(weights, np.int64), np.ones(window, np.int64)) if weights else np.zeros(1, np.int64)

    weigh = lambda x: max(0, len(x.text) - x.links)
    if any(x.article for x in lines):
        own: dict[int, list[int]] = {}
        for x in lines:
            if x.article:
                own.setdefault(x.article, []).append(weigh(x))
        main = {k for k, w in own.items() if sums(w).max() >= surge}
        # What stands in <main> beside its articles, such as their title, stays with them.
        keep = main | {k for k in own if articles[k - 1] == "main"} if main else set(own)
        return "\n".join(x.text for x in lines if x.article in keep)
    weights = [weigh(x) for x in lines]
    first, last = 0, len(lines)
    if last and sums(weights).max() >= surge:
        heavy = np.flatnonzero(weights)
        first = heavy[0] if heavy[0] >= window else 0
        last = heavy[-1] + 1 if last - 1 - heavy[-1] >= window else last
    return "\n".join(x.text for x in lines[first:last])


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def extract(df: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    schema = arrow_schema(EXTRACTED)

    def run(batches):
        for b in batches:
            out = [main_text(x, window, surge) for x in texts(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], schema=schema)

    return arrow_map(columns(df, page_id="bigint", url="string", html="string"), run, EXTRACTED)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
