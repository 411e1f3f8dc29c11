"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block-level tag ends one. Each line has a length in code points, without link text, and
the lengths are summed over sliding windows of ``WINDOW`` lines. The text surges where a sum reaches the surge
threshold, ``SURGE`` or ``SURGE_SHARE`` of the page's greatest sum, whichever is less, and it dives, before and after
that, where a sum falls to ``DIVE``. What lies between two dives with a surge is kept, however short single lines are in
there; lines of length 0 at its ends are not.

Markup weighs lines, and the sums decide:

* Elements that never hold an article's text (scripts, styles, menus, page headers, footers, sidebars, forms), or whose
  class, id or role names them as advert, notice, comments or the like, are stripped with what they contain. A line of
  length 0 stands for them; for menus, headers, footers and sidebars outside a marked article it is a whole window.
  A class or id counts where it is a listed name, or made of such names and of words like ``box`` or ``list`` only:
  ``ad-box`` is an advert, ``no-sidebar``, ``tag-search`` and ``related-work`` are nothing.
* A name alone takes no article: a form, or an element stripped for its name, stays if it holds more than half of the
  page's text (links, menus and the like not counted) and no marked article next to it has text. What is named as advert
  or comments, or is hidden, stays only where nothing else has text. What such an element contains is judged anew.
  Beyond ``WRAPPERS`` of them, one in the other, no name on the page counts.
* Lines in a marked article (``article``, ``main``, role ``main``) count ``MARK_WEIGHT`` times, link text included, and
  a window of length 0 stands at either end of it.

Defined results
---------------
* A null or empty page, and one whose lines all have length 0, gives the empty text. On any other page the window with
  the greatest sum is a surge, however short its text is.
* Lines without text (adjacent tags) are no lines.
* Character references are decoded once, after the tags are gone. Runs of white space within a block become one space;
  ``br`` is white space; blocks are joined by one \\n.
* Rows are independent; repeated rows give repeated results, and an empty table an empty one. Pages are read whole.
  Columns besides key, url and html are not read. Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Lines of a window, and the sums (code points) of a surge and of a dive.
WINDOW, SURGE, DIVE = 3, 600, 0
#: A surge is this share of the greatest sum, where that is less than ``SURGE``.
SURGE_SHARE = 0.25
#: How often the lines of a marked article count.
MARK_WEIGHT = 4
#: Named elements around an article, one in the other, that are looked into.
WRAPPERS = 8

# Element names of HTML by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select menu dialog svg canvas object audio video map datalist fieldset head".split())
FURNITURE = frozenset("nav header footer aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices notification popup modal overlay newsletter subscribe subscription paywall social share sharing sidebar rail menu navbar nav"
    " navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead comment comments commentlist disqus respond related"
    " recommended recommendations widget widgets login signup search skip tagcloud".split()
)
#: What a compound name may hold besides listed names.
PLAIN_PARTS = frozenset("area bar block body box btn button buttons card container content form group holder inner item items js links list module outer page panel popup posts section site slot top bottom left right unit widget wrap wrapper".split())
PAGE_HEADERS = frozenset("header site-header page-header siteheader pageheader site_header page_header top-header topbar top-bar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond related recommended recommendations".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")).lower())
    return found


def _named(token: str) -> set[str]:
    """The listed names that a class or id is made of; none if it has any other part."""
    if token in NAMES:
        return {token}
    parts = [p for p in re.split(r"[-_]+", token) if p and not p[0].isdigit()]
    names = NAMES.intersection(parts)
    return names if all(p in names or p in PLAIN_PARTS for p in parts) else set()


def _boilerplate(name: str, attributes: dict[str, str], inside: bool) -> str:
    """Why an element and all it contains are stripped: its ``element``, a ``name``, an ``aside`` matter, or nothing.

    ``inside``: within a marked article. Forms go with names; adverts, comments and hidden elements are aside matters.
    """
    if name in ("form", "fieldset"):
        return "name"
    if name in DROPPED or name == "header" and not inside:
        return "element"
    if not attributes or name in ("html", "body", "main"):
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "aside"
    tokens = (attributes.get("class", "") + " " + attributes.get("id", "")).split()
    names = set().union(*map(_named, tokens))
    if not names.isdisjoint(COMMENTS | ADVERTS):
        return "aside"
    headers = not inside and any(t in PAGE_HEADERS for t in tokens)
    return "name" if names or headers or attributes.get("role") in ROLES else ""


def lines_of(page: str) -> list[tuple[str, int]]:
    """Stripped lines: text, and weighted length. What was stripped, and the ends of marked articles, are empty lines."""
    entered: set[int] = set()
    for _ in range(WRAPPERS):
        out, regions, kept, marked = _lines(page, entered.__contains__)
        total = kept + sum(size for _, size, _, _ in regions)
        new = {at for at, size, why, inside in regions if size and (size == total if why == "aside" else 2 * size > total and (inside or not marked))}
        if not new:
            return out
        entered |= new
    return _lines(page, lambda at: True)[0]


def _lines(page: str, entered: Callable[[int], bool]) -> tuple[list[tuple[str, int]], list[tuple[int, int, str, bool]], int, int]:
    """One pass over the tags; ``entered`` tells which places of named elements are not stripped.

    Returns the lines, the elements stripped by name (place, code points outside links, why, in a marked article), and the
    code points outside links of all lines and of those in marked articles.
    """
    out: list[tuple[str, int]] = []
    regions: list[tuple[int, int, str, bool]] = []
    kept, marked, held = 0, 0, 0
    parts: list[str] = []
    own = 0
    at, links, inside = 0, 0, 0
    skip, depth, skip_comments, region = "", 0, False, (0, "", False)

    def end_line() -> None:
        nonlocal own, kept, marked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, MARK_WEIGHT * len(text) if inside else own))
            kept += own
            marked += own if inside else 0
        parts.clear()
        own = 0

    def gap(lines: int) -> None:
        """End the line, and make sure that so many empty lines stand behind it."""
        end_line()
        have = 0
        while have < lines and have < len(out) and not out[-1 - have][0]:
            have += 1
        out.extend([("", 0)] * (lines - have))

    def text(piece: str) -> None:
        nonlocal own, held
        if piece and skip:
            held += 0 if links else len(" ".join(piece.split()))
        elif piece:
            parts.append(piece)
            if not links:
                own += len(" ".join(piece.split()))

    marks: list[str] = []
    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0][1:2].isalpha() or m[0][1:2] == "/":  # a tag with an unclosed quote
                end_line() if not skip else None
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if skip:
            if name == "a":
                links = 0 if closing else 1
            if closing and name == skip:
                depth -= 1
            elif not closing and name == skip and name not in ("p", "li"):
                depth += name not in VOID
            elif skip == "p" and name in BLOCKS or skip == "li" and (name == "li" or closing and name in ("ul", "ol")):
                depth = 0  # its end tag was left out
            elif not closing and name in ("article", "main") and not skip_comments:
                depth = 0  # an unclosed menu or header before the article
            if depth:
                continue
            closed_here = closing and name == skip
            skip, links = "", 0
            if region[1] != "element":
                regions.append((region[0], held, *region[1:]))
            if closed_here:
                continue
        if not closing and name not in VOID:
            attributes = _attributes(m[3]) if m[3].strip() else {}
            why = _boilerplate(name, attributes, inside > 0)
            if why == "element" or why and not entered(m.start()):
                gap(WINDOW if name in FURNITURE and not inside else 1)
                if not m[3].endswith("/"):
                    skip, depth, held, region = name, 1, 0, (m.start(), why, inside > 0)
                    names = set(re.split(r"[-_\s]+", attributes.get("class", "") + " " + attributes.get("id", "")))
                    skip_comments = name == "aside" or not COMMENTS.isdisjoint(names)
                continue
            if name in ("article", "main") or attributes.get("role") == "main":
                gap(0 if inside else WINDOW)
                marks.append(name)
                inside += 1
                links = 0
                continue
        if name == "br":
            text(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name in BLOCKS:
            end_line()
            links = 0
        if closing and marks and name == marks[-1] and name in ("article", "main"):
            marks.pop()
            inside -= 1
            gap(0 if inside else WINDOW)
    text(page[at:])
    if skip and region[1] != "element":
        regions.append((region[0], held, *region[1:]))
    end_line()
    return out, regions, kept, marked


def between_dives(sizes: list[int]) -> list[tuple[int, int]]:
    """The runs of lines, first and behind the last, that hold a surge and end at dives."""
    n = len(sizes)
    sums = [0, *accumulate(sizes)]
    ahead = [sums[min(i + WINDOW, n)] - sums[i] for i in range(n)]
    peak = max(ahead, default=0)
    if not peak:
        return []
    surge, runs, i, low = min(SURGE, SURGE_SHARE * peak), [], 0, 0
    while i < n:
        if ahead[i] < surge or ahead[i] <= DIVE:
            i += 1
            continue
        first = end = next(j for j in range(i, n) if sizes[j])
        while first > low and sums[first] - sums[max(first - WINDOW, low)] > DIVE:
            first -= 1
        while end < n and ahead[end] > DIVE:
            end += 1
        i = low = max(end, i + 1)
        while not sizes[first]:
            first += 1
        while not sizes[end - 1]:
            end -= 1
        runs.append((first, end))
    return runs


def main_text(page: str | None) -> str:
    """The text of a page's article, blocks joined by \\n."""
    lines = lines_of(page) if page else []
    runs = between_dives([n for _, n in lines])
    return "\n".join(t for first, end in runs for t, _ in lines[first:end] if t)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars), one for each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(p) for p in common.decoded(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    read = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html"))
    kinds = [f.dataType.simpleString() for f in read.schema]
    return read.mapInArrow(scan, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})
