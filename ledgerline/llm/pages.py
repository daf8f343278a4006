"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

Pages are sorted by host, path and query. A page's text lines are aligned with those of its neighbours by longest common
subsequence. Lines that both neighbours share are template, not text; so are those that the nearer one shares, unless it may
be a copy. A neighbour that shares nearly all text is a copy, which says nothing about templates. Of explicit article
elements those with lines of the page's own are its text, so that teasers that stand on every page go. They are then kept
whole and alone, since articles of one host may well share lines. Containers whose element,
role or name says what they are (menus, adverts, forms, comments) fall as well, but of those with a name that may stand for
text too, none that holds most of the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
ARTICLE = frozenset(["article", "main"])
SKIPPED = frozenset("nav footer aside form button dialog menu fieldset datalist select svg math object canvas video audio title".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SKIPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu sidebar "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent popup modal overlay "
    "newsletter subscribe signup login comment comments disqus respond replies "
    "toolbar pagination pager".split()
)
#: Names that may also stand for text, such as legal-analysis.
UNSURE_NAMES = frozenset("header notice notices alert share sharing social related recommended widget copyright legal skip".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_PART = re.compile(r"[a-z]+")
COPY_SHARE = 0.9  # of the longer text, which only copies share
ALONE_SHARE = 0.5  # of the longer text; a single neighbour that shares more may be a copy


@dataclass
class Line:
    text: str
    inside: int  # number of the outermost article element, or 0
    skipped: bool  # of a container that is no text
    unsure: int  # number of the container with an unsure name, or 0


def _kind(name: str, attributes: str, in_article: bool) -> str:
    """What a container holds: ``article``, ``skip`` or nothing special."""
    if name in SKIPPED or (name == "header" and not in_article):
        return "skip"
    if attributes:
        lowered = attributes.lower()
        if "=" in lowered:
            values = {m[0]: m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(lowered)}
            if values.get("role") in SKIPPED_ROLES or values.get("aria-hidden") == "true":
                return "skip"
            named = NAME_PART.findall(f"{values.get('class', '')} {values.get('id', '')}")
            if name not in ARTICLE and name not in HEADINGS and name != "body" and name != "html":
                if not SKIPPED_NAMES.isdisjoint(named):
                    return "skip"
                if not UNSURE_NAMES.isdisjoint(named):
                    return "unsure"
            if values.get("role") == "main":
                return "article"
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", lowered):
            return "skip"
    return "article" if name in ARTICLE else ""


def page_lines(page: str | None) -> list[Line]:
    """The blocks of a page in order, character references decoded and white space turned into single spaces."""
    lines: list[Line] = []
    if not page:
        return lines
    stack: list[tuple[str, str]] = []
    counts = {"article": 0, "skip": 0, "unsure": 0, "": 0}
    at = container = article = 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(Line(text, article if counts["article"] else 0, counts["skip"] > 0, container if counts["unsure"] else 0))

    def push(name: str, kind: str) -> None:
        nonlocal container, article
        container += kind == "unsure" and not counts["unsure"]
        article += kind == "article" and not counts["article"]
        counts[kind] += 1
        stack.append((name, kind))

    def pop_to(place: int) -> None:
        while len(stack) > place:
            counts[stack.pop()[1]] -= 1

    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        attributes, inline = m["attributes"], name in INLINE
        if not inline:
            flush()
        if m["close"]:
            pop_to(next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), len(stack)))
        elif name in VOID or attributes.endswith("/"):
            continue
        else:
            if not inline:  # a block ends an open paragraph, and what stands open in that
                block = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), -1)
                if block >= 0 and stack[block][0] == "p":
                    pop_to(block)
            kind = _kind(name, attributes, counts["article"] > 0)
            if kind or not inline:
                flush()
                push(name, kind)
    parts.append(page[at:])
    flush()
    return sure_lines(lines)


def sure_lines(lines: list[Line]) -> list[Line]:
    """``lines`` with those skipped that stand in a container of unsure name, unless it holds most of the page's text."""
    size = sum(len(x.text) for x in lines if not x.skipped)
    held: dict[int, int] = defaultdict(int)
    for x in lines:
        if x.unsure and not x.skipped:
            held[x.unsure] += len(x.text)
    for x in lines:
        x.skipped = x.skipped or (x.unsure > 0 and 2 * held[x.unsure] <= size)
    return lines


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Positions in ``mine`` of a longest common subsequence with ``other``."""
    n, m, head = len(mine), len(other), 0
    while head < min(n, m) and mine[head] == other[head]:
        head += 1
    while n > head and m > head and mine[n - 1] == other[m - 1]:
        n, m = n - 1, m - 1
    found = {*range(head), *range(n, len(mine))}
    places: dict[str, list[int]] = defaultdict(list)
    for j in range(m - 1, head - 1, -1):
        places[other[j]].append(j)
    ends: list[int] = []  # the smallest last place of a subsequence of each length
    chains: list[tuple[int, tuple | None]] = []
    for i in range(head, n):
        for j in places.get(mine[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def template_lines(lines: list[Line], neighbours: list[list[Line]]) -> set[int]:
    """Positions of the lines that the neighbours, the nearest first, show to be template."""
    kept = [k for k, line in enumerate(lines) if not line.skipped]
    evidence = []
    for other in neighbours:
        shared = shared_lines([x.text for x in lines], [x.text for x in other])
        longer = max(sum(len(x.text) for x in page if not x.skipped) for page in (lines, other))
        share = sum(len(lines[k].text) for k in kept if k in shared) / max(longer, 1)
        if share < COPY_SHARE:
            evidence.append((shared, share))
    template = evidence[0][0] & evidence[1][0] if len(evidence) == 2 else set()
    if evidence and evidence[0][1] < ALONE_SHARE:
        template |= evidence[0][0]
    return template


def main_text(lines: list[Line], neighbours: list[list[Line]]) -> str:
    """The page's text, its nearest neighbour first.

    Differencing finds the page's own lines. Article elements that hold some of them are the text, whole and alone. Where
    none does the own lines are, and where there are no own lines either, all article elements.
    """
    kept = [k for k, line in enumerate(lines) if not line.skipped]
    template = template_lines(lines, neighbours)
    own = [k for k in kept if k not in template]
    articles = {lines[k].inside for k in own or kept if lines[k].inside}
    return "\n\n".join(lines[k].text for k in (kept if articles else own) if not articles or lines[k].inside in articles)


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by host and path; each page waits for the one after it, and knows the last one of another path before it."""
    before = current = None

    def result(page, previous, following) -> tuple:
        near = [x for x in (previous, following) if x is not None and x[1] == page[1] and x[2] != page[2]]
        near.sort(key=lambda x: -_common_prefix(x[2], page[2]))
        text = main_text(page[4], [x[4] for x in near])
        return page[0], page[3], text, len(text)

    for batch in batches:
        rows = []
        for page_id, host, path, url, source in zip(batch["page_id"], batch["host"], batch["path"], batch["url"], batch["html"]):
            page = (page_id, host, path, url, page_lines(source))
            if current is not None:
                rows.append(result(current, before, page))
                if current[1:3] != page[1:3]:
                    before = current
            current = page
        yield pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"])
    if current is not None:
        yield pd.DataFrame([result(current, before, None)], columns=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars, the text's code points.

    Blocks are joined by an empty line. The neighbours are the last page before and the page after in the order of host, path
    and query, the one that shares more of these first, the one before on a tie. A page of the same path and query is a
    version of this one and no neighbour; at an edge of a sorted partition only the one inside counts. A hot host is cut by
    path, so no task gets a whole host; every task keeps three pages at a time.

    Defined cases: a null, empty or unparsable html gives an empty text; a null url is a host of its own with an empty
    path; null or repeated page_ids stay as rows of their own; other columns are ignored; no rows give no rows.
    """
    address = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(address, "^//([^/?#]*)", 1))
    path = F.regexp_extract(address, "^(?://[^/?#]*)?([^#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "url", "html")
    return (
        rows.repartitionByRange("host", "path", "page_id")
        .sortWithinPartitions("host", "path", "page_id")
        .mapInPandas(_difference, "page_id long, url string, text string, n_chars long")
    )
