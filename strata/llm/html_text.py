"""Main text of web pages by line-block distribution.

A page is stripped of markup into lines, one for each block element.  Elements
that are not prose by their kind (menus, headers, footers, asides, forms,
scripts, styles, blocks whose class or id names an advert, notice, sidebar or
comment list) leave a barrier instead of a line.  Text lengths, link text left
out, are summed over a sliding window of lines that ends at a barrier.  A surge
is where the sum reaches SURGE; headings right before it go with it.  A dive is
where it falls to nothing, or a full window under DIVE.  What lies between them
is main text, also across a barrier: a short run behind one goes on if the run
before it had not dived.  Where the page marks its article, windows count inside it
only, any prose is a surge and only its absence (a list of links) a dive, as its
short paragraphs are text; it is one text, from its heading or first surge to its
last dive, barriers excepted.  Without any surge: the article, or the longest run.

End tags that HTML lets authors leave out are implied: a paragraph ends where a block
begins, a list item or cell where the next one does, and whatever is open ends with
its parent; so does an element that is not prose.  A tag that never closes is text, an
open comment goes on to the end; both are found in one pass.

Null or empty html, or a page without prose: empty text.  Character references
are decoded, white space inside a block becomes one space, blocks are joined in
page order by a line feed; nothing else is dropped.  Repeated rows give equal
rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: a window of lines must hold so many characters to surge
SURGE = 80
#: a full window of fewer characters is a dive
DIVE = 40

# fixed values: names of HTML elements
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select fieldset".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: what an open element ends before, without an end tag
IMPLIED = {"p": BLOCKS - frozenset(("p", "body", "html", "head", "center", "summary")) | frozenset(("p", "menu", "nav", "aside")), "li": frozenset(("li",)),
           "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
           "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot"))}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|notice|sidebar|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|comments?|disqus|respond|share|sharing|social|related|newsletter|subscribe|popup|modal|login|search|complementary|contentinfo)(?:$|[\s_-])", re.I)
_ARTICLE = frozenset(("article", "main"))


class Line(NamedTuple):
    """Text of a block, whether it is in an article, its characters outside links, and whether it is a heading."""

    text: str
    article: bool
    prose: int
    heading: bool


class Open:
    """Elements that are open, blocks and those of other kinds that are pushed."""

    def __init__(self):
        self.names: list[str] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def pop(self) -> str:
        name = self.names.pop()
        self.count[name] -= 1
        return name

    def before(self, name: str) -> None:
        """End what the start of an element implies the end of."""
        while self.names and name in IMPLIED.get(self.names[-1], ()):
            self.pop()

    def end(self, name: str) -> None:
        """End an element, and what is open in it."""
        while self.pop() != name:
            pass


def lines(page: str) -> Iterator[Line | None]:
    """The blocks with text; None for a barrier."""
    parts: list[str] = []
    linked: list[str] = []
    around, skipped, article = Open(), Open(), 0
    link = heading = False

    def block():
        text, inside = (" ".join(html.unescape("".join(x)).split()) for x in (parts, linked))
        parts.clear()
        linked.clear()
        return Line(text, article > 0, max(0, len(text) - len(inside)), heading) if text else None

    at, size = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    while at < size:
        tag = _TAG.search(page, at, last) if at < last else None
        stop = tag.start() if tag else size if (comment := page.find("<!--", at)) < 0 else comment
        if not skipped.names and stop > at:
            parts.append(page[at:stop])
            if link:
                linked.append(page[at:stop])
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:  # a comment or declaration
            if tag[0].startswith("<!--") and not tag[0].endswith("-->"):
                break
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        void = name in VOID or tag[3].endswith("/")
        if not closing and name in RAW and not tag[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if skipped.names:
            if not closing:
                skipped.before(name)
                if name in _ARTICLE:  # an element left open ends where the article begins
                    skipped = Open()
                elif skipped.names:
                    if not void and (name in BLOCKS or name in BOILERPLATE or name == skipped.names[0]):
                        skipped.push(name)
                    continue
            elif skipped.count[name]:
                skipped.end(name)
                continue
            elif around.count[name]:  # its parent ends
                skipped = Open()
            else:
                continue
        if not closing:
            around.before(name)
        if not closing and not void and (
                name in BOILERPLATE or name == "header" and not article
                or name not in _ARTICLE and name not in ("body", "html") and any(_UNWANTED.search(x.strip("\"'")) for x in _NAMED.findall(tag[3]))):
            if line := block():
                yield line
            yield None
            skipped.push(name)
            continue
        if name in BLOCKS:
            if closing and around.count[name]:
                around.end(name)
            elif not closing and not void:
                around.push(name)
            if line := block():
                yield line
            if name in _ARTICLE:
                article = max(0, article + (-1 if closing else 1))
            link, heading = False, not closing and name in HEADINGS
        elif name == "a":
            link = not closing
        elif name == "br":
            parts.append(" ")
            linked.append(" ")
    if line := block():
        yield line


def runs_of_text(run: list[Line], text: bool, surge: int, dive: int) -> tuple[list[bool], bool]:
    """Whether each line of a run between barriers is main text, and whether the last one is; text: whether the line before the run was."""
    size = [x.prose for x in run]
    taken = [False] * len(run)
    for i in range(len(run)):
        total = sum(size[i: i + WINDOW])
        if text and (not total or total < dive and i + WINDOW <= len(run)):
            text = False
        if not text and total >= surge and size[i]:  # lines of links alone do not begin it
            text = True
            back = i
            while back and run[back - 1].heading:
                back -= 1
                taken[back] = True
        taken[i] = text
    return taken, text


def main_lines(found: list[Line | None]) -> list[str]:
    """The lines between surges and dives."""
    marked = any(x and x.article for x in found)
    if marked:
        found = [x if x is None or x.article else None for x in found]
    runs: list[list[Line]] = [[]]
    for x in found:
        if x is None:
            runs.append([])
        else:
            runs[-1].append(x)
    every: list[Line] = []
    taken: list[bool] = []
    text = False
    for run in (r for r in runs if r):
        own, after = runs_of_text(run, text, *((1, 1) if marked else (SURGE, DIVE)))
        if own[0] and not text:  # headings before a barrier belong to what follows it
            for i in range(len(every) - 1, -1, -1):
                if not every[i].heading:
                    break
                taken[i] = True
        every, taken, text = every + run, taken + own, after
    if not any(taken):  # no surge anywhere: the article, or the longest run
        return [x.text for x in (every if marked else max(runs, key=lambda r: sum(len(x.text) for x in r)))]
    if marked:  # an article is one text: from its heading or first surge to its last dive
        inside = [i for i, x in enumerate(taken) if x or every[i].heading and not any(taken[:i])]
        return [x.text for x in every[inside[0]: inside[-1] + 1]]
    return [x.text for x, t in zip(every, taken, strict=True) if t]


def main_text(page: str | None) -> str:
    return "\n".join(main_lines(list(lines(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(x) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})

    kind = dict(pages.dtypes)["page_id"]
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
