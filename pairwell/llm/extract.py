"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. What is never article (scripts, menus,
page headers, footers, sidebars, adverts, notices, forms, reader comments) leaves ``WINDOW``
empty lines in its place, so it shows as a gap. The lengths of the texts outside links are
summed over windows of ``WINDOW`` lines: a surge begins where a sum rises above the threshold,
and the dive is where the sums are back at zero. The text between surge and dive is kept.
A marked article is set off by empty lines; if it has a surge, all of its text is kept. Otherwise the lines of the same parent as a surge's
long lines are kept as well, before and after a gap: it ends nothing inside the parent.
Only on a page without any surge is the marked article all that counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
#: Characters outside links that a window needs to begin a surge.
SURGE = 86
#: Weight of a marked article's text against that of an element whose name calls it furniture.
ARTICLE = 4

#: Elements by their role in HTML.
RAW = "script style noscript template iframe object svg canvas audio video title textarea xmp".split()
NEVER = frozenset(
    "head nav aside footer form button select option fieldset dialog menu input "
    "script style noscript template iframe object svg canvas audio video title textarea xmp".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same group.
SIBLINGS = {name: frozenset(group) for group in (["p"], ["li"], ["dt", "dd"], ["tr"], ["td", "th"], ["option"]) for name in group}
CONTAINERS = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words in a class or id that tell page furniture.
FURNITURE = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert menu nav navbar navigation breadcrumb breadcrumbs sidebar comment comments reply replies "
    "disqus discussion related recommended share sharing social footer masthead newsletter subscribe subscription signup "
    "login popup modal overlay widget pagination pager toolbar".split()
)

#: Of these, words that name parts of articles as well: inside a marked article, the text decides.
AMBIGUOUS = frozenset("discussion related recommended notice notification alert banner promotion widget overlay".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\b[^<>]*+>?|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
#: A tag after a quote that never closes.
LOOSE_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-z][^\s/<>]*+)(?P<attributes>[^<>]*+)>", re.I)
#: Elements nested deeper are read as if they were not nested, as browsers do.
DEPTH = 512
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
#: Blocks that are parts of a text; what holds them is the home of their lines.
PARTS = frozenset("blockquote center dd details dl dt figure li ol p pre table tbody tfoot thead tr ul".split()) | HEADINGS
PARAGRAPH_ENDERS = BLOCKS - {"tbody", "td", "tfoot", "th", "thead", "tr", "caption"}


NEVER_TEXT, NAMED, HINTED = 1, 2, 3


def furniture_kind(name: str, attributes: str, in_article: bool) -> int:
    """``NEVER_TEXT`` by the element's role, ``NAMED`` by a word in its class or id alone, else 0.

    ``HINTED``: the words are ``AMBIGUOUS``, and the element lies in a marked article.
    """
    if name in NEVER or (name == "header" and not in_article):
        return NEVER_TEXT
    if name in CONTAINERS or name in HEADINGS or not attributes:
        return 0
    kind = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return NEVER_TEXT
        if key in ("class", "id") and (words := {part.lower() for part in NAME_PART.findall(value)} & FURNITURE):
            kind = HINTED if in_article and words <= AMBIGUOUS and kind != NAMED else NAMED
    return kind


def tags(page: str) -> Iterator[re.Match]:
    """Tags, comments and elements without text, in order. One pass, also over pages whose quotes never close."""
    at, pattern = page.find("<"), TAG
    while at >= 0:
        tag = pattern.match(page, at)
        if tag is None and pattern is TAG and page[at + 1 : at + 2].isalpha():
            pattern = LOOSE_TAG
            tag = pattern.match(page, at)
        if tag:
            yield tag
        at = page.find("<", tag.end() if tag else at + 1)


class Line(NamedTuple):
    """A line: its text, the characters outside links, and the elements around it by number (0: none).

    ``article``: the outermost marked article. ``block`` holds the line, ``home`` holds the block, ``outer`` the home.
    ``named``: open elements that a class or id calls furniture. ``text`` is empty where a gap may be;
    ``gap`` is the element whose leaving out makes it one, 0 if it always is, and ``outer`` is what it lies in.
    """

    text: str
    n: int
    article: int = 0
    block: int = 0
    home: int = 0
    named: tuple[int, ...] = ()
    gap: int = 0
    outer: int = 0


class Lines:
    """Lines of a page and its open elements."""

    def __init__(self) -> None:
        self.rows: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[str] = []
        self.numbers: list[int] = []
        self.article = 0  # the outermost marked article that is open
        self.named: list[int] = []  # depths of open elements that a class or id calls furniture
        self.opened = 0
        self.hinted: set[int] = set()  # numbers of named elements whose words are ambiguous
        self.marked: dict[int, str] = {}
        self.around: dict[int, tuple[int, ...]] = {}  # named elements around a marked article

    def add(self, text: str, in_link: bool) -> None:
        self.parts.append(text)
        if in_link:
            self.linked += len(text.strip())

    def open(self, name: str) -> None:
        self.opened += 1
        self.stack.append(name)
        self.numbers.append(self.opened)

    def cut(self, depth: int) -> None:
        """End the elements from ``depth`` on."""
        if self.article in self.numbers[depth:]:
            self.article = 0
            self.gap()
        del self.stack[depth:]
        if self.named and self.named[-1] >= depth:
            while self.named and self.named[-1] >= depth:
                number = self.numbers[self.named.pop()]
            self.rows.append(Line("", 0, named=self.open_named(), gap=number, outer=self.holder()))
        del self.numbers[depth:]

    def holder(self) -> int:
        """The innermost open element, 0 if that is the page itself."""
        return self.numbers[len(self.stack) - 1] if self.stack and self.stack[-1] not in ("html", "body") else 0

    def open_named(self) -> tuple[int, ...]:
        return tuple(self.numbers[k] for k in self.named)

    def close(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                blocks = [(x, i) for x, i in zip(self.stack, self.numbers) if x in BLOCKS]
                block = blocks[-1][1] if blocks else 0
                homes = [i for x, i in blocks[:-1] if x not in PARTS and x != "body" and x != "html"] if len(blocks) > 1 else []
                home = next((i for x, i in reversed(blocks[:-1]) if x not in PARTS), 0)
                # Only paragraphs and headings go on after a gap: bare lines beside an article are rarely part of it.
                outer = homes[-2] if len(homes) > 1 and homes[-1] == home and blocks[-1][0] in PARTS else 0
                n = max(len(text) - self.linked, 0)
                self.rows.append(Line(text, n, self.article, block, home, self.open_named(), 0, outer))
            self.parts, self.linked = [], 0

    def gap(self, parts: bool = False) -> None:
        """Empty lines; with ``parts`` they only part what the innermost open element holds."""
        self.rows.extend([Line("", 0, named=self.open_named(), outer=self.holder() if parts else 0)] * WINDOW)

    def left(self) -> list[Line]:
        """Lines without those of named furniture, which leave a gap.

        An element that holds more than half of the page's text outside links, or the page's only main
        element (or its only article, if there is no main), is no furniture whatever its name. Text of a
        marked article outside all such elements counts ``ARTICLE`` times. Where the words of a name are
        ambiguous, a surge of text that is mostly no links makes the element a part of its article.
        """
        if not any(line.named or line.gap for line in self.rows):
            return self.rows
        held: dict[int, int] = {}
        shown: dict[int, int] = {}
        for line in self.rows:
            for number in line.named:
                held[number] = held.get(number, 0) + line.n
                shown[number] = shown.get(number, 0) + len(line.text)
        article_text = {x for x in self.hinted if held.get(x, 0) > SURGE and 2 * held[x] > shown[x]}
        half = sum(line.n * (ARTICLE if line.article and not line.named else 1) for line in self.rows) / 2
        main = [number for number, name in self.marked.items() if name == "main"] or list(self.marked)
        article = set(self.around[main[0]]) if len(main) == 1 else set()
        out: list[Line] = []
        stays = lambda number: number in article or number in article_text or held.get(number, 0) > half
        for line in self.rows:
            if all(map(stays, line.named)):
                if line.text or not line.gap:
                    out.append(line)
                elif not stays(line.gap):
                    out.extend([line] * WINDOW)
        return out


def lines_of(page: str, furniture: bool = True) -> list[Line]:
    """Lines in page order; ``furniture=False`` leaves out only what never holds text."""
    lines = Lines()
    stack = lines.stack
    left_out: int | None = None  # depth at which an element that is left out was opened
    links = articles = 0
    at = 0
    for tag in tags(page):
        if left_out is None and tag.start() > at:
            lines.add(page[at : tag.start()], links > 0)
        at = tag.end()
        name = (tag.groupdict()["name"] or "").lower()
        if not name:
            continue  # a comment, a declaration, or an element whose content is no text
        if tag["end"]:
            if name not in stack:
                if name in BLOCKS and left_out is None:
                    lines.close()
                continue
            closed = True
        else:
            closed = False
            group = SIBLINGS.get(name)
            if group is None and name in PARAGRAPH_ENDERS:
                group = SIBLINGS["p"]
            # An open paragraph or list item ends where the next block of its kind begins.
            if group and stack:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth] in group:
                        if left_out is None or depth > left_out:
                            links -= stack[depth:].count("a") if left_out is None else 0
                            if left_out is None:
                                lines.close()
                            lines.cut(depth)
                        break
                    if stack[depth] in BLOCKS:
                        break
        if closed:
            depth = len(stack) - 1 - stack[::-1].index(name)
            if left_out is None:
                if any(x in BLOCKS for x in stack[depth:]) or lines.named and lines.named[-1] >= depth:
                    lines.close()
                links -= stack[depth:].count("a")
                articles -= sum(x in ("article", "main") for x in stack[depth:])
            outer = stack[depth:left_out] if left_out is not None else []
            lines.cut(depth)
            if left_out is not None and depth <= left_out:
                links -= outer.count("a")
                articles -= sum(x in ("article", "main") for x in outer)
                left_out = None
                lines.gap(name not in ("nav", "header", "footer"))
            continue
        if left_out is None:
            if name in BLOCKS:
                lines.close()
            elif name in ("br", "img"):
                lines.add(" ", False)
        if name in VOID or tag["attributes"].endswith("/") and name not in BLOCKS or len(stack) >= DEPTH:
            continue
        lines.open(name)
        if left_out is not None:
            continue
        if furniture:
            kind = furniture_kind(name, tag["attributes"], articles > 0)
        else:
            kind = NEVER_TEXT if name in ("head", *RAW) else 0
        if kind == NEVER_TEXT:
            lines.close()
            left_out = len(stack) - 1
        else:
            if kind in (NAMED, HINTED):
                lines.close()
                lines.named.append(len(stack) - 1)
                if kind == HINTED:
                    lines.hinted.add(lines.opened)
            if name in ("article", "main"):
                if not lines.article:
                    lines.gap()
                    lines.article = lines.opened
                lines.marked[lines.opened] = name
                lines.around[lines.opened] = lines.open_named()
            links += name == "a"
            articles += name in ("article", "main")
    if left_out is None and at < len(page):
        lines.add(page[at:], links > 0)
    lines.close()
    return lines.left()


def between(rows: list[Line]) -> list[str]:
    """Texts between surge and dive, and what else the element or the marked article that holds a surge has."""
    lengths = [line.n for line in rows]
    sums = [sum(lengths[k : k + WINDOW]) for k in range(len(lengths))]
    threshold = min(SURGE, max(max(sums, default=0) - 1, 0))
    if threshold < SURGE and any(line.article for line in rows):
        # No surge on the page: a marked article decides.
        lengths, threshold = [len(line.text) if line.article else 0 for line in rows], 0
        sums = [sum(lengths[k : k + WINDOW]) for k in range(len(lengths))]
    kept: set[int] = set()
    articles: set[int] = set()
    homes: set[int] = set()
    k = 0
    while k < len(sums):
        if sums[k] <= threshold:
            k += 1
            continue
        # The window looks ahead: the surge begins at its first line that has text.
        start = k
        while lengths[start] == 0:
            start += 1
        dive = start
        while dive < len(sums) and sums[dive] > 0:
            dive += 1
        kept.update(range(start, dive))
        # The longest line of a surge, and others that would be one alone, say where it is.
        longest = max(range(start, dive), key=lengths.__getitem__)
        for j in range(start, dive):
            if j == longest or lengths[j] > SURGE:
                articles.add(rows[j].article)
                homes.add(rows[j].home)
        k = dive
    articles.discard(0)
    homes.discard(0)
    # What is left out of an element parts its blocks only: the element goes on after the gap.
    parted = {line.outer for line in rows if not line.text} & {rows[k].outer for k in kept if rows[k].home in homes}
    parted.discard(0)
    return [
        line.text
        for k, line in enumerate(rows)
        if line.text
        and (k in kept or line.article in articles or line.home in homes or line.block in homes or line.outer in parted)
    ]


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by a line feed; empty if there is none."""
    if not page:
        return ""
    found = between(lines_of(page))
    if not found:
        # An element that is left out and never closed may have taken the article along.
        found = between(lines_of(page, furniture=False))
    return "\n".join(found)


def extracted(pages: DataFrame, *, page: str = "html", text: str = "main_text") -> DataFrame:
    """All columns of ``pages`` and the page's main text.

    - Null and empty pages, and pages without text, give an empty text. Pages are read whole.
    - Character references are decoded, white space inside a block is one space, blocks are
      trimmed and joined by a line feed in page order.
    - Rows are handled one by one: ties, repeated rows and null ids change nothing. An empty
      table gives an empty table. A column called ``text`` is replaced.
    """

    @F.arrow_udf(T.StringType())
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(value.as_py()) for value in batch], pa.string())

    return pages.withColumn(text, extract(F.col(page)))
