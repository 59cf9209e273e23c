"""Pages as trees: elements found by label, path, heading or attribute, and link targets."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without an end tag, with text that is not shown, and that end a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(["script", "style"])
LINE_TAGS = frozenset(["p", "div", "li", "h1", "h2", "h3", "tr"])
#: An element of these ends an open one of its own kind.
SAME_ENDS = frozenset(["p", "li", "tr", "td", "th", "option", "dt", "dd"])
#: Elements nested deeper are read as if they were not nested.
DEPTH = 512
#: Texts of an Arrow batch that are Python strings at a time: these take many times the batch.
TEXTS_AT_A_TIME = 100

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\b[^<>]*+>?|\Z)"
    r"|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>",
    re.S | re.I,
)
ANCHOR = re.compile(r"<a(?=\s)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I)
TARGET = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^\"'])*?\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def readable(page: str) -> str:
    """The page up to a tag that never ends, which browsers drop with all that follows."""
    at = page.find("<")
    while at >= 0:
        tag = TAG.match(page, at)
        if tag is None and page[at + 1 : at + 2].isalpha():
            return page[:at]
        at = page.find("<", tag.end() if tag else at + 1)
    return page


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    first: int  # place of its first part among the page's parts
    last: int = 0
    children: list[Element] = field(default_factory=list)


class Tree(HTMLParser):
    """Elements in page order, and the parts of the page: texts, and beginnings and ends of elements."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None, 0)
        self.elements: list[Element] = []
        self.parts: list[tuple[str, str | Element, Element]] = []
        self.stack = [self.root]
        self.feed(readable(page))
        self.close()
        while len(self.stack) > 1:
            self.end()
        self.root.last = len(self.parts)

    def handle_starttag(self, tag, attrs):
        if tag in SAME_ENDS and self.stack[-1].tag == tag:
            self.end()
        element = Element(tag, {k: v or "" for k, v in attrs}, self.stack[-1], len(self.parts))
        self.elements.append(element)
        self.stack[-1].children.append(element)
        self.parts.append(("begin", element, self.stack[-1]))
        if tag in VOID or len(self.stack) >= DEPTH:
            element.last = len(self.parts)
        else:
            self.stack.append(element)

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.stack):
            while self.stack[-1].tag != tag:
                self.end()
            self.end()

    def handle_data(self, data):
        self.parts.append(("text", data, self.stack[-1]))

    def end(self) -> None:
        element = self.stack.pop()
        self.parts.append(("end", element, self.stack[-1]))
        element.last = len(self.parts)

    def text(self, element: Element) -> str:
        """Visible text; what ends a line is a line feed."""
        out = []
        for kind, part, owner in self.parts[element.first : element.last]:
            if kind == "text" and owner.tag not in HIDDEN:
                out.append(part)
            elif kind == "begin" and part.tag == "br" or kind == "end" and part.tag in LINE_TAGS:
                out.append("\n")
        return "".join(out).strip()


def plain(text: str) -> str:
    return " ".join(text.split())


@dataclass(frozen=True)
class AfterLabel:
    """The nth element of a kind that follows the first element showing just ``label``."""

    label: str
    tag: str
    nth: int = 1

    def find(self, tree: Tree) -> Iterator[Element]:
        for kind, part, owner in tree.parts:
            if kind == "text" and plain(part) and self.label.startswith(plain(part)) and plain(tree.text(owner)) == self.label:
                following = [e for e in tree.elements if e.tag == self.tag and e.first >= owner.last]
                yield from following[self.nth - 1 : self.nth]
                return


@dataclass(frozen=True)
class Path:
    """Elements below the one with an id: steps are a tag, or a tag and its number among its like."""

    id: str
    steps: Sequence[tuple[str, int | None]]

    def find(self, tree: Tree) -> Iterator[Element]:
        found = [e for e in tree.elements if e.attributes.get("id") == self.id]
        for tag, number in self.steps:
            found = [
                c
                for e in found
                for k, c in enumerate((c for c in e.children if c.tag == tag), 1)
                if number is None or k == number
            ]
        yield from found


@dataclass(frozen=True)
class UnderHeading:
    """Elements of a kind and class inside the block whose heading contains a text."""

    heading: str
    label: str
    tag: str
    class_part: str

    def find(self, tree: Tree) -> Iterator[Element]:
        for e in tree.elements:
            if e.tag == self.heading and self.label in tree.text(e) and e.parent.tag == "div":
                yield from (
                    c
                    for c in tree.elements
                    if c.tag == self.tag and e.parent.first < c.first < e.parent.last and self.class_part in c.attributes.get("class", "")
                )


@dataclass(frozen=True)
class WithAttribute:
    """Elements of a kind with an attribute of this value."""

    tag: str
    name: str
    value: str

    def find(self, tree: Tree) -> Iterator[Element]:
        yield from (e for e in tree.elements if e.tag == self.tag and e.attributes.get(self.name) == self.value)


Selector = AfterLabel | Path | UnderHeading | WithAttribute


def field_texts(page: Column, rules: Mapping[str, Sequence[Selector]]) -> Column:
    """Struct with, per field, the text of the first selector whose first element shows any; else ``""``.

    A page is parsed once for all fields.
    """
    kind = T.StructType([T.StructField(name, T.StringType()) for name in rules])

    @F.arrow_udf(kind)
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for value in batch.to_pylist():
                tree = Tree(value or "")
                rows.append({name: _first_text(tree, selectors) for name, selectors in rules.items()})
            yield pa.array(rows, pa.struct([(name, pa.string()) for name in rules]))

    return extract(page)


def _first_text(tree: Tree, selectors: Sequence[Selector]) -> str:
    for selector in selectors:
        element = next(selector.find(tree), None)
        if element is not None and (text := tree.text(element)):
            return text
    return ""


def targets(page: str, base: str | None = None) -> list[str]:
    """Targets of all anchors in page order, decoded, and resolved against ``base`` if there is one."""
    out = []
    for tag in ANCHOR.finditer(readable(page)):
        found = TARGET.match(tag[1])
        if found:
            target = html.unescape(found[1].strip("\"'")).strip()
            try:
                out.append(urljoin(base, target) if base and target else target)
            except ValueError:
                out.append(target)
    return out


def links(page: Column, base: Column | None = None) -> Column:
    """``targets`` of a column of pages; null for a null page."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, bases in batches:
            rows = zip(pages.to_pylist(), bases.to_pylist())
            yield pa.array([None if p is None else targets(p, b) for p, b in rows], pa.list_(pa.string()))

    return find(page, F.lit(None).cast("string") if base is None else base)


def element_html(page: Column, tag: str, name: str, value: str) -> Column:
    """The page's part inside the first element of a kind with an attribute, nested ones and all; null without one."""

    @F.arrow_udf(T.StringType())
    def find(batch: pa.Array) -> pa.Array:
        return pa.array([None if p is None else _inside(p, tag, name, value) for p in batch.to_pylist()], pa.string())

    return find(page)


def _inside(page: str, tag: str, name: str, value: str) -> str | None:
    begins = re.compile(rf"<(/?){re.escape(tag)}(?=[\s>/])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I)
    wanted = re.compile(rf"\s{re.escape(name)}\s*=\s*[\"']?{re.escape(value)}[\"']?(?=[\s/]|$)", re.I)
    start, depth = None, 0
    for found in begins.finditer(page):
        if start is None:
            if not found[1] and wanted.search(found[2]):
                start, depth = found.end(), 1
            continue
        depth += -1 if found[1] else 1
        if not depth:
            return page[start : found.start()]
    return None if start is None else page[start:]


def unescaped(batch: pa.Array) -> pa.Array:
    starts = range(0, max(1, len(batch)), TEXTS_AT_A_TIME)
    slices = (batch.slice(start, TEXTS_AT_A_TIME).to_pylist() for start in starts)
    return pa.concat_arrays([pa.array([html.unescape(t) if t and "&" in t else t for t in texts], pa.string()) for texts in slices])


def decoded(text: Column) -> Column:
    """Text with its character references written out."""

    @F.arrow_udf(T.StringType())
    def unescape(batch: pa.Array) -> pa.Array:
        return unescaped(batch)

    return unescape(text)
