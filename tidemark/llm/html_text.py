"""Visible text of web pages, laid out as a reader sees it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_rows

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style template noscript noframes iframe object audio video canvas svg math datalist select textarea".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
LINES = frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main "
    "menu nav optgroup option search section summary caption".split()
)
ENDS_P = (PARAGRAPHS | LINES) - {"p", "body", "html", "caption"} | {"p"}
#: What an opening tag closes before it, and the elements beyond which it closes nothing.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head", "title"}, {"html"}),
}
BARRIERS = frozenset("td th table caption html body button".split())
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element with its children, which are nodes and texts."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def seen(self) -> bool:
        """Whether the element is displayed."""
        return not (
            self.tag in UNSEEN
            or "hidden" in self.attrs
            or (self.tag == "dialog" and "open" not in self.attrs)
            or _HIDDEN.search(self.attrs.get("style") or "")
        )


class Builder(HTMLParser):
    """Tree of a page; tags that HTML lets authors leave out are put in, stray ones passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.counts: dict[str, int] = {}

    def _push(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.open.append(node)
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.counts[self.open.pop().tag] -= 1

    def _close(self, tags: set[str], until: frozenset[str] | set[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``until`` encloses."""
        if not any(self.counts.get(t) for t in tags):
            return
        depth = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                break
            if self.open[i].tag in tags:
                depth = i
        if depth is not None:
            self._cut(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in ENDS_P:
            self._close({"p"}, BARRIERS)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self.counts.get("table") and self._nearest({"tr", "table"}) == "table":
            self._push("tr", {})
        if self.open[-1].tag == "head" and tag not in UNSEEN and tag not in VOID:
            self._cut(len(self.open) - 1)
        if tag in VOID:
            self.open[-1].children.append(Node(tag, dict(attrs)))
        else:
            self._push(tag, dict(attrs))

    def _nearest(self, tags: set[str]) -> str | None:
        return next((n.tag for n in reversed(self.open) if n.tag in tags), None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.counts.get(tag):
            if tag == "br":
                self.open[-1].children.append(Node("br", {}))
            return
        if tag == "table":
            until = frozenset({"html"})
        else:
            until = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else BARRIERS - {tag}
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if self.open[i].tag in until:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


class Frame:
    """Lines being written: of the page, a table cell, or a list item."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0  # lines to leave free before the next text

    def text(self, data: str, exact: bool) -> None:
        if exact:
            first, *rest = data.split("\n")
            self._put(first)
            for part in rest:
                self.end(0, keep=True)
                self._put(part)
            return
        data = _SPACE.sub(" ", data)
        if not self.line or self.line.endswith(" "):
            data = data.lstrip(" ")
        self._put(data)

    def _put(self, data: str) -> None:
        if data:
            if self.gap and self.lines and not self.line:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.line += data

    def end(self, gap: int, keep: bool = False) -> None:
        """End the line; ``gap`` free lines at least come before the next one."""
        if self.line.strip() or keep:
            self.lines.append(self.line.rstrip())
        self.line = ""
        self.gap = max(self.gap, gap) if self.lines else 0

    def add(self, lines: list[str], gap: int) -> None:
        """Whole lines as a block of their own."""
        self.end(gap)
        if lines:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.extend(lines)
            self.gap = gap

    def done(self) -> list[str]:
        self.end(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells, each some lines, with the columns brought to one width."""
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max([widths[i], *map(len, cell)])
    lines = []
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            cells = [(cell[k] if k < len(cell) else "").ljust(width) for cell, width in zip(row, widths, strict=False)]
            lines.append(" | ".join(cells).rstrip())
    return lines


def render(html: str) -> str:
    """All visible text of a page.

    Paragraph-like blocks stand apart by a free line, other blocks begin a line, spaces run together
    but in ``pre``; list items are marked and indented by their depth, cells of a table row stand
    side by side in aligned columns.  Scripts, styles, the head and what is hidden by attribute
    or style give nothing.
    """
    builder = Builder()
    builder.feed(html)
    builder.close()
    frames = [Frame()]
    lists: list[list] = []  # kind and number of each list around
    tables: list[list[list[list[str]]]] = []
    exact = 0
    todo: list[tuple[object, bool]] = [(builder.root, True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            frames[-1].text(node, bool(exact))
            continue
        tag = node.tag
        if enter:
            if not node.seen():
                continue
            todo.append((node, False))
            todo.extend((child, True) for child in reversed(node.children))
        if tag == "br":
            if enter:
                frames[-1].end(0, keep=True)
        elif tag == "pre":
            frames[-1].end(1)
            exact += 1 if enter else -1
        elif tag in ("ul", "ol", "menu"):
            if enter:
                start = node.attrs.get("start") or ""
                frames[-1].end(0 if lists else 1)
                lists.append([tag, int(start) - 1 if re.fullmatch(r"\d{1,9}", start) else 0])
            else:
                lists.pop()
                frames[-1].end(0 if lists else 1)
        elif tag == "li":
            if enter:
                frames[-1].end(0)
                frames.append(Frame())
            else:
                lines = frames.pop().done()
                kind = lists[-1] if lists else ["ul", 0]
                kind[1] += 1
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                frames[-1].add([(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)], 0)
        elif tag == "table":
            if enter:
                frames[-1].end(1)
                tables.append([])
            else:
                frames[-1].add(_aligned(tables.pop()), 1)
        elif tag == "tr" and tables:
            if enter:
                tables[-1].append([])
        elif tag in ("td", "th") and tables and tables[-1]:
            if enter:
                frames.append(Frame())
            else:
                tables[-1][-1].append(frames.pop().done())
        elif tag in PARAGRAPHS:
            frames[-1].end(1)
        elif tag in LINES:
            frames[-1].end(0)
    return "\n".join(frames[0].done())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but ``html``, and ``text``, the visible text.

    NULL pages give NULL, empty pages and such without visible text give an empty text.  Markup need
    not be well formed, and pages of any length and depth are rendered whole, each by itself.
    A column named text is replaced; tables without rows give none.
    """
    others = [c for c in pages.columns if c not in (html, "text")]
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = [None if page is None else render(page.decode("utf-8", "replace")) for page in batch[html]]
            yield {**{c: batch[c] for c in others}, "text": texts}

    schema = ", ".join([f"`{c}` {types[c]}" for c in others] + ["text string"])
    return arrow_rows(pages.select(*others, html), each, schema)
