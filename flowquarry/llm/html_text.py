"""Layout-aware HTML extraction: a tree with implied tags, visibility rules, and text as it is laid out."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from flowquarry.llm.common import small_batches

#: Fixed values of the HTML standard, by the roles they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RAW_WITH_ENTITIES = frozenset("textarea title".split())
HIDDEN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas datalist defs desc metadata annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption thead tbody tfoot tr td th ul".split()
)
#: Blocks that stand apart by an empty line.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: A start tag ends these open elements, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag does not reach past these.
SCOPES = frozenset("table td th caption template html".split())
#: Deeper elements are attached at this depth, as browsers do; their text stays.
MAX_DEPTH = 512
#: Fixed values of the HTML standard: the most columns and rows of a cell. A rowspan of 0 reaches as far as it may.
MAX_SPANS = {"colspan": 1000, "rowspan": 65534}
#: Columns of a table begin at this place of a line at most.
MAX_INDENT = 400
#: Python frames that laying out a tree of the greatest depth may take.
FRAMES = 20 * MAX_DEPTH

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(html: str) -> Node:
    """The element tree. Missing start and end tags are implied; nothing raises on any input."""
    root = Node("html", {})
    stack = [root]

    def close_until(at: int) -> None:
        del stack[at:]

    def open_tag(tag: str, rest: str) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == "p":
                    close_until(at)
                    break
                if stack[at].tag in SCOPES or stack[at].tag == "button":
                    break
        if tag in ENDS:
            ends, stops = ENDS[tag]
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in stops:
                    break
                if stack[at].tag in ends:
                    close_until(at)
                    if tag in ("li", "dd", "dt", "option", "body"):
                        break
        if tag not in HEAD_ONLY and tag not in ("head", "body") and stack[-1].tag == "head":
            stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            put(Node("tr", {}), True)
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t\r") else {}
        put(Node(tag, attributes), tag not in VOID)

    def put(node: Node, stays: bool) -> None:
        stack[-1].children.append(node)
        if stays and len(stack) < MAX_DEPTH:
            stack.append(node)

    at, end = 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        text = html[at : found.start() if found else end]
        if text:
            if stack[-1].tag == "head" and text.strip():
                stack.pop()
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_until(k)
                    break
                if stack[k].tag in SCOPES and tag not in ("table", "tr", "thead", "tbody", "tfoot", "template"):
                    break
            continue
        depth = len(stack)
        open_tag(tag, found[3])
        if tag in RAW or tag in RAW_WITH_ENTITIES or tag == "plaintext":
            stop = None if tag == "plaintext" else re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            node = stack[-1] if stack[-1].tag == tag and len(stack) > depth - 2 else stack[-1].children[-1]
            node.children.append(unescape(body) if tag in RAW_WITH_ENTITIES else body)
            if stack[-1] is node:
                stack.pop()
            at = stop.end() if stop else end
    return root


def visible(node: Node) -> bool:
    own = node.attributes
    if node.tag in HIDDEN or "hidden" in own or (node.tag == "input" and own.get("type", "").lower() == "hidden"):
        return False
    if node.tag == "dialog" and "open" not in own:
        return False
    return not ("style" in own and UNSEEN.search(own["style"]))


class Lines:
    """Lines of text being laid out, with the space that is owed before the next word and the next block."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False
        self.prefix = ""

    def word(self, text: str, keep: bool) -> None:
        if keep:
            first, *more = text.replace("\r\n", "\n").split("\n")
            if first:
                self._put(first)
            for line in more:
                self.end(force=True)
                if line:
                    self._put(line)
            return
        flat = SPACE.sub(" ", text)
        if flat == " " or not flat:
            self.space = self.space or bool(flat)
            return
        if flat[0] == " ":
            self.space = True
        self._put((" " if self.space and self.line else "") + flat.strip(" "))
        self.space = flat[-1] == " "

    def _put(self, text: str) -> None:
        if not self.line and self.gap and self.done:
            self.done.append("")
        self.gap = self.gap and bool(self.line)
        if self.prefix:
            text, self.prefix = self.prefix + text, ""
        self.line.append(text)

    def end(self, force: bool = False) -> None:
        if self.line or force:
            self.done.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or spaced

    def insert(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Whole lines, the first one after ``first``, the others after ``rest``."""
        if not lines and not first.strip():
            return
        self.end()
        if self.gap and self.done:
            self.done.append("")
        self.gap = False
        for k, line in enumerate(lines or [""]):
            self.done.append(f"{first if k == 0 else rest}{line}".rstrip(" "))


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    most = MAX_SPANS[name]
    given = int(value) if len(value) < 9 else most
    return min(most, given) or (most if name == "rowspan" else 1)


def width_of(line: str) -> int:
    """Columns that a line takes where wide characters take two and combining ones none."""
    if line.isascii():
        return len(line)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in line)


def _members(node: Node) -> Iterator[Node | str]:
    """Children of a part of a table; a form there holds no box of its own."""
    for child in node.children:
        if isinstance(child, Node) and child.tag == "form" and visible(child):
            yield from _members(child)
        else:
            yield child


def _stray(part: Node) -> Iterator[Node | str]:
    """What a table, its groups and rows hold beside groups, rows and cells: browsers show it above the table."""
    for child in _members(part):
        if not isinstance(child, Node):
            if child.strip():
                yield child
        elif not visible(child):
            continue
        elif child.tag in ("tr", "thead", "tbody", "tfoot"):
            yield from _stray(child)
        elif child.tag not in ("td", "th", "caption", "colgroup", "col"):
            yield child


def _rows(table: Node) -> Iterator[Node]:
    for child in _members(table):
        if isinstance(child, Node) and visible(child):
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _table(table: Node) -> list[str]:
    """Rows with cells padded to their columns' widths; cells of several lines take several lines.

    A column takes room where a cell begins in it, and begins at ``MAX_INDENT`` at most: further right a cell follows what stands
    before it in its line. So padding is bounded by the number of lines, however wide cells and spans are, and no text is lost.
    """
    grid: list[dict[int, list[str]]] = []
    held: list[tuple[int, int, int]] = []  # columns, from and to, that cells above still hold for so many rows
    widths: dict[int, int] = {}
    wide: list[tuple[int, int, int]] = []
    for row in _rows(table):
        cells: dict[int, list[str]] = {}
        column, upper, new = 0, 0, []
        for cell in _members(row):
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or not visible(cell):
                continue
            while upper < len(held) and held[upper][0] <= column:
                column = max(column, held[upper][1])
                upper += 1
            lines = _layout(cell)
            cells[column] = lines
            across, down = _span(cell, "colspan"), _span(cell, "rowspan")
            width = max(map(width_of, lines), default=0)
            widths[column] = max(widths.get(column, 0), width if across == 1 else 0)
            if across > 1:
                wide.append((column, column + across, width))
            if down > 1:
                new.append((column, column + across, down - 1))
            column += across
        held = sorted(new + [(c, end, n - 1) for c, end, n in held if n > 1])
        grid.append(cells)
    columns = sorted(widths)
    room = [widths[c] for c in columns]
    for column, end, width in wide:
        first, last = bisect_left(columns, column), bisect_left(columns, end)
        inside, at = 0, first
        while at < last and inside - 2 < width:
            inside += room[at] + 2
            at += 1
        if inside - 2 < width:
            room[last - 1] += width - inside + 2
    starts, at = {}, 0
    for c, width in zip(columns, room, strict=True):
        starts[c] = min(at, MAX_INDENT)
        at += width + 2
    out: list[str] = []
    for cells in grid:
        order = sorted(cells)
        for k in range(max((len(v) for v in cells.values()), default=0)):
            parts, end = [], 0
            for c in order:
                if k < len(cells[c]) and cells[c][k]:
                    gap = max(starts[c] - end, 2 if end else 0)
                    parts.append(" " * gap + cells[c][k])
                    end += gap + width_of(cells[c][k])
            out.append("".join(parts))
    captions = [c for c in _members(table) if isinstance(c, Node) and c.tag == "caption" and visible(c)]
    stray = list(_stray(table))
    above = Node("div", {})
    above.children = [*stray, *captions]
    return [*_layout(above), *out]


def _layout(node: Node) -> list[str]:
    out = Lines()
    _walk(node, out, False)
    out.end()
    return out.done


def _list(node: Node, out: Lines) -> None:
    start = node.attributes.get("start", "1").strip()
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1
    for child in node.children:
        if not isinstance(child, Node):
            if child.strip():
                out.insert(_layout_of([child]))
            continue
        if not visible(child):
            continue
        if child.tag != "li":
            out.insert(_layout_of([child]), "  ", "  ")
            continue
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        out.insert(_layout(child), mark, " " * len(mark))


def _layout_of(children: list) -> list[str]:
    holder = Node("div", {})
    holder.children = children
    return _layout(holder)


def _walk(node: Node, out: Lines, keep: bool) -> None:
    closed = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if not isinstance(child, Node):
            if not closed:
                out.word(child, keep)
            continue
        if not visible(child) or (closed and child.tag != "summary"):
            continue
        tag = child.tag
        if tag == "br":
            out.end(force=True)
        elif tag == "hr":
            out.block(False)
        elif tag == "wbr":
            pass
        elif tag == "table":
            out.block(True)
            out.insert(_table(child))
            out.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = node.tag == "li"
            out.block(not nested)
            _list(child, out)
            out.block(not nested)
        elif tag in ("blockquote", "dd"):
            out.block(tag == "blockquote")
            out.insert(_layout(child), "  ", "  ")
            out.block(tag == "blockquote")
        elif tag in BLOCK:
            out.block(tag in SPACED)
            _walk(child, out, keep or tag in ("pre", "textarea"))
            out.block(tag in SPACED)
        elif tag in ("textarea", "xmp", "listing", "plaintext"):
            _walk(child, out, True)
        else:
            _walk(child, out, keep)


def extract(html: str | None) -> str:
    """The visible text of a page; empty for null."""
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    lines = _layout(parse((html or "").replace("\r\n", "\n").replace("\r", "\n")))
    while lines and not lines[-1]:
        lines.pop()
    first = next((k for k, line in enumerate(lines) if line), 0)
    return "\n".join(lines[first:])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_lines"])


def page_text(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, url, text, n_lines)`` of ``pages(page_id, url, html, ...)``.

    All visible text, whole: hidden elements, scripts, styles and the head's title are left out. Blocks
    start lines, and paragraphs, headings, lists and tables stand apart by an empty line; list items
    carry marks or numbers, tables have aligned columns, where wide characters count as two. Elements deeper
    than ``MAX_DEPTH`` are attached at that depth, and spans are held to ``MAX_SPANS``, as browsers do. Null or empty html gives empty text and 0 lines;
    malformed html never fails; repeated rows stay; extra columns are not read.
    """
    small_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_lines int")
