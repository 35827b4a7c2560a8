"""Layout-aware HTML rendering (operator 2): all visible text, laid out as lines.

A small tree builder reads tags as browsers do where it matters for text: void and raw
text elements, implied end tags (a block ends a paragraph, an item the item before it,
a cell the cell before it, ...), stray end tags ignored, depth limited to ``DEPTH`` (deeper elements
become siblings). A renderer walks the tree: elements that are not displayed (by tag,
``hidden``, ``display:none``, closed ``details`` and ``dialog``) give nothing; visibility
is inherited, and what is invisible gives no text; labels of drawings (svg) stand on lines of
their own, formulas (math) in line; text fields show their values; white space collapses outside ``pre``; paragraphs, headings, lists and
tables stand between blank lines; list items get bullets or their numbers and hang;
table cells are padded to columns, spans included.

Pages are independent: one narrow Arrow pass, whole pages.

Cases: null html gives null text, empty html an empty text; repeated rows and null ids are rendered like any
other; other columns are ignored; markup that never closes is closed at the end of the page.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm.tables import arrow_map

DEPTH = 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("script style template head title meta link noscript iframe noembed noframes datalist object audio video canvas area param source track".split())
BLOCKS = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl pre blockquote table figure hr fieldset".split())
# Opening one of the right ends an open element of the left, up to the fence.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul dd dt".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th", "caption", "colgroup"), ("tr", "table")), "th": (("td", "th", "caption", "colgroup"), ("tr", "table")),
    "tbody": (("td", "th", "tr", "caption", "colgroup", "thead", "tbody", "tfoot"), ("table",)),
    "body": (("head",), ()),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
FENCE = frozenset(("td", "th", "table", "caption", "body", "html", "template", "button"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\f\r]+")
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse)\b", re.I)
FOREIGN = frozenset(("svg", "math"))
SVG_UNSEEN = frozenset("defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient filter".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
MATH_TOKENS = frozenset("mi mn mo mtext ms".split())
VALUELESS = frozenset("hidden password checkbox radio file image color range".split())
PRESERVED = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre|pre-wrap|break-spaces)\b", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "seen")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children, self.seen = tag, attrs, [], True


def build(page: str) -> Node:
    root = Node("#root", {})
    stack = [root]

    def close(tags, fence) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return close(tags, fence)
            if stack[i].tag in fence:
                return None
        return None

    def add_text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    at = 0
    while m := TOKEN.search(page, at):
        add_text(page[at:m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in FENCE and tag not in FENCE and tag not in ("tr", "tbody", "thead", "tfoot", "html", "body"):
                    break
            continue
        attrs: dict[str, str] = {}
        if m[3].strip("/ \t\n\r\f"):
            for k, a, b, c in ATTRIBUTE.findall(m[3]):
                attrs.setdefault(k.lower(), html.unescape(a or b or c))
        if tag in ENDS_P:
            close(("p",), FENCE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID or (m[3].endswith("/") and (tag in FOREIGN or any(n.tag in FOREIGN for n in stack))):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at:end.start()] if end else page[at:]
            at = end.end() if end else len(page)
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
        elif len(stack) < DEPTH:
            stack.append(node)
    add_text(page[at:])
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return (node.tag in UNSEEN or "hidden" in a or ("style" in a and HIDDEN.search(a["style"]) is not None)
            or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"))


def mark(root: Node) -> None:
    """``seen`` of every element: its own visibility or that of the element it stands in."""
    todo = [(root, False)]
    while todo:
        node, drawn = todo.pop()
        drawn = drawn or node.tag == "svg"
        for c in node.children:
            if isinstance(c, Node):
                own = VISIBILITY.findall(c.attrs["style"]) if "style" in c.attrs else []
                if not own and (drawn or c.tag == "svg") and "visibility" in c.attrs:
                    own = [c.attrs["visibility"].strip()]
                c.seen = own[-1].lower() in ("visible", "initial") if own else node.seen
                todo.append((c, drawn))


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Lines with pending blank lines, indents and white space that collapses."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.blank, self.fresh = "", 0, True
        self.indent: list[str] = []
        self.marker: str | None = None  # of the list item that has no line yet

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.expandtabs(8).split("\n")
            self._append(first)
            for x in rest:
                self.end_line(True)
                self._append(x)
            return
        s = SPACES.sub(" ", s)
        if self.line == "" or self.line.endswith(" "):
            s = s.lstrip(" ")
        self._append(s)

    def _append(self, s: str) -> None:
        self.line += s

    def end_line(self, forced: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line or forced:
            self._put(line)

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.blank
        self.blank = 0
        if self.marker is not None:
            prefix = "".join(self.indent[:-1]) + self.marker
            self.marker = None
        else:
            prefix = "".join(self.indent)
        self.lines.append((prefix + line).rstrip(" ") if line else "")

    def space(self, blank: int) -> None:
        self.end_line()
        self.blank = max(self.blank, blank) if self.lines else 0

    def done(self) -> list[str]:
        self.end_line()
        if self.marker is not None:
            self._put("")
        return self.lines


def number(node: Node, key: str, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", node.attrs.get(key, ""))
    return int(m[1]) if m else default


def label(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
        return s.upper() if kind == "A" else s
    if kind in ("i", "I") and 0 < n < 4000:
        s = ""
        for v, r in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            s, n = s + r * (n // v), n % v
        return s.upper() if kind == "I" else s
    return str(n)


def walk(node: Node, out: Lines, pre: bool = False, depth: int = 0) -> None:
    for child in node.children:
        if isinstance(child, str):
            if node.seen:
                out.text(child, pre)
        elif not hidden(child):
            element(child, out, pre, depth)


def drawing(node: Node, out: Lines, pre: bool, depth: int) -> None:
    for c in node.children:  # text that stands outside of text elements is not shown
        if isinstance(c, str) or hidden(c) or c.tag in SVG_UNSEEN or c.attrs.get("display") == "none":
            continue
        if c.tag in ("text", "foreignobject"):
            out.end_line()
            walk(c, out, pre, depth)
            out.end_line()
        else:
            drawing(c, out, pre, depth)


def formula(node: Node, out: Lines, depth: int) -> None:
    for i, c in enumerate(node.children):
        if isinstance(c, str):
            if node.seen and c.strip():
                out.text(c, False)
        elif not hidden(c) and c.tag not in MATH_UNSEEN:
            if c.tag == "mtr":
                out.end_line()
            elif c.tag in ("mtd", "mspace") or node.tag == "mfrac":
                out.text(" ", False)
            walk(c, out, False, depth) if c.tag in MATH_TOKENS else formula(c, out, depth)
    if node.tag in ("mtable", "mfrac"):
        out.end_line() if node.tag == "mtable" else out.text(" ", False)


def element(node: Node, out: Lines, pre: bool, depth: int) -> None:
    tag = node.tag
    if tag == "br":
        return out.end_line(True) if node.seen else None
    if tag == "svg":
        return drawing(node, out, pre, depth)
    if tag == "math":
        return formula(node, out, depth)
    if tag == "tspan" and {"x", "y", "dy"} & node.attrs.keys():
        out.text(" ", False)
    if tag == "wbr" or tag == "img":
        return None
    if tag == "input":
        return out.text(node.attrs.get("value", "") if node.seen and node.attrs.get("type", "").strip().lower() not in VALUELESS else "", False)
    if tag not in BLOCKS:
        return walk(node, out, pre or ("style" in node.attrs and PRESERVED.search(node.attrs["style"]) is not None), depth)
    gap = 1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and depth) else 0
    out.space(gap)
    if tag == "table":
        for line in table(node):
            out.line = line
            out.end_line(True)
    elif tag in ("ul", "ol", "menu"):
        listed(node, out, pre, depth)
    elif tag in ("blockquote", "dd"):
        out.indent.append("    ")
        walk(node, out, pre, depth)
        out.end_line()
        out.indent.pop()
    elif tag == "details" and "open" not in node.attrs:
        walk(Node("div", {}) if not (s := [c for c in node.children if isinstance(c, Node) and c.tag == "summary"]) else s[0], out, pre, depth)
    elif tag == "pre":
        if node.children and isinstance(node.children[0], str):
            node.children[0] = node.children[0].removeprefix("\n")
        if node.children and isinstance(node.children[-1], str):
            node.children[-1] = node.children[-1].removesuffix("\n")
        walk(node, out, True, depth)
    else:
        walk(node, out, pre or ("style" in node.attrs and PRESERVED.search(node.attrs["style"]) is not None), depth)
    out.space(gap)


def listed(node: Node, out: Lines, pre: bool, depth: int) -> None:
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and not hidden(c)]
    step = -1 if "reversed" in node.attrs else 1
    n = number(node, "start", len(items) if step < 0 else 1)
    for child in node.children:
        if isinstance(child, str):
            if node.seen:
                out.text(child, pre)
        elif hidden(child):
            continue
        elif child.tag == "li":
            out.end_line()
            n = number(child, "value", n)
            marker = f"{label(n, node.attrs.get('type', '1'))}. " if node.tag == "ol" else "- "
            n += step
            if out.marker is not None:
                out._put("")
            out.indent.append(" " * len(marker))
            out.marker = marker if child.seen else None
            walk(child, out, pre, depth + 1)
            out.end_line()
            if out.marker is not None:
                out._put("")
            out.indent.pop()
        else:
            element(child, out, pre, depth + 1)


def _rows(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not hidden(c):
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def table(node: Node) -> list[str]:
    """Lines of a table: every column as wide as its widest line; spans take their columns together."""
    loose = Lines()
    for c in node.children:  # captions and text that stands outside of cells come first
        if isinstance(c, str):
            if node.seen:
                loose.text(c, False)
        elif not hidden(c) and c.tag not in ("tr", "thead", "tbody", "tfoot", "col", "colgroup"):
            element(c, loose, False, 0)
            loose.end_line()
    taken: dict[int, int] = {}  # column -> rows that a span above still covers
    rows: list[list[tuple[int, int, list[str]]]] = []
    for tr in _rows(node):
        cells, col = [], 0
        for c in tr.children:
            if isinstance(c, str):
                if c.strip() and tr.seen:
                    loose.text(c, False)
                continue
            if hidden(c):
                continue
            while taken.get(col, 0) > 0:
                col += 1
            inner = Lines()
            walk(c, inner, False, 0) if c.tag in ("td", "th") else element(c, inner, False, 0)
            span = min(max(number(c, "colspan", 1), 1), 1000)
            down = min(max(number(c, "rowspan", 1), 1), 65534)
            cells.append((col, span, inner.done()))
            for k in range(col, col + span):
                if down > 1:
                    taken[k] = down
            col += span
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
        rows.append(cells)
    wide: dict[int, int] = {}
    for many in (False, True):
        for cells in rows:
            for col, span, lines in cells:
                need = max(map(width, lines), default=0)
                if (span > 1) == many:
                    have = sum(wide.get(k, 0) for k in range(col, col + span)) + 2 * (span - 1)
                    last = col + span - 1
                    wide[last] = wide.get(last, 0) + max(0, need - have)
    left: dict[int, int] = {}
    at = 0
    for k in range(max(wide, default=-1) + 1):
        left[k] = at
        at += wide.get(k, 0) + (2 if wide.get(k, 0) else 0)
    out = loose.done()
    for cells in rows:
        for i in range(max((len(x) for _, _, x in cells), default=0)):
            line = ""
            for col, _, lines in cells:
                if i < len(lines):
                    line += " " * (left.get(col, 0) - width(line)) + lines[i]
            out.append(line.rstrip(" "))
    return out


def render(page: str) -> str:
    out, root = Lines(), build(page)
    mark(root)
    walk(root, out)
    return "\n".join(out.done())


def _pages():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if p is None else render(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id and ``text``."""
    x = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    out = T.StructType([T.StructField("id", x.schema["id"].dataType), T.StructField("text", T.StringType())])
    return arrow_map(x, _pages(), out).withColumnRenamed("id", id_col)
