"""HTML extraction: a tree builder with implied tags, and a layout of its visible text.

The tokenizer takes tags, comments and raw-text elements apart; the builder closes what a start or
end tag implies (paragraphs by blocks, list items, cells, rows, options); elements that are not
shown are skipped. The layout collapses blanks, separates blocks by line breaks or blank lines,
marks and indents list items, and pads table cells to the width of their column; long cells of tables
with several columns are wrapped at blanks, so that columns stay aligned. Text in SVG and MathML and the
values that form fields show are text as well.

Defined results: null or empty HTML has empty text; unclosed tags end with their parent; a ``<``
that begins no tag is text; a head ends where text or a tag comes that no head holds; nesting of any
depth is laid out without recursion, and pages of any length are read whole; repeated rows are extracted each; an empty table gives no rows; the column ``text`` of the input is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes title textarea xmp".split())
UNSEEN = frozenset("head script style noscript template iframe noembed noframes title object audio video canvas datalist".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset hr".split())
BLOCK = MARGIN | frozenset("html body div section article aside nav header footer main address details summary dialog figcaption li dt dd tr caption legend option optgroup center hgroup search menu".split())
CLOSES_P = BLOCK - frozenset("html body tr caption legend option optgroup li dt dd".split()) | {"li", "dt", "dd"}
#: What a start tag closes, and the elements that this does not reach beyond.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
}
#: What a head may hold.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Fields whose value is shown.
FIELDS = frozenset(["", "text", "search", "email", "url", "tel", "number", "date", "time", "month", "week", "datetime-local", "submit", "button", "reset"])
#: End tags don't reach beyond these, but for their own.
SCOPE = frozenset(["table", "td", "th", "body", "html", "caption"])
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
TABLE_SCOPE = frozenset(["table", "html"])
#: Cells are wrapped at so many characters, so that a long one does not widen every row.
MAX_PAD = 40
MAX_SPAN = 1000
#: Elements nested deeper become siblings, as in browsers; this bounds the search for what a tag closes.
MAX_DEPTH = 512

_TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:\"[^\"<]*+\"|'[^'<]*+'|[^>\"'])*+>|[^>]*+(?:>|\Z))", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NEEDED = re.compile(r"hidden|style|span|start|value|open|type|reversed", re.I)
_BLANKS = re.compile(r"[ \t\n\f\r]+")


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(rest: str) -> dict[str, str]:
    if not _NEEDED.search(rest):
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(rest):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def build(source: str) -> Node:
    """The tree of a document; its root is an element without a tag."""
    root = Node("", {})
    stack = [root]

    def pop_to(i: int) -> None:
        del stack[i:]

    def find(tags: frozenset[str], stop: frozenset[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return 0
        return 0

    def add_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            pop_to(len(stack) - 1)
        stack[-1].children.append(text)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            add_text(source[at:])
            break
        if m.start() > at:
            add_text(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif i := find(frozenset([tag]), (TABLE_SCOPE if tag in TABLE_PARTS else SCOPE) - {tag}):
                pop_to(i)
            continue
        if tag in ("html", "body") and find(frozenset([tag]), frozenset()):
            continue
        if tag in CLOSES_P and (i := find(frozenset(["p"]), SCOPE | {"button"})):
            pop_to(i)
        if stack[-1].tag == "head" and tag not in HEAD:
            pop_to(len(stack) - 1)
        if tag in IMPLIED and (i := find(*IMPLIED[tag])):
            pop_to(i)
        node = Node(tag, _attributes(m["rest"]))
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            end = close.start() if close else n
            node.children.append(source[at:end])
            at = source.find(">", end) + 1 if close else n
            at = at or n
        elif tag not in VOID and not (m["rest"].endswith("/>") and tag in ("svg", "math")):
            if len(stack) < MAX_DEPTH:
                stack.append(node)
    return root


def _hides(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return True
    return "style" in a and bool(re.search(r"display\s*:\s*none", a["style"], re.I))


def _shown(node: Node, shown: bool) -> bool:
    if "style" in node.attrs and (m := re.search(r"visibility\s*:\s*(\w+)", node.attrs["style"], re.I)):
        return m[1].lower() == "visible" or m[1].lower() == "inherit" and shown
    return shown


class Writer:
    """Lines of text; ``gap`` is the number of line breaks that come before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.mark = 0, False, "", ""

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
        self.gap = 0
        if self.mark:
            self.parts.append(self.indent[: max(0, len(self.indent) - len(self.mark))] + self.mark)
            self.mark = ""
        else:
            self.parts.append(self.indent)

    def write(self, text: str) -> None:
        words = _BLANKS.sub(" ", text)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        if not self.parts:
            self._begin()
        elif self.space:
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words.rstrip(" ") if self.space else words)

    def write_lines(self, lines: list[str]) -> None:
        for i, line in enumerate(lines):
            if i:
                self.flush()
                self.gap = max(self.gap, 1)
                if not line:
                    self.lines.append("")
                    continue
            if line:
                if not self.parts:
                    self._begin()
                self.parts.append(line)
        self.space = False

    def flush(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.space = False

    def break_lines(self, n: int) -> None:
        self.flush()
        self.gap = max(self.gap, n)

    def new_line(self) -> None:
        self.gap = self.gap + 1 if not self.parts else max(self.gap, 1)
        self.flush()

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(node: Node, name: str) -> int:
    v = node.attrs.get(name, "1").strip()
    return min(MAX_SPAN, max(1, int(v))) if v.isascii() and v.isdigit() and len(v) < 9 else 1


def _wrapped(line: str) -> list[str]:
    """A line cut at blanks into parts of up to ``MAX_PAD`` characters; longer words stay whole."""
    if len(line) <= MAX_PAD:
        return [line]
    out, part = [], line[: len(line) - len(line.lstrip(" "))]
    for word in line.split(" "):
        if part.strip() and len(part) + 1 + len(word) > MAX_PAD:
            out.append(part)
            part = word
        else:
            part = f"{part} {word}" if part.strip() else part + word
    return [*out, part]


def lay_out_table(rows: list[list[tuple[Node, list[str]]]]) -> list[str]:
    """Lines of a table; a cell takes the first free columns of its row, and others below if it spans rows."""
    taken: dict[int, int] = {}
    placed: list[list[tuple[int, int, list[str]]]] = []
    for row in rows:
        col, line = 0, []
        busy = {c for c, left in taken.items() if left > 0}
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        for node, text in row:
            while col in busy:
                col += 1
            wide, high = _span(node, "colspan"), _span(node, "rowspan")
            line.append((col, wide, text))
            if high > 1:
                taken.update({c: max(taken.get(c, 0), high - 1) for c in range(col, col + wide)})
            col += wide
        placed.append(line)
    if any(len(line) > 1 for line in placed):
        placed = [[(col, wide, [part for x in text for part in _wrapped(x)]) for col, wide, text in line] for line in placed]
    widths: dict[int, int] = {}
    for line in placed:
        for col, wide, text in line:
            if wide == 1:
                widths[col] = max(widths.get(col, 0), min(MAX_PAD, max(map(len, text), default=0)))
    used = sorted(widths.keys() | {col for line in placed for col, _, _ in line})
    starts, at = {}, 0
    for c in used:
        starts[c] = at
        at += widths.get(c, 0) + 2
    out = []
    for line in placed:
        for i in range(max((len(text) for _, _, text in line), default=0)):
            s = ""
            for col, _, text in line:
                if i < len(text) and text[i]:
                    s = (s.ljust(starts[col]) if len(s) <= starts[col] - 2 or not s else s + "  ") + text[i]
            out.append(s.rstrip(" "))
    return out


def render(source: str | None) -> str:
    """The visible text of an HTML document."""
    if not source:
        return ""
    writer = Writer()
    writers: list[Writer] = []
    tables: list[list[list[tuple[Node, list[str]]]]] = []
    lists: list[list] = []
    pre = 0
    work: list[tuple] = [("in", build(source), True)]
    while work:
        what, node, shown = work.pop()
        if isinstance(node, str):
            if shown:
                text = html.unescape(node) if "&" in node else node
                if pre:
                    writer.write_lines(text.replace("\r\n", "\n").split("\n"))
                else:
                    writer.write(text)
            continue
        tag = node.tag
        if what == "in":
            if _hides(node):
                continue
            shown = _shown(node, shown)
            if tag == "br":
                writer.new_line()
                continue
            if tag == "input":
                if shown and node.attrs.get("type", "").strip().lower() in FIELDS:
                    writer.write(node.attrs.get("value", ""))
                continue
            if tag in BLOCK:
                tight = tag in ("ul", "ol", "dl", "menu") and lists
                writer.break_lines(2 if tag in MARGIN and not tight else 1)
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1, writer.indent])
                writer.mark = ""
            elif tag == "li":
                kind, number, indent = lists[-1] if lists else ("ul", 1, "")
                value = node.attrs.get("value", "")
                number = int(value) if kind == "ol" and re.fullmatch(r"-?\d{1,9}", value, re.A) else number
                mark = f"{number}. " if kind == "ol" else "- "
                if lists:
                    lists[-1][1] = number + 1
                # Deep nesting indents no further, so that output stays in proportion to input.
                writer.mark, writer.indent = mark, (indent + " " * len(mark)) if len(indent) < 40 else indent
            elif tag == "dd":
                lists.append(["dd", 0, writer.indent])
                writer.indent = writer.indent + "  " if len(writer.indent) < 40 else writer.indent
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th"):
                if tables:
                    writers.append(writer)
                    writer = Writer()
                else:
                    writer.write(" ")
            work.append(("out", node, shown))
            inner = node.children
            if tag == "details" and "open" not in node.attrs:
                inner = [c for c in inner if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "table":
                inner = [c for c in inner if not isinstance(c, str) or c.strip()]
            work.extend(("in", c, shown) for c in reversed(inner))
            continue
        if tag in ("td", "th"):
            if tables:
                text, writer = writer.done(), writers.pop()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((node, text))
            else:
                writer.write(" ")
        elif tag == "table":
            rows = tables.pop()
            for line in lay_out_table(rows):
                writer.break_lines(1)
                writer.write_lines([line])
            writer.break_lines(2)
        elif tag in ("ul", "ol", "menu"):
            writer.indent = lists.pop()[2]
            writer.mark = ""
        elif tag == "li":
            writer.flush()
            writer.mark = ""
            writer.indent = lists[-1][2] if lists else ""
        elif tag == "dd":
            writer.flush()
            writer.indent = lists.pop()[2]
        elif tag in ("pre", "textarea"):
            pre -= 1
        if tag in BLOCK and tag != "table":
            tight = tag in ("ul", "ol", "dl", "menu") and lists
            writer.break_lines(2 if tag in MARGIN and not tight else 1)
    return "\n".join(writer.done())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the column ``text`` in place of the HTML."""
    keep = [f for f in pages.schema.fields if f.name not in (html_col, "text")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = 64  # rows that are laid out at once
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                text = pa.array([render(x.as_py()) for x in part.column(part.num_columns - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], [*(f.name for f in keep), "text"])

    return pages.select(*[f.name for f in keep], html_col).mapInArrow(run, schema)
