"""Visible text of web pages by layout-aware rendering.

A page is read tag by tag into a stack of open elements with the implied tags of HTML: a new block ends an open
paragraph, a new item its predecessor, a cell its row's last cell, body content the head. Elements that a browser does
not show (scripts, styles, templates, the head, ``hidden`` ones, and inline styles ``display:none`` or
``visibility:hidden``) take their whole subtree out. The rest is laid out: blocks on lines of their own,
paragraphs apart by an empty line, list items with marks and indents, table cells in aligned columns.
All visible text is emitted; nothing is classified as boilerplate.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.words import chunks

_CHUNK = 4 << 20
#: wider cells are written whole, but do not widen their column
WIDEST = 40
_GAP = "  "

# fixed values: element names of HTML by their role
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = set(
    "head script style template noscript title iframe object audio video canvas datalist noembed noframes area base "
    "link meta param source track".split()
)
_IN_HEAD = set("title meta link style script base template noscript head".split())
_APART = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table hr figure".split())
_BLOCK = _APART | set(
    "html body div section article aside nav header footer main address center details summary dialog fieldset form "
    "legend li dt dd figcaption menu dir hgroup caption thead tbody tfoot tr td th option optgroup".split()
)
#: an opening tag ends these open elements, but looks no further than the named ones
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
_ENDS_PARAGRAPH = _BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "legend"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'<])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WHITE = re.compile(r"[ \t\n\r\f]+")


class _Flow:
    """Lines of laid-out text. ``block`` starts a new line, with ``apart`` after an empty one."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.apart = False
        self.mark = ""

    def text(self, text: str, indent: int, keep: bool) -> None:
        if keep:
            pieces = text.replace("\r\n", "\n").split("\n")
            for i, piece in enumerate(pieces):
                if i:
                    self.end_line(indent, always=True)
                if piece:
                    self.parts.append(piece)
            return
        text = _WHITE.sub(" ", text)
        if not self.parts or self.parts[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def end_line(self, indent: int, always: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts = []
        if line or always:
            if self.apart and self.lines:
                self.lines.append("")
            self.apart = False
            lead = " " * max(0, indent - len(self.mark)) + self.mark
            self.mark = ""
            self.lines.append((lead + line).rstrip(" ") if not line else lead + line)

    def block(self, indent: int, apart: bool) -> None:
        self.end_line(indent)
        self.apart = self.apart or (apart and bool(self.lines))

    def rows(self, rows: list[str], indent: int) -> None:
        self.end_line(indent)
        for row in rows:
            self.parts = [row]
            self.end_line(indent, always=True)


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[_Flow, int]]] = []

    def lines(self) -> list[str]:
        """Cells under each other in columns; a cell of several lines takes several lines of its row."""
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for cell, span in row:
                if span == 1:
                    widest = max((len(x) for x in cell.lines if len(x) <= WIDEST), default=0)
                    widths[at] = max(widths.get(at, 0), widest)
                at += span
        out = []
        for row in self.rows:
            for number in range(max((len(cell.lines) for cell, _ in row), default=0)):
                at, pieces = 0, []
                for cell, span in row:
                    text = cell.lines[number] if number < len(cell.lines) else ""
                    width = sum(widths.get(i, 0) for i in range(at, min(at + span, at + 64))) + len(_GAP) * (min(span, 64) - 1)
                    pieces.append(text.ljust(width))
                    at += span
                out.append(_GAP.join(pieces).rstrip(" "))
        return out


class _Page:
    def __init__(self):
        self.open: list[tuple[str, bool]] = []  # name and whether it hides what it holds
        self.hidden = 0
        self.flows = [_Flow()]
        self.tables: list[_Table] = []
        self.lists: list[list] = []  # name and number of the last item
        self.pre = 0
        self.indents = [0]
        self.body = False
        self.spans: list[int] = []
        self.count: dict[str, int] = {}

    def push(self, name: str, hides: bool) -> None:
        self.open.append((name, hides))
        self.count[name] = self.count.get(name, 0) + 1
        self.hidden += hides
        if self.hidden:
            return
        flow, indent = self.flows[-1], self.indents[-1]
        if name in ("td", "th"):
            self.flows.append(_Flow())
            self.indents.append(0)
            return
        if name in _BLOCK:
            nested = name in ("ul", "ol") and bool(self.lists)
            flow.block(indent, name in _APART and not nested)
        if name in ("ul", "ol", "menu", "dir"):
            self.lists.append([name, 0])
        elif name == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            self.indents.append(indent + len(mark))
            flow.mark = mark
        elif name in ("dd", "blockquote"):
            self.indents.append(indent + 2)
        elif name == "pre":
            self.pre += 1
        elif name == "table":
            self.tables.append(_Table())
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])

    def pop(self) -> None:
        name, hides = self.open.pop()
        self.count[name] -= 1
        seen = not self.hidden
        self.hidden -= hides
        if not seen:
            return
        if name in ("td", "th"):
            cell = self.flows.pop()
            cell.end_line(0)
            self.indents.pop()
            if self.tables:
                table = self.tables[-1]
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((cell, self.spans.pop() if self.spans else 1))
            else:
                for line in cell.lines:
                    self.flows[-1].rows([line], self.indents[-1])
            return
        flow = self.flows[-1]
        if name == "table":
            flow.end_line(self.indents[-1])
            flow.rows(self.tables.pop().lines(), self.indents[-1])
        if name in _BLOCK:
            nested = name in ("ul", "ol") and len(self.lists) > 1
            flow.block(self.indents[-1], name in _APART and not nested)
        if name in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif name in ("li", "dd", "blockquote"):
            if name == "li" and flow.mark:
                flow.end_line(self.indents[-1], always=True)
            self.indents.pop()
        elif name == "pre":
            self.pre -= 1

    def end(self, names: set[str], until: set[str]) -> None:
        """Close the open elements down to each of ``names``, as far as none of ``until`` is met."""
        while any(self.count.get(n) for n in names):
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in names:
                    while len(self.open) > depth:
                        self.pop()
                    break
                if self.open[depth][0] in until:
                    return

    def start(self, name: str, attributes: str) -> None:
        if not self.body and name not in _IN_HEAD and name != "html":
            self.end({"head"}, set())
            self.body = True
        values = {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        if name in _ENDS_PARAGRAPH:
            self.end({"p"}, {"table", "td", "th", "button", "caption"})
        if name in _ENDS:
            self.end(*_ENDS[name])
        style = values.get("style", "").lower().replace(" ", "")
        hides = name in _UNSEEN or "hidden" in values or "display:none" in style or "visibility:hidden" in style
        if name in _VOID:
            if not self.hidden and not hides:
                flow = self.flows[-1]
                if name == "br":
                    flow.end_line(self.indents[-1], always=bool(flow.parts))
                elif name == "hr":
                    flow.block(self.indents[-1], True)
                elif name == "input" and values.get("type", "").lower() in ("button", "submit", "reset") and values.get("value"):
                    flow.text(values["value"], self.indents[-1], False)
            return
        if name in ("html", "body"):
            return
        if name in ("td", "th") and not self.hidden and not hides:
            span = values.get("colspan", "1")
            self.spans.append(min(1000, int(span)) if re.fullmatch(r"[1-9][0-9]{0,3}", span) else 1)
        self.push(name, hides)

    def stop(self, name: str) -> None:
        if name in ("html", "body", "br"):
            if name == "br":
                self.start("br", "")
            return
        if not self.count.get(name):
            return
        until = {"table", "td", "th", "tr"} - {name} if name not in ("table", "tr", "thead", "tbody", "tfoot", "td", "th", "caption") else {"table"} - {name}
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == name:
                while len(self.open) > depth:
                    self.pop()
                return
            if self.open[depth][0] in until:
                return

    def text(self, text: str) -> None:
        if not self.hidden and text:
            self.flows[-1].text(unescape(text) if "&" in text else text, self.indents[-1], self.pre > 0)
        elif text.strip() and not self.body and any(n == "head" for n, _ in self.open) and not any(n in _RAW for n, _ in self.open):
            self.end({"head"}, set())
            self.body = True
            self.text(text)


def render(html: str) -> str:
    """The visible text of one page."""
    page = _Page()
    at, length = 0, len(html)
    while at < length:
        token = _TOKEN.search(html, at)
        begin = token.start() if token else length
        if begin > at:
            page.text(html[at:begin])
        if not token:
            break
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name = name.lower()
        if token[1]:
            page.stop(name)
            continue
        page.start(name, token[3])
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inner = html[at : close.start() if close else length]
            if name == "textarea":
                page.text(inner)
            page.stop(name)
            at = close.end() if close else length
    while page.open:
        page.pop()
    page.flows[0].end_line(0)
    lines = page.flows[0].lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, text`` for every row, in one pass without a shuffle.

    A null page has null text; an empty one, or one with nothing visible, has the empty text. Broken mark-up is read
    as far as it goes. Repeated rows are each rendered; other columns are left out.
    """
    schema = T.StructType([pages.schema[key], T.StructField("text", T.StringType())])

    def rendered(batches):
        for batch in chunks(batches, "_html", _CHUNK):
            texts = [None if value is None else render(value) for value in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(texts, pa.string())], names=schema.names)

    return pages.select(F.col(key).alias("_key"), F.col(html).alias("_html")).mapInArrow(rendered, schema)
