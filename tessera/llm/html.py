"""Visible text of HTML pages by layout-aware rendering.

A tree builder takes the tags of a page, with implied ends (a new ``li``, ``p``, ``td``,
``option`` ... ends the open one) and void elements; visibility rules drop what a browser
does not show (head, scripts, ``hidden``, ``display: none``, closed ``details`` but for the summary;
``visibility: hidden`` until a descendant is visible again). The renderer
collapses white space outside ``pre``, puts a blank line around paragraphs, headings, lists and
tables and a line break around other blocks, marks and indents list items, and pads table
cells so that columns line up.

A head ends at the first start tag or text that does not belong in one. Elements below ``svg``
and ``math`` end at once when self-closing (also after an unquoted value, where a browser takes the
slash into the value), and a paragraph or the like ends them; of an svg, what its ``text``
and ``foreignObject`` elements hold is shown (copies by ``use`` are not). An input shows its value
unless its type shows none as text (checkbox, radio, file, image, password, range, color, hidden).

Cases: null html gives a null text, empty html an empty one; malformed and unclosed tags are
closed at their parent's end; nothing recurses, so depth is not limited; repeated rows
repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names by their role in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title iframe object canvas audio video datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure form fieldset".split())
BLOCK = SPACED | frozenset("""html body div section article aside nav header footer main address li dt dd tr caption
thead tbody tfoot figcaption details summary dialog hgroup legend option optgroup center menu""".split())
# A start tag ends the open elements named, up to the scope that bounds it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "tr", "thead", "tbody", "tfoot", "caption", "legend"} | {"hr"}
SCOPE = frozenset("html body table td th caption button object foreignobject".split())
HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
# Start tags that end an open svg or math element; elements of these whose own content is HTML again; svg content that is not drawn.
LEAVES_FOREIGN = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu
meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
HTML_INSIDE = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
NOT_DRAWN = frozenset("""defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc""".split())
NO_TEXT_INPUTS = frozenset("hidden checkbox radio file image password range color".split())

_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "space", "inner")

    def __init__(self, tag: str, attrs: dict, space: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.space = tag if tag in HTML_INSIDE else space  # "svg", "math" or "" (HTML): of the element, and of what it holds
        self.inner = "" if tag in HTML_INSIDE.get(space, ()) else self.space


class TreeBuilder(HTMLParser):
    """Page to tree; ``children`` holds nodes and strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _end_implied(self, names: set, scope: set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in scope or tag == "foreignobject":
                return
            if tag in names:
                below = [k for k in range(i - 1, 0, -1) if self.open[k].tag in names | scope]
                del self.open[i:]
                if not below or self.open[below[0]].tag in scope:
                    return

    def _end_head(self) -> None:
        while self.open[-1].tag == "head":
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._end_head()
        if tag in LEAVES_FOREIGN or tag == "font" and any(k in ("color", "face", "size") for k, _ in attrs):
            while self.open[-1].inner:
                self.open.pop()
        if tag in ENDS:
            self._end_implied(*ENDS[tag])
        if tag in CLOSES_P:
            self._end_implied({"p"}, SCOPE)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1].inner)
        self.open[-1].children.append(node)
        if tag not in VOID and not (node.space and self.get_starttag_text().endswith("/>")):
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "p" and all(n.tag != "p" for n in self.open):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return
            if self.open[i].tag == "foreignobject" and tag != "svg":
                return

    def set_cdata_mode(self, elem, **kind):
        if not (self.open[-1].tag == elem and self.open[-1].space):  # svg styles and titles are ordinary markup
            super().set_cdata_mode(elem, **kind)

    def handle_data(self, data):
        if data.strip(" \t\n\r\f"):
            self._end_head()
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if self.open[-1].inner and data.startswith("CDATA["):
            self.handle_data(data[6:])


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """(the element takes part in the layout, its own text is visible)."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, False
    if node.space == "svg" and node.tag in NOT_DRAWN:
        return False, False
    if node.tag == "dialog" and "open" not in a:
        return False, False
    style = a.get("style")
    if style:
        if _NONE.search(style):
            return False, False
        v = _VISIBILITY.findall(style)
        if v:
            visible = v[-1].lower() == "visible"
    return True, visible


class Page:
    """Text under construction: lines that end in collapsed white space."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = 0       # line breaks owed before the next text
        self.space = False    # a space owed before the next text
        self.fresh = True     # at the start of a line
        self.lead = ""        # what the next line starts with (list marker)
        self.indent = ""

    def block(self, lines: int) -> None:
        self.space = False
        self.breaks = max(self.breaks, lines)

    def _begin(self) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
            self.fresh = True
        self.breaks = 0
        if self.fresh:
            self.parts.append(self.lead or self.indent)
            self.lead, self.fresh, self.space = "", False, False

    def text(self, data: str) -> None:
        if data[0] in " \t\n\r\f" and not self.fresh:
            self.space = True
        words = _SPACE.sub(" ", data).strip(" ")
        if not words:
            return
        self._begin()
        if self.space:
            self.parts.append(" ")
        self.parts.append(words)
        self.space = data[-1] in " \t\n\r\f"

    def lines(self, data: str) -> None:
        """Preformatted text."""
        for i, line in enumerate(data.split("\n")):
            if i:
                self.newline()
            if line:
                self._begin()
                self.parts.append(line)

    def newline(self) -> None:
        self.space = False
        self.breaks = self.breaks + 1 if self.breaks < 2 else self.breaks

    def result(self) -> str:
        return "".join(self.parts)


def _layout(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (text, span) as lines with aligned columns."""
    width: list[int] = []
    for row in rows:
        at = 0
        for text, span in row:
            while len(width) < at + span:
                width.append(0)
            if span == 1:
                width[at] = max(width[at], len(text))
            at += span
    lines = []
    for row in rows:
        at, line = 0, []
        for text, span in row:
            line.append(text.ljust(sum(width[at:at + span]) + 2 * (span - 1)))
            at += span
        lines.append("  ".join(line).rstrip())
    return lines


def render(root: Node) -> str:
    """Visible text; tables are rendered cell by cell into their own pages."""
    page = Page()
    pages: list[Page] = [page]
    tables: list[list[list[tuple[str, int]]]] = []
    # work: ("open", node, visible, pre, drawn) or ("close", function); drawn: not text that stands loose in an svg
    work: list[tuple] = [("open", root, True, False, True)]
    counters: list[list] = []

    def closing(f):
        work.append(("close", f))

    while work:
        step = work.pop()
        if step[0] == "close":
            step[1]()
            continue
        _, node, visible, pre, drawn = step
        page = pages[-1]
        if isinstance(node, str):
            if visible and drawn and node:
                page.lines(node) if pre else page.text(node)
            continue
        shown, visible = _shown(node, visible)
        if not shown:
            continue
        tag = node.tag
        children = node.children
        if node.space == "svg":
            if tag == "svg":
                drawn = False
            elif tag in ("text", "foreignobject"):
                drawn = True
                page.text(" ")  # each has a place of its own
                closing(lambda page=page: page.text(" "))
            elif tag == "switch":  # the first that suits
                children = [c for c in children if isinstance(c, Node)][:1]
        if tag == "br":
            page.newline()
            continue
        if tag == "input":
            if node.attrs.get("type", "text").lower() not in NO_TEXT_INPUTS and node.attrs.get("value") and visible and drawn:
                page.text(node.attrs["value"])
            continue
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        gap = 0 if tag not in BLOCK else 2 if tag in SPACED else 1
        if tag in ("ul", "ol", "menu", "dl") and counters:
            gap = 1  # a list inside a list stays close
        if tag == "table":
            page.block(2)
            rows: list = []
            tables.append(rows)

            def end_table(rows=rows, page=page):
                tables.pop()
                for line in _layout([r for r in rows if r]):
                    if line:
                        page.block(1)
                        page.lines(line)
                page.block(2)
            closing(end_table)
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            cell = Page()
            pages.append(cell)
            span = node.attrs.get("colspan", "1")
            span = min(1000, int(span)) if span.isascii() and span.isdigit() and int(span) else 1

            def end_cell(cell=cell, span=span, row=tables[-1][-1]):
                pages.pop()
                row.append((_SPACE.sub(" ", cell.result()).strip(), span))
            closing(end_cell)
        elif gap and not (tables and tag in ("thead", "tbody", "tfoot")):
            page.block(gap)
            closing(lambda page=page, gap=gap: page.block(gap))
        if tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start", "1")
            counters.append(["ol", int(start)] if tag == "ol" and start.isascii() and start.isdigit() else [tag, 1])
            closing(counters.pop)
        elif tag == "li":
            kind = counters[-1] if counters else ["ul", 1]
            marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            before = page.indent
            page.lead = before + marker
            page.indent = before + " " * len(marker)

            def end_item(page=page, before=before):
                page.indent = before
                page.lead = ""
            closing(end_item)
        for child in reversed(children):
            work.append(("open", child, visible, pre or tag in ("pre", "textarea"), drawn))
    return pages[0].result()


def visible_text(html: str) -> str:
    return render(parse(html))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html, plus its visible text (a column of that name is replaced)."""
    frame = pages if out == html_col else pages.drop(out)
    names = [c for c in frame.columns if c != html_col]
    at = frame.columns.index(html_col)
    source = frame.columns
    schema = T.StructType([f for f in frame.schema.fields if f.name != html_col] + [T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if h.as_py() is None else visible_text(h.as_py()) for h in part.column(at)]
                yield pa.RecordBatch.from_arrays([part.column(source.index(c)) for c in names] + [pa.array(texts, type=pa.string())],
                                                 names=names + [out])

    return frame.mapInArrow(run, schema)
