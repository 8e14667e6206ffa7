"""Layout-aware text of web pages.

A page becomes a tree (start tags imply the end of elements that cannot hold them), the
tree is laid out as text: hidden elements go, blocks begin lines, paragraphs and the like
keep an empty line around them, list items get marks and indents, table cells are aligned.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, outer_id

# Fixed values of HTML: element groups of the parsing and rendering rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCKS = CLOSES_PARAGRAPH | frozenset("html body li dt dd legend option optgroup caption tr thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure fieldset".split())
HIDDEN = frozenset(
    "head title style script template object iframe noframes noembed audio video canvas datalist "
    "area base link meta param rp".split()
)
# A start tag of the key ends an open element of the value, unless one of the third closes it in.
IMPLIED_ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "td": ("td th", "table tr"),
    "th": ("td th", "table tr"),
    "tr": ("tr", "table"),
    "thead": ("tr thead tbody tfoot caption colgroup", "table"),
    "tbody": ("tr thead tbody tfoot caption colgroup", "table"),
    "tfoot": ("tr thead tbody tfoot caption colgroup", "table"),
    "body": ("head", "html"),
}
IMPLIED_ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in IMPLIED_ENDS.items()}
# Roots of foreign markup, and their elements that hold HTML again.
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
# Elements of them without text on the page.
HIDDEN_FOREIGN = frozenset("title desc metadata defs symbol clippath mask marker pattern style script annotation annotation-xml".split())
# HTML start tags that end foreign markup.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed font h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
# Other texts of svg are not drawn.
SVG_TEXT = frozenset("text foreignobject".split())
# No end tag or implied end reaches out of these.
SCOPES = frozenset("html table td th caption object template".split())
# Parts of a table end at their table only.
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
TABLE_SCOPES = frozenset("html table object template".split())
TABLE_ROWS = frozenset("thead tbody tfoot tr".split())
# Other values are those of the element around.
VISIBILITY = {"visible": True, "initial": True, "hidden": False, "collapse": False}
# Indents do not grow beyond this width, so a page's text stays linear in the page.
WIDEST_INDENT = 300
# Cells up to this width are padded; longer ones are not, so a table's text stays linear in the page.
WIDEST = 80
# Tables inside this many others are not aligned by column: a line is copied that often at most.
ALIGNED_TABLES = 16

_GAPS = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important\s*)?(?=;|$)", re.I)
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds a tree of Nodes and texts from any input."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in BREAKOUT:
            self._leave_foreign()
        foreign = self._foreign()
        if tag in CLOSES_PARAGRAPH:
            self._end({"p"}, SCOPES | {"button"})
        if tag in IMPLIED_ENDS:
            ends, fence = IMPLIED_ENDS[tag]
            fence = fence if tag in TABLE_PARTS else fence | SCOPES
            while self._end(ends, fence):
                pass
        if self.open[-1].tag == "head" and tag not in HIDDEN | {"noscript"}:
            self._close(len(self.open) - 1)
        node = Node(tag, {k: v or "" for k, v in attrs})
        if foreign and tag in HIDDEN_FOREIGN:
            node.attrs["hidden"] = ""
        if foreign and tag == "text":
            node.children.append(" ")  # has a place of its own
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash closes void elements, and those of svg and math."""
        before = len(self.open)
        foreign = tag in FOREIGN or self._foreign()
        self.handle_starttag(tag, attrs)
        if foreign and tag not in VOID and len(self.open) > before and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)

    def _close(self, size: int) -> None:
        """Close all open elements but the first ``size``."""
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()

    def _innermost(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _leave_foreign(self) -> None:
        while self._foreign():
            self._close(self._innermost(FOREIGN))

    def _foreign(self) -> bool:
        """Whether the open elements are in svg or math, and not in HTML inside of them."""
        return self._innermost(FOREIGN) > self._innermost(INTEGRATION)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("br", "p"):
            self._leave_foreign()
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag not in ("html", "body"):
            found = self._end({tag}, (TABLE_SCOPES if tag in TABLE_PARTS else SCOPES) - {tag})
            if tag == "p" and not found:  # stands for an empty paragraph
                self.open[-1].children.append(Node("p", {}))

    def _end(self, tags: set[str] | frozenset[str], fence: frozenset[str]) -> bool:
        """Close the innermost open element of ``tags`` with all inside it, if no fence is in between."""
        place = self._innermost(tags)
        if not place or place < self._innermost(fence):
            return False
        self._close(place)
        return True

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._close(len(self.open) - 1)
        if self._drawn():
            self.open[-1].children.append(data)

    def _drawn(self) -> bool:
        """Whether text is not just in svg, outside of its text elements."""
        return not self.places.get("svg") or self.places["svg"][-1] < self._innermost(SVG_TEXT)


def declared(node: Node, name: str) -> str:
    """Value of a property in the element's own style: the last important one, else the last."""
    found, strong = "", False
    for prop, value, important in _DECLARED.findall(node.attrs.get("style", "")):
        if prop.lower() == name and (important or not strong):
            found, strong = value.lower(), bool(important)
    return found


def cut(node: Node) -> bool:
    """Whether the element goes with all inside it."""
    attrs = node.attrs
    return (
        node.tag in HIDDEN
        or "hidden" in attrs
        or (node.tag == "input" and attrs.get("type", "").lower() == "hidden")
        or (node.tag == "dialog" and "open" not in attrs)
        or declared(node, "display") == "none"
        or (node.tag in TABLE_ROWS and declared(node, "visibility") == "collapse")
    )


def drawn(node: Node, around: bool) -> bool:
    """Whether the element's own text is drawn; elements inside it may say otherwise."""
    value = declared(node, "visibility")
    return around if value not in VISIBILITY else VISIBILITY[value]


class Layout:
    """Lines of text; ``gap`` is an empty line that the next text asks for."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written
        self.gap = self.space = False
        self.mark = ""  # of a list item that has not begun

    def text(self, data: str, indent: str) -> None:
        words = _GAPS.sub(" ", data)
        if words == " ":
            self.space = True
            return
        if not words:
            return
        if self.parts and (self.space or words[0] == " ") and self.parts[-1][-1:] not in ("", " "):
            self.parts.append(" ")
        self._begin(indent)
        self.parts.append(words.strip(" "))
        self.space = words[-1] == " "

    def kept(self, data: str, indent: str) -> None:
        """Preformatted text."""
        first, *more = data.replace("\r\n", "\n").split("\n")
        if first:
            self._begin(indent)
            self.parts.append(first)
        for part in more:
            self._begin(indent)
            self.end_line()
            if part:
                self._begin(indent)
                self.parts.append(part)

    def _begin(self, indent: str) -> None:
        if not self.parts:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = self.space = False
            self.parts.append(indent[: len(indent) - len(self.mark)] + self.mark)
            self.mark = ""

    def end_line(self, forced: bool = False) -> None:
        if self.parts or forced:
            self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def rows(self, lines: list[str], indent: str) -> None:
        for line in lines:
            self._begin(indent)
            self.parts.append(line)
            self.end_line()


def finish(task: Generator) -> object:
    """Run a generator that yields the tasks whose results it needs, with a stack of its own."""
    stack, result = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as done:
            stack.pop()
            result = done.value
    return result


def deeper(indent: str, width: int) -> str:
    return indent if len(indent) >= WIDEST_INDENT else indent + " " * width


def lay_out(node: Node, out: Layout, indent: str = "", pre: bool = False, seen: bool = True, tables: int = 0) -> Generator:
    """Lay out what is in ``node``, whose own text is ``seen`` or not, inside of ``tables`` tables."""
    number, step = _numbers(node)
    cells = False  # whether the next cell stands beside another
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.kept(child, indent) if pre else out.text(child, indent)
            continue
        tag = child.tag
        if cut(child):
            continue
        here = drawn(child, seen)
        if tag == "br":
            out.end_line(here and bool(out.lines) and not out.gap)
            continue
        block = tag in BLOCKS
        if block:
            out.end_line()
            out.gap = out.gap or (tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li"))
        if tag == "table" and tables < ALIGNED_TABLES:
            out.rows((yield table_lines(child, here, tables + 1)), indent)
        elif tag == "tr":
            cells = False
            yield lay_out(child, out, indent, pre, here, tables)
        elif tag == "li":
            number = _whole(child, "value", number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            out.mark = mark if here else ""
            number += step
            yield lay_out(child, out, deeper(indent, len(mark)), pre, here, tables)
            out.mark = ""
        elif tag in ("dd", "blockquote"):
            yield lay_out(child, out, deeper(indent, 2), pre, here, tables)
        elif tag == "input":
            if here:
                out.text(child.attrs.get("value", ""), indent)
        elif tag in ("td", "th"):  # without columns
            out.text(" | " if cells and here else " ", indent)
            cells = cells or tables >= ALIGNED_TABLES
            yield lay_out(child, out, indent, pre, here, tables)
        else:
            yield lay_out(child, out, indent, pre or tag in ("pre", "textarea"), here, tables)
        if block:
            out.end_line()
            out.gap = out.gap or (tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li"))


def _whole(node: Node, name: str, default: int) -> int:
    found = _NUMBER.match(node.attrs.get(name, ""))
    return int(found[1]) if found else default


def _numbers(node: Node) -> tuple[int, int]:
    """First number of a list's items, and the step to the next."""
    if node.tag != "ol" or "reversed" not in node.attrs:
        return _whole(node, "start", 1), 1
    items = sum(not isinstance(c, str) and c.tag == "li" and not cut(c) for c in node.children)
    return _whole(node, "start", items), -1


def _span(cell: Node) -> int:
    value = cell.attrs.get("colspan", "1")
    return max(1, min(100, int(value))) if re.fullmatch(r"[0-9]{1,4}", value) else 1


def table_lines(table: Node, seen: bool, tables: int) -> Generator:
    """Rows of a table with cells aligned by column, a bar between cells; all else comes before them."""
    before: list[str] = []
    rows: list[list[tuple[list[str], int]]] = []
    row: list[tuple[list[str], int]] | None = None  # that cells go to; without one they begin one
    open_parts = [(iter(table.children), seen)]
    while open_parts:
        children, shown = open_parts[-1]
        for child in children:
            if isinstance(child, str):
                if shown and child.strip(" \t\n\r\f"):
                    before.append(_GAPS.sub(" ", child).strip(" "))
            elif cut(child):
                continue
            elif child.tag in TABLE_ROWS or child.tag == "colgroup":
                row = None
                if child.tag == "tr":
                    rows.append(row := [])
                open_parts.append((iter(child.children), drawn(child, shown)))
                break
            elif child.tag in ("td", "th"):
                if row is None:
                    rows.append(row := [])
                row.append(((yield text_lines(child, drawn(child, shown), tables)), _span(child)))
            else:  # captions and what does not belong into a table
                before += yield text_lines(_wrapped(child), shown, tables)
        else:
            open_parts.pop()
            row = None
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for lines, span in row:
            if span == 1:
                width = max(map(len, lines), default=0)
                widths[column] = max(widths.get(column, 0), width if width <= WIDEST else 0)
            column += span
    out = before
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            column, parts = 0, []
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(column, column + span)) + 3 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(width))
                column += span
            out.append(" | ".join(parts).rstrip())
    return out


def _wrapped(node: Node) -> Node:
    around = Node("div", {})
    around.children.append(node)
    return around


def text_lines(node: Node, seen: bool = True, tables: int = 0) -> Generator:
    out = Layout()
    yield lay_out(node, out, "", False, seen, tables)
    out.end_line()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return out.lines


def page_text(html: str) -> str:
    """All visible text of a page."""
    tree = Tree()
    # A tag that the page breaks off is no text; the parser would try it at each of its "<" again.
    broken = re.search(r"<[/!?a-zA-Z]", html[(last := html.rfind(">") + 1) :])
    tree.feed(html[: last + broken.start()] if broken else html)
    tree.close()
    return "\n".join(finish(text_lines(tree.root)))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [page_text(html) for html in batch["body"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(texts, pa.string())], ["doc", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Visible text of every page: the id and ``text``.

    Hidden are elements that browsers do not show (head, script, style, template, embedded
    content, svg apart from its text elements), those with ``hidden`` or ``display:none`` of their own,
    and closed dialogs, each with all inside it; ``visibility`` holds for the elements inside until
    one of them says otherwise. Style sheets and scripts are not applied. White space runs are one
    space except in ``pre`` and ``textarea``. A table inside of 16 others keeps its rows and the
    bars between cells, but they are not aligned. A null, empty or textless page has an empty
    text; broken markup never fails. Repeated pages and ids are rendered on their own, a
    null id stays null, an empty table gives no rows.
    """
    rows = documents(pages, id_col, html_col)
    return rows.mapInArrow(_render, "doc long, text string").select(outer_id().alias(id_col), "text")
