"""HTML extraction by layout-aware rendering.

A tree builder closes what HTML leaves open (paragraphs, list items, table rows and cells), visibility rules drop
what a reader doesn't see, and a renderer emits all visible text: blocks on lines of their own, paragraphs with a
blank line between them, list items with markers and indents, and table cells in aligned columns. Formulas and the texts
of drawings are text, and so are the labels of buttons. Visibility is that of elements, attributes and style attributes; the
rules of style sheets aren't looked at.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, table

#: Elements deeper than this hang from the last one within, as browsers do it too.
DEPTH = 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas".split())
#: In drawings and formulas: what isn't shown, where HTML stands again, and the HTML that ends them (the parsing standard's list).
UNDRAWN = frozenset("defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
WITHIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = SPACED | frozenset("html body div section article header footer main nav aside address form fieldset legend li dt dd figcaption details summary caption center dir menu tr thead tbody tfoot td th".split())
#: What a start tag closes, up to the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: What can stand in a head; anything else ends it.
HEADED = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
#: Where only rows, cells and their groups can stand; what else is there is shown before the table.
ROWED = frozenset("table thead tbody tfoot tr colgroup".split())
PARTS = frozenset("thead tbody tfoot tr td th caption colgroup".split())
CELLS = frozenset("td th caption".split())
#: Widest column that cells are padded to; wider cells stand as they are and push the rest of their line.
WIDE = 80
#: Columns beyond this place aren't aligned any more, so that lines don't grow with a table's columns.
FAR = 400
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_MAY_HIDE = re.compile(r"hidden|none|visib|&#", re.I)
_QUOTED_STYLE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|\([^)]*\)", re.S)
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Element:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attribute(self, name: str) -> str:
        return attributes(self.attrs).get(name, "").strip() if name in self.attrs.lower() else ""

    def number(self, name: str, default: int, most: int) -> int:
        found = re.match(r"[-+]?\d{1,9}", self.attribute(name))
        return min(int(found[0]), most) if found else default


def _tag_ends(source: str) -> tuple[list[int], list[int]]:
    """Places of >, " and ' and, for each, where a tag ends that is open there outside of quotes; -1 if it never does."""
    places = [m.start() for m in _SPECIAL.finditer(source)]
    ends, same = [-1] * (len(places) + 1), {}
    for i in range(len(places) - 1, -1, -1):
        mark = source[places[i]]
        if mark == ">":
            ends[i] = places[i]
        else:
            if mark in same:
                ends[i] = ends[same[mark] + 1]
            same[mark] = i
    return places, ends


def _parts(source: str) -> Iterator[tuple[str, str, str, int]]:
    """Texts, CDATA sections, start and end tags as (kind, text or name, attributes, place after it). What the caller
    sends is where to go on. Each place of the source is looked at a few times at most, however broken the page is."""
    places, ends = _tag_ends(source)
    at, size, near, last, no_cdata = 0, len(source), 0, source.rfind(">"), False
    while at < size:
        if source[at] != "<":
            end = source.find("<", at)
            end = size if end < 0 else end
            part = ("text", source[at:end], "", end)
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 2)
            at = size if end < 0 else end + 3
            continue
        elif not no_cdata and source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            if end < 0:
                no_cdata = True
                continue
            part = ("cdata", source[at + 9 : end], "", end + 3)
        elif last > at and source.startswith(("<!", "<?"), at):
            at = source.find(">", at) + 1
            continue
        else:
            found = _NAME.match(source, at)
            if found and not found[1]:
                near = bisect_left(places, found.end(), near)
                end = ends[near]
            else:
                end = source.find(">", found.end()) if found and last >= found.end() else -1
            if not found or end < 0:
                part = ("text", "<", "", at + 1)
            else:
                part = ("end" if found[1] else "start", found[2].lower(), source[found.end() : end], end + 1)
        moved = yield part
        at = moved or part[3]


def build_tree(source: str) -> Element:
    """The document's elements; texts are strings among the children."""
    root = Element("html")
    stack, end = [root], len(source)
    islands: list[int] = []  # places of open drawings and formulas
    parts, moved = _parts(source), None
    while True:
        try:
            kind, value, attrs, at = parts.send(moved)
        except StopIteration:
            break
        moved = None
        if kind == "text":
            _text(stack, html.unescape(value))
        elif kind == "cdata":
            _text(stack, value)
        elif kind == "end":
            tag = value
            if tag == "br":
                stack[-1].kids.append(Element("br"))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("table", "td", "th") and (tag not in BLOCKS or tag == "form"):
                    break
        else:
            tag = value
            if tag == "html":
                continue
            while islands and islands[-1] >= len(stack):
                islands.pop()
            foreign = bool(islands) and not any(e.tag in WITHIN for e in stack[islands[-1] + 1 :])
            if foreign and tag in BREAKOUT:
                del stack[islands.pop() :]
                foreign = False
            if stack[-1].tag == "head" and tag not in HEADED:
                stack.pop()
            _close_implied(stack, tag)
            if tag in PARTS or tag == "table":
                _clear_to_rows(stack, tag)
            elif tag == "form" and stack[-1].tag in ROWED and _table_at(stack):
                continue
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                _open(stack, Element("tr"))
            made = Element(tag, attrs)
            if tag in PARTS or tag == "col" or not _before_table(stack, made):
                stack[-1].kids.append(made)
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(source, at)
                after = source.find(">", close.end()) + 1 if close else 0
                inner = source[at : close.start()] if after else source[at:]
                if tag == "textarea":
                    made.kids.append(html.unescape(inner))
                moved = after or end
            elif tag not in VOID and not (attrs.endswith("/") and (foreign or tag in ("svg", "math", "path", "use", "circle", "rect"))):
                if len(stack) < DEPTH:
                    if tag in ("svg", "math"):
                        islands.append(len(stack))
                    stack.append(made)
    return root


def _text(stack: list[Element], text: str) -> None:
    if text and not text.isspace():
        if stack[-1].tag == "head":
            stack.pop()
        if _before_table(stack, text):
            return
    stack[-1].kids.append(text)


def _table_at(stack: list[Element]) -> int:
    """The place of the table whose rows are open, no cell among them; 0 if there is none."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in CELLS:
            return 0
        if stack[depth].tag == "table":
            return depth
    return 0


def _before_table(stack: list[Element], made: Element | str) -> bool:
    """Puts what stands loosely among a table's rows before the table, as browsers do."""
    at = _table_at(stack) if stack[-1].tag in ROWED else 0
    if not at:
        return False
    if stack[-1].tag == "colgroup":
        stack.pop()
    beside = stack[at - 1].kids
    beside.insert(len(beside) - 1, made)
    return True


def _clear_to_rows(stack: list[Element], tag: str) -> None:
    """Ends loose elements among a table's rows before its next part, and a table before one that isn't in a cell."""
    at = _table_at(stack)
    if not at:
        return
    if tag == "table":
        del stack[at:]
        return
    while len(stack) > at + 1 and (stack[-1].tag not in ROWED or stack[-1].tag == "colgroup" or tag in ("caption", "colgroup")):
        stack.pop()


def _open(stack: list[Element], made: Element) -> None:
    stack[-1].kids.append(made)
    if len(stack) < DEPTH:
        stack.append(made)


def _close_implied(stack: list[Element], tag: str) -> None:
    closes, bounds = CLOSES.get(tag, (set(), set()))
    for depth in range(len(stack) - 1, 0, -1):
        name = stack[depth].tag
        if name in bounds:
            break
        if name in closes:
            del stack[depth:]
            if tag not in ("tr", "thead", "tbody", "tfoot"):
                break
    if tag in BLOCKS:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in BLOCKS:
                break


class Page:
    """Lines of text under way: a current line, and how many blank lines are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.lead, self.gap, self.space = [], "", 0, False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def end_line(self) -> None:
        if self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append(self.lead + "".join(self.line))
            self.line, self.gap = [], 0
            self.lead = " " * len(self.lead)
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced


def attributes(source: str) -> dict[str, str]:
    """Names and values of a start tag's attributes; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def _style(style: str) -> dict[str, str]:
    """The last declaration of each property; important ones come first."""
    said: dict[str, tuple[bool, str]] = {}
    for declaration in _QUOTED_STYLE.sub(" ", style).lower().split(";"):
        name, _, value = declaration.partition(":")
        name, (value, mark, _) = name.strip(), value.partition("!")
        if value.strip() and (mark or not said.get(name, (False,))[0]):
            said[name] = bool(mark), value.strip()
    return {name: value for name, (_, value) in said.items()}


def _seen(node: Element, visible: bool = True) -> bool | None:
    """Whether an element's own texts are visible, given whether its parent's are; None if nothing in it is displayed."""
    if node.tag in UNSEEN or node.tag in UNDRAWN:
        return None
    if not node.attrs or not _MAY_HIDE.search(node.attrs):
        return visible
    found = attributes(node.attrs)
    style = _style(found.get("style", ""))
    if "hidden" in found or "none" in (style.get("display"), found.get("display")) or (node.tag == "input" and found.get("type", "").strip().lower() == "hidden"):
        return None
    said = style.get("visibility", found.get("visibility"))
    return said == "visible" if said in ("visible", "hidden", "collapse") else visible


def _render(node: Element, page: Page, marker: list | None = None, pre: bool = False, visible: bool = True) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            if not visible:
                continue
            if not pre:
                page.text(kid)
                continue
            for i, line in enumerate(kid.split("\n")):
                if i:
                    page.line = page.line or [""]
                    page.end_line()
                if line:
                    page.line.append(line.rstrip("\r"))
            continue
        tag = kid.tag
        seen = _seen(kid, visible)
        if seen is None:
            continue
        if tag == "br":
            if visible:
                page.line = page.line or [""]
                page.end_line()
        elif tag == "wbr":
            pass
        elif tag == "svg":
            _render_drawing(kid, page, seen)
        elif tag == "input":
            if seen and kid.attribute("type").lower() in ("submit", "reset", "button"):
                page.text(f" {kid.attribute('value')} ")
        elif tag == "textarea":
            page.block(False)
            _render(kid, page, marker, True, seen)
            page.block(False)
        elif tag == "table":
            page.block(True)
            _render_table(kid, page, seen)
            page.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(marker is None)
            _render(kid, page, [kid.number("start", 1, 10**9)] if tag == "ol" else [None], pre, seen)
            page.block(marker is None)
        elif tag == "li":
            page.block(False)
            outer, number = page.lead, (marker or [None])[0]
            bullet = "- " if number is None else f"{number}. "
            if marker and number is not None:
                marker[0] += 1
            page.lead = outer + bullet
            _render(kid, page, marker or [None], pre, seen)
            page.end_line()
            page.lead = outer
        elif tag in BLOCKS:
            page.block(tag in SPACED)
            outer = page.lead
            if tag in ("blockquote", "dd"):
                page.lead = " " * len(outer) + "  "
            _render(kid, page, marker, pre or tag == "pre", seen)
            page.end_line()
            page.lead = " " * len(outer) if outer != page.lead and tag in ("blockquote", "dd") else page.lead
            page.block(tag in SPACED)
        else:
            _render(kid, page, marker, pre, seen)
            if tag in ("option", "mtr"):
                page.end_line()
            elif tag in ("mtd", "mfrac"):
                page.space = True


def _render_drawing(node: Element, page: Page, visible: bool) -> None:
    """The texts of a drawing, each on a line, and the HTML that stands in it; other strings there aren't drawn."""
    for kid in node.kids:
        if isinstance(kid, str) or (seen := _seen(kid, visible)) is None:
            continue
        if kid.tag in ("text", "foreignobject"):
            page.block(False)
            _render(kid, page, visible=seen)
            page.block(False)
        else:
            _render_drawing(kid, page, seen)


class Spans:
    """Columns that cells of earlier rows reach into: separate stretches, merged where they touch, each part with the row
    in which it ends. Columns that cells overlap on are counted, and end when the last of them does."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.until: dict[int, list[tuple[int, int]]] = {}
        self.row, self.more = 0, {}

    def free(self, column: int) -> int:
        """The first free column from this one on."""
        at = bisect_right(self.begins, column) - 1
        return self.ends[at] if at >= 0 and self.ends[at] > column else column

    def take(self, first: int, last: int, rows: int | None) -> None:
        """Columns first to last - 1 are taken up to row number `rows`, for good if that is None."""
        if rows is not None:
            self.until.setdefault(rows, []).append((first, last))
        low, high = bisect_left(self.ends, first), bisect_right(self.begins, last)
        for a, b in zip(self.begins[low:high], self.ends[low:high], strict=True):
            for column in range(max(a, first), min(b, last)):
                self.more[column] = self.more.get(column, 0) + 1
        a, b = min([first, *self.begins[low:high]]), max([last, *self.ends[low:high]])
        self.begins[low:high], self.ends[low:high] = [a], [b]

    def reach(self, row: int) -> None:
        """Frees what ends before this row."""
        for number in range(self.row, row):
            for first, last in self.until.pop(number, ()):
                if not self.more:
                    self._free(first, last)
                    continue
                begin = first
                for column in range(first, last):
                    if column in self.more:
                        self._free(begin, column)
                        begin = column + 1
                        self.more[column] -= 1
                        if not self.more[column]:
                            del self.more[column]
                self._free(begin, last)
        self.row = row

    def _free(self, first: int, last: int) -> None:
        if first < last:
            at = bisect_right(self.begins, first) - 1
            a, b = self.begins[at], self.ends[at]
            parts = [(x, y) for x, y in ((a, first), (last, b)) if x < y]
            self.begins[at : at + 1], self.ends[at : at + 1] = [x for x, _ in parts], [y for _, y in parts]


def _rows(node: Element, visible: bool) -> Iterator[tuple[Element, bool]]:
    for kid in node.kids:
        if isinstance(kid, Element) and (seen := _seen(kid, visible)) is not None:
            if kid.tag in ("tr", "caption"):
                yield kid, seen
            elif kid.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(kid, seen)


def _cell_lines(cell: Element, visible: bool) -> list[str]:
    inner = Page()
    _render(cell, inner, visible=visible)
    inner.end_line()
    return inner.lines


def _render_table(node: Element, page: Page, visible: bool) -> None:
    """Cells begin where their column does, columns two spaces apart; a cell's own lines stay lines of its row.

    A cell that spans columns or rows takes their places. Columns are as wide as their cells of one column that aren't
    wider than WIDE, and a column without text takes no room. None begins beyond place FAR.
    """
    rows: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    taken = Spans()
    for row, seen in _rows(node, visible):
        if row.tag == "caption":
            for line in _cell_lines(row, seen):
                page.line.append(line)
                page.end_line()
            continue
        found, column = [], 0
        taken.reach(len(rows))
        for cell in row.kids:
            if not isinstance(cell, Element) or cell.tag not in ("td", "th") or (shown := _seen(cell, seen)) is None:
                continue
            column = taken.free(column)
            lines = _cell_lines(cell, shown)
            across, down = max(1, cell.number("colspan", 1, 1000)), cell.number("rowspan", 1, 65534)
            found.append((column, lines))
            if across == 1:
                widths[column] = max([widths.get(column, 0), *(len(line) for line in lines if len(line) <= WIDE)])
            if down > 1 or down == 0:  # 0: down to the last row
                taken.take(column, column + across, len(rows) + down - 1 if down else None)
            column += across
        if found:
            rows.append(found)
    begins, at = {}, 0
    for column in sorted(widths.keys() | {c for row in rows for c, _ in row}):
        begins[column] = min(at, FAR)
        at += widths[column] + 2 if widths.get(column) else 0
    for row in rows:
        for k in range(max(len(lines) for _, lines in row)):
            line = ""
            for column, lines in row:
                if k < len(lines) and lines[k]:
                    line = (line.ljust(begins[column]) if not line or len(line) + 2 <= begins[column] else line + "  ") + lines[k]
            page.line.append(line.rstrip())
            page.end_line()
    # elements too deep to be opened as rows
    loose = Element("div")
    loose.kids = [k for k in node.kids if (isinstance(k, str) and k.strip()) or (isinstance(k, Element) and k.tag not in ("tr", "caption", "thead", "tbody", "tfoot", "colgroup", "col"))]
    _render(loose, page, visible=visible)


def html_text(source: str | None) -> str:
    """The visible text of a page; null and empty pages give an empty string."""
    page = Page()
    _render(build_tree((source or "").replace("\x00", "")), page)
    page.end_line()
    return "\n".join(line.rstrip() for line in page.lines)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of keep and text: the visible text of every whole page, row for row. Null html gives ''. A column of
    keep that is named like a result gives way to it."""
    keep = apart(keep, "text")
    schema = pages.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [html_text(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)


def query(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.char_length("text").cast("long").alias("n_chars"), "text")
