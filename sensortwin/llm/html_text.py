"""Layout-aware text of HTML pages.

A tree builder reads the markup with the implied tags of HTML (a block start ends an open paragraph,
``li``, ``dt``/``dd``, ``option``, table rows and cells end their open siblings, void elements have no
content, script-like elements hold raw text).  Elements that a browser does not show are left out:
script-like and head content, the ``hidden`` attribute, ``display:none`` styles, hidden inputs, closed
dialogs, and the content of closed ``details`` but for the summary.  ``visibility`` is inherited: a
visible element within a hidden one is shown.  Of inline SVG the ``text`` elements and foreign objects
are shown, of MathML all but annotations, with ``/`` in fractions; of ``object`` the content where no
``data`` is to be loaded in its place.

Everything else is rendered in document order: white space collapses as in a browser, blocks start on
a new line, blocks with margins are divided by a blank line, ``br`` and ``pre`` keep their breaks,
list items are marked and indented by depth.  A table is a grid: cells are laid out as blocks of their own, with their
breaks, lists and tables, and stand in columns as wide as their widest line; ``colspan`` and ``rowspan`` cells keep the
places they cover.

Nulls and edge cases: a null or empty page has an empty text; broken or endless markup never fails,
what is open at the end is closed; nesting of any depth, of tables too, uses no recursion (inner tables are laid out
first); very long pages are rendered whole; every input row gives an output row, repeated rows too; only the id and the
html are read.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sensortwin.llm.common import map_rows, texts_of

#: Between two columns of a table.
GAP = "  "
# fixed values: the largest spans of HTML
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

_MARK = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=)*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"[ \t\r\n\f]+")
_NONE = re.compile(r"(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
# fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("script style template head title noembed noframes iframe noscript datalist audio video canvas rp area".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
BLOCK = MARGIN | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li "
    "listing main nav optgroup option search section select summary thead tbody tfoot tr td th".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split())
#: A start tag ends these open elements, unless one of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Never shown within SVG or MathML.
FOREIGN_UNSEEN = frozenset("title desc metadata defs symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
#: Within SVG or MathML these hold HTML again.
TO_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: A start tag of these ends open SVG and MathML.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split())
WALLS = frozenset("td th caption table template html".split())
P_WALLS = WALLS | TO_HTML | {"button"}


class Node:
    """``seen``: whether the element and its content are rendered; ``hidden``: takes room without being
    shown; ``kind``: what its text belongs to, html, svg (not shown), svgtext or math."""

    __slots__ = ("tag", "children", "seen", "attrs", "hidden", "kind", "lines")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, seen: bool = True, hidden: bool = False, kind: str = "html"):
        self.tag, self.attrs, self.seen, self.hidden, self.kind, self.children = tag, attrs or {}, seen, hidden, kind, []
        self.lines: list[str] = []  # of a table, once it is laid out


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(raw):
        if v[:1] in "\"'" and v:
            v = v[1:-1]
        out.setdefault(k.lower(), html.unescape(v))
    return out


def _node(tag: str, attrs: dict[str, str], parent: Node) -> Node:
    """An element with what it inherits."""
    kind, foreign = parent.kind, parent.kind != "html"
    if tag in ("svg", "math"):
        kind = tag
    elif foreign and tag in TO_HTML:
        kind = "html"
    elif kind == "svg" and tag == "text":
        kind = "svgtext"
    seen = _visible(tag, attrs) and not (foreign and (tag in FOREIGN_UNSEEN or attrs.get("display") == "none"))
    hidden = parent.hidden
    said = _VISIBILITY.findall(attrs["style"]) if "style" in attrs else ()
    value = said[-1].lower() if said else attrs.get("visibility", "") if foreign or kind != "html" else ""
    if value == "collapse" and tag in ("tr", "thead", "tbody", "tfoot"):
        seen = False
    elif value in ("visible", "hidden", "collapse"):
        hidden = value != "visible"
    return Node(tag, attrs, seen, hidden, kind)


def _visible(tag: str, attrs: dict[str, str]) -> bool:
    if tag in UNSEEN or "hidden" in attrs or tag == "object" and "data" in attrs:
        return False
    if tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in attrs:
        return False
    return not ("style" in attrs and _NONE.search(attrs["style"]))


def parse(markup: str) -> Node:
    """Tree of a page with implied tags resolved."""
    root = Node("html")
    stack, at, end = [root], 0, len(markup)

    def text(piece: str) -> None:
        if not piece:
            return
        if stack[-1].tag == "head" and piece.strip(" \t\r\n\f"):
            open_[stack.pop().tag] -= 1  # the body begins without a tag
        inside = stack[-1]
        if inside.hidden or inside.kind == "svg" or inside.kind == "math" and not piece.strip(" \t\r\n\f"):
            return
        inside.children.append(html.unescape(piece) if "&" in piece else piece)

    open_ = Counter()

    def pop_to(tags, walls) -> None:
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                open_.subtract(n.tag for n in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    while at < end:
        m = _MARK.search(markup, at)
        if not m:
            text(markup[at:])
            break
        text(markup[at : m.start()])
        at = m.end()
        if m.group() != "<":
            continue  # comment, doctype, processing instruction
        m = _TAG.match(markup, m.start())
        if not m:
            break  # the text ends inside a tag
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not open_["p"]:
                stack[-1].children.append(Node("p"))
            elif tag not in VOID and tag not in ("html", "body"):
                pop_to({tag}, () if tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") else WALLS - {tag})
            continue
        if tag == "html":
            continue
        if tag in BREAKS_OUT:
            while stack[-1].kind != "html":
                open_[stack.pop().tag] -= 1
        if tag in ENDS_P:
            pop_to({"p"}, P_WALLS)
        if tag in ENDS:
            tags, walls = ENDS[tag]
            for _ in range(4):  # a section ends its row, the row its cell
                before = len(stack)
                pop_to(tags, walls)
                if len(stack) == before:
                    break
        elif stack[-1].tag == "head" and tag not in ("meta", "title", "link", "base", "script", "style", "noscript", "template"):
            open_[stack.pop().tag] -= 1  # the body begins without a tag
        attrs = _attributes(m.group(3)) if m.group(3).strip() else {}
        node = _node(tag, attrs, stack[-1])
        closed = m.group(3).endswith("/") and (tag in ("svg", "math") or stack[-1].kind != "html")
        stack[-1].children.append(node)
        if closed:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(markup, at)
            body = markup[at : close.start()] if close else markup[at:]
            if tag in ("textarea", "xmp") and not node.hidden:
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            at = close.end() if close else end
        elif tag not in VOID:
            stack.append(node)
            open_[tag] += 1
    return root


def width(s: str) -> int:
    """Columns of a text: wide characters take two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Page:
    """Lines of text with collapsed spaces and margins."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.mark: str | None = None  # a list marker waits for its item's first text

    def put(self, piece: str, pre: bool, indent: str) -> None:
        if pre:
            parts = piece.split("\n")
            for k, x in enumerate(parts):
                if k:
                    self.end(force=True)
                if x:
                    self._add(x, indent)
            return
        if not piece:
            return
        words = _SPACE.sub(" ", piece)
        if words[0] == " ":
            self.space = bool(self.line)
            words = words[1:]
        if not words:
            return
        tail = words[-1] == " "
        self._add((" " if self.space else "") + (words[:-1] if tail else words), indent)
        self.space = tail

    def _add(self, x: str, indent: str) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(self.mark if self.mark is not None else indent)
            self.mark = None
        self.line.append(x)
        self.space = False

    def end(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


@dataclass
class _Cell:
    """A cell's lines and the grid places it takes."""
    lines: list[str]
    row: int
    column: int
    columns: int
    rows: int


def _span(node: Node, name: str, most: int) -> int | None:
    """A span attribute; 0 is None (up to the end of the row group)."""
    value = node.attrs.get(name, "1")
    if not (value.isascii() and value.isdigit()):
        return 1
    return min(int(value[:9]), most) or (None if name == "rowspan" else 1)


def _rows(table: Node) -> tuple[list[Node], list[list[list[Node]]]]:
    """Captions, and the rows of a table as cells by row group; loose content makes a row of its own."""
    captions, groups, todo = [], [[]], list(reversed(table.children))
    while todo:
        n = todo.pop()
        if n is None:  # a row group ends
            groups.append([])
        elif isinstance(n, str):
            if n.strip():
                groups[-1].append([_wrap([n])])
        elif not n.seen:
            continue
        elif n.tag == "caption":
            captions.append(n)
        elif n.tag in ("thead", "tbody", "tfoot"):
            groups.append([])
            todo += [None, *reversed(n.children)]
        elif n.tag == "tr":
            row, loose = [], []
            for c in n.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    if c.seen:
                        row.append(c)
                else:
                    loose.append(c)
            if any(isinstance(c, Node) or c.strip() for c in loose):
                row.append(_wrap(loose))
            groups[-1].append(row)
        elif n.tag not in ("col", "colgroup"):
            groups[-1].append([_wrap([n])])
    return captions, groups


def _wrap(children: list) -> Node:
    out = Node("td")
    out.children = children
    return out


def _place(groups: list[list[list[Node]]]) -> tuple[list[_Cell], int]:
    """Every cell on the grid: a cell takes the first free column of its row, and spans keep the places they cover."""
    cells, at = [], 0
    for group in groups:
        until: dict[int, int] = {}  # column -> first row that is free again
        for k, row in enumerate(group):
            column = 0
            for node in row:
                while until.get(column, 0) > at + k:
                    column += 1
                columns = _span(node, "colspan", MAX_COLSPAN)
                rows = min(_span(node, "rowspan", MAX_ROWSPAN) or len(group), len(group) - k)
                if rows > 1:
                    until.update((column + c, at + k + rows) for c in range(columns))
                cells.append(_Cell(render(node).split("\n"), at + k, column, columns, rows))
                column += columns
        at += len(group)
    return cells, at


def _table_lines(table: Node) -> list[str]:
    """The lines of a table whose inner tables have theirs already."""
    captions, groups = _rows(table)
    lines = [x for c in captions if (t := render(c)) for x in t.split("\n")]
    cells, n_rows = _place(groups)
    if len(cells) == 1:
        return lines + [x for x in cells[0].lines if len(cells[0].lines) > 1 or x]
    starts = sorted({c.column for c in cells})  # columns in which a cell begins; others have no room of their own
    covered = {id(c): range(bisect.bisect_left(starts, c.column), bisect.bisect_left(starts, c.column + c.columns)) for c in cells}
    widths = [0] * len(starts)
    for c in sorted(cells, key=lambda c: len(covered[id(c)])):
        over = covered[id(c)]
        room = sum(widths[k] for k in over[:-1]) + len(GAP) * (len(over) - 1)
        widths[over[-1]] = max(widths[over[-1]], max(map(width, c.lines)) - room)
    heights = [0] * n_rows
    for c in sorted(cells, key=lambda c: c.rows):
        high = len(c.lines) if len(c.lines) > 1 or c.lines[0] else 0
        last = c.row + c.rows - 1
        heights[last] = max(heights[last], high - sum(heights[c.row : last]))
    tops = [0, *itertools.accumulate(heights)]
    left = [0, *itertools.accumulate(w + len(GAP) for w in widths)]
    grid: list[list[tuple[int, str]]] = [[] for _ in range(tops[-1])]
    for c in cells:
        for k, line in enumerate(c.lines):
            if line:
                grid[tops[c.row] + k].append((left[covered[id(c)][0]], line))
    for row in grid:
        out, at = [], 0
        for place, line in sorted(row):
            out.append(" " * (place - at) + line)
            at = place + width(line)
        lines.append("".join(out).rstrip())
    return lines


def _lay_out_tables(root: Node) -> None:
    """Give every shown table its lines, inner ones first, so that no depth of nesting needs recursion."""
    tables, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "table":
            tables.append(n)
        todo += [c for c in n.children if isinstance(c, Node) and c.seen]
    for t in reversed(tables):
        t.lines = _table_lines(t)


def render(root: Node) -> str:
    """Text of a tree whose tables are laid out (see the module's text)."""
    page = _Page()
    # (node, False) enters it, (node, True) leaves it; pre and indent hold for its content
    todo: list[tuple] = [(c, False, False, "", None) for c in reversed(root.children)]
    numbers: list[int] = []
    while todo:
        n, leave, pre, indent, item = todo.pop()
        if isinstance(n, str):
            page.put(n, pre, indent)
            continue
        if leave:
            if n.tag in ("ul", "ol", "menu", "dir"):
                numbers.pop()
            page.mark = None if n.tag == "li" else page.mark
            page.end()
            page.blank |= n.tag in MARGIN and not (numbers and n.tag in ("ul", "ol", "menu"))
            continue
        if not n.seen:
            continue
        tag = n.tag
        if tag == "br":
            page.end(force=not n.hidden)
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "input":
            if not n.hidden and n.attrs.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number"):
                page.put(n.attrs.get("value", ""), False, indent)
            continue
        if tag in ("td", "th") and not page.space:
            page.space = bool(page.line)
        if tag in BLOCK:
            page.end()
            page.blank |= tag in MARGIN and not (numbers and tag in ("ul", "ol", "menu"))
        if tag == "hr":
            page.put("" if n.hidden else "----", True, indent)
            page.end()
            page.blank = True
            continue
        if tag == "table":
            for line in n.lines:
                if line:
                    page.put(line, True, indent)
                page.end(force=True)
            page.blank = True
            continue
        inner = indent
        if tag in ("ul", "ol", "menu", "dir"):
            start = n.attrs.get("start", "1")
            numbers.append(int(start) - 1 if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else -1 if tag != "ol" else 0)
            todo.append((n, True, pre, indent, tag))
            todo += [(c, False, pre, indent, tag) for c in reversed(n.children)]
            continue
        if tag == "li":
            if item == "ol" and numbers:
                numbers[-1] += 1
                mark = f"{numbers[-1]}. "
            else:
                mark = "- "
            page.mark, inner = None if n.hidden else indent + mark, indent + " " * len(mark)
        elif tag in ("dd", "blockquote"):
            inner = indent + "  "
        if tag == "q" and not n.hidden:
            page.put('"', pre, indent)
        inside = n.children
        if n.kind == "svgtext" and tag == "text":  # a label of its own
            page.put(" ", False, indent)
            todo.append((" ", False, False, indent, None))
        elif n.kind == "math" and tag == "mfrac" and len(inside) == 2:
            inside = [inside[0], "/", inside[1]] if not n.hidden else inside
        elif n.kind == "math" and tag in ("mtd", "mtr"):
            page.put(" ", False, indent)
        if tag == "details" and "open" not in n.attrs:
            inside = [c for c in n.children if isinstance(c, Node) and c.tag == "summary"]
        if tag in BLOCK:
            todo.append((n, True, pre, indent, None))
        elif tag == "q" and not n.hidden:
            todo.append(('"', False, pre, indent, None))
        keep = pre or tag in ("pre", "listing", "xmp", "textarea")
        if keep and not pre and inside and isinstance(inside[0], str) and inside[0].startswith("\n"):
            inside = [inside[0][1:], *inside[1:]]  # the break after the tag is not shown
        todo += [(c, False, keep, inner, None) for c in reversed(inside)]
    return page.text()


def html_to_text(markup: str | None) -> str:
    if not markup:
        return ""
    root = parse(markup)
    _lay_out_tables(root)
    return render(root)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id and ``text``."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batch):
        return {id_col: batch.column(0), "text": [html_to_text(t) for t in texts_of(batch, "html")]}

    return map_rows(pages.select(id_col, pages[html_col].alias("html")), run, f"`{id_col}` {id_type}, text string")
