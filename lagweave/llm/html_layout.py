"""Visible text of HTML pages by layout-aware rendering.

A scanner splits the markup into tags, text, comments and raw-text elements. A tree builder
opens and closes elements with the implied tags of HTML (p, li, dt/dd, option, table parts,
unclosed elements at an outer end tag). Visibility rules drop what a browser would not show: head, script, style,
template and the like, `hidden`, inline display:none or visibility:hidden, hidden inputs, closed
details. Of svg the text elements and foreign objects are kept, of math all but annotations. A renderer then lays the tree out as text: inline white space collapses, blocks stand on lines of
their own with blank lines where margins are, lists are indented with bullets or numbers,
`pre` keeps its white space, and table cells are padded so that columns align.

All visible text is kept, navigation included. Defined results: null html gives null text; an empty page
gives ""; broken markup never fails (unclosed tags end with the page, stray end tags and a
lone `<` are text or nothing, as a browser would do); rows repeated whole get a row each; null url stays null; other columns are
ignored. Equal cells and rows need no order. Trees are walked without recursion, and tables laid out from the innermost outwards, however deep they stand;
a page of any length is one task's work, a few pages at a time.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, url string, text string, n_blocks long, n_tables long"

# Fixed values of the HTML standard: element groups by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base param source track area".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li listing main menu nav ol optgroup option p pre search section select summary table ul caption hr".split())
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol ul pre table fieldset hr listing menu dir".split())
TABLE_PART = frozenset("tr td th thead tbody tfoot caption colgroup col".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup legend caption select".split())
SCOPE = frozenset("table td th caption html template button object body foreignobject annotation-xml".split())
#: What leaves an open head open.
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes script style template".split())
#: In svg and math: elements that hold html again, start tags that end the foreign part, elements that show nothing, and texts that stand apart.
POINTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient annotation annotation-xml".split())
APART = frozenset("text mtd".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
#: Start tags that end open elements of these names, up to the listed limits.
IMPLIED = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table thead tbody tfoot"),
    "td": ("td th caption colgroup", "tr table"),
    "th": ("td th caption colgroup", "tr table"),
    "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "caption": ("caption colgroup", "table"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}

#: Fixed values of the HTML standard: the most that colspan and rowspan count.
SPANS = {"colspan": 1000, "rowspan": 65534}
#: A name, and after = a value: a quote counts only at its begin; an open one runs to the end of the page.
_PAIR = r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f\"'>][^ \t\n\r\f>]*+)|(?=>)))?+"
_ATTR = re.compile(_PAIR)
_TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|[!?](?P<decl>[^>]*)(?:>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^ \t\n\r\f/>]*+)(?P<attrs>(?:[ \t\n\r\f/]++|" + _PAIR + r")*+)(?:(?P<close>>)|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|/>)", re.S)
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """kind: "math", "svg" or, inside its text elements, "svg text", where foreign rules hold; else ""."""

    __slots__ = ("attrs", "children", "kind", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, kind: str = ""):
        self.name, self.attrs, self.children, self.kind = name, attrs or {}, [], kind


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def parse(html: str) -> Node:
    """The tree of a page; text children are strings."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            _text(stack, html[at:])
            break
        if m.start() > at:
            _text(stack, html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if stack[-1].kind and html.startswith("<![CDATA[", m.start()):
                stop = html.find("]]>", m.start())
                if stack[-1].kind != "svg":
                    stack[-1].children.append(html[m.start() + 9 : stop if stop >= 0 else n])
                at = stop + 3 if stop >= 0 else n
            continue
        if not m["close"]:
            break  # the page ends inside the tag
        name = name.lower()
        if m["end"]:
            _end(stack, name)
            continue
        raw = m["attrs"]
        attrs = attributes(raw) if raw and not raw.isspace() else {}
        if stack[-1].kind and (name in BREAKOUT or (name == "font" and attrs.keys() & {"color", "face", "size"})):
            _leave(stack)
        if name == "body" and len(stack) > 1 and stack[1].name == "head" and all(x.name != "template" for x in stack):
            del stack[1:]
        if name == "head" and len(stack) > 1:
            continue
        if name in ("html", "body"):
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            continue
        if stack[-1].kind or name in ("svg", "math"):
            if not stack[-1].kind and stack[-1].name == "head":
                stack.pop()
            _foreign(stack, name, attrs, raw)
            continue
        _start(stack, name, attrs)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            stop = close.start() if close else n
            body = html[at:stop]
            if name in ("textarea", "title"):
                body = unescape(body)
            if body:
                stack[-1].children.append(body)
            stack.pop()
            at = html.find(">", stop) + 1 if close else n
            at = at or n
    return root


def _text(stack: list[Node], raw: str) -> None:
    if stack[-1].kind == "svg":
        return  # only text elements are drawn
    if stack[-1].name == "head" and raw.strip(" \t\n\r\f"):
        stack.pop()
    stack[-1].children.append(unescape(raw) if "&" in raw else raw)


def _leave(stack: list[Node]) -> None:
    while stack[-1].kind:
        stack.pop()


def _foreign(stack: list[Node], name: str, attrs: dict[str, str], raw: str) -> None:
    """A start tag of svg or math, or inside them: no implied tags, and a slash at its end closes it."""
    kind = stack[-1].kind or name
    if name in ("svg", "math"):
        kind = name
    elif name in POINTS:
        kind = ""
    elif name == "text" and kind == "svg":
        kind = "svg text"
    if name in UNDRAWN or attrs.get("display") == "none" or attrs.get("visibility") in ("hidden", "collapse"):
        attrs = attrs | {"hidden": ""}
    node = Node(name, attrs, kind)
    stack[-1].children += [" ", node, " "] if name in APART else [node]
    if not (raw.endswith("/") and max((m.end() for m in _ATTR.finditer(raw)), default=0) < len(raw)):
        stack.append(node)


def _start(stack: list[Node], name: str, attrs: dict[str, str]) -> None:
    if name in CLOSES_P or name in TABLE_PART:
        _close(stack, frozenset(("p",)), SCOPE)
    if stack[-1].name == "head" and name not in IN_HEAD:
        stack.pop()
    if name in IMPLIED:
        names, limits = IMPLIED[name]
        while _close(stack, names, limits):
            pass
    if name[0] == "h" and name[1:] in "123456" and len(name) == 2 and stack[-1].name[:1] == "h" and stack[-1].name[1:] in tuple("123456"):
        stack.pop()
    if name in ("a", "button") and any(x.name == name for x in stack[-6:]):
        _end(stack, name)
    if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
        _push(stack, Node("tr"))
    node = Node("img" if name == "image" else name, attrs)
    stack[-1].children.append(node)
    if node.name not in VOID:
        stack.append(node)


def _push(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    stack.append(node)


def _close(stack: list[Node], names: frozenset[str], limits: frozenset[str]) -> bool:
    """Ends the nearest open element of these names, with what is open inside it, unless a limit is nearer."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return True
        if stack[i].name in limits:
            return False
    return False


def _end(stack: list[Node], name: str) -> None:
    if name in ("html", "body"):
        return
    if name in ("br", "p") and stack[-1].kind:
        _leave(stack)
    if name == "br":
        stack[-1].children.append(Node("br"))
        return
    found = _close(stack, frozenset((name,)), frozenset(("td", "th", "caption")) - {name} if name in FORMAT or name in ("p", "li", "div") else frozenset())
    if name == "p" and not found:
        stack[-1].children.append(Node("p"))


def visible(node: Node) -> bool:
    if node.name in UNSEEN:
        return False
    a = node.attrs
    if not a:
        return True
    return not ("hidden" in a or ("style" in a and _HIDDEN.search(a["style"])) or (node.name == "input" and a.get("type", "").lower() == "hidden") or (node.name == "dialog" and "open" not in a))


class Layout:
    """Lines of text under construction. `need` is the blank space owed before the next text: 1 a new line, 2 a blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.need, self.space, self.indent, self.mark, self.blocks = 0, False, "", "", 0

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            parts = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    self._open()
                    self._flush()
                if part:
                    self._open()
                    self.line.append(part)
            return
        words = _SPACE.sub(" ", raw)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words[-1] == " "
        self._open()
        if self.space and self.line and not self.line[-1].endswith((" ", "\t")):
            self.line.append(" ")
        self.line.append(words[:-1] if tail else words)
        self.space = tail

    def _open(self) -> None:
        if self.need:
            self._flush()
            if self.need > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.need = 0
        if not self.line:
            self.space = False
            self.blocks += 1
            if self.mark:
                self.line.append(self.indent[: max(0, len(self.indent) - len(self.mark))] + self.mark)
                self.mark = ""
            elif self.indent:
                self.line.append(self.indent)

    def _flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def gap(self, size: int) -> None:
        self.need = max(self.need, size)

    def line_break(self) -> None:
        if self.line:
            self._flush()
        else:
            self._open()
            self.line = []
            self.lines.append("")

    def block(self, lines: list[str]) -> None:
        """Finished lines, a table's."""
        self.gap(2)
        for x in lines:
            self._open()
            self.line.append(x)
            self.need = 1
        self.gap(2)

    def done(self) -> str:
        self._flush()
        return "\n".join(self.lines).strip("\n")


def render(root: Node, done: dict[int, tuple[list[str], int]]) -> tuple[str, int, int]:
    """Text, blocks of text and tables of a tree whose own tables are done."""
    out, tables = Layout(), 0
    jobs: list = [("in", root, False)]
    lists: list = []
    while jobs:
        what, node, pre = jobs.pop()
        if what == "call":
            node()
            continue
        if isinstance(node, str):
            out.text(node, pre)
            continue
        if not visible(node):
            continue
        name = node.name
        if name == "br":
            out.line_break()
            continue
        if name == "hr":
            out.gap(2)
            continue
        if name in ("img", "input"):
            text = node.attrs.get("alt", "") if name == "img" else node.attrs.get("value", "") if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search") else ""
            if text.strip():
                out.text(f" {text} ", False)
            continue
        if name == "wbr":
            continue
        if name == "table":
            tables += 1
            lines, inner = done[id(node)]
            tables += inner
            out.block(lines)
            continue
        is_block = name in BLOCK or name in TABLE_PART
        after = []
        if is_block:
            size = 2 if name in SPACED and not (name in ("ul", "ol", "menu", "dir") and lists) else 1
            out.gap(size)
            after.append(lambda size=size: out.gap(size))
        if name in ("ul", "menu", "dir", "ol"):
            lists.append([int(node.attrs["start"]) if name == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1, name == "ol"])
            after.insert(0, lists.pop)
        elif name == "li":
            top = lists[-1] if lists else [1, False]
            mark = f"{top[0]}. " if top[1] else "- "
            top[0] += 1
            after.insert(0, _indent(out, out.indent + " " * len(mark), mark))
        elif name in ("dd", "blockquote"):
            after.insert(0, _indent(out, out.indent + "  ", ""))
        elif name == "q":
            out.text('"', False)
            after.append(lambda: out.text('"', False))
        children = node.children
        if name == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        jobs += [("call", f, None) for f in reversed(after)]
        pre = pre or name in ("pre", "listing", "textarea", "xmp")
        jobs += [("in", c, pre) for c in reversed(children)]
    return out.done(), out.blocks, tables


def _indent(out: Layout, indent: str, mark: str):
    old, old_mark = out.indent, out.mark
    out.indent, out.mark = indent, mark

    def back() -> None:
        out.indent, out.mark = old, "" if mark else old_mark

    return back


def table(node: Node, done: dict[int, tuple[list[str], int]]) -> tuple[list[str], int]:
    """Lines of a table, its columns aligned: a cell's lines below each other, two blanks between columns; colspan and rowspan take their places. Captions come first."""
    head, rows, foot, captions, loose = [], [], [], [], []
    for child in node.children:
        if isinstance(child, str):
            loose.append(child)
        elif not visible(child):
            continue
        elif child.name == "tr":
            rows.append(child)
        elif child.name in ("thead", "tbody", "tfoot"):
            {"thead": head, "tbody": rows, "tfoot": foot}[child.name].extend(c for c in child.children if isinstance(c, Node) and c.name == "tr" and visible(c))
            loose += [c for c in child.children if not (isinstance(c, Node) and c.name == "tr")]
        elif child.name == "caption":
            captions.append(child)
        elif child.name not in ("col", "colgroup"):
            loose.append(child)
    tables, grid, taken = 0, [], {}
    for r, row in enumerate(head + rows + foot):
        cells, c = {}, 0
        for cell in row.children:
            if isinstance(cell, str) or cell.name not in ("td", "th"):
                loose.append(cell)
                continue
            if not visible(cell):
                continue
            while taken.get(c, 0) > r:
                c += 1
            part = Node("div", {})
            part.children = cell.children
            text, _, inner = render(part, done)
            tables += inner
            wide, deep = _span(cell, "colspan"), _span(cell, "rowspan")
            cells[c] = (text.split("\n") if text else [""], wide)
            for k in range(c, c + wide):
                taken[k] = r + deep
            c += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, (lines, wide) in cells.items():
            if wide == 1:
                widths[c] = max(widths.get(c, 0), *map(len, lines))
    for cells in grid:
        for c, (lines, wide) in cells.items():
            if wide > 1:
                have = sum(widths.get(k, 0) for k in range(c, c + wide)) + 2 * (wide - 1)
                widths[c + wide - 1] = widths.get(c + wide - 1, 0) + max(0, max(map(len, lines)) - have)
    begin, total = {}, 0
    for c in range(max(widths, default=-1) + 1):
        begin[c] = total
        total += widths.get(c, 0) + 2
    out: list[str] = []
    for part in [*captions, _holder(loose)]:
        text, _, inner = render(_holder(part.children), done)
        tables += inner
        out += text.split("\n") if text else []
    for cells in grid:
        for k in range(max((len(lines) for lines, _ in cells.values()), default=0)):
            line = ""
            for c in sorted(cells):
                lines = cells[c][0]
                if k < len(lines) and lines[k]:
                    line = line.ljust(begin[c]) + lines[k]
            if line.strip():
                out.append(line.rstrip(" "))
    return out, tables


def _holder(children: list) -> Node:
    node = Node("div")
    node.children = list(children)
    return node


def _span(cell: Node, name: str) -> int:
    """As the standard reads them: leading digits, up to a most; a rowspan of 0 goes to the end."""
    digits = re.match(r"[ \t\n\f\r]*\+?(\d+)", cell.attrs.get(name, ""))
    if not digits:
        return 1
    value = int(digits[1][:9]) if len(digits[1].lstrip("0")) < 9 else SPANS[name]
    if not value:
        return SPANS[name] if name == "rowspan" else 1
    return min(value, SPANS[name])


def text_of(html: str) -> tuple[str, int, int]:
    """Text, blocks of text and tables of a page."""
    root = parse(html)
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name == "table":
            tables.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    done: dict[int, tuple[list[str], int]] = {}
    for node in reversed(tables):  # a table comes before those within it
        done[id(node)] = table(node, done)
    return render(root, done)


def rendered(pages: DataFrame) -> DataFrame:
    """Per page: its visible text, blocks of text and tables (RESULT)."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, len(batch), 64)):
                got = [text_of(h) if h is not None else (None, 0, 0) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())],
                    ["page_id", "url", "text", "n_blocks", "n_tables"],
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, RESULT)
