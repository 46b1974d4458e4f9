"""Visible text of HTML pages by layout-aware rendering.

A tree builder supplies the end tags that HTML implies; visibility rules take out what a browser
does not paint; the rest is laid out: blocks on lines of their own, margins as blank lines, list items with bullets
or numbers, table cells in columns of equal width. All visible text is emitted, boilerplate included: of drawings
the text elements, of formulas all but annotations, of a select the option that is shown (all of a list box). Text that a drawing
repeats by <use> is not followed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never painted.
HIDDEN = frozenset("head title script style template datalist noframes object iframe canvas audio video".split())
#: Never painted in a drawing and in a formula.
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
UNSET = frozenset("annotation annotation-xml mphantom".split())
#: Elements of a formula between whose children blanks mean nothing.
FORMULA = frozenset("math mrow mfrac msqrt mroot mstyle merror mpadded menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mlabeledtr mtd maction semantics".split())
#: Where HTML goes on within a drawing or formula, and the tags that otherwise end both.
HTML_IN = frozenset("foreignobject desc title mi mn mo ms mtext annotation-xml".split())
HTML_ONLY = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Blocks without and with a margin.
PLAIN = frozenset("address article aside body center details dialog div dd dt fieldset figcaption figure footer form header hgroup html legend li main nav section summary tr td th thead tbody tfoot caption option".split())
SPACED = frozenset("blockquote dl h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
SCOPE = frozenset("table td th caption button".split())
#: What an opening tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "input": ({"select"}, SCOPE),
    "textarea": ({"select"}, SCOPE),
    "body": ({"head"}, set()),
}
CLOSE_P = (PLAIN | SPACED) - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option"}
IN_HEAD = frozenset("base link meta title style script template noscript head html".split())
#: Content of elements deeper than this goes to the element at this depth, but for what is hidden. Drawings, formulas and selects may
#: go deeper by so much.
DEPTH, FURTHER = 150, 20
SPACE = re.compile("[ \t\n\f\r]+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
GAP = "  "
ROWS, CELLS = ("tr", "mtr", "mlabeledtr"), ("td", "th", "mtd")


class Node:
    #: off: not painted where it stands; apart: stands apart from the text around it; level: its depth in the tree; flat: too deep
    #: to hold its content, which goes to the element above.
    __slots__ = ("tag", "attrs", "children", "off", "apart", "level", "flat")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.off = self.apart = self.flat = False
        self.level = 0


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # tag: its places in open

    def _last(self, tags: set[str] | frozenset) -> int:
        """The place of the innermost of these tags; 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _cut(self, place: int) -> None:
        for node in reversed(self.open[place:]):
            self.at[node.tag].pop()
            if node.flat and (node.apart or node.tag in PLAIN or node.tag in SPACED):  # the text after it stands apart from its own
                node.children.append(" " if node.apart else Node("p" if node.tag in SPACED else "div", {}))
        del self.open[place:]

    def _end(self, tags: set[str], stop: set[str] | frozenset) -> None:
        """Close the outermost of these tags above the nearest stop."""
        if any(self.at.get(t) for t in tags):
            last = self._last(stop)
            places = [x for t in tags if (x := self.at.get(t)) and x[-1] > last]
            found = min((x[bisect_right(x, last)] for x in places), default=0)
            if found:
                self._cut(found)

    def _foreign(self) -> str:
        """svg or math if its rules hold here."""
        svg, math = self._last({"svg"}), self._last({"math"})
        return ("svg" if svg > math else "math") if max(svg, math) > self._last(HTML_IN) else ""

    def handle_starttag(self, tag, attrs):
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag in HTML_ONLY:
            self._end({"svg", "math"}, HTML_IN)
        if tag in CLOSE_P:
            self._end({"p"}, SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "select" and self._last({"select"}) > self._last(SCOPE):
            return self._end({"select"}, SCOPE)  # a second one ends the first
        node = Node(tag, {k: v or "" for k, v in attrs})
        kind = self._foreign()
        if kind == "svg":
            node.off = tag in UNDRAWN or node.attrs.get("display") == "none" or node.attrs.get("visibility") in ("hidden", "collapse")
            node.apart = tag == "text" or tag == "tspan" and ("x" in node.attrs or "y" in node.attrs)
        elif kind:
            node.off = tag in UNSET
        above = self.open[-1]
        above.children.append(node)
        if tag in VOID:
            return
        node.level = above.level + 1
        if node.level >= (DEPTH + FURTHER if kind or tag in ("svg", "math", "select", "optgroup", "option") else DEPTH):
            flat = Node(tag, {})
            flat.flat, flat.apart, flat.level = True, node.apart, above.level
            flat.children = above.children if visible(node) else []
            node = flat
        self.at[tag].append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        # HTML ignores the slash, but for elements that have no content anyway; drawings and formulas don't.
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and (tag in ("svg", "math") or self._last({"svg", "math"}) > self._last(HTML_IN - {tag})):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        stop = SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else frozenset({"table"} - {tag})
        found, last = self._last({tag}), self._last(stop)
        if found > last:
            self._cut(found)
        elif tag == "br" and not last:
            self.handle_starttag("br", [])

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        svg = self._last({"svg"})
        if svg and self._last({"text", "foreignobject", "math"}) < svg:
            return  # a drawing paints its text elements only
        if self.open[-1].tag in FORMULA and not SPACE.sub("", data):
            return
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and self._foreign():
            self.handle_data(data[6:])


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html.replace("\0", "�"))
    if re.match("<[a-zA-Z!/?]", builder.rawdata):
        builder.rawdata = ""  # a tag or comment that never ends is not text
    builder.close()
    return builder.root


def visible(node: Node) -> bool:
    return node.tag not in HIDDEN and not node.off and "hidden" not in node.attrs and not UNSEEN.search(node.attrs.get("style", "")) and not (node.tag == "dialog" and "open" not in node.attrs)


class _Page:
    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.blank = self.space = False

    def text(self, data: str) -> None:
        part = SPACE.sub(" ", data)
        if not part:
            return
        body = part.strip(" ")
        if self.line and (self.space or part[0] == " ") and body:
            self.line.append(" ")
        if body:
            self.line.append(body)
            self.space = part[-1] == " "
        else:
            self.space = True

    def put(self, line: str) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        self.done.append(line)

    def block(self, margin: bool = False) -> None:
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False
        self.blank |= margin

    def lines(self, lines: list[str], margin: bool = False) -> None:
        self.block(margin)
        for line in lines:
            self.put(line)
        self.block(margin)


def _flow(nodes: list, pre: bool = False) -> list[str]:
    page = _Page()
    _lay(nodes, page, pre)
    page.block()
    return page.done


def _lay(nodes: list, page: _Page, pre: bool) -> None:
    for node in nodes:
        if isinstance(node, str):
            if pre:
                first, *more = node.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                page.line.append(first)
                for line in more:
                    page.put("".join(page.line))
                    page.line = [line]
            else:
                page.text(node)
        elif not visible(node):
            continue
        elif node.tag == "br":
            if page.line:
                page.block()
            else:
                page.put("")
        elif node.tag == "hr":
            page.lines(["---"], True)
        elif node.tag in ("ul", "ol", "menu"):
            page.lines(_items(node, pre), True)
        elif node.apart:
            _lay([" ", *node.children, " "], page, pre)
        elif node.tag == "select":
            _choice(node, page, pre)
        elif node.tag in ("switch", "maction", "semantics"):
            parts = _elements(node)
            _lay([x for x in parts if "systemlanguage" not in x.attrs][:1] or parts[:1], page, pre)
        elif node.tag == "mfrac":
            parts = _elements(node)
            bar = " " if re.fullmatch(r"[0.]+[a-z%]*", node.attrs.get("linethickness", "")) else "/"
            _lay([*parts[:1], *([bar] if parts[1:] else []), *parts[1:]], page, pre)
        elif node.tag in ("table", "mtable"):
            page.lines(_table(node, pre), node.tag == "table")
        elif node.tag == "blockquote":
            page.lines([f"> {x}".rstrip() for x in _flow(node.children, pre)], True)
        elif node.tag == "dd":
            page.lines([f"    {x}".rstrip() for x in _flow(node.children, pre)])
        elif node.tag in ("pre", "listing", "textarea"):
            kept = _flow(node.children, True)
            page.lines(kept[1:] if kept and not kept[0] else kept, node.tag == "pre")
        elif node.tag in PLAIN or node.tag in SPACED or node.tag == "foreignobject" or node.tag == "math" and node.attrs.get("display") == "block":
            page.block(node.tag in SPACED)
            _lay(node.children, page, pre)
            page.block(node.tag in SPACED)
        else:
            _lay(node.children, page, pre)


def _elements(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node)]


def _choice(select: Node, page: _Page, pre: bool) -> None:
    """The option that a drop-down shows, hidden in its list or not; all of a list box, with the labels of groups."""
    box = "multiple" in select.attrs or _whole(select.attrs.get("size", ""), 1) > 1
    options: list[Node] = []
    free: list[Node] = []
    todo = [(x, False) for x in reversed(_elements(select))]
    while todo:
        node, off = todo.pop()
        off |= "disabled" in node.attrs and node.tag in ("option", "optgroup")
        if box and not visible(node):
            continue
        if node.tag == "option" or node.tag == "optgroup" and box and node.attrs.get("label", "").strip():
            options.append(node)
            free += [] if off else [node]
        if node.tag != "option":
            todo += [(x, off) for x in reversed(_elements(node))]
    if box:
        return page.lines([x for x in map(_label, options) if x])
    shown = [x for x in options if "selected" in x.attrs][-1:] or free[:1]
    _lay([" ", *map(_label, shown), " "], page, pre)


def _label(option: Node) -> str:
    return SPACE.sub(" ", option.attrs.get("label", "")).strip(" ") or " ".join(x for x in _flow(option.children) if x)


def _whole(text: str, other: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text)
    return int(found[1]) if found else other


def _items(node: Node, pre: bool) -> list[str]:
    out: list[str] = []
    number = _whole(node.attrs.get("start", ""), 1)
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if not visible(child):
                continue
            number = _whole(child.attrs.get("value", ""), number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = _flow(child.children, pre) or [""]
            out.append((mark + lines[0]).rstrip())
            out += [(" " * len(mark) + x).rstrip() for x in lines[1:]]
        else:
            out += _flow([child], pre)
    return out


def _table(node: Node, pre: bool) -> list[str]:
    rows: list[list[tuple[list[str], int, int]]] = []
    loose: list[str] = []
    todo = list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or not visible(child):
            loose += _flow([child], pre) if isinstance(child, str) else []
        elif child.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(child.children)
        elif child.tag in ROWS or child.tag in CELLS:
            cells = child.children if child.tag in ROWS else [child]
            row = []
            for cell in cells:
                if isinstance(cell, str) or cell.tag not in CELLS:
                    loose += _flow([cell], pre)
                elif visible(cell):
                    span = lambda name: min(1000, max(1, _whole(cell.attrs.get(name, ""), 1)))  # noqa: B023, E731
                    row.append((_flow(cell.children, pre), span("colspan"), span("rowspan")))
            rows.append(row)
        elif child.tag == "caption":
            loose += _flow(child.children, pre)
        else:
            loose += _flow([child], pre)
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows that a cell above still covers
    for row in rows:
        at, out, covers = 0, [], {}
        for lines, across, down in row:
            while taken.get(at, 0):
                at += 1
            out.append((at, across, lines))
            if down > 1:
                covers |= {at + k: down for k in range(across)}
            at += across
        placed.append(out)
        taken = {k: v - 1 for k, v in taken.items() if v > 1} | {k: v - 1 for k, v in covers.items()}
    width: dict[int, int] = {}
    for row in placed:
        for at, across, lines in row:
            for k in range(at, at + across):
                width.setdefault(k, 0)
            if across == 1:
                width[at] = max(width[at], max(map(len, lines), default=0))
    for row in placed:  # a cell over several columns widens the last of them
        for at, across, lines in row:
            room = sum(width[k] for k in range(at, at + across)) + len(GAP) * (across - 1)
            width[at + across - 1] += max(0, max(map(len, lines), default=0) - room)
    starts, at = {}, 0
    for k in range(max(width, default=-1) + 1):
        starts[k] = at
        at += width.get(k, 0) + len(GAP)
    out = loose
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for at, _, lines in row:
                if k < len(lines):
                    line = line.ljust(starts[at]) + lines[k]
            out.append(line.rstrip())
    return out


def rendered(html: str | None) -> str:
    """The visible text of a page; blank for null."""
    return "\n".join(_flow(tree(html or "").children)).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, text, n_chars.

    A null or empty page, or one with nothing visible, has an empty text. Broken markup is read as far as a tree can be made of
    it. Ids may be null or repeat: each row is rendered by itself. An empty table gives no rows. Other columns are ignored.
    """
    bare = pick(pages, page_id=id_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                found = [rendered(x) for x in texts(b.column("html"))]
                yield pa.record_batch([b.column("page_id"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "text", "n_chars"])

    return bare.mapInArrow(run, f"page_id {dict(bare.dtypes)['page_id']}, text string, n_chars long")
