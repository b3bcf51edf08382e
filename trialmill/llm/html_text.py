"""Text of HTML pages as a reader sees it laid out.

A tokenizer feeds a tree builder that knows implied tags (a new ``<li>`` ends the one before, a
block ends an open ``<p>``, cells end cells, what may not stand in ``<head>`` ends it), so that
broken pages still nest. Rendering walks the tree without recursion:

* not shown: head matter, scripts, styles, templates, comments, media and ``<canvas>`` with what
  stands in for them, an ``<object>`` that names its data, the attribute ``hidden``, inline
  ``display:none`` and ``visibility:hidden`` (until a part is ``visible`` again), closed ``<dialog>`` and ``<details>`` (but for its
  summary), and elements that simple selectors (tag, .class, #id, tag.class) of the page's own
  style sheets hide. Rules cascade (important, then selector, then order); those under a condition
  (``@media print``, widths, ``@supports`` and the like) do not count;
* of ``<svg>`` the text elements show, of ``<math>`` all but annotations;
* white space collapses, except in ``<pre>``, ``<xmp>``, ``<listing>`` and ``<textarea>``; ``<br>`` breaks a line; blocks
  start lines, and paragraphs, headings, lists, tables and the like stand apart by an empty line;
* list items are indented by depth, with ``- `` or their number (``start``, ``value`` and ``reversed`` count); options are lines;
  a table's head comes first and its foot last; table cells start where their
  column does, are padded to its widest, keep their own lines, and span columns and rows.

Defined cases: a null or empty page gives an empty text. Unclosed tags end with their parents, and
stray end tags are ignored, also those without a name; a comment ends at ``-->`` or ``--!>``, or at once (``<!-->``), and an unclosed one, or a script, runs to the end. A number that is none, or has more than
nine digits, counts as not given. Nesting has no bound. Pages are taken whole. Repeated rows get the same result;
an empty table gives an empty one. Other columns come back unchanged.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z]|\Z)[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_BRACE = re.compile(r"[{};]")
_MEDIA = re.compile(r"@media\b(.*)", re.IGNORECASE | re.DOTALL)
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?\Z", re.IGNORECASE)
_SHOWING = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)([^;}]*)", re.IGNORECASE)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})\s*\Z", re.ASCII)
_ZEROS, _TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,}")
#: Limits of the HTML standard.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEVER = frozenset("rp head script style template title noembed noframes iframe datalist audio video canvas annotation annotation-xml".split())
#: What may stand in <head>.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Parts of an <svg> that are not drawn where they stand, and those whose text is.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
DRAWN = frozenset(("text", "foreignobject"))
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp listing blockquote figure hr".split())
#: White space and line breaks in these are kept.
KEPT = frozenset("pre xmp listing textarea".split())
BLOCKS = APART | frozenset(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav search section summary caption tr thead tbody tfoot option optgroup".split()
)
#: A start tag ends these open elements, up to the boundary.
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("td", "th", "tr"))
_LISTS, _TABLE = frozenset(("ul", "ol", "menu", "table")), frozenset(("table",))
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "td": (_CELLS, _TABLE),
    "th": (_CELLS, _TABLE),
    "tr": (_ROWS, _TABLE),
    "thead": (_ROWS | {"thead", "tbody", "tfoot", "caption"}, _TABLE),
    "tbody": (_ROWS | {"thead", "tbody", "tfoot", "caption"}, _TABLE),
    "tfoot": (_ROWS | {"thead", "tbody", "tfoot", "caption"}, _TABLE),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: These end all such elements, not only the nearest.
ENDS_ALL = frozenset(("tr", "thead", "tbody", "tfoot", "optgroup"))
#: An end tag does not reach past these, but for those of tables and pages.
SCOPE = frozenset(("table", "td", "th", "caption", "html"))
FAR = frozenset("table tr tbody thead tfoot html body".split())
#: No block, or none that ends a <p>.
OUTER = frozenset("tr thead tbody tfoot html body head option optgroup".split())

RESULT = "text string, n_lines long, n_items long, n_tables long"


@dataclass
class Node:
    name: str
    shown: bool = True
    visible: bool | None = None  # None: as what is around it
    start: int | None = None  # of an ordered list; the number of a list item
    step: int = 1  # of an ordered list
    spans: tuple[int, int] = (1, 1)  # columns and rows of a cell
    closed: bool = False  # details of which only the summary shows
    children: list[Node | str] = field(default_factory=list)


#: Of a selector and a property: (important, specificity, place in the page), and whether it shows (None: inherited).
Rules = dict[tuple[str, str, str], dict[str, tuple[tuple[bool, int, int], bool | None]]]


def _showing(body: str) -> list[tuple[str, bool, bool | None]]:
    """(property, important, shows) of declarations that bear on being shown."""
    out = []
    for name, value, rest in _SHOWING.findall(body):
        name, value = name.lower(), value.lower()
        shows = value != "none" if name == "display" else {"hidden": False, "collapse": False, "visible": True}.get(value)
        out.append((name, "!important" in rest.replace(" ", "").lower(), shows))
    return out


def number(text: str | None, default: int | None, least: int = -(10**9), most: int = 10**9) -> int:
    """The whole number that an attribute gives, within bounds; else the default."""
    m = _NUMBER.match(text or "")
    return min(max(int(m[1]), least), most) if m else default


def unescaped(text: str) -> str:
    """Character references replaced; numbers too long to convert stand for no character."""
    if "&" not in text:
        return text
    return html.unescape(_TOO_LARGE.sub("&#1114112", _ZEROS.sub("&#", text)) if "&#" in text else text)


def _holds(prelude: str) -> bool:
    """Whether a block at-rule holds on any screen."""
    if m := _MEDIA.match(prelude):
        return any(q.lower().split() in ([], ["all"], ["screen"], ["only", "screen"], ["only", "all"]) for q in m[1].split(","))
    return prelude.lower().startswith("@layer")


def _rules(sheet: str) -> Iterator[tuple[tuple[str, str, str], str, bool, int, bool | None]]:
    """Selector, property, important, specificity and whether it shows, of the rules of a style sheet that bear on being shown."""
    sheet = _COMMENT.sub(" ", sheet)
    holds, start, prelude = [], 0, ""  # of open at-rules and style rules
    for m in _BRACE.finditer(sheet):
        if m[0] == ";":
            if not prelude:
                start = m.end()
            continue
        piece = sheet[start : m.start()].strip()
        start = m.end()
        if m[0] == "{":
            at_rule = piece.startswith("@")
            holds.append(_holds(piece) if at_rule else True)
            prelude = "" if at_rule else piece
            continue
        if holds:
            if prelude and all(holds):
                yield from _rule(prelude, piece)
            holds.pop()
        prelude = ""


def _rule(selectors: str, body: str) -> Iterator[tuple[tuple[str, str, str], str, bool, int, bool | None]]:
    found = _showing(body)
    for selector in selectors.split(",") if found else ():
        if (m := _SELECTOR.match(selector.strip())) and m[0]:
            for name, important, shows in found:
                yield ((m[1] or "").lower(), m[2] or "", m[3] or ""), name, important, {"#": 100, ".": 10}.get(m[2], 0) + bool(m[1]), shows


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # depths of the open elements of each name
    rules: Rules = {}
    placed = 0

    def nearest(names: Iterable[str]) -> int:
        """Depth of the innermost open element of these names; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().name].pop()

    def drawing() -> int:
        """Depth of the <svg> whose parts come next, 0 outside one."""
        depth = nearest(("svg",))
        return depth if depth > nearest(("foreignobject",)) else 0

    def text(piece: str) -> None:
        if not piece or (depth := drawing()) and nearest(DRAWN) < depth:
            return
        if stack[-1].name == "head" and not piece.isspace():
            close(len(stack) - 1)
        stack[-1].children.append(unescaped(piece))

    def looks(name: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
        """Whether an element is shown, and whether it is visible."""
        if name in NEVER or "hidden" in attrs or name == "dialog" and "open" not in attrs or name == "object" and "data" in attrs:
            return False, None
        won: dict[str, tuple[tuple[bool, int, int], bool | None]] = {}
        if drawing():
            if name in UNDRAWN:
                return False, None
            for prop, _, shows in _showing(";".join(f"{p}:{attrs[p]}" for p in ("display", "visibility") if p in attrs)):
                won[prop] = (False, -1, 0), shows
        keys = [("", ""), *((".", c) for c in attrs.get("class", "").split()), ("#", attrs.get("id", ""))] if rules else ()
        for found in [rules[tag, *key] for key in keys for tag in ("", name) if (tag or key[0]) and (tag, *key) in rules]:
            for prop, ruled in found.items():
                won[prop] = max(won.get(prop, ruled), ruled, key=lambda r: r[0])
        for place, (prop, important, shows) in enumerate(_showing(attrs["style"]) if "style" in attrs else ()):
            ruled = ((important, 1000, place), shows)
            won[prop] = max(won.get(prop, ruled), ruled, key=lambda r: r[0])
        return won.get("display", (None, True))[1], won.get("visibility", (None, None))[1]

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            depth = nearest((name,))
            if depth and (name in FAR or nearest(SCOPE) <= depth):
                close(depth)
            continue
        if name in BLOCKS and (depth := drawing()):
            close(depth)  # blocks end a drawing
        if stack[-1].name == "head" and name not in HEAD:
            close(len(stack) - 1)
        if name in BLOCKS and name not in OUTER and (depth := nearest(("p",))) > nearest(SCOPE | {"div", "li"}):
            close(depth)
        if name in ENDS:
            ended, boundary = ENDS[name]
            while (depth := nearest(ended)) > nearest(boundary):
                close(depth)
                if name not in ENDS_ALL:
                    break
        attrs: dict[str, str] = {}
        for key, value in _ATTR.findall(m["attrs"]) if m["attrs"] else ():
            attrs.setdefault(key.lower(), value.strip("\"'"))
        node = Node(name, *looks(name, attrs))
        if name == "ol":
            node.step = -1 if "reversed" in attrs else 1
            node.start = number(attrs.get("start"), None)
        elif name == "li":
            node.start = number(attrs.get("value"), None)
        elif name in _CELLS:
            rows = number(attrs.get("rowspan"), 1, 0, MAX_ROWSPAN)
            node.spans = number(attrs.get("colspan"), 1, 1, MAX_COLSPAN), rows or MAX_ROWSPAN
        elif name == "details" and "open" not in attrs:
            node.closed = True
        spaced = name == "text" and drawing() > 0  # labels of a drawing stand apart
        stack[-1].children.extend([" ", node, " "] if spaced else [node])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
            body = page[at : end.start()] if end else page[at:]
            at = end.end() if end else len(page)
            if name == "style":
                for key, prop, important, specificity, shows in _rules(body):
                    placed += 1
                    rules.setdefault(key, {})
                    ruled = ((important, specificity, placed), shows)
                    rules[key][prop] = max(rules[key].get(prop, ruled), ruled, key=lambda r: r[0])
            elif node.shown:
                node.children.append(unescaped(body))
        elif name not in VOID and not m["attrs"].rstrip().endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


class Canvas:
    """Lines of output with pending gaps; text is collapsed unless it is preformatted."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.indent, self.mark = "", 0, "", ""

    def write(self, text: str, kept: bool) -> None:
        if kept:
            first, *rest = text.split("\n")
            self.line += first if self.line or not first else self.begin() + first
            for piece in rest:
                self.lines.append(self.line.rstrip())
                self.line = self.indent + piece if piece else ""
            return
        text = _SPACES.sub(" ", text)
        if not self.line.strip() or self.line.endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.line = (self.line or self.begin()) + text

    def begin(self) -> str:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        start, self.mark = self.indent + self.mark, ""
        return start

    def end_line(self) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        self.line = ""

    def block(self, apart: bool) -> None:
        self.end_line()
        self.gap |= apart

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


#: Lines, columns and rows of a cell.
Cell = tuple[list[str], int, int]
BAR = " | "


def _table(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table: columns are as wide as their widest cell, and a cell that spans several as wide as these."""
    until: dict[int, int] = {}  # the row at which a column is free again
    grid: list[list[tuple[int, int, list[str]]]] = []
    for r, row in enumerate(rows):
        at, placed = 0, []
        for lines, across, down in row:
            while until.get(at, 0) > r:
                at += 1
            placed.append((at, at + across, lines))
            if down > 1:
                until.update(dict.fromkeys(range(at, at + across), r + down))
            at += across
        grid.append(placed)
    starts = sorted({at for row in grid for at, _, _ in row})  # columns in which no cell starts have no width
    grid = [[(bisect_left(starts, at), bisect_left(starts, to), lines) for at, to, lines in row] for row in grid if any(lines for _, _, lines in row)]
    widths = [0] * len(starts)
    over = lambda at, to: sum(widths[at:to]) + len(BAR) * (to - at - 1)
    for spans in (False, True):
        for row in grid:
            for at, to, lines in row:
                if spans == (to - at > 1):
                    widths[to - 1] += max(0, max(map(len, lines), default=0) - over(at, to))
    out = []
    for row in grid:
        for k in range(max(len(lines) for _, _, lines in row)):
            fields, done = [], 0
            for at, to, lines in row:
                fields += ["".ljust(widths[c]) for c in range(done, at)]
                fields.append((lines[k] if k < len(lines) else "").ljust(over(at, to)))
                done = to
            while fields and not fields[-1].strip():
                fields.pop()
            out.append(BAR.join(fields).rstrip())
    return out


def _sections(children: list[Node | str]) -> list[Node | str]:
    """Children of a table as they are laid out: captions, the first head, what else there is, the first foot."""
    named = lambda what: [c for c in children if isinstance(c, Node) and c.name == what]
    first, last = [*named("caption"), *named("thead")[:1]], named("tfoot")[:1]
    moved = {id(c) for c in (*first, *last)}
    return [*first, *[c for c in children if id(c) not in moved], *last]


def render(root: Node) -> tuple[str, int, int]:
    """Text, list items and tables of a tree."""
    canvas, tables, items = Canvas(), 0, 0
    lists: list[list] = []  # [ordered, next number, step]
    held: list[tuple[Canvas, list[list[Cell]], list[list]]] = []  # what is around open tables and cells
    todo: list[tuple[str, Node | str]] = [("open", root)]
    kept, visible = 0, [True]
    while todo:
        what, node = todo.pop()
        if isinstance(node, str):
            if visible[-1]:
                canvas.write(node, kept > 0)
            continue
        name = node.name
        if what == "open":
            if not node.shown:
                continue
            if name == "br":
                if canvas.line.strip():
                    canvas.end_line()
                elif canvas.lines:
                    canvas.gap = 1
                continue
            if name == "hr":
                canvas.block(True)
                continue
            visible.append(visible[-1] if node.visible is None else node.visible)
            if name in _CELLS and held:
                held.append((canvas, held[-1][1], lists))
                canvas, lists = Canvas(), []
            elif name == "tr" and held:
                held[-1][1].append([])
            elif name == "table":
                canvas.block(True)
                tables += 1
                held.append((canvas, [], lists))
                node = Node(name, children=_sections(node.children))
            elif name in ("ul", "ol", "menu"):
                canvas.block(not lists)
                items_of = sum(isinstance(c, Node) and c.name == "li" and c.shown for c in node.children)
                lists.append([name == "ol", (1 if node.step > 0 else items_of) if node.start is None else node.start, node.step])
            elif name == "li":
                canvas.block(False)
                items += 1
                depth = max(len(lists) - 1, 0)
                if lists and node.start is not None:
                    lists[-1][1] = node.start
                canvas.mark = (f"{lists[-1][1]}. " if lists and lists[-1][0] else "- ") if visible[-1] else ""
                canvas.indent = "  " * depth
                if lists:
                    lists[-1][1] += lists[-1][2]
            elif node.closed:
                canvas.block(False)
                node = Node(name, children=[c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1])
            elif name in BLOCKS:
                canvas.block(name in APART)
            kept += name in KEPT
            todo.append(("close", node))
            todo.extend(("open", c) for c in reversed(node.children))
            continue
        visible.pop()
        kept -= name in KEPT
        if name in _CELLS and held:
            lines = [line for line in canvas.text().split("\n") if line.strip()]
            canvas, rows, lists = held.pop()
            if not rows:
                rows.append([])
            rows[-1].append((lines, *node.spans))
        elif name == "table":
            canvas, rows, lists = held.pop()
            canvas.block(True)
            for line in _table(rows):
                canvas.line = canvas.begin() + line
                canvas.end_line()
            canvas.block(True)
        elif name in ("ul", "ol", "menu"):
            if lists:
                lists.pop()
            canvas.block(not lists)
            canvas.indent, canvas.mark = "  " * max(len(lists) - 1, 0), ""
        elif name == "li":
            canvas.block(False)
            canvas.mark = ""
        elif name in BLOCKS:
            canvas.block(name in APART)
    return canvas.text(), items, tables


def text_of(page: str | None) -> tuple[str, int, int, int]:
    """Text, lines, list items and tables of a page."""
    if not page:
        return "", 0, 0, 0
    text, items, tables = render(parse(page))
    return text, text.count("\n") + 1 if text else 0, items, tables


def extract(page: Column) -> Column:
    """A struct (text, n_lines, n_items, n_tables) from a column of HTML."""

    @F.pandas_udf(RESULT)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_of(p) for p in pages], columns=["text", "n_lines", "n_items", "n_tables"])

    return run(page)
