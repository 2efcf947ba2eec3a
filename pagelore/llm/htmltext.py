"""Operator 1, HTML extraction by layout-aware rendering.

A tokenizer that reads each character a bounded number of times and a tree builder
with implied tags turn a page into nodes; visibility rules drop what a browser
would not show; a renderer walks the tree once and emits all visible text: blocks
on lines of their own with blank lines around paragraphs, list items with their
marks and indents, preformatted text as it stands, and tables with aligned columns
over row and column spans. Cells wrap between words at WRAP columns, as in a window;
a longer word or preformatted line stands out of its column in its line. All walks
use explicit stacks, so depth is bounded by memory only.

Of style sheets and style attributes, display and visibility are read; a rule
applies if its selector is made of at most one tag and one class or id. Other
selectors, sheets of other media and linked sheets are left out. What a page leaves
open at its end is closed there; a tag or comment that never ends shows nothing.
Layout nests DEEPEST levels deep; further in, text keeps its lines but no columns,
marks or indents.

Nulls: null or empty html gives empty text and no title. A null id keeps its row;
repeated rows (ties) are rendered alike, very long pages whole, an empty table gives
an empty one, and other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from html import unescape
from html.entities import html5
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown. (An iframe's or object's fallback shows only where the browser can't load it.)
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist title meta link noframes noembed defs desc metadata symbol annotation annotation-xml rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre listing xmp plaintext ul ol dl figure table hr fieldset".split())
BLOCKS = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd figcaption details summary legend center dialog menu dir search caption option optgroup textarea text".split())
#: A start tag of the key ends an open element of the value, up to a barrier.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr listing main menu nav ol p plaintext pre search section summary table ul li dt dd".split())
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir td th table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset("dl td th table".split())),
    "dd": (frozenset({"dt", "dd"}), frozenset("dl td th table".split())),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset({"tbody", "thead", "tfoot", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: What an end tag of an inline element or a paragraph may not reach through.
SCOPE = frozenset("table td th caption html template".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: Where a part of a table may stand; elements in between are ended. Text and other elements there go before the table.
ROW_GROUPS = frozenset({"tbody", "thead", "tfoot"})
CONTEXT = {"tr": ROW_GROUPS | {"table"}, "td": ROW_GROUPS | {"table", "tr"}, "th": ROW_GROUPS | {"table", "tr"}} | dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup"), frozenset({"table"}))
BETWEEN_CELLS = ROW_GROUPS | {"table", "tr"}
AT_HOME_THERE = frozenset(CONTEXT) | {"col", "script", "style", "template", "table"}
#: Elements whose white space is kept; those whose content is text up to their end tag, without or with character references.
KEPT = frozenset("pre listing xmp plaintext textarea".split())
RAW, RAW_WITH_REFERENCES = frozenset("script style xmp iframe noembed noframes".split()), frozenset({"title", "textarea"})
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot caption colgroup col".split())
#: Input types that show no value.
NO_VALUE = frozenset("hidden checkbox radio file password image color range".split())
#: Values of display.
FLOWS_INLINE = frozenset("inline inline-block inline-flex inline-grid contents".split())
FLOWS_AS_BLOCK = frozenset("block flex grid flow-root list-item".split())
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:screen|all)", re.I)
SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?([.#][^\s.#:\[\]>+~*,()]+)?", re.I)
BRACE = re.compile(r"[{}]")
TAG_NAME = re.compile(r"[A-Za-z][^ \t\n\f\r/>]*")
BEFORE_ATTRIBUTE = re.compile(r"[ \t\n\f\r/]*")
ATTRIBUTE_NAME = re.compile(r"=?[^ \t\n\f\r/>=]*")
EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {n: re.compile(rf"</{n}(?=[ \t\n\f\r/>])", re.I | re.A) for n in RAW | RAW_WITH_REFERENCES}
LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]++;?)")
BLANK = re.compile(r"[ \t\n\f\r]+")
INTEGER = re.compile(r"[ \t\n\f\r]*([-+]?\d+)")
#: Cells, items and indents inside one another that are laid out; what lies deeper flows in lines.
DEEPEST = 64
#: Columns at which the lines of a table cell wrap.
WRAP = 80


class Node:
    __slots__ = ("attrs", "before", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str | None]):
        self.name, self.attrs, self.children = name, attrs, []
        #: What stood between the cells of a table and is shown before it.
        self.before: list[Node | str] = []


def short_references(s: str) -> str:
    """Character references of many digits in short."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{digits};" if m[1] else f"&#x{digits};"

    return LONG_REFERENCE.sub(short, s)


def decoded(s: str) -> str:
    """Text with its character references resolved."""
    return unescape(short_references(s)) if "&" in s else s


def decoded_value(s: str) -> str:
    """An attribute's value; a name without semicolon that letters, digits or = follow is no reference."""
    if "&" not in s:
        return s
    s = short_references(s)
    return REFERENCE.sub(lambda m: unescape(m[0]) if m[1][0] == "#" or (m[1] in html5 and (m[1][-1] == ";" or s[m.end() : m.end() + 1] != "=")) else m[0], s)


def attributes(html: str, at: int) -> tuple[dict[str, str | None], int, bool]:
    """Attributes of the tag whose name ends at ``at`` (of equal names the first), where the tag ends (-1: never) and whether it closes itself."""
    found: dict[str, str | None] = {}
    while True:
        begin, at = at, BEFORE_ATTRIBUTE.match(html, at).end()
        if at == len(html):
            return found, -1, False
        if html[at] == ">":
            return found, at + 1, at > begin and html[at - 1] == "/"
        m = ATTRIBUTE_NAME.match(html, at)
        at, value = m.end(), None
        if equals := EQUALS.match(html, at):
            at = equals.end()
            if html[at : at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return found, -1, False
                value, at = html[at + 1 : end], end + 1
            else:
                bare = UNQUOTED.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(m[0].lower(), None if value is None else decoded_value(value))


class Sheet:
    """Rules of display and visibility by tag and class or id: of each key the one that wins."""

    def __init__(self):
        self.rules: dict[tuple[str, str], dict[str, tuple[bool, int, int, str]]] = {}
        self.n = 0

    def add(self, css: str) -> None:
        css, at = CSS_COMMENT.sub(" ", css), 0
        while (brace := css.find("{", at)) >= 0:
            prelude = css[at:brace].rpartition(";")[2].strip("} \t\n\f\r")
            if prelude.startswith("@"):
                at = brace + 1
                if not SCREEN.fullmatch(prelude):
                    depth = 1
                    for m in BRACE.finditer(css, at):
                        depth += 1 if m[0] == "{" else -1
                        at = m.end()
                        if not depth:
                            break
                    else:
                        return
                continue
            end = css.find("}", brace)
            end = len(css) if end < 0 else end
            found = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in DECLARATION.finditer(css[brace + 1 : end])]
            for part in prelude.split(",") if found else ():
                m = SELECTOR.fullmatch(part.strip())
                if m and m[0]:
                    tag = "" if m[1] in (None, "*") else m[1].lower()
                    weight = bool(tag) + (0 if not m[2] else 100 if m[2][0] == "#" else 10)
                    slot = self.rules.setdefault((tag, m[2] or ""), {})
                    for name, value, important in found:
                        self.n += 1
                        slot[name] = max(slot.get(name, (False, -1, 0, "")), (important, weight, self.n, value))
            at = end + 1

    def style(self, n: Node) -> dict[str, str]:
        """display and visibility of an element, as far as sheets or its own attribute set them."""
        best: dict[str, tuple[bool, int, int, str]] = {}
        if self.rules:
            parts = ["", *("." + c for c in (n.attrs.get("class") or "").split())]
            if n.attrs.get("id"):
                parts.append("#" + n.attrs["id"])
            for tag in ("", n.name):
                for part in parts:
                    for name, rule in self.rules.get((tag, part), {}).items():
                        best[name] = max(best.get(name, rule), rule)
        for i, m in enumerate(DECLARATION.finditer(n.attrs.get("style") or "")):
            rule = (bool(m[3]), 1000, i, m[2].lower())
            best[m[1].lower()] = max(best.get(m[1].lower(), rule), rule)
        return {name: rule[3] for name, rule in best.items()}


class Tree:
    """Builds nodes from a page, with the end tags that HTML lets authors leave out."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        #: Places in the stack of the open elements of each name.
        self.open: dict[str, list[int]] = {}
        self.sheet = Sheet()

    def feed(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            tag = html.find("<", at)
            self.text(html[at : tag if tag >= 0 else size])
            if tag < 0:
                return
            sign = html[tag + 1 : tag + 2]
            name = TAG_NAME.match(html, tag + 2 if sign == "/" else tag + 1)
            if name:
                attrs, at, closed = attributes(html, name.end())
                if at < 0:
                    return
                if sign == "/":
                    self.end(name[0].lower())
                else:
                    self.start(name[0].lower(), attrs, closed)
                    at = self.raw(name[0].lower(), html, at)
            elif sign == "!" and html.startswith("--", tag + 2):
                m = re.compile("-?>").match(html, tag + 4) or COMMENT_END.search(html, tag + 4)
                at = m.end() if m else size
            elif sign == "!" and html.startswith("[CDATA[", tag + 2) and self.foreign():
                end = html.find("]]>", tag + 9)
                self.text(html[tag + 9 : end if end >= 0 else size], False)
                at = end + 3 if end >= 0 else size
            elif sign in ("!", "?") or (sign == "/" and tag + 2 < size):
                at = (html.find(">", tag + 2) + 1) or size
            else:
                at = tag + 1 + (sign == "/")
                self.text(html[tag:at])

    def raw(self, name: str, html: str, at: int) -> int:
        """Reads the content of an element that holds no tags; returns where that ends."""
        if name == "plaintext":
            end = len(html)
        elif name in RAW or (name in RAW_WITH_REFERENCES and not self.foreign()):
            m = RAW_END[name].search(html, at)
            end = m.start() if m else len(html)
        else:
            return at
        if name == "style" and (self.stack[-1].attrs.get("media") or "all").strip().lower() in ("all", "screen") and not self.open.get("template") and not self.open.get("noscript"):
            self.sheet.add(html[at:end])
        self.text(html[at:end], name in RAW_WITH_REFERENCES)
        return end

    def foreign(self) -> bool:
        return bool(self.open.get("svg") or self.open.get("math"))

    def pop(self) -> None:
        self.open[self.stack.pop().name].pop()

    def end_of(self, names: frozenset[str], barrier: frozenset[str]) -> None:
        """Ends the innermost open element of names that no barrier shields."""
        at = max((self.open[n][-1] for n in names if self.open.get(n)), default=0)
        if at and all(self.open[n][-1] <= at for n in barrier if self.open.get(n)):
            while len(self.stack) > at:
                self.pop()

    def start(self, tag: str, attrs: dict[str, str | None], closed: bool = False) -> None:
        if tag == "html":
            return
        if self.open.get("head") and tag not in HEAD_ONLY and tag != "head":
            self.end_of(frozenset({"head"}), frozenset())
        if tag in CLOSES_P:
            self.end_of(frozenset({"p"}), SCOPE | {"button"})
        if tag in IMPLIED:
            self.end_of(*IMPLIED[tag])
        if tag in CONTEXT and self.open.get("table"):
            while self.stack[-1].name not in CONTEXT[tag] and len(self.stack) > 1:
                self.pop()
        elif tag == "table" and self.stack[-1].name in BETWEEN_CELLS:
            self.end_of(frozenset({"table"}), frozenset({"td", "th", "caption"}))
        if tag in ("td", "th") and self.stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            self.push("tr", {})
        self.push(tag, attrs)
        if tag in VOID or (closed and self.foreign()):
            self.pop()

    def push(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = Node(tag, attrs)
        self.put(node, tag in AT_HOME_THERE or (tag == "input" and (attrs.get("type") or "").lower() == "hidden"))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def put(self, child: Node | str, at_home: bool) -> None:
        """Adds a child, before the table if it may not stand between its cells."""
        if at_home or self.stack[-1].name not in BETWEEN_CELLS or not self.open.get("table"):
            self.stack[-1].children.append(child)
        else:
            self.stack[self.open["table"][-1]].before.append(child)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif self.open.get(tag) and tag not in VOID:
            table = tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "template")
            self.end_of(frozenset({tag}), frozenset({"table"}) - {tag} if table else SCOPE - {tag})

    def text(self, data: str, references: bool = True) -> None:
        data = decoded(data) if references else data
        if data:
            bare = data.strip()
            if self.stack[-1].name == "head" and bare:
                self.end_of(frozenset({"head"}), frozenset())
            self.put(data, not bare)


def laid_out(n: Node, display: str | None) -> bool:
    """Whether an element takes part in the layout."""
    if n.name in HIDDEN:
        return False
    if display:
        return display != "none"
    return "hidden" not in n.attrs and (n.name != "dialog" or "open" in n.attrs)


def in_order(children: list) -> Iterator:
    """Children, and before a table what its cells don't hold."""
    for c in children:
        if isinstance(c, Node):
            yield from c.before
        yield c


def shown_children(n: Node) -> list:
    """The children that an element shows: of closed details the summary, of a drop-down list the chosen option."""
    if n.name == "details" and "open" not in n.attrs:
        return next(([c] for c in n.children if isinstance(c, Node) and c.name == "summary"), [])
    if n.name == "select" and "multiple" not in n.attrs and number(n.attrs.get("size"), 1) <= 1:
        options, stack = [], list(reversed(n.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Node):
                if c.name == "option":
                    options.append(c)
                else:
                    stack.extend(reversed(c.children))
        chosen = [c for c in options if "selected" in c.attrs] or [c for c in options if "disabled" not in c.attrs and "hidden" not in c.attrs]
        return chosen[-1:] if any("selected" in c.attrs for c in options) else chosen[:1]
    return n.children


class Whole(str):
    """A preformatted line."""

    __slots__ = ()


class Lines:
    """Lines under construction; blank lines are asked for and collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.blank = False
        self.whole = False

    def word(self, s: str) -> None:
        flat = BLANK.sub(" ", s)
        if flat[:1] == " " and self.now:
            self.gap = True
        bare = flat.strip(" ")
        if bare:
            self.now.append(" " + bare if self.gap else bare)
            self.gap = flat[-1] == " "

    def end(self) -> None:
        """Ends the line if there is one."""
        if self.now:
            self.put("".join(self.now))
            self.now = []
        self.gap = False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(Whole(line) if self.whole else line)
        self.whole = False

    def space(self) -> None:
        self.end()
        self.blank = True


def number(v: str | None, default: int) -> int:
    """An attribute's integer; one that does not fit 32 bits is none, as in browsers."""
    m = INTEGER.match(v or "")
    if not m or len(m[1].lstrip("+-").lstrip("0")) > 10:
        return default
    n = int(m[1])
    return n if -(1 << 31) <= n < 1 << 31 else default


def columns(s: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


def wrapped(line: str) -> list[str]:
    """A line in parts of at most WRAP columns, cut between words; preformatted ones as they stand."""
    if isinstance(line, Whole) or columns(line) <= WRAP:
        return [line]
    out, now, width = [], [], 0
    for word in re.findall(" *[^ ]+", line):
        if now and width + columns(word) > WRAP:
            out.append("".join(now))
            now, width, word = [], 0, word.lstrip(" ")
        now.append(word)
        width += columns(word)
    return [*out, "".join(now)]


def count_mark(n: int, kind: str | None) -> str:
    """The mark of an item of an ordered list: 1, a, A, i or I."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ROMAN:
            out += sign * (n // value)
            n %= value
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


class Table:
    """Rows of cells (lines, column span, row span) and the row groups they end in."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.ends: list[int] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """Of each row the cells' columns, spans and lines; cells that reach down take their columns in the rows below."""
        out: list = []
        busy: list[tuple[int, int, int]] = []  # by column: the first, the one after the last, and the first row in which they are free
        ends = sorted({*self.ends, len(self.rows)})
        for r, row in enumerate(self.rows):
            at, k, cells, reach = 0, 0, [], []
            busy = [x for x in busy if x[2] > r]
            last = ends[bisect_right(ends, r)]
            for lines, span, down in row:
                while k < len(busy) and busy[k][0] <= at:
                    at = max(at, busy[k][1])
                    k += 1
                free = last if down == 0 else min(r + down, last)
                if free > r + 1:
                    if reach and reach[-1][1:] == (at, free):
                        reach[-1] = (reach[-1][0], at + span, free)
                    else:
                        reach.append((at, at + span, free))
                cells.append((at, span, [w for x in lines for w in wrapped(x)]))
                at += span
            busy = sorted(busy + reach) if reach else busy
            out.append(cells)
        return out

    def drawn(self) -> list[str]:
        if all(len(row) <= 1 and (not row or row[0][2] == 1) for row in self.rows):
            return [w for row in self.rows for lines, *_ in row for x in lines for w in wrapped(x)]
        rows = self.placed()
        width: dict[int, int] = {}
        for row in rows:
            for at, span, lines in row:
                if span == 1:
                    width[at] = max([width.get(at, 0), *(w for x in lines if (w := columns(x)) <= WRAP)])
        # Columns that no cell has to itself take no room.
        used = sorted(width)
        left = dict(zip(used, accumulate((width[c] + 2 for c in used), initial=0)))
        out = []
        for row in rows:
            rest = row
            for i in range(max((len(lines) for *_, lines in row), default=0)):
                parts, end = [], 0
                rest = [x for x in rest if i < len(x[2])]
                for at, _, lines in rest:
                    k = bisect_left(used, at)
                    start = left[used[k]] if k < len(used) else left[used[-1]] + width[used[-1]] + 2 if used else 0
                    if lines[i]:
                        room = max(start - end, 2 if end else 0)
                        parts += [" " * room, lines[i]]
                        end += room + columns(lines[i])
                out.append("".join(parts).rstrip())
        return out


MARKS = ("- ", "* ", "+ ")
#: Roman numerals.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def render(root: Node, sheet: Sheet) -> str:
    """The visible text of a tree."""
    outs = [Lines()]
    lists: list[list] = []  # open ones: kind, next number, type of marks, step
    tables: list[Table | None] = []  # None: too deep to be laid out
    pre = 0
    # Nodes to enter (or to leave, with what was begun), whether they are visible, and as what they flow.
    stack: list[tuple[Node | str, bool, object, bool, str]] = [(root, True, None, True, "")]
    while stack:
        n, entering, kept, seen, flow = stack.pop()
        out = outs[-1]
        if isinstance(n, str):
            if not seen:
                continue
            if pre:
                first, *rest = n.replace("\r\n", "\n").split("\n")
                out.now.append(first)
                for line in rest:
                    out.whole = True
                    out.put("".join(out.now))
                    out.now = [line]
                out.whole = True
            else:
                out.word(n)
            continue
        name = n.name
        if entering:
            style = sheet.style(n)
            display = style.get("display")
            if not laid_out(n, display):
                continue
            if style.get("visibility") in ("visible", "hidden", "collapse"):
                seen = style["visibility"] == "visible"
            flow = "spaced" if name in SPACED and not (name in ("ul", "ol") and lists) else "block" if name in BLOCKS else "inline"
            if display in FLOWS_INLINE and name not in TABLE_PARTS:
                flow = "inline"
            elif display in FLOWS_AS_BLOCK and name not in TABLE_PARTS and flow == "inline":
                flow = "block"
            if name == "br":
                out.put("".join(out.now))
                out.now, out.gap = [], False
                continue
            if name == "hr":
                out.space()
                out.put("---")
                out.space()
                continue
            if name in ("img", "input", "area", "col", "embed", "wbr"):
                kind = (n.attrs.get("type") or "text").lower()
                shown = n.attrs.get("alt") if name == "img" or (name == "input" and kind == "image") else n.attrs.get("value") if name == "input" and kind not in NO_VALUE else ""
                if shown and seen:
                    out.word(shown)
                continue
            if name in ("tr", "td", "th") and tables and not tables[-1]:
                out.end()
            elif name == "tr" and tables:
                tables[-1].rows.append([])
            elif name in ("td", "th") and tables and tables[-1].rows:
                outs.append(Lines())
                kept = "cell"
            elif name == "table":
                out.space()
                tables.append(Table() if len(outs) < DEEPEST else None)
                kept = "table"
            elif name == "li" and flow != "inline" and len(outs) < DEEPEST:
                out.end()
                outs.append(Lines())
                kept = "item"
            elif flow == "spaced":
                out.space()
            elif flow == "block":
                out.end()
            if name in ("ul", "ol", "menu", "dir"):
                back = name == "ol" and "reversed" in n.attrs
                first = sum(isinstance(c, Node) and c.name == "li" for c in n.children) if back else 1
                lists.append([name, number(n.attrs.get("start"), first) if name == "ol" else 0, n.attrs.get("type"), -1 if back else 1])
            if name == "li" and lists:
                lists[-1][1] = number(n.attrs.get("value"), lists[-1][1])
            if (name == "blockquote" or name == "dd") and flow != "inline" and len(outs) < DEEPEST:
                outs.append(Lines())
                kept = "indent"
            if name in KEPT:
                pre += 1
                if n.children and isinstance(n.children[0], str) and n.children[0][:1] == "\n":
                    n.children[0] = n.children[0][1:]
            if name == "q" and seen:
                out.word('"')
            stack.append((n, False, kept, seen, flow))
            stack.extend((c, True, None, seen, "") for c in reversed(list(in_order(shown_children(n)))))
            continue
        # Leaving.
        if name == "q" and seen:
            out.gap = False
            out.word('"')
        if name in KEPT:
            pre -= 1
        if name in ROW_GROUPS and tables and tables[-1]:
            tables[-1].ends.append(len(tables[-1].rows))
        if name in ("ul", "ol", "menu", "dir"):
            lists.pop()
        if kept == "cell":
            out.end()
            outs.pop()
            # The bounds of spans are those of HTML.
            span, down = number(n.attrs.get("colspan"), 1), number(n.attrs.get("rowspan"), 1)
            tables[-1].rows[-1].append((out.lines, min(span, 1000) if span > 0 else 1, min(down, 65534) if down >= 0 else 1))
        elif kept == "table":
            out.end()
            for line in t.drawn() if (t := tables.pop()) else ():
                out.whole = isinstance(line, Whole)
                out.put(line)
            out.space()
        elif kept in ("indent", "item"):
            out.end()
            outs.pop()
            mark = "    "
            if kept == "item":
                mark = f"{count_mark(lists[-1][1], n.attrs.get('type') or lists[-1][2])}. " if lists and lists[-1][0] == "ol" else MARKS[(len(lists) or 1) % 3 - 1]
            for i, line in enumerate(out.lines):
                outs[-1].whole = isinstance(line, Whole)
                outs[-1].put(mark + line if i == 0 and kept == "item" else (" " * len(mark) + line if line else ""))
            if kept == "indent" and name == "blockquote":
                outs[-1].space()
        elif flow == "spaced":
            out.space()
        elif flow == "block":
            out.end()
        if name == "li" and lists:
            lists[-1][1] += lists[-1][3]
    outs[0].end()
    return "\n".join(outs[0].lines).strip("\n")


def title_of(root: Node) -> str | None:
    stack = [root]
    while stack:
        n = stack.pop()
        if n.name == "title":
            return BLANK.sub(" ", "".join(c for c in n.children if isinstance(c, str))).strip() or None
        stack.extend(c for c in reversed(list(in_order(n.children))) if isinstance(c, Node) and c.name not in ("svg", "template"))
    return None


def extract(html: str | None) -> tuple[str, str | None]:
    """Visible text and title of a page."""
    if not html:
        return "", None
    tree = Tree()
    tree.feed(html.replace("\x00", "\ufffd").replace("\r\n", "\n").replace("\r", "\n"))
    return render(tree.root, tree.sheet), title_of(tree.root)


def extracted(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, text, n_chars, n_lines of every page."""
    bounded_batches(pages.sparkSession)
    kind = f"{key} long, title string, text string, n_chars long, n_lines long"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(x) for x in b.column(1).to_pylist()]
            text = [t for t, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for _, t in got], pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in text], pa.int64())], [key, "title", "text", "n_chars", "n_lines"])

    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(work, kind)


def op1(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
