"""Text of web pages as they are laid out: blocks apart, lists marked, table cells aligned.

A tree builder reads tags, implies the ends that authors leave out, and keeps the open elements
on a stack with whether they are visible. A renderer writes into the buffer of the innermost
list item, quote or table cell; a finished buffer goes into the one around it.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import defaultdict, deque
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import per_text

#: A comment, a declaration, a tag, text, or a "<" that begins none of these. Quotes count after a "=" only.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>|[^<]++|<""", re.S
)
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
SPACES = re.compile(r"[ \t\n\r\f]+")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)

#: Elements of HTML by the way they are read and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist audio video canvas defs desc metadata".split())
HEAD = frozenset("html head meta link base title style script template noscript".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu dir".split())  # with a blank line around
BLOCK = APART | frozenset("address article aside body center details summary div dd dt figcaption footer form header hr html legend li main nav option optgroup section select tbody thead tfoot tr td th caption search hgroup".split())
ENDS_P = BLOCK - frozenset("body html option optgroup select legend summary td th tr tbody thead tfoot caption".split())
#: A start tag ends these open elements, up to the ones that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
}
WALLS = frozenset("td th caption table button object template html".split())  # end tags inside don't reach beyond
#: So that no page becomes much longer than its source: quotes and items are indented in so many outer levels; a table has
#: room for so many characters of padding for each cell and line; below so many levels of tables, lines give no room.
#: Columns are as wide as their longest line, or, if that takes more room, at most so wide. All text is there in any case.
DEEPEST, ROOM, TALL, WIDEST = 30, 128, 4, 60
#: The largest spans of cells.
COLSPAN, ROWSPAN = 1000, 65_534


class Buffer:
    """Lines of one box. Inline text collapses white space; blocks end lines and may ask for a blank one.

    Lines are moved up to the box around it, the fewer to the more, and what marks the first line (innermost
    mark first) is kept apart until another line comes before it: deep nesting copies no line at each level.
    """

    def __init__(self, inner: bool = True) -> None:
        self.inner = inner  # of an element: spaces at the ends of its lines go
        self.lines: deque[str] = deque()
        self.marks: list[str] = []
        self.line: list[str] = []
        self.blank = False

    def text(self, text: str) -> None:
        if SPACES.fullmatch(text):
            text = " "
        if not self.line and text[0] in " \t\n\r\f":
            text = text.lstrip(" \t\n\r\f")
        if text:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(text)

    def verbatim(self, text: str) -> None:
        if self.blank and self.lines and not self.line:
            self.lines.append("")
        self.blank = False
        first, *rest = text.split("\n")
        if first:
            self.line.append(first)
        for x in rest:
            self.new_line()
            if x:
                self.line.append(x)

    def new_line(self) -> None:
        """The line ends here, even if it is empty."""
        line = "".join(self.line)
        self.lines.append(line.rstrip() if self.inner else line)
        self.line = []

    def end_line(self, collapse: bool = True) -> None:
        if self.line:
            line = "".join(self.line)
            if collapse:
                self.lines.append(SPACES.sub(" ", line).strip(" "))
            else:
                self.lines.append(line.rstrip() if self.inner else line)
            self.line = []

    def apart(self) -> None:
        self.blank = self.blank or bool(self.lines)

    def add(self, box: Buffer, first: str = "", rest: str = "") -> None:
        """Takes over the lines of ``box``."""
        lines, marks = box.lines, box.marks
        if not lines:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if rest:
            head = lines.popleft()
            lines = deque((rest + x).rstrip() for x in lines)
            lines.appendleft(head)
        if first:
            marks.append(first)
        if not self.lines:
            self.lines, self.marks = lines, marks
            return
        if marks:
            lines[0] = ("".join(reversed(marks)) + lines[0]).rstrip()
        if len(lines) > len(self.lines):
            lines.extendleft(reversed(self.lines))
            self.lines = lines
        else:
            self.lines.extend(lines)

    def done(self) -> Buffer:
        """Without blank lines at the end."""
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self

    def flat(self) -> deque[str]:
        """All lines, with the marks of the first."""
        if self.marks and self.lines:
            self.lines[0] = ("".join(reversed(self.marks)) + self.lines[0]).rstrip()
            self.marks = []
        return self.lines


@dataclass
class Table:
    """Rows of cells: (box, columns it spans, rows it spans)."""

    rows: list[list[tuple[Buffer, int, int]]] = field(default_factory=list)

    def places(self) -> list[dict[int, Buffer]]:
        """The cells with text by column, for each row that has any.

        Free columns are kept as intervals: a cell over several rows takes its columns out, and they come back
        after its last row. Where one from above stands in its way, a cell fills what is free before that.
        """
        free, back = [(0, sys.maxsize)], defaultdict(list)
        grid = []
        for r, row in enumerate(self.rows):
            for a, b in back.pop(r, ()):
                k = bisect_right(free, (a, b))
                low, high = k - (k > 0 and free[k - 1][1] == a), k + (free[k][0] == b)
                free[low:high] = [(min(a, free[low][0]), max(b, free[high - 1][1]))] if low < high else [(a, b)]
            cells: dict[int, Buffer] = {}
            at = 0
            for box, across, down in row:
                k = bisect_right(free, (at, sys.maxsize)) - 1
                if k < 0 or free[k][1] <= at:
                    k += 1
                a, b = free[k]
                at = max(a, at)
                if box.lines:
                    cells[at] = box
                if down > 1:
                    stop = min(b, at + across)
                    free[k : k + 1] = [x for x in ((a, at), (stop, b)) if x[0] < x[1]]
                    back[r + down].append((at, stop))
                at += across
            if cells:
                grid.append(cells)
        return grid

    def render(self, level: int) -> Buffer:
        """The rows, their cells aligned and apart by " | ". ``level`` counts the tables around it and itself.

        Where aligning takes more than the room there is, the texts of a row follow each other, on one line if
        each has only one. The time is in proportion to the cells, lines and padding.
        """
        grid, out = self.places(), Buffer()
        columns = sorted({k for cells in grid for k in cells})
        short = all(len(box.lines) == 1 for cells in grid for box in cells.values())
        if len(columns) > 1 and (short or level <= TALL):
            place = {k: i for i, k in enumerate(columns)}
            lines: list[dict[int, str]] = []
            for cells in grid:
                own: list[dict[int, str]] = [{} for _ in range(max(len(box.lines) for box in cells.values()))]
                for k, box in cells.items():
                    for x, line in zip(box.flat(), own, strict=False):
                        if x.strip():
                            line[place[k]] = x
                lines += own
            widths = [0] * len(columns)
            for line in lines:
                for k, x in line.items():
                    widths[k] = max(widths[k], len(x))
            room = ROOM * (sum(map(len, self.rows)) + (len(lines) if level <= TALL else 0))
            for most in (sys.maxsize, WIDEST):
                wide = [min(x, most) for x in widths]
                before = list(accumulate((x + 3 for x in wide), initial=0))
                if sum(before[max(line)] - sum(min(wide[k], len(x)) for k, x in line.items()) for line in lines if line) <= room:
                    for line in lines:
                        out.lines.append(" | ".join([line.get(k, "").ljust(wide[k]) for k in range(max(line, default=-1) + 1)]).rstrip(" "))
                    return out
        for cells in grid:
            if len(cells) > 1 and all(len(box.lines) == 1 for box in cells.values()):
                out.lines.append(" | ".join([box.flat()[0] for box in cells.values()]))
            else:
                for box in cells.values():
                    out.add(box)
        return out


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return found


def number(text: str | None, low: int, high: int, other: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(high, max(low, int(m[1]))) if m else other


@dataclass(slots=True)
class Element:
    tag: str
    displayed: bool
    visible: bool
    verbatim: bool
    known: dict[str, str]

    @property
    def closed(self) -> bool:
        """Whether only its summary is shown."""
        return self.tag == "details" and "open" not in self.known


class Page:
    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # tag -> where it stands on the stack
        self.buffers = [Buffer(inner=False)]
        self.tables: list[Table] = []
        self.lists: list[list] = []  # [numbered, next number, step, items that wait for their number]
        self.skip = False  # a line's end that comes next is no text

    # Tree builder

    def start(self, tag: str, raw: str) -> None:
        if tag not in HEAD and self.places["head"]:
            self.end("head")
        if tag in ENDS_P and self.places["p"]:
            self._end_up_to({"p"}, WALLS)
        if tag in ENDS:
            inner, outer = ENDS[tag]
            self._end_up_to(inner, outer)
        if tag in ("html", "body") and self.places[tag]:
            return
        if tag in ("td", "th") and self._last({"tr"}) <= self._last({"table"}) and self.places["table"]:
            self.start("tr", "")
        known = attributes(raw) if raw.strip(" /") else {}
        top = self.stack[-1] if self.stack else Element("", True, True, False, {})
        self.skip = tag in ("pre", "textarea", "listing")
        style = known.get("style", "")
        displayed = top.displayed and tag not in UNSEEN and "hidden" not in known and not NO_DISPLAY.search(style) and (tag != "dialog" or "open" in known)
        if top.closed and tag != "summary":
            displayed = False
        stated = VISIBILITY.search(style)
        visible = stated[1].lower() not in ("hidden", "collapse") if stated and stated[1].lower() != "inherit" else top.visible
        if tag in VOID:
            if displayed:
                self._void(tag, known if visible else {})
            return
        self.places[tag].append(len(self.stack))
        self.stack.append(Element(tag, displayed, visible, tag in ("pre", "xmp", "textarea") or top.verbatim, known))
        if displayed:
            self._enter(tag, known)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif self.places[tag]:
            self._end_up_to({tag}, WALLS - {tag})
        elif tag == "p" and (not self.stack or self.stack[-1].displayed):
            self.buffers[-1].end_line()
            self.buffers[-1].apart()

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        """Where the innermost open element of ``tags`` stands; -1 for none."""
        return max([at[-1] for t in tags if (at := self.places.get(t))], default=-1)

    def _end_up_to(self, tags: set[str], outer: set[str] | frozenset[str]) -> None:
        """Ends the outermost open element of ``tags`` that no one of ``outer`` holds (of a single tag the innermost), with all in it."""
        wall = self._last(outer)
        if len(tags) == 1:
            found = [x for x in [self._last(tags)] if x > wall]
        else:
            found = [at[k] for t in tags if (at := self.places.get(t)) and (k := bisect_right(at, wall)) < len(at)]
        if found:
            self._close(min(found))

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            x = self.stack.pop()
            self.places[x.tag].pop()
            if x.displayed:
                self._leave(x.tag, x.known)

    def text(self, text: str) -> None:
        top = self.stack[-1] if self.stack else None
        skip, self.skip = self.skip, False
        if top and (top.closed or not (top.displayed and top.visible)):
            return
        text = unescape(text) if "&" in text else text
        if top and top.verbatim:
            text = text.replace("\r\n", "\n")
            self.buffers[-1].verbatim(text[1:] if skip and text[:1] == "\n" else text)
        elif text:
            self.buffers[-1].text(text)

    # Renderer

    def _void(self, tag: str, known: dict[str, str]) -> None:
        if tag == "br":
            out = self.buffers[-1]
            if out.line:
                out.end_line()
            elif out.lines:
                out.apart()
        elif tag == "hr":
            self.buffers[-1].end_line()
            self.buffers[-1].apart()
        elif tag == "input" and known.get("type", "").lower() in ("submit", "button", "reset") and known.get("value"):
            self.buffers[-1].text(known["value"])

    def _enter(self, tag: str, known: dict[str, str]) -> None:
        out = self.buffers[-1]
        if tag in BLOCK:
            out.end_line(collapse=not self.stack[-1].verbatim)
            if tag in APART and not (tag in ("ul", "ol") and self.lists):
                out.apart()
        if tag in ("ul", "ol", "menu", "dir"):
            down = tag == "ol" and "reversed" in known
            waiting = [] if down and "start" not in known else None  # its first number is the number of its items
            self.lists.append([tag == "ol", number(known.get("start"), -(10**9), 10**9, 1), -1 if down else 1, waiting])
        elif tag in ("li", "blockquote", "dd", "td", "th"):
            self.buffers.append(Buffer())
        elif tag == "table":
            self.tables.append(Table())
        if tag == "tr" and self.tables:
            self.tables[-1].rows.append([])

    def _leave(self, tag: str, known: dict[str, str]) -> None:
        out = self.buffers[-1]
        if tag == "pre":
            out.end_line(collapse=False)
        if tag in ("ul", "ol", "menu", "dir"):
            out.end_line()
            if self.lists:
                *_, waiting = self.lists[-1]
                if waiting:
                    self.lists[-1][1:] = [len(waiting), -1, None]
                    for box, value in waiting:
                        self._item(box, value)
                self.lists.pop()
        elif tag in ("li", "blockquote", "dd", "td", "th"):
            box = self.buffers.pop().done()
            out = self.buffers[-1]
            deep = len(self.buffers) > DEEPEST
            if tag == "li":
                if self.lists and self.lists[-1][3] is not None:
                    self.lists[-1][3].append((box, known.get("value")))
                else:
                    self._item(box, known.get("value"))
            elif tag in ("td", "th") and self.tables:
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append((box, number(known.get("colspan"), 1, COLSPAN, 1), number(known.get("rowspan"), 1, ROWSPAN, 1)))
            elif tag == "blockquote":
                out.add(box, "> ", "" if deep else "> ")
            else:
                out.add(box, "" if deep else "  ", "" if deep else "  ")
        elif tag == "table" and self.tables:
            out.end_line()
            level = len(self.tables)
            out.add(self.tables.pop().render(level))
        if tag in BLOCK:
            out.end_line()
            if tag in APART and not (tag in ("ul", "ol") and self.lists):
                out.apart()

    def _item(self, box: Buffer, value: str | None) -> None:
        mark = "- "
        if self.lists and self.lists[-1][0]:
            at = number(value, -(10**9), 10**9, self.lists[-1][1])
            mark = f"{at}. "
            self.lists[-1][1] = at + self.lists[-1][2]
        self.buffers[-1].add(box, mark, "" if len(self.buffers) > DEEPEST else " " * len(mark))


def render(html: str) -> str:
    """The visible text of ``html``; its length and the time are in proportion to the page, however deep it nests or wide it spans.

    Never fails: what is no tag counts as text. A tag whose quotes don't end is ended by the next ">";
    if none follows, the rest of the page is text.
    """
    page, at, n = Page(), 0, len(html)
    last = html.rfind(">")
    while at < n:
        m = TAG.match(html, at) if at <= last else None
        if m is None:
            page.text(html[at:])
            break
        if m[2] is None and m[0] == "<":
            m = BROKEN.match(html, at) or m
        at = m.end()
        tag = m[2] if m.re.groups and m.lastindex else None
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                page.text(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, m[3])
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = close.start() if close else n
            page.text(html[at:stop])
            at = stop
            if not close:
                page.end(tag)
    page._close(0)
    return "\n".join(page.buffers[0].done().flat())


def extract(html: Column) -> Column:
    """The text of each page; "" for null."""
    return per_text(lambda: lambda value: (render(value),), "text string", ["text"])(html)["text"]


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text for every row of ``pages`` (page_id, url, html), in one narrow pass.

    Null and empty pages have the text "". Pages are read whole; nesting of any depth needs no
    recursion. Repeated rows repeat; other columns are ignored.
    """
    return pages.select("page_id", "url", extract(F.col("html")).alias("text"))
