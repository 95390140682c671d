"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a renderer of all visible text.

Builder: void and raw-text elements, comments, character references; a start tag closes what HTML says it closes (p, li, dt/dd, option, table
parts), table rows and bodies are implied, a stray end tag is ignored, what is open at the end is closed. Elements nest as deep as they like: neither the builder nor the renderer
calls itself.

Visibility: head, scripts, styles, templates and the like, ``hidden``, ``display:none``, hidden inputs and dialogs that aren't open give nothing with all they hold;
``visibility:hidden`` gives nothing but descendants made visible again; the content of a closed ``details`` is hidden but for its summary.

Rendering: blocks begin on lines of their own, paragraphs and the like are set off by an empty line, white space is collapsed except in
``pre``; list items have their bullet or number and are indented by nesting, as far as the first ``LEVELS`` levels; the cells of a table stand in columns of equal width, spans included.
Two cells in a line always have ``GAP`` between them. Cells longer than ``CELL`` don't widen their column, and columns that would begin beyond ``ALIGNED`` characters aren't aligned, so that a line of a
table is never longer than the text of its cells and ``ALIGNED`` spaces for each: a page's text grows with its html, whatever its tables hold.

Nulls: null html gives an empty text and title. A null page_id or url is kept. Repeated rows are rendered each. An empty table gives
an empty result. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of nesting that indent a line.
LEVELS = 40
#: Columns that one cell may span.
SPAN = 1000
#: Spaces between two cells; characters of the longest cell that columns are widened for, and how far into a line columns are aligned.
GAP, CELL, ALIGNED = 2, 80, 160

# Names of elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist area param source track meta link base rp desc metadata defs symbol".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section nav aside header footer main form fieldset menu address hr".split())
LINED = frozenset("div dialog li dt dd tr caption legend figcaption details summary html body center dir hgroup optgroup option search thead tbody tfoot td th".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag: the open elements that it closes, and those beyond which it doesn't look.
LISTS, CELLS = frozenset("ul ol menu dir table td th".split()), frozenset("td th caption table template html".split())
CLOSES = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, frozenset({"dl", "table", "td", "th"})), "dd": ({"dt", "dd"}, frozenset({"dl", "table", "td", "th"})),
    "option": ({"option"}, frozenset({"select", "datalist"})), "optgroup": ({"option", "optgroup"}, frozenset({"select"})),
    "tr": ({"tr", "td", "th", "caption"}, frozenset({"table"})), "td": ({"td", "th"}, frozenset({"table"})), "th": ({"td", "th"}, frozenset({"table"})),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, frozenset({"table"})), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, frozenset({"table"})),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, frozenset({"table"})), "a": ({"a"}, frozenset({"table", "td", "th"})),
}

TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>)""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
#: Only tags that say one of these need their attributes read.
TELLING = re.compile(r"hidden|style|span|type|start|value|open", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
EDGES = " \t\n\r\f"


class Node:
    __slots__ = ("tag", "said", "inner")

    def __init__(self, tag: str, said: str = ""):
        self.tag, self.said, self.inner = tag, said, []

    def attributes(self) -> dict[str, str]:
        if not self.said or not TELLING.search(self.said):
            return {}
        out: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.said):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return out


def parsed(html: str) -> Node:
    """The tree of a page or fragment."""
    root = Node("#root")
    stack, at, end, loose = [root], 0, len(html), False
    places: dict[str, list[int]] = {}  # of each name: where its open elements stand in the stack

    def text(piece: str) -> None:
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            if stack[-1].tag in ("table", "thead", "tbody", "tfoot", "tr") and not piece.strip(EDGES):
                return
            stack[-1].inner.append(piece)

    def open_(node: Node) -> None:
        stack[-1].inner.append(node)
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def close(names: set[str] | frozenset[str], scope: frozenset[str], all_: bool = False) -> None:
        """Closes the innermost element with one of the names, or the outermost, within the innermost element of the scope."""
        own = [places[n] for n in names if places.get(n)]
        if not own:
            return
        bound = max((places[n][-1] for n in scope if places.get(n)), default=0)
        within = [x[bisect_right(x, bound)] if all_ else x[-1] for x in own if x[-1] > bound]
        if within:
            lowest = min(within) if all_ else max(within)
            while len(stack) > lowest:
                places[stack.pop().tag].pop()

    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            text(html[at:])
            break
        m = LOOSE.match(html, begin) if loose else TAG.match(html, begin)
        if loose and m is None and html.startswith(("<!", "<?"), begin):
            m = TAG.match(html, begin)
        if m is None:
            if html.find(">", begin) < 0:
                text(html[at:])
                break
            if not loose and LOOSE.match(html, begin):
                loose = True  # a quote that is never closed: from here on, tags end at the first >
                continue
            text(html[at : begin + 1])
            at = begin + 1
            continue
        text(html[at:begin])
        if m.re is TAG and (m[1] or m[2]):
            mark = "-->" if m[1] else ">"
            stop = html.find(mark, begin + (4 if m[1] else 2))
            at = end if stop < 0 else stop + len(mark)
            continue
        slash, name, said = (m[3], m[4], m[5]) if m.re is TAG else (m[1], m[2], m[3])
        name, at = name.lower(), m.end()
        if slash:
            if name == "br":
                stack[-1].inner.append(Node("br"))
            elif name in HEADINGS:
                close(HEADINGS, CELLS)
            else:
                close({name}, frozenset() if name in ("table", "html", "body") else frozenset({"table"}) if name in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else CELLS)
            continue
        if name in ENDS_P:
            close({"p"}, CELLS)
        if name in CLOSES:
            close(*CLOSES[name], all_=name in ("tr", "thead", "tbody", "tfoot"))
        top = stack[-1].tag
        if name in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
            if top == "table":
                open_(Node("tbody"))
            open_(Node("tr"))
        elif name == "tr" and top == "table":
            open_(Node("tbody"))
        node = Node(name, said)
        if name in VOID or (said.endswith("/") and name in ("svg", "path")):
            stack[-1].inner.append(node)
        elif name in RAW:
            stop = re.compile(f"</{name}[\\s/>]", re.I).search(html, at)
            inner = html[at : stop.start() if stop else end]
            node.inner.append(unescape(inner) if name in ("title", "textarea") else inner)
            stack[-1].inner.append(node)
            close_at = html.find(">", stop.start()) if stop else -1
            at = end if close_at < 0 else close_at + 1
        else:
            open_(node)
    return root


class Page:
    """Text under construction: what is written goes on the current line; breaks are kept until more text comes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.breaks = 0
        self.space = False
        self.indent: list[str] = []
        self.marker = ""

    def block(self, lines: int) -> None:
        """The next text stands at least that many lines below."""
        if self.now or self.lines:
            self.breaks = max(self.breaks, lines)
        self.space = False

    def _begin(self) -> None:
        if self.breaks:
            if self.now:
                self.lines.append("".join(self.now))
                self.now = []
            self.lines += [""] * (self.breaks - 1)
            self.breaks = 0
        if not self.now:
            lead = "".join(self.indent[:LEVELS])
            if self.marker:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            if lead:
                self.now.append(lead)
            self.space = False

    def write(self, text: str) -> None:
        flat = SPACE.sub(" ", text)
        if flat == " " or not flat:
            self.space = self.space or bool(flat and self.now and not self.breaks)
            return
        lead, tail = flat[0] == " ", flat[-1] == " "
        fresh = not self.now or self.breaks > 0
        self._begin()
        if (lead or self.space) and not fresh:
            self.now.append(" ")
        self.now.append(flat.strip(" "))
        self.space = tail

    def line(self, text: str) -> None:
        """A line as it is."""
        self._begin()
        self.now.append(text)
        self.breaks = 1

    def newline(self) -> None:
        """A break that adds to those before it."""
        if self.now or self.lines:
            self.breaks += 1
        self.space = False

    def done(self) -> list[str]:
        if self.now:
            self.lines.append("".join(self.now))
        out = [x.rstrip() for x in self.lines]
        while out and not out[-1]:
            out.pop()
        return out


def _hidden(node: Node, said: dict[str, str]) -> bool:
    style = said.get("style", "").lower().replace(" ", "")
    return "hidden" in said or "display:none" in style or (node.tag == "dialog" and "open" not in said) or (node.tag == "input" and said.get("type", "").lower() == "hidden")


def _number(value: str | None, usual: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?\d{1,9}\s*", value) else usual


Step = tuple[Node, Page, bool, bool, list | None]


def render(node: Node, page: Page) -> None:
    """All visible text below a node. A step that comes to an element hands it over and goes on when it is done, so that depth costs no calls."""
    running = [_steps(node, page, True, False, None)]
    while running:
        below = next(running[-1], None)
        if below is None:
            running.pop()
        else:
            running.append(_steps(*below))


def _steps(node: Node, page: Page, seen: bool, pre: bool, items: list | None) -> Iterator[Step]:
    for x in node.inner:
        if isinstance(x, str):
            if not seen:
                continue
            if pre:
                pieces = x.split("\n")
                for i, piece in enumerate(pieces):
                    if i:
                        page.newline()
                    if piece:
                        page._begin()
                        page.now.append(piece)
            else:
                page.write(x)
            continue
        tag = x.tag
        if tag in UNSEEN:
            continue
        said = x.attributes()
        if (said or tag == "dialog") and _hidden(x, said):
            continue
        shown = seen
        if said and (found := re.search(r"visibility\s*:\s*(\w+)", said.get("style", ""), re.I)):
            shown = found[1].lower() not in ("hidden", "collapse")
        if tag == "br":
            if seen:
                page.newline()
        elif tag == "hr":
            page.block(2)
        elif tag == "table":
            page.block(2)
            yield from _table(x, page, shown)
            page.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if items is not None else 2)
            yield x, page, shown, pre, [tag == "ol", _number(said.get("start"), 1)]
            page.block(1 if items is not None else 2)
        elif tag == "li":
            own = items or [False, 1]
            if own[0]:
                own[1] = _number(said.get("value"), own[1])
            mark = f"{own[1]}. " if own[0] else "- "
            own[1] += 1
            page.block(1)
            page.indent.append(" " * len(mark))
            page.marker = mark
            yield x, page, shown, pre, []
            page.marker = ""
            page.indent.pop()
            page.block(1)
        elif tag in ("dd", "blockquote"):
            page.block(1 if tag == "dd" else 2)
            page.indent.append("  ")
            yield x, page, shown, pre, None
            page.indent.pop()
            page.block(1 if tag == "dd" else 2)
        elif tag == "details" and "open" not in said:
            page.block(1)
            only = Node("details")
            only.inner = [y for y in x.inner if isinstance(y, Node) and y.tag == "summary"][:1]
            yield only, page, shown, pre, None
            page.block(1)
        else:
            gap = 2 if tag in SPACED else 1 if tag in LINED else 0
            if gap:
                page.block(gap)
            yield x, page, shown, pre or tag in ("pre", "textarea", "xmp"), None if gap == 2 else items
            if gap:
                page.block(gap)


def _rows(table: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
    """The rows of a table with their visibility: head, bodies in order, foot."""
    parts: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
    for x in table.inner:
        if isinstance(x, Node) and x.tag in parts:
            said = x.attributes()
            if not _hidden(x, said):
                parts[x.tag] += [(y, seen) for y in x.inner if isinstance(y, Node) and y.tag == "tr"]
    return iter([*parts["thead"], *parts["tbody"], *parts["tfoot"]])


def _rest(node: Node) -> Node:
    """What stands in a table outside of its cells, as a block of its own."""
    out = Node("div")
    for x in node.inner:
        if isinstance(x, str) or x.tag not in ("thead", "tbody", "tfoot", "tr", "td", "th"):
            out.inner.append(x)
        elif x.tag in ("thead", "tbody", "tfoot", "tr") and not _hidden(x, x.attributes()):
            inner = _rest(x)
            if inner.inner:
                out.inner.append(inner)
    return out


def _table(table: Node, page: Page, seen: bool) -> Iterator[Step]:
    rest = _rest(table)
    if rest.inner:
        yield rest, page, seen, False, None
        page.block(1)
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows for which a cell above still holds it
    for row, shown in _rows(table, seen):
        said = row.attributes()
        if said and _hidden(row, said):
            continue
        cells, column = [], 0
        for x in row.inner:
            if not isinstance(x, Node) or x.tag not in ("td", "th"):
                continue
            said = x.attributes()
            if said and _hidden(x, said):
                continue
            while taken.get(column, 0) > 0:
                column += 1
            wide, high = min(SPAN, max(1, _number(said.get("colspan"), 1))), max(1, _number(said.get("rowspan"), 1))
            inner = Page()
            yield x, inner, shown, False, None
            cells.append((column, wide, inner.done()))
            if high > 1:
                for k in range(column, column + wide):
                    taken[k] = high
            column += wide
        for k in [k for k in taken]:
            taken[k] -= 1
            if taken[k] <= 0:
                del taken[k]
        grid.append(cells)
    starts = _starts(grid)
    for cells in grid:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    own = starts.get(column, 0)
                    # what begins a line may be a table's line, indented by its own columns: no further than ALIGNED in all
                    line = line.ljust(max(own, len(line) + GAP) if line else min(own, max(0, ALIGNED - len(lines[i]) + len(lines[i].lstrip())))) + lines[i]
            page.line(line.rstrip())


def _starts(grid: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """Where in a line the columns begin that hold cells, as far as they are aligned."""
    widths: dict[int, int] = {}
    spanning = []
    for cells in grid:
        for column, wide, lines in cells:
            widths.setdefault(column, 0)
            size = max((n for n in map(len, lines) if n <= CELL), default=0)
            if wide == 1:
                widths[column] = max(widths[column], size)
            elif size:
                spanning.append((column, wide, size))
    for column, wide, size in spanning:
        have = sum(widths[k] + GAP for k in range(column, column + wide) if widths.get(k)) - GAP
        if size > max(have, 0):
            last = column + wide - 1
            # a last column without a width gets a gap of its own, which the span covers
            more = size - (have + GAP if have > 0 and not widths.get(last) else max(have, 0))
            widths[last] = widths.get(last, 0) + max(more, 0)
    starts, at = {}, 0
    for k in sorted(widths):
        if at > ALIGNED:
            break
        starts[k] = at
        at += widths[k] + GAP if widths[k] else 0
    return starts


def extracted(html: str | None) -> tuple[str, str]:
    """(title, text) of a page."""
    root = parsed(html or "")
    page = Page()
    render(root, page)
    return SPACE.sub(" ", _title(root)).strip(), "\n".join(page.done())


def _title(root: Node) -> str:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return "".join(x for x in node.inner if isinstance(x, str))
        if node.tag != "body":
            todo += [x for x in reversed(node.inner) if isinstance(x, Node)]
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(256, batch.num_rows))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            found = [extracted(h) for h in part.column(2).to_pylist()]
            texts = [t for _, t in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([t for t, _ in found], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["page_id", "url", "title", "text", "n_chars", "n_lines"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, n_chars, n_lines: one row per page, where the page lies, without a shuffle."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, title string, text string, n_chars long, n_lines long")
