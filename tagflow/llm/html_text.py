"""Layout-aware rendering of HTML to text.

A tree builder closes what the next tag implies (paragraphs, list items, rows, cells, options) and opens the row that a
cell needs, visibility rules leave out what a reader never sees, and the renderer keeps the layout: blocks on lines of
their own, blank lines around paragraphs and headings, markers and indents of lists, preformatted text as it is, and
table cells padded into columns. Cells take the columns that spans from rows above leave free; a spanning cell widens
its last column if it must. A cell wider than ALIGNED characters pushes the rest of its row instead of padding all
others. What lies in a row outside its cells stands above the table. Lists are indented up to INDENTED characters.

A page is scanned once, forwards. A quote that no other closes is a character; a page in which some tag ends only
inside a quoted value is read without quotes from there on; a tag that nothing ends is text.

Cases: a null page gives null; an empty one, or one without visible text, gives an empty text. Unclosed, stray and
misnested tags are mended, tags nested deeper than MAX_DEPTH (as deep as browsers go) become siblings at that depth, and
no text is lost by it. Repeated rows are rendered as often. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, ALIGNED, INDENTED = 512, 200, 100

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("html body div section article aside header footer main nav form address li dt dd tr td th thead tbody tfoot caption details summary figcaption legend option optgroup dialog menu".split())
KEPT_AS_IT_IS = frozenset("pre listing xmp plaintext textarea".split())
GROUPS = frozenset("thead tbody tfoot".split())
#: What an opening tag closes, up to the nearest of the scopes named behind.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
SCOPES = frozenset({"table", "td", "th", "button", "caption", "html", "body"})

OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VALUE = re.compile(r"\s*")
UNDISPLAYED = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
LONG_NUMBER = re.compile(r"&#0*[0-9]{8,};?")


class Element:
    __slots__ = ("attributes", "children", "holds_cells", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.holds_cells = tag, attributes, [], False

    def get(self, name: str) -> str | None:
        for key, value in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return unescaped(value[1:-1] if value[:1] in "\"'" and value[:1] == value[-1:] and len(value) > 1 else value)
        return None

    def style(self) -> str:
        return (self.get("style") or "") if "style" in self.attributes.lower() else ""

    def unseen(self) -> bool:
        """Whether neither the element nor anything in it is displayed."""
        if self.tag in UNSEEN or (self.tag == "dialog" and self.get("open") is None):
            return True
        a = self.attributes
        return bool(a) and (("hidden" in a.lower() and self.get("hidden") is not None) or bool(UNDISPLAYED.search(self.style())))

    def shown(self, inherited: bool) -> bool:
        """Whether its own text is visible; what is in it may say otherwise for itself."""
        found = VISIBILITY.findall(self.style()) if self.attributes else []
        return found[-1].lower() == "visible" if found else inherited


def unescaped(s: str) -> str:
    if "&" not in s:
        return s
    return html.unescape(LONG_NUMBER.sub("�", s) if "&#" in s else s)


class Scanner:
    """Finds where tags end, in one pass over the page."""

    STOP = re.compile(r"[>=]")

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, {q: page.rfind(q) for q in "\"'"}, True

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ended at ``at``, or -1."""
        page, begin = self.page, at
        while self.quoted:
            m = self.STOP.search(page, at)
            if m is None:
                self.quoted = False  # only quoted values hold a >, if anything does
                break
            if m[0] == ">":
                return m.start()
            at = VALUE.match(page, m.end()).end()
            q = page[at : at + 1]
            if q in self.last and q and self.last[q] > at:
                at = page.index(q, at + 1) + 1
        return page.find(">", begin)


def tree(page: str) -> Element:
    root, scanner = Element("html"), Scanner(page)
    stack, at, text_from = [root], 0, 0
    foreign = 0

    def close(tags: set[str], scopes: set[str] | frozenset[str]) -> None:
        """Pops up to the outermost open element of ``tags`` that is inside the nearest of ``scopes``."""
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in scopes and stack[k].tag not in tags:
                break
            if stack[k].tag in tags:
                cut = k
        if cut:
            del stack[cut:]

    def text(upto: int) -> None:
        if upto > text_from:
            stack[-1].children.append(unescaped(page[text_from:upto]))

    def opened(name: str, attributes: str) -> Element:
        node = Element(name, attributes)
        stack[-1].children.append(node)
        return node

    while (m := OPENING.search(page, at)) is not None:
        begin, name = m.start(), (m[2] or "").lower()
        if not name:
            text(begin)
            if m[0] == "<!--":
                short = page.startswith((">", "->"), m.end())
                end = None if short else COMMENT_END.search(page, m.end())
                at = page.index(">", m.end()) + 1 if short else end.end() if end else len(page)
            elif foreign and page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                stack[-1].children.append(page[begin + 9 : end if end >= 0 else len(page)])
                at = end + 3 if end >= 0 else len(page)
            else:
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else len(page)
            text_from = at
            continue
        end = scanner.tag_end(m.end())
        if end < 0:
            break  # nothing ends a tag any more: the rest is text
        text(begin)
        attributes = page[m.end() : end].rstrip("/")
        text_from = at = end + 1
        if m[1] and name != "br":
            foreign -= foreign > 0 and name in ("svg", "math")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and name not in SCOPES and name != "tr" and name not in GROUPS:
                    break
            continue
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif name in BLOCKS:
            close({"p"}, SCOPES)
        if name in ("body", "html"):
            continue
        if name in ("td", "th"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "tr":
                    for part in stack[k + 1 :]:
                        part.holds_cells = True
                    break
                if stack[k].tag == "table":  # a cell without a row opens one
                    if stack[-1].tag == "table" or stack[-1].tag in GROUPS:
                        stack.append(opened("tr", ""))
                    break
        node = opened(name, attributes)
        foreign += name in ("svg", "math")
        if name in RAW and not (foreign and name == "title"):
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at) if name != "plaintext" else None
            inside = page[at : found.start() if found else len(page)]
            node.children.append(unescaped(inside) if name in ("textarea", "title") else inside)
            text_from = at = found.end() if found else len(page)
        elif name not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
        if name in KEPT_AS_IT_IS and node.children:
            node.children[0] = re.sub(r"\A\r?\n", "", node.children[0])
        elif name in KEPT_AS_IT_IS and page.startswith(("\n", "\r\n"), at):
            text_from = at = page.index("\n", at) + 1
    text(len(page))
    return root


class Lines:
    """Text laid out so far: finished lines, the open line in parts, and the blank lines due before the next.

    Lines begin with ``prefix``, the next one with ``mark`` if there is one. ``base``: lines done where the item began.
    """

    def __init__(self) -> None:
        self.done: list[str] = []
        self.open: list[str] = []
        self.due = self.base = 0
        self.prefix, self.mark = "", None

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if not self.open or self.open[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.open.append(s)

    def as_it_is(self, s: str) -> None:
        first, *rest = s.split("\n")
        if first:
            self.open.append(first)
        for part in rest:
            self.line("".join(self.open).rstrip("\r"))
            self.open = [part] if part else []

    def line(self, s: str) -> None:
        if self.due and self.done:
            self.done += [""] * self.due
        self.due = 0
        self.done.append((self.prefix if self.mark is None else self.mark) + s if s else s)
        if s:
            self.mark = None

    def end(self, blank: int = 0, forced: bool = False) -> None:
        s = "".join(self.open).strip(" ")
        if s.strip() or forced:
            self.line(s)
        self.open = []
        if len(self.done) > self.base or not self.base:
            self.due = max(self.due, blank)

    def take(self, lines: list[str]) -> None:
        for s in lines:
            self.line(s)


def laid_out(node: Element, shown: bool = True) -> list[str]:
    out = Lines()
    render(node, out, shown=shown)
    out.end()
    return out.done


def render(node: Element, out: Lines, pre: bool = False, depth: int = 0, shown: bool = True) -> None:
    for child in node.children:
        if isinstance(child, str):
            if not shown:
                continue
            if pre:
                out.as_it_is(child)
            else:
                out.text(child)
            continue
        tag = child.tag
        if child.unseen():
            continue
        seen = child.shown(shown)
        if tag == "br":
            if seen:
                out.end(forced=True)
        elif tag in KEPT_AS_IT_IS:
            out.end(1)
            render(child, out, True, 0, seen)
            if out.open:
                out.line("".join(out.open))
            out.open, out.due = [], 1
        elif tag in ("ul", "ol", "menu"):
            out.end(0 if depth else 1)
            listed(child, out, depth, seen)
            out.end(0 if depth else 1)
        elif tag == "table":
            out.end(1)
            out.take(tabled(child, seen))
            out.end(1)
        elif tag in BLOCKS:
            blank = int(tag in SPACED)
            out.end(blank)
            render(child, out, pre, depth, seen)
            out.end(blank)
        else:
            render(child, out, pre, depth, seen)


def listed(node: Element, out: Lines, depth: int, shown: bool) -> None:
    start = node.get("start") if node.tag == "ol" else None
    number = int(start) if start and re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            rest = Element("div")
            rest.children = [child]
            render(rest, out, False, depth, shown)
            out.end()
        elif not child.unseen():
            out.end()
            seen, was = child.shown(shown), (out.prefix, out.mark, out.base, out.due)
            mark = (f"{number}. " if node.tag == "ol" else "- ") if seen else ""
            number += 1
            out.mark, out.base = (out.prefix if out.mark is None else out.mark) + mark, len(out.done)
            out.prefix += " " * len(mark) * (len(out.prefix) < INDENTED)
            render(child, out, False, depth + 1, seen)
            out.end()
            out.due = was[3] if len(out.done) == out.base else 0
            out.prefix, out.mark, out.base = was[0], was[1] if len(out.done) == out.base else None, was[2]


class Cell:
    """A cell's lines and the columns from ``at`` to before ``end`` that it takes."""

    __slots__ = ("at", "end", "lines")

    def __init__(self, lines: list[str], at: int, end: int):
        self.lines, self.at, self.end = lines, at, end


def tabled(node: Element, shown: bool) -> list[str]:
    """The rows of a table, cells padded to their column's width; captions and what is in no cell stand alone above."""
    rows: list[list[Cell]] = []
    above: list[str] = []
    taken: list[list[int]] = []  # columns that cells of earlier rows still take: begin, end, rows left

    def walk(part: Element, seen: bool) -> None:
        for child in part.children:
            if isinstance(child, str):
                if child.strip() and seen:
                    above.append(SPACES.sub(" ", child).strip())
            elif not child.unseen():
                if child.tag == "tr":
                    rows.append(row(child, child.shown(seen)))
                elif child.tag in GROUPS:
                    walk(child, child.shown(seen))
                    taken.clear()  # no cell spans beyond its group
                else:
                    loose = Element("div")
                    loose.children = [child]
                    above.extend(laid_out(loose, seen))

    def gather(part: Element, seen: bool, cells: list[tuple[Element, bool]]) -> None:
        """The cells of a row, also those in wrappers; what else it holds stands above the table."""
        loose = Element("div")
        for child in part.children:
            if isinstance(child, str):
                loose.children.append(child)
            elif not child.unseen():
                if child.tag in ("td", "th"):
                    cells.append((child, child.shown(seen)))
                elif child.holds_cells:
                    above.extend(laid_out(loose, seen))
                    loose = Element("div")
                    gather(child, child.shown(seen), cells)
                else:
                    loose.children.append(child)
        above.extend(laid_out(loose, seen))

    def row(part: Element, seen: bool) -> list[Cell]:
        found: list[tuple[Element, bool]] = []
        gather(part, seen, found)
        out, new, at, k = [], [], 0, 0
        for cell, cell_seen in found:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            end = at + span(cell, "colspan", 1000)
            if (down := span(cell, "rowspan", 65534)) > 1:
                new.append([at, end, down])
            out.append(Cell(laid_out(cell, cell_seen), at, end))
            at = end
        taken[:] = sorted(t for t in ([b, e, n - 1] for b, e, n in [*taken, *new]) if t[2] > 0)
        return out

    walk(node, shown)
    places = sorted({c.at for r in rows for c in r})  # columns in which no cell begins have no width of their own
    column = {at: k for k, at in enumerate(places)}
    widths, wide = [0] * len(places), []
    for r in rows:
        for c in r:
            c.at, last = column[c.at], c.end
            c.end = c.at + 1
            while c.end < len(places) and places[c.end] < last:
                c.end += 1
            width = max(map(len, c.lines), default=0)
            if width <= ALIGNED and c.end == c.at + 1:
                widths[c.at] = max(widths[c.at], width)
            elif width <= ALIGNED:
                wide.append((c.end - c.at, c.at, width))
    for columns, at, width in sorted(wide):
        widths[at + columns - 1] += max(0, width - sum(widths[at : at + columns]) - 2 * (columns - 1))
    begins = [0]
    for w in widths:
        begins.append(begins[-1] + w + 2)
    out = above
    for r in rows:
        for k in range(max((len(c.lines) for c in r), default=0)):
            parts, at = [], 0
            for c in r:
                if k >= len(c.lines) or not c.lines[k]:
                    continue
                gap = max(begins[c.at] - at, 2 if parts else 0)
                parts += [" " * gap, c.lines[k]]
                at += gap + len(c.lines[k])
            out.append("".join(parts).rstrip())
    return out


def span(cell: Element, name: str, most: int) -> int:
    value = (cell.get(name) or "") if name in cell.attributes.lower() else ""
    n = int(value) if re.fullmatch(r"[0-9]{1,6}", value) else 1
    return most if n == 0 and name == "rowspan" else min(most, max(1, n))


def page_text(page: str | None) -> str | None:
    if page is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
    return "\n".join(laid_out(tree(page))).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key`` and the visible text of each row of ``pages``: a narrow map, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([page_text(s) for s in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    named = pages.select(F.col(key), F.col(page).alias("_page"))
    return named.mapInArrow(run, f"`{key}` {dict(named.dtypes)[key]}, text string")
