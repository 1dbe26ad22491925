"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and
a renderer that keeps block spacing, lists and aligned table cells.

Rules
- Tree: unclosed paragraphs, list items, definitions, options, rows, cells and table
  sections end where the next of their kind, an enclosing end tag or a block that can't
  stand in them begins; stray end tags are ignored (a stray </p> is an empty paragraph,
  </br> a line break). html, head and body tags are never required. Script, style and
  the like are raw text up to their own end tag, textarea and title text with
  references. A plain "<" that begins no tag is text.
- Hidden: the head and its elements, script, style, template, noscript, comments, media,
  input of any type, rp, datalist, annotations of formulas, anything with a hidden
  attribute that its style doesn't overrule, display:none, closed dialogs, and closed
  details but for their summary; on html and body too. Text under visibility:hidden (or
  collapse) is hidden until an element within says visible. In drawings only text elements
  and foreign objects show. A drop-down shows its chosen option, a list box all of them.
  Everything else is visible, formulas, aria-hidden text, navigation and footers too.
- For reading (everything=False) the choices of drop-downs and what is marked aria-hidden
  are left out as well; pages are extracted with everything that can be seen.
- A tag that the end of the page cuts off is no text, nor is what follows an open quote
  in it.
- Text: white space (not the no-break space, which becomes a blank at the end) collapses
  to one blank, also across inline tags, and goes at the edges of lines; pre and textarea
  keep theirs. br breaks the line, hr is a line of dashes. Blocks stand on lines of their
  own, paragraphs, headings, lists, tables, pre, blockquote, figure and the like between
  blank lines; at most one blank line in a row.
- Lists: "- " or the number (start, value, reversed), nested lists two columns further
  in. dd and quotes are two columns further in; from INDENT columns on deeper levels stand
  where theirs does. An image shows its alt text.
- Tables: a line per line of cells, columns padded to the widest cell and set apart by
  " | "; colspan and rowspan hold their places (up to 1,000 columns and 65,534 rows, as
  the standard has it); captions come first. A line wider than WIDE doesn't widen its
  column, but pushes what follows it. Past ALIGNED columns with content cells aren't
  padded, and those without content leave no gap. A table within a cell is rendered within it; one
  within NESTED tables puts its cells below each other.

Null and empty pages give an empty text; other columns are ignored, repeated rows give
equal results, and an empty table gives an empty result. Open elements have no bound, and
all rules hold at any depth; the scan goes forward once, and elements are found by name,
so that the time a page takes grows with its length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

NESTED = 32
WIDE = 400
#: Columns that lists and quotes are set in at most, and columns of a table that are aligned.
INDENT = 80
ALIGNED = 1000
GAP = " | "
# What the HTML standard says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
TEXT_ONLY = frozenset("title textarea".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe object audio video canvas datalist input base link meta param source track area annotation annotation-xml rp".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul".split())
BLOCKS = PARAGRAPH_ENDS | frozenset("html body li dd dt caption tr td th thead tbody tfoot legend optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure hr address fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: A start tag ends open elements of these names, up to an element of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "caption": (frozenset(["caption", "colgroup"]), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
#: Elements that an end tag within a cell or a table's part doesn't reach beyond.
FENCES = frozenset("table td th caption html body object template".split())

#: Elements of which only the table's own end tags get out.
WITHIN = frozenset(["table", "tr", "td", "th", "caption"]) | SECTIONS
NONE: frozenset[str] = frozenset()
P, A = frozenset(["p"]), frozenset(["a"])
#: Inline boxes that stand apart from the text around them.
BOXES = frozenset("button select textarea".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?)")
COMMENT_END = re.compile(r"--!?>")
ZEROS = re.compile(r"&#([xX]?)0{3,}")
TOO_LARGE = re.compile(r"&#(?:[1-9]\d{7,}|0[1-9]\d{7,}|[xX]0?[1-9a-fA-F][0-9a-fA-F]{6,});?")
SPACES = re.compile(r"[ \t\n\r\f]+")
DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.IGNORECASE)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z]+)", re.IGNORECASE)
NUMBER = re.compile(r"\s*([+-]?)0*(\d+)")


class Element:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []

    def number(self, key: str, default: int, least: int = 1, most: int = 1000) -> int:
        found = NUMBER.match(self.attributes.get(key, ""))
        if not found:
            return default
        n = int(found[2]) if len(found[2]) < 19 else 10**18
        return min(most, max(least, -n if found[1] == "-" else n))


def plain(piece: str) -> str:
    """Text with its references resolved; numbers beyond the last character are unknown."""
    if "&" in piece:
        piece = entities.unescape(TOO_LARGE.sub("\ufffd", ZEROS.sub(r"&#\g<1>0", piece)))
    return piece.replace("\0", "")


@lru_cache(maxsize=64)
def end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE)


def attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes from there on, where the tag ends (-1: it doesn't) and whether it
    closes itself."""
    out: dict[str, str] = {}
    while found := ATTRIBUTE.match(page, at):
        at = found.end()
        if found[1]:
            return out, at, page[at - 2] == "/"
        value = found[3] if found[3] is not None else found[4] if found[4] is not None else found[5] or ""
        out.setdefault(found[2].lower(), plain(value))
    return out, -1, False


class Open:
    """The open elements, and where those of each name are."""

    def __init__(self, root: Element):
        self.elements = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, new: Element) -> None:
        self.places.setdefault(new.name, []).append(len(self.elements))
        self.elements.append(new)

    def cut(self, at: int) -> None:
        """Closes the element at that place and all within it."""
        while len(self.elements) > at:
            self.places[self.elements.pop().name].pop()

    def last(self, names: frozenset[str]) -> int:
        """The place of the innermost element of these names; 0: there is none."""
        places = self.places
        return max([found[-1] for n in names if (found := places.get(n))], default=0)


def build(page: str, everything: bool = False) -> tuple[Element, list[dict[str, str]]]:
    """The tree of a page, and the attributes of its html and body."""
    root = Element("html", {})
    outer: list[dict[str, str]] = [{}, {}]
    open_ = Open(root)
    elements = open_.elements

    def text(piece: str) -> None:
        if piece:
            elements[-1].children.append(plain(piece))

    def close_to(names: frozenset[str], fence: frozenset[str]) -> None:
        at = open_.last(names)
        if at and at > open_.last(fence - names):
            while at > 1 and elements[at - 1].name in names:
                at -= 1
            open_.cut(at)

    def start(name: str, own: dict[str, str], shut: bool) -> None:
        if name in ("html", "body"):
            if name == "body" and len(elements) > 1 and elements[1].name == "head":
                open_.cut(1)
            for key, value in own.items():
                outer[name == "body"].setdefault(key, value)
            return
        if len(elements) > 1 and elements[-1].name == "head" and name not in HIDDEN:
            open_.cut(len(elements) - 1)
        if name in PARAGRAPH_ENDS:
            close_to(P, FENCES)
        if name in HEADINGS and elements[-1].name in HEADINGS:
            open_.cut(len(elements) - 1)
        if name in IMPLIED:
            close_to(*IMPLIED[name])
        if name == "a":
            close_to(A, FENCES)
        if not everything and (name == "select" or own.get("aria-hidden", "").lower() == "true"):
            own = {"hidden": ""}
        new = Element(name, own)
        elements[-1].children.append(new)
        if name not in VOID and not shut:
            open_.push(new)

    def end(name: str) -> None:
        if name == "br":
            start("br", {}, True)
            return
        at = open_.last(HEADINGS if name in HEADINGS else frozenset([name]))
        if at and at >= open_.last(NONE if name in WITHIN else FENCES):
            open_.cut(at)
        elif name == "p":
            elements[-1].children.append(Element("p", {}))

    at = 0
    while (tag := page.find("<", at)) >= 0:
        second = page[tag + 1 : tag + 2]
        closing = second == "/"
        named = NAME.match(page, tag + 1 + closing)
        if named is None:
            if second not in ("!", "?") and not (closing and tag + 2 < len(page)):
                text(page[at : tag + 1])
                at = tag + 1
                continue
            text(page[at:tag])
            if page.startswith("<!--", tag):
                quick = next((n for n in (">", "->") if page.startswith(n, tag + 4)), None)
                found = None if quick else COMMENT_END.search(page, tag + 4)
                at = tag + 4 + len(quick) if quick else found.end() if found else len(page)
            else:
                at = page.find(">", tag) + 1 or len(page)
            continue
        text(page[at:tag])
        name = named[0].lower()
        own, at, shut = attributes(page, named.end())
        if at < 0:
            at = len(page)
            break
        if closing:
            end(name)
            continue
        foreign = name in ("svg", "math") or open_.last(frozenset(["svg", "math"])) > open_.last(frozenset(["foreignobject"]))
        start(name, own, shut and foreign)
        if name in RAW or name in TEXT_ONLY:
            stop = end_of(name).search(page, at)
            inside = page[at : stop.start()] if stop else page[at:]
            at = stop.start() if stop else len(page)
            if name in TEXT_ONLY:
                text(inside)
            if not stop and elements[-1].name == name:
                open_.cut(len(elements) - 1)
        elif name == "plaintext":
            elements[-1].children.append(page[at:])
            at = len(page)
    text(page[at:])
    return root, outer


def displayed(name: str, own: dict[str, str]) -> bool:
    """Whether an element has a box at all."""
    if name in HIDDEN or (name == "dialog" and "open" not in own):
        return False
    said = DISPLAY.search(own["style"]) if "style" in own else None
    return said[1].lower() != "none" if said else "hidden" not in own


def shown(element: Element) -> bool:
    return displayed(element.name, element.attributes)


def seen_in(name: str, own: dict[str, str], before: bool) -> bool:
    """Whether text of an element is seen, given that of its parent is or not."""
    if name == "svg":
        return False
    if name in ("text", "foreignobject"):
        return True
    said = VISIBILITY.search(own["style"]) if "style" in own else None
    return {"visible": True, "hidden": False, "collapse": False}.get(said[1].lower(), before) if said else before


def chosen(select: Element) -> list[Element]:
    """The options that a select shows."""
    options: list[Element] = []
    for child in select.children:
        if isinstance(child, Element):
            inside = child.children if child.name == "optgroup" else [child]
            options += [o for o in inside if isinstance(o, Element) and o.name == "option" and shown(o)]
    if "multiple" in select.attributes or select.number("size", 1) > 1:
        return options
    marked = [o for o in options if "selected" in o.attributes][-1:]
    return marked or [o for o in options if "disabled" not in o.attributes][:1] or options[:1]


def width(line: str) -> int:
    """Columns of a line: wide characters take two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Page:
    """Lines with collapsing white space and blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank waits for the next word
        self.gap = False  # a blank line waits for the next line
        self.marker = ""
        self.indent = 0

    def word(self, piece: str) -> None:
        if not piece:
            return
        inner = SPACES.sub(" ", piece)
        if inner[0] == " ":
            self.blank = True
            inner = inner[1:]
            if not inner:
                return
        if self.blank and self.line:
            self.line.append(" ")
        self.blank = inner[-1] == " "
        self.line.append(inner[:-1] if self.blank else inner)

    def kept(self, piece: str) -> None:
        first, *rest = piece.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if self.blank and self.line:
            self.line.append(" ")
        self.blank = False
        if first:
            self.line.append(first)
        for more in rest:
            self.flush(True)
            if more:
                self.line.append(more)

    def flush(self, even_empty: bool = False) -> None:
        if self.line or even_empty or self.marker:
            self.raw("".join(self.line).rstrip(" "))
        self.line, self.blank = [], False

    def raw(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marker:
            line = " " * max(0, self.indent - len(self.marker)) + self.marker + line
            self.marker = ""
        elif line:
            line = " " * self.indent + line
        self.lines.append(line)

    def text(self) -> list[str]:
        out: list[str] = []
        for line in self.lines:
            line = line.replace("\xa0", " ").rstrip()
            if line or (out and out[-1]):
                out.append(line)
        while out and not out[-1]:
            out.pop()
        return out


def counters(element: Element) -> dict[int, str]:
    """The marker of each item of a list, by its place among the children."""
    items = [(i, c) for i, c in enumerate(element.children) if isinstance(c, Element) and c.name == "li" and shown(c)]
    if element.name != "ol":
        return dict.fromkeys((i for i, _ in items), "- ")
    back = "reversed" in element.attributes
    n = element.number("start", len(items) if back else 1, -(10**9), 10**9)
    out = {}
    for i, item in items:
        n = item.number("value", n, -(10**9), 10**9)
        out[i] = f"{n}. "
        n += -1 if back else 1
    return out


def render(element: Element, seen: bool = True, level: int = 0) -> list[str]:
    """Lines of an element's inside. The walk keeps a stack; only tables recur, NESTED
    deep at most."""
    page = Page()
    todo: list[tuple] = [("in", element, False, seen)]
    while todo:
        what, node, pre, seen = todo.pop()
        if what == "in":
            marks = counters(node) if node.name in LISTS else {}
            inside = list(enumerate(node.children))
            if node.name == "details" and "open" not in node.attributes:
                inside = [(i, c) for i, c in inside if isinstance(c, Element) and c.name == "summary"][:1]
            elif node.name == "select":
                inside = [(-1, o) for o in chosen(node)]
            for i, child in reversed(inside):
                todo.append(("see", (child, marks.get(i, "- ")), pre, seen))
        elif what == "out":
            name, indent = node
            page.flush()
            page.indent = indent
            page.gap |= name in SPACED
        elif what == "apart":
            page.blank = True
        else:
            child, mark = node
            if isinstance(child, str):
                if seen:
                    page.kept(child) if pre else page.word(child)
                continue
            if not shown(child):
                continue
            name = child.name
            seen = seen_in(name, child.attributes, seen)
            if name == "br":
                page.flush(True)
            elif name == "wbr":
                pass
            elif name == "img":
                page.word(child.attributes.get("alt", "") if seen else "")
            elif name == "hr" or (name == "table" and level < NESTED):
                page.flush()
                page.gap = True
                for line in table_lines(child, seen, level + 1) if name == "table" else ["---"]:
                    page.raw(line)
                page.gap = True
            elif name in BLOCKS:
                page.flush()
                page.gap |= name in SPACED and not (name in LISTS and page.indent)
                todo.append(("out", (name if not (name in LISTS and page.indent) else "", page.indent), pre, seen))
                if name == "li":
                    page.marker = mark if seen else ""
                    page.indent = min(page.indent + len(mark), max(page.indent, INDENT))
                elif name in ("dd", "blockquote"):
                    page.indent = min(page.indent + 2, max(page.indent, INDENT))
                todo.append(("in", child, pre or name == "pre", seen))
                if name == "pre" and child.children and isinstance(child.children[0], str):
                    child.children[0] = child.children[0].removeprefix("\r").removeprefix("\n")
            else:
                if name == "q":
                    child.children = ['"', *child.children, '"']
                if name in BOXES:
                    page.blank = True
                    todo.append(("apart", None, pre, seen))
                todo.append(("in", child, pre or name == "textarea", seen))
    page.flush()
    return page.text()


def widest(lines: list[str]) -> int:
    """Columns of the widest line that isn't over WIDE."""
    return max((w for w in map(width, lines) if w <= WIDE), default=0)


Held = tuple[int, int, int]  # from a column to a column, until a row


def covered(held: list[Held], new: list[Held]) -> list[Held]:
    """held where the new intervals don't cover it, and these: both in order and apart, as is
    the result, in which neighbours that end in the same row are one."""
    out: list[Held] = []

    def put(a: int, b: int, until: int) -> None:
        if out and out[-1][1] == a and out[-1][2] == until:
            out[-1] = (out[-1][0], b, until)
        elif a < b:
            out.append((a, b, until))

    k = 0
    for a, b, until in held:
        while k < len(new) and new[k][1] <= a:
            put(*new[k])
            k += 1
        while k < len(new) and new[k][0] < b:
            put(a, min(new[k][0], b), until)
            a = max(a, new[k][1])
            if new[k][1] > b:
                break
            put(*new[k])
            k += 1
        put(a, b, until)
    for one in new[k:]:
        put(*one)
    return out


def table_lines(table: Element, seen: bool, level: int) -> list[str]:
    """A table as lines: cells aligned by column."""
    out: list[str] = []
    rows: list[tuple[Element, bool]] = []
    head: list[tuple[Element, bool]] = []
    foot: list[tuple[Element, bool]] = []
    loose = Element("div", {})
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                loose.children.append(child)
        elif child.name == "caption":
            out += render(child, seen_in("caption", child.attributes, seen), level) if shown(child) else []
        elif child.name == "tr":
            rows.append((child, seen))
        elif child.name in SECTIONS:
            if not shown(child):
                continue
            inner = seen_in(child.name, child.attributes, seen)
            part = {"thead": head, "tfoot": foot}.get(child.name, rows)
            for c in child.children:
                if isinstance(c, Element) and c.name == "tr":
                    part.append((c, inner))
                elif isinstance(c, Element) or c.strip():
                    loose.children.append(c)
        elif child.name != "colgroup":
            loose.children.append(child)
    if loose.children:
        out += render(loose, seen, level)
    grid: list[dict[int, list[str]]] = []
    spans: list[tuple[int, int, int, list[str]]] = []  # row, column, columns, lines
    shown_rows = [(tr, above) for tr, above in [*head, *rows, *foot] if shown(tr)]
    held: list[Held] = []  # what cells of the rows above still hold, in order
    for tr, above in shown_rows:
        across = seen_in("tr", tr.attributes, above)
        row: dict[int, list[str]] = {}
        here = len(grid)
        if any(until <= here for _, _, until in held):
            held = [h for h in held if h[2] > here]
        column = at = 0
        tall_ones: list[Held] = []
        stray = Element("div", {})
        for cell in tr.children:
            if isinstance(cell, str) or cell.name not in ("td", "th"):
                if not isinstance(cell, str) or cell.strip():
                    stray.children.append(cell)
                continue
            while at < len(held) and held[at][0] <= column:
                column = max(column, held[at][1])
                at += 1
            wide, tall = cell.number("colspan", 1), cell.number("rowspan", 1, 0, 65534) or 65534
            lines = render(cell, seen_in(cell.name, cell.attributes, across), level) if shown(cell) else []
            if wide == 1:
                row[column] = lines
            else:
                spans.append((here, column, wide, lines))
            if tall > 1:
                tall_ones.append((column, column + wide, min(here + tall, len(shown_rows))))
            column += wide
        if tall_ones:
            held = covered(held, tall_ones)
        if stray.children:
            out += render(stray, across, level)
        grid.append(row)
    size: dict[int, int] = {}
    for row in grid:
        for c, lines in row.items():
            size[c] = max(size.get(c, 0), widest(lines))
    used = sorted({c for row in grid for c, lines in row.items() if lines} | {c for _, c, _, lines in spans if lines})
    for _, c, w, lines in spans:
        inside = used[bisect_left(used, c) : bisect_left(used, c + w)]
        room = sum(size.get(k, 0) for k in inside) + len(GAP) * (len(inside) - 1)
        if inside and (need := widest(lines)) > room:
            size[inside[-1]] = size.get(inside[-1], 0) + need - room
    by_row: dict[int, dict[int, tuple[int, list[str]]]] = {}
    for r, c, w, lines in spans:
        by_row.setdefault(r, {})[c] = (w, lines)
    for r, row in enumerate(grid):
        cells = {c: (1, lines) for c, lines in row.items()} | by_row.get(r, {})
        for k in range(max((len(lines) for _, lines in cells.values()), default=0)):
            parts: list[str] = []
            c = 0
            while c < min(len(used), ALIGNED):
                w, lines = cells.get(used[c], (1, []))
                inside = used[c : bisect_left(used, used[c] + w)]
                room = sum(size.get(x, 0) for x in inside) + len(GAP) * (len(inside) - 1)
                piece = lines[k] if k < len(lines) else ""
                parts.append(piece + " " * (room - width(piece)))
                c += len(inside)
            if len(used) > c:
                parts += [lines[k] for column, (_, lines) in sorted(cells.items()) if column >= used[c] and k < len(lines)]
            while parts and not parts[-1].strip():
                parts.pop()
            out.append(GAP.join(parts).rstrip())
    return out


def extract(page: str | None, everything: bool = False) -> str:
    if not page:
        return ""
    root, outer = build(page, everything)
    seen = True
    for name, own in zip(("html", "body"), outer, strict=True):
        if not displayed(name, own):
            return ""
        seen = seen_in(name, own, seen)
    return "\n".join(render(root, seen))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", full: bool = True, everything: bool = True) -> DataFrame:
    """Per page: id, text, n_chars, n_lines, text_sha256. Map-only: no shuffle."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, everything) for h in batch.column(1).to_pylist()]
            out = {id_col: batch.column(0)} | ({"text": pa.array(texts, pa.string())} if full else {})
            out |= {
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_lines": pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                "text_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(out)

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}" + ", text string" * full + ", n_chars long, n_lines long, text_sha256 string")
