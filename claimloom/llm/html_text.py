"""Visible text of HTML pages, laid out as lines.

A tree builder reads tags in one pass: implied end tags (`p`, `li`, `dt`, `td`, `tr`, `option` ...),
void and raw-text elements, unmatched end tags dropped.  Visibility rules take out what a browser
doesn't show: head matter, scripts, templates, `hidden`, `display:none` and `visibility:hidden` in
style attributes or in simple rules of style elements (a tag, .class or #id); what is visible again
inside of `visibility:hidden` is shown, in tables too.  Formulas and drawings give their text inline,
without descriptions, definitions and annotations.  The rest is laid out:
blocks on lines of their own, a blank line around paragraphs, headings and the like, list items with
markers and indents, preformatted text as it is, and tables as columns padded to one width per column
(spans included).

Defined cases: a null or blank page has an empty text; text without tags is one block; broken markup is
read as far as it goes (an open comment or raw-text element runs to the end); elements may be nested to
any depth, as neither the tree builder nor the layout recurses (lists in lists are indented at each
level, so that lines grow with the depth); very long pages are laid out whole; rows are treated one by one, so ids may repeat or be null; an empty
table gives an empty result; other columns are kept by `extracted`, but for one of its result's name, which it replaces.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Not shown whatever the page says.
UNSEEN = frozenset("head script style template title noframes noembed iframe object audio video canvas datalist noscript".split())
#: Not shown inside of these.
_UNSEEN_IN = {
    "svg": frozenset("desc metadata defs symbol clippath mask marker pattern filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address form fieldset legend li dt dd tr td th thead tbody tfoot "
    "caption figcaption center details summary dialog option optgroup hgroup search".split()
)
#: A start tag closes these open elements, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
    "body": ({"head"}, {"html"}),
}
_IN_HEAD = frozenset("title meta link style script base basefont bgsound noscript template noframes".split())
_ENDS_P = (SPACED | BLOCK) - {"option", "optgroup", "td", "th", "tr", "html", "body", "thead", "tbody", "tfoot", "caption", "legend"}
#: End tags don't reach past these.
_WALLS = frozenset("table td th caption html template".split())

_TAG = re.compile(
    r"<!--(?:>|->|(?s:.*?)(?:-->|--!>|\Z))|<!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_NONE = re.compile(r"(?:^|[;\s])display\s*:\s*none\b", re.I)
_HIDDEN = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)\b", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(page: str) -> tuple[Node, list[str]]:
    """(root, contents of style elements)."""
    root = Node("html")
    stack, styles, at, size = [root], [], 0, len(page)
    places: dict[str, list[int]] = {}  # of the open elements but the root, by tag

    def last(tags) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max([places[t][-1] for t in tags if places.get(t)], default=0)

    def cut(start: int) -> None:
        for node in stack[start:]:
            places[node.tag].pop()
        del stack[start:]

    def close(tags: set, walls: set) -> None:
        while (i := last(tags)) and i > last(walls):
            cut(i)

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                i = last((tag,))
                if i and (tag in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") or i >= last(_WALLS)):
                    cut(i)
            continue
        tag, attrs = (m[2], m[3]) if m[2] else (m[4], m[5])
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if tag in ("html", "body") and len(stack) > 1 and tag == "html":
            continue
        if tag in _ENDS_P:
            close({"p"}, _WALLS | {"li", "dd", "dt", "div", "section", "article", "button", "object"})
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if len(stack) > 1 and stack[1].tag == "head" and tag not in _IN_HEAD:
            cut(1)
        if tag == "body" and len(stack) > 1:
            cut(1)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            inside = page[at : end.start() if end else size]
            at = end.end() if end else size
            if tag == "style":
                styles.append(inside)
            else:
                node.children.append(inside if tag != "xmp" else html.escape(inside, quote=False))
        elif tag not in VOID and not attrs.endswith("/") or tag in ("p", "div", "span", "a", "td", "li"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root, styles


def _visibility(declared: str) -> bool | None:
    """Whether declarations show or hide; None if they say neither."""
    found = _HIDDEN.findall(declared)
    return found[-1].lower() == "visible" if found else None


def hidden_by(styles: list[str]) -> tuple[frozenset[str], dict[str, tuple[int, bool]]]:
    """Simple selectors (tag, .class, #id) whose rules take out what they match, and those whose rules
    set its visibility: (place of the rule, whether it shows)."""
    found, seen, place = set(), {}, 0
    for style in styles:
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S)):
            place += 1
            simple = [s.strip() for s in selectors.split(",") if re.fullmatch(r"[.#]?[\w-]+", s.strip())]
            if _NONE.search(body):
                found.update(simple)
            shows = _visibility(body)
            if shows is not None:
                seen.update(dict.fromkeys(simple, (place, shows)))
    return frozenset(found), seen


class Flow:
    """Lines of laid-out text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.need, self.space, self.indent, self.marker = 0, False, 0, ""

    def brk(self, lines: int) -> None:
        self.need, self.space = max(self.need, lines), False

    def _open(self) -> None:
        if self.need or not self.out:
            if self.out:
                self.out.append("\n" * self.need)
            self.out.append(" " * (self.indent - len(self.marker)) + self.marker)
            self.need, self.marker, self.space = 0, "", False

    def text(self, s: str) -> None:
        if "&" in s:
            s = html.unescape(s)
        s = _SPACES.sub(" ", s)
        if s == " " or not s:
            self.space |= bool(s) and not self.need and bool(self.out)
            return
        fresh = self.need or not self.out
        self._open()
        if (self.space or s[0] == " ") and not fresh:
            self.out.append(" ")
        self.out.append(s.strip(" "))
        self.space = s[-1] == " "

    def lines(self, lines: list[str]) -> None:
        """Lines as they are."""
        for line in lines:
            if line:
                self._open()
                self.out.append(line)
                self.need = 1
            elif self.out:
                self.need += 1

    def done(self) -> str:
        return "".join(self.out)


def _number(value: str | None, default: int, most: int) -> int:
    found = re.match(r"\s*(\d+)", value or "")
    return min(int(found[1]), most) if found else default


class Layout:
    """What lays out nodes.  `run`, `item` and `table` yield the layouts inside theirs, and `whole` takes
    them one after another from a list, so that depth costs no recursion."""

    def __init__(self, hidden: frozenset[str], seen: dict[str, tuple[int, bool]]):
        self.hidden, self.seen = hidden, seen

    def whole(self, node: Node, flow: Flow) -> None:
        todo = [self.run(node, flow)]
        while todo:
            inner = next(todo[-1], None)
            if inner is None:
                todo.pop()
            else:
                todo.append(inner)

    def shows(self, node: Node, shown: bool, inside: str = "") -> bool:
        """Whether text right in a node is visible, if that around it is shown or not."""
        if node.attrs and "visibility" in node.attrs.lower():
            own = _visibility(node.get("style") or "")
            if own is not None:
                return own
        if self.seen:
            names = ["#" + (node.get("id") or "")], ["." + c for c in (node.get("class") or "").split()], [node.tag]
            for same in names:
                if held := [self.seen[s] for s in same if s in self.seen]:
                    return max(held)[1]
        if inside == "svg" and (own := node.get("visibility")):
            return own.strip().lower() not in ("hidden", "collapse")
        return shown

    def gone(self, node: Node, inside: str = "") -> bool:
        if node.tag in UNSEEN or node.tag in self.hidden:
            return True
        if inside and (node.tag in _UNSEEN_IN[inside] or inside == "svg" and (node.get("display") or "").strip().lower() == "none"):
            return True
        if not node.attrs:
            return False
        if node.get("hidden") is not None or (style := node.get("style")) and _NONE.search(style):
            return True
        if node.tag == "input" or node.tag == "dialog" and node.get("open") is None:
            return True
        if self.hidden:
            own = node.get("id")
            return own and "#" + own in self.hidden or any("." + c in self.hidden for c in (node.get("class") or "").split())
        return False

    def run(self, node: Node, flow: Flow, pre: bool = False, shown: bool = True, level: int = 0, inside: str = "") -> Iterator[Iterator]:
        """Lay out what is in a node."""
        number = _number(node.get("start"), 1, 10**9) if node.tag == "ol" else 0
        for child in node.children:
            if isinstance(child, str):
                if shown and pre:
                    parts = html.unescape(child).replace("\r\n", "\n").split("\n")
                    for i, part in enumerate(parts):
                        if i:
                            flow.lines([""]) if flow.need else flow.brk(1)
                        if part:
                            flow._open()
                            flow.out.append(part)
                elif shown:
                    flow.text(child)
                continue
            tag = child.tag
            if self.gone(child, inside):
                continue
            seen = self.shows(child, shown, inside)
            if tag == "br":
                flow.need += 1
                flow.space = False
            elif tag in BLOCK:
                # lists inside lists stand close
                gap = 1 if tag not in SPACED or tag in ("ul", "ol", "menu") and level else 2
                flow.brk(gap)
                if tag == "li":
                    number = _number(child.get("value"), number, 10**9)
                    yield self.item(child, flow, f"{number}. " if node.tag == "ol" else "- ", pre, seen, level)
                    number += 1
                elif tag == "table":
                    yield self.table(child, flow, pre, seen)
                elif tag in ("dd", "blockquote"):
                    held, flow.indent = flow.indent, flow.indent + 2
                    yield self.run(child, flow, pre, seen, level)
                    flow.indent = held
                else:
                    yield self.run(child, flow, pre or tag == "pre", seen, level + (tag in ("ul", "ol", "menu")))
                flow.brk(gap)
            else:
                apart = tag == "text" and inside == "svg"  # labels of a drawing are words apart
                flow.space |= apart and not flow.need and bool(flow.out)
                within = tag if tag in _UNSEEN_IN else "" if tag == "foreignobject" else inside
                yield self.run(child, flow, pre or tag in ("textarea", "xmp"), seen, level, within)
                flow.space |= apart and not flow.need and bool(flow.out)

    def item(self, node: Node, flow: Flow, marker: str, pre: bool, shown: bool, level: int) -> Iterator[Iterator]:
        held = flow.indent
        flow.indent, flow.marker = held + len(marker), marker
        yield self.run(node, flow, pre, shown, level)
        flow.indent, flow.marker = held, ""

    def table(self, node: Node, flow: Flow, pre: bool, shown: bool) -> Iterator[Iterator]:
        rows, last, todo = [], [], [(child, False, shown) for child in reversed(node.children)]
        while todo:
            child, foot, seen = todo.pop()
            found = last if foot else rows
            if isinstance(child, str):
                if seen and child.strip():
                    flow.text(child)  # text astray in a table stands before it
            elif self.gone(child):
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                seen = self.shows(child, seen)
                todo += [(c, foot or child.tag == "tfoot", seen) for c in reversed(child.children)]
            elif child.tag == "tr":
                found.append((child, self.shows(child, seen)))
            elif child.tag in ("td", "th"):
                found.append((Node("tr"), seen))
                found[-1][0].children.append(child)
            else:
                outer = Node("div")
                outer.children.append(child)
                yield self.run(outer, flow, pre, seen)
                flow.brk(1)
        flow.brk(1)
        grid: list[list[tuple[int, int, list[str]]]] = []  # per row: (column, columns, lines)
        taken: dict[int, int] = {}  # column: rows still covered by a cell above
        for row, seen in rows + last:
            column, cells, spans = 0, [], {}
            for cell in row.children:
                if isinstance(cell, str):
                    if seen and cell.strip():
                        flow.text(cell)
                    continue
                if self.gone(cell):
                    continue
                while taken.get(column, 0) > 0:
                    column += 1
                inner = Flow()
                holder = cell
                if cell.tag not in ("td", "th"):
                    holder = Node("td")
                    holder.children.append(cell)
                yield self.run(holder, inner, pre, self.shows(cell, seen) if holder is cell else seen)
                wide = max(1, _number(holder.get("colspan"), 1, 1000))
                tall = _number(holder.get("rowspan"), 1, 65534) or 65534
                cells.append((column, wide, inner.done().split("\n")))
                for c in range(column, column + wide):
                    spans[c] = tall
                column += wide
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n - 1 for c, n in spans.items() if n > 1}
            grid.append(cells)
        width: dict[int, int] = {}
        for wide_first in (False, True):
            for cells in grid:
                for column, wide, lines in cells:
                    longest = max(map(len, lines))
                    if wide == 1 and not wide_first:
                        width[column] = max(width.get(column, 0), longest)
                    elif wide > 1 and wide_first:
                        held = sum(width.get(c, 0) for c in range(column, column + wide)) + 2 * (wide - 1)
                        if longest > held:
                            width[column + wide - 1] = width.get(column + wide - 1, 0) + longest - held
        start, at = {}, 0
        for column in range(max([c + w for cells in grid for c, w, _ in cells], default=0)):
            start[column] = at
            at += width.get(column, 0) + 2 * (width.get(column, 0) > 0)
        for cells in grid:
            for i in range(max([len(lines) for _, _, lines in cells], default=0)):
                line = ""
                for column, _, lines in cells:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(start[column]) + lines[i]
                if line.strip():
                    flow.brk(1)
                    flow.lines([line.rstrip()])


def visible_text(page: str | None) -> str:
    """The text of one page."""
    if not page:
        return ""
    root, styles = parse(page)
    flow = Flow()
    Layout(*hidden_by(styles)).whole(root, flow)
    return "\n".join(line.rstrip() for line in flow.done().split("\n")).strip("\n")


def extracted(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep_html: bool = False) -> DataFrame:
    """pages with the visible text of html_col."""
    back = [c for c in pages.columns if c != out_col and (keep_html or c != html_col)]
    schema = T.StructType([f for f in pages.schema.fields if f.name in back]).add(out_col, "string")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(page.as_py()) for page in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in back], pa.array(texts, pa.string())], [*back, out_col])

    rows = pages.select(*dict.fromkeys([*back, html_col])).withColumn(html_col, F.col(html_col).cast("string"))
    return rows.mapInArrow(extract, schema)
