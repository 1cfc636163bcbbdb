"""Visible text of HTML pages: a tree builder with implied tags, then layout by blocks."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.columns import map_batches

# How HTML elements nest and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes object svg math audio video canvas "
    "datalist select textarea title".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table ul caption".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: A start tag on the left ends open elements on the right, up to the nearest of the boundaries.
_CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "legend", "caption", "summary"}
IMPLIED = (
    {name: ({"p"}, {"td", "th", "table", "button", "li", "body"}) for name in _CLOSES_P}
    | {
        "li": ({"li"}, {"ul", "ol", "menu", "table"}),
        "dt": ({"dt", "dd"}, {"dl", "table"}),
        "dd": ({"dt", "dd"}, {"dl", "table"}),
        "tr": ({"tr", "td", "th", "caption"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}),
        "optgroup": ({"option", "optgroup"}, {"select"}),
    }
    | {
        name: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"})
        for name in ("thead", "tbody", "tfoot")
    }
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
# The most columns and rows a cell of HTML may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def parse(page: str) -> Node:
    """The tree of a page. Missing end tags are implied, stray ones ignored, none fails."""
    root = Node("html", {})
    stack, open_names = [root], {"html": 1}

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_names[stack.pop().name] -= 1

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if open_names.get(name) and name != "html":
                barrier = {"table"} if name not in ("table", "body") else set()
                depth = len(stack) - 1
                while depth and stack[depth].name != name and stack[depth].name not in barrier:
                    depth -= 1
                if depth and stack[depth].name == name:
                    close(depth)
            continue
        ends, walls = IMPLIED.get(name, ((), ()))
        if any(open_names.get(e) for e in ends):
            lowest, depth = None, len(stack) - 1
            while depth and stack[depth].name not in walls:
                if stack[depth].name in ends:
                    lowest = depth
                depth -= 1
            if lowest:
                close(lowest)
        node = Node(name, _attributes(found[3]) if found[3] else {})
        if name == "html":
            continue
        stack[-1].children.append(node)
        if name in RAW:
            closing = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.IGNORECASE).search(page, at)
            node.children.append(page[at : closing.start()] if closing else page[at:])
            at = end if not closing else closing.start()
            if closing:
                after = page.find(">", at)
                at = end if after < 0 else after + 1
        elif name not in VOID and not found[3].endswith("/"):
            stack.append(node)
            open_names[name] = open_names.get(name, 0) + 1
    return root


def _shown(node: Node) -> bool:
    attributes = node.attributes
    return not (
        node.name in HIDDEN
        or "hidden" in attributes
        or _NOT_SHOWN.search(attributes.get("style", ""))
        or (node.name == "dialog" and "open" not in attributes)
    )


def prune(root: Node) -> list[Node]:
    """Take all that is not seen out of the tree; the tables left, those inside others after them.

    An element that is not shown goes with all it holds. Invisible ones only lose their own text: what
    is made visible inside them stays. A closed ``details`` keeps its summary.
    """
    order, work = [], [(root, True)]
    while work:
        node, seen = work.pop()
        if found := _VISIBILITY.findall(node.attributes.get("style", "")):
            seen = found[-1].lower() == "visible"
        order.append((node, seen))
        if node.name == "details" and "open" not in node.attributes:
            summaries = [c for c in node.children if isinstance(c, Node) and c.name == "summary"]
            node.children = summaries[:1]
        node.children = [c for c in node.children if isinstance(c, str) or _shown(c)]
        work += [(c, seen) for c in reversed(node.children) if isinstance(c, Node)]
    empty = set()
    for node, seen in reversed(order):
        if not seen:
            node.children = [c for c in node.children if isinstance(c, Node) and id(c) not in empty]
            if not node.children:
                empty.add(id(node))
        elif empty:
            node.children = [c for c in node.children if id(c) not in empty]
    return [node for node, _ in order if node.name == "table" and id(node) not in empty]


class Page:
    """Lines of text. Inline text is joined with single spaces; blocks ask for breaks before them."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.gap = 0  # breaks owed before the next text: 1 a new line, 2 an empty line
        self.space = False
        self.marker = ""

    def break_line(self, breaks: int) -> None:
        if self.current:
            self.lines.append("".join(self.current))
            self.current = []
        self.space = False
        self.gap = max(self.gap, breaks)

    def new_line(self) -> None:
        """A forced line break; two in a row leave an empty line."""
        if self.current:
            self.break_line(1)
        elif self.lines:
            self.gap = min(2, self.gap + 1)

    def write(self, text: str, indent: str) -> None:
        if not self.current:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.current.append(indent + self.marker)
            self.marker = ""
            self.space = False
        elif self.space:
            self.current.append(" ")
            self.space = False
        self.current.append(text)

    def inline(self, text: str, indent: str) -> None:
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space = self.space or bool(self.current)
        if body := words.strip(" "):
            self.write(body, indent)
            self.space = words.endswith(" ")

    def text(self) -> str:
        self.break_line(0)
        return "\n".join(line.rstrip() for line in self.lines).strip("\n")


def _width(text: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    wide = sum(unicodedata.east_asian_width(c) in "WF" for c in text)
    return len(text) + wide - sum(unicodedata.combining(c) > 0 for c in text)


def _span(cell: Node, name: str, most: int) -> int:
    found = cell.attributes.get(name, "1").strip()
    return max(1, min(most, int(found[: len(str(most)) + 1]))) if found.isdecimal() else 1


def _holding(child: Node | str, name: str) -> Node:
    """A new element around something that stands in a table without one."""
    holder = Node(name, {})
    holder.children.append(child)
    return holder


def _rows(node: Node) -> list[list[Node] | Node]:
    """Rows of cells of a table in reading order; what is no row stands between them as a block."""
    rows, work = [], [*reversed(node.children)]
    while work:
        child = work.pop()
        if isinstance(child, str):
            if child.strip():
                rows.append(_holding(child, "div"))
        elif child.name in ("td", "th"):
            rows.append([child])
        elif child.name == "tr":
            cells = []
            for cell in child.children:
                if isinstance(cell, Node) and cell.name in ("td", "th"):
                    cells.append(cell)
                elif isinstance(cell, Node) or cell.strip():
                    cells.append(_holding(cell, "td"))
            rows.append(cells)
        elif child.name in ("thead", "tbody", "tfoot", "colgroup", "form"):
            work += reversed(child.children)
        else:
            rows.append(_holding(child, "div"))
    return rows


def _table(node: Node, tables: dict[int, list[str]]) -> list[str]:
    """Lines of a table: its cells are blocks of lines, side by side in columns two spaces apart.

    A cell that spans columns or rows stands in the first of them and leaves the others empty. Columns
    without text take no room. A row of one cell in the first column does not widen it.
    """
    grid: list[list[tuple[int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows for which a cell above still covers it
    for row in _rows(node):
        if isinstance(row, Node):
            grid.append([(0, render(row, tables).split("\n"))])
            continue
        covered = set(taken)
        taken = {column: rows - 1 for column, rows in taken.items() if rows > 1}
        placed, column = [], 0
        for cell in row:
            while column in covered:
                column += 1
            placed.append((column, render(cell, tables).split("\n")))
            down = _span(cell, "rowspan", MOST_ROWS)
            for _ in range(_span(cell, "colspan", MOST_COLUMNS)):
                if down > 1:
                    taken[column] = down - 1
                column += 1
        grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        if len(placed) > 1 or (placed and placed[0][0]):
            for column, lines in placed:
                widths[column] = max(widths.get(column, 0), *map(_width, lines))
    columns = sorted(column for column, width in widths.items() if width)
    found = []
    for placed in grid:
        if not any(any(lines) for _, lines in placed):
            continue
        if len(placed) == 1 and not placed[0][0]:
            found += placed[0][1]
            continue
        cells = dict(placed)
        for k in range(max(len(lines) for lines in cells.values())):
            line = []
            for column in columns:
                text = cells[column][k] if column in cells and k < len(cells[column]) else ""
                line.append(text + " " * (widths[column] - _width(text)))
            found.append("  ".join(line).rstrip())
    return found


def render_page(root: Node) -> str:
    """All visible text of a page in reading order. Inner tables are laid out before outer ones."""
    tables: dict[int, list[str]] = {}
    for table in reversed(prune(root)):
        tables[id(table)] = _table(table, tables)
    return render(root, tables)


def render(root: Node, tables: dict[int, list[str]]) -> str:
    """The text below ``root``, whose tables' lines are in ``tables`` already."""
    page = Page()
    # (node, indent, list counter or None, inside pre); a string stands for what follows a block.
    work: list[tuple] = [(child, "", None, False) for child in reversed(root.children)]
    while work:
        node, indent, counter, pre = work.pop()
        if isinstance(node, int):
            page.break_line(node)
            continue
        if isinstance(node, str):
            if not pre:
                page.inline(node, indent)
                continue
            for k, line in enumerate(node.split("\n")):
                if k:
                    if not page.current and page.lines and not page.gap:
                        page.lines.append("")
                    page.break_line(0)
                if line.strip():
                    page.write(line, indent)
            continue
        name = node.name
        if name == "br":
            page.new_line()
            continue
        if name == "input":
            shown = node.attributes.get("type", "text").lower() in ("button", "submit", "reset")
            if shown and node.attributes.get("value"):
                page.inline(node.attributes["value"], indent)
            continue
        if name == "table":
            page.break_line(2)
            for line in tables.pop(id(node)):
                if line:
                    page.write(line, indent)
                    page.break_line(1)
                else:
                    page.break_line(2)
            page.break_line(2)
            continue
        breaks = 2 if name in SPACED else 1 if name in BLOCK else 0
        if name in ("ul", "ol", "menu") and counter is not None:
            breaks = 1
        if breaks:
            page.break_line(breaks)
            work.append((breaks, "", None, False))
        inner, inside = indent, counter
        if name in ("ul", "menu"):
            inside = [None]
        elif name == "ol":
            start = node.attributes.get("start", "1")
            inside = [int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1]
        elif name == "li":
            page.marker = "- "
            if counter and counter[0] is not None:
                page.marker = f"{counter[0]}. "
                counter[0] += 1
            inner = indent + "  "
        elif name in ("dd", "blockquote"):
            inner = indent + "  "
        if name == "li":
            # The marker stands in the item's indent.
            children = [(c, indent if k == 0 else inner, inside, pre) for k, c in enumerate(node.children)]
            work += reversed(children)
        else:
            work += [(c, inner, inside, pre or name == "pre") for c in reversed(node.children)]
    return page.text()


def visible_text(page: str | None) -> str | None:
    return None if page is None else render_page(parse(page))


def extract_text(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """(page_id, text, n_lines) of every row of ``pages``.

    Text is all that a reader sees, whole: hidden elements, scripts, comments and attributes are left
    out; blocks stand on lines of their own, paragraphs apart, list items carry a dash or their number,
    table cells stand side by side with their own blocks and lists. A null page gives null and no lines, an empty or broken one the text that
    can be read. Null ids and repeated rows stay; an empty table gives none. One pass, no shuffle.
    """

    def work(batches):
        for batch in batches:
            texts = [visible_text(page) for page in batch["html"]]
            yield {
                "page_id": batch["page_id"],
                "text": texts,
                "n_lines": [len(text.split("\n")) if text else 0 for text in texts],
            }

    own = pages.select(F.col(page_id).alias("page_id"), F.col(page).alias("html"))
    return map_batches(own, work, "page_id long, text string, n_lines long")
