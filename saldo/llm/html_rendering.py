"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags (a paragraph ends at the next block, an item at the next item, a cell
at the next cell or row, what is open at the end of the page) give a tree; rules of visibility leave out what a browser
does not show; rendering emits all visible text, blocks set apart, items with their marks and depth, and the cells of a
table in aligned columns. Trees are built and rendered with a stack of their own, so nesting may be of any depth.

Visibility follows the page: `display: none` takes an element out with all that is in it; `visibility` is inherited, and an
element inside may show itself again. Both are read from `style` attributes and from the page's own style sheets, of which
rules for an element, a class, an id or a compound of these count (what stands in an @-rule does not). A closed `details`
shows its summary; an `input` shows its value only where a browser writes it out.

Cells are placed on a grid: a cell that spans columns covers them, one that spans rows keeps its columns free below. Spans end
with the table. Columns in which no cell begins are left out of the text, and so are the empty columns before a row of which
no cell shares its column with another; so spans of whatever size need no place of their own.

Defined cases: a null page gives null, an empty one or one without visible text the empty text; broken markup never
fails; equal rows give equal texts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Not shown by a browser.
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video datalist".split())
#: Not shown inside of svg and math, whose other text is.
HIDDEN_INSIDE = frozenset("annotation annotation-xml defs desc metadata symbol clippath mask marker pattern".split())
#: Elements of svg and math that hold HTML again.
HOLDS_HTML = frozenset("foreignobject mi mn mo ms mtext".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul tr tbody thead "
    "tfoot caption optgroup option".split()
)
#: Set apart by an empty line.
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol pre table ul menu dir article section".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body html li dt dd option optgroup caption tr tbody thead tfoot legend summary".split())
#: An opening tag ends an open one of these, up to the nearest of the others.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("caption", "thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tbody": (("caption", "thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("caption", "thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Kinds of input that write their value out.
WRITTEN = frozenset(("", *"text search email tel url number date time datetime-local month week submit reset button".split()))
_PROPERTY = re.compile(r"(?i)(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children", "inside", "styles")

    def __init__(self, name: str, attributes: dict[str, str], inside: bool = False):
        """inside: of svg or math, or one of them."""
        self.name, self.attributes, self.children, self.inside = name, attributes, [], inside
        self.styles: list[str] | tuple = ()  # the style sheets, at the root


def tree(page: str) -> Node:
    """The page as a tree of nodes and strings."""
    root = Node("html", {})
    root.styles = []
    stack, at = [root], 0

    def text(start: int, end: int) -> None:
        if end > start:
            stack[-1].children.append(html.unescape(page[start:end]))

    def close(names, limits) -> None:
        """Ends the outermost open element of names above the innermost of limits."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in limits:
                break
            if stack[k].name in names:
                del stack[k:]

    search = _TAG.search
    while found := search(page, at):
        text(at, found.start())
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if name not in BLOCKS and any(x.name in BLOCKS for x in stack[k + 1 :]):
                        del stack[k]  # blocks inside stay open
                    else:
                        del stack[k:]
                    break
                if stack[k].name in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break  # what began outside of a cell is not ended inside
            continue
        if name == "html":
            continue
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ENDS_PARAGRAPH:
            close(("p",), ("td", "th", "li", "dd", "button", "div", "blockquote", "section", "article"))
        if name in BLOCKS and stack[-1].name == "head":
            stack.pop()
        attributes = {}
        if found[3]:
            for key, *values in _ATTRIBUTE.findall(found[3]):
                attributes.setdefault(key.lower(), html.unescape("".join(values)))
        over = stack[-1]
        node = Node(name, attributes, name in ("svg", "math") or (over.inside and over.name not in HOLDS_HTML))
        over.children.append(node)
        if name in VOID or (node.inside and found[4]):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            at = end.end() if end else len(page)
            if name == "style":
                root.styles.append(body)
            continue
        stack.append(node)
    text(at, len(page))
    return root


class Sheet:
    """What the style sheets of a page say about display and visibility."""

    def __init__(self, css: str = ""):
        #: By element, class or id that a selector ends with: its parts, and what it sets with its weight.
        self.rules: dict[str, list[tuple[str, frozenset, dict]]] = {}
        if "display" not in css and "visibility" not in css:
            return
        css, at, order = _COMMENT.sub(" ", css), 0, 0
        while (opening := css.find("{", at)) >= 0:
            selector = css[at:opening].rsplit(";", 1)[-1].strip()
            if selector.startswith("@"):  # skipped with all blocks inside
                depth, at = 1, opening + 1
                while depth and at < len(css):
                    depth += {"{": 1, "}": -1}.get(css[at], 0)
                    at += 1
                continue
            closing = css.find("}", opening)
            closing = len(css) if closing < 0 else closing
            found = properties(css[opening + 1 : closing])
            for one in selector.split(",") if found else ():
                if (match := _COMPOUND.fullmatch(one.strip())) and match[0]:
                    order += 1
                    tag, parts = (match[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", match[2]))
                    weight = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), tag != "*", order)
                    set_ = {name: ((important, False, *weight), value) for name, (important, value) in found.items()}
                    self.rules.setdefault(min(parts) if parts else tag, []).append((tag, parts, set_))
            at = closing + 1

    def says(self, node: Node) -> dict[str, str]:
        """The display and visibility given for an element by rules and by its own style."""
        own = properties(node.attributes["style"]) if "style" in node.attributes else {}
        best = {name: ((important, True), value) for name, (important, value) in own.items()}
        if self.rules:
            parts = {f".{x}" for x in node.attributes.get("class", "").split()}
            if "id" in node.attributes:
                parts.add(f"#{node.attributes['id']}")
            for key in (node.name, "*", *parts):
                for tag, needed, set_ in self.rules.get(key, ()):
                    if tag in ("*", node.name) and needed <= parts:
                        for name, found in set_.items():
                            if name not in best or found[0] > best[name][0]:
                                best[name] = found
        return {name: value for name, (_, value) in best.items()}


def properties(css: str) -> dict[str, tuple[bool, str]]:
    """display and visibility as declared: whether important, and the value; later declarations win."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in _PROPERTY.findall(css):
        name, important = name.lower(), bool(important)
        if name not in found or important >= found[name][0]:
            found[name] = (important, value.lower())
    return found


def displayed(node: Node, says: dict[str, str]) -> bool:
    """Whether an element takes part in the rendering."""
    given = node.attributes
    if node.name in HIDDEN or (node.inside and (node.name in HIDDEN_INSIDE or given.get("display") == "none")):
        return False
    if node.name == "input" and given.get("type", "").lower() == "hidden":
        return False
    return says.get("display", "none" if "hidden" in given else "") != "none"


def seen_in(node: Node, says: dict[str, str], outside: bool) -> bool:
    """Whether the text of an element is seen, inherited from outside unless it says so itself."""
    given = says.get("visibility") or (node.attributes.get("visibility", "").lower() if node.inside else "")
    return given == "visible" if given in ("visible", "hidden", "collapse") else outside


class _Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # empty lines wanted before the next text
        self.mark = ""  # of an item, before its first text
        self.depth = 0

    def add(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.split("\n")
            self.line.append(first)
            for line in rest:
                self.end(force=True)
                self.line.append(line)
            return
        text = _SPACE.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] in ("", " ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def end(self, force: bool = False) -> None:
        line = "".join(self.line).rstrip(" \t")
        self.line = []
        if line or force:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.append("  " * max(0, self.depth - 1) + (self.mark or ("  " if self.depth else "")) + line)
            self.mark = ""

    def apart(self, lines: int) -> None:
        self.end()
        self.gap = max(self.gap, lines)


@dataclass
class Cell:
    text: str
    columns: int = 1
    rows: int = 1


def grid(rows: list[list[Cell]]) -> list[list[tuple[int, int, Cell]]]:
    """Per row its cells with first column and columns covered.

    Columns covered from above are kept as stretches that end with the same row, so a wide cell is one step.
    """
    placed, last = [], 0
    held: list[tuple[int, int, int]] = []  # first column, column past the last, row past the last; in order, disjoint
    for y, row in enumerate(rows):
        held = [h for h in held if h[2] > y]
        out, new, x, i = [], [], 0, 0
        for cell in row:
            while i < len(held) and held[i][0] <= x:
                x = held[i][1]
                i += 1
            width = min(cell.columns, held[i][0] - x) if i < len(held) else cell.columns
            out.append((x, width, cell))
            last = max(last, x)
            if cell.rows > 1:
                new.append((x, x + width, min(len(rows), y + cell.rows)))
            x += width
        if new:
            joined: list[tuple[int, int, int]] = []
            for h in sorted(held + new):
                if joined and joined[-1][1] == h[0] and joined[-1][2] == h[2]:
                    joined[-1] = (joined[-1][0], *h[1:])
                else:
                    joined.append(h)
            held = joined
        placed.append(out)
    # What a cell spans beyond the last column in which any begins is of no use.
    return [[(x, min(width, last - x + 1), cell) for x, width, cell in row] for row in placed]


def _table(rows: list[list[Cell]]) -> list[str]:
    """Rows of cells in aligned columns; a cell of several lines takes as many."""
    placed = grid(rows)
    # Columns in which no cell begins are left out.
    begun = sorted({x for row in placed for x, _, _ in row})
    at = {x: i for i, x in enumerate(begun)}
    placed = [[(at[x], bisect_left(begun, x + width) - at[x], cell) for x, width, cell in row] for row in placed]
    count = len(begun)
    begins = Counter(x for row in placed for x, _, _ in row)
    lines = {id(cell): cell.text.split("\n") for row in placed for _, _, cell in row}
    longest = {key: max(map(len, value)) for key, value in lines.items()}
    widths = [0] * count
    for row in placed:
        for x, width, cell in row:
            if width == 1:
                widths[x] = max(widths[x], longest[id(cell)])
    for x, width, cell in sorted((c for row in placed for c in row if c[1] > 1), key=lambda c: c[1]):
        missing = longest[id(cell)] - sum(widths[x : x + width]) - 3 * (width - 1)
        if missing > 0:
            widths[x + width - 1] += missing
    out = []
    for row in placed:
        # Where no cell of a row stands below or above another, there is nothing to align the row with.
        aligned = any(begins[x] > 1 for x, _, _ in row)
        for k in range(max((len(lines[id(cell)]) for _, _, cell in row), default=0)):
            parts, at = [], 0 if aligned or not row else row[0][0]
            for x, width, cell in row:
                parts += [" " * w for w in widths[at:x]]
                text = lines[id(cell)]
                parts.append((text[k] if k < len(text) else "").ljust(sum(widths[x : x + width]) + 3 * (width - 1)))
                at = x + width
            out.append(" | ".join(parts).rstrip())
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "").strip()
    number = int(value) if re.fullmatch(r"\d{1,9}", value) else 1
    return most if name == "rowspan" and not number else max(1, min(number, most))


def render(page: str) -> str:
    """The visible text of a page."""
    flow, flows = _Flow(), []  # outer flows wait while a cell is rendered
    rows: list[list[list[Cell]]] = []  # of the tables that are open
    counters: list[int | None] = []  # of the lists that are open: the next number, or None
    pre, seen = 0, True
    root = tree(page)
    sheet = Sheet("\n".join(root.styles))
    # Steps to take, last first: a node or text to render, or a function to call when a node ends.
    todo: list = [root]

    def after_table() -> None:
        for line in _table(rows.pop()):
            flow.line = [line]
            flow.end()
        flow.apart(1)

    def after_cell() -> None:
        nonlocal flow
        flow.end()
        done, flow = flow, flows.pop()
        rows[-1][-1][-1].text = "\n".join(x for x in done.lines if x)

    def after_list() -> None:
        counters.pop()
        flow.depth -= 1
        flow.apart(0 if flow.depth else 1)

    def see(now: bool) -> None:
        nonlocal seen
        seen = now

    def after_pre() -> None:
        nonlocal pre
        pre -= 1
        flow.apart(1)

    while todo:
        step = todo.pop()
        if callable(step):
            step()
            continue
        if isinstance(step, str):
            if seen:
                flow.add(step, keep=pre > 0)
            continue
        says = sheet.says(step)
        if not displayed(step, says):
            continue
        name, children = step.name, step.children
        if (now := seen_in(step, says, seen)) != seen:
            todo.append(partial(see, seen))
            seen = now
        if name == "br":
            flow.end(force=bool(flow.line) or not flow.gap)
        elif name == "img":
            flow.add(step.attributes.get("alt", "") if seen else "")
        elif name == "input":
            kind = step.attributes.get("type", "").strip().lower()
            if seen and (kind in WRITTEN or kind == "image"):
                flow.add(step.attributes.get("alt" if kind == "image" else "value", ""))
        elif name == "hr" and seen:
            flow.apart(1)
            flow.line = ["---"]
            flow.apart(1)
        elif name == "table":
            flow.apart(1)
            rows.append([])
            todo.append(after_table)
        elif name == "tr" and rows:
            rows[-1].append([])
        elif name in ("td", "th") and rows:
            if not rows[-1]:
                rows[-1].append([])
            rows[-1][-1].append(Cell("", _span(step, "colspan", 1000), _span(step, "rowspan", 65_534)))
            flows.append(flow)
            flow = _Flow()
            todo.append(after_cell)
        elif name in ("ul", "ol", "menu", "dir"):
            flow.apart(0 if flow.depth else 1)
            start = step.attributes.get("start", "1")
            counters.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if name == "ol" else None)
            flow.depth += 1
            todo.append(after_list)
        elif name == "li":
            flow.apart(0)
            if counters and counters[-1] is not None:
                flow.mark = f"{counters[-1]}. "
                counters[-1] += 1
            else:
                flow.mark = "- "
            if not seen:
                flow.mark = ""
            flow.depth = max(flow.depth, 1)
            todo.append(lambda: flow.apart(0))
        elif name == "text" and step.inside:  # a label of a drawing
            flow.apart(0)
            todo.append(lambda: flow.apart(0))
        elif name == "pre":
            flow.apart(1)
            pre += 1
            todo.append(after_pre)
        elif name in BLOCKS:
            lines = 1 if name in SPACED else 0
            flow.apart(lines)
            todo.append(lambda lines=lines: flow.apart(lines))
            if name == "details" and "open" not in step.attributes:
                children = [x for x in children if isinstance(x, Node) and x.name == "summary"][:1]
        todo.extend(reversed(children))
    while flows:  # a cell outside of any table's end
        after_cell()
    flow.end()
    return "\n".join(flow.lines).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, text): the visible text of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return pages.select(key, markup).mapInArrow(run, f"`{key}` {kind}, text string")
