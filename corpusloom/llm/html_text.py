"""Visible text of web pages, laid out: blocks, lists and aligned table cells."""

import re
from bisect import bisect_left
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by content model and by how browsers show them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {
    "area", "base", "datalist", "head", "iframe", "link", "meta", "noembed", "noframes", "param", "script", "source",
    "style", "template", "title", "track", "audio", "video", "canvas", "object",
    "svg title", "svg desc", "svg metadata", "svg defs", "svg symbol", "svg clippath", "svg mask", "svg marker",
    "svg pattern", "svg style", "svg script", "math annotation", "math annotation-xml", "math mphantom",
}
#: Elements of SVG and MathML are named with their language and a space, which no tag holds.
FOREIGN = {"svg", "math"}
#: Foreign elements in which HTML begins again.
HTML_WITHIN = {"svg foreignobject", "svg desc", "svg title", "math mi", "math mo", "math mn", "math ms", "math mtext"}
#: HTML that ends a foreign element that was left open.
BREAKS_OUT = {
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s",
    "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var",
}
#: SVG elements whose own characters are drawn, within a text.
LETTERED = {"svg text", "svg tspan", "svg textpath", "svg a"}
HEAD_ONLY = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
SPACED = {"blockquote", "dl", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "p", "pre", "table", "ul"}
BLOCK = SPACED | {
    "address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "div", "dt", "fieldset",
    "figcaption", "footer", "form", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "search",
    "section", "summary", "tbody", "tfoot", "thead", "tr",
}
CLOSES_P = (BLOCK | {"td", "th"}) - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "dialog", "legend"}
#: For an opening tag, the open elements it ends and those that it doesn't look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPES = {"html", "table", "td", "th", "caption", "button", "object", "template"} | HTML_WITHIN
TABLE_PARTS = {"table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}

#: Markup at a "<". Nothing here is matched twice, so time is linear in the page.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>",
    re.S,
)
TAG_BEGINS = re.compile(r"</?[A-Za-z]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: Controls whose label stands apart from the text beside it.
CONTROLS = {"button"}
#: Widest cell line that other cells of its column are aligned to, and the most columns or rows that a cell spans.
ALIGNED, MOST_COLUMNS, MOST_ROWS = 48, 1000, 65534
#: Levels of indents that are shown, and of tables within tables whose cells are aligned.
DEEPEST, NESTED = 12, 8
#: Spaces that may align a table, for each character and each cell of it: the text stays within a multiple of the page.
PADDING = 2, 24
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def hidden(self) -> bool:
        a = self.attributes
        return (
            self.tag in UNSEEN
            or "hidden" in a
            or bool(NOT_SHOWN.search(a.get("style", "")))
            or " " in self.tag and a.get("display") == "none"
            or self.tag == "input"
        )

    def visible(self, inherited: bool) -> bool:
        """By its own style, the last one given, or else as the element around it."""
        own = VISIBILITY.findall(self.attributes.get("style", ""))
        if not own and " " in self.tag and "visibility" in self.attributes:
            own = [self.attributes["visibility"]]
        return own[-1].lower() == "visible" if own else inherited

    def foreign(self) -> bool:
        """Whether tags within it are those of SVG or MathML."""
        if self.tag == "math annotation-xml":
            return self.attributes.get("encoding", "").lower() not in ("text/html", "application/xhtml+xml")
        return " " in self.tag and self.tag not in HTML_WITHIN


class TreeBuilder:
    """Nodes of a page. Tags that authors leave out are implied; a stray end tag is ignored."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        #: Where in `open` the elements of each tag are, and those of HTML, so that no end tag looks through all of them.
        self.at: dict[str, list[int]] = {"html": [0]}
        self.at_html = [0]

    def pop(self) -> None:
        tag = self.open.pop().tag
        self.at[tag].pop()
        if " " not in tag:
            self.at_html.pop()

    def last(self, tag: str) -> int:
        """Where the innermost open element of a tag is; -1 if there is none."""
        found = self.at.get(tag)
        return found[-1] if found else -1

    def close(self, tags: set[str], beyond: set[str]) -> None:
        """End the innermost open element of these tags, unless it lies beyond one of the others."""
        inner = max(map(self.last, tags))
        if inner > 0 and inner >= max(map(self.last, beyond), default=0):
            while len(self.open) > inner:
                self.pop()

    def start(self, tag: str, attributes: dict[str, str], closed: bool = False) -> bool:
        """Open an element; whether it is one of HTML. One of SVG or MathML may be closed by its own tag."""
        if self.open[-1].foreign() and (tag in BREAKS_OUT or tag == "font" and attributes.keys() & {"color", "face", "size"}):
            while self.open[-1].foreign():
                self.pop()
        if tag in FOREIGN or self.open[-1].foreign():
            if self.at.get("head"):
                self.close({"head"}, set())
            name = f"{tag if tag in FOREIGN else self.open[-1].tag.split(' ')[0]} {tag}"
            self.add(Node(name, attributes), closed)
            return False
        self.start_html(tag, attributes)
        return True

    def add(self, node: Node, closed: bool) -> None:
        self.open[-1].children.append(node)
        if not closed:
            self.at.setdefault(node.tag, []).append(len(self.open))
            if " " not in node.tag:
                self.at_html.append(len(self.open))
            self.open.append(node)

    def start_html(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("select", "input", "textarea") and self.at.get("select"):
            self.close({"select"}, SCOPES)
            if tag == "select":
                return
        if tag in ("html", "body") and (tag == "html" or self.at.get("body")):
            return
        if self.at.get("head") and tag not in HEAD_ONLY and tag != "head":
            self.close({"head"}, set())
        if tag in CLOSES_P:
            self.close({"p"}, SCOPES)
        if tag in ENDS:
            self.close(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {})
        self.add(Node(tag, attributes), tag in VOID)

    def end(self, tag: str) -> None:
        if tag in ("p", "br"):
            while self.open[-1].foreign():
                self.pop()
        found = max((self.last(f"{language} {tag}"), f"{language} {tag}") for language in FOREIGN)
        if found[0] > self.last(tag):
            # where HTML is open within, only the end of its foreign element or of the whole one ends it
            if found[0] > self.at_html[-1] or tag in FOREIGN or found[1] in HTML_WITHIN:
                while len(self.open) > found[0]:
                    self.pop()
                return
        if tag == "br":
            self.start("br", {})
        elif tag not in ("html", "body"):
            self.close({tag}, {"table"} if tag in TABLE_PARTS - {"table"} else set() if tag == "table" else SCOPES - {tag})

    def text(self, data: str) -> None:
        if not data.isspace() and self.at.get("head") and self.open[-1].tag == "head":
            self.close({"head"}, set())
        self.open[-1].children.append(data)


def closes_itself(inside: str) -> bool:
    """Whether a tag ends in a slash that is no part of an attribute's value."""
    if not inside.endswith("/"):
        return False
    last = max(map(inside.rfind, " \t\n\r\f\"'")) + 1
    return "=" not in inside[last:] and not inside[:last].rstrip().endswith("=")


def parse(html: str) -> Node:
    builder, at = TreeBuilder(), 0
    while at < len(html):
        m, end = None, html.find("<", at)
        while end >= 0 and not (m := MARKUP.match(html, end)) and not TAG_BEGINS.match(html, end):
            end = html.find("<", end + 1)
        end = end if end >= 0 else len(html)
        if end > at:
            builder.text(unescape(html[at:end]))
        if not m:  # the end, or a tag that never ends
            break
        at = m.end()
        if not m[2]:
            if " " in builder.open[-1].tag and m[0].startswith("<![CDATA["):
                builder.text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            builder.end(tag)
            continue
        found = ATTRIBUTE.findall(m[3]) if m[3] else ()
        attributes = {n.lower(): unescape(a or b or c) for n, a, b, c in reversed(found)}
        if builder.start(tag, attributes, closes_itself(m[3])) and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            if close.start() > at:
                builder.text(html[at : close.start()] if tag in ("script", "style") else unescape(html[at : close.start()]))
            at = close.end()
            builder.end(tag)
    return builder.root


class Layout:
    """Lines of text in which runs of white space are one space and blocks are kept apart."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indents: list[int] = []
        self.indent = 0
        self.marker = ""
        self.weight = 0  # characters shown, without white space

    def put(self, data: str, keep: bool = False) -> None:
        if keep:
            self.weight += len(data) - data.count(" ")
            first, *rest = data.split("\n")
            self.word((" " if self.space and self.line else "") + first)
            self.space = False
            for more in rest:
                self.finish(force=True)
                self.word(more)
            return
        parts = SPACES.split(data)
        for i, part in enumerate(parts):
            self.space = self.space or i > 0
            if part:
                self.weight += len(part)
                self.word((" " if self.space and self.line else "") + part)
                self.space = False

    def word(self, data: str) -> None:
        if not data:
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            data = "  " * min(self.indent, DEEPEST) + self.marker + data
            self.marker = ""
        self.line.append(data)

    def deeper(self, levels: int) -> None:
        self.indents.append(levels)
        self.indent += levels

    def back(self) -> None:
        self.indent -= self.indents.pop()

    def finish(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def part(self) -> None:
        """Begin a cell of a table that is not aligned."""
        self.space = True

    def apart(self, spaced: bool) -> None:
        self.finish()
        self.blank = self.blank or spaced

    def shown(self) -> list[str]:
        """The lines, without empty ones before and after them."""
        self.finish()
        first, last = 0, len(self.lines)
        while last and not self.lines[last - 1]:
            last -= 1
        while first < last and not self.lines[first]:
            first += 1
        return self.lines[first:last]


def span_of(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and re.fullmatch(r"[0-9]{1,9}", value.strip()) else 1


class Cell(NamedTuple):
    lines: list[str]
    weight: int
    columns: int
    rows: int


def places(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Each cell with its column, the first that no cell of an earlier row fills; MOST_COLUMNS is that of all further ones."""
    until, placed = None, []  # the row up to which a cell that began above fills a column
    for r, row in enumerate(rows):
        line, at = [], 0
        for cell in row:
            if until is not None and at < MOST_COLUMNS and until[at] > r:
                free = until[at:] <= r
                at = at + int(free.argmax()) if free.any() else MOST_COLUMNS
            line.append((at, cell))
            if cell.rows > 1:
                until = np.zeros(MOST_COLUMNS, dtype=np.int64) if until is None else until
                until[at : at + cell.columns] = r + cell.rows
            at = min(at + cell.columns, MOST_COLUMNS)
        placed.append(line)
    return placed


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table: cells of a column start at the same place, further lines of a cell lie below.

    Lines longer than ALIGNED widen no column, so a page with one long cell is not padded to its length. A table that
    would be padded by more than PADDING for its characters and cells is not aligned: two spaces part its cells.
    """
    placed = places(rows)
    width: dict[int, int] = {}
    for line in placed:
        for at, cell in line:
            if cell.columns == 1 and at < MOST_COLUMNS:
                for x in cell.lines:
                    if width.get(at, 0) < len(x) <= ALIGNED:
                        width[at] = len(x)
    columns = sorted(width)
    starts = list(accumulate((width[c] + 2 for c in columns), initial=0))
    begin = {at: starts[bisect_left(columns, at)] for line in placed for at, _ in line}
    for padded in (True, False):
        out, spent = [], 0
        allowed = sum(PADDING[0] * cell.weight + PADDING[1] for line in placed for _, cell in line)
        for line in placed:
            below: list[list[tuple[int, str]]] = []  # what the cells show in their first line, the next, and so on
            for at, cell in line:
                below.extend([] for _ in range(len(cell.lines) - len(below)))
                for k, text in enumerate(cell.lines):
                    if text:
                        below[k].append((begin[at] if padded else 0, text))
            for some in below:
                parts, size = [], 0
                for at, text in some:
                    gap = max(at - size, 2 if parts else 0)
                    spent += gap
                    parts += [" " * gap, text]
                    size += gap + len(text)
                if spent > allowed and padded:
                    break
                out.append("".join(parts).rstrip())
            if spent > allowed and padded:
                break
        else:
            break
    return out


def options(select: Node) -> list[str]:
    """What a select shows: the last selected or else the first enabled option, or all options of a list box."""
    found, picked, enabled = [], None, None
    stack = [(c, False) for c in reversed(select.children)]
    size = select.attributes.get("size", "").strip()
    box = "multiple" in select.attributes or (re.fullmatch(r"0*[1-9][0-9]{0,8}", size) is not None and int(size) > 1)
    while stack:
        node, off = stack.pop()
        if isinstance(node, str) or node.tag in UNSEEN or box and node.hidden():
            continue
        a = node.attributes
        off = off or "disabled" in a
        if node.tag == "option":
            if "selected" in a:
                picked = len(found)
            if enabled is None and not off:
                enabled = len(found)
            found.append(a.get("label") or letters(node))
        else:
            if box and node.tag == "optgroup" and a.get("label"):
                found.append(a["label"])
            stack.extend((c, off) for c in reversed(node.children))
    if box:
        return found
    shown = enabled if picked is None else picked
    return [] if shown is None else [found[shown]]


def letters(node: Node) -> str:
    """The characters of a tree, apart from what is never shown."""
    out, stack = [], [*reversed(node.children)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in UNSEEN:
            stack.extend(reversed(x.children))
    return SPACES.sub(" ", "".join(out)).strip()


def drawn(node: Node, lettering: bool) -> list:
    """What an element of SVG or MathML shows of its children, with spaces between parts that are set apart."""
    children = node.children
    if node.tag == "svg switch":
        inner = [c for c in children if isinstance(c, Node)]
        children = ([c for c in inner if "systemlanguage" not in c.attributes] or inner)[:1]
    if node.tag in HTML_WITHIN or node.tag in LETTERED and lettering:
        return children
    if node.tag.startswith("svg "):
        return [c for c in children if isinstance(c, Node)]
    children = [c for c in children if isinstance(c, Node) or not c.isspace()]
    if node.tag in ("math mfrac", "math mtable", "math mtr", "math mlabeledtr"):
        return [x for c in children for x in (" ", c)][1:]
    return children


def render(root: Node) -> str:
    """The visible text of a tree, without recursion: nodes are entered and left by a stack of their own."""
    layouts, tables, lists = [Layout()], [], []
    stack: list[tuple[object, str]] = [(root, "enter")]
    keep = lettering = 0
    seen = [True]  # visibility of the elements that are open
    while stack:
        node, step = stack.pop()
        now = layouts[-1]
        if isinstance(node, str):
            if seen[-1] and not (tables and tables[-1]["open"] and tables[-1]["depth"] == len(layouts) and node.isspace()):
                now.put(node, keep > 0)
            continue
        tag = node.tag
        if step == "enter":
            if node.hidden():
                continue
            now.space = now.space or tag in CONTROLS
            visible = node.visible(seen[-1])
            if tag == "select":
                shown = options(node) if visible else []
                for text in shown:
                    if len(shown) > 1:
                        now.apart(False)
                    now.space = True
                    now.put(text)
                    now.space = True
                if len(shown) > 1:
                    now.apart(False)
                continue
            flat = bool(tables) and tables[-1]["flat"]
            cell = tag in ("td", "th") and tables
            if tag == "br":
                now.finish(force=True)
            elif tag == "table":
                now.apart(True)
                flat = len(tables) >= NESTED
                tables.append({"rows": [], "open": not flat, "depth": len(layouts), "flat": flat})
            elif flat and (cell or tag == "tr"):
                now.apart(False) if tag == "tr" else now.part()
            elif tag == "tr" and tables and tables[-1]["depth"] == len(layouts):
                tables[-1]["rows"].append([])
            elif cell:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                layouts.append(Layout())
            elif tag in BLOCK:
                now.apart(tag in SPACED and not (tag in ("ul", "ol") and lists))
                if tag in ("ul", "ol", "menu"):
                    begin = node.attributes.get("start", "1")
                    lists.append(int(begin) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", begin) else 1 if tag == "ol" else None)
                elif tag == "li":
                    number = lists[-1] if lists else None
                    now.marker = f"{number}. " if number is not None else "- "
                    if number is not None:
                        lists[-1] = number + 1
                    now.deeper(int(len(lists) > 1))
                elif tag in ("blockquote", "dd"):
                    now.deeper(1)
            keep += tag in ("pre", "textarea")
            seen.append(visible)
            stack.append((node, "leave"))
            if " " in tag:
                a = node.attributes
                if tag == "math math" and a.get("display") == "block":
                    now.apart(False)
                lettering += tag == "svg text"
                now.space = now.space or tag == "svg text" or tag == "svg tspan" and ("x" in a or "y" in a)
                stack.extend((c, "enter") for c in reversed(drawn(node, lettering > 0)))
            else:
                stack.extend((c, "enter") for c in reversed(node.children))
        else:
            seen.pop()
            now.space = now.space or tag in CONTROLS
            keep -= tag in ("pre", "textarea")
            lettering -= tag == "svg text"
            if tag == "svg text":
                now.space = True
            elif tag == "math math" and node.attributes.get("display") == "block":
                now.apart(False)
            if tag == "table":
                table = tables.pop()
                now.finish()
                now.weight += sum(cell.weight for row in table["rows"] for cell in row)
                for line in aligned(table["rows"]):
                    now.word(line)
                    now.finish(force=True)
                now.apart(True)
            elif tag in ("td", "th") and tables and tables[-1]["flat"]:
                now.part()
            elif tag in ("td", "th") and tables and len(layouts) > 1:
                layouts.pop()
                a = node.attributes
                cell = Cell(now.shown(), now.weight, span_of(a.get("colspan"), MOST_COLUMNS), span_of(a.get("rowspan"), MOST_ROWS))
                tables[-1]["rows"][-1].append(cell)
            elif tag in BLOCK:
                now.apart(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
                if tag in ("ul", "ol", "menu"):
                    lists.pop()
                elif tag in ("li", "blockquote", "dd"):
                    now.back()
                    if tag == "li":
                        now.marker = ""
    return "\n".join(layouts[0].shown())


def title_of(root: Node) -> str | None:
    queue = [root]
    for node in queue:
        for child in node.children:
            if isinstance(child, Node):
                if child.tag == "title":
                    return SPACES.sub(" ", "".join(c for c in child.children if isinstance(c, str))).strip()
                if child.tag in ("html", "head"):
                    queue.append(child)
    return None


def page_text(html: str | None) -> tuple[str | None, str]:
    """(title, visible text) of a page."""
    root = parse(html or "")
    return title_of(root), render(root)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a struct column `page`: title and text.

    All visible text is kept, in order: nothing is judged to be boilerplate. What browsers do not show is
    left out: scripts, styles, comments, the head, options that are not chosen, and elements hidden by attribute
    or style. A drop-down list shows its selected or first enabled option, a list box all of them. Formulas show
    their symbols, drawings the characters of their text elements and HTML, without titles, descriptions and
    definitions; text of definitions is left out also where a `use` element draws it. Blocks start on new lines, paragraphs, headings, lists and tables are set off by an empty line, list
    items carry a dash or number, table cells of a column are aligned, also beside cells that span several columns
    or rows, preformatted text keeps its spaces. A visible part of an invisible element is shown.

    Time and text stay within a multiple of the page: no more than DEEPEST indents are shown, tables within NESTED
    others have their cells one after another, cells beyond column MOST_COLUMNS are not aligned, and neither are
    tables that would be mostly padding (PADDING). Misnested formatting elements are not opened again: they
    change no text, unless a style hides them.

    Null and empty pages give an empty text and no title. Unclosed and stray tags never fail; nesting may be
    of any depth. Rows are independent; other columns pass through, one named `page` is replaced.
    """

    @F.pandas_udf("title string, text string")
    def udf(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_text(v) for v in values], columns=["title", "text"], dtype=object)

    return pages.withColumn("page", udf(F.col(f"`{html_col}`")))
