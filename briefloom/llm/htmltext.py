"""Visible text of HTML pages, laid out.

A page is read once into a tree, with the tags that HTML implies (ends of p, li, dt, dd, option,
table parts; tr around cells; the end of head), text put into a table where no text may be
moved before it, and elements nested deeper than MOST_DEPTH made siblings.  What is not shown is
left out: head, scripts, styles, templates, elements with `hidden` or an inline or simple style rule
of display:none or visibility:hidden that holds on every screen.  Of drawings, text elements are shown.  All other text is emitted: blocks on lines of their own,
paragraphs with an empty line between them, list items with their marks and indents, quotes
with "> ", preformatted text as it is, table cells aligned in columns (a cell that spans rows keeps
its columns in all of them and its text in the first).

Null pages give null, empty or invisible ones the empty text.  Broken markup never raises: what
cannot be read as a tag is text, a tag that the page's end cuts off is dropped.  Rows are rendered one
by one, so repeated rows and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches

MOST_DEPTH = 150
#: Cells wider than this do not widen their column, so padding stays in proportion to the text.
MOST_WIDTH = 80

# HTML's bounds of colspan and rowspan, and its element groups.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = set("head script style template noscript iframe noembed noframes title meta link datalist object audio video canvas annotation annotation-xml".split())
IN_HEAD = set("base link meta noscript script style template title".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset".split())
BLOCK = SPACED | set("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav option optgroup search section summary caption tr".split())
CLOSES_P = (BLOCK - set("li dd dt tr caption option optgroup body html legend".split())) | {"p"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SCOPE = set("td th table caption button template html".split())
TABLE_PARTS = set("table tbody thead tfoot tr".split())
SECTIONS = set("tbody thead tfoot".split())
FORMATTING = set("a abbr b bdi bdo cite code dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\s*/?([^\s"'>/=]+)?(?:\s*=\s*("[^"]*(?:"|$)|'[^']*(?:'|$)|[^\s"'>]*))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*\+?([0-9]{1,9})")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_QUOTED = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"\n]*"|'[^'\n]*'""", re.S)
_MARKS = re.compile(r"[{};]")
_SHOWN_ON = re.compile(r"(?:only\s+)?(?:all|screen)|", re.I)
_SELECTOR = re.compile(r"[.#]?[A-Za-z_-][\w-]*")

# What of a drawing is not painted; the tags that end one, and the elements in which they do not.
UNDRAWN = set("defs symbol desc metadata clippath mask pattern marker lineargradient radialgradient filter".split())
ENDS_FOREIGN = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from a place behind a tag's name, and where the tag ends (-1: not at all)."""
    end = html.find(">", at)
    if end < 0:
        return {}, -1
    if end == at:
        return {}, end + 1
    found: dict[str, str] = {}
    while at < len(html):
        m = _ATTRIBUTE.match(html, at)
        if m[1]:
            value = m[2] or ""
            found.setdefault(m[1].lower(), unescape(value.strip("\"'") if value[:1] in "\"'" else value))
        at = m.end()
        while at < len(html) and html[at] in " \t\n\r\f/":
            at += 1
        if html[at : at + 1] == ">":
            return found, at + 1
        if m.end() == m.start() or (at < len(html) and html[at] in "\"'=" and not m[1]):
            at += 1
    return found, -1


def _on_screen(media: str) -> bool:
    """Whether a list of media queries holds on every screen."""
    return any(_SHOWN_ON.fullmatch(x.strip()) for x in media.split(","))


class Tree:
    """Builds the tree of one page; `hides` collects simple selectors that its styles hide."""

    def __init__(self, html: str) -> None:
        self.root = Node("html", {})
        self.stack = [self.root]
        self.hides: set[str] = set()
        self.drawn = False  # whether svg or math has been met
        self.read(html)

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                return
            if lt > at:
                self.text(html[at:lt])
            mark = html[lt + 1 : lt + 2]
            if mark == "!" or mark == "?":
                comment = html.startswith("<!--", lt)
                end = html.find("-->" if comment else ">", lt + (2 if comment else 1))
                at = size if end < 0 else end + (3 if comment else 1)
                continue
            m = _NAME.match(html, lt + 1 + (mark == "/"))
            if not m:
                self.text("<")
                at = lt + 1
                continue
            tag = m[0].lower()
            if mark == "/":
                end = html.find(">", m.end())
                at = size if end < 0 else end + 1
                if end >= 0:
                    self.end(tag)
                continue
            attrs, end = _attributes(html, m.end())
            if end < 0:
                return
            at = end
            self.start(tag, attrs)
            if self.drawn and html[end - 2] == "/" and tag not in VOID and any(x.tag in ("svg", "math") for x in self.stack):
                if self.stack[-1].tag == tag:
                    self.stack.pop()
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                inner = html[at : close.start() if close else size]
                if tag == "style" and _on_screen(attrs.get("media", "")):
                    self.style(inner)
                elif tag == "textarea" or tag == "xmp":
                    self.stack[-1].children.append(unescape(inner) if tag == "textarea" else inner)
                self.end(tag)
                end = html.find(">", close.end()) if close else -1
                at = size if end < 0 else end + 1

    def style(self, sheet: str) -> None:
        """Reads the rules that hold on every screen: not those in blocks with other media or conditions."""
        sheet = _QUOTED.sub(" ", sheet)
        opened: list[str | None] = []  # selectors, "" in a block whose rules count as those outside, None in what is passed over
        at = 0
        for m in _MARKS.finditer(sheet + "}"):
            part, at = sheet[at : m.start()].strip(), m.end()
            if m[0] == "{":
                if opened and opened[-1] != "":
                    opened.append(None)
                elif part.startswith("@"):
                    name, _, rest = part[1:].partition(" ") if " " in part else part[1:].partition("(")
                    opened.append("" if name.lower() == "layer" or name.lower() == "media" and _on_screen(rest) else None)
                else:
                    opened.append(part or None)
                continue
            if opened and opened[-1] and _HIDES.search(part):
                self.hides |= {s.strip() for s in opened[-1].split(",") if _SELECTOR.fullmatch(s.strip())}
            if m[0] == "}" and opened:
                opened.pop()

    def text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        top = self.stack[-1]
        if top.tag == "head" or top.tag in TABLE_PARTS:
            if not text.strip(" \t\n\r\f"):
                return
            if top.tag == "head":
                self.stack.pop()
            else:
                self.before_table(text)
                return
        self.stack[-1].children.append(text)

    def before_table(self, child: Node | str) -> None:
        """Puts what no table may hold before the innermost open table."""
        k = max(i for i, x in enumerate(self.stack) if x.tag == "table")
        children = self.stack[k - 1].children
        at = len(children) - 1
        while at > 0 and children[at] is not self.stack[k]:
            at -= 1
        children.insert(max(at, 0), child)

    def pop_to(self, tags: set[str], barriers: set[str]) -> bool:
        """Closes the innermost open element of the tags, unless a barrier is nearer."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                return True
            if self.stack[k].tag in barriers:
                return False
        return False

    def clear_to(self, tags: set[str]) -> bool:
        """Leaves everything inside the innermost open element of the tags."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k + 1 :]
                return True
            if self.stack[k].tag in ("template", "caption") or self.stack[k].tag == "table" and "table" not in tags:
                return False
        return False

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body" and self.stack[-1].tag == "head":
                self.stack.pop()
            if attrs:
                self.root.attrs = attrs | self.root.attrs
            return
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.stack.pop()
        if tag in ("svg", "math"):
            self.drawn = True
        elif self.drawn and tag in ENDS_FOREIGN:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in HOLDS_HTML:
                    break
                if self.stack[k].tag in ("svg", "math"):
                    del self.stack[k:]
                    break
        if tag in CLOSES_P:
            self.pop_to({"p"}, SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        elif tag == "li":
            self.pop_to({"li"}, SCOPE | {"ul", "ol", "menu", "blockquote", "dl"})
        elif tag in ("dd", "dt"):
            self.pop_to({"dd", "dt"}, SCOPE | {"dl", "ul", "ol", "blockquote"})
        elif tag in ("option", "optgroup"):
            self.pop_to({"option"} if tag == "option" else {"option", "optgroup"}, SCOPE | {"select", "datalist"})
        elif tag in SECTIONS or tag in ("caption", "colgroup"):
            if not self.clear_to({"table"}):
                return
        elif tag == "tr":
            if not self.clear_to(SECTIONS | {"table"}):
                return
        elif tag in ("td", "th"):
            if not self.clear_to({"tr"}):
                if not self.clear_to(SECTIONS | {"table"}):
                    return
                self.push("tr", {})
        self.push(tag, attrs)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node, top = Node(tag, attrs), self.stack[-1]
        if tag == "form" and top.tag in TABLE_PARTS:  # it stays empty there: what follows is the table's
            return
        if top.tag in TABLE_PARTS and tag not in TABLE_PARTS and tag not in ("td", "th", "caption", "colgroup", "col", "script", "style", "template", "input"):
            self.before_table(node)
        else:
            top.children.append(node)
        if tag not in VOID and len(self.stack) < MOST_DEPTH:
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.push("br", {})
        elif tag in HEADINGS:
            self.pop_to(HEADINGS, SCOPE)
        elif tag in TABLE_PARTS or tag in ("td", "th", "caption"):
            self.pop_to({tag}, {"template"} if tag == "table" else {"template", "table"})
        elif tag in FORMATTING:
            self.pop_to({tag}, BLOCK | SCOPE)
        elif tag == "li":
            self.pop_to({tag}, SCOPE | {"ul", "ol", "menu"})
        else:
            self.pop_to({tag}, SCOPE - {tag})


class Page:
    """Lines of laid-out text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.prefixes: list[str] = []
        self.mark: str | None = None  # replaces the last prefix on the next line
        self.gap, self.outside, self.space = 0, "", False

    def put(self, text: str) -> None:
        """Adds running text; white space collapses."""
        flat = _SPACES.sub(" ", text)
        if flat == " ":
            self.space = True
            return
        if not flat:
            return
        if self.words:
            if self.space or flat[0] == " ":
                self.words.append(" ")
        self.words.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def flush(self) -> None:
        if self.words:
            self.line("".join(self.words).replace("\xa0", " "))
            self.words = []
        self.space = False

    def line(self, text: str) -> None:
        if self.lines:
            self.lines += [self.outside.rstrip(" ")] * self.gap
        self.gap = 0
        prefixes = self.prefixes
        if self.mark is not None and prefixes:
            prefixes, self.mark = [*prefixes[:-1], self.mark], None
        self.lines.append(("".join(prefixes) + text).rstrip(" "))

    def block(self, gap: int) -> None:
        """Ends the line; what comes next is at least so many empty lines below."""
        self.flush()
        outside = "".join(self.prefixes)
        self.outside = min(self.outside, outside, key=len) if self.gap else outside
        self.gap = max(self.gap, gap)


def _hidden(node: Node, hides: set[str]) -> bool:
    a = node.attrs
    if node.tag in UNSEEN:
        return True
    if not a and not hides:
        return False
    if "hidden" in a or node.tag == "input" or _HIDES.search(a.get("style", "")):
        return True
    return bool(hides) and (node.tag in hides or f"#{a.get('id')}" in hides or any(f".{c}" in hides for c in a.get("class", "").split()))


def _drawn(node: Node, hides: set[str]) -> list[Node]:
    """The elements of a drawing that show text."""
    found = []
    for c in node.children:
        if isinstance(c, str) or c.tag in UNDRAWN or c.attrs.get("display") == "none" or _hidden(c, hides):
            continue
        found += [c] if c.tag in ("text", "foreignobject") else _drawn(c, hides)
    return found


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def _span(node: Node, name: str, least: int, most: int) -> int:
    """How many columns or rows a cell says that it takes."""
    found = _NUMBER.match(node.attrs.get(name, "1"))
    return min(max(int(found[1]), least), most) if found else 1


def _placed(rows: list[list[tuple[int, int, list[str]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Cells (columns and rows spanned, lines) of one group of rows as (first column, columns spanned, lines): a cell takes the first
    column that no cell from above reaches into.  A cell that spans no row spans all that are left of its group."""
    free: dict[int, int] = {}  # of each column: the first row that cells above leave free
    out = []
    for i, row in enumerate(rows):
        at, here = 0, []
        for across, down, lines in row:
            while free.get(at, 0) > i:
                at += 1
            here.append((at, across, lines))
            end = i + down if down else len(rows)
            if end > i + 1:
                for column in range(at, at + across):
                    free[column] = max(free.get(column, 0), end)
            at += across
        out.append(here)
    return out


def _cells(node: Node, hides: set[str]) -> tuple[list[list[tuple[int, int, list[str]]]], list[list[str]]]:
    """A table's rows of placed cells (first column, columns spanned, lines), and its captions.  Cells span no rows of another group."""
    rows, group, captions = [], [], []
    for c in node.children:
        if isinstance(c, str) or _hidden(c, hides):
            continue
        if c.tag == "caption":
            captions.append(laid_out(c, hides))
        elif c.tag == "tr":
            cells = [x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and not _hidden(x, hides)]
            group.append([(_span(x, "colspan", 1, MOST_COLUMNS), _span(x, "rowspan", 0, MOST_ROWS), laid_out(x, hides)) for x in cells])
        elif c.tag in SECTIONS:
            rows += _placed(group)
            group = []
            part = _cells(c, hides)
            rows += part[0]
            captions += part[1]
    return rows + _placed(group), captions


def _table(page: Page, node: Node, hides: set[str]) -> None:
    """Columns are aligned; the text of a cell that spans rows stands in the first of them."""
    rows, captions = _cells(node, hides)
    for lines in captions:
        for x in lines:
            page.line(x)
    widths: dict[int, int] = {}
    for row in rows:
        for at, span, lines in row:
            if span == 1:
                widths[at] = max([widths.get(at, 0), *(w for w in map(_width, lines) if w <= MOST_WIDTH)])
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, next_column = [], 0
            for at, span, lines in row:
                parts += [" " * widths.get(i, 0) for i in range(next_column, at)]
                text = lines[k] if k < len(lines) else ""
                room = sum(widths.get(i, 0) for i in range(at, at + span)) + 2 * (span - 1)
                parts.append(text + " " * max(0, room - _width(text)))
                next_column = at + span
            page.line("  ".join(parts).rstrip(" "))


def _render(page: Page, node: Node, hides: set[str]) -> None:
    number = None
    if node.tag == "ol":
        first = node.attrs.get("start", "1")
        number = int(first) if first.lstrip("-").isdecimal() and len(first) < 10 else 1
    for c in node.children:
        if isinstance(c, str):
            page.put(c)
            continue
        if _hidden(c, hides):
            continue
        tag = c.tag
        if tag == "br":
            if page.words:
                page.flush()
            else:
                page.gap = max(page.gap, 1)
        elif tag == "pre" or tag == "textarea":
            page.block(tag == "pre")
            inner = Page()
            _verbatim(inner, c, hides)
            for x in "".join(inner.words).removeprefix("\n").rstrip().split("\n"):
                page.line(x)
            page.block(tag == "pre")
        elif tag == "svg":
            for x in _drawn(c, hides):
                page.space = True
                _render(page, x, hides)
                page.space = True
        elif tag == "table":
            page.block(1)
            _table(page, c, hides)
            page.block(1)
        elif tag == "li":
            page.block(0)
            mark = "- "
            if number is not None:
                mark, number = f"{number}. ", number + 1
            page.prefixes.append(" " * len(mark))
            outer, page.mark = page.mark, mark
            if outer is not None and len(page.prefixes) > 1:
                page.mark = mark
            _render(page, c, hides)
            page.block(0)
            page.prefixes.pop()
            page.mark = None
        elif tag == "blockquote" or tag == "dd":
            page.block(tag == "blockquote")
            page.prefixes.append("> " if tag == "blockquote" else "  ")
            _render(page, c, hides)
            page.block(0)
            page.prefixes.pop()
            page.block(tag == "blockquote")
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and bool(page.prefixes)
            gap = int(tag in SPACED and not nested)
            page.block(0 if page.mark is not None else gap)
            _render(page, c, hides)
            page.block(gap)
        else:
            _render(page, c, hides)


def _verbatim(page: Page, node: Node, hides: set[str]) -> None:
    for c in node.children:
        if isinstance(c, str):
            page.words.append(c.replace("\r\n", "\n").replace("\r", "\n"))
        elif c.tag == "br":
            page.words.append("\n")
        elif c.tag == "svg" and not _hidden(c, hides):
            for x in _drawn(c, hides):
                _verbatim(page, x, hides)
        elif not _hidden(c, hides):
            _verbatim(page, c, hides)


def laid_out(node: Node, hides: set[str]) -> list[str]:
    page = Page()
    if not _hidden(node, hides):
        _render(page, node, hides)
    page.flush()
    return page.lines


def visible_text(html: str) -> str:
    tree = Tree(html)
    return "\n".join(laid_out(tree.root, tree.hides)).strip("\n")


def rendered(html: Column) -> Column:
    def shown(column: pa.Array) -> pa.Array:
        return pa.array((None if not x.is_valid else visible_text(x.as_py()) for x in column), pa.string(), size=len(column))

    return F.arrow_udf(shown, "string")(html)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = pages.select("page_id", rendered(F.col("html")).alias("text"))
    return text.select("page_id", "text", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
