"""Operator 4: HTML extraction by layout-aware rendering.

A tree builder supplies implied tags; a renderer walks the tree and emits all visible
text, with the spacing of blocks, list markers and tables in aligned columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelane.llm.common import table

# Fixed values of the HTML standard: which elements are void, hold raw text, are not shown,
# start a block, and which open elements a start tag closes (up to the named boundary).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
ESCAPABLE = {"textarea", "title"}
#: Boxes of their own within a line: words don't run on into them.
CONTROLS = {"button", "textarea", "select"}
HIDDEN = set("head script style title template noscript iframe noembed noframes datalist audio video canvas".split())
#: What a head may hold; any other tag, and text, begins the body. Parts of SVG and MathML that only define or describe.
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template".split())
FOREIGN_HIDDEN = set("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc annotation annotation-xml mphantom".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset".split())
BLOCK = SPACED | set("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav search section summary tr td th caption thead tbody tfoot option optgroup select".split())
CELLS, ROWS = {"td", "th"}, {"thead", "tbody", "tfoot"}
CLOSES = (
    {x: ({"p"}, {"table", "td", "th", "caption", "button", "object"}) for x in BLOCK - CELLS - ROWS - {"tr", "option", "optgroup", "html", "body"}}
    | {"li": ({"li", "p"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd", "p"}, {"dl", "table"}), "dd": ({"dt", "dd", "p"}, {"dl", "table"})}
    | {"option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"})}
    | {x: (CELLS | {"caption"}, {"tr", "table"}) for x in CELLS}
    | {"tr": (CELLS | {"tr", "caption"}, {"table"}) }
    | {x: (CELLS | ROWS | {"tr", "caption", "colgroup"}, {"table"}) for x in ROWS}
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
GONE = re.compile(r"(?:^|;|\*/)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)(?![\w-])", re.I)
SHOWN = re.compile(r"(?:^|;|\*/)\s*visibility\s*:\s*(hidden|collapse|visible)(?![\w-])", re.I)
#: Fixed values of the standard: the most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Tables within so many others are laid out as blocks: each level of cells is laid out again by those around it.
MOST_TABLES, FLAT = 20, "table laid out as blocks"


class Node:
    __slots__ = ("attributes", "children", "foreign", "tag")

    def __init__(self, tag: str, attributes: str = "", foreign: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        #: "svg" (where text isn't drawn), "text" inside of its text elements, "math", or "".
        self.foreign = tag if tag in ("svg", "math") or tag == "text" and foreign else "" if tag == "foreignobject" else foreign

    def get(self, name: str) -> str | None:
        for k, *v in ATTRIBUTE.findall(self.attributes):
            if k.lower() == name:
                return unescape("".join(v))
        return None

    def present(self) -> bool:
        """Whether it, or what it holds, can be seen at all."""
        if self.tag in HIDDEN or self.foreign and self.tag in FOREIGN_HIDDEN:
            return False
        if self.tag == "input" or self.tag == "dialog" and self.get("open") is None:
            return False
        if not self.attributes:
            return True
        if self.get("hidden") is not None:
            return False
        if self.foreign and self.get("display") == "none":
            return False
        return not GONE.search(self.get("style") or "")

    def shown(self, around: bool) -> bool:
        """Whether its text is drawn; an element may be visible within a hidden one that takes up its space."""
        if not self.attributes:
            return around
        said = SHOWN.findall(self.get("style") or "") or [self.get("visibility") or ""] * bool(self.foreign)
        return said[-1].lower() == "visible" if said and said[-1] else around

    def span(self, name: str, most: int) -> int:
        n = self.get(name) or ""
        return max(1, min(most, int(n))) if re.fullmatch(r"\s*[0-9]{1,9}\s*", n) else 1


class Open:
    """The open elements, and for each tag where in the stack it stands, so that neither end
    tags nor implied ones search the stack."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close(self, k: int) -> None:
        for node in reversed(self.stack[k:]):
            self.at[node.tag].pop()
        del self.stack[k:]

    def last(self, tags) -> int:
        """Place of the innermost element with one of the tags; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_after(self, tags, k: int) -> int:
        """Place of the outermost element with one of the tags that stands after place k; 0 if there is none."""
        return min((own[i] for t in tags if (own := self.at.get(t)) and (i := bisect_right(own, k)) < len(own)), default=0)


def build(html: str) -> Node:
    """The tree, with implied end tags, and implied rows in tables. Unknown end tags are passed over."""
    root, at = Node("html"), 0
    open_ = Open(root)
    stack = open_.stack

    def body() -> None:
        if len(stack) > 1 and stack[1].tag == "head":
            open_.close(1)

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            body()
        if raw and stack[-1].foreign != "svg":
            stack[-1].children.append(raw)

    while m := TAG.search(html, at):
        text(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            bound = ("table",) if tag not in CELLS | ROWS | {"table", "caption"} else ()
            k = open_.last((tag,))
            if k and k > open_.last(bound):
                open_.close(k)
            continue
        if tag == "body" or tag not in IN_HEAD | {"html", "head"}:
            body()
        if tag in ("html", "body"):
            continue
        closes, bound = CLOSES.get(tag, ((), ()))
        if k := open_.first_after(closes, open_.last(bound)):
            open_.close(k)
        if tag in CELLS and stack[-1].tag in ROWS | {"table"}:
            stack[-1].children.append(Node("tr"))
            open_.push(stack[-1].children[-1])
        node = Node(tag, m[3], stack[-1].foreign)
        stack[-1].children.append(node)
        if tag in RAW and not (node.foreign and m[3].endswith("/")):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            raw = html[at : end.start() if end else len(html)]
            node.children.append(unescape(raw) if tag in ESCAPABLE else raw)
            at = end.end() if end else len(html)
        elif tag not in VOID and not (node.foreign and m[3].endswith("/")):
            open_.push(node)
    text(unescape(html[at:]))
    return root


class Page:
    """Text so far; white space collapses, and blocks ask for line breaks before what follows."""

    def __init__(self):
        self.parts, self.breaks, self.space, self.indent, self.marker = [], 0, False, "", ""

    def rest(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def say(self, raw: str, pre: bool = False) -> None:
        words = raw if pre else " ".join(raw.split())
        if not words:
            self.space |= bool(raw)
            return
        if self.breaks or not self.parts:
            self.parts.append(("\n" * self.breaks if self.parts else "") + self.indent[: len(self.indent) - len(self.marker)] + self.marker)
            self.marker = ""
        elif self.space or not pre and raw[0].isspace():
            self.parts.append(" ")
        self.parts.append(words.replace("\n", "\n" + self.indent) if pre else words)
        self.breaks, self.space = 0, not pre and raw[-1].isspace()

    def text(self) -> str:
        return "".join(self.parts)


Cell = tuple[str, int, int]  # text, columns and rows that it spans


def _placed(rows: list[list[Cell]]) -> list[list[tuple[int, int, str]]]:
    """(column, columns, text) of each row's own cells; cells that reach down from rows above
    keep their columns. Columns in which no cell begins are left out."""
    out, down = [], {}  # down: of a column that is taken from above, the first row and the next column that aren't
    for r, row in enumerate(rows):
        column, own = 0, []
        for text, columns, deep in row:
            while (taken := down.get(column, (0, 0)))[0] > r:
                column = taken[1]
            own.append((column, columns, text))
            if deep > 1:
                down |= dict.fromkeys(range(column, column + columns), (r + deep, column + columns))
            column += columns
        out.append(own)
    begins = sorted({k for own in out for k, _, _ in own})
    place = lambda k: bisect_left(begins, k)
    return [[(place(k), max(1, place(k + n) - place(k)), text) for k, n, text in own] for own in out]


def _grid(rows: list[list[Cell]]) -> str:
    """Cells in columns as wide as their widest line, two spaces apart. A cell over several
    columns widens the last of them if it has to; one over several rows stands in the first."""
    split = [[(k, n, text.split("\n")) for k, n, text in own] for own in _placed(rows)]
    width = [0] * max((k + n for own in split for k, n, _ in own), default=0)
    for most in (False, True):
        for own in split:
            for k, n, lines in own:
                if (n > 1) == most:
                    width[k + n - 1] = max(width[k + n - 1], max(map(len, lines)) - (sum(width[k : k + n - 1]) + 2 * (n - 1)))
    begin = [0]
    for w in width:
        begin.append(begin[-1] + w + 2)
    out = []
    for own in split:
        for i in range(max((len(lines) for _, _, lines in own), default=0)):
            line, n = [], 0
            for k, _, lines in own:
                if i < len(lines) and lines[i]:
                    line += [" " * (begin[k] - n), lines[i]]
                    n = begin[k] + len(lines[i])
            out.append("".join(line).rstrip())
    return "\n".join(out)


def render(html: str | None) -> str:
    """All visible text of the page; the walk keeps its own stack, so depth is no limit."""
    page = Page()
    pages: list[Page] = []  # of the tables around, with their rows
    grids: list[list[list[Cell]]] = []
    lists: list[list] = []  # [marker number or None] of the lists around
    pre = flat = 0
    walk: list[tuple[object, bool, bool]] = [(build(html or ""), True, True)]
    while walk:
        node, enter, drawn = walk.pop()
        if isinstance(node, str):
            if drawn:
                page.say(node, bool(pre))
            continue
        tag = node.tag
        if enter:
            if not node.present():
                continue
            drawn = node.shown(drawn)
            if tag == "table" and len(grids) >= MOST_TABLES:
                node.tag = tag = FLAT
            walk.append((node, False, drawn))
            held = node.children
            if tag == "details" and node.get("open") is None:  # closed: only its summary is seen
                held = [x for x in held if isinstance(x, Node) and x.tag == "summary"][:1]
            walk += [(x, True, drawn) for x in reversed(held)]
            page.space |= tag in CONTROLS
            if tag == "br":
                page.breaks, page.space = page.breaks + 1 if page.parts else 0, False
            elif tag in BLOCK or tag == FLAT or node.foreign and tag == "text":
                page.rest(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 1)
            if tag in ("ul", "ol", "menu"):
                start = node.get("start") or "" if tag == "ol" else None
                lists.append([None if start is None else int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                number = lists[-1][0] if lists else None
                mark = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1][0] += 1
                page.indent, page.marker = page.indent + " " * len(mark), mark
                lists.append([len(mark)])
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                pages.append(page)
                page = Page()
                grids.append([])
            elif tag == FLAT:
                flat += 1
            elif grids and tag == "tr" and not flat:
                grids[-1].append([])
            elif grids and tag in CELLS and not flat:
                if not grids[-1]:
                    grids[-1].append([])
                pages.append(page)
                page = Page()
        else:
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "li":
                size = lists.pop()[0]
                page.indent, page.marker = page.indent[: len(page.indent) - size], ""
            elif tag == "pre":
                pre -= 1
            elif tag == "table":
                outside, grid = page, _grid(grids.pop())
                page = pages.pop()
                for part in (outside.text(), grid):
                    if part:
                        page.rest(2 if not outside.parts or part is not grid else 1)
                        page.say(part, True)
            elif tag == FLAT:
                flat -= 1
            elif grids and tag in CELLS and not flat:
                cell, page = page, pages.pop()
                grids[-1][-1].append((cell.text().strip("\n"), node.span("colspan", MOST_COLUMNS), node.span("rowspan", MOST_ROWS)))
            if tag in BLOCK or tag == FLAT or node.foreign and tag == "text":
                page.rest(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 1)
            page.space |= tag in CONTROLS
    return page.text()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [render(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id long, url string, html string).

    A null or empty html, and one without visible text, gives an empty text. Null ids and
    urls stay null, repeated rows give repeated rows, no rows give no rows, and other
    columns are ignored. Broken markup never fails: what can't be a tag is text.
    """
    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(_texts, "page_id long, url string, text string")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
