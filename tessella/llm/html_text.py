"""Layout-aware text of HTML pages.

A tolerant tokeniser feeds a tree builder that supplies implied tags (a block closes an open paragraph; list items,
definition terms, options, rows, cells and row groups close their like; an end tag closes what is open inside its
element and is ignored without one). The tree is then laid out: white space collapses inside inline text, blocks
start lines, paragraphs and the like are set off by an empty line, list items carry a bullet or their number and are
indented by depth, table rows are lines whose cells are padded to common column widths, preformatted text stays as
it is. Everything that a browser would show as text is emitted; scripts, styles, templates, comments, metadata (of
formulas and drawings too), media, the fallback of objects and elements hidden by attribute, inline style or the
page's own style rules are not. A style rule counts if its selector is a tag, classes and an id without combinators, and
it stands outside of @-rules; among such rules the last one wins, inline styles over all. ``visibility`` is inherited
and can be undone by a descendant, ``display: none`` can't. Formulas (math) and drawings (svg) are inline text in
document order. Blocks inside a table cell are joined by spaces; cells are placed on a grid, so a ``rowspan`` keeps its
columns in the rows below.

Parsing and layout use explicit stacks, tables are laid out from the innermost on, and a look for an open element costs
nothing where none is open: depth is bounded by memory alone. The extraction of a page touches only that page: the plan
is one narrow Arrow stage.

Defined results: null and empty pages give empty text; unclosed tags, quotes and comments are closed by the end of
the page; character references beyond Unicode are U+FFFD and spans are 100 columns or 1,000 rows at most; repeated rows
are extracted each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<other>[!?])[^>]*>?|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?<![-\w])display\s*:\s*([-\w]+)", re.I)
_VISIBILITY = re.compile(r"(?<![-\w])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9]*)?((?:[.#][-\w]+)*)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_HUGE_REFERENCE = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*));?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INVISIBLE = frozenset("head script style template title meta link noscript iframe object noembed noframes datalist audio video canvas".split())
#: Inside svg and math: what is never painted.
UNPAINTED = frozenset("title desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript head html".split())
BLOCK = frozenset("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav optgroup option search section summary table tbody thead tfoot tr td th caption ul ol p pre blockquote h1 h2 h3 h4 h5 h6 listing xmp".split())
SPACED = frozenset("p pre blockquote ul ol dl table h1 h2 h3 h4 h5 h6 figure fieldset menu dir listing xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul listing xmp li dd dt summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: start tag -> (open elements that it closes, elements beyond which it does not look)
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset("dl table".split())),
    "dd": (frozenset({"dt", "dd"}), frozenset("dl table".split())),
    "option": (frozenset({"option"}), frozenset("select datalist table".split())),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset("select table".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("table".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset("table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset("table".split())),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset("table".split())),
    "a": (frozenset({"a"}), frozenset("table td th".split())),
}
#: An end tag does not reach out of these.
SCOPES = frozenset("table td th caption template html".split())
WIDEST = 40  # columns are padded to this at most, so one long cell does not blow up all rows


class Node:
    """``hidden``: takes no place; ``shown``: its own visibility, None if inherited."""

    __slots__ = ("tag", "children", "attrs", "hidden", "shown", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False):
        self.foreign = foreign or tag in ("svg", "math")
        self.tag, self.attrs, self.children, self.shown = tag, attrs, [], None
        self.hidden = tag in INVISIBLE or foreign and tag in UNPAINTED or tag == "input" or "hidden" in attrs
        if "style" in attrs:
            self.style(attrs["style"])

    def style(self, declarations: str) -> None:
        display, visibility = _DISPLAY.findall(declarations), _VISIBILITY.findall(declarations)
        if display and self.tag not in INVISIBLE:
            self.hidden = display[-1].lower() == "none" or self.tag == "input"
        if visibility:
            self.shown = visibility[-1].lower() == "visible"


def unescape(text: str) -> str:
    """Character references resolved; a number of any length is legal here."""
    if "&#" in text:
        text = _HUGE_REFERENCE.sub(lambda m: "\ufffd" if len(m[1] or m[2] or "") > 7 else m[0] if len(m[0]) < 20 else f"&#{'x' if m[1] else ''}{m[1] or m[2] or '0'};", text)
    return html.unescape(text) if "&" in text else text


def _number(text: str, least: int, most: int) -> int:
    """A number of an attribute within limits; the least if it is none."""
    digits = text.strip().lstrip("0")
    return max(least, min(int(digits[:9]), most)) if digits.isascii() and digits.isdigit() else least


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t") else {}


def style_rules(sheet: str) -> list[tuple[str, frozenset[str], str]]:
    """(tag or "", classes and ids with their marks, declarations) of rules that set display or visibility, in order."""
    out, depth, at, plain = [], 0, 0, []
    sheet = _COMMENT.sub(" ", sheet)
    for m in re.finditer(r"@[^{};]*[{;]|[{}]", sheet):  # cut @-rules with all that they hold
        mark = m[0][-1]
        if depth == 0 and m[0][0] == "@":
            plain.append(sheet[at : m.start()])
            depth, at = (2, at) if mark == "{" else (0, m.end())
        elif depth > 1:
            depth += {"{": 1, "}": -1}.get(mark, 0)
            if depth == 1:
                depth, at = 0, m.end()
    plain.append(sheet[at:] if depth == 0 else "")
    for selectors, declarations in _RULE.findall("".join(plain)):
        if _DISPLAY.search(declarations) or _VISIBILITY.search(declarations):
            for selector in selectors.split(","):
                m = _SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    out.append(((m[1] or "").lower().strip("*"), frozenset(re.findall(r"[.#][-\w]+", m[2])), declarations))
    return out


def apply_rules(root: Node, rules: list[tuple[str, frozenset[str], str]]) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        todo.extend(c for c in node.children if isinstance(c, Node))
        marks = {"." + c for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if "id" in node.attrs else set())
        own = [d for tag, need, d in rules if (not tag or tag == node.tag) and need <= marks]
        for declarations in [*own, node.attrs.get("style", "")] if own else ():
            node.style(declarations)


class TreeBuilder:
    """Open elements and the root. ``body`` starts with the first content that does not belong in a head."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.stack = [self.root]
        self.open: Counter[str] = Counter()  # tags on the stack, the root's aside
        self.sheets: list[str] = []

    def _close(self, at: int) -> None:
        """Close all elements from a place of the stack on."""
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def _pop_to(self, tags: frozenset[str], scopes: frozenset[str]) -> bool:
        """Close everything up to the outermost element with one of the tags before a scope."""
        found, left = None, sum(self.open[t] for t in tags)
        if not left:
            return False
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                found, left = at, left - 1
                if not left:
                    break
            elif tag in scopes:
                break
        if found is None:
            return False
        self._close(found)
        return True

    def _leave_head(self, tag: str) -> None:
        if tag not in HEAD_ONLY and self.open["head"]:
            self._close(next(at for at in range(1, len(self.stack)) if self.stack[at].tag == "head"))

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body"):
            self._leave_head("body") if tag == "body" else None
            if tag == "body" and attrs:
                body = Node(tag, attrs)
                self.root.attrs |= attrs
                self.root.hidden |= body.hidden
                self.root.shown = self.root.shown if body.shown is None else body.shown
            return
        self._leave_head(tag)
        if tag in CLOSES_P:
            self._pop_to(frozenset({"p"}), SCOPES | {"button", "object"})
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._close(len(self.stack) - 1)
        if tag in IMPLIED:
            closes, beyond = IMPLIED[tag]
            self._pop_to(closes, beyond | {"template"})
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._open("tr", {})
        self._open(tag, attrs)
        if tag in VOID or closed and self.stack[-1].foreign:
            self._close(len(self.stack) - 1)

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.stack[-1]
        node = Node(tag, attrs, parent.foreign and parent.tag != "foreignobject")
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
            return
        if not self.open[tag]:
            return
        scopes = frozenset() if tag in ("table", "html", "body") else SCOPES - {tag} if tag not in ("tr", "tbody", "thead", "tfoot") else frozenset({"table"})
        for at in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[at].tag
            if open_tag == tag:
                self._close(at)
                return
            if open_tag in scopes:
                return

    def text(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self._leave_head("#text")
        self.stack[-1].children.append(data)


def parse(page: str) -> Node:
    """The tree of a page."""
    builder, at, n = TreeBuilder(), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            builder.text(unescape(page[at:]))
            break
        if m.start() > at:
            builder.text(unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        tag = name.lower()
        if m["end"]:
            builder.end(tag)
            continue
        builder.start(tag, _attributes(m["attrs"]), m["attrs"].endswith("/"))
        if tag in ("pre", "listing", "textarea") and page.startswith("\n", at):
            at += 1  # a line end right after the tag is no text
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            raw = page[at : close.start() if close else n]
            if tag in ("textarea", "title"):
                raw = unescape(raw)
            if tag == "style":
                builder.sheets.append(raw)
            builder.text(raw)
            builder.end(tag)
            at = close.end() if close else n
    rules = style_rules("".join(builder.sheets)) if builder.sheets else []
    if rules:
        apply_rules(builder.root, rules)
    return builder.root


class Lines:
    """Lines under construction: inline text collapses, blocks ask for a break of one or two line ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space = False  # white space waits for text on both sides
        self.gap = 0  # empty lines that are due before the next text
        self.prefix, self.indent = "", ""

    def inline(self, data: str) -> None:
        parts = _SPACES.sub(" ", data)
        if not parts:
            return
        body = parts.strip(" ")
        if parts[0] == " ":
            self.space = bool(self.current)
        if body:
            self._word((" " if self.space and self.current else "") + body)
            self.space = parts[-1] == " "

    def _word(self, text: str) -> None:
        if not self.current:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.current.append(self.indent + self.prefix)
            self.indent, self.prefix = self.indent + " " * len(self.prefix), ""
        self.current.append(text)

    def brk(self, gap: int = 0) -> None:
        if self.current:
            self.lines.append("".join(self.current).rstrip(" "))
            self.current = []
            self.gap = 0
        self.space = False
        self.gap = max(self.gap, gap)

    def verbatim(self, data: str) -> None:
        for k, line in enumerate(data.split("\n")):
            if k:
                if not self.current:
                    self._word("")
                self.brk()
            if line:
                self._word(line)

    def result(self) -> str:
        self.brk()
        return "\n".join(self.lines)


def _inside(children: list[Node | str]) -> Node:
    out = Node("div", {})
    out.children = children
    return out


class Cell(NamedTuple):
    text: str
    column: int
    columns: int


class Table:
    """Rows of a table under construction: cells are placed on a grid, in which those of earlier rows may reach down."""

    def __init__(self, done: dict[int, tuple[list[str], list]]):
        self.done, self.rows, self.stray = done, [], []  # done: lines of the tables inside
        self.down: dict[int, int] = {}  # rows that a column is still taken for

    def row(self, row: Node, shown: bool) -> None:
        shown = shown if row.shown is None else row.shown
        cells, at, reach = [], 0, {}
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip(" \t\n\r\f"):
                    self.stray.append((cell, shown))
            elif cell.tag not in ("td", "th"):
                self.stray.append((cell, shown))
            elif not cell.hidden:
                while self.down.get(at, 0):
                    at += 1
                columns, rows = _number(cell.attrs.get("colspan", ""), 1, 100), _number(cell.attrs.get("rowspan", ""), 1, 1000)
                inner = render(_inside(cell.children), shown if cell.shown is None else cell.shown, self.done)
                cells.append(Cell(" ".join(inner.split("\n")).replace("  ", " ").strip(), at, columns))
                reach |= {c: rows for c in range(at, at + columns) if rows > 1}
                at += columns
        self.down = {c: n - 1 for c, n in (self.down | reach).items() if n > 1}
        self.rows.append(cells)

    def lines(self) -> list[str]:
        width: list[int] = []
        for row in self.rows:
            for cell in row:
                width.extend([0] * (cell.column + cell.columns - len(width)))
                if cell.columns == 1:
                    width[cell.column] = max(width[cell.column], min(len(cell.text), WIDEST))
        out = []
        for row in self.rows:
            if any(cell.text for cell in row):
                line, at = [], 0
                for cell in row:
                    line += [" " * w for w in width[at : cell.column]]
                    at = cell.column + cell.columns
                    line.append(cell.text.ljust(sum(width[cell.column : at]) + 2 * (cell.columns - 1)))
                out.append("  ".join(line).rstrip(" "))
        return out


def _lay_out(table: Node, shown: bool, done: dict[int, tuple[list[str], list]]) -> tuple[list[str], list]:
    """Aligned rows, and what stands in the table outside of rows, with its visibility."""
    out = Table(done)
    todo = [(c, shown) for c in reversed(table.children)]
    while todo:
        x, shown = todo.pop()
        if isinstance(x, str):
            if x.strip(" \t\n\r\f"):
                out.stray.append((x, shown))
        elif x.hidden or x.tag in ("colgroup", "col"):
            continue
        elif x.tag == "tr":
            out.row(x, shown)
        elif x.tag in ("tbody", "thead", "tfoot"):
            out.down = {}
            todo.extend((c, shown if x.shown is None else x.shown) for c in reversed(x.children))
        else:
            out.stray.append((x, shown))
    return out.lines(), out.stray


def tables_of(root: Node) -> list[tuple[Node, bool]]:
    """All tables that take a place, with their visibility, inner ones first."""
    out, todo = [], [(root, True)]
    while todo:
        x, shown = todo.pop()
        if not x.hidden:
            shown = shown if x.shown is None else x.shown
            if x.tag == "table":
                out.append((x, shown))
            todo.extend((c, shown) for c in x.children if isinstance(c, Node))
    return out[::-1]


def render(root: Node, shown: bool = True, done: dict[int, tuple[list[str], list]] | None = None) -> str:
    """The visible text of a tree whose tables are laid out already."""
    out, done = Lines(), done or {}
    # What is to do: enter a node or text, or leave a node; lists carry their kind, depth and counter.
    todo: list = [("in", root, shown)]
    lists: list[list] = []
    indents: list[str] = []
    pre = 0
    while todo:
        what, x, shown = todo.pop()
        if what == "out":
            tag = x.tag
            if x.foreign and tag == "text":
                out.inline(" ")
            if tag in ("pre", "listing", "xmp", "textarea"):
                pre -= 1
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            if tag in BLOCK:
                out.brk(1 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir", "p")) else 0)
            if tag in ("li", "dd", "blockquote"):
                out.indent, out.prefix = indents.pop(), ""
            continue
        if isinstance(x, str):
            if shown:
                out.verbatim(x) if pre else out.inline(x)
            continue
        if x.hidden:
            continue
        shown = shown if x.shown is None else x.shown
        tag = x.tag
        if x.foreign and tag == "text":  # each stands in a place of its own
            out.inline(" ")
        if tag == "br":
            if not out.current:
                out._word("")
            out.brk()
            continue
        if tag == "table":
            lines, stray = done[id(x)]
            out.brk(1)
            for s, seen in stray:  # a caption, or content that has no cell, stands before the rows
                text = render(_inside([s]), seen, done)
                for line in text.split("\n") if text else []:
                    out._word(line)
                    out.brk()
            for line in lines:
                out._word(line)
                out.brk()
            out.brk(1)
            continue
        if tag in BLOCK:
            out.brk(1 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir", "p")) else 0)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(x.attrs["start"], 0, 99_999_999) if x.attrs.get("start", "").isdigit() else 1])
        elif tag == "li":
            indents.append(out.indent)
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if shown:
                out.prefix = out.prefix + mark
        elif tag in ("dd", "blockquote"):
            indents.append(out.indent)
            out.indent += "  "
        elif tag in ("pre", "listing", "xmp", "textarea"):
            pre += 1
        todo.append(("out", x, shown))
        todo.extend(("in", c, shown) for c in reversed(x.children))
    return out.result()


def extract(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    root, done = parse(page), {}
    for table, shown in tables_of(root):
        done[id(table)] = _lay_out(table, shown, done)
    return render(root, done=done)


SCHEMA = "page_id bigint, text string, n_chars bigint, n_lines bigint, text_sha256 string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(1)]
        texts = [t.encode("utf-8", "replace").decode() for t in texts]  # numeric references may name lone surrogates
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array((t.count("\n") + bool(t) for t in texts), pa.int64()), pa.array((hashlib.sha256(t.encode()).hexdigest() for t in texts), pa.string())], names=["page_id", "text", "n_chars", "n_lines", "text_sha256"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines, text_sha256 of every page."""
    from pyspark.sql import functions as F

    return pages.select(F.col("page_id").cast("bigint"), "html").mapInArrow(_run, SCHEMA)
