"""Visible text of web pages as it is laid out: blocks, lists and aligned tables from a tree with implied tags."""
from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.shared import small_batches

#: Element sets of the HTML standard that decide structure, visibility and spacing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
HIDDEN = frozenset("script style title noscript iframe noembed noframes template head datalist audio video canvas object svg math".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header html legend li main nav option optgroup search section summary tr caption".split())
CLOSES_P = (SPACED | BLOCK) - frozenset("option optgroup legend body html tr caption".split())
#: An opening tag ends the open ones it names, up to the first of the second set.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{x: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")}}
TABLE_PARTS = frozenset("table thead tbody tfoot tr colgroup".split())
SCOPES = frozenset("table td th caption html".split())

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>)""", re.S)
#: Searched in the page itself: lower() may change a text's length. Letters outside ASCII are no letters of a tag.
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_BLANKS = re.compile(r"[ \t\n\f\r]+")
#: Cells are padded up to this width; a wider one does not stretch its column, so a table's text stays linear in its page.
PAD = 60


class Node:
    __slots__ = ("tag", "attributes", "kids")

    def __init__(self, tag, attributes=None):
        self.tag, self.attributes, self.kids = tag, attributes or {}, []


def attributes(source: str) -> dict:
    out: dict = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def tree(page: str) -> Node:
    """The page's elements, with end tags and table rows put in where the page leaves them out."""
    root = Node("html")
    open_, at = [root], 0

    def end(tags, until):
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in until:
                return
            if open_[i].tag in tags:
                del open_[i:]
                if not any(x.tag in tags for x in open_[1:]) or len(tags) == 1:
                    return
                return end(tags, until)

    last = page.rfind(">") + 1  # no tag ends behind it, so nothing is searched there
    for m in iter(lambda: _TOKEN.search(page, at, last), None):
        if m.start() > at:
            open_[-1].kids.append(unescape(page[at: m.start()]) if "&" in page[at: m.start()] else page[at: m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, rest = name.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            if tag == "br":
                open_[-1].kids.append(Node("br"))
            elif tag == "p" and not any(x.tag == "p" for x in open_):
                open_[-1].kids.append(Node("p"))
            else:
                barrier = SCOPES - {tag} if tag not in TABLE_PARTS else {"html"} | ({"table"} - {tag})
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag == tag:
                        del open_[i:]
                        break
                    if open_[i].tag in barrier:
                        break
            continue
        if tag in ("html", "body"):
            continue
        if tag in IMPLIED_END:
            end(*IMPLIED_END[tag])
        if tag in CLOSES_P:
            end({"p"}, SCOPES)
        if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            open_[-1].kids.append(row)
            open_.append(row)
        node = Node(tag, attributes(rest) if rest and not rest.isspace() else None)
        open_[-1].kids.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            close = found.start() if found else -1
            inner = page[at:] if close < 0 else page[at:close]
            if tag == "textarea":
                node.kids.append(unescape(inner))
            upto = page.find(">", close) if close >= 0 else -1
            at = len(page) if upto < 0 else upto + 1
        elif tag not in VOID and not (rest.endswith("/") and tag in ("svg", "math")):
            open_.append(node)
    rest = page[at:].split("<!--")[0] if at >= last else page[at:last] + page[last:].split("<!--")[0]
    if rest:
        open_[-1].kids.append(unescape(rest))
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return False
    return not a or not ("hidden" in a or (node.tag == "input") or ("style" in a and _UNSEEN.search(a["style"])))


class Writer:
    """Text under construction: breaks and blanks are due until text follows, so none stand at the ends or in excess."""

    def __init__(self):
        self.parts, self.breaks, self.blank, self.indent, self.marker = [], 0, False, 0, ""

    def line(self, n=1):
        self.breaks, self.blank = max(self.breaks, n), False

    def add(self, text, kept=False):
        if not kept:
            lead, trail = text[:1] in " \t\n\f\r", text[-1:] in " \t\n\f\r"
            text = _BLANKS.sub(" ", text).strip(" ")
            if not text:
                self.blank = self.blank or lead
                return
            self.blank = self.blank or lead
        if self.breaks or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.breaks)
            lead_in = " " * max(0, self.indent - len(self.marker)) + self.marker
            if lead_in:
                self.parts.append(lead_in)
            self.marker = ""
        elif self.blank:
            self.parts.append(" ")
        self.breaks, self.blank = 0, False
        self.parts.append(text.replace("\n", "\n" + " " * self.indent) if kept and self.indent else text)
        if not kept:
            self.blank = trail

    def text(self):
        return "".join(self.parts)


class Grid:
    """Cells of a table by row and column; spans take their places as empty cells."""

    def __init__(self):
        self.rows, self.caption, self.taken = [], [], {}

    def row(self):
        self.rows.append([])

    def cell(self, text, wide, high):
        if not self.rows:
            self.row()
        at, row = len(self.rows) - 1, self.rows[-1]
        while self.taken.get(len(row), 0) > at:
            row.append("")
        for i in range(wide):
            if high > 1:
                self.taken[len(row)] = at + high
            row.append(text if i == 0 else "")

    def text(self):
        rows = [[c.split("\n") for c in r] for r in self.rows if any(r)]
        widths: dict = {}
        for r in rows:
            for i, c in enumerate(r):
                fits = [len(x) for x in c if len(x) <= PAD]
                widths[i] = max(widths.get(i, 0), *fits) if fits else widths.get(i, 0)
        lines = [t for t in self.caption if t]
        for r in rows:
            for k in range(max(map(len, r))):
                lines.append(" | ".join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(r)).rstrip())
        return "\n".join(lines)


def _number(text, least, most, default):
    try:
        return min(most, max(least, int(text)))
    except (TypeError, ValueError):
        return default


def render(page: str | None) -> str | None:
    """All visible text of a page: blocks on lines of their own, blank lines around paragraphs, headings, lists and tables,
    list items with their marks and indentation, table cells in aligned columns, preformatted text as it stands."""
    if page is None:
        return None
    writers, grids, lists, pre = [Writer()], [], [], 0
    todo = [(tree(page), False)]
    while todo:
        node, leaving = todo.pop()
        out = writers[-1]
        if isinstance(node, str):
            if pre:
                body = node.strip("\n")
                if node.startswith("\n"):
                    out.line()
                if body:
                    out.add(body, kept=True)
                if node.endswith("\n"):
                    out.line()
            else:
                out.add(node)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            if tag == "br":
                out.breaks, out.blank = (out.breaks + 1 if out.breaks else 1), False
                continue
            if tag in BLOCK and tag not in ("tr", "caption"):
                out.line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", _number(node.attributes.get("start"), -10**9, 10**9, 1)])
                out.indent += 2 if not lists[-1][0] else 3
            elif tag == "li" and lists:
                kind = lists[-1]
                if kind[0]:
                    kind[1] = _number(node.attributes.get("value"), -10**9, 10**9, kind[1])
                out.marker = f"{kind[1]}. " if kind[0] else "- "
                kind[1] += 1
            elif tag == "dd":
                out.indent += 2
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                grids.append(Grid())
            elif tag == "tr" and grids:
                grids[-1].row()
            elif tag in ("td", "th", "caption") and grids:
                writers.append(Writer())
            todo.append((node, True))
            kids = node.kids
            if tag == "pre" and kids and isinstance(kids[0], str):
                kids = [kids[0].removeprefix("\n"), *kids[1:]]
            if tag == "details" and "open" not in node.attributes:
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"]
            todo += [(k, False) for k in reversed(kids)]
            continue
        if tag in ("td", "th", "caption") and grids:
            text = writers.pop().text()
            if tag == "caption":
                grids[-1].caption.append(text)
            else:
                grids[-1].cell(text, _number(node.attributes.get("colspan"), 1, 1000, 1), _number(node.attributes.get("rowspan"), 1, 65534, 1))
            continue
        if tag == "table":
            text = grids.pop().text()
            if text:
                out.line(2)
                out.add(text, kept=True)
        elif tag in ("ul", "ol", "menu"):
            out.indent -= 3 if lists.pop()[0] else 2
        elif tag == "li":
            out.marker = ""
        elif tag == "dd":
            out.indent -= 2
        elif tag == "pre":
            pre -= 1
        if tag in BLOCK and tag not in ("tr", "caption"):
            out.line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
    return writers[0].text()


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text in place of ``column``: what a reader sees of each whole page (see ``render``).

    Each page is a row of its own, so nothing is shuffled. Null gives null, an empty page and one without visible text
    the empty string; markup that breaks off ends where it breaks off. Rows that repeat are rendered alike; extra columns
    stay; a column named text is replaced.
    """
    small_batches(pages.sparkSession)
    keep = [f for f in pages.schema.fields if f.name not in (column, "text")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [render(x) for x in batch.column("_page").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*[f.name for f in keep], F.col(column).cast("string").alias("_page")).mapInArrow(run, schema)
