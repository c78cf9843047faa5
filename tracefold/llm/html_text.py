"""HTML extraction: tree builder with implied tags, visibility rules, layout-aware text.

The tokenizer knows comments, declarations, raw-text elements and quoted attributes.  The
tree builder closes what HTML lets authors leave open (p, li, dt/dd, table parts, options),
opens a missing row or list item parent only as far as layout needs it, and ignores stray end
tags.  Text is rendered as it would be seen: blocks on lines of their own, a blank line
around paragraphs, headings, lists and tables, list markers with indentation, ``pre`` kept,
table cells padded to aligned columns.  A cell keeps its own blocks and lists as lines; lines of
more than ``WIDE`` characters do not widen their column, so padding is bounded.  Hidden: head,
script, style, template, noscript, embedded documents and media, inputs, ``hidden``,
``display:none``, ``visibility:hidden``.  A head without end tag ends at the first text or element
that cannot stand in it.

Defined cases: null html gives null text, empty html an empty text; malformed mark-up never
fails: an unfinished tag is text.  Depth is not limited by recursion (explicit stacks).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer main nav form address li dt dd tr caption figcaption details summary "
    "center dir menu hr legend tbody thead tfoot hgroup search option optgroup".split()
)
#: An opening tag closes these open elements, up to a boundary.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), "thead": ("caption", "tbody", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
BOUNDARY = {
    "li": frozenset(("ul", "ol", "menu", "dir", "table")), "dt": frozenset(("dl", "table")), "dd": frozenset(("dl", "table")),
    "option": frozenset(("select", "datalist")), "optgroup": frozenset(("select",)),
}
#: Cells of longer lines do not widen their column.
WIDE = 80
TABLE_EDGE = frozenset(("table",))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>"
    # Quotes only count where a value starts; elsewhere they are letters.
    r"|<(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+)|[^>=])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    root = Node("#root")
    stack = [root]

    def close(tags, boundary) -> None:
        """Close open elements of ``tags`` (and what they hold) above the nearest boundary."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in boundary:
                return
            if stack[i].tag in tags:
                lowest = i
                while lowest > 1 and stack[lowest - 1].tag in tags:
                    lowest -= 1
                del stack[lowest:]
                return

    at = 0
    while True:
        found = TOKEN.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            if stack[-1].tag == "head" and text.strip():
                stack.pop()
            stack[-1].children.append(html.unescape(text))
        if not found:
            return root
        at = found.end()
        if found["end"]:
            name = found["end"].lower()
            if name == "br":
                stack[-1].children.append(Node("br"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
        elif found["tag"]:
            name = found["tag"].lower()
            if name in CLOSES:
                close(CLOSES[name], BOUNDARY.get(name, TABLE_EDGE))
            if name in BLOCK:
                close(("p",), frozenset(("table", "td", "th", "li", "dd", "button", "body", "object")))
            if stack[-1].tag == "head" and name not in HEAD:
                stack.pop()
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
            node = Node(name, found["attrs"])
            stack[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                raw = source[at : end.start() if end else len(source)]
                node.children.append(html.unescape(raw) if name in ("textarea", "title") else raw)
                closing = source.find(">", end.start()) if end else -1
                at = closing + 1 if closing >= 0 else len(source)
            elif name not in VOID and not found["attrs"].endswith("/") or name in BLOCK - {"hr"}:
                stack.append(node)


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attrs)}


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or node.tag == "title":
        return False
    if not node.attrs:
        return True
    found = attributes(node)
    return not ("hidden" in found or UNSEEN.search(found.get("style", "")) or (node.tag == "input"))


class Page:
    """Lines of text with collapsed spaces and margins."""

    def __init__(self):
        self.lines: list[str] = []
        self.current = ""
        self.space = False
        self.margin = False
        self.indent: list[str] = []
        self.marker: str | None = None

    def write(self, text: str) -> None:
        words = SPACES.split(text)
        if len(words) == 1 and not words[0]:
            return
        if words[0] == "" and self.current:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            if self.space and self.current:
                self.current += " "
            self.current += body
            self.space = False
        if words[-1] == "" and self.current:
            self.space = True

    def put(self, line: str) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        lead = "".join(self.indent)
        if self.marker is not None:
            lead = lead[: max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = None
        self.lines.append((lead + line).rstrip())

    def end(self) -> None:
        if self.current:
            self.put(self.current)
        self.current, self.space = "", False

    def gap(self) -> None:
        self.end()
        self.margin = True


def render(root: Node) -> str:
    page = Page()
    pages: list[Page] = []  # pages around a cell
    tables: list[dict] = []
    lists: list[int | None] = []
    pre = 0
    work: list[tuple[bool, Node | str]] = [(True, root)]
    while work:
        opening, node = work.pop()
        if isinstance(node, str):
            if not pre:
                page.write(node)
            else:
                *full, rest = node.replace("\r\n", "\n").split("\n")
                for line in full:
                    page.put(page.current + line)
                    page.current = ""
                page.current += rest
            continue
        tag = node.tag
        if opening:
            if not visible(node):
                continue
            if tag == "br":
                page.put(page.current) if page.current or page.lines and not page.margin else None
                page.current, page.space = "", False
                continue
            if tag == "hr":
                page.gap()
                page.put("---")
                page.margin = True
                continue
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                page.gap()
            elif tag in BLOCK:
                page.end()
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(1 if tag == "ol" else None)
            elif tag == "li":
                count = lists[-1] if lists else None
                if count is not None:
                    lists[-1] = count + 1
                page.marker = "- " if count is None else f"{count}. "
                page.indent.append(" " * len(page.marker))
            elif tag in ("blockquote", "dd"):
                page.indent.append("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append({"rows": [], "caption": None})
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th", "caption") and tables:
                pages.append(page)
                page = Page()
            work.append((False, node))
            work.extend((True, child) for child in reversed(node.children))
            continue
        if tag in ("td", "th", "caption") and tables:
            page.end()
            cell = page.lines
            page = pages.pop()
            if tag == "caption":
                tables[-1]["caption"] = " ".join(line.strip() for line in cell if line.strip())
            else:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                span = attributes(node).get("colspan", "1") if node.attrs else "1"
                wide = max(1, min(int(span), 1000)) if re.fullmatch("[0-9]{1,6}", span) else 1
                tables[-1]["rows"][-1] += [cell, *[[]] * (wide - 1)]
            continue
        if tag == "table" and tables:
            page.end()
            done = tables.pop()
            rows = [r for r in done["rows"] if any(r)]
            if done["caption"]:
                page.put(done["caption"])
            widths = [0] * max(map(len, rows), default=0)
            for row in rows:
                for c, cell in enumerate(row):
                    widths[c] = max(widths[c], *(len(line) for line in cell if len(line) <= WIDE), 0)
            for row in rows:
                for n in range(max(map(len, row))):
                    page.put("  ".join((cell[n] if n < len(cell) else "").ljust(widths[c]) for c, cell in enumerate(row)))
        if tag == "pre":
            pre -= 1
        if tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1):
            page.gap()
        elif tag in BLOCK:
            page.end()
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            page.indent.pop()
            page.marker = None
        elif tag in ("blockquote", "dd"):
            page.indent.pop()
    page.end()
    return "\n".join(page.lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines; one row per page, in the task that scanned it."""
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [None if x is None else render(parse(x)) for x in part.column(1).to_pylist()]
                lines = [0 if not t else t.count("\n") + 1 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"]
                )

    return base.mapInArrow(run, "page_id long, text string, n_lines long")
