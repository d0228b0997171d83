"""Visible blocks, tables and filing indexes of HTML pages, a page at a time in Arrow batches.

A small tree is built with the standard library's parser: `p` closes at a new block, unclosed
tags close with their parent, and script, style and noscript are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

BLOCKS = ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "table")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CLOSES_P = (*BLOCKS, "article", "aside", "blockquote", "footer", "form", "header", "hr", "main", "nav", "ol", "pre", "section", "ul")
_SPACE = re.compile(T.PY_SPACE + "+")
#: A tag that can be read without the parser's rules for malformed ones, or else a mere `<`.
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)[ \t\n]*(/?)>)?""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)=(?:"([^"]*)"|'([^']*)')""")
#: Starts of what is no plain tag, or of tags whose content is no markup.
_RAW = re.compile("<(?:[!?]|/?(?:script|style|noscript|textarea|title|xmp|iframe|noembed|noframes|plaintext))", re.I)
#: About so many bytes of pages are parsed before their rows are sent on.
AT_ONCE = 1 << 20


class Node:
    def __init__(self, tag, parent, attrs=()):
        self.tag, self.parent, self.attrs, self.children = tag, parent, dict(attrs), []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def text(self, cells: bool) -> str:
        """All text below; with cells, a space after each table cell and row."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if cells and x.tag in ("td", "th", "tr"):
                stack.append(" ")
            stack.extend(reversed(x.children))
        return _SPACE.sub(" ", "".join(out)).strip(" ")


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.skip = 0
        self.plain = not _RAW.search(html) and self.read_plain(html)
        if not self.plain:
            self.feed(html)
            self.close()

    def read_plain(self, html: str) -> bool:
        """Read a page whose tags are all plain, as feed() does but faster; others are left to it."""
        tags = [(m.start(), m.end(), *m.groups()) for m in _TAG.finditer(html)]
        if any(name is None or (end and (attrs or single)) for _, _, end, name, attrs, single in tags):
            return False
        done = 0
        for a, b, end, name, attrs, single in tags:
            if done < a:
                self.handle_data(unescape(html[done:a]))
            done, name = b, name.lower()
            if end:
                self.handle_endtag(name)
                continue
            found = [(k.lower(), x or y) for k, x, y in _ATTRIBUTE.findall(attrs)] if attrs else []
            (self.handle_startendtag if single else self.handle_starttag)(name, found)
        if done < len(html):
            self.handle_data(unescape(html[done:]))
        return True

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += tag == "noscript"
            self.hidden = tag
            self.at = self._add(tag, attrs)
            return
        if tag in CLOSES_P:
            self._end_of("p", ("table", "td", "th", "button"))
        if tag in ("td", "th"):
            self._end_of(("td", "th"), ("table",))
        if tag == "tr":
            self._end_of(("tr",), ("table",))
        if tag == "li":
            self._end_of(("li",), ("ul", "ol"))
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.at = node

    def _add(self, tag, attrs):
        node = Node(tag, self.at, attrs)
        self.at.children.append(node)
        return node

    def _end_of(self, tags, stop):
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag == "table" and tag != "table" and tag not in ("body", "html", "div"):
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree(html)
    root = tree.root
    for node in [] if tree.plain else list(root.walk()):  # a plain page has no scripts
        node.children = [x for x in node.children if isinstance(x, str) or x.tag not in ("script", "style", "noscript")]
    return root


def _children_of(node):
    return [x for x in node.children if isinstance(x, Node)]


def blocks(html: str | Node) -> list[tuple[str, str, str | None]]:
    """(tag, text, anchor) of visible blocks in order, of a page or its tree.

    Every div without a block among its children, wherever it sits; and p, h1-h6 and tables that
    have no p, heading or table above them. Blocks without text are left out.
    """
    out = []
    root = parse(html) if isinstance(html, str) else html
    body = next((n for n in root.walk() if n.tag == "body"), root)
    for node in body.walk():
        if node is body or node.tag not in BLOCKS:
            continue
        if node.tag == "div":
            if any(c.tag in BLOCKS for c in _children_of(node)):
                continue
        else:
            up = node.parent
            while up is not None and (up.tag not in BLOCKS or up.tag == "div"):
                up = up.parent
            if up is not None:
                continue
        text = node.text(any(x.tag == "table" for x in node.walk()))
        if text:
            out.append((node.tag, text, next((x.attrs["id"] for x in node.walk() if x.attrs.get("id")), None)))
    return out


def _by_page(pages: DataFrame, id_col: str, html_col: str, columns: str, rows_of: Callable[[str], list[tuple]]) -> DataFrame:
    """(id, columns) of the rows that rows_of gives for each page; pages are parsed about AT_ONCE bytes at a time, so a large batch is never held as objects."""
    kinds = {"int": pa.int32(), "string": pa.string()}
    fields = [c.split() for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // AT_ONCE)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(size)], strict=True):
                part = batch.slice(a, b - a)
                rows = [(i, *r) for i, h in enumerate(part.column(1).to_pylist()) for r in rows_of(h or "")]
                own = part.column(0).take(pa.array([r[0] for r in rows], pa.int32()))
                yield pa.RecordBatch.from_arrays([own, *[pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields, 1)]], [id_col, *[n for n, _ in fields]])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def _tables(root: Node) -> list[tuple[int, str]]:
    return [(k, t) for k, t in enumerate(n.text(True) for n in root.walk() if n.tag == "table") if t]


def html_blocks(pages: DataFrame, id_col: str = "document_id", html_col: str = "html") -> DataFrame:
    """(id, pos, tag, text, anchor): visible blocks of each page; none for a null or empty page."""
    return _by_page(pages, id_col, html_col, "pos int, tag string, text string, anchor string", lambda html: [(k, *b) for k, b in enumerate(blocks(html))])


def page_parts(pages: DataFrame, id_col: str = "document_id", html_col: str = "html") -> DataFrame:
    """(id, kind, pos, tag, text, anchor): each page's blocks (kind `block`) and tables (kind `table`) from one parse; see html_blocks and extract_tables."""

    def parts(html):
        root = parse(html)
        return [("block", k, *b) for k, b in enumerate(blocks(root))] + [("table", k, "table", t, None) for k, t in _tables(root)]

    return _by_page(pages, id_col, html_col, "kind string, pos int, tag string, text string, anchor string", parts)


def extract_tables(pages: DataFrame, id_col: str = "document_id", html_col: str = "html") -> DataFrame:
    """(id, ord, text) of every table, nested ones too; numbered before empty ones are dropped."""
    return _by_page(pages, id_col, html_col, "ord int, text string", lambda html: _tables(parse(html)))


def filing_inventory(indexes: DataFrame, base_url: str = "", id_col: str = "document_id", html_col: str = "html", table_class: str = "tableFile") -> DataFrame:
    """(package, id, sequence, type, description, filename, source_url): rows of index tables of the class.

    A row needs four cells, a sequence number other than 0, and a link other than `#`.
    """

    def listed(html):
        rows = []
        for table in (n for n in parse(html).walk() if n.tag == "table" and table_class in (n.attrs.get("class") or "").split()):
            for tr in (n for n in table.walk() if n.tag == "tr"):
                td = [n for n in tr.walk() if n.tag == "td"]
                if len(td) < 4:
                    continue
                seq = td[0].text(False)
                link = next((n.attrs["href"] for n in td[2].walk() if n.tag == "a" and "href" in n.attrs), None) or td[2].text(False)
                if not re.fullmatch(r"\d+", seq) or not int(seq) or not link or link == "#":
                    continue
                rows.append((int(seq), td[3].text(False), td[1].text(False), link.split("/")[-1]))
        return rows

    rows = _by_page(indexes, id_col, html_col, "sequence int, type string, description string, filename string", listed)
    name = F.coalesce(F.nullif("type", F.lit("")), F.nullif("description", F.lit("")), "filename")
    return rows.select(id_col, F.concat_ws("-", "sequence", T.slugify(name)).alias("id"), "sequence", "type", "description", "filename", F.concat(F.lit(base_url), "filename").alias("source_url"))
