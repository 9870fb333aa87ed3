"""Web pages as text: headings with their surroundings, noise removal, main content; for static HTML.

Rendering is out of scope: what scripts would add is not seen, and line breaks are those of block elements.

Character references that lack their semicolon (`&amp` at the end of a text that was cut) are decoded as browsers do it,
or, with bare=False, left as they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from veridoc.functions.shipping import ship

# What is removed as noise, and where content is looked for, in this order.
NOISE_TAGS = frozenset(["nav", "header", "footer", "script", "style", "noscript", "iframe", "svg", "img", "button", "form"])
NOISE_CLASSES = ("cookie", "banner", "popup", "modal", "toast", "alert", "menu", "nav", "breadcrumb")
CONTENT = ("main", "article", ".content", "#content", ".microsite", "#microsite", "*content")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
HIDDEN = frozenset(["script", "style", "head", "noscript", "template", "title"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order; without recursion, as pages nest deeply."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        """What a reader sees: white space collapsed, blocks on lines of their own."""
        parts: list[str] = []
        todo: list[Node | str | None] = [self]
        while todo:
            item = todo.pop()
            if item is None:
                parts.append("\n")
            elif isinstance(item, str):
                parts.append(re.sub(r"\s+", " ", item))
            elif item.tag == "br":
                parts.append("\n")
            elif item.tag not in HIDDEN:
                block = [None] if item.tag in BLOCK else []
                todo += [*block, *reversed(item.children), *block]
        lines = (re.sub(" +", " ", x).strip() for x in "".join(parts).split("\n"))
        return "\n".join(x for x in lines if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.at.tag == "p" or tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _as_text(found: re.Match) -> str:
    """A character reference as it is, if it ends in a semicolon and is known; else with its ampersand escaped."""
    name = found[1]
    return found[0] if name and (name[0] == "#" or name in html5) else "&amp;" + (name or "")


def parse(html: str | None, bare: bool = True) -> Node:
    """The tree of a page. bare: references without a semicolon are decoded too."""
    builder = _Builder()
    builder.feed((html or "") if bare else re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?", _as_text, html or ""))
    builder.close()
    return builder.root


def headings(root: Node) -> list[dict]:
    """All headings in order: section (80 characters), text of the closest section or parent (500), selector."""
    out = []
    for node in root.walk():
        if node.tag in HEADINGS:
            around = node.parent
            while around is not None and around.tag != "section":
                around = around.parent
            out.append({"section": node.text().strip()[:80], "text": (around or node.parent or node).text().strip()[:500], "selector": f"{node.tag}:nth-of-type({len(out) + 1})"})
    return out


def remove_noise(root: Node) -> None:
    for node in root.walk():
        classes = lambda c: isinstance(c, Node) and (c.tag in NOISE_TAGS or c.attrs.get("aria-hidden") == "true" or any(k in c.attrs.get("class", "") for k in NOISE_CLASSES))
        node.children = [c for c in node.children if not classes(c)]


def content(root: Node) -> str:
    """The text of the first content element that has any, else of the body."""
    for wanted in CONTENT:
        for node in root.walk():
            names = node.attrs.get("class", "")
            hit = (
                wanted[0] == "." and wanted[1:] in names.split() or wanted[0] == "#" and node.attrs.get("id") == wanted[1:]
                or wanted[0] == "*" and wanted[1:] in names or node.tag == wanted
            )
            if hit:
                if text := node.text():
                    return text
                break  # only an element's first match counts
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return body.text()


def read_pages(pages: DataFrame, bare: bool = True) -> DataFrame:
    """pages (page_id, html): page_id, sections, content. bare: see parse()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b.page_id, b.html, strict=True):
                root = parse(html, bare)
                found = headings(root)
                remove_noise(root)
                rows.append((page, found, content(root)))
            yield pd.DataFrame(rows, columns=["page_id", "sections", "content"])

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, sections array<struct<section:string,text:string,selector:string>>, content string")
