"""HTML without a tree: block elements become blocks, as a forgiving browser would part them.

Script, style and their like vanish with all they hold. A block element that has text is one
block and what it nests is part of it. Text outside every block element is dropped, unless
there is no block at all: then the whole text is one. A start tag of CLOSES_P ends an open
paragraph, so markup that forgets its end tags reads as it looks.
"""

from __future__ import annotations

from html.parser import HTMLParser

from leafmill.sources.base import Block, Document, decoded, flat

# What vanishes, what is a block, what ends a paragraph.
DROPPED = {"script", "style", "noscript", "template", "svg", "canvas", "iframe"}
KIND = dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading") | dict.fromkeys(("p", "pre", "blockquote"), "para") | dict.fromkeys(("li", "dd", "dt"), "list")
KIND |= dict.fromkeys(("figcaption", "caption"), "caption") | dict.fromkeys(("header", "footer", "nav"), "head_foot") | {"table": "table"}
CLOSES_P = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "div", "table", "nav", "article", "header", "footer", "blockquote", "pre", "dl", "dd", "dt", "figcaption"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE_END = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class _Node:
    __slots__ = ("tag", "children")

    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.walk()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root")
        self.open = [self.root]
        self.dropped: str | None = None
        self.lang, self.links, self.images, self.description = "", 0, 0, ""

    def _close(self, tags: set[str], until: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            return
        if tag in DROPPED:
            self.dropped = tag
            return
        has = dict(attrs)
        if tag == "html":
            self.lang = has.get("lang") or ""
        elif tag == "a" and has.get("href") is not None:
            self.links += 1
        elif tag == "img":
            self.images += 1
        elif tag == "meta" and (has.get("name") or "").lower() == "description":
            self.description = has.get("content") or ""
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "body", "article"})
        if tag in INLINE_END:
            self._close(INLINE_END[tag], {"table", "ul", "ol", "dl"})
        node = _Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.dropped and self.open[-1].tag == tag:
            self.open.pop()
        if self.dropped == tag:
            self.dropped = None

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped:
                self.dropped = None
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.dropped:
            self.open[-1].children.append(data)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def table_rows(node: _Node) -> list[list[str]]:
    """Cells of every row under an element, nested tables included."""
    return [[_squeezed(c.text()) for c in row.children if not isinstance(c, str) and c.tag in ("td", "th")] for row in node.walk() if row.tag == "tr"]


def _blocks(node: _Node):
    for child in node.children:
        if isinstance(child, str):
            continue
        if child.tag in ("head", "title"):
            continue
        kind = KIND.get(child.tag)
        text = _squeezed(child.text()) if kind else ""
        if not text:
            yield from _blocks(child)
        elif kind == "table":
            rows = [r for r in table_rows(child) if r]
            yield Block("table", flat(rows), rows=rows)
        else:
            yield Block(kind, text, int(child.tag[1]) if kind == "heading" else None)


def read_html(data: bytes | str) -> Document:
    builder = _Builder()
    builder.feed(data if isinstance(data, str) else decoded(data))
    builder.close()
    blocks = list(_blocks(builder.root))
    title = next((_squeezed(n.text()) for n in builder.root.walk() if n.tag == "title"), "")
    if not blocks:
        whole = _squeezed("".join(c if isinstance(c, str) else c.text() for n in [builder.root] for c in n.children if isinstance(c, str) or c.tag not in ("head", "title")))
        blocks = [Block("para", whole)] if whole else []
    meta = {"title": title, "lang": builder.lang, "links": builder.links, "images": builder.images, "tables": sum(b.kind == "table" for b in blocks), "headings": sum(b.kind == "heading" for b in blocks), "description": builder.description}
    return Document("html", blocks, meta=meta)
