"""EPUB: chapters in spine order, one page each; a missing chapter is an empty page."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote
from xml.etree import ElementTree

from leafmill.sources.archive import opened
from leafmill.sources.base import Block, Document, ReadError
from leafmill.sources.html import read_html


def parsed(data: bytes) -> ElementTree.Element:
    """XML without entity declarations: none is ever expanded or fetched."""
    if b"<!ENTITY" in data:
        raise ReadError("the XML declares entities", "remove them")
    return ElementTree.fromstring(data)


def local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def read_epub(data: bytes) -> Document:
    bundle = opened(data)
    container = parsed(bundle.read("META-INF/container.xml"))
    root = next((e.get("full-path") for e in container.iter() if local(e) == "rootfile"), None)
    if not root:
        raise ReadError("the book names no package", "the file may be damaged")
    package = parsed(bundle.read(root))
    hrefs = {e.get("id"): e.get("href") for e in package.iter() if local(e) == "item"}
    chapters = [hrefs[e.get("idref")] for e in package.iter() if local(e) == "itemref" and e.get("idref") in hrefs]
    title = next((e.text or "" for e in package.iter() if local(e) == "title"), "")
    blocks, names = [], set(bundle.namelist())
    for page, href in enumerate(chapters, 1):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(href)))
        found = read_html(bundle.read(name)).blocks if name in names else []
        for b in found or [Block("para", "")]:
            b.page = page
            blocks.append(b)
    return Document("epub", blocks, pagination="native", page_count=max(1, len(chapters)), meta={"title": title, "chapters": len(chapters)})
