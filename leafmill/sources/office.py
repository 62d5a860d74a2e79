"""DOCX, PPTX and XLSX from their XML parts; nothing but the standard library."""

from __future__ import annotations

import posixpath
import re
from xml.etree import ElementTree

from leafmill.budget import Budget
from leafmill.sources.archive import opened
from leafmill.sources.base import Block, Document, flat
from leafmill.sources.epub import local, parsed

EMU_A_POINT = 12700


def _children(element: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in element.iter() if local(e) == name]


def _attribute(element: ElementTree.Element | None, name: str) -> str | None:
    return None if element is None else next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _relations(bundle, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in bundle.namelist():
        return {}
    made = {}
    for e in parsed(bundle.read(path)):
        target = e.get("Target") or ""
        made[e.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return made


def _words(paragraph: ElementTree.Element) -> str:
    return "".join({"t": e.text or "", "tab": "\t", "br": "\n"}.get(local(e), "") for e in paragraph.iter())


def read_docx(data: bytes) -> Document:
    """Paragraphs and tables in the order of the body; a style's name makes a heading."""
    bundle = opened(data)
    names = {}
    if "word/styles.xml" in bundle.namelist():
        for style in _children(parsed(bundle.read("word/styles.xml")), "style"):
            name = next((e for e in style if local(e) == "name"), None)
            names[_attribute(style, "styleId")] = _attribute(name, "val") or ""
    body = next(e for e in parsed(bundle.read("word/document.xml")) if local(e) == "body")
    blocks = []
    for e in body:
        if local(e) == "tbl":
            rows = [["\n".join(filter(None, (_words(p).strip() for p in _children(c, "p")))) for c in r if local(c) == "tc"] for r in e if local(r) == "tr"]
            rows = [r for r in rows if any(r)]
            blocks += [Block("table", flat(rows), rows=rows)] if rows else []
        elif local(e) == "p" and (text := _words(e).strip()):
            style = next((_attribute(s, "val") or "" for s in _children(e, "pStyle")), "")
            name = (names.get(style) or style).lower()
            level = re.match(r"heading\s*(\d+)", name)
            if level or name == "title":
                blocks.append(Block("heading", text, min(int(level[1]), 6) if level else 1))
            else:
                blocks.append(Block("list" if "list" in name or "bullet" in name else "caption" if "caption" in name else "para", text))
    return Document("docx", blocks)


def read_pptx(data: bytes) -> Document:
    """A slide is a page; shapes from top to bottom, then from the left; notes last."""
    bundle = opened(data)
    show = parsed(bundle.read("ppt/presentation.xml"))
    relations = _relations(bundle, "ppt/presentation.xml")
    slides = [relations[_attribute(e, "id") if _attribute(e, "id") in relations else e.attrib[next(k for k in e.attrib if k.endswith("}id"))]] for e in _children(show, "sldId")]
    blocks = []
    for page, part in enumerate(slides, 1):
        shapes = []
        for shape in (e for e in parsed(bundle.read(part)).iter() if local(e) in ("sp", "graphicFrame")):
            off, ext = next(iter(_children(shape, "off")), None), next(iter(_children(shape, "ext")), None)
            box = None
            if off is not None and ext is not None and off.get("x") and ext.get("cx"):
                x, y, w, h = (int(v) / EMU_A_POINT for v in (off.get("x"), off.get("y"), ext.get("cx"), ext.get("cy")))
                box = (x, y, x + w, y + h)
            kind = _attribute(next(iter(_children(shape, "ph")), None), "type")
            if table := next(iter(_children(shape, "tbl")), None):
                rows = [[" ".join(_words(p) for p in _children(c, "p")).strip() for c in _children(r, "tc")] for r in _children(table, "tr")]
                shapes.append(Block("table", flat(rows), rows=rows, page=page, bbox=box))
            elif text := "\n".join(filter(None, (_words(p).strip() for p in _children(shape, "p")))):
                shapes.append(Block("heading" if kind in ("title", "ctrTitle") else "para", text, 1 if kind in ("title", "ctrTitle") else None, page=page, bbox=box))
        shapes.sort(key=lambda b: (b.bbox is None, b.bbox[1] if b.bbox else 0, b.bbox[0] if b.bbox else 0))
        for target in _relations(bundle, part).values():
            if "notesSlide" in target and target in bundle.namelist():
                notes = "\n".join(filter(None, (_words(p).strip() for p in _children(parsed(bundle.read(target)), "p"))))
                shapes += [Block("head_foot", notes, page=page)] if notes else []
        blocks += shapes or [Block("para", "", page=page)]
    return Document("pptx", blocks, pagination="native", page_count=max(1, len(slides)), meta={"slides": len(slides)})


def _column(reference: str) -> int:
    made = 0
    for c in re.match("[A-Z]+", reference)[0]:
        made = made * 26 + ord(c) - 64
    return made - 1


def read_xlsx(data: bytes, budget: Budget = Budget()) -> Document:
    """A sheet is a page (long ones several): cached values, not formulas; blank rows and tails go."""
    bundle = opened(data)
    strings = [_words(e) for e in _children(parsed(bundle.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in bundle.namelist() else []
    relations, blocks, where, page, split = _relations(bundle, "xl/workbook.xml"), [], {}, 0, False
    for sheet in _children(parsed(bundle.read("xl/workbook.xml")), "sheet"):
        link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
        rows: list[list[str]] = []
        for r in _children(parsed(bundle.read(relations[link])), "row"):
            row: list[str] = []
            for c in (e for e in r if local(e) == "c"):
                at = _column(c.get("r")) if c.get("r") else len(row)
                value = next((e.text or "" for e in c if local(e) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = strings[int(value)]
                elif c.get("t") == "inlineStr":
                    value = _words(c)
                elif c.get("t") == "b" and value is not None:
                    value = "TRUE" if value == "1" else "FALSE"
                if value:
                    row += [""] * (at + 1 - len(row))
                    row[at] = value
            if any(x.strip() for x in row):
                rows.append(row)
        total, rows = len(rows), rows[: budget.sheet_rows]
        name, first = sheet.get("name") or "", page + 1
        parts: list[list[list[str]]] = [[]]
        for row in rows:
            if parts[-1] and len(flat([*parts[-1], row])) > budget.chars_a_page:
                parts.append([])
            parts[-1].append(row)
        split |= len(parts) > 1
        for i, part in enumerate(parts):
            page += 1
            if not i:
                blocks.append(Block("heading", name, 1, page=page))
            if part:
                blocks.append(Block("table", flat(part), rows=part, page=page))
        where[name] = f"{first}-{page} of {total} rows" if page > first else f"{first} of {total} rows"
    return Document("xlsx", blocks, pagination="native", page_count=max(1, page), meta={"sheets": len(where), "sheet_pages": "; ".join(f"{k}: {v}" for k, v in where.items()), "split": split})
