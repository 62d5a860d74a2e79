"""XBRL instances: facts with their contexts and units; values stay the strings they are."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from leafmill.sources.base import Block, Document, flat
from leafmill.sources.epub import local, parsed
from leafmill.sources.html import read_html

FACTS_A_BLOCK = 120
HEAD = ["fact", "context", "unit", "value", "decimals"]


def _said(element: ElementTree.Element, name: str) -> str | None:
    return next(((e.text or "").strip() for e in element.iter() if local(e) == name), None)


def _tail(name: str) -> str:
    return re.split("[}:]", name)[-1]


def humanised(name: str) -> str:
    return re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", re.sub("TextBlock$", "", _tail(name)))


def contexts(root: ElementTree.Element) -> dict[str, str]:
    """Context id to its period and members in words."""
    made = {}
    for e in root.iter():
        if local(e) == "context":
            at, start, end = _said(e, "instant"), _said(e, "startDate"), _said(e, "endDate")
            period = f"at {at}" if at is not None else f"{start or ''} to {end or ''}"
            members = [_tail((m.text or "").strip()) for m in e.iter() if local(m) == "explicitMember"]
            made[e.get("id")] = " | ".join([period, *members])
    return made


def units(root: ElementTree.Element) -> dict[str, str]:
    return {e.get("id"): "/".join(_tail((m.text or "").strip()) for m in e.iter() if local(m) == "measure") for e in root.iter() if local(e) == "unit"}


def facts(data: bytes) -> list[list[str]]:
    """[fact, context, unit, value, decimals]; an unknown context stays its reference, no unit is empty."""
    root = parsed(data)
    when, what = contexts(root), units(root)
    made = []
    for e in root.iter():
        ref, text = e.get("contextRef"), (e.text or "").strip()
        if ref and text and not local(e).endswith("TextBlock"):
            made.append([humanised(e.tag), when.get(ref, ref), what.get(e.get("unitRef"), ""), text, e.get("decimals") or ""])
    return made


def read_xbrl(data: bytes) -> Document:
    root, found, blocks = parsed(data), facts(data), []
    for at in range(0, len(found), FACTS_A_BLOCK):
        rows = [HEAD, *found[at : at + FACTS_A_BLOCK]]
        blocks.append(Block("table", flat(rows), rows=rows))
    for e in root.iter():
        if local(e).endswith("TextBlock") and (e.text or "").strip():
            blocks.append(Block("heading", humanised(e.tag), 2))
            blocks += read_html(e.text).blocks
    numeric = sum(bool(r[2]) for r in found)
    return Document("xbrl", blocks, meta={"facts": len(found), "numeric_facts": numeric, "units": ",".join(sorted({r[2] for r in found if r[2]}))}, basis="tagged")
