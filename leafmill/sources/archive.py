"""ZIP bundles: a manifest as one page, and single members, behind guards against bombs."""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath

from leafmill.budget import Budget
from leafmill.sources.base import Block, Document, ReadError, flat, readers

LISTED = 50


def opened(data: bytes, budget: Budget = Budget()) -> zipfile.ZipFile:
    """An archive whose members are few, safe to name and not absurdly compressed."""
    try:
        bundle = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ReadError("the archive is damaged", "send it again") from None
    members = bundle.infolist()
    if len(members) > budget.archive_members:
        raise ReadError(f"{len(members)} members; the limit is {budget.archive_members}", "split the archive")
    size, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
    if size > budget.source_bytes:
        raise ReadError(f"{size} bytes unpacked; the limit is {budget.source_bytes}", "split the archive")
    if packed and size / packed > budget.archive_ratio:
        raise ReadError(f"it unpacks to {size / packed:.0f} times its size", "this looks like a bomb")
    return bundle


def safe(name: str) -> bool:
    path = PurePosixPath(name.replace("\\", "/"))
    return not path.is_absolute() and ".." not in path.parts and ":" not in name


def manifest(data: bytes) -> list[tuple[str, str, int, bool]]:
    """(member, format, bytes, readable) of every file."""
    made = []
    for m in opened(data).infolist():
        if not m.is_dir():
            extension = m.filename.rsplit(".", 1)[-1].lower() if "." in m.filename else ""
            made.append((m.filename, extension, m.file_size, extension in readers() and safe(m.filename)))
    return made


def read_zip(data: bytes) -> Document:
    found = manifest(data)
    rows = [["member", "format", "bytes", "readable"], *[[n, f, str(s), "yes" if r else "no"] for n, f, s, r in found[:LISTED]]]
    packed = sum(m.compress_size for m in opened(data).infolist())
    total = sum(s for _, _, s, _ in found)
    meta = {"members": len(found), "readable": sum(r for *_, r in found), "bytes": total, "ratio": round(total / packed, 2) if packed else 1.0}
    return Document("zip", [Block("table", flat(rows), rows=rows)], pagination="native", page_count=1, meta=meta)


def member(data: bytes, name: str) -> bytes:
    """One member, byte for byte."""
    if not safe(name):
        raise ReadError(f"{name!r} leads out of the archive", "name a member as the manifest lists it")
    bundle = opened(data)
    try:
        return bundle.read(name)
    except KeyError:
        raise ReadError(f"no member {name!r}", "the manifest lists the members") from None
