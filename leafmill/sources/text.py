"""Plain text, Markdown and CSV."""

from __future__ import annotations

import csv
import io
import re

from leafmill.sources.base import Block, Document, decoded, flat

SNIFFED, DELIMITERS = 8192, ",;\t|"
HEADING_SIZE = {1: 26.0, 2: 22.0, 3: 18.0, 4: 16.0, 5: 14.0, 6: 13.0}


def paragraphs(text: str) -> list[str]:
    """Runs of lines between blank ones."""
    made: list[list[str]] = [[]]
    for line in text.splitlines():
        if line.strip():
            made[-1].append(line)
        elif made[-1]:
            made.append([])
    return ["\n".join(m) for m in made if m]


def read_text(data: bytes) -> Document:
    return Document("text", [Block("para", p) for p in paragraphs(decoded(data))])


def read_markdown(data: bytes) -> Document:
    """Headings by marks or underlines; inside a fence nothing is a heading."""
    blocks: list[Block] = []
    held: list[str] = []

    def flush():
        if held:
            blocks.append(Block("para", "\n".join(held)))
            held.clear()

    fence, lines = "", decoded(data).splitlines()
    for line in lines:
        mark = re.match(r"\s{0,3}(```|~~~)", line)
        if mark and (not fence or fence == mark[1]):
            fence = "" if fence else mark[1]
            held.append(line)
            continue
        if fence:
            held.append(line)
            continue
        heading = re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        under = re.match(r"(={3,}|-{3,})\s*$", line)
        if heading and heading[2]:
            flush()
            blocks.append(Block("heading", heading[2], len(heading[1]), size=HEADING_SIZE[len(heading[1])]))
        elif under and len(held) == 1:
            level = 1 if under[1][0] == "=" else 2
            blocks.append(Block("heading", held.pop().strip(), level, size=HEADING_SIZE[level]))
        elif line.strip():
            held.append(line)
        else:
            flush()
    flush()
    return Document("markdown", blocks)


def read_csv(data: bytes) -> Document:
    """One table; its dialect is sniffed, its head stays the first row, blank rows go."""
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:SNIFFED], DELIMITERS)
    except csv.Error:
        dialect = csv.excel
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), dialect, strict=True) if any(c.strip() for c in r)]
    except csv.Error as bad:
        plain = read_text(data)
        plain.meta["csv_parse"] = str(bad)
        return plain
    return Document("csv", [Block("table", flat(rows), rows=rows)] if rows else [], meta={"rows": len(rows), "delimiter": dialect.delimiter})
