"""Text as a PDF file: one of the standard fonts, pages of fixed size, nothing embedded."""

from __future__ import annotations

import textwrap
import zlib

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 612, 792, 54, 10, 13
#: Letters of the fixed-width font that fit between the margins; one is 0.6 of its size wide.
ACROSS, DOWN = int((WIDTH - 2 * MARGIN) / (SIZE * 0.6)), int((HEIGHT - 2 * MARGIN) / LEADING)


def _escaped(line: str) -> bytes:
    raw = line.encode("cp1252", "replace")
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def lines(text: str) -> list[str]:
    """The text's lines, longer ones broken at blanks."""
    made = []
    for line in text.expandtabs(4).split("\n"):
        made += textwrap.wrap(line, ACROSS, replace_whitespace=False, drop_whitespace=True) or [""]
    return made


def text_pdf(pages: list[str]) -> bytes:
    """A file with every text from a page of its own on; a text that is longer takes several.

    Characters beyond Windows-1252, which the standard fonts lack, become question marks.
    """
    sheets = []
    for text in pages or [""]:
        every = lines(text)
        sheets += [every[i : i + DOWN] for i in range(0, len(every), DOWN)]
    bodies = [b"<</Type /Catalog /Pages 2 0 R>>", b"", b"<</Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [" + b" ".join([b"600"] * 224) + b"]>>"]
    kids = []
    for sheet in sheets:
        drawn = b"BT /F1 %d Tf %d TL %d %d Td\n" % (SIZE, LEADING, MARGIN, HEIGHT - MARGIN - SIZE)
        drawn += b"\n".join(b"(" + _escaped(line) + b") Tj T*" for line in sheet) + b"\nET"
        packed = zlib.compress(drawn)
        kids.append(len(bodies) + 1)
        bodies.append(b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources <</Font <</F1 3 0 R>> >> /Contents %d 0 R>>" % (WIDTH, HEIGHT, len(bodies) + 2))
        bodies.append(b"<</Length %d /Filter /FlateDecode>> stream\n" % len(packed) + packed + b"\nendstream")
    bodies[1] = b"<</Type /Pages /Count %d /Kids [" % len(kids) + b" ".join(b"%d 0 R" % k for k in kids) + b"]>>"
    made, places = bytearray(b"%PDF-1.4\n"), []
    for number, body in enumerate(bodies, 1):
        places.append(len(made))
        made += b"%d 0 obj " % number + body + b" endobj\n"
    at = len(made)
    made += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(made + b"trailer <</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, at))
