"""A small PDF text reader on the standard library: Flate streams, simple fonts, ToUnicode maps.

It serves born-digital files with plain content streams: words with geometry in reading order,
ruling lines and the tables they draw, bookmarks, and for each page whether it has text, only
pictures, or nothing. Encrypted files, other filters and recognition of pixels need a library and
say so.
"""

from __future__ import annotations

import json
import re
import zlib

from leafmill.ir import TEXT_LAYER_CHARS
from leafmill.sources import page_layout as L
from leafmill.sources.base import Block, Document, ReadError

_OBJECT = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]<>()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Width of a character against its height, where a font's own widths are not read.
ADVANCE = 0.5


class Pdf:
    """Objects of a file, and its pages in order."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ReadError("this is no PDF", "check the file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ReadError("the file is encrypted", "decrypt it first; no cipher is built in")
        self.objects: dict[int, bytes] = {int(n): body for n, _, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                self._unpack(body)
        if not self.objects:
            raise ReadError("no object can be read", "the file may be damaged: repair it")

    def _unpack(self, body: bytes) -> None:
        stream, first = self.stream(body), re.search(rb"/First\s+(\d+)", body)
        if not stream or not first:
            return
        heads = [int(x) for x in stream[: int(first[1])].split()]
        ends = heads[3::2] + [len(stream)]
        for number, at, end in zip(heads[::2], heads[1::2], ends):
            self.objects.setdefault(number, stream[int(first[1]) + at : int(first[1]) + end])

    def stream(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        if b"FlateDecode" not in body[: found.start()]:
            return found[1] if b"/Filter" not in body[: found.start()] else b""
        try:
            return zlib.decompressobj().decompress(found[1])
        except zlib.error:
            return b""

    def follow(self, body: bytes, key: bytes) -> list[int]:
        """Object numbers behind a key: one reference or an array of them."""
        found = re.search(rb"/" + key + rb"\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", body)
        if not found:
            return []
        return [int(found[2])] if found[2] else [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", found[1])]

    def pages(self) -> list[bytes]:
        root = next((n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        start = self.follow(self.objects[root], b"Pages") if root is not None else []
        made, todo, seen = [], start[::-1], set()
        self.page_numbers: list[int] = []
        while todo:
            number = todo.pop()
            if number in seen or number not in self.objects:
                continue
            seen.add(number)
            body = self.objects[number]
            if re.search(rb"/Type\s*/Pages\b", body):
                todo += self.follow(body, b"Kids")[::-1]
            else:
                made.append(body)
                self.page_numbers.append(number)
        return made

    def content(self, page: bytes) -> bytes:
        return b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.follow(page, b"Contents"))

    def fonts(self, page: bytes) -> dict[bytes, Font]:
        """A page's fonts by resource name."""
        made = {}
        resources = page
        for n in self.follow(page, b"Resources"):
            resources += self.objects.get(n, b"")
        fonts = re.search(rb"/Font\s*<<(.*?)>>", resources, re.S)
        listed = fonts[1] if fonts else b"".join(self.objects.get(n, b"") for n in self.follow(resources, b"Font"))
        for name, number in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", listed):
            body = self.objects.get(int(number), b"")
            font = made[name] = Font()
            for n in self.follow(body, b"ToUnicode"):
                font.known, font.code_bytes = character_map(self.stream(self.objects.get(n, b"")))
            first, widths = re.search(rb"/FirstChar\s+(\d+)", body), re.search(rb"/Widths\s*\[([^\]]*)\]", body)
            listed_apart = widths[1] if widths else b"".join(self.objects.get(n, b"") for n in self.follow(body, b"Widths"))
            if first and listed_apart:
                font.widths = {int(first[1]) + i: float(w) / 1000 for i, w in enumerate(re.findall(rb"[-\d.]+", listed_apart))}
        return made

    def inherited(self, page: bytes, key: bytes) -> bytes:
        """A page's value in brackets, its own or a parent's."""
        for _ in range(32):
            found = re.search(rb"/" + key + rb"\s*(?:\[([^\]]*)\]|([-\d.]+))", page)
            if found:
                return found[1] if found[1] is not None else found[2]
            above = self.follow(page, b"Parent")
            if not above or above[0] not in self.objects:
                break
            page = self.objects[above[0]]
        return b""

    def box(self, page: bytes) -> tuple[float, float, int]:
        """(width, height, rotation) of a page."""
        said = [float(x) for x in re.findall(rb"[-\d.]+", self.inherited(page, b"MediaBox"))]
        width, height = (said[2] - said[0], said[3] - said[1]) if len(said) == 4 else (612.0, 792.0)
        return width, height, int(float(self.inherited(page, b"Rotate") or 0)) % 360

    def bookmarks(self) -> list[dict]:
        """The outline tree in order: level, title, page (None if it leads elsewhere)."""
        numbers = {n: i for i, n in enumerate(self.page_numbers, 1)}
        roots = [n for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b) for n in self.follow(b, b"Outlines")]
        todo = [(n, 1) for r in roots for n in self.follow(self.objects.get(r, b""), b"First")]
        made, seen = [], set()
        while todo:
            number, level = todo.pop()
            if number in seen or number not in self.objects:
                continue
            seen.add(number)
            body = self.objects[number]
            title = re.search(rb"/Title\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)", body, re.S)
            raw = _bytes(title[1]) if title else b""
            said = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
            target = re.search(rb"/(?:Dest|D)\s*\[\s*(\d+)\s+\d+\s+R", body)
            if not target:
                target = next((t for n in self.follow(body, b"A") if (t := re.search(rb"/D\s*\[\s*(\d+)\s+\d+\s+R", self.objects.get(n, b"")))), None)
            made.append({"level": level, "title": said.strip(), "page": numbers.get(int(target[1])) if target else None})
            todo += [(n, level) for n in self.follow(body, b"Next")] + [(n, level + 1) for n in self.follow(body, b"First")]
        return made


class Font:
    """Codes to text, bytes of a code, and widths of codes where the font states them."""

    def __init__(self):
        self.known: dict[int, str] | None = None
        self.code_bytes, self.widths = 1, {}

    def codes(self, raw: bytes) -> list[int]:
        n = self.code_bytes
        return [int.from_bytes(raw[i : i + n], "big") for i in range(0, len(raw), n)]

    def width(self, raw: bytes) -> float:
        """How far a shown string goes, against its height."""
        return sum(self.widths.get(c, ADVANCE) for c in self.codes(raw))


def character_map(data: bytes) -> tuple[dict[int, str], int]:
    """Codes to text from bfchar and bfrange sections, and the bytes of a code by its code space."""
    spaces = [len(h) // 2 for section in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.S) for h in re.findall(rb"<([0-9A-Fa-f]+)>", section)]
    written = [len(h) // 2 for h in re.findall(rb"(?:beginbf(?:char|range)\s*)<([0-9A-Fa-f]+)>", data)]
    said = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    made: dict[int, str] = {}
    for section in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", section):
            made[int(code, 16)] = said(text)
    for section in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for low, high, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", section):
            first, last = int(low, 16), int(high, 16)
            if one:
                for i in range(min(last - first, 0xFFFF) + 1):
                    made[first + i] = said(f"{int(one, 16) + i:0{len(one)}x}".encode())
            else:
                made |= {first + i: said(t) for i, t in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many))}
    return made, max(spaces or written or [1]) or 1


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\(\r?\n|[0-7]{1,3}|.)", lambda m: _ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else m[1]), token[1:-1], flags=re.S)


def decode(raw: bytes, font: Font | None) -> str:
    """Text of a shown string; a code that the font's map lacks becomes U+FFFD."""
    if font is None or font.known is None:
        return raw.decode("cp1252", "replace")
    return "".join(font.known.get(c, "\ufffd") for c in font.codes(raw))


def runs(content: bytes, fonts: dict[bytes, Font], height: float) -> list[tuple[str, float, float, float, float]]:
    """(text, x, top, size, width) of every shown string, from the top left."""
    made, stack, size, font, leading = [], [], 12.0, None, 0.0
    line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    now = list(line)
    inside: list | None = None

    def move(x: float, y: float) -> None:
        line[4] += x * line[0] + y * line[2]
        line[5] += x * line[1] + y * line[3]
        now[:] = line

    def show(parts: list) -> None:
        text = "".join(p[0] if isinstance(p, tuple) else " " if p < -200 else "" for p in parts)
        scale = abs(now[3]) or 1.0
        across = sum(p[1] if isinstance(p, tuple) else -p / 1000 for p in parts) * size * (now[0] or 1.0)
        if text:
            made.append((text, now[4], height - now[5] - size * scale, size * scale, across))
        now[4] += across

    for token in _TOKEN.findall(content):
        first = token[:1]
        if first in b"(<":
            raw, known = _bytes(token), fonts.get(font)
            (stack if inside is None else inside).append((decode(raw, known), known.width(raw) if known else len(raw) * ADVANCE))
        elif token == b"[":
            inside = []
        elif token == b"]":
            stack.append(inside or [])
            inside = None
        elif first == b"/":
            stack.append(token[1:])
        elif first in b"-+.0123456789":
            (stack if inside is None else inside).append(float(token))
        else:
            try:
                if token == b"BT":
                    line[:] = now[:] = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
                elif token == b"Tf":
                    font, size = stack[-2], stack[-1]
                elif token == b"Tm":
                    line[:] = now[:] = stack[-6:]
                elif token in (b"Td", b"TD"):
                    leading = -stack[-1] if token == b"TD" else leading
                    move(stack[-2], stack[-1])
                elif token == b"TL":
                    leading = stack[-1]
                elif token == b"T*":
                    move(0, -leading)
                elif token in (b"Tj", b"'", b'"'):
                    if token != b"Tj":
                        move(0, -leading)
                    show([stack[-1]])
                elif token == b"TJ":
                    show(stack[-1])
            except (IndexError, TypeError):
                pass  # an operator without its operands shows nothing
            stack = []
    return made


def has_content(content: bytes) -> bool:
    """Whether a page draws anything."""
    return bool(re.search(rb"\b(?:re|l|c|Do|f|S|B)\b", content))


def rulings(content: bytes, height: float) -> list[tuple[float, float, float, float]]:
    """(x0, y0, x1, y1) of straight strokes and of the sides of boxes, from the top left."""
    made, path, stack, at = [], [], [], (0.0, 0.0)
    matrix, saved = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), []

    def place(x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = matrix
        return a * x + c * y + e, height - (b * x + d * y + f)

    for token in _TOKEN.findall(content):
        if token[:1] in b"-+.0123456789":
            stack.append(float(token))
            continue
        try:
            if token == b"q":
                saved.append(matrix)
            elif token == b"Q":
                matrix = saved.pop()
            elif token == b"cm":
                a, b, c, d, e, f = stack[-6:]
                m = matrix
                matrix = (a * m[0] + b * m[2], a * m[1] + b * m[3], c * m[0] + d * m[2], c * m[1] + d * m[3], e * m[0] + f * m[2] + m[4], e * m[1] + f * m[3] + m[5])
            elif token == b"m":
                at = place(*stack[-2:])
            elif token == b"l":
                path.append((*at, *(at := place(*stack[-2:]))))
            elif token == b"re":
                x, y, w, h = stack[-4:]
                corners = [place(x, y), place(x + w, y), place(x + w, y + h), place(x, y + h)]
                path += [(*p, *q) for p, q in zip(corners, [*corners[1:], corners[0]])]
            elif token in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                made += path
                path = []
            elif token == b"n":
                path = []
        except (IndexError, ValueError, TypeError):
            pass  # an operator without its operands draws nothing
        stack = []
    return [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in made if abs(a - c) <= L.THIN or abs(b - d) <= L.THIN]


def _words(shown: list[tuple]) -> list[tuple[float, float, float, float, str, float]]:
    """(x0, y0, x1, y1, text, size) of every word."""
    made = []
    for text, x, top, size, across in shown:
        step = across / len(text)
        made += [(x + m.start() * step, top, x + m.end() * step, top + size, m[0], size) for m in re.finditer(r"\S+", text)]
    return made


def words(data: bytes) -> list[tuple[int, str, float, float, float, float, float]]:
    """(page, text, x0, y0, x1, y1, size) of every word."""
    pdf = Pdf(data)
    shown = [(n, w) for n, page in enumerate(pdf.pages(), 1) for w in _words(runs(pdf.content(page), pdf.fonts(page), pdf.box(page)[1]))]
    return [(n, w[4], *w[:4], w[5]) for n, w in shown]


def read_pdf(data: bytes) -> Document:
    """A page is a page, with a basis of its own; a line of a column is a block, in reading order.

    A table is a block without text, as its words are in the lines already; a page that only
    draws is a figure. meta holds each page's size and columns, and the bookmarks.
    """
    pdf, blocks, kinds, layout = Pdf(data), [], [], []
    pages = pdf.pages()
    for number, page in enumerate(pages, 1):
        content, (width, height, rotation) = pdf.content(page), pdf.box(page)
        found = _words(runs(content, pdf.fonts(page), height))
        cuts, tabular = L.columns(found, width)
        made = [Block("para", " ".join(w[4] for w in line), page=number, size=max(w[5] for w in line), bbox=(line[0][0], min(w[1] for w in line), max(w[2] for w in line), max(w[3] for w in line))) for line in L.lines(found, cuts)]
        kind = "text_layer" if len("".join(b.text for b in made).strip()) >= TEXT_LAYER_CHARS else "scanned" if has_content(content) else "empty"
        for b in made:
            b.basis = "text_layer" if kind == "text_layer" else "empty"
        for rows, basis, box in L.tables(found, rulings(content, height), bool(cuts)):
            made.append(Block("table", "", rows=rows, page=number, bbox=box, basis=basis))
        if kind == "scanned":
            made.append(Block("figure", "", page=number, basis="empty"))
        kinds.append(kind)
        layout.append({"width": width, "height": height, "rotation": rotation, "columns": 1 if tabular else len(cuts) + 1, "looks_tabular": tabular, "words": len(found)})
        blocks += made or [Block("para", "", page=number, basis="empty")]
    meta = {"page_kinds": ",".join(kinds), "layout": json.dumps(layout), "bookmarks": json.dumps(pdf.bookmarks())}
    return Document("pdf", blocks, pagination="native", page_count=max(1, len(pages)), meta=meta, basis="text_layer" if "text_layer" in kinds else "empty")
