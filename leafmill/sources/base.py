"""What every reader returns, and how readers run over files and columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import ir
from leafmill.budget import Budget


class ReadError(ValueError):
    """A source that can't be read; hint says what to do."""

    def __init__(self, error: str, hint: str):
        super().__init__(error)
        self.hint = hint


@dataclass
class Block:
    kind: str
    text: str
    level: int | None = None
    rows: list[list[str]] | None = None
    page: int = 1
    size: float = 0.0
    bbox: tuple[float, float, float, float] | None = None
    basis: str = ""  # the document's, if empty


@dataclass
class Document:
    """blocks carry their page where pagination is native; flow formats are packed into pages."""

    format: str
    blocks: list[Block]
    pagination: str = "synthetic"
    page_count: int | None = None
    meta: dict[str, str] = field(default_factory=dict)
    basis: str = "native"


def decoded(data: bytes) -> str:
    """UTF-8 (with or without a mark), else a guess, else UTF-8 with replacements."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
        if best is not None:
            return str(best)
    except ImportError:
        pass
    return data.decode("utf-8", "replace")


def paged(document: Document, limit: int = Budget().chars_a_page) -> list[Block]:
    """Blocks with pages: packed in order, none above the limit; tables are split by rows."""
    if document.pagination == "native":
        return document.blocks or [Block("para", "", page=1)]
    pieces: list[Block] = []
    for b in document.blocks:
        if len(b.text) <= limit:
            pieces.append(b)
        elif b.rows:
            part: list[list[str]] = []
            for row in b.rows:
                if part and len(flat([*part, row])) > limit:
                    pieces.append(Block(b.kind, flat(part), b.level, part))
                    part = []
                part.append(row)
            pieces.append(Block(b.kind, flat(part), b.level, part))
        else:
            now: str | None = None
            for line in b.text.split("\n"):
                for cut in [line[i : i + limit] for i in range(0, max(len(line), 1), limit)]:
                    if now is not None and len(now) + 1 + len(cut) <= limit:
                        now += "\n" + cut
                        continue
                    if now is not None:
                        pieces.append(Block(b.kind, now, b.level))
                    now = cut
            pieces.append(Block(b.kind, now or "", b.level))
    page, used = 1, 0
    for b in pieces:
        if used and used + len(b.text) > limit:
            page, used = page + 1, 0
        b.page, used = page, used + len(b.text)
    return pieces or [Block("para", "", page=1)]


def flat(rows: list[list[str]]) -> str:
    """A table as text."""
    return "\n".join("\t".join(r) for r in rows)


def readers() -> dict:
    """File extension to (module, function); a module is imported when it is first used."""
    plain = dict.fromkeys(("txt", "log"), ("text", "read_text")) | dict.fromkeys(("md", "markdown"), ("text", "read_markdown")) | {"csv": ("text", "read_csv"), "tsv": ("text", "read_csv")}
    web = dict.fromkeys(("html", "htm", "xhtml"), ("html", "read_html"))
    office = {"docx": ("office", "read_docx"), "pptx": ("office", "read_pptx"), "xlsx": ("office", "read_xlsx"), "xlsm": ("office", "read_xlsx"), "epub": ("epub", "read_epub")}
    return plain | web | office | {"eml": ("mail", "read_eml"), "xbrl": ("xbrl", "read_xbrl"), "xml": ("xbrl", "read_xbrl"), "zip": ("archive", "read_zip"), "pdf": ("pdf", "read_pdf")}


def read(name: str, data: bytes, password: str = "") -> Document:
    """Read a document by its extension. "bundle.zip::member" reads a file inside an archive."""
    from importlib import import_module

    if ".zip::" in name.lower():
        from leafmill.sources.archive import member

        at = name.lower().index(".zip::") + 4
        return read(name[at + 2 :], member(data, name[at + 2 :]), password)
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension not in readers():
        raise ReadError(f"no reader for {extension or 'a name without extension'!r}", "use one of " + ", ".join(sorted(readers())))
    module, function = readers()[extension]
    return getattr(import_module(f"leafmill.sources.{module}"), function)(data)


BLOCK_ROWS = ir.BLOCKS + ", format string, pagination string, meta map<string,string>, error string, hint string"


def _rows(name: str, data: bytes) -> list[dict]:
    try:
        document = read(name, data)
    except Exception as bad:  # one bad file is a row that says so, not the end of the job
        return [{"doc_id": name, "page": 1, "ord": 0, "error": f"{type(bad).__name__}: {bad}", "hint": getattr(bad, "hint", "check that the file opens elsewhere")}]
    made = []
    for i, b in enumerate(paged(document), 1):
        box = dict(zip(("x0", "y0", "x1", "y1"), b.bbox)) if b.bbox else None
        made.append({"doc_id": name, "page": b.page, "ord": i, "kind": b.kind, "basis": b.basis or document.basis, "text": b.text, "size": float(b.size), "level": b.level, "bbox": box, "rows": b.rows,
                     "format": document.format, "pagination": document.pagination, "meta": {k: str(v) for k, v in document.meta.items()}})
    return made


_COLUMNS = ["doc_id", "page", "ord", "kind", "basis", "text", "size", "level", "bbox", "rows", "format", "pagination", "meta", "error", "hint"]


def _frame(rows: list[dict]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=_COLUMNS).astype(object)
    return made.where(made.notna(), None)


#: Bytes of documents whose blocks are one frame, about.
FRAME_BYTES = 1 << 20


def _read_batches(batches):
    for pdf in batches:
        rows, size = [], 0
        for name, content in zip(pdf["name"], pdf["content"]):
            rows += _rows(name, bytes(content or b""))
            size += len(content or b"")
            if size >= FRAME_BYTES:
                yield _frame(rows)
                rows, size = [], 0
        if rows:
            yield _frame(rows)


def read_column(rows: DataFrame, name: str, content: str) -> DataFrame:
    """Blocks of documents held in a column: its name tells the format."""
    data = F.col(content)
    named = rows.select(F.col(name).cast("string").alias("name"), (data if dict(rows.dtypes)[content] == "binary" else data.cast("binary")).alias("content"))
    return named.mapInPandas(_read_batches, BLOCK_ROWS)


def read_files(spark: SparkSession, path: str, glob: str = "*", budget: Budget = Budget(), only: str = "") -> DataFrame:
    """Blocks of files, or of `only` one. Files over the source ceiling are rows with an error and are never opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path") == only) if only else files
    fits = read_column(files.where(F.col("length") <= budget.source_bytes).select("path", "content"), "path", "content")
    large = files.where(F.col("length") > budget.source_bytes).select("path")
    schema = fits.schema
    said = {"doc_id": F.col("path"), "page": F.lit(1), "ord": F.lit(0), "error": F.lit(f"the file is over {budget.source_bytes} bytes"), "hint": F.lit("split the file, or raise the source ceiling")}
    return fits.unionByName(large.select(*[(said.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.fields]))


def pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text, basis, has_content) of blocks: block texts joined by line ends.

    A table without a text says what other blocks say and adds no line; a figure is content
    without text. The page's basis is that of its text.
    """
    drawn = F.col("kind").isin("table", "figure") & (F.col("text") == "")
    listed = blocks.where("error IS NULL").groupBy("doc_id", "page").agg(
        F.sort_array(F.collect_list(F.when(~drawn, F.struct("ord", "text")))).alias("b"),
        F.coalesce(F.min_by("basis", F.when(~drawn, F.col("ord"))), F.first("basis")).alias("basis"),
        F.max(F.col("kind") == "figure").alias("has_content"),
    )
    return listed.select("doc_id", "page", F.array_join(F.col("b")["text"], "\n").alias("text"), "basis", "has_content")


def block_lines(blocks: DataFrame) -> DataFrame:
    """Lines of blocks without geometry: one block is one line."""
    drawn = F.col("kind").isin("table", "figure") & (F.col("text") == "")
    return blocks.where(F.col("error").isNull() & ~drawn).select("doc_id", "page", F.col("ord").alias("line"), "text", "size")
