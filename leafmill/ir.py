"""The relational document model: one table per level, keyed by doc_id, page and ord."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENTS = "doc_id string, source string, format string, page_count int, bytes long, encrypted boolean, tagged boolean, pagination string, chars_per_page int, meta map<string,string>"
PAGES = "doc_id string, page int, width double, height double, rotation int, basis string, confidence double, columns int, has_content boolean, raw_text string"
BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = f"struct<text:string,bbox:{BBOX},font:string,size:double,bold:boolean,italic:boolean>"
BLOCKS = f"doc_id string, page int, ord int, kind string, basis string, text string, size double, level int, bbox {BBOX}, rows array<array<string>>"
TABLES = f"doc_id string, page int, table_no int, rows array<array<string>>, row_count int, column_count int, basis string, confidence double, bbox {BBOX}, note string"
OUTLINE = "doc_id string, level int, title string, page int, basis string"
MATCHES = "doc_id string, page int, line int, start int, end int, snippet string, groups map<string,string>"
FACTS = "doc_id string, fact string, context string, unit string, value string, decimals string"
MEMBERS = "doc_id string, member string, format string, bytes long, readable boolean"

KINDS = ("para", "heading", "table", "figure", "caption", "list", "head_foot")

# Fixed values of the model: what a basis is worth, and from strongest to weakest. An empty
# page has no strength: it never is the weakest basis of an answer.
CONFIDENCE = {"text_layer": 1.0, "tagged": 1.0, "native": 1.0, "ruled": 0.95, "ocr": 0.75, "whitespace": 0.5, "font_size": 0.5, "empty": 0.0}
STRENGTH = ("native", "tagged", "text_layer", "ruled", "ocr", "font_size", "whitespace")
#: A PDF page has a text layer from so many characters on.
TEXT_LAYER_CHARS = 32


def confidence(basis: Column, measured: Column | None = None) -> Column:
    """A measured confidence, or else what the basis is worth."""
    worth = F.coalesce(*[F.when(basis == b, F.lit(c)) for b, c in CONFIDENCE.items()], F.lit(0.0))
    return worth if measured is None else F.coalesce(measured, worth)


def rank(basis: Column) -> Column:
    """Position in STRENGTH; null for an unranked basis."""
    return F.coalesce(*[F.when(basis == b, F.lit(i)) for i, b in enumerate(STRENGTH)])


def weakest(basis: Column, fallback: str) -> Column:
    """Aggregate: the weakest ranked basis of a group."""
    return F.coalesce(F.max_by(basis, rank(basis)), F.lit(fallback))


def agreed(basis: Column, fallback: str = "text_layer") -> Column:
    """Aggregate: the single basis of a group, or the fallback if they differ."""
    return F.when(F.count_distinct(basis) == 1, F.max(basis)).otherwise(F.lit(fallback))


def is_scanned(basis: Column) -> Column:
    """Pages whose text can't be relied on."""
    return basis.isin("empty", "whitespace")


def text_basis(text: Column) -> Column:
    """Basis of a page that is known by its text alone."""
    return F.when(F.length(F.trim(text)) >= TEXT_LAYER_CHARS, "text_layer").otherwise("empty")


def page_kind(basis: Column, has_content: Column) -> Column:
    """born_digital, scanned or empty; the three exclude one another."""
    return F.when(basis != "empty", "born_digital").when(has_content, "scanned").otherwise("empty")
