"""Scalar text functions as column expressions; Python only for Unicode composition."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a line break, and what normalisation replaces.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
BLANK = r"[\s\x1C-\x1F]"
REPLACED = (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"), ("\u00ad", ""), ("\u00a0", " "))


def strip(text: Column) -> Column:
    """Without white space at its ends, Unicode's included."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){BLANK}+\z", "")


def collapse(text: Column) -> Column:
    """Words with one space between."""
    return strip(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def lines(text: Column) -> Column:
    """The lines of a text; a break at its end opens no further line, and no text has no line."""
    found = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)


def shape(line: Column) -> Column:
    """A line with its digits hidden, as running heads are compared."""
    return F.regexp_replace(strip(line), r"(?U)\d+", "#")


def is_blank(line: Column) -> Column:
    return strip(line) == ""


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """NFC. Spark has no such function; call it only where a text isn't ASCII."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def replaced_characters(text: Column) -> Column:
    """Ligatures, soft hyphens and no-break spaces replaced."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), REPLACED, text)


def replaced_count(text: Column) -> Column:
    """How many characters replaced_characters() replaces."""
    found = F.translate(text, "".join(a for a, _ in REPLACED), "")
    return (F.length(text) - F.length(found)).cast("long")


@cache
def uncomposed() -> str:
    """A pattern of the characters that composition can change: marks, Hangul parts, and what is never in composed form."""
    never = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", chr(c))]
    runs = [(a, b) for a, b in zip(never, [None, *never]) if b != a - 1]
    ends = [a for a, b in zip(never, [*never[1:], None]) if b != a + 1]
    return r"[\p{M}\x{1161}-\x{1175}\x{11A8}-\x{11C2}" + "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for (a, _), z in zip(runs, ends)) + "]"


def normalised(text: Column) -> Column:
    """replaced_characters() in composed form; only texts that it can change are brought to Python."""
    made = replaced_characters(text)
    return F.coalesce(composed(F.when(made.rlike(uncomposed()), made)), made)


def literal(query: str) -> str:
    """A pattern that matches a text as it stands."""
    return "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def starts(text: Column, query: str) -> Column:
    """0-based places of a literal, case ignored, not overlapping; no UDF."""
    pieces = F.split(text, f"(?iu){literal(query)}", -1)
    n = len(query)
    sums = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("next")),
        lambda s, p: F.struct(F.concat(s.at, F.array(s.next + F.length(p))).alias("at"), (s.next + F.length(p) + n).alias("next")),
    )
    return sums["at"]


def hits(text: Column, query: str) -> Column:
    """Number of places of a literal, case ignored."""
    return (F.size(F.split(text, f"(?iu){literal(query)}", -1)) - 1).cast("long")


def line_number(text: Column, start: Column) -> Column:
    """1-based line of a 0-based place."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def snippet(text: Column, start: Column, end: Column, around: int = 60) -> Column:
    """A match with its surroundings on one line; an ellipsis where it was cut."""
    low, high = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    cut = F.trim(F.translate(F.substring(text, low + 1, high - low), "\n", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), cut, F.when(high < F.length(text), "…").otherwise(""))


def heading_mark(level: Column) -> Column:
    return F.repeat(F.lit("#"), F.least(level, F.lit(6)))


def cell_text(cell: Column) -> Column:
    """A cell as a pipe table holds it."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def width(rows: Column) -> Column:
    """Columns of a ragged table."""
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def pipe_table(rows: Column) -> Column:
    """A ragged table in Markdown: padded, never cut, the first row as its head."""
    n = width(rows)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell_text), F.array_repeat(F.lit(""), n - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    drawn = F.transform(rows, line)
    return F.when((F.size(rows) > 0) & (n > 0), F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, 2, 2147483646)), "\n")).otherwise("")


def tsv(rows: Column) -> Column:
    """A table as text: tabs between cells, one line a row."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t", "")), "\n")


def html_escape(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), text)


def html_page(title: Column, text: Column) -> Column:
    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), html_escape(title), F.lit("</title></head><body><pre>"), html_escape(text), F.lit("</pre></body></html>\n"))


def local_name(name: Column) -> Column:
    """A qualified name without its namespace."""
    return F.element_at(F.split(name, "[}:]"), -1)


def humanised(name: Column) -> Column:
    """CamelCase in words, without the suffix of narrative facts."""
    bare = F.regexp_replace(local_name(name), "TextBlock$", "")
    return F.trim(F.regexp_replace(bare, "(?<=[a-z0-9])(?=[A-Z])", " "))


def atx_level(line: Column) -> Column:
    """Level of a Markdown heading line, or 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))


def safe_name(name: Column, most: int = 120) -> Column:
    """A file name without anything a shell or a path could trip over."""
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    made = F.substring(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+\z", ""), 1, most)
    return F.when(made == "", "download").otherwise(made)


def direct_link(url: Column) -> Column:
    """Share links of file hosts as links to the file itself."""
    rules = (
        (r"^https?://drive\.google\.com/file/d/([A-Za-z0-9_-]+).*$", "https://drive.google.com/uc?export=download&id=$1"),
        (r"^https?://drive\.google\.com/(?!uc\?)[^?#]*\?(?:[^#]*&)?id=([^&#]+).*$", "https://drive.google.com/uc?export=download&id=$1"),
        (r"^https?://docs\.google\.com/document/d/([A-Za-z0-9_-]+)(?!.*/export).*$", "https://docs.google.com/document/d/$1/export?format=docx"),
        (r"^https?://docs\.google\.com/spreadsheets/d/([A-Za-z0-9_-]+)(?!.*/export).*?[?&#]gid=([^&#]+).*$", "https://docs.google.com/spreadsheets/d/$1/export?format=csv&gid=$2"),
        (r"^https?://docs\.google\.com/spreadsheets/d/([A-Za-z0-9_-]+)(?!.*/export).*$", "https://docs.google.com/spreadsheets/d/$1/export?format=csv"),
        (r"^https?://docs\.google\.com/presentation/d/([A-Za-z0-9_-]+)(?!.*/export).*$", "https://docs.google.com/presentation/d/$1/export?format=pptx"),
        (r"^https?://github\.com/([^/]+/[^/]+)/blob/([^?#]+).*$", "https://raw.githubusercontent.com/$1/$2"),
        (r"^(https?://gitlab\.com/.+)/-/blob/(.+)$", "$1/-/raw/$2"),
    )
    made = reduce(lambda c, r: F.regexp_replace(c, *r), rules, url)
    # Dropbox: every other parameter stays, an access key is one of them.
    head, asked = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:dl|raw)(?:=|$)"))
    dropbox = F.concat(head, F.lit("?"), F.array_join(F.concat(kept, F.array(F.lit("dl=1"))), "&"))
    return F.when(url.rlike(r"^https?://(?:www\.)?dropbox\.com/"), dropbox).otherwise(made)


def data_uri(uri: Column) -> Column:
    """A data: URI taken apart: media type, name, bytes; null for anything else."""
    head = F.regexp_extract(uri, "^data:([^,]*),", 1)
    body = F.regexp_extract(uri, "(?s)^data:[^,]*,(.*)$", 1)
    content = F.when(head.rlike("(?i);base64$"), F.try_to_binary(body, F.lit("base64"))).otherwise(F.try_url_decode(body).cast("binary"))
    kind = F.regexp_extract(head, "^([^;]*)", 1)
    named = F.struct(F.when(kind == "", "text/plain").otherwise(kind).alias("media_type"), F.nullif(F.regexp_extract(head, "name=([^;]*)", 1), F.lit("")).alias("name"), content.alias("content"))
    return F.when(uri.startswith("data:"), named)


GLUED = r"^(\(?\d{1,3}(?:\.\d{3})+\)?)(?![.,]\d)(.+)$"


def glued_figure(token: Column) -> Column:
    """A figure and what was set too close behind it, or null."""
    tail = F.regexp_extract(token, GLUED, 2)
    return F.when(token.rlike(GLUED) & tail.rlike(r"^[\p{L}\p{N}]"), F.struct(F.regexp_extract(token, GLUED, 1).alias("figure"), tail.alias("tail")))
