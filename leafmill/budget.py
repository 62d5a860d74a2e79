"""Explicit ceilings, and the arithmetic that admits or refuses a request before it runs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_A_TOKEN, BYTES_A_PIXEL = 4, 4
LEAST_DPI, MOST_DPI, DEFAULT_DPI, READABLE_DPI = 36, 600, 150, 72


@dataclass(frozen=True)
class Budget:
    """Ceilings of one request; Budget.constrained() is for small machines."""

    response_tokens: int = 8000
    table_pages: int = 50
    render_bytes: int = 256 << 20
    ocr_seconds: float = 180.0
    ocr_seconds_a_page: float = 2.0
    source_bytes: int = 64 << 20
    regex_seconds: float = 10.0
    chars_a_page: int = 2800
    archive_members: int = 2000
    archive_ratio: float = 200.0
    sheet_rows: int = 5000
    match_tokens: int = 20

    @classmethod
    def constrained(cls) -> Budget:
        return cls(response_tokens=2000, table_pages=10, render_bytes=64 << 20, ocr_seconds=60.0, source_bytes=16 << 20, regex_seconds=5.0)

    @property
    def most_matches(self) -> int:
        return self.response_tokens // self.match_tokens


def tokens(chars: Column) -> Column:
    """Estimated tokens of so many characters."""
    return F.floor(chars / CHARS_A_TOKEN).cast("long")


def pages_that_fit(chars: Column, pages: Column, budget: Budget = Budget()) -> Column:
    """Pages of average length that one response holds, 1 at least; all of them if nothing is known."""
    average = F.greatest(F.lit(1), F.floor(chars / pages))
    fit = F.floor(F.lit(budget.response_tokens * CHARS_A_TOKEN) / average)
    return F.when((chars <= 0) | (pages < 1), pages).otherwise(F.least(F.greatest(fit, F.lit(1)), pages)).cast("long")


def render_bytes(width: Column, height: Column, dpi: Column) -> Column:
    """Bytes of a rendered page; width and height in points."""
    return F.floor(width / 72 * dpi * (height / 72 * dpi) * BYTES_A_PIXEL).cast("long")


def dpi_that_fits(square_inches: Column, pages: Column, budget: Budget = Budget()) -> Column:
    """Largest resolution at which so many pages of this area stay within the render ceiling."""
    dpi = F.floor(F.sqrt(F.lit(budget.render_bytes) / F.greatest(pages, F.lit(1)) / (square_inches * BYTES_A_PIXEL))).cast("int")
    return F.when(square_inches <= 0, READABLE_DPI).otherwise(F.least(F.greatest(dpi, F.lit(LEAST_DPI)), F.lit(MOST_DPI)))


def pages_that_fit_render(page_bytes: Column, budget: Budget = Budget()) -> Column:
    """Pages of this size within the render ceiling, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(budget.render_bytes) / page_bytes)).cast("long")


def ocr_admitted(pages: int, budget: Budget = Budget()) -> tuple[bool, int]:
    """Whether so many pages can be recognised in time, and how many could."""
    return pages * budget.ocr_seconds_a_page <= budget.ocr_seconds, int(budget.ocr_seconds // budget.ocr_seconds_a_page)


def size_ratio(before: int, after: int) -> float:
    """after / before to four places."""
    return round(after / before, 4) if before else 0.0


def json_safe(value: object) -> object:
    """NaN and infinities become None, at any depth."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return value


def finite(column: Column) -> Column:
    """json_safe() of a column of doubles."""
    return F.when(~(F.isnan(column) | (F.abs(column) == float("inf"))), column)
