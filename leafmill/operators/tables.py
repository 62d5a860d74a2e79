"""Tables: words into ruled cells, reading order inside a cell, filters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.budget import Budget

#: Width of the buckets that make a range join an equi-join.
BUCKET = 64
WORD = "array<struct<top:double,x0:double,bottom:double,text:string>>"


def words_in_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Words with the cells that hold their centre, borders included.

    Both sides meet by (doc_id, page, x bucket): no nested loop over words and cells.
    """
    centre_x, centre_y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    low, high = F.floor(F.col("x0") / BUCKET), F.floor(F.col("x1") / BUCKET)
    spread = cells.withColumn("__b", F.explode(F.sequence(low, high)))
    placed = words.withColumn("__b", F.floor((F.col("x0") + F.col("x1")) / 2 / BUCKET))
    w, c = placed.alias("w"), spread.alias("c")
    same = (F.col("w.doc_id") == F.col("c.doc_id")) & (F.col("w.page") == F.col("c.page")) & (F.col("w.__b") == F.col("c.__b"))
    inside = centre_x.between(F.col("c.x0"), F.col("c.x1")) & centre_y.between(F.col("c.y0"), F.col("c.y1"))
    return w.join(c, same & inside).select("w.doc_id", "w.page", "c.table_no", "c.row", "c.col", "w.text", F.col("w.x0").alias("x0"), F.col("w.y0").alias("y0"), F.col("w.y1").alias("y1"))


def characters_in_words(chars: DataFrame, words: DataFrame, slack: float = 0.5) -> DataFrame:
    """Characters with the word of the same top whose x range holds them, give or take."""
    top = lambda s: F.bround(F.col(f"{s}.y0"), 1)
    c, w = chars.alias("c"), words.alias("w")
    same = (F.col("c.doc_id") == F.col("w.doc_id")) & (F.col("c.page") == F.col("w.page")) & (top("c") == top("w"))
    inside = (F.col("c.x0") >= F.col("w.x0") - slack) & (F.col("c.x1") <= F.col("w.x1") + slack)
    return c.join(w, same & inside).select("c.doc_id", "c.page", F.col("w.ord").alias("word"), F.col("c.text").alias("char"), F.col("c.x0").alias("x0"), F.col("c.x1").alias("x1"))


def cell_text(words: Column) -> Column:
    """Words of a cell (WORD) in reading order: lines by vertical overlap, then by x.

    A word is on a line if it overlaps what the line's words have in common by over half of
    the shorter height.
    """
    line = "struct<top:double,bottom:double,words:array<struct<x0:double,text:string>>>"

    def step(s: Column, w: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        shared = F.least(last.bottom, w.bottom) - F.greatest(last.top, w.top)
        on = shared > 0.5 * F.least(last.bottom - last.top, w.bottom - w.top)
        one = F.array(F.struct(w.x0.alias("x0"), w.text.alias("text")))
        grown = F.struct(F.greatest(last.top, w.top).alias("top"), F.least(last.bottom, w.bottom).alias("bottom"), F.concat(last.words, one).alias("words")).cast(line)
        fresh = F.struct(w.top.alias("top"), w.bottom.alias("bottom"), one.alias("words")).cast(line)
        return F.when((F.size(s) > 0) & on, F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(s, F.array(fresh)))

    folded = F.aggregate(F.sort_array(words.cast(WORD)), F.array().cast(f"array<{line}>"), step)
    return F.array_join(F.transform(folded, lambda x: F.array_join(F.sort_array(x.words)["text"], " ")), " ")


def filled(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, rows): every cell with its words, empty cells kept."""
    held = words_in_cells(words, cells).groupBy("doc_id", "page", "table_no", "row", "col")
    texts = held.agg(cell_text(F.collect_list(F.struct(F.col("y0").alias("top"), "x0", F.col("y1").alias("bottom"), "text"))).alias("text"))
    every = cells.select("doc_id", "page", "table_no", "row", "col").join(texts, ["doc_id", "page", "table_no", "row", "col"], "left")
    rows = every.groupBy("doc_id", "page", "table_no", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text"))))["text"].alias("cells"))
    return rows.groupBy("doc_id", "page", "table_no").agg(F.sort_array(F.collect_list(F.struct("row", "cells")))["cells"].alias("rows"))


def splice(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with the words inside a table's box replaced by the table, at the first one's place."""
    b, t = blocks.alias("b"), tables.alias("t")
    centre_x, centre_y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page")) & centre_x.between(F.col("t.x0"), F.col("t.x1")) & centre_y.between(F.col("t.y0"), F.col("t.y1"))
    rest = b.join(t, inside, "left_anti").select("doc_id", "page", "ord", F.lit("para").alias("kind"), "text")
    placed = t.join(b, inside).groupBy("t.doc_id", "t.page", "t.table_no").agg(F.min("b.ord").alias("ord"), F.first("t.text").alias("text"))
    return rest.unionByName(placed.select("doc_id", "page", "ord", F.lit("table").alias("kind"), "text"))


def worth_rendering(rows: Column, basis: Column) -> Column:
    """Ruled tables of at least two rows and two columns."""
    return (basis == "ruled") & (F.size(rows) >= 2) & (F.array_max(F.transform(rows, lambda r: F.size(r))) >= 2)


def without_blank_rows(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(c) != ""))


def confident(tables: DataFrame, least: float = 0.0) -> DataFrame:
    return tables.where(F.col("confidence") >= least)


def by_basis(tables: DataFrame) -> DataFrame:
    return tables.groupBy("doc_id", "basis").agg(F.count("*").alias("tables"))


def first_table_pages(pages: list[int], budget: Budget = Budget()) -> tuple[list[int], bool]:
    """The pages that one request may look at for tables, and whether all were admitted."""
    return pages[: budget.table_pages], len(pages) <= budget.table_pages
