"""Outlines and Markdown: declared headings first, else headings by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.tables import worth_rendering

LARGER, LARGEST, HEADING_CHARS = 1.15, 1.5, 120


def upper_median(sizes: Column) -> Column:
    """The value at n // 2 of the sorted non-zero sizes (not percentile(): it differs for even n)."""
    kept = F.array_sort(F.filter(sizes, lambda s: s > 0))
    return F.when(F.size(kept) > 0, F.try_element_at(kept, F.floor(F.size(kept) / 2).cast("int") + 1))


def inferred_headings(lines: DataFrame, distinct: bool = False) -> DataFrame:
    """(doc_id, page, line, level, title) by size: over 1.15 x the median and not long.

    distinct: the median is taken over distinct lines, the last size of each.
    """
    sized = lines.where(F.col("size") > 0).withColumn("title", T.strip(F.col("text")))
    if distinct:
        some = sized.groupBy("doc_id", "title").agg(F.max_by("size", F.struct("page", "line")).alias("size"))
    else:
        some = sized
    median = some.groupBy("doc_id").agg(upper_median(F.collect_list("size")).alias("median"))
    joined = sized.join(median, "doc_id")
    larger = (F.col("size") > LARGER * F.col("median")) & (F.length("title") <= HEADING_CHARS) & (F.col("title") != "")
    return joined.where(larger).select("doc_id", "page", "line", F.when(F.col("size") >= LARGEST * F.col("median"), 1).otherwise(2).alias("level"), "title")


def outline(blocks: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, level, title, page, basis): declared headings and bookmarks, else inferred ones."""
    declared = blocks.where("kind = 'heading'").select("doc_id", F.coalesce("level", F.lit(1)).alias("level"), F.col("text").alias("title"), "page", F.lit("native").alias("basis"))
    if "meta" in blocks.columns:
        marks = F.from_json(F.first(F.col("meta")["bookmarks"], ignorenulls=True), "array<struct<level:int,title:string,page:int>>")
        marked = blocks.groupBy("doc_id").agg(marks.alias("marks")).select("doc_id", F.inline("marks"))
        declared = declared.unionByName(marked.select("doc_id", "level", "title", "page", F.lit("tagged").alias("basis")))
    if lines is None:
        return declared
    guessed = inferred_headings(lines).join(declared.select("doc_id").distinct(), "doc_id", "left_anti")
    return declared.unionByName(guessed.select("doc_id", "level", "title", "page", F.lit("font_size").alias("basis")))


def mark_headings(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """lines with "#" before those whose text is a declared title; of equal titles the last level counts."""
    levels = declared.groupBy("doc_id", F.col("title").alias("__title")).agg(F.max_by("level", F.struct("page", "ord")).alias("__level"))
    marked = lines.withColumn("__title", T.strip(F.col("text"))).join(levels, ["doc_id", "__title"], "left")
    text = F.when(F.col("__level").isNotNull(), F.concat(T.heading_mark(F.col("__level")), F.lit(" "), F.col("__title"))).otherwise(F.col("text"))
    return marked.withColumn("text", text).drop("__title", "__level")


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks as Markdown wants them: headings inferred by size where a document declares none,
    and a ruled table in place of the lines inside its box. Tables that gaps suggest are left out."""
    headed = blocks.where("kind = 'heading'").select("doc_id").distinct()
    guessed = inferred_headings(blocks.where("size > 0").select("doc_id", "page", F.col("ord").alias("line"), "text", "size")).join(headed, "doc_id", "left_anti")
    guessed = guessed.select("doc_id", "page", F.col("line").alias("ord"), F.col("level").alias("__level"))
    marked = blocks.join(guessed, ["doc_id", "page", "ord"], "left")
    said = F.col("__level").isNotNull()
    marked = marked.withColumn("kind", F.when(said, "heading").otherwise(F.col("kind"))).withColumn("level", F.coalesce("__level", "level")).drop("__level")
    # A reader's table without text stands beside the lines that it is made of.
    apart = (F.col("kind") == "table") & (F.col("text") == "") & F.col("bbox").isNotNull()
    drawn = marked.where(apart & worth_rendering(F.col("rows"), F.col("basis"))).select("doc_id", "page", F.col("bbox").alias("box"))
    boxes = drawn.groupBy("doc_id", "page").agg(F.collect_list("box").alias("boxes"))
    x, y = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    held = lambda b: x.between(b.x0, b.x1) & y.between(b.y0, b.y1)
    lines = marked.where(~apart).join(boxes, ["doc_id", "page"], "left")
    inside = F.coalesce(F.exists("boxes", held), F.lit(False)) & F.col("bbox").isNotNull()
    # The table takes the place of its first line.
    at = lines.where(inside).select("doc_id", "page", "ord", F.explode(F.filter("boxes", held)).alias("box")).groupBy("doc_id", "page", "box").agg(F.min("ord").alias("at"))
    kept = lines.where(~inside).drop("boxes")
    shown = marked.where(apart & worth_rendering(F.col("rows"), F.col("basis"))).withColumn("box", F.col("bbox")).join(at, ["doc_id", "page", "box"], "left")
    shown = shown.withColumn("ord", F.coalesce("at", "ord")).drop("at", "box")
    return kept.unionByName(shown.select(*kept.columns))


def block_markdown(kind: Column, text: Column, level: Column, rows: Column) -> Column:
    """One block in Markdown."""
    return (
        F.when((kind == "heading") & (T.strip(text) != ""), F.concat(T.heading_mark(F.coalesce(level, F.lit(1))), F.lit(" "), T.collapse(text)))
        .when((kind == "table") & rows.isNotNull(), T.pipe_table(rows))
        .when(kind == "list", F.concat(F.lit("- "), text))
        .otherwise(text)
    )


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown, characters, headings, tables): headings counts lines that start with "#"."""
    drawn = blocks.select("doc_id", "page", "ord", "kind", block_markdown(F.col("kind"), F.col("text"), F.col("level"), F.col("rows")).alias("md"))
    whole = drawn.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "ord", "md"))).alias("b"), F.count_if(F.col("kind") == "table").alias("tables"))
    text = F.array_join(F.filter(F.col("b")["md"], lambda m: m != ""), "\n\n")
    return whole.select("doc_id", text.alias("markdown"), "tables").select(
        "doc_id", "markdown", F.length("markdown").cast("long").alias("characters"), F.regexp_count("markdown", F.lit("(?m)^#")).cast("long").alias("headings"), "tables"
    )
