"""Reading order from word boxes: baseline rows, gutters between columns, lines.

Boxes are (doc_id, page, ord, text, x0, y0, x1, y1), and the page's width if known, top-left
origin; a box without geometry
keeps the reader's order. Everything is partitioned by (doc_id, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the layout rules, in points or shares.
SAME_LINE, LEAST_BOXES, LEAST_ROWS, MOST_COLUMNS = 2.0, 40, 8, 3
GUTTER_SHARE, CROSSED_SHARE, FLANK_SHARE = 0.013, 0.12, 0.25
PAGE = ["doc_id", "page"]


def baseline_rows(boxes: DataFrame) -> DataFrame:
    """Positioned boxes with row: sorted by y then x, a row ends where y steps by over SAME_LINE."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord")
    step = F.abs(F.col("y0") - F.lag("y0").over(order)) > SAME_LINE
    return boxes.where("x0 IS NOT NULL").withColumn("row", F.sum(F.coalesce(step, F.lit(False)).cast("int")).over(order) + 1)


def _extent(rows: DataFrame) -> DataFrame:
    width = F.max("width") if "width" in rows.columns else F.lit(None).cast("double")
    whole = rows.groupBy(*PAGE).agg(width.alias("width"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.max("row").alias("n_rows"), F.count("*").alias("n_boxes"))
    # A share of the page's width; of what the words span where that is not known.
    across = F.coalesce("width", F.col("right") - F.col("left"))
    gutter = F.greatest(F.lit(2), F.floor(across * GUTTER_SHARE).cast("int"))
    return whole.withColumn("least", gutter).withColumn("flank", F.greatest(F.lit(2), F.floor(F.col("n_rows") * FLANK_SHARE).cast("int")))


def row_segments(rows: DataFrame) -> DataFrame:
    """(doc_id, page, row, segment, x0, x1): a row broken where a gap reaches the least gutter."""
    order = Window.partitionBy(*PAGE, "row").orderBy("x0", "ord")
    sized = rows.join(_extent(rows).select(*PAGE, "least"), PAGE)
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    broken = sized.withColumn("__new", F.coalesce(F.col("x0") - reach >= F.col("least"), F.lit(False)).cast("int"))
    numbered = broken.withColumn("segment", F.sum("__new").over(order) + 1)
    return numbered.groupBy(*PAGE, "row", "segment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def crossings(segments: DataFrame) -> DataFrame:
    """(doc_id, page, x, n): segments that cover each whole x."""
    at = F.explode(F.sequence(F.floor("x0").cast("int"), F.floor("x1").cast("int")))
    return segments.select(*PAGE, at.alias("x")).groupBy(*PAGE, "x").agg(F.count("*").alias("n"))


def gutters(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, low, high, middle) of the gaps that part columns."""
    rows = baseline_rows(boxes)
    extent, segments = _extent(rows).where((F.col("n_boxes") >= LEAST_BOXES) & (F.col("n_rows") >= LEAST_ROWS)), row_segments(rows)
    every = extent.select(*PAGE, "n_rows", "least", "flank", F.explode(F.sequence(F.floor("left").cast("int"), F.floor("right").cast("int"))).alias("x"))
    counted = every.join(crossings(segments), [*PAGE, "x"], "left")
    free = counted.withColumn("free", F.coalesce("n", F.lit(0)) <= F.col("n_rows") * CROSSED_SHARE)
    order = Window.partitionBy(*PAGE).orderBy("x")
    # A run keeps its number while x is free; one that reaches the last x is never closed.
    runs = free.withColumn("run", F.sum((~F.col("free")).cast("int")).over(order)).withColumn("end", F.max("x").over(Window.partitionBy(*PAGE)))
    runs = runs.where("free").groupBy(*PAGE, "run", "least", "flank", "end").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    runs = runs.where((F.col("high") < F.col("end")) & (F.col("high") - F.col("low") + 1 >= F.col("least")))
    sided = runs.join(segments, PAGE).groupBy(*PAGE, "low", "high", "flank").agg(
        F.count_distinct(F.when(F.col("x1") <= F.col("low"), F.col("row"))).alias("on_left"),
        F.count_distinct(F.when(F.col("x0") >= F.col("high") + 1, F.col("row"))).alias("on_right"),
    )
    flanked = sided.where((F.col("on_left") >= F.col("flank")) & (F.col("on_right") >= F.col("flank")))
    return flanked.select(*PAGE, "low", "high", ((F.col("low") + F.col("high") + 1) / 2).alias("middle"))


def columns(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, columns, looks_tabular, cuts): more than MOST_COLUMNS columns are a table."""
    found = gutters(boxes).groupBy(*PAGE).agg(F.sort_array(F.collect_list("middle")).alias("cuts"))
    n = F.coalesce(F.size("cuts"), F.lit(0)) + 1
    paged = boxes.select(*PAGE).distinct().join(found, PAGE, "left")
    tabular = n > MOST_COLUMNS
    empty = F.array().cast("array<double>")
    return paged.select(*PAGE, F.when(tabular, 1).otherwise(n).alias("columns"), tabular.alias("looks_tabular"), F.when(tabular, empty).otherwise(F.coalesce("cuts", empty)).alias("cuts"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes with column and position: by column, y to a tenth, x; boxes without geometry last."""
    placed = boxes.join(columns(boxes).select(*PAGE, "cuts"), PAGE)
    middle = (F.col("x0") + F.col("x1")) / 2
    column = F.when(F.col("x0").isNull(), F.size("cuts")).otherwise(F.size(F.filter("cuts", lambda c: middle >= c))) + 1
    placed = placed.withColumn("column", column)
    order = Window.partitionBy(*PAGE).orderBy("column", F.col("x0").isNull(), F.bround("y0", 1), "x0", "ord")
    return placed.withColumn("position", F.row_number().over(order)).drop("cuts")


def lines(ordered: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, size) in the order given; without any geometry a block is a line."""
    page, order = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("position")
    placed = F.max(F.col("x0").isNotNull()).over(page)
    step = F.abs(F.col("y0") - F.lag("y0").over(order)) > SAME_LINE
    new = F.when(placed, F.coalesce(step, F.lag("position").over(order).isNotNull() & F.col("y0").isNull())).otherwise(F.lag("position").over(order).isNotNull())
    numbered = ordered.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("line", F.sum("__new").over(order) + 1)
    size: Column = F.col("size") if "size" in ordered.columns else F.lit(0.0)
    listed = numbered.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("w"), F.max(size).alias("size"))
    return listed.select(*PAGE, "line", F.array_join(F.col("w")["text"], " ").alias("text"), "size")
