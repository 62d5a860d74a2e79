"""The engine's tables made from the driver's: documents as pages, lines, blocks and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import ir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is what a source has among a thousand ids, and each of its texts a page.

    There are more documents, not longer ones, the more texts there are.
    """
    read = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", F.expr("doc_id div 1000")).alias("volume"), "doc_id", "text")
    order = Window.partitionBy("volume").orderBy("doc_id")
    text = F.coalesce("text", F.lit(""))
    return read.select(F.col("volume").alias("doc_id"), F.row_number().over(order).alias("page"), text.alias("text"), ir.text_basis(text).alias("basis"), F.lit(False).alias("has_content"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of doc_pages()."""
    return doc_pages(spark, sf_dir).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is a document of one paragraph."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("ord"), F.lit("para").alias("kind"), "text")


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document and each turn a page."""
    read = table(spark, sf_dir, "conversations")
    return read.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit("native").alias("basis"), F.lit(False).alias("has_content"), F.lit(0).alias("rotation"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts: the part names the context, the supplier the unit."""
    read = table(spark, sf_dir, "lineitem")
    return read.select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact"),
        F.col("l_partkey").cast("string").alias("context_ref"), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey").cast("string")).alias("unit_ref"),
        F.col("l_quantity").cast("long").cast("string").alias("value"),
    )


def boxes(spark: SparkSession) -> DataFrame:
    """Two columns of 24 rows, four words wide, on one page; the left one is listed last."""
    grid = spark.range(0, 2 * 24 * 4).select(F.col("id").cast("int").alias("ord"), F.floor(F.col("id") / 96).cast("int").alias("side"), F.floor(F.col("id") % 96 / 4).cast("int").alias("r"), (F.col("id") % 4).cast("int").alias("k"))
    x0 = F.when(F.col("side") == 0, 330.0).otherwise(60.0) + F.col("k") * 55.0
    y0 = F.lit(110.0) + F.col("r") * 18.0
    text = F.concat(F.when(F.col("side") == 0, "R").otherwise("L"), "r", F.lit("w"), "k")
    return grid.select(F.lit("two_column").alias("doc_id"), F.lit(1).alias("page"), "ord", text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 50.0).alias("x1"), (y0 + 10.0).alias("y1"))


def cells(spark: SparkSession) -> DataFrame:
    """A ruled grid of 6 rows and 2 columns over the left column of boxes()."""
    grid = spark.range(0, 12).select(F.floor(F.col("id") / 2).cast("int").alias("row"), (F.col("id") % 2).cast("int").alias("col"))
    x0, y0 = F.lit(55.0) + F.col("col") * 110.0, F.lit(108.0) + F.col("row") * 36.0
    return grid.select(F.lit("two_column").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), "row", "col", x0.alias("x0"), y0.alias("y0"), (x0 + 110.0).alias("x1"), (y0 + 36.0).alias("y1"))


def found_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: the status names how a table was found."""
    read = table(spark, sf_dir, "orders")
    basis = F.when(F.col("o_orderstatus") == "F", "ruled").when(F.col("o_orderstatus") == "O", "whitespace").otherwise("native")
    return read.select((F.col("o_custkey") % 50).cast("string").alias("doc_id"), F.col("o_orderkey").alias("table_no"), basis.alias("basis")).withColumn("confidence", ir.confidence(F.col("basis")))
