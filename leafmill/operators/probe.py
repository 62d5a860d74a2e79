"""probe: what a document is, from one aggregate over its pages; and what a request would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import ir
from leafmill.budget import CHARS_A_TOKEN, Budget, pages_that_fit, tokens
from leafmill.selection import page_ranges

STRIDED = 8


def page_size_mode(pages: DataFrame) -> DataFrame:
    """(doc_id, width, height, n_pages, other_pages): the most common size, the first seen of equals."""
    sizes = pages.groupBy("doc_id", "width", "height").agg(F.count("*").alias("n_pages"), F.min("page").alias("seen"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n_pages"), "seen")
    mode = sizes.withColumn("place", F.row_number().over(order)).where("place = 1").select("doc_id", "width", "height", "n_pages")
    m = mode.select("doc_id", F.col("width").alias("w"), F.col("height").alias("h"))
    other = pages.join(m, "doc_id").where(~(F.col("width").eqNullSafe(F.col("w")) & F.col("height").eqNullSafe(F.col("h"))))
    return mode.join(page_ranges(other, ["doc_id"]).withColumnRenamed("pages", "other_pages"), "doc_id", "left").withColumn("other_pages", F.coalesce("other_pages", F.lit("")))


def probe(pages: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """One row per document. pages: doc_id, page, text, basis, has_content."""
    kind = ir.page_kind(F.col("basis"), F.col("has_content"))
    marked = pages.select("doc_id", "page", F.length("text").cast("long").alias("chars"), "basis", kind.alias("kind"))
    whole = marked.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.sum("chars").alias("characters"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("born_digital", "scanned", "empty")],
        ir.agreed(F.col("basis")).alias("agreed_basis"),
    )
    extractable = F.when(F.col("born_digital") == F.col("pages"), "full").when(F.col("born_digital") == 0, "none").otherwise("partial")
    basis = F.when(F.col("born_digital") + F.col("scanned") == 0, "empty").otherwise(F.col("agreed_basis"))
    whole = whole.select(
        "doc_id", "pages", "characters", "born_digital", "scanned", "empty", extractable.alias("extractable"), basis.alias("basis"),
        tokens(F.col("characters")).alias("token_estimate_full"), pages_that_fit(F.col("characters"), F.col("pages"), budget).alias("pages_that_fit_one_response"),
    )
    for name, some in (("scanned_pages", marked.where("kind <> 'born_digital'")), ("digital_pages", marked.where("kind = 'born_digital'"))):
        ranges = page_ranges(some, ["doc_id"]).withColumnRenamed("pages", name)
        whole = whole.join(ranges, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return whole


def sampled_tokens(pages: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """keys + (n_pages, sampled, estimate): mean length of at most STRIDED strided pages, times pages."""
    order = Window.partitionBy(*keys).orderBy("page")
    ranked = pages.select(*keys, F.length("text").alias("chars"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    step = F.greatest(F.floor(F.col("n") / STRIDED), F.lit(1))
    some = ranked.where((F.col("i") % step == 0) & (F.col("i") < step * STRIDED))
    sums = some.groupBy(*keys).agg(F.max("n").alias("n_pages"), F.count("*").alias("sampled"), F.sum("chars").cast("long").alias("chars"))
    return sums.select(*keys, "n_pages", "sampled", F.floor(F.col("chars") / F.col("sampled") * F.col("n_pages") / CHARS_A_TOKEN).cast("long").alias("estimate"))


def admission(pages: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Per document: whether a whole extract is admitted, and the longest prefix of pages that fits.

    The prefix is exact: a running sum, where estimating again and again would only come near.
    """
    order = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    upto = pages.select("doc_id", "page", F.sum(F.length("text").cast("long")).over(order).alias("upto"))
    fits = upto.groupBy("doc_id").agg(F.min("page").alias("first"), F.max(F.when(tokens(F.col("upto")) <= budget.response_tokens, F.col("page"))).alias("last"))
    joined = sampled_tokens(pages).join(fits, "doc_id")
    admitted = F.col("estimate") <= budget.response_tokens
    said: Column = F.when(admitted, "").otherwise(F.concat_ws("-", "first", F.coalesce("last", "first")))
    return joined.select("doc_id", "n_pages", "estimate", admitted.alias("admitted"), said.alias("suggested_pages"))
