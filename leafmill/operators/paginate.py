"""Synthetic pages of flow formats: blocks are packed in order, big ones split at line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.budget import Budget

LIMIT = Budget().chars_a_page


def packed(sizes: Column, limit: int = LIMIT) -> Column:
    """Page of each size: a page is closed when the next size would pass the limit."""

    def step(s: Column, n: Column) -> Column:
        over = (s.used > 0) & (s.used + n > limit)
        first = F.when(over, F.concat(s.first, F.array(s.at))).otherwise(s.first)
        return F.struct(first.alias("first"), (s.at + 1).alias("at"), F.when(over, n).otherwise(s.used + n).alias("used"))

    # Only the first block of each page is collected; pages are many blocks long.
    begin = F.struct(F.array(F.lit(0)).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("used"))

    def spread(s: Column) -> Column:
        ends = lambda k: F.coalesce(F.get(s.first, k + 1), s.at)
        return F.flatten(F.transform(s.first, lambda b, k: F.array_repeat(k + 1, ends(k) - b)))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("int")), begin, step, spread)


def hard_cut(line: Column, limit: int = LIMIT) -> Column:
    """A line in pieces of at most the limit."""
    n = F.greatest(F.ceil(F.length(line) / limit).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(line, i * limit + 1, F.lit(limit)))


def split_block(text: Column, limit: int = LIMIT) -> Column:
    """A block in pieces of at most the limit, cut at line ends where there are any."""
    parts = F.flatten(F.transform(F.split(text, "\n", -1), lambda x: F.transform(hard_cut(x, limit), lambda p, i: F.struct(p.alias("text"), (i > 0).alias("glued")))))

    def step(s: Column, p: Column) -> Column:
        mark = F.when(p.glued, F.lit("")).otherwise(F.lit("\n"))
        fits = F.length(s.now) + F.length(mark) + F.length(p.text) <= limit
        first = s.now.isNull()
        done = F.when(first | fits, s.done).otherwise(F.concat(s.done, F.array(s.now)))
        now = F.when(first, p.text).when(fits, F.concat(s.now, mark, p.text)).otherwise(p.text)
        return F.struct(done.alias("done"), now.alias("now"))

    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    whole = F.aggregate(parts, begin, step, lambda s: F.concat(s.done, F.array(s.now)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(whole)


def paginate(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Blocks (doc_id, ord, kind, text) with their page; a document without text has one empty page."""
    pieces = blocks.select("doc_id", "ord", "kind", F.posexplode(split_block(F.coalesce("text", F.lit("")), limit)).alias("piece", "text"))
    listed = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "piece", "kind", "text"))).alias("b"))
    listed = listed.withColumn("page", packed(F.transform("b", lambda x: F.length(x.text)), limit))
    return listed.select("doc_id", F.posexplode(F.arrays_zip("b", "page")).alias("i", "x")).select("doc_id", F.col("x.page").alias("page"), (F.col("i") + 1).alias("ord"), "x.b.kind", "x.b.text")


def page_texts(paged: DataFrame) -> DataFrame:
    """(doc_id, page, text): blocks of a page joined by line ends."""
    listed = paged.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return listed.select("doc_id", "page", F.array_join(F.col("b")["text"], "\n").alias("text"))
