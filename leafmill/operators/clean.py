"""Cleaning of extracted lines: running heads, hyphens, blanks, characters - in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

#: A head stands on at least this share of the pages, of documents with so many pages.
HEAD_SHARE, HEAD_PAGES = 0.6, 4


def edge_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line, text) that stand first or last on their page."""
    page = Window.partitionBy("doc_id", "page")
    marked = lines.withColumn("__first", F.min("line").over(page)).withColumn("__last", F.max("line").over(page))
    return marked.withColumn("is_edge", (F.col("line") == F.col("__first")) | (F.col("line") == F.col("__last"))).drop("__first", "__last")


def running_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, shape, n_pages, total_pages, is_head) of every shape that an edge line has.

    pages holds every page, so that pages without text stay in the denominator.
    """
    edges = edge_lines(lines).where("is_edge").select("doc_id", "page", T.shape(F.col("text")).alias("shape")).where("shape <> ''")
    counts = edges.distinct().groupBy("doc_id", "shape").agg(F.count("*").alias("n_pages"))
    totals = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("total_pages"))
    joined = counts.join(totals, "doc_id")
    is_head = (F.col("total_pages") >= HEAD_PAGES) & (F.col("n_pages") >= HEAD_SHARE * F.col("total_pages"))
    return joined.withColumn("is_head", is_head)


def strip_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines without the running heads at the edges of their pages."""
    heads = running_heads(lines, pages).where("is_head").select("doc_id", F.col("shape").alias("__shape"))
    marked = edge_lines(lines).withColumn("__shape", F.when(F.col("is_edge"), T.shape(F.col("text"))))
    return marked.join(heads, ["doc_id", "__shape"], "left_anti").drop("__shape", "is_edge")


def _bound(value: Column, made) -> Column:
    """made(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), made), 1)


def join_hyphens(found: Column) -> Column:
    """Lines with words joined that a hyphen broke: struct(lines, joined).

    A line that ends in a word and a hyphen takes the next line, or the one behind a single
    blank, if it starts with a small letter. The joined line is not looked at again. Time is
    linear in the lines: no step copies what the steps before it made.
    """
    item = lambda c, i: F.get(c, i)
    broken = lambda x: T.rstrip(x).rlike(r"(?U)\w-\z")
    lstrip = lambda x: F.regexp_replace(x, rf"(?U)^{T.BLANK}+", "")

    def linked(said: Column) -> Column:
        """Per line with text, "1" if the one before it could take it."""

        def one(s: Column, k: Column) -> Column:
            before = item(said, k - 1)
            return F.when((k > 0) & s.x.rlike(r"^\p{IsLowercase}") & (s.i - before.i <= 2) & broken(before.x), "1").otherwise("0")

        return F.array_join(F.transform(said, one), "")

    def whole(lines: Column, said: Column, taken: Column) -> Column:
        is_taken = lambda k: F.coalesce(item(taken, k) == "1", F.lit(False))

        def one(s: Column, k: Column) -> Column:
            behind = F.slice(lines, s.i + 2, F.coalesce(item(said, k + 1).i, F.size(lines)) - s.i - 1)
            joined = F.concat(F.regexp_replace(T.rstrip(s.x), "-$", ""), lstrip(item(said, k + 1).x))
            return F.when(is_taken(k), behind).when(is_taken(k + 1), F.array(joined)).otherwise(F.concat(F.array(s.x), behind))

        head = F.slice(lines, 1, F.coalesce(item(said, F.lit(0)).i, F.size(lines)))
        every = F.concat(head, F.flatten(F.transform(said, one)))
        return F.struct(every.alias("lines"), F.size(F.filter(taken, lambda t: t == "1")).alias("joined"))

    def made(lines: Column) -> Column:
        said = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~T.is_blank(s.x))
        # Of lines in a row that could each be taken, every second one is: what is taken takes nothing.
        taken = lambda w: F.split(F.regexp_replace(linked(w), "11", "10"), "")
        return _bound(said, lambda w: _bound(taken(w), lambda t: whole(lines, w, t)))

    return _bound(found, made)


def collapse_blanks(found: Column) -> Column:
    """Lines stripped, blanks inside them squeezed, blank lines in a row made one, none at the ends."""
    squeezed = F.transform(found, lambda x: T.strip(F.regexp_replace(x, "[ \t]+", " ")))
    whole = F.array_join(squeezed, "\n")
    return F.split(F.regexp_replace(F.regexp_replace(whole, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", ""), "\n", -1)


def clean(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: cleaned text, whether heads were checked, and what was changed."""
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("before"))
    kept = strip_heads(lines, pages)
    by_page = kept.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    every = pages.select("doc_id", "page").distinct().join(by_page, ["doc_id", "page"], "left")
    texts = F.concat(F.coalesce(F.col("l")["text"], F.array().cast("array<string>")), F.array(F.lit("")))
    paged = every.select("doc_id", F.struct("page", texts.alias("text"), F.coalesce(F.size("l"), F.lit(0)).alias("n")).alias("p"))
    whole = paged.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    whole = whole.select("doc_id", F.size("p").alias("n_pages"), F.flatten(F.col("p")["text"]).alias("all"), F.aggregate(F.col("p")["n"], F.lit(0), lambda s, n: s + n).alias("left"))
    whole = whole.withColumn("j", join_hyphens(F.col("all"))).withColumn("raw", F.array_join(collapse_blanks(F.col("j.lines")), "\n"))
    return whole.join(counted, "doc_id", "left").select(
        "doc_id",
        T.normalised(F.col("raw")).alias("text"),
        (F.col("n_pages") >= HEAD_PAGES).alias("running_heads_checked"),
        (F.coalesce("before", F.lit(0)) - F.col("left")).cast("long").alias("running_heads_removed"),
        F.col("j.joined").cast("long").alias("hyphens_joined"),
        T.replaced_count(F.col("raw")).alias("unicode_fixed"),
    )
