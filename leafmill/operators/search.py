"""find: literal search in native expressions, patterns in a guarded Python table function.

A user's pattern never runs in the JVM, where nothing can interrupt it: CPython's matcher
polls for signals, so a timer ends it.
"""

from __future__ import annotations

import re
import signal
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill import ir
from leafmill.budget import Budget
from leafmill.functions import text as T
from leafmill.selection import page_ranges

AROUND = 60


class PatternError(ValueError):
    """A pattern that can't be used; hint says why."""

    def __init__(self, error: str, hint: str):
        super().__init__(error)
        self.hint = hint


class PatternTimeout(RuntimeError):
    """A pattern that took longer than its budget."""


def compiled(pattern: str) -> re.Pattern:
    if not pattern:
        raise PatternError("the query is empty", "give a text or a pattern")
    try:
        return re.compile(pattern, re.IGNORECASE | re.MULTILINE)
    except re.error as bad:
        raise PatternError(f"the pattern can't be read: {bad}", "escape ( ) [ ] { } . * + ? ^ $ | \\ or search literally") from None


class deadline:
    """Seconds that the matches inside may take together; needs the worker's main thread."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def __enter__(self):
        def late(*_):
            raise PatternTimeout(f"the pattern took more than {self.seconds:g} seconds")

        self.before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, max(self.seconds, 1e-3))

    def __exit__(self, *_):
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, self.before)


def match_rows(text: str | None, found: re.Pattern) -> Iterator[tuple]:
    """(line, start, end, snippet, groups) of each match in one page."""
    text = text or ""
    line, upto = 1, 0
    for m in found.finditer(text):
        line, upto = line + text.count("\n", upto, m.start()), m.start()
        low, high = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        cut = text[low:high].replace("\n", " ").strip()
        snippet = ("…" if low else "") + cut + ("…" if high < len(text) else "")
        yield line, m.start(), m.end(), snippet, {k: v for k, v in m.groupdict().items() if v is not None}


class FindMatches:
    """SQL: FROM pages, LATERAL find_matches(text, '(?P<user>...)@(?P<host>...)')."""

    def eval(self, text: str, pattern: str):
        with deadline(Budget().regex_seconds):
            rows = list(match_rows(text, compiled(pattern)))
        yield from rows


MATCH_ROW = "line int, start int, end int, snippet string, groups map<string,string>"
find_matches = F.udtf(FindMatches, returnType=MATCH_ROW)


def register(spark) -> None:
    """Make find_matches a table function of SQL."""
    spark.udtf.register("find_matches", find_matches)


def guarded_count(pattern: str, seconds: float | None = None):
    """A function of texts: how often a user's pattern matches, under the same timer as a search."""
    compiled(pattern)
    budget = seconds or Budget().regex_seconds

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        found, made = compiled(pattern), []
        for text in texts:
            with deadline(budget):
                made.append(sum(1 for _ in found.finditer(text or "")))
        return pd.Series(made, dtype="int64")

    return count


def searched(pages: DataFrame) -> DataFrame:
    """Pages that have text to search."""
    return pages.where(~ir.is_scanned(F.col("basis")))


def literal_matches(pages: DataFrame, query: str) -> DataFrame:
    """doc_id, page, line, start, end, snippet of a literal, case ignored. Native."""
    if not query:
        raise PatternError("the query is empty", "give a text or a pattern")
    hit = searched(pages).where(F.col("text").rlike(f"(?iu){T.literal(query)}"))
    at = hit.select("doc_id", "page", "text", F.explode(T.starts(F.col("text"), query)).alias("start"))
    end = F.col("start") + len(query)
    return at.select("doc_id", "page", T.line_number(F.col("text"), F.col("start")).alias("line"), "start", end.alias("end"), T.snippet(F.col("text"), F.col("start"), end, AROUND).alias("snippet"))


def pattern_matches(pages: DataFrame, pattern: str, seconds: float | None = None) -> DataFrame:
    """Matches of a pattern with its named groups; a page that exceeds the budget fails by name.

    The budget is a page's, so an honest pattern does not fail because a partition is large.
    """
    compiled(pattern)
    budget = seconds or Budget().regex_seconds

    def search(batches):
        found = compiled(pattern)
        for pdf in batches:
            rows = []
            for doc, page, text in zip(pdf["doc_id"], pdf["page"], pdf["text"]):
                with deadline(budget):
                    rows += [(doc, page, *m) for m in match_rows(text, found)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "line", "start", "end", "snippet", "groups"])

    return searched(pages).select("doc_id", "page", "text").mapInPandas(search, f"doc_id string, page int, {MATCH_ROW}")


def find(pages: DataFrame, query: str, regex: bool = False) -> DataFrame:
    return pattern_matches(pages, query) if regex else literal_matches(pages, query)


def totals(pages: DataFrame, query: str) -> DataFrame:
    """Per document: exact hits whatever the cap, pages with hits, pages searched and skipped."""
    scanned = ir.is_scanned(F.col("basis"))
    counted = pages.select("doc_id", "page", scanned.alias("scanned"), F.when(scanned, F.lit(0).cast("long")).otherwise(T.hits(F.col("text"), query)).alias("n"))
    sums = counted.groupBy("doc_id").agg(
        F.sum("n").alias("hits"),
        F.count_if(~F.col("scanned")).alias("pages_searched"),
        F.count_if("scanned").alias("pages_skipped_no_text"),
    )
    ranges = page_ranges(counted.where("n > 0"), ["doc_id"])
    return sums.join(ranges, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.lit("")))


def first_matches(matches: DataFrame, most: int = 50, budget: Budget = Budget()) -> DataFrame:
    """The first matches of each document in page order, with how many there are in all."""
    most = min(most, budget.most_matches)
    order = Window.partitionBy("doc_id").orderBy("page", "start")
    ranked = matches.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    cut = ranked.where(F.col("place") <= most)
    return cut.withColumn("returned", F.least(F.col("total"), F.lit(most))).withColumn("truncated", F.col("total") > most)


def passages(pages: DataFrame, patterns: DataFrame, gram: int = 8) -> DataFrame:
    """(item_id, doc_id, page): which passages of three words or more each page contains, character by character.

    Shorter ones are short_passages()'s. A passage is joined by the hash of its first `gram` words, whose places in a page are
    few, so pages and passages never meet all with all.
    """
    key = lambda words: F.xxhash64(words)
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    items = patterns.where(F.length(F.trim("text")) > 0).select("item_id", F.col("text").alias("passage"), split(F.col("text")).alias("w"))
    # The first and the last word may be parts of a page's word: they stay out of the key.
    items = items.withColumn("n", F.least(F.size("w") - 2, F.lit(gram)))
    inner = items.where("n >= 1").select("item_id", "passage", "n", key(F.slice("w", 2, F.col("n"))).alias("key"))
    sizes = [r["n"] for r in inner.select("n").distinct().collect()]  # at most `gram` numbers
    words = searched(pages).select("doc_id", "page", "text", split(F.col("text")).alias("w"))
    found = None
    for n in sizes:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1))
        grams = words.select("doc_id", "page", "w", F.explode(at).alias("at")).select("doc_id", "page", F.lit(n).alias("n"), key(F.slice("w", F.col("at"), n)).alias("key"))
        found = grams if found is None else found.unionByName(grams)
    if found is None:
        near = pages.select("doc_id", "page").limit(0).crossJoin(inner.select("item_id", "passage").limit(0))
    else:
        near = found.join(inner, ["n", "key"]).select("doc_id", "page", "item_id", "passage").distinct()
    texts = searched(pages).select("doc_id", "page", "text")
    return near.join(texts, ["doc_id", "page"]).where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id", "page")


def short_passages(pages: DataFrame, patterns: DataFrame, gram: int = 8) -> DataFrame:
    """(item_id, doc_id, page): which passages of one or two words each page contains, character by character.

    Both words may be parts of a page's words, so a passage is joined by its first `gram`
    characters; the pages are cut into characters only if there is such a passage.
    """
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    items = patterns.where((F.length(F.trim("text")) > 0) & (words <= 2)).select("item_id", F.col("text").alias("passage"))
    items = items.withColumn("n", F.least(F.length("passage"), F.lit(gram)))
    items = items.withColumn("key", F.xxhash64(F.substring(F.col("passage"), F.lit(1), F.col("n"))))
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # at most `gram` numbers
    texts = searched(pages).select("doc_id", "page", "text")
    near = pages.select("doc_id", "page").limit(0).crossJoin(items.select("item_id", "passage").limit(0))
    for n in sizes:
        at = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1))
        grams = texts.select("doc_id", "page", "text", F.explode(at).alias("at")).select("doc_id", "page", F.xxhash64(F.substring(F.col("text"), F.col("at"), F.lit(n))).alias("key"))
        near = near.unionByName(grams.join(items.where(F.col("n") == n), "key").select("doc_id", "page", "item_id", "passage"))
    return near.distinct().join(texts, ["doc_id", "page"]).where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id", "page")
