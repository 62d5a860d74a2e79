"""Benchmark decontamination by winnowing. DataFrame functions only.

A window is 13 consecutive words and holds nine 5-word grams. Of each window the least gram hash
is kept; neighbouring windows mostly keep the same one, so a text is left with one fingerprint
for each run of windows, about one in five words. Equal windows have equal fingerprints: every
shared span of 13 words is found. Fingerprints of documents and benchmark are joined, and a hit
is extended to the windows of its run, which are compared as text.

Defined cases: null or wordless texts have no words and no hits; an item with 1 to 12 words is
one window, whose fingerprint is the hash of its words; null item ids are left out of the
digest's ids; rows that share a doc_id are judged each by its own text; repeated rows repeat
their row; extra columns of either table are ignored, by clean() kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Folder, ascii_lower, free_names, version_of

#: Everything but 0-9, a-z and what lies beyond ASCII parts words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 5
#: At most so many fingerprints, of 12 bytes each, are broadcast; more are shuffled.
BROADCAST_PRINTS = 1_000_000


def words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_ANY_CASE, -1), "")


def _hashed(found: Column) -> Column:
    # Full lower-casing can only add candidates: the windows are compared as text later.
    return F.transform(found, lambda w: F.xxhash64(F.lower(w)))


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of all n-word grams in order; none if there are fewer words."""
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))


def _least(grams: Column, n: int) -> Column:
    """The least of every n neighbours."""
    starts = F.when(F.size(grams) >= n, F.sequence(F.lit(0), F.size(grams) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.least(*[F.get(grams, i + j) for j in range(n)]))


def _prints(texts: DataFrame, spans: list[int], span: int, gram: int) -> DataFrame:
    """texts (.., hash) with prints: array of (span, low, high, print), a run of windows each."""
    texts = texts.withColumn("grams", _grams(F.col("hash"), gram)) if span in spans else texts.withColumn("grams", F.array().cast("array<long>"))
    texts = texts.withColumn("minima", _least(F.col("grams"), span - gram + 1))
    at = F.transform("minima", lambda p, i: F.when((i == 0) | (p != F.get("minima", i - 1)), i))
    texts = texts.withColumn("at", F.filter(at, lambda i: i.isNotNull()))
    run = lambda i, k: F.struct(F.lit(span).alias("span"), i.alias("low"), (F.coalesce(F.get("at", k + 1), F.size("minima")) - 1).alias("high"), F.get("minima", i).alias("print"))

    def short(n: int) -> Column:
        return F.transform(_grams(F.col("hash"), n), lambda p, i: F.struct(F.lit(n).alias("span"), i.alias("low"), i.alias("high"), p.alias("print")))

    return texts.withColumn("prints", F.concat(F.transform("at", run), *[short(n) for n in spans if n < span])).drop("hash", "grams", "minima", "at")


def _windows(texts: DataFrame) -> DataFrame:
    """Rows (.., word, span, low, high) to one row per window: (.., span, at, window)."""
    keep = [c for c in texts.columns if c not in ("word", "low", "high")]
    texts = texts.select(*keep, "word", F.explode(F.sequence("low", "high")).alias("at"))
    return texts.select(*keep, "at", ascii_lower(F.concat_ws(" ", F.expr("slice(word, at + 1, span)"))).alias("window"))


def item_windows(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(window, span, print, items): each distinct window with the items that hold it."""
    read = benchmark.select("item_id", words(F.col("text")).alias("word")).where(F.size("word") > 0)
    read = _prints(read.withColumn("hash", _hashed(F.col("word"))), list(range(1, span + 1)), span, gram)
    # A shorter item is one window, its whole; a longer one has windows of the full span only.
    own = F.filter("prints", lambda x: x.span == F.least(F.size("word"), F.lit(span)))
    made = _windows(read.select("item_id", "word", F.explode_outer(own).alias("x")).select("item_id", "word", "x.*").where("print is not null"))
    return made.groupBy("window", "span").agg(F.first("print").alias("print"), F.collect_set(F.col("item_id").cast("string")).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Hits (doc_id, version, at, span, window, items): every window of an item in a document."""
    folder = Folder(docs.sparkSession, "benchmark")
    items = folder.keep("items", item_windows(benchmark, span, gram))
    prints = folder.keep("prints", items.select("span", "print").distinct())
    # As many rows as there are lengths: span at most.
    spans = {r["span"]: r["n"] for r in prints.groupBy("span").agg(F.count("*").alias("n")).collect()}
    words_of = docs.select("doc_id", version_of(F.col("text")).alias("version"), words(F.col("text")).alias("word"))
    read = _prints(words_of.withColumn("hash", _hashed(F.col("word"))), sorted(spans), span, gram)
    # Outer, as a filter on the prints that Spark would infer nests all their folds in one; null joins nothing.
    found = ["doc_id", "version", "span", "low", "high"]
    if sum(spans.values()) <= BROADCAST_PRINTS:
        near = read.select("doc_id", "version", "word", F.explode_outer("prints").alias("x")).select("doc_id", "version", "word", "x.*")
        near = near.join(F.broadcast(prints), ["span", "print"], "left_semi").select(*found, "word")
    else:
        near = read.select("doc_id", "version", F.explode_outer("prints").alias("x")).select("doc_id", "version", "x.*")
        near = near.join(prints, ["span", "print"], "left_semi").groupBy("doc_id", "version").agg(F.collect_set(F.struct("span", "low", "high")).alias("runs"))
        a, b = words_of.alias("a"), near.alias("b")
        near = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version")))
        near = near.select("a.doc_id", "a.version", "word", F.explode("runs").alias("x")).select("doc_id", "version", "x.*", "word")
    return _windows(near).join(items.select("window", "span", "items"), ["window", "span"])


def judge(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least one in `share` of its words is hit.
    """
    return _judged(docs, benchmark, span, gram, share).drop("version")


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, share: int = 20) -> DataFrame:
    """docs without the contaminated ones."""
    id_, version = free_names(docs.columns, "doc", "version")
    bad = _judged(docs, benchmark, span, gram, share).where("contaminated").select(F.col("doc_id").alias(id_), F.col("version").alias(version)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(id_)) & (version_of(docs["text"]) == F.col(version)), "left_anti")


def _judged(docs: DataFrame, benchmark: DataFrame, span: int, gram: int, share: int) -> DataFrame:
    hits = find(docs, benchmark, span, gram)
    before = Window.partitionBy("doc_id", "version").orderBy("at", "span").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("at") + F.col("span") - F.greatest(F.col("at"), F.coalesce(F.max(F.col("at") + F.col("span")).over(before), F.lit(0)))
    covered = hits.withColumn("fresh", F.greatest(fresh, F.lit(0)).cast("long"))
    per_doc = covered.groupBy("doc_id", "version").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    all_docs = docs.select("doc_id", version_of(F.col("text")).alias("version"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = all_docs.alias("a").join(per_doc.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "a.doc_id", "a.version", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
