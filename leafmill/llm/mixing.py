"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of at most BLOCK_WORDS words. In each epoch a keyed hash
permutes a source's blocks; whole epochs take them all, a last one takes the prefix whose
words come nearest the target. That gives an exact quota of blocks per source. A tree splits
the quotas among output shards: at each node the left half's share of every source is one
multivariate hypergeometric draw. A shard then owns disjoint ranges of the permutations and
orders its blocks by another keyed hash. Every draw depends on the seed and on the rows
alone, so reruns agree.

Defined cases: a null or blank text has size 0 and is taken 0 times; the null source is a
source, last in order; a source without words has target 0; rows that repeat a document are
documents of their own; a table without rows gives none; extra columns are ignored (by
materialize(): kept).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import BLANK_WORD, cut, free_names, version_of

BLOCK_WORDS, MOST_EPOCHS, SEED = 256, 3, 17
#: Words in an output shard, at least; and cells of the table of shards by sources, which the driver
#: holds. A mix with more has larger shards; what it takes of a document is the same.
SHARD_WORDS, TABLE_CELLS = 250_000, 8_000_000
#: Blocks that share a bucket of a permutation, about, and most buckets of one permutation.
BUCKET_BLOCKS, MOST_BUCKET_BITS = 512, 16
#: Sources are collected to the driver; a table with more distinct ones is refused.
MOST_SOURCES = 100_000
#: numpy draws hypergeometric variates below this population; above, the sampler here does.
NUMPY_POPULATION = 900_000_000


def size(text: Column) -> Column:
    """Words without ASCII blanks; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BLANK_WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST_EPOCHS) -> list[float]:
    """Share out all sizes by weight; what is above `most` times a size goes to the others."""
    total, made, active = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while active:
        whole = sum(weights[i] for i in active)
        over = {i for i in active if left * weights[i] / whole > most * sizes[i]}
        if not over:
            for i in active:
                made[i] = left * weights[i] / whole
            break
        for i in over:
            made[i] = float(most * sizes[i])
        active -= over
        left = total - sum(made[i] for i in range(len(sizes)) if i not in active)
    return made


def _stirling_rest(n: float) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss where they are close."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v * v * v, 3
        while abs(term / j) > 1e-17 * abs(total):
            total, term, j = total + term / j, term * v * v, j + 2
        return total
    return (x * math.log(x / mean) if x else 0.0) + mean - x


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log of the binomial probability by the saddle point, exact to a double's last digits."""
    if x < 0 or x > n:
        return -math.inf
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p)) if n else 0.0
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return rest - 0.5 * (math.log(2 * math.pi) + math.log(x) + math.log1p(-x / n))


def _rejected(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """An exact hypergeometric variate by ratio of uniforms; 0 < drawn < good + bad, both above 0."""
    n = good + bad
    p, share = drawn / n, good / n
    log_p = lambda x: _log_binomial(x, good, p) + _log_binomial(drawn - x, bad, p)
    mode = min(max((drawn + 1) * (good + 1) // (n + 2), drawn - bad, 0), good, drawn)
    top, mean = log_p(mode), drawn * share + 0.5
    # Stadlober's constants for a hat over any unimodal, log-concave table.
    width = 1.7155277699214135 * math.sqrt((n - drawn) / (n - 1) * drawn * share * (1 - share) + 0.5) + 0.8989161620588988
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + width * (v - 0.5) / u)
        if max(drawn - bad, 0) <= x <= min(good, drawn) and 2 * math.log(u) <= log_p(x) - top:
            return x


def _hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, drawn))
    if not good or not drawn or not bad or drawn == good + bad:
        return min(good, drawn)
    return _rejected(good, bad, drawn, rng)


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Quotas by source to an array (shards, sources) with the quotas as column sums."""
    made = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, list(quotas))]
    while todo:
        low, high, here = todo.pop()
        if high - low == 1:
            made[low] = here
            continue
        middle, rng = (low + high) // 2, np.random.default_rng([seed, low, high])
        left, rest, drawn = [], sum(here), round(sum(here) * (middle - low) / (high - low))
        for q in here:
            got = _hypergeometric(q, rest - q, drawn, rng) if drawn else 0
            left.append(got)
            rest, drawn = rest - q, drawn - got
        todo += [(low, middle, left), (middle, high, [q - g for q, g in zip(here, left)])]
    return made


def _keyed(name: str, seed: int) -> Column:
    return F.xxhash64(F.lit(f"{name} {seed}"), "epoch", "doc_id", "version", "copy", "block")


class Mix:
    """The plan of a mix. documents: one row per input row; draws: one per block taken."""

    def __init__(self, docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, weigh=lambda i: i % 3 + 1, shards: int | None = None):
        spark = docs.sparkSession
        read = docs.select("doc_id", "source", version_of(F.col("text")).alias("version"), size(F.col("text")).alias("size"))
        rows = cut(read.groupBy("doc_id", "source", "version", "size").agg(F.count("*").cast("int").alias("n_rows")))
        blocks_of = F.ceil(F.col("size") / block_words)
        stats = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("size"), F.sum(blocks_of * F.col("n_rows")).alias("blocks")).limit(MOST_SOURCES + 1).collect()
        if len(stats) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in stats]
        wanted = targets(sizes, [weigh(i) for i in range(len(stats))])
        total = sum(sizes)
        table = []
        for i, r in enumerate(stats):
            whole = min(MOST_EPOCHS, int(wanted[i] // sizes[i])) if sizes[i] else 0
            rest = wanted[i] - whole * sizes[i] if sizes[i] else 0.0
            bits = min(MOST_BUCKET_BITS, max(1, math.ceil(math.log2(max(r["blocks"], 1) / BUCKET_BLOCKS + 1))))
            table.append((i, r["source"], r["size"], wanted[i], whole, rest if whole < MOST_EPOCHS else 0.0, bits))
        # As many rows as there are sources, so its size is known here.
        self.sources = spark.createDataFrame(table, "source_id int, source string, source_size long, target double, whole int, rest double, bits int")
        at = rows.alias("r").join(F.broadcast(self.sources.alias("s")), F.col("r.source").eqNullSafe(F.col("s.source")))
        self.documents = at.select("doc_id", "version", "r.source", "size", "source_id", "source_size", "target", "whole", "rest", "bits", F.explode(F.sequence(F.lit(1), "n_rows")).alias("copy"))
        epochs = F.sequence(F.lit(0), F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1))
        some = self.documents.where((F.col("size") > 0) & ((F.col("whole") > 0) | (F.col("rest") > 0)))
        blocks = some.select("*", F.explode(epochs).alias("epoch"))
        blocks = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block_words) - 1)).alias("block"))
        blocks = blocks.select(
            "doc_id", "version", "copy", "block", "epoch", "source_id", "whole", "rest", "bits",
            F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"), _keyed("permute", seed).alias("order"),
        ).withColumn("bucket", F.expr("shiftrightunsigned(order, 64 - bits)"))
        where = ["source_id", "epoch", "bucket"]
        # Prefix sums: first over buckets, whose number is bounded, then within each.
        before = Window.partitionBy("source_id", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = blocks.groupBy(*where).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
        zero = F.lit(0).cast("long")
        prefix = counts.select(*where, F.coalesce(F.sum("n").over(before), zero).alias("n_before"), F.coalesce(F.sum("w").over(before), zero).alias("w_before"))
        inside = Window.partitionBy(*where).orderBy(F.col("order").bitwiseXOR(F.lit(-(1 << 63))), "doc_id", "version", "copy", "block")
        ranked = blocks.join(prefix, where)
        ranked = ranked.withColumn("rank", F.col("n_before") + F.row_number().over(inside) - 1)
        ranked = ranked.withColumn("w_upto", F.col("w_before") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        taken = (F.col("epoch") < F.col("whole")) | (F.col("w_upto") - F.col("words") / 2 <= F.col("rest"))
        ranked = cut(ranked.where(taken).select("doc_id", "version", "copy", "block", *where, "words", "rank"))
        quota = {(r["source_id"], r["epoch"]): r["n"] for r in ranked.groupBy("source_id", "epoch").agg(F.count("*").alias("n")).collect()}
        quotas = [sum(quota.get((i, e), 0) for e in range(MOST_EPOCHS + 1)) for i in range(len(stats))]
        room = max(1, TABLE_CELLS // max(len(stats), 1))
        self.shards = shards or max(1, min(room, math.ceil(total / SHARD_WORDS)))
        self.quotas = split_tree(quotas, self.shards, seed) if quotas else np.zeros((self.shards, 0), dtype=np.int64)
        starts = np.cumsum(self.quotas, axis=0)
        owned = [(i, e, sum(quota.get((i, x), 0) for x in range(e)), [int(s) for s in starts[:, i]]) for i, e in quota]
        ranges = spark.createDataFrame(owned, "source_id int, epoch int, epoch_start long, ends array<long>")
        # The shards whose ranges cross a bucket, found once for each bucket.
        spans = ranked.groupBy(*where).agg(F.min("rank").alias("low"), F.max("rank").alias("high")).join(F.broadcast(ranges), ["source_id", "epoch"])
        low, high = F.col("low") + F.col("epoch_start"), F.col("high") + F.col("epoch_start")
        spans = spans.select(*where, "epoch_start", F.size(F.filter("ends", lambda x: x <= low)).alias("first"), F.filter("ends", lambda x: (x > low) & (x <= high)).alias("cuts"))
        at = F.col("rank") + F.col("epoch_start")
        drawn = ranked.join(spans, where).withColumn("at", at)
        self.draws = drawn.select("doc_id", "version", "copy", "block", "epoch", "words", (F.col("first") + F.size(F.filter("cuts", lambda x: x <= F.col("at")))).alias("shard"), _keyed("shuffle", seed).alias("place"))
        self.block_words = block_words

    def report(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken, n_shards."""
        taken = self.draws.groupBy("doc_id", "version", "copy").agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"))
        a, b = self.documents.alias("a"), taken.alias("b")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version")) & (F.col("a.copy") == F.col("b.copy"))
        zero = F.lit(0).cast("long")
        return a.join(b, same, "left").select("a.doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("n_shards", zero).alias("n_shards"))

    def materialize(self, docs: DataFrame) -> DataFrame:
        """The mix itself: docs' columns with text cut to a block, then epoch, block, shard, place.

        Order by (shard, place) to read a shard in its shuffled order. Where docs has a column
        of such a name, the new one has _ behind it.
        """
        id_, version, drawn, n, words, one, *added = free_names(docs.columns, "doc", "version", "drawn", "n", "words", "one", "epoch", "block", "shard", "place")
        # A document has at most MOST_EPOCHS draws of each of its own blocks.
        plan = self.draws.groupBy("doc_id", "version", "copy").agg(F.collect_list(F.struct("epoch", "block", "shard", "place")).alias("drawn"))
        plan = plan.groupBy(F.col("doc_id").alias(id_), F.col("version").alias(version)).agg(F.flatten(F.collect_list("drawn")).alias(drawn))
        mine = f"{version}_of_text"
        rows = docs.withColumn(mine, version_of(F.col("text")))
        if not self.documents.where(F.col("copy") > 1).isEmpty():
            # Rows that repeat a document share its plan: one of them stands for all.
            key = Window.partitionBy("doc_id", mine).orderBy(F.lit(0))
            rows = rows.withColumn(n, F.row_number().over(key)).where(F.col(n) == 1).drop(n)
        rows = rows.join(plan, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(version)))
        rows = rows.withColumn(words, F.regexp_extract_all("text", F.lit(BLANK_WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))
        rows = rows.withColumn(one, F.explode(drawn))
        start = (F.col(one)["block"] * self.block_words + 1).cast("int")
        text = F.array_join(F.slice(words, start, self.block_words), "")
        kept = [text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
        return rows.select(*kept, *[F.col(one)[c].alias(new) for c, new in zip(("epoch", "block", "shard", "place"), added)])
