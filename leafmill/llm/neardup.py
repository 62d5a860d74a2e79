"""Near copies for the pipeline: SimHash's components, joined by links that three bits miss.

The stage groups all documents by SimHash first, through the operator of simhash.py: fingerprints,
pivot tables and components, nothing left out. Near copies at a similarity of 0.8 mostly differ in
more bits than its radius, so group() adds links, and deduplicated() joins the components of
SimHash that these links connect: documents are alike if either step says so, directly or by way
of others.

For group(), two texts link if the Jaccard similarity of their sets of five-word shingles is at
least SIMILAR, counted exactly. A text's fingerprint is a SimHash of WIDE bits: at a similarity of 0.8 two of them
differ in 39 bits on average and in more than RADIUS once in 10^5 (small sets, whose bits vary
more, are not judged by it). Only texts with a band of min-hashes in common are looked at (a
pair at 0.8 has none in common 3 in 10^5 times): blocks of the fingerprint itself can't propose
pairs that differ in so many bits, as what is left of 64 or 256 bits is so short that nearly all
meet all.

Each bucket has a leader, the member that shares most buckets with others. All members are
counted against it, which links most of a group; what is linked is one component and needs no
pairs of its own. Buckets that still hold several components are compared block by block: a
block's pivot table has the Hamming distances of its fingerprints to PIVOTS of them; a pair of
different components is discarded if any two coordinates differ by more than RADIUS, next if the
fingerprints do, and survivors are verified on their shingles. Only links leave a block.

Defined cases: words and case as in simhash; a text of fewer than five words is one shingle;
null, empty and wordless texts are alike; equal sets of shingles are one fingerprint; rows that
share a doc_id or have none are told apart by their texts; a table without rows has no groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import simhash
from leafmill.llm.common import Folder, ascii_lower, small_arrow_batches, version_of
from leafmill.llm.simhash import BLANKS, components, one_of_each

SHINGLE, BANDS, ROWS = 5, 20, 4
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
WIDE, RADIUS = 256, 64
#: Sets of fewer shingles are verified whatever their fingerprints are.
SMALL = 64
#: Rows of a block, and references of its pivot table.
BLOCK, PIVOTS = 256, 16

_DRAWN = np.random.default_rng(20240805).integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(5).integers(0, 2**63, max(SHINGLE, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = np.random.default_rng(11).integers(0, 2**63, WIDE // 64, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text, given its words' hashes; ascending."""
    w = np.asarray(words, np.int64).view(np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h += w[j : j + n] * _PLACE[j]
    return np.unique(_mixed(h))


def _digest(found: np.ndarray) -> int:
    """A set's name."""
    return int(_mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def _bands(found: np.ndarray) -> np.ndarray:
    least = np.empty(BANDS * ROWS, np.uint64)
    for i in range(0, BANDS * ROWS, ROWS):
        least[i : i + ROWS] = ((found[None, :] ^ _DRAWN[0, i : i + ROWS, None]) * _DRAWN[1, i : i + ROWS, None]).min(axis=1)
    keys = (_mixed(least).reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def wide_simhash(found: np.ndarray) -> np.ndarray:
    """A set's SimHash of WIDE bits, as longs: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(found), 1 << 14):
        lanes = _mixed(found[at : at + (1 << 14), None] ^ _LANE)
        counts += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found)).view(np.int64)


def _signed(words: pd.Series) -> pd.DataFrame:
    sets = [shingles(w) for w in words]
    return pd.DataFrame({"fp": [_digest(s) for s in sets], "bands": [_bands(s) for s in sets]}, columns=["fp", "bands"])


def _listed(words: pd.Series) -> pd.DataFrame:
    sets = [shingles(w) for w in words]
    # Half of each hash is enough to count what two sets share, and ships half the bytes.
    short = [np.unique(s.view(np.uint32)[::2]).view(np.int32) for s in sets]
    return pd.DataFrame({"fp": [_digest(s) for s in sets], "shingles": short, "sim": [wide_simhash(s) for s in sets]}, columns=["fp", "shingles", "sim"])


def _words(text: Column) -> Column:
    word = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BLANKS, -1), "")
    return F.transform(word, lambda w: F.xxhash64(w))


def _hamming(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(f"{a}.sim")[i].bitwiseXOR(F.col(f"{b}.sim")[i])) for i in range(WIDE // 64)]
    return sum(bits[1:], bits[0]).cast("int")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (fp_a, fp_b) with linked."""
    a = sets.select(F.col("fp").alias("fp_a"), F.struct("shingles", "sim").alias("a"))
    b = sets.select(F.col("fp").alias("fp_b"), F.struct("shingles", "sim").alias("b"))
    size = lambda side: F.size(F.col(f"{side}.shingles"))
    both = F.size(F.array_intersect(F.col("a.shingles"), F.col("b.shingles")))
    any_ = size("a") + size("b") - both
    # A set that is too small can't hold four fifths of the other.
    near = (SIMILAR[1] * F.least(size("a"), size("b")) >= SIMILAR[0] * F.greatest(size("a"), size("b"))) & ((F.least(size("a"), size("b")) < SMALL) | (_hamming("a", "b") <= RADIUS))
    rows = pairs.join(b, "fp_b").join(a, "fp_a")
    return rows.select("fp_a", "fp_b", F.when(near, SIMILAR[1] * both >= SIMILAR[0] * any_).otherwise(F.lit(False)).alias("linked"))


def _bits(sims: list[np.ndarray]) -> np.ndarray:
    return np.unpackbits(np.array(sims, np.int64).view(np.uint8), axis=1).astype(np.float32)


def _linked_pairs(key: int, same: bool, a: list, b: list):
    """Links (fp_a, fp_b) between rows of two blocks of a bucket, or inside one, that join different components."""
    bits_a, bits_b = _bits([r[3] for r in a]), _bits([r[3] for r in b])
    size_a, size_b = (np.array([len(r[2]) for r in x]) for x in (a, b))
    root_a, root_b = (np.array([r[1] for r in x]) for x in (a, b))
    bands_a, bands_b = (np.array([r[4] for r in x]) for x in (a, b))
    todo = root_a[:, None] != root_b[None, :]
    if same:
        todo &= np.triu(np.ones_like(todo), 1)
    for i in range(BANDS):  # a pair is told in the first bucket that it shares
        if bands_a[0, i] == key:
            break
        todo &= bands_a[:, None, i] != bands_b[None, :, i]
    small, large = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    todo &= SIMILAR[1] * small >= SIMILAR[0] * large
    free = small < SMALL
    # The pivot table: distances to references spread over the first block.
    pivots = bits_a[:: max(1, -(-len(a) // PIVOTS))]
    far = lambda x, y: x @ (1 - y.T) + (1 - x) @ y.T
    table_a, table_b = far(bits_a, pivots), far(bits_b, pivots)
    for k in range(len(pivots)):
        todo &= free | (np.abs(table_a[:, None, k] - table_b[None, :, k]) <= RADIUS)
    todo &= free | (far(bits_a, bits_b) <= RADIUS)
    joined: dict[int, int] = {}  # components that links of this block have joined

    def top(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    for i, j in zip(*np.nonzero(todo)):
        x, y = top(int(root_a[i])), top(int(root_b[j]))
        if x != y:
            both = len(np.intersect1d(a[i][2], b[j][2], assume_unique=True))
            if SIMILAR[1] * both >= SIMILAR[0] * (len(a[i][2]) + len(b[j][2]) - both):
                joined[x] = y
                yield min(a[i][0], b[j][0]), max(a[i][0], b[j][0])


def _verified(batches):
    """Links from rows sorted by bucket and pair of blocks, each such group at a time."""

    def told(at, rows):
        key, low, high = at
        a = [r[1:] for r in rows if r[0] == low]
        return _linked_pairs(key, low == high, a, a if low == high else [r[1:] for r in rows if r[0] == high])

    at, rows = None, []
    for pdf in batches:
        found = []
        for key, low, high, part, *row in pdf[["key", "low", "high", "part", "fp", "root", "shingles", "sim", "bands"]].itertuples(index=False, name=None):
            if (key, low, high) != at:
                found += told(at, rows) if len(rows) > 1 else []
                at, rows = (key, low, high), []
            rows.append((part, *row))
        yield pd.DataFrame(found, columns=["fp_a", "fp_b"])
    if len(rows) > 1:
        yield pd.DataFrame(told(at, rows), columns=["fp_a", "fp_b"])


def links(members: DataFrame, sets: DataFrame, folder: Folder, block: int = BLOCK) -> DataFrame:
    """(fp_a, fp_b) that join every two members (key, fp) of a bucket that are alike, directly or by way of others.

    sets: (fp, shingles, sim, bands) of all members.
    """
    shared = members.groupBy("key").agg(F.count("*").alias("n"))
    weight = members.join(shared, "key").groupBy("fp").agg(F.sum("n").alias("weight"))
    leaders = members.join(weight, "fp").groupBy("key").agg(F.max(F.struct("weight", "fp"))["fp"].alias("leader"))
    leaders = folder.keep("leaders", leaders)
    star = members.join(leaders, "key").where("fp <> leader").select(F.col("leader").alias("fp_a"), F.col("fp").alias("fp_b")).distinct()
    edges = folder.keep("star", compared(star, sets).where("linked").select("fp_a", "fp_b"))
    roots = components(edges)
    rooted = folder.keep("rooted", members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # Buckets of several components; a leader has met all members of its own.
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count("*") / block).cast("long").alias("blocks")).where("least <> most")
    mixed = folder.keep("mixed", mixed.join(leaders, "key").select("key", "leader", "blocks"))
    rows = rooted.join(mixed, "key").where("fp <> leader").select("key", "fp", "root", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("part"))
    rows = rows.join(sets, "fp").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp", "root", "shingles", "sim", "bands")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return folder.keep("edges", edges.unionByName(rows.mapInPandas(_verified, "fp_a long, fp_b long")))


def group(docs: DataFrame, block: int = BLOCK, folder: Folder | None = None) -> DataFrame:
    """(fp, root, named): one row per distinct set of shingles.

    root is its component; named, the first of its rows: (unnamed, doc_id, version, n_rows).
    """
    small_arrow_batches(docs.sparkSession)
    folder = folder or Folder(docs.sparkSession, "near")
    read = docs.select("doc_id", "text", version_of(F.col("text")).alias("version"))
    rows = read.select("doc_id", "version", F.pandas_udf(_signed, "fp long, bands array<long>")(_words(F.col("text"))).alias("s")).select("doc_id", "version", "s.fp", "s.bands")
    each = folder.keep("each", rows.groupBy("doc_id", "version", "fp").agg(F.count("*").cast("int").alias("n_rows"), F.first("bands").alias("bands")))
    prints = folder.keep("prints", each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "n_rows")).alias("named"), F.first("bands").alias("bands")))
    banded = prints.select("fp", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = folder.keep("members", banded.join(shared, "key"))
    of = members.select("fp").distinct().join(prints, "fp").select(F.col("named.doc_id").alias("d"), F.col("named.version").alias("v"))
    # The texts of members, one row of each, are read again; the others' shingles never leave their task.
    texts = read.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left_semi")
    listed = texts.select(F.pandas_udf(_listed, "fp long, shingles array<int>, sim array<long>")(_words(F.col("text"))).alias("s")).select("s.*")
    sets = listed.groupBy("fp").agg(F.first("shingles").alias("shingles"), F.first("sim").alias("sim"))
    sets = folder.keep("sets", sets.join(prints.select("fp", "bands"), "fp"))
    roots = components(links(members, sets, folder, block))
    folder.drop("members", "sets", "leaders", "star", "rooted", "mixed", "edges")
    return prints.select("fp", "named").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "named")


def joined(simhashed: DataFrame, each: DataFrame, near: DataFrame, folder: Folder) -> DataFrame:
    """(sim, root) for every SimHash component that links of group() join with others.

    simhashed: (doc_id, version, sim); each: (doc_id, version, fp); near: (fp, root).
    """
    e = each.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "fp")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
    pairs = folder.keep("sims", simhashed.join(e, same).select("fp", "sim").distinct())
    pairs = folder.keep("pairs", pairs.join(near.select("fp", "root"), "fp").select("root", "sim").distinct())
    several = folder.keep("several", pairs.groupBy("root").agg(F.min("sim").alias("least"), F.max("sim").alias("most")).where("least <> most").select("root", "least"))
    edges = pairs.join(several, "root").where("sim <> least").select(F.col("least").alias("fp_a"), F.col("sim").alias("fp_b")).distinct()
    return components(edges).select(F.col("fp").alias("sim"), "root")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the least (doc_id, version), null ids last."""
    folder = Folder(docs.sparkSession, "near")
    simhashed = folder.keep("simhashed", simhash.group(docs).select("doc_id", "version", "n_rows", F.col("root").alias("sim")))
    near = folder.keep("near", group(docs, folder=folder))
    folder.drop("prints")
    each = docs.sparkSession.read.parquet(f"{folder.path}/each")
    # One row of each SimHash component first, so that no component's rows meet in one task.
    firsts = simhashed.groupBy("sim").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "n_rows")).alias("k"))
    roots = joined(simhashed.select("doc_id", "version", "sim"), each, near, folder)
    kept = firsts.join(roots, "sim", "left").groupBy(F.coalesce("root", "sim").alias("root")).agg(F.min("k").alias("k"))
    kept = folder.keep("kept", kept.select("k.doc_id", "k.version", "k.n_rows"))
    folder.only("kept")
    return one_of_each(docs, kept)
