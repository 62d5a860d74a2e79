"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits; two link at `radius` or fewer differing bits. Only distinct
fingerprints are compared. Candidates agree on two of five blocks of bits (pigeonhole: three
changed bits touch at most three blocks). Each fingerprint carries its Hamming distances to
reference fingerprints; by the triangle inequality a pair whose distances to any one pivot
differ by more than the radius is discarded, and the survivors are verified bit by bit.

A bucket of many fingerprints is not paired off: it is split again by the blocks that its
members do not share yet, until buckets are small or their members can differ in so few bits
that their number is bounded.

Defined cases: a null, empty or wordless text has fingerprint zero, linked like any other;
rows that share a doc_id are fingerprinted each by its own text; repeated rows repeat their
row; a null doc_id never names a component unless nothing else does; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Folder, ascii_lower, cut, free_names, version_of

BLANKS = r"[\x20\x09-\x0D]+"
SHINGLE, BITS, RADIUS = 3, 64, 3
N_PIVOTS = 16
#: Buckets with more fingerprints are split by further blocks before pairs are formed.
BUCKET = 64


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, n_rows, fp): n_rows says how many equal rows there were."""
    text = F.coalesce("text", F.lit(""))
    word = F.array_remove(F.split(ascii_lower(text), BLANKS, -1), "")
    rows = docs.select("doc_id", F.xxhash64(text).alias("version"), word.alias("word"))
    at = F.when(F.size("word") > 0, F.sequence(F.lit(0), F.greatest(F.size("word") - shingle, F.lit(0)))).otherwise(F.array(F.lit(-1)))
    rows = rows.select("doc_id", "version", "word", F.explode(at).alias("at"))
    said = F.concat_ws(" ", *[F.get("word", F.col("at") + j) for j in range(shingle)])
    rows = rows.select("doc_id", "version", "at", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(said)).alias("h"))
    # Two counters in each sum: bit k in the low half, bit k + 32 in the high half.
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{k}") for k in range(32)]
    counted = rows.groupBy("doc_id", "version").agg(F.count("*").alias("n"), F.count_if(F.col("at") <= 0).cast("int").alias("n_rows"), *lanes)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{k}", 32)
        fp = fp.bitwiseOR(F.when(2 * low > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        bit = (1 << (k + 32)) - (1 << 64 if k == 31 else 0)
        fp = fp.bitwiseOR(F.when(2 * high > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select("doc_id", "version", "n_rows", fp.alias("fp"))


def _masks(blocks: int) -> list[int]:
    """Masks of the bits that two fingerprints share if three other blocks may differ."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    made = [sum(chosen) for chosen in combinations(block, blocks - RADIUS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in made]


def pivot_table(fps: DataFrame, n_pivots: int = N_PIVOTS) -> DataFrame:
    """Adds the distances to the reference fingerprints, eight to a long."""
    pivots = [F.xxhash64(F.lit(f"pivot {i}")) for i in range(n_pivots)]
    packed = []
    for start in range(0, n_pivots, 8):
        value = F.lit(0).cast("long")
        for i, p in enumerate(pivots[start : start + 8]):
            value = value.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(p)).cast("long"), 8 * i))
        packed.append(value.alias(f"p{start // 8}"))
    return fps.select("fp", *packed)


def _pivots_agree(n_pivots: int = N_PIVOTS, radius: int = RADIUS) -> Column:
    """No pivot tells a pair (a, b) of the table apart."""
    near = F.lit(True)
    for i in range(n_pivots):
        at = lambda side: F.shiftrightunsigned(F.col(f"{side}.p{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255))
        near = near & (F.abs(at("a") - at("b")) <= radius)
    return near


def _buckets(table: DataFrame, blocks: int) -> DataFrame:
    """One row per fingerprint and mask: (mask, part, fp, pivots)."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(_masks(blocks))]))
    return table.select(parts.alias("b"), "*").select("b.mask", "b.part", *table.columns)


def links(distinct: DataFrame, bucket: int = BUCKET, levels: tuple[int, ...] = (5, 8, 12, 16)) -> DataFrame:
    """Pairs (fp_a, fp_b), fp_a < fp_b, of distinct fingerprints within the radius; none is lost.

    Two fingerprints of a crowded bucket both go on to the next level, whose blocks are
    finer. At the last level a bucket has 12 free bits, so 4096 members at most.
    """
    found, todo = None, pivot_table(distinct)
    for level, blocks in enumerate(levels):
        rows, last = _buckets(todo, blocks), level == len(levels) - 1
        crowded = None
        if not last:
            crowded = cut(rows.groupBy("mask", "part").count().where(F.col("count") > bucket).drop("count"))
            crowded = None if crowded.isEmpty() else crowded
        calm = rows if crowded is None else rows.join(crowded, ["mask", "part"], "left_anti")
        pairs = calm.alias("a").join(
            calm.alias("b"),
            (F.col("a.mask") == F.col("b.mask")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp")) & _pivots_agree(),
        )
        pairs = pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        pairs = pairs.select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b")).distinct()
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None:
            break
        todo = cut(rows.join(crowded, ["mask", "part"], "left_semi").drop("mask", "part").distinct())
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint with a link: alternating large and small stars."""
    folder, turn = Folder(edges.sparkSession, "stars"), 0
    edges = folder.keep("0", edges.select(F.col("fp_b").alias("u"), F.col("fp_a").alias("v")))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        turn += 1
        edges = folder.keep(f"{turn}", small.select("e.u", "e.v").where("u != v").distinct())
        folder.only(f"{turn}")
        # Equal edge sets have equal counts and sums; a sum of hashes can't overflow a decimal.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("fp"), F.col("v").alias("root"))).distinct()


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_rows, fp, component_id, root): one row per distinct (doc_id, text).

    root is the component's fingerprint, which is never null as component_id can be.
    """
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut(components(links(distinct.select("fp"))))
    named = linked.join(distinct, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written out, so that the join below can deal a fingerprint of very many rows to several tasks.
    classes = cut(distinct.join(linked.join(least, "root"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return prints.join(classes, "fp").select("doc_id", "version", "n_rows", "fp", "component_id", "root")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = group(docs).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def firsts(grouped: DataFrame) -> DataFrame:
    """(doc_id, version, n_rows): of each root the least (doc_id, version), null ids last."""
    place = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "n_rows"))
    return grouped.groupBy("root").agg(place.alias("k")).select("k.doc_id", "k.version", "k.n_rows")


def one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept (doc_id, version, n_rows) names; of equal rows one."""
    id_, version, n = free_names(docs.columns, "kept", "version", "n_rows")
    kept = cut(kept.toDF(id_, version, n))
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (version_of(docs["text"]) == F.col(version))
    left = docs.join(kept, same, "left_semi")
    if kept.where(F.col(n) > 1).isEmpty():
        return left
    return left.withColumn(version, version_of(F.col("text"))).dropDuplicates(["doc_id", version]).drop(version)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component.

    Ids play no part in telling components apart: they can be null or have two texts.
    """
    return one_of_each(docs, firsts(group(docs)))
