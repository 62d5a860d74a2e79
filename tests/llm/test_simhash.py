import re
import string

import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import simhash
from tests.llm.cases import documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def near(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 8
    return [(100 + i, base + f"variant {'x' * (i % 5)} {i // 9}") for i in range(60)]


def test_matches_brute_force(spark):
    docs = documents(spark, near(spark))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, simhash.report(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("levels", [(5, 8, 12, 16), (5, 16)])
def test_crowded_buckets_lose_no_link(spark, levels):
    prints = sorted({(1 << i) | (1 << j) for i in range(0, 40, 3) for j in range(0, 40, 5)} | {0, -1, -1 << 63, 7})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {tuple(r) for r in simhash.links(frame, bucket=4, levels=levels).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "fp_a long, fp_b long")
    got = {r.fp: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_keep_one_and_empty(spark):
    docs = documents(spark, near(spark))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.group(docs).select("root").distinct().count()
    assert simhash.report(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_no_component_goes_with_its_id(spark):
    rows = [(None, f"text number {i} of nobody {'abcdefgh'[i] * 9} {i * i} said here") for i in range(6)] + [(4, "one text of the id four here"), (4, "something else under that very id"), (None, "one text of the id four here"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted({r for r in rows if r != (None, "one text of the id four here")}, key=str)


def test_pivots_discard_candidates_and_no_link(spark):
    prints = [((i * 0x9E3779B97F4A7C15) ^ (i << 40)) % (1 << 63) for i in range(300)] + [1 << i for i in range(60)]
    table = simhash.pivot_table(spark.createDataFrame([(p,) for p in prints], "fp long"))
    pairs = table.alias("a").join(table.alias("b"), F.expr("a.fp < b.fp"))
    left = pairs.where(simhash._pivots_agree())
    linked = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= simhash.RADIUS
    assert left.count() < pairs.count() / 20
    assert left.where(linked).count() == pairs.where(linked).count() > 0
