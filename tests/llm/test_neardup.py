import random
import re

import pytest

import corpus_pipeline as P
from leafmill.llm import neardup, simhash
from tests.llm.cases import documents
from tests.llm.test_simhash import LOWER


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_pairs(texts):
    sets = [brute_set(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute_pairs(texts):
        root[find(i)] = find(j)
    made = {}
    for i in range(len(texts)):
        made.setdefault(find(i), set()).add(i)
    return {frozenset(c) for c in made.values()}


def edited(seed=3, families=12, most=12):
    """Families of texts with one to 12 words changed, about half of them at 0.8 and more."""
    draw, texts = random.Random(seed), []
    for f in range(families):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice((30, 120, 300)))]
        for _ in range(most):
            words = list(base)
            for _ in range(draw.randrange(1, 13)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [neardup.BLOCK, 5])
def test_components_match_brute_force(spark, block):
    texts = [*edited(), *edited(7, families=1, most=60), *[t for _, t in documents(spark).select("doc_id", "text").collect()]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in neardup.group(docs, block).collect():
        got.setdefault(r.root, set()).add(r.fp)
    rows = neardup.group(docs, block).select("root", "fp", "named.doc_id").collect()
    first = {}
    for c in brute_classes(texts):
        for i in c:
            first[i] = c
    assert len(got) == len(brute_classes(texts))
    for r in rows:
        same = {x.doc_id for x in rows if x.root == r.root}
        assert same <= first[r.doc_id]


def test_stage_links_what_three_bits_miss(spark):
    texts = edited(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    assert len(kept) == len(brute_classes(texts))
    assert not [p for p in brute_pairs(texts) if set(p) <= kept]
    assert simhash.keep_one(docs).count() > len(kept)


def test_empty(spark):
    docs = documents(spark)
    assert P.near_dedup(spark, docs.limit(0), "").count() == 0
    assert P.near_dedup(spark, docs, "").columns == docs.columns


def test_stage_joins_components_of_simhash(spark):
    draw = random.Random(2)
    word = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n))
    mass = "alpha beta gamma " * 60
    texts = [mass + word(20), mass + word(20), word(200)]  # SimHash links the first two, shingles don't
    bridge = mass + word(20)
    wide = bridge + " " + word(150)
    texts += [bridge, wide, " ".join(wide.split()[:-6]) + " " + word(6), word(3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    pairs = {tuple(sorted(p)) for p in brute_pairs(texts)}
    prints = {r.doc_id: r.fp for r in simhash.group(docs).where("doc_id is not null").collect()}
    pairs |= {(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS}
    assert (0, 1) in pairs and (0, 1) not in {tuple(sorted(p)) for p in brute_pairs(texts)} and (4, 5) in pairs
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id for r in P.near_dedup(spark, docs, "").collect()} == set(root)
