import re
import struct

import numpy as np
import pytest
import xxhash

from leafmill.llm import mixing
from tests.llm.cases import documents


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    made = mixing.targets([10, 1000, 1000], [3, 1, 1])
    assert made == pytest.approx([30, 990, 990])
    assert mixing.targets([0, 50], [1, 2]) == [0.0, 50.0]
    assert mixing.targets([], []) == []


def test_tree_keeps_quotas():
    made = mixing.split_tree([1000, 10, 0, 333], 7)
    assert made.sum(axis=0).tolist() == [1000, 10, 0, 333] and (made >= 0).all()
    assert np.ptp(made.sum(axis=1)) <= 2
    assert (made == mixing.split_tree([1000, 10, 0, 333], 7)).all()
    assert mixing.split_tree([4 * 10**9, 10**9], 4).sum(axis=0).tolist() == [4 * 10**9, 10**9]


def test_plan_is_near_its_targets_and_repeats(spark):
    docs = documents(spark, [(100 + i, "some words here " * (i + 1)) for i in range(40)])
    mix = mixing.Mix(docs, block_words=16, shards=5)
    rows = mix.report().collect()
    assert len(rows) == docs.count()
    by = {}
    sizes = {(r.doc_id, r.size): r.taken for r in rows}
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size > 0 or r.taken == 0)
        by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] += r.taken
    assert all(abs(t - target) <= 16 for (_, target), t in by.items())
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in rows))
    again = mixing.Mix(docs.repartition(7), block_words=16, shards=5).report().collect()
    assert sorted(map(str, again)) == sorted(map(str, rows)) and sizes
    per_shard = {r["shard"]: r["n"] for r in mix.draws.groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert per_shard == {i: int(n) for i, n in enumerate(mix.quotas.sum(axis=1)) if n}
    whole = mix.materialize(docs)
    assert whole.count() == mix.draws.count()
    words = whole.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0]
    assert words == sum(r.taken for r in rows)


def test_no_rows_and_no_words(spark):
    docs = documents(spark)
    assert mixing.Mix(docs.limit(0)).report().count() == 0
    blank = docs.where("text is null or text = ''")
    assert [r.taken for r in mixing.Mix(blank).report().collect()] == [0, 0]


def keyed(*values):
    """Spark's xxhash64 of several values: each is hashed with the last one's hash as seed."""
    h = 42
    for v, size in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if size == "s" else struct.pack(f"<{size}", v), h)
    return h


def brute(rows, block_words):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, source, text), without Spark."""
    docs, copies = [], {}
    for i, source, text in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        signed = struct.unpack("<q", struct.pack("<Q", keyed((text or "", "s"))))[0]
        copies[i, source, signed] = copy = copies.get((i, source, signed), 0) + 1
        docs.append((i, source, signed, copy, size))
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    total = sum(d[4] for d in docs)
    sizes = {s: sum(d[4] for d in docs if d[1] == s) for s in sources}
    weights, fixed = {s: k % 3 + 1 for k, s in enumerate(sources)}, {}
    while True:
        free = [s for s in sources if s not in fixed]
        left, whole = total - sum(fixed.values()), sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / whole > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
    target = fixed | {s: left * weights[s] / whole for s in free}
    taken = dict.fromkeys(docs, 0)
    for s in sources:
        epochs, mine = min(3, int(target[s] // sizes[s])) if sizes[s] else 0, [d for d in docs if d[1] == s]
        for d in mine:
            taken[d] += epochs * d[4]
        rest = target[s] - epochs * sizes[s]
        blocks = [(keyed(("permute 17", "s"), (epochs, "i"), (d[0], "q"), (d[2], "q"), (d[3], "i"), (b, "q")), d, min(block_words, d[4] - b * block_words)) for d in mine for b in range(-(-d[4] // block_words))]
        upto = 0
        for _, d, words in sorted(blocks, key=lambda x: x[0]) if rest > 0 and epochs < 3 else []:
            upto += words
            taken[d] += words if upto - words / 2 <= rest else 0
    return [(d[0], d[4], sizes[d[1]], target[d[1]], taken[d]) for d in docs]


@pytest.mark.parametrize("block_words", [16, 256])
def test_matches_brute_force(spark, block_words):
    docs = documents(spark, [(100 + i, "some words here " * (i + 1)) for i in range(40)])
    want = brute([(r.doc_id, r.source, r.text) for r in docs.collect()], block_words)
    got = [tuple(r) for r in mixing.Mix(docs, block_words=block_words).report().drop("n_shards").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_columns_with_clashing_names_stay(spark):
    docs = documents(spark).selectExpr("*", "1 AS epoch", "2 AS block", "3 AS Shard", "4 AS place", "5 AS drawn", "6 AS n")
    made = mixing.Mix(docs).materialize(docs)
    assert made.columns == [*docs.columns, "epoch_", "block_", "shard_", "place_"]
    assert {(r.epoch, r.Shard, r.drawn, r.n) for r in made.collect()} == {(1, 3, 5, 6)}


def test_exact_draws_of_any_population():
    rng = np.random.default_rng(3)
    for good, bad, drawn in ((50, 70, 30), (5, 2000, 900), (10**5, 10**6, 5 * 10**5)):
        made = np.array([mixing._rejected(good, bad, drawn, rng) for _ in range(4000)])
        p, n = good / (good + bad), good + bad
        sd = (drawn * p * (1 - p) * (n - drawn) / (n - 1)) ** 0.5
        assert abs(made.mean() - drawn * p) < 5 * sd / 4000**0.5
        assert made.std() == pytest.approx(sd, rel=0.08)
    few = np.bincount([mixing._rejected(3, 4, 3, rng) for _ in range(20000)], minlength=4) / 20000
    assert few == pytest.approx([4 / 35, 18 / 35, 12 / 35, 1 / 35], abs=0.015)
    quotas = [6 * 10**10, 4 * 10**10, 10**9, 7]
    one, two = mixing.split_tree(quotas, 16), mixing.split_tree(quotas, 16)
    assert one.sum(axis=0).tolist() == quotas and (one == two).all() and (one >= 0).all()
    assert np.ptp(one.sum(axis=1)) <= 4
    assert np.abs(one[:, 0] - quotas[0] / 16).max() < 6 * (sum(quotas) / 16 * 0.6 * 0.4) ** 0.5
