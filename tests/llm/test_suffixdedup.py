import hashlib
import random
import tracemalloc

import numpy as np

from leafmill.llm import suffixdedup as S
from tests.llm.cases import documents


def brute(rows, length=200):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            w = d[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    made = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        made.append((doc_id, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(made, key=str)


def check(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, S.report(docs).collect()), key=str) == brute(rows)


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for trial in range(120):
        pieces = ["".join(rng.choice("ab" if trial % 2 else "abcdefg\0") for _ in range(rng.randrange(0, 40))).encode() for _ in range(rng.randrange(1, 6))]
        text, ranks, separators = [], [], 0
        for p in pieces:
            text += [c + 1000 for c in p] + [separators]
            ranks += [c + 1000 for c in p] + [separators]
            separators += 1
        order = S.suffix_array(np.array(text), 1300).tolist()
        assert order == sorted(range(len(text)), key=lambda i: ranks[i:])
        for p, again in zip(pieces, S.repeated_starts(pieces, 5)):
            want = [sum(q[j : j + 5] == p[i : i + 5] for q in pieces for j in range(len(q) - 4)) > 1 for i in range(len(p) - 4)]
            assert again.tolist() == want


def test_runs_cover_every_start_once():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 5, 199, 200, 201, 3000, 200_000, 450)] + [b"a" * 2000]
    text, key, first, last = S.segments(texts)
    for i, t in enumerate(texts):
        starts = [s for k in np.flatnonzero(text == i) for s in range(first[k], last[k] + 1)]
        assert starts == list(range(len(t) - 199))
    alone = S.segments([texts[5]])
    assert [x[text == 5].tolist() for x in (key, first, last)] == [x.tolist() for x in alone[1:]]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdluéß") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    shared, line = prose(60), prose(22)
    extra = []
    for i in range(40):
        text = prose(30) + line + prose(25)
        if i % 3 == 0:
            text += shared[i // 3 :] + prose(9)
        if i % 5 == 0:
            text = text.replace("e", "E", 1) + text[40:400]
        extra.append((100 + i, text))
    extra += [(200, extra[0][1]), (201, extra[0][1]), (202, "ab" * 400), (203, "z" * 500), (204, extra[3][1] + " near"), (205, "\0" * 300), (206, "x" * 199), (206, "x" * 199)]
    check(spark, documents(spark, extra))


def test_empty_table(spark):
    assert S.report(documents(spark).limit(0)).count() == 0


def test_small_table_matches_brute_force(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_a_shard_needs_few_bytes_for_each_of_its_own():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 105, 3000, np.uint8).tobytes()
    pieces = [base[a : a + 300] for a in rng.integers(0, 2700, 2000).tolist()]
    tracemalloc.start()
    flags = S.repeated_starts(pieces)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 * sum(map(len, pieces))
    assert all(f.dtype == bool and len(f) == 101 for f in flags) and sum(f.sum() for f in flags) > 100_000
