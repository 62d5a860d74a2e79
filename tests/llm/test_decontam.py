import hashlib
import re
import string

import pytest

from leafmill.llm import decontam
from tests.llm.cases import benchmark, documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PASSAGE = "one TWO three, four five six seven eight nine ten eleven twelve thirteen"
EXTRA = [(50, f"pad pad {PASSAGE} fourteen pad {PASSAGE} end"), (51, "x " * 400 + PASSAGE), (52, "the lazy,dog"), (53, PASSAGE.replace("seven", "7")), (54, PASSAGE), (54, PASSAGE)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    made = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(13, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= {i} - {None}
        ids = sorted(map(str, ids))
        made.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(made, key=str)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_PRINTS", bound)  # 0: the way without broadcasts
    docs, items = documents(spark, EXTRA), benchmark(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, decontam.judge(docs, items).collect()), key=str) == want
    assert sum(r[-1] for r in want) >= 4
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in want)


def test_empty_tables(spark):
    docs, items = documents(spark, EXTRA), benchmark(spark)
    assert decontam.judge(docs.limit(0), items).count() == 0
    assert not [r for r in decontam.judge(docs, items.limit(0)).collect() if r.n_hit or r.contaminated]
