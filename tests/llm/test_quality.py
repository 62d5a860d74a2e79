import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality
from tests.llm.cases import documents


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    words = ["calm", "river", "stone", "letter", "window", "garden", "north", "paper"]
    rows = []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(rng.choice(words, 40 + i % 60)) + "." if good else " ".join(f"{w}%%%" for w in rng.choice(words, 50))
        rows.append((i, text, "en", "s", len(text), int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int").cache()
    return frame.drop("quality"), frame.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = quality.report(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 400
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r.predicted == r.quality for r in rows if r.held_out]
    assert np.mean(out) >= 0.95


def test_held_out_labels_are_not_learnt(corpus):
    docs, labels = corpus
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.report(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_gradients_lower_the_loss_and_long_texts_chunk_alike():
    text = " ".join(f"w{i}" for i in range(5000))
    bags = [quality.encode(quality._bytes(t)) for t in (text, "x! " * 300)]
    model = quality.train(bags, np.array([1.0, 0.0]), steps=200)
    whole = model.score(quality._bytes(text))
    assert whole > 0.8 and model.score(quality._bytes("x! " * 300)) < 0.2
    step, quality.CHUNK = quality.CHUNK, 2 * quality.PASSAGE
    try:
        assert model.score(quality._bytes(text)) == pytest.approx(whole, abs=1e-6)
    finally:
        quality.CHUNK = step


def test_awkward_rows(spark, corpus):
    docs, (_, labels) = documents(spark), corpus
    made = quality.report(docs, labels).collect()
    assert len(made) == docs.count() and all(0 <= r.score <= 1 for r in made)
    assert quality.report(docs.limit(0), labels).count() == 0
    none = quality.report(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns


def test_clashing_columns_and_repeated_labels(spark, corpus):
    docs, labels = corpus
    clash = docs.selectExpr("*", "-1.0 AS score", "doc_id AS version", "1 AS label", "2 AS id")
    made = quality.accepted(clash, labels)
    assert made.columns == clash.columns and {r.score for r in made.select("score").collect()} == {-1}
    assert 0 < made.count() < 400
    many = labels.unionByName(labels).unionByName(labels.selectExpr("doc_id", "CAST(NULL AS int) AS quality", "toxic")).unionByName(labels.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", "quality", "toxic"))
    assert quality.training_rows(docs, many) == quality.training_rows(docs, labels)


def test_the_sample_is_bounded_by_rows_and_bytes(spark, corpus):
    docs, labels = corpus
    repeated = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    assert len(quality.training_rows(repeated, labels, most=30)) == 30
    rows = quality.training_rows(docs, labels, most_bytes=5000)
    assert 0 < sum(len(t.encode()) for _, t in rows) <= 5000
    assert len(quality.training_rows(docs, labels)) == labels.where(~quality.held_out(F.col("doc_id"))).count()


def brute_score(model, text):
    """The score of a text by plain loops over its bytes, passages and weights."""
    data, m = text.encode(), 0xFFFFFFFF
    hidden, power = [], []
    for at in range(0, max(len(data), 1), quality.PASSAGE):
        p = data[at : at + quality.PASSAGE]
        counts, kinds = [0] * quality.TRIGRAMS, [0] * 7
        for i, c in enumerate(p):
            b, d = (p[i + 1] if i + 1 < len(p) else 0), (p[i + 2] if i + 2 < len(p) else 0)
            x = (c * 0x9E3779B1 + b * 0x85EBCA6B + d * 0xC2B2AE35) & m
            x ^= x >> 15
            counts[(x * 0x27D4EB2F & m) >> 22] += 1
            kinds[int(quality._KIND[c])] += 1
        n = max(len(p), 1)
        share = [c / n for c in counts]
        stats = [k / n for k in kinds] + [20 * sum(s * s for s in share), 5 * max(share), sum(c > 0 for c in counts) / min(n, quality.TRIGRAMS), math.log1p(n) / 7, 1]
        x = [math.sqrt(s) for s in share] + stats if p else [0.0] * quality.FEATURES
        h = [math.tanh(sum(a * float(w) for a, w in zip(x, column))) for column in model.w.T]
        gate = [math.tanh(sum(a * float(w) for a, w in zip(h, v))) / (1 + math.exp(-sum(a * float(w) for a, w in zip(h, u)))) for v, u in zip(model.v.T, model.u.T)]
        hidden.append(h)
        power.append(math.exp(sum(g * float(a) for g, a in zip(gate, model.a))))
    z = [sum(p * h[k] for p, h in zip(power, hidden)) / sum(power) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(a * float(c) for a, c in zip([*z, 1.0], model.c))))


def test_scores_match_brute_force(spark, corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    some = documents(spark).where("doc_id <> 5 or doc_id is null").unionByName(docs.limit(10).selectExpr("*", *[f"CAST(NULL AS {t}) AS {c}" for c, t in documents(spark).dtypes[5:]]))
    for r in quality.scores(some, model, ["doc_id", "text"]).collect():
        assert r.score == pytest.approx(brute_score(model, r.text or ""), abs=2e-4)
