"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, each PASSAGE bytes of its UTF-8 text. A passage is encoded
from hashed byte trigrams and a few shares (letters, capitals, digits, punctuation, repeated
trigrams) by one tanh layer. Gated attention, tanh(V h) * sigmoid(U h), weighs the passages;
the weighted mean is scored by a logistic unit. Only labels of documents train the weights:
no passage has a label. Labels, language, source and id are no inputs.

Training takes a bounded sample of the labelled rows: in the order of a hash of id and text, at
most TRAIN_DOCS of them and as many as have TRAIN_BYTES in all; of these it reads every
passage. A row that does not fit is passed over. Scoring reads every passage of every document.

Defined cases: a null or empty text is one empty passage; a document's label is the mean of
its labels, null labels left out and repeated ones counted; without a trainable label, or with one class only, the
score is the mean label (one half without any); rows that share an id are scored each by its
own text; a null id is never held out and never trains; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import free_names, small_arrow_batches, version_of

PASSAGE, TRIGRAMS, HIDDEN, ATTENTION = 768, 1024, 24, 12
TRAIN_DOCS, TRAIN_BYTES = 6000, 32 << 20
STEPS, BATCH, RATE, DECAY, SEED = 1200, 64, 3e-3, 1e-5, 11
THRESHOLD, FOLDS, HELD_OUT = 0.7, 4, 2
#: Bytes of text whose features are in memory at once.
CHUNK = 1 << 20

_KIND = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 3 digit, 4 blank, 5 other ASCII, 6 beyond ASCII
_KIND[33:127] = 5
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[128:] = 6
SHARES = 12
FEATURES = TRIGRAMS + SHARES


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def encode(data: np.ndarray) -> np.ndarray:
    """Features of passages of PASSAGE bytes each (the last may be shorter) of one byte array."""
    n = max(1, -(-len(data) // PASSAGE))
    made = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(data):
        return made
    passage = np.arange(len(data)) // PASSAGE
    x = data.astype(np.uint32)
    y, z = np.roll(x, -1), np.roll(x, -2)
    for late, last in ((y, 1), (z, 1), (z, 2)):  # no trigram reads beyond its passage
        late[PASSAGE - last :: PASSAGE] = 0
        late[-last:] = 0
    x = x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA6B) + z * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(15)
    counts = np.bincount(passage * TRIGRAMS + (x * np.uint32(0x27D4EB2F) >> np.uint32(22)), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    kinds = np.bincount(passage * 7 + _KIND[data], minlength=n * 7).reshape(n, 7)
    length = np.maximum(counts.sum(axis=1), 1)[:, None]
    share = counts / length
    made[:, :TRIGRAMS] = np.sqrt(share)
    stats = made[:, TRIGRAMS:]
    stats[:, :7] = kinds / length
    stats[:, 7] = (share * share).sum(axis=1) * 20  # repetition
    stats[:, 8] = share.max(axis=1) * 5
    stats[:, 9] = (counts > 0).sum(axis=1) / np.minimum(length[:, 0], TRIGRAMS)
    stats[:, 10] = np.log1p(length[:, 0]) / 7
    stats[:, 11] = 1
    return made


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)


@dataclass
class Model:
    """Encoder w, gates v and u, attention a, and the logistic unit c over (z, 1)."""

    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    prior: float | None = None

    def passages(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden vectors of passages and their attention before the softmax."""
        h = np.tanh(features @ self.w)
        return h, (np.tanh(h @ self.v) / (1 + np.exp(-(h @ self.u)))) @ self.a

    def score(self, data: np.ndarray) -> float:
        """Score of one document, chunk by chunk: a running softmax keeps memory bounded."""
        if self.prior is not None:
            return self.prior
        top, total, mean = -np.inf, 0.0, np.zeros(HIDDEN)
        step = CHUNK // PASSAGE * PASSAGE
        for at in range(0, max(len(data), 1), step):
            h, e = self.passages(encode(data[at : at + step]))
            here = max(top, float(e.max()))
            old, new = np.exp(top - here), np.exp(e - here)
            total, mean, top = total * old + new.sum(), mean * old + new @ h, here
        z = np.append(mean / total, 1.0)
        return float(1 / (1 + np.exp(-(z @ self.c))))


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model:
    """Fit on bags of passage features by Adam; labels lie in 0 to 1."""
    if not len(bags) or labels.min() == labels.max():
        return Model(*[np.zeros(0)] * 5, prior=float(labels.mean()) if len(bags) else 0.5)
    rng = np.random.default_rng(seed)
    shapes = {"w": (FEATURES, HIDDEN), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN + 1,)}
    p = {k: (rng.standard_normal(s) * (0.5 if k == "w" else 0.3)).astype(np.float32) for k, s in shapes.items()}
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    mean = min(max(float(labels.mean()), 0.01), 0.99)
    p["c"][-1] = np.log(mean / (1 - mean))
    step = 0
    while step < steps:  # as many steps for few labels as for many
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen, rate = order[at : at + BATCH], RATE * max(0.0, 1 - step / steps) + 1e-4
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float32)
            sizes = np.array([len(bags[i]) for i in chosen])
            starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(chosen)), sizes)
            h = np.tanh(x @ p["w"])
            tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
            e = (tv * su) @ p["a"]
            weight = np.exp(e - np.maximum.reduceat(e, starts)[bag])
            weight /= np.add.reduceat(weight, starts)[bag]
            z = np.add.reduceat(weight[:, None] * h, starts)
            score = 1 / (1 + np.exp(-(z @ p["c"][:-1] + p["c"][-1])))
            off = ((score - labels[chosen]) / len(chosen)).astype(np.float32)
            dz = off[:, None] * p["c"][:-1]
            pull = (dz[bag] * h).sum(axis=1)
            de = weight * (pull - np.add.reduceat(weight * pull, starts)[bag])
            dg = de[:, None] * p["a"]
            dv, du = dg * su * (1 - tv * tv), dg * tv * su * (1 - su)
            dh = weight[:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T
            grads = {"w": x.T @ (dh * (1 - h * h)), "v": h.T @ dv, "u": h.T @ du, "a": (tv * su).T @ de, "c": np.append(z.T @ off, off.sum())}
            step += 1
            for k, g in grads.items():
                m, s = moments[k]
                g = g + DECAY * p[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(**p)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> list[tuple[float, str]]:
    """(label, text) of the sample that is learnt from, in a fixed order."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("label").alias("label"))
    # Twice the sample's ids are enough to fill it where some have no document; at most so many rows of two numbers.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    rows = docs.select("doc_id", version_of(F.col("text")).alias("version"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    rows = rows.join(F.broadcast(known), "doc_id").distinct()
    chosen, total = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "version").limit(most).collect():
        if total + r["size"] <= most_bytes:
            total += r["size"]
            chosen.append((r["doc_id"], r["version"], r["label"]))
    sample = docs.sparkSession.createDataFrame(chosen, "id long, version long, label double")
    texts = docs.join(F.broadcast(sample), (docs["doc_id"] == sample["id"]) & (version_of(docs["text"]) == sample["version"]))
    texts = texts.select(sample["id"], sample["version"], sample["label"], docs["text"]).distinct().collect()
    return [(r["label"], r["text"] or "") for r in sorted(texts, key=lambda r: (r["id"], r["version"]))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    rows = training_rows(docs, labels, label, most)
    bags = [encode(_bytes(text)).astype(np.float16) for _, text in rows]
    return train(bags, np.array([label for label, _ in rows]))


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep + score of every whole text; its name has _ behind it where keep has a score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    small_arrow_batches(spark)
    (score_name,) = free_names(keep, "score")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(_bytes(t)) for t in texts], dtype="float64")

    return docs.select(*keep, score(F.col("text")).alias(score_name))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = scores(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score under the threshold."""
    scored = scores(docs, fit(docs, labels), docs.columns)
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)
