"""Suffix-array dedup of byte strings: every byte that a repeated 200-byte string covers.

1. Keys. In each string of LENGTH bytes one GRAM-byte gram has the least hash; with the bytes
   on its longer side it makes a key of LONG bytes. Equal strings have equal keys, so strings
   whose key has one place in the corpus are not repeated. (Equal texts share their places.)
2. Segments. A run of strings with one repeated key goes to the shard that the key names.
   Equal segments become one, with their number, so a passage that a third of all documents
   hold is one row of a shard.
3. Suffix arrays. A shard sorts the suffixes of its segments by induced sorting (SA-IS):
   suffixes are classified, leftmost-smaller substrings sorted and named, the string of names
   sorted in the same way, level by level, and the array induced, many buckets at a time. The
   permuted common prefixes then tell which strings occur again.
4. Documents. Repeated strings are joined back to the documents and their bytes removed.

Defined cases: a null text is empty; texts under LENGTH bytes stay whole; a text that
repeats as a whole goes wholly if it has LENGTH bytes; matches never cross documents; rows
that share a doc_id are judged each by its own text; a table without rows gives none; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Folder, small_arrow_batches, version_of

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # grams in a string
#: A string reaches this far beyond its anchor's start on the left, or beyond its end on the right.
REACH = (LENGTH - GRAM) // 2
LONG = GRAM + REACH
#: Bytes hashed at a time; places within them fit 20 bits.
CHUNK = 1 << 16
#: Places and names in a shard; most of a worker's memory are arrays of these.
PLACE = np.int32
_A, _B, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64((1 << 20) - 1)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width, the hash of every gram of so many bytes, by doubling."""
    x, step, made = (data.astype(np.uint64) + np.uint64(1)) * _B, 1, [None] * len(widths)
    while True:
        for k, width in enumerate(widths):
            if width & step:
                n = len(data) - (width & (2 * step - 1)) + 1
                made[k] = x[:n] if made[k] is None else _joined(x[:n], made[k][step : step + n])
        if 2 * step > max(widths):
            return made
        x, step = _joined(x[:-step], x[step:]), 2 * step


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _chunk(data: np.ndarray, ends: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segments() of the first `count` starts; ends: the end of the text that holds each start."""
    h, far = gram_hashes(data, GRAM, LONG)
    low = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), SPAN)[:count]
    at = (low & _PLACE).astype(np.int64)
    starts = np.arange(len(at))
    side = starts <= at - REACH
    key_at = np.where(side, at - REACH, at)
    inside = starts + LENGTH <= ends[: len(at)]
    # One number tells apart which text, key and side a start has; -1 is none.
    run = np.where(inside, (ends[: len(at)] << 21) | (key_at << 1) | side, -1)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    good = inside[first]
    first, last = first[good], last[good]
    return far[key_at[first]] ^ side[first].astype(np.uint64), first, last


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, first, last): runs of starts of LENGTH-byte strings that share a key.

    A string's anchor is the first of its grams with the least hash. Its key is the hash of
    the LONG bytes up to the anchor's end if it holds them, else of those from its start.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data, begins = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes) - sizes
    found = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        count = min(CHUNK, len(data) - LENGTH + 1 - at)
        piece = data[at : at + count + LENGTH - 1]
        low = np.searchsorted(begins, at, side="right") - 1
        high = np.searchsorted(begins, at + count, side="left")
        ends = np.repeat(begins[low:high] + sizes[low:high], np.diff(np.r_[at, np.clip(begins[low + 1 : high], at, at + count), at + count])) - at
        key, first, last = _chunk(piece, ends, count)
        found.append((key, first + at, last + at))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    key, first, last = (np.concatenate(x) for x in zip(*found))
    text = np.searchsorted(begins + sizes, first, side="right")
    return text, key, first - begins[text], last - begins[text]


def _cuts(low: np.ndarray, high: np.ndarray, size: int) -> list[int]:
    """Bounds of the fewest ranges of characters that hold no pair low < high both."""
    nearest = np.full(size + 1, size, dtype=PLACE)
    np.minimum.at(nearest, low, high)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    made = [0]
    while made[-1] < size:
        made.append(int(nearest[made[-1]]))
    return made


class _Buckets:
    """Places sorted by their character, filled in the order of arrival."""

    def __init__(self, text: np.ndarray, members: np.ndarray, size: int):
        self.text, counts = text, np.bincount(text[members], minlength=size)
        self.start = np.r_[0, np.cumsum(counts)].astype(PLACE)
        self.next, self.held = self.start[:-1].copy(), np.empty(len(members), dtype=PLACE)
        self.char = np.repeat(np.arange(size, dtype=PLACE), counts)

    def put(self, places: np.ndarray) -> None:
        if not len(places):
            return
        chars = self.text[places]
        by = np.argsort(chars, kind="stable")
        chars = chars[by]
        first = np.concatenate(([0], np.flatnonzero(chars[1:] != chars[:-1]) + 1)).astype(PLACE)
        ends = np.append(first[1:], PLACE(len(chars)))
        heads, count = chars[first], ends - first
        at = np.arange(len(chars), dtype=PLACE)
        at += np.repeat(self.next[heads] - first, count)
        self.held[at] = places[by]
        self.next[heads] += count

    def complete(self, low: int, high: int) -> bool:
        return bool((self.next[low:high] == self.start[low + 1 : high + 1]).all())

    def arrived(self, low: int, high: int) -> np.ndarray:
        at = np.arange(self.start[low], self.start[high], dtype=PLACE)
        return self.held[at[at < self.next[self.char[at]]]]

    def whole(self, low: int, high: int) -> np.ndarray:
        return self.held[self.start[low] : self.start[high]]


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes induce: L-types, then S-types.

    A suffix is induced by the next. Buckets are scanned in order, as many at a time as hold
    no suffix that induces one of another bucket among them; inside a bucket, equal
    neighbours induce each other in rounds.
    """
    same = np.concatenate(([False], text[:-1] == text[1:]))
    first = np.zeros(len(text), dtype=bool)
    first[0] = True
    smaller_before = np.concatenate(([False], is_s[:-1]))

    def scan(buckets: _Buckets, twin: np.ndarray, low: int, high: int) -> np.ndarray:
        if not buckets.complete(low, high):
            now = buckets.arrived(low, high)
            while len(now := now[twin[now]] - 1):
                buckets.put(now)
        return buckets.whole(low, high)

    here, after, smaller = text[:-1], text[1:], is_s[:-1]
    larger = _Buckets(text, np.flatnonzero(~is_s), size)
    larger.put(np.array([len(text) - 1], dtype=PLACE))  # by the end, which is smaller than all
    falls = ~smaller & (after < here)
    bounds = _cuts(after[falls], here[falls], size)
    at = np.searchsorted(text[seeds], bounds)
    del falls
    twin, other = same & ~smaller_before, ~same & ~smaller_before & ~first
    for low, high, a, b in zip(bounds, bounds[1:], at.tolist(), at[1:].tolist()):
        found = scan(larger, twin, low, high)
        if b > a:
            found = np.concatenate([found, seeds[a:b]])
            found = found[np.argsort(text[found], kind="stable")]
        larger.put(found[other[found]] - 1)
    # The same from the other end, with characters counted downwards.
    rises = smaller & (here < after)
    bounds = [size - x for x in _cuts(size - 1 - after[rises], size - 1 - here[rises], size)]
    del rises
    less = _Buckets(text, np.flatnonzero(is_s), size)
    twin, other = same & smaller_before, ~same & smaller_before
    for high, low in zip(bounds, bounds[1:]):
        found = np.concatenate([scan(less, twin, low, high), larger.whole(low, high)[::-1]])
        if high - low > 1:
            found = found[np.argsort(-text[found], kind="stable")]
        less.put(found[other[found]] - 1)
    # A bucket of S-types was filled from its largest on.
    turned = less.start[less.char] + less.start[less.char + 1] - 1 - np.arange(len(less.char), dtype=PLACE)
    whole = np.concatenate([larger.held, less.held[turned]])
    del larger, less, turned, same, twin, other, smaller_before, first
    return whole[np.argsort(text[whole], kind="stable")]


def _same_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether pairs of leftmost-smaller substrings are equal."""
    equal = n_a == n_b
    todo, k = np.flatnonzero(equal), 0
    while len(todo):
        same = text[a[todo] + k] == text[b[todo] + k]
        equal[todo[~same]] = False
        todo = todo[same & (k + 1 < n_a[todo])]
        k += 1
    return equal


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix array by induced sorting; text holds numbers under size, its end is smaller than all.

    Suffixes are classified, leftmost-smaller substrings sorted by an induction and named; the
    string of names is sorted in the same way, unless all its names differ; its order induces
    that of all suffixes.
    """
    n = len(text)
    # A suffix is S-type if it is smaller than the next: by the first neighbour that differs.
    change = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    up = np.r_[text[change[:-1]] < text[change[:-1] + 1], False]
    is_s = np.repeat(up, np.diff(np.r_[-1, change]))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(PLACE) + PLACE(1)
    del change, up
    seeds = lms[np.argsort(text[lms], kind="stable")]
    if len(lms) > 1:
        mark = np.zeros(n, dtype=bool)
        mark[lms] = True
        first = _induce(text, is_s, seeds, size)
        by_substring = first[mark[first]]
        del first, mark
        length = np.zeros(n, dtype=PLACE)
        length[lms] = np.diff(np.r_[lms, n]) + 1
        length[lms[-1]] = n + 2  # it ends with the text, as no other does
        a, b = by_substring[:-1], by_substring[1:]
        name = np.cumsum(np.r_[0, ~_same_substrings(text, a, b, length[a], length[b])], dtype=PLACE)
        del length, a, b
        names = np.empty(n, dtype=PLACE)
        names[by_substring] = name
        count, names = int(name[-1]) + 1, names[lms]
        del name
        seeds = by_substring if count == len(lms) else lms[suffix_array(names, count)]
        del names
    return _induce(text, is_s, seeds, size)


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Permuted common prefixes: at each place, with the suffix before it in order, `most` at most.

    All segments advance together, each place starting from its left neighbour's less one.
    """
    n = len(text)
    before = np.full(n, -1, dtype=PLACE)
    before[order[1:]] = order[:-1]
    made = np.zeros(n, dtype=np.int16)
    sizes = np.diff(np.r_[begins, n])
    by = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[by], sizes[by]
    level = np.zeros(len(begins), dtype=np.int64)
    for t in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at, level = begins[:live] + t, np.maximum(level[:live] - 1, 0)
        other = before[at]
        level[other < 0] = 0
        todo = np.flatnonzero((other >= 0) & (level < most))
        while len(todo):
            x, y = text[at[todo] + level[todo]], text[other[todo] + level[todo]]
            todo = todo[x == y]
            level[todo] += 1
            todo = todo[level[todo] < most]
        made[at] = level
    return made


def repeated_starts(pieces: list[bytes], most: int = LENGTH) -> list[np.ndarray]:
    """For each piece, whether the string of `most` bytes at each start occurs in them again."""
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    # Each separator is a character of its own, so no suffix compares beyond one.
    text = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8).astype(np.int32) + len(pieces)
    text[begins + sizes - 1] = np.arange(len(pieces))
    order = suffix_array(text, len(pieces) + 256)
    common = common_prefixes(text, order, begins, most)
    again = common >= most
    again[order[:-1]] |= again[order[1:]]
    return [again[b : max(b, b + n - most)] for b, n in zip(begins.tolist(), sizes.tolist())]


KEY_ROWS = "key long, c1 long, c2 long, first int, last int"
SEGMENT_ROWS = "key long, sid binary, piece binary, c1 long, c2 long, first int"
RUNS = "key long, sid binary, runs array<struct<a:int,b:int>>"
#: Bytes of segments in a shard, about.
SHARD_BYTES = 3_000_000


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _groups(pdf: pd.DataFrame, most: int = 1 << 20):
    """Rows of a batch, about `most` bytes at a time."""
    texts, rows, size = [], [], 0
    for i, t in enumerate(pdf["text"]):
        texts.append(t.encode("utf-8", "replace"))
        rows.append(i)
        size += len(texts[-1])
        if size >= most:
            yield rows, texts
            texts, rows, size = [], [], 0
    if rows:
        yield rows, texts


def _key_rows(batches):
    for pdf in batches:
        for rows, texts in _groups(pdf):
            text, key, first, last = segments(texts)
            at = pdf.iloc[rows]
            yield pd.DataFrame({"key": key.view(np.int64), "c1": at["c1"].to_numpy()[text], "c2": at["c2"].to_numpy()[text], "first": first.astype(np.int32), "last": last.astype(np.int32)})


def _segment_rows(batches):
    seen: set = set()  # a segment's bytes leave a task once, or again when this set was full
    for pdf in batches:
        keys, sids, pieces, owners, firsts = [], [], [], [], []
        for i, (text, key, first, last) in enumerate(zip(pdf["text"], pdf["keys"], pdf["firsts"], pdf["lasts"])):
            data = text.encode("utf-8", "replace")
            for k, a, b in zip(key.tolist(), first.tolist(), (last + LENGTH).tolist()):
                piece = data[a:b]
                sid = hashlib.blake2b(piece, digest_size=16).digest()
                named = (k, sid)
                if named in seen:
                    piece = None
                else:
                    seen.add(named)
                sids.append(sid)
                pieces.append(piece)
            keys.append(key)
            firsts.append(first)
            owners.append(np.full(len(key), i))
        if len(seen) > 300_000:
            seen.clear()
        owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        yield pd.DataFrame({"key": joined(keys), "sid": sids, "piece": pieces, "c1": pdf["c1"].to_numpy()[owner], "c2": pdf["c2"].to_numpy()[owner], "first": joined(firsts)})


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each segment, the runs of starts whose strings occur again in the corpus."""
    pieces = [bytes(p) for p in pdf["piece"]]
    flags = [np.full(len(p) - LENGTH + 1, n > 1) for p, n in zip(pieces, pdf["n"])]
    several = pdf["key"].duplicated(keep=False).to_numpy()
    # Only strings with one key can be equal, so a key with one segment needs no array.
    chosen = np.flatnonzero(several)
    if len(chosen):
        for i, again in zip(chosen, repeated_starts([pieces[i] for i in chosen])):
            flags[i] = flags[i] | again
    return pd.DataFrame({"key": pdf["key"], "sid": pdf["sid"], "runs": [_runs(f) for f in flags]})


def _digest_rows(batches):
    for pdf in batches:
        made = []
        for text, c1, c2, low, high in zip(pdf["text"], pdf["c1"], pdf["c2"], pdf["low"], pdf["high"]):
            data, spans = text.encode("utf-8", "replace"), []
            for a, b in sorted(zip(low.tolist(), (high + (LENGTH - 1)).tolist())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            cuts = [0, *[x for s in spans for x in s], len(data)]
            kept = hashlib.sha256()
            for a, b in zip(cuts[::2], cuts[1::2]):
                kept.update(data[a:b])
            made.append((c1, c2, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
        yield pd.DataFrame(made, columns=["c1", "c2", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(docs: DataFrame) -> DataFrame:
    """(c1, c2, n_removed, n_spans, kept_sha256, spans) of texts with repeated strings.

    c1 and c2, xxhash64 and CRC-32, name a text. Texts that repeat as a whole are left out:
    they go wholly, and count here once.
    """
    spark = docs.sparkSession
    folder = Folder(spark, "suffix")
    small_arrow_batches(spark)
    read = docs.select("doc_id", _text().alias("text")).where(F.octet_length("text") >= LENGTH)
    read = read.select("doc_id", "text", F.xxhash64("text").alias("c1"), F.crc32("text").alias("c2"))
    keys = folder.keep("keys", read.select("text", "c1", "c2").mapInPandas(_key_rows, KEY_ROWS))
    place = F.xxhash64("c1", "c2", "first")
    # Written out, so that the join below can deal a key of very many places to several tasks.
    common = folder.keep("common", keys.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key"))
    listed = keys.join(common, "key").groupBy("c1", "c2").agg(F.collect_set(F.struct("key", "first", "last")).alias("listed"))
    copies = read.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    listed = folder.keep("listed", listed.join(copies, ["c1", "c2"]))
    folder.drop("keys", "common")
    same = lambda other: F.col("t.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("t.c1") == F.col(f"{other}.c1")) & (F.col("t.c2") == F.col(f"{other}.c2"))
    texts = read.alias("t").join(listed.alias("l"), same("l"))
    texts = texts.select("t.text", "t.c1", "t.c2", F.col("l.listed.key").alias("keys"), F.col("l.listed.first").alias("firsts"), F.col("l.listed.last").alias("lasts"))
    found = folder.keep("segments", texts.mapInPandas(_segment_rows, SEGMENT_ROWS))
    distinct = found.groupBy("key", "sid").agg(F.max("piece").alias("piece"), F.count("*").alias("n"))
    size = found.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    runs = folder.keep("runs", sharded.groupBy("shard").applyInPandas(_shard, RUNS).where(F.size("runs") > 0))
    back = found.select("key", "sid", "c1", "c2", "first").join(runs, ["key", "sid"])
    back = back.select("c1", "c2", F.transform("runs", lambda r: F.struct((r.a + F.col("first")).alias("a"), (r.b + F.col("first")).alias("b"))).alias("runs"))
    back = back.groupBy("c1", "c2").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))
    # Whole copies need no reading: their removal is known.
    back = back.join(listed.where("copies = 1").select("c1", "c2", "doc_id"), ["c1", "c2"])
    back = folder.keep("back", back)
    folder.drop("segments", "runs", "listed")
    texts = read.alias("t").join(back.alias("l"), same("l")).select("t.text", "t.c1", "t.c2", F.col("l.runs.a").alias("low"), F.col("l.runs.b").alias("high"))
    made = texts.mapInPandas(_digest_rows, "c1 long, c2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>")
    made = folder.keep("digests", made)
    folder.drop("back")
    return made


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    digests = repeats(docs).drop("spans").withColumnRenamed("kept_sha256", "sha")
    rows = docs.select("doc_id", _text().alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("c1"), F.crc32("text").alias("c2"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    copies = rows.groupBy("c1", "c2").agg(F.count("*").alias("copies"))
    known = copies.where("copies > 1").join(digests, ["c1", "c2"], "full_outer")
    rows = rows.join(known, ["c1", "c2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    )
