"""Streaming extension: documents as they arrive, uploads in parts, caches and tokens that expire."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.sources import base

#: Seconds that the parts of an upload wait for one another, a fetched page is reused, a token is good.
PART_TTL, FETCH_TTL, TOKEN_TTL = 3600, 300, 900


def inbox(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Blocks of files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return base.read_column(files.select("path", "content"), "path", "content")


def first_seen(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """The first row of each key within a span: a fetch cache, or tokens that work once."""
    return rows.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, at: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and key; rows later than `late` are dropped."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


PARTS_STATE = "parts array<struct<part:int,content:binary>>"
PARTS_OUT = "sha256 string, bytes long, content binary, verified boolean"


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = {p["part"]: bytes(p["content"]) for p in state.get[0]} if state.exists else {}
    total = 0
    for pdf in batches:
        for part, of, content in zip(pdf["part"], pdf["parts"], pdf["content"]):
            held[int(part)] = bytes(content)  # a part that is sent again replaces the old one
            total = int(of)
    if total and len(held) >= total and not set(range(1, total + 1)) - set(held):
        whole = b"".join(held[i] for i in range(1, total + 1))
        state.remove()
        yield pd.DataFrame([(key[0], len(whole), whole, hashlib.sha256(whole).hexdigest() == key[0])], columns=["sha256", "bytes", "content", "verified"])
        return
    state.update(([{"part": k, "content": v} for k, v in held.items()],))
    state.setTimeoutDuration(PART_TTL * 1000)


def assembled(parts: DataFrame) -> DataFrame:
    """Whole files from parts (sha256 of the whole, part, parts, content) in any order."""
    return parts.groupBy("sha256").applyInPandasWithState(_gather, PARTS_OUT, PARTS_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def missing_parts(parts: DataFrame) -> DataFrame:
    """(sha256, missing): numbers still to come, of a batch of received parts."""
    got = parts.groupBy("sha256").agg(F.max("parts").alias("n"), F.collect_set("part").alias("got"))
    return got.select("sha256", F.array_except(F.sequence(F.lit(1), "n"), "got").alias("missing"))
