"""assemble: pages of several sources in a given order, with repeats and rotation."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.selection import SelectionError, ordered

_PART = re.compile(r"(all|[\d,\s-]+?)\s*(?:r(90|180|270))?\Z")


def keys(sources: list[str]) -> dict[str, int]:
    """Names of sources: s1, s2, ... always, and file stems, where the first of equals wins."""
    made = {f"s{i}": i - 1 for i in range(1, len(sources) + 1)}
    for i, source in enumerate(sources):
        made.setdefault(PurePosixPath(source).stem, i)
    return made


def parse(select: str, sources: list[str], page_counts: list[int]) -> list[tuple[int, int, int]]:
    """(source index, page, rotation) in order. A clause without a key goes on with the last one."""
    known, now, made = keys(sources), None, []
    for clause in select.split(","):
        key, colon, spec = clause.strip().rpartition(":")
        if colon:
            if key not in known:
                raise SelectionError(f"no source is called {key!r}", "use one of " + ", ".join(known))
            now = known[key]
        if now is None:
            raise SelectionError(f"{clause.strip()!r} names no source", "start with key:pages, for example s1:all")
        part = _PART.match(spec.strip())
        if not part:
            raise SelectionError(f"can't read {clause.strip()!r}", "use key:all, key:1-3 or key:2r90")
        made += [(now, p, int(part[2] or 0)) for p in ordered("" if part[1] == "all" else part[1], page_counts[now])]
    return made


def assemble(pages: DataFrame, plan: list[tuple[str, int, int]]) -> DataFrame:
    """Pages (doc_id, page, rotation, ...) by a plan of (doc_id, page, rotation added)."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(i + 1, *p) for i, p in enumerate(plan)], "position int, doc_id string, page int, turn int")
    joined = wanted.join(pages, ["doc_id", "page"])
    turned = ((F.coalesce("rotation", F.lit(0)) + F.col("turn")) % 360).alias("rotation")
    return joined.select("position", *[turned if c == "rotation" else F.col(c) for c in pages.columns]).orderBy("position")


def without(pages: DataFrame, spec: str, page_count: int) -> DataFrame:
    """Pages but for those of a selection."""
    gone = pages.sparkSession.createDataFrame([(p,) for p in sorted(set(ordered(spec, page_count)))], "page int")
    return pages.join(gone, "page", "left_anti")


def upsert(pages: DataFrame, better: DataFrame, value: str = "text") -> DataFrame:
    """Pages with a column replaced where another table has it for the same page."""
    new = better.select("doc_id", "page", F.col(value).alias("__new"))
    return pages.join(new, ["doc_id", "page"], "left").withColumn(value, F.coalesce("__new", value)).drop("__new")
