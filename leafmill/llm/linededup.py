"""Substring dedup by line hashing.

Units are lines, or paragraphs between blank lines; a unit of more than LONG_WORDS words is
cut at its sentence ends, so that a passage is found inside a longer line too. Units are
normalised (case, blanks) and digested; equal digests are grouped over the whole corpus and
the earliest occurrence by (doc_id, version, place) stays. Later occurrences are removed where
they follow each other, blank lines aside, for at least `least_run` words: a passage goes
whatever units it is made of, while a short line that many innocent texts share by itself (a
greeting, "all rights reserved") stays. With least_run=1 every later occurrence goes. Offsets
are code points of the original text.

Defined cases: a null text is empty; blank units are never digested and always stay; where
scripts have no blanks, two letters count as a word; a null doc_id ranks first; rows that
share a doc_id are ranked by a hash of their text, and rows that repeat a text under one id
share their fate; a table without rows gives none; deduplicated() keeps extra columns, and a
column of docs whose name it adds stays while the new one has _ behind it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Folder, free_names, small_arrow_batches, version_of

LONG_WORDS, LEAST_RUN = 12, 20
#: Letters of scripts without blanks.
_NO_BLANKS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}]"
_RUNS = "array<struct<a:int,b:int>>"


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def units(text: Column, unit: str = "line", long_words: int = LONG_WORDS) -> Column:
    """The units of a text in order; joined they give the text back."""
    if unit == "line":
        whole = F.split(text, r"(?<=\n)", -1)
    else:  # a paragraph ends behind the blank lines that follow it
        whole = F.regexp_extract_all(text, F.lit(r"(?s).+?(?:\n\s*\n\s*|\z)"), F.lit(0))
    return F.flatten(F.transform(whole, lambda u: F.when(F.size(F.split(u, " ", long_words + 2)) > long_words, F.split(u, r"(?<=[.!?] )", -1)).otherwise(F.array(u))))


def normal(unit: Column) -> Column:
    """What counts of a unit: its words in lower case, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x00-\x20]+", " "))


def weight(unit: Column) -> Column:
    """Words of a normal unit."""
    blanks = F.length(unit) - F.length(F.translate(unit, " ", "")) + 1
    return F.greatest(blanks, F.when(unit.rlike(_NO_BLANKS), F.regexp_count(unit, F.lit(_NO_BLANKS)) / 2).otherwise(0).cast("int"))


def later(docs: DataFrame, folder: Folder, unit: str = "line") -> DataFrame:
    """(doc_id, version, at, seq, words): units that occurred before; seq counts those that are not blank."""
    rows = docs.select("doc_id", version_of(F.col("text")).alias("version"), units(_text(), unit).alias("units"))
    said = F.filter(F.transform("units", lambda u, i: F.struct(i.alias("at"), normal(u).alias("unit"))), lambda x: F.length(x.unit) > 0)
    rows = rows.select("doc_id", "version", F.posexplode(said).alias("seq", "x"))
    found = rows.select(F.unhex(F.md5("x.unit")).alias("digest"), F.struct("doc_id", "version", "seq", F.col("x.at").alias("at")).alias("place"), weight(F.col("x.unit")).alias("words"))
    kept = found.groupBy("digest").agg(F.min("place").alias("kept"), F.max("place").alias("last")).where("kept <> last").select("digest", "kept")
    # Written out, so that the join can deal a unit of very many places to several tasks.
    kept = folder.keep("kept", kept)
    # One plan at every size: a merge join, whose larger side is split where a key is hot.
    return found.join(kept.hint("merge"), "digest").where("place <> kept").select("place.*", "words")


def removals(docs: DataFrame, unit: str = "line", least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, version, runs): the units to remove, as ranges of places, end exclusive, ascending."""
    folder = Folder(docs.sparkSession, "lines")
    # Rows that repeat a text under one id name the same places.
    seen = later(docs, folder, unit).groupBy("doc_id", "version", "seq").agg(F.first("at").alias("at"), F.first("words").alias("words"))
    along = Window.partitionBy("doc_id", "version").orderBy("seq")
    seen = seen.withColumn("run", F.col("seq") - F.row_number().over(along))
    runs = seen.groupBy("doc_id", "version", "run").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"), F.sum("words").alias("words"))
    runs = runs.where(F.col("words") >= least_run).groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    return folder.keep("runs", runs)


def _cut(units: pd.Series, runs: pd.Series) -> pd.DataFrame:
    made = []
    for parts, gone in zip(units, runs):
        if parts is None:
            made.append((None, None, 0))
            continue
        kept, spans, n, at, upto = [], [], 0, 0, 0
        for a, b in ((r["a"], r["b"]) for r in gone):
            for k in range(upto, a):
                kept.append(parts[k])
                at += len(parts[k])
            begin = at
            for k in range(a, b):
                # A blank unit inside a run stays, as blank units always do.
                if parts[k].strip("".join(map(chr, range(33)))):
                    n += 1
                    at += len(parts[k])
                else:
                    spans += [f"{begin}:{at}"] if at > begin else []
                    kept.append(parts[k])
                    begin = at = at + len(parts[k])
            spans += [f"{begin}:{at}"] if at > begin else []
            upto = b
        kept += list(parts[upto:])
        made.append(("".join(kept), spans, n))
    return pd.DataFrame(made, columns=["text", "spans", "n_removed"])


def deduplicated(docs: DataFrame, unit: str = "line", least_run: int = LEAST_RUN, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or the columns in keep) with text cut, and n_units, n_removed and spans."""
    small_arrow_batches(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c != "text"]
    id_, version, runs, whole, made, *added = free_names([*docs.columns, "text"], "doc", "version", "runs", "whole", "made", "n_units", "n_removed", "spans")
    gone = removals(docs, unit, least_run).toDF(id_, version, runs)
    rows = docs.withColumn(whole, _text())
    rows = rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (version_of(F.col(whole)) == F.col(version)), "left")
    touched = F.col(runs).isNotNull()
    cut = F.pandas_udf(_cut, "text string, spans array<string>, n_removed long")
    parts = units(F.col(whole), unit)
    # Only texts that lose something are brought to Python.
    rows = rows.select(*keep, whole, F.size(parts).cast("long").alias(added[0]), touched.alias(id_), cut(F.when(touched, parts), F.col(runs).cast(_RUNS)).alias(made))
    return rows.select(
        *keep, F.when(F.col(id_), F.col(made)["text"]).otherwise(F.col(whole)).alias("text"), added[0],
        F.col(made)["n_removed"].alias(added[1]), F.coalesce(F.col(made)["spans"], F.array().cast("array<string>")).alias(added[2]),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_units, n_removed, spans, kept_sha256."""
    made = deduplicated(docs.select("doc_id", "text"), keep=("doc_id",))
    return made.select("doc_id", "n_units", "n_removed", F.array_join("spans", ",").alias("spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
