"""Tagged facts: a star join of facts, contexts and units; values stay the strings they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period(instant: Column, start: Column, end: Column) -> Column:
    """A period in words: at D, or D1 to D2."""
    return F.when(instant.isNotNull(), F.concat(F.lit("at "), instant)).when(start.isNotNull() | end.isNotNull(), F.concat(F.coalesce(start, F.lit("")), F.lit(" to "), F.coalesce(end, F.lit(""))))


def with_context(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """facts with their context's period; a reference without a context stays as it is.

    No broadcast hint: contexts grow with the filings, so the size decides at run time.
    """
    named = contexts.select("doc_id", F.col("id").alias("context_ref"), "period")
    return facts.join(named, ["doc_id", "context_ref"], "left").withColumn("context", F.coalesce("period", "context_ref")).drop("period")


def with_unit(facts: DataFrame, units: DataFrame) -> DataFrame:
    """facts with their unit's measure; "" without one."""
    named = units.select("doc_id", F.col("id").alias("unit_ref"), "measure")
    return facts.join(named, ["doc_id", "unit_ref"], "left").withColumn("unit", F.coalesce("measure", F.lit(""))).drop("measure")


def counts(facts: DataFrame) -> DataFrame:
    """Per document: facts, numeric ones (those with a unit) and the units in order."""
    return facts.groupBy("doc_id").agg(
        F.count("*").alias("facts"),
        F.count_if(F.col("unit") != "").alias("numeric_facts"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("unit") != "", F.col("unit")))), ",").alias("units"),
    )


def spine(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chapters in spine order: references without an entry are dropped."""
    return items.join(manifest, ["doc_id", "idref"]).orderBy("doc_id", "position")
