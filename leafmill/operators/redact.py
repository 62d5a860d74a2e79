"""redact: drop every text run that matches, then look again and fail if anything is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import literal
from leafmill.operators.search import guarded_count


class ResidualMatch(RuntimeError):
    """Something still matches after redaction, for instance across two runs."""


def _count(text: Column, pattern: str, regex: bool) -> Column:
    """How often a text matches. A user's pattern never runs in the JVM, where nothing could interrupt it."""
    if regex:
        return guarded_count(pattern)(text)
    return F.coalesce(F.regexp_count(text, F.lit(f"(?iu){literal(pattern)}")), F.lit(0)).cast("long")


def redact(runs: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """Runs (doc_id, page, run, text) without those that match: the whole run goes, not the match."""
    return runs.where(_count(F.col("text"), pattern, regex) == 0)


def summary(runs: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """Per document: runs redacted and pages they were on."""
    counted = runs.select("doc_id", "page", (_count(F.col("text"), pattern, regex) > 0).alias("hit"))
    return counted.groupBy("doc_id").agg(F.count_if("hit").alias("redacted"), F.count_distinct(F.when(F.col("hit"), F.col("page"))).alias("pages"))


def residual(runs: DataFrame, pattern: str, regex: bool = False, glue: str = "") -> DataFrame:
    """Per page: matches in what the remaining runs say together, which must be none."""
    text = runs.groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("run", "text")))["text"], glue).alias("text"))
    return text.select("doc_id", "page", _count(F.col("text"), pattern, regex).alias("residual_matches"))


def verified(runs: DataFrame, pattern: str, regex: bool = False, glue: str = "") -> DataFrame:
    """redact() that raises if the result still matches."""
    kept = redact(runs, pattern, regex)
    left = residual(kept, pattern, regex, glue).agg(F.sum("residual_matches")).first()[0] or 0
    if left:
        raise ResidualMatch(f"{left} matches remain, across runs")
    return kept
