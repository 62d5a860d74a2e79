"""Secret scans with an incremental ledger of blobs. DataFrame functions only.

Every text version is addressed by its SHA-256. A ledger says which (blob, rule, rule
version) triples were scanned; only the unseen ones are scanned, each blob once however many
paths hold it, and the findings are joined back to every path.

Defined cases: a null text is the empty blob; rows that share a doc_id are versions of one
path and each gets its own row; repeated rows repeat their row; a table without rows gives
none; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Folder, cut


class Rule(NamedTuple):
    """A pattern; group `group` of a match must have `least` code points."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so this is [0-9a-f]+ of 24 or more
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("live", r"[sr]k_live_[A-Za-z0-9]{20,}", 0, 1),
)
RULES = BASE + MORE


def address(docs: DataFrame) -> DataFrame:
    """(doc_id, text, blob): the path, its content (null: empty) and the content's address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def rule_table(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, version), as few rows as there are rules."""
    return docs.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")


def unseen(addressed: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, doc_id, todo): one path of each blob and the rules still to run on it."""
    reps = addressed.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        return reps.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    done = ledger.join(F.broadcast(rule_table(addressed, rules)), ["rule", "version"]).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    left = reps.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("todo") > 0).drop("done")


def _hits(text: Column, k: int, rule: Rule, todo: Column) -> Column:
    """Matches of one rule in order: what lies before each, its length, its group's length."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    found = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), group.alias("group")),
        lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.length(x.gap).alias("gap"), F.length(x.hit).alias("hit"), F.length(x.group).alias("size")),
    )
    run = F.array_contains(todo, rule.kind) & text.rlike(rule.pattern)
    return F.when(run, F.filter(found, lambda x: x.hit.isNotNull())).otherwise(F.array().cast("array<struct<k:int,i:int,gap:int,hit:int,size:int>>"))


def scan(addressed: DataFrame, todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, rule, version, k, start, end; code points, end exclusive) of what unseen() gave."""
    todo = todo.select(F.col("blob").alias("b"), F.col("doc_id").alias("d"), "todo")
    rows = addressed.join(todo, F.col("blob").eqNullSafe(F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")))
    hits = rows.select("blob", F.explode(F.flatten(F.array(*[_hits(F.col("text"), k, r, F.col("todo")) for k, r in enumerate(rules)]))).alias("x"))
    hits = hits.select("blob", "x.*").dropDuplicates(["blob", "k", "i"])  # paths that repeat a row
    along = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("hit")).over(along))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("k") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("k") + 1)
    version = F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("k") + 1)
    return hits.where(F.col("size") >= least).select("blob", kind.alias("rule"), version.alias("version"), "k", (F.col("end") - F.col("hit")).alias("start"), "end")


def ledger_rows(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What a scan adds to the ledger: (blob, rule, version)."""
    return todo.select("blob", F.explode("todo").alias("rule")).join(F.broadcast(rule_table(todo, rules)), "rule")


def scanned(addressed: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger under `folder` has not seen; findings of all blobs it ever saw.

    Appends the new findings, then the new ledger rows: a run that dies between the two scans
    those blobs again, and distinct() drops what was then found twice.
    """
    spark = addressed.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    ledger = spark.read.parquet(f"{folder}/ledger") if there else None
    work = Folder(spark, "unseen")
    todo = work.keep("todo", unseen(addressed, rules, ledger))
    scan(addressed, todo, rules).write.mode("append").parquet(f"{folder}/findings")
    ledger_rows(todo, rules).write.mode("append").parquet(f"{folder}/ledger")
    work.only()
    # Findings of rules, or of versions of them, that are no longer asked for stay out.
    known = F.broadcast(rule_table(addressed, rules))
    return spark.read.parquet(f"{folder}/findings").join(known, ["rule", "version"], "left_semi").distinct()


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, folder: str = "") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    folder: where the ledger is; a new one in the checkpoint folder if none is given.
    """
    addressed = address(docs)
    found = scanned(addressed, folder or Folder(docs.sparkSession, "ledger").path, rules)
    base = len(BASE)
    span = F.struct("start", "k", F.concat_ws(":", "rule", "start", "end").alias("said"))
    joined = lambda c: F.array_join(F.sort_array(c)["said"], ",")
    # Written out, so that the join below can deal a blob of very many paths to several tasks.
    per_blob = found.groupBy("blob").agg(
        *[F.count_if(F.col("k") == k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])],
        F.sha2(joined(F.collect_list(F.when(F.col("k") < base, span))), 256).alias("base_sha256"),
        joined(F.collect_list(span)).alias("spans"),
    )
    none = {f"n_{r.kind}": F.lit(0).cast("long") for r in rules[:base]} | {"base_sha256": F.sha2(F.lit("").cast("binary"), 256), "spans": F.lit("")}
    return addressed.select("doc_id", "blob").join(cut(per_blob), "blob", "left").select("doc_id", *[F.coalesce(c, e).alias(c) for c, e in none.items()])


def incremental(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every path, scanning only what the ledger under `folder` has not seen."""
    addressed = address(docs)
    found = scanned(addressed, folder, rules)
    return addressed.select("doc_id", "blob").join(found, "blob").select("doc_id", "rule", "start", "end")
