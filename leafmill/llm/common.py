"""Small helpers that the training-data operators share."""

from __future__ import annotations

import string
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII blanks (space, tab, LF, VT, FF, CR).
BLANK_WORD = r"[^\x20\x09-\x0D]+"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def version_of(text: Column) -> Column:
    """A 64-bit name of a text; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many _ behind it as keep it from clashing (in any case)."""
    used, made = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        made.append(name)
    return made


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the checkpoint folder that the cluster names; a folder of one's own only in one local process."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafmill-ckpt-"))


def cut(frame: DataFrame) -> DataFrame:
    """Compute a frame now and cut its lineage through the shared checkpoint folder.

    Spark removes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    ensure_checkpoints(frame.sparkSession)
    return frame.checkpoint(eager=True)


class Folder:
    """Tables written to the shared checkpoint folder, so that no step is computed again."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoints(spark)
        self.spark, self.names = spark, set()
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"

    def keep(self, name: str, frame: DataFrame) -> DataFrame:
        """Write a frame and read it back. The shuffle files of the write are not needed after it."""
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            frame.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        self.names.add(name)
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no frame will read any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def only(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[n for n in self.names if n not in names])


def small_arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows an Arrow batch brings to Python, since one text can be megabytes.

    The setting is the session's; all operators use one value, so no lazy frame meets another's.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
