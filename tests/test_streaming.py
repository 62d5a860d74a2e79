import hashlib
import time
from datetime import datetime, timedelta

from leafmill.streaming import ingest


def drained(frame, name, mode="append", least=1):
    """Rows of a stream once they are there; a query with timeouts never runs out of batches."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        for _ in range(300):
            rows = frame.sparkSession.table(name).collect()
            if len(rows) >= least:
                return rows
            time.sleep(0.3)
        return rows
    finally:
        query.stop()


def test_parts_in_any_order(spark, tmp_path):
    whole = [b"abc", b"def", b"g"]
    key = hashlib.sha256(b"".join(whole)).hexdigest()
    schema = "sha256 string, part int, parts int, content binary"
    source = str(tmp_path / "parts")
    spark.createDataFrame([(key, 3, 3, whole[2]), (key, 1, 3, b"old"), ("other", 1, 2, b"x")], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([(key, 1, 3, whole[0]), (key, 2, 3, whole[1])], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = drained(ingest.assembled(stream), "whole_files")
    assert [(r.sha256, bytes(r.content), r.verified) for r in rows] == [(key, b"abcdefg", True)]
    left = {r.sha256: r.missing for r in ingest.missing_parts(spark.createDataFrame([("k", 3, 4, b""), ("k", 1, 4, b"")], schema)).collect()}
    assert left == {"k": [2, 4]}


def test_first_seen_windows_and_inbox(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start), ("a", start + timedelta(seconds=10)), ("b", start + timedelta(seconds=20))]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, "url string, at timestamp").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("url string, at timestamp").parquet(source)
    assert sorted(r.url for r in drained(ingest.first_seen(stream(), "url", "at", ingest.FETCH_TTL), "seen", least=2)) == ["a", "b"]
    counts = drained(ingest.tumbling(stream(), "at", "15 seconds", "1 minute", "url"), "counts", "complete", least=2)
    assert sorted((r.url, r.start.second, r.n) for r in counts) == [("a", 0, 2), ("b", 15, 1)]
    folder = tmp_path / "inbox"
    folder.mkdir()
    (folder / "n.txt").write_text("one\n\ntwo")
    assert sorted(r.text for r in drained(ingest.inbox(spark, str(folder)), "arrived", least=2)) == ["one", "two"]
