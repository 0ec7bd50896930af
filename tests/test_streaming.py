"""Streams of file revisions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flawsieve.streaming.revisions import compact, current_findings, scan_revisions, write_revision_log
from querysuite.corpus import revisions

SCHEMA = "path string, content string, event_time timestamp, revision bigint"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    query = write_revision_log(stream, f"{folder}/log", f"{folder}/checkpoint", trigger={"availableNow": True})
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    return spark.read.parquet(f"{folder}/log")


def add(spark, folder, *rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def current(log):
    rows = current_findings(log).select("path", "revision", "line", "rule_ord").collect()
    return sorted(tuple(r) for r in rows)


def test_new_revision_replaces_old(spark, folder):
    add(spark, folder, ("a.py", "eval(x)\nexec(y)", at(1), 1), ("b.js", "eval(x)", at(1), 1), ("n.txt", "eval(", at(1), 1))
    log = run(spark, folder)
    assert current(log) == [("a.py", 1, 1, 1), ("a.py", 1, 2, 2), ("b.js", 1, 1, 1)]

    add(spark, folder, ("a.py", "exec(y)", at(2), 2))
    assert current(run(spark, folder)) == [("a.py", 2, 1, 2), ("b.js", 1, 1, 1)]

    add(spark, folder, ("b.js", "clean", at(3), 2))  # became clean
    add(spark, folder, ("a.py", "exec(y)", at(2), 2))  # delivered again
    add(spark, folder, ("a.py", "eval(late)", at(1), 1))  # late and superseded
    assert current(run(spark, folder)) == [("a.py", 2, 1, 2)]

    add(spark, folder, ("c.py", "exec(y)", at(0), 1))  # late, yet the first of its file
    add(spark, folder, ("a.py", "eval(x)", at(2), 3))  # same time, later revision
    assert current(run(spark, folder)) == [("a.py", 3, 1, 1), ("c.py", 1, 1, 2)]


def test_stream_equals_batch(spark, folder, sf_small):
    files = revisions(spark, sf_small).select(
        "path", "content", F.col("event_time").cast("timestamp").alias("event_time"), "revision"
    )
    files.filter("revision = 1").repartition(3).write.mode("append").parquet(f"{folder}/in")
    files.filter("revision = 2").repartition(2).write.mode("append").parquet(f"{folder}/in")
    log = run(spark, folder)
    batch = scan_revisions(files)
    assert log.exceptAll(batch).isEmpty() and batch.exceptAll(log).isEmpty()
    assert current(log) == current(batch) != []
    assert current_findings(log).filter("revision = 2").isEmpty()


def test_restart_without_news_writes_nothing(spark, folder):
    add(spark, folder, ("a.py", "eval(x)", at(1), 1))
    before = run(spark, folder).count()
    assert run(spark, folder).count() == before == 2


@pytest.mark.parametrize("copies", [1, 500])
def test_history_of_a_hot_file(spark, copies):
    df = spark.range(copies).select(
        F.lit("a.py").alias("path"),
        F.lit("eval(x)").alias("content"),
        F.timestamp_seconds("id").alias("event_time"),
        F.col("id").alias("revision"),
    )
    assert current(scan_revisions(df.union(df))) == [("a.py", copies - 1, 1, 1)]


def test_null_versions_keep_their_findings(spark):
    from flawsieve.streaming.revisions import current_findings, scan_revisions

    rows = [("a.py", "eval(x)", None, None), ("b.py", "eval(x)", None, 2), ("b.py", "x = 1", None, 3)]
    files = spark.createDataFrame(rows, "path string, content string, event_time timestamp, revision bigint")
    assert [r.path for r in current_findings(scan_revisions(files)).collect()] == ["a.py"]


def test_compaction_keeps_the_view(spark, folder):
    add(spark, folder, ("a.py", "eval(x)", at(1), 1), ("b.js", "eval(x)", at(1), 1), ("b.js", "eval(x)", None, None))
    add(spark, folder, ("a.py", "exec(y)", at(2), 2), ("b.js", "eval(x)", at(1), 1), ("c.py", "eval(x)", None, None))
    log = run(spark, folder)
    compact(log).write.parquet(f"{folder}/compact")
    small = spark.read.parquet(f"{folder}/compact")
    assert current(small) == current(log) == [("a.py", 2, 1, 2), ("b.js", 1, 1, 1), ("c.py", None, 1, 1)]
    assert log.count() == 12 and small.count() == 6
