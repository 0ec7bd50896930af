"""The current findings of every path, kept up to date by a stream of revisions.

The table is cut into buckets by path. A micro-batch writes anew the buckets
that its own paths fall into, from what these hold and what the batch brings, and
nothing else; then one row a bucket in the manifest says which folder is the
bucket's. A batch counts when its manifest is there: readers see all of its
buckets or none, a batch that comes again changes nothing, and one that
broke off leaves folders that nobody names.

A revision that is older than the one a path has, or the same again, changes
nothing either, whatever the order in which they arrive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flawsieve.operators.match import FILE_MARKER
from flawsieve.rules import Rule
from flawsieve.sources.folders import delete_folders, folders_below, path_exists, stage
from flawsieve.streaming.revisions import compact, scan_revisions

# A batch names at most this many folders, and so does the manifest.
BUCKETS = 64

_MANIFEST = "bucket int, folder string, batch bigint"


def _manifest(spark: SparkSession, store: str) -> DataFrame:
    """``(bucket, folder)`` of every bucket that has rows, as of the last batch."""
    if not path_exists(spark, f"{store}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    named = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    return named.groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder"))


def _rows(spark: SparkSession, folders: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def update_current(
    log: DataFrame, store: str, batch: int, buckets: int = BUCKETS, staging: str | None = None
) -> None:
    """Bring the log of a batch of scanned revisions (see ``scan_revisions``) into the table ``store``.

    ``batch`` rises from batch to batch. One that the manifest has is passed over.
    """
    spark = log.sparkSession
    if path_exists(spark, f"{store}/manifest/batch={batch}/_SUCCESS"):
        return
    bucket = f"int(pmod(xxhash64(path), {buckets}))"
    new = stage(log, staging).withColumn("_bucket", F.expr(bucket))
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # numbers, no more than there are buckets
    held = {r.bucket: r.folder for r in _manifest(spark, store).collect()}
    old = _rows(spark, [held[b] for b in touched if b in held], log.schema).withColumn("_bucket", F.expr(bucket))
    folder = f"{store}/data/{batch:020d}-{uuid.uuid4().hex[:8]}"
    both = old.unionByName(new)
    compact(both).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    named = spark.createDataFrame([(b, f"{folder}/_bucket={b}") for b in touched], "bucket int, folder string")
    named.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/batch={batch}")


def read_log(spark: SparkSession, store: str, schema: StructType | str) -> DataFrame:
    """The markers and findings of each path's latest revision, as the last whole batch left them."""
    held = [r.folder for r in _manifest(spark, store).collect()]
    schema = spark.createDataFrame([], schema).schema
    return _rows(spark, held, schema)


# What a scan of revisions gives.
LOG = (
    "path string, event_time timestamp, revision bigint, language string, line int, rule_ord int,"
    " issue string, severity string, confidence string, n_lines bigint"
)


def read_current(spark: SparkSession, store: str, schema: StructType | str = LOG) -> DataFrame:
    """The findings of each path's latest revision."""
    return read_log(spark, store, schema).filter(F.col("rule_ord") != FILE_MARKER).drop("n_lines")


def write_current(
    revisions: DataFrame,
    store: str,
    checkpoint: str,
    rules: DataFrame | Iterable[Rule] | None = None,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Scan a stream of revisions and keep the table ``store`` current."""

    def update(batch: DataFrame, number: int) -> None:
        update_current(batch, store, number, buckets)

    return (
        scan_revisions(revisions, rules)
        .writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def expire_current(spark: SparkSession, store: str) -> int:
    """Delete the folders of buckets that no longer are anyone's; how many there were.

    Not while a batch is being written, whose folders nobody names yet.
    """
    named = {r.folder.rpartition("/data/")[2] for r in _manifest(spark, store).collect()}
    gone = [f for f in folders_below(spark, f"{store}/data", 2) if f.rpartition("/data/")[2] not in named]
    delete_folders(spark, gone)
    return len(gone)
