"""Scanning a file tree again as its files are saved.

The file source of a stream goes by name and never reads a rewritten file again.
Here a pass takes a snapshot of the tree (path, size, time of change), as a
table listed by tasks, and compares it with that of the pass before: files that are
new or differ are read and scanned, those that are gone lose their findings, and
all others stay unread. The current findings are kept as in ``streaming.current``.

A pass first writes its snapshot, then brings its findings in as the batch of
its number, and is done when it says so. One that broke off is gone through again
from its snapshot. A file that could not be read is tried again by the next pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from flawsieve.functions.paths import in_scope
from flawsieve.plans.scan import quarantine, scan_read
from flawsieve.rules import Rule
from flawsieve.sources.files import DEFAULT_EXCLUDES
from flawsieve.sources.folders import folders_below, path_exists, stage
from flawsieve.sources.tree import read_with_reasons, walk_tree
from flawsieve.streaming.current import BUCKETS, update_current

_SNAPSHOT = "path string, relative string, length bigint, modified timestamp"


def _passes(spark: SparkSession, store: str) -> tuple[int, int]:
    """The numbers of the last pass that is done and of the one to go through; 0 is before the first."""
    done = [int(f.rpartition("=")[2]) for f in folders_below(spark, f"{store}/done", 1) if path_exists(spark, f"{f}/_SUCCESS")]
    last = max(done, default=0)
    return last, last + 1


def _snapshot(spark: SparkSession, store: str, number: int) -> DataFrame:
    if not number:
        return spark.createDataFrame([], _SNAPSHOT)
    return spark.read.schema(_SNAPSHOT).parquet(f"{store}/snapshots/pass={number}")


def scan_changes(
    spark: SparkSession,
    root: str,
    store: str,
    exclude: Iterable[str] = DEFAULT_EXCLUDES,
    rules: DataFrame | Iterable[Rule] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One pass over the tree at ``root``; gives ``path, reason`` of the files that could not be read."""
    last, number = _passes(spark, store)
    taken = f"{store}/snapshots/pass={number}"
    if not path_exists(spark, f"{taken}/_SUCCESS"):
        found = walk_tree(spark, root, exclude).filter(f"kind = 'file' AND {in_scope('relative', exclude)}")
        found.select("path", "relative", "length", "modified").write.mode("overwrite").parquet(taken)
    now, before = _snapshot(spark, store, number), _snapshot(spark, store, last)
    if last:  # what the last pass could not read counts as not seen
        failed = spark.read.schema("path string, reason string").parquet(f"{store}/done/pass={last}")
        before = before.join(failed, "path", "left_anti")
    same = [now["path"] == before["path"], now["length"] == before["length"], now["modified"].eqNullSafe(before["modified"])]
    changed = now.join(before, same, "left_anti")
    version = f"current_timestamp() AS event_time, {number}L AS revision"
    log = stage(scan_read(read_with_reasons(changed, root), rules).selectExpr("*", *version.split(", ")))
    gone = before.join(now, "path", "left_anti").join(quarantine(log), "path", "left_anti")
    unmarked = [
        f"CAST({value} AS {kind}) AS {name}"
        for name, kind, value in (
            ("language", "string", "NULL"), ("line", "int", "0"), ("rule_ord", "int", "0"), ("issue", "string", "NULL"),
            ("severity", "string", "NULL"), ("confidence", "string", "NULL"), ("n_lines", "bigint", "NULL"),
        )
    ]
    removed = gone.selectExpr("path", *version.split(", "), *unmarked)
    scanned = log.join(quarantine(log), "path", "left_anti").drop("reason")
    update_current(scanned.unionByName(removed), store, number, buckets)
    quarantine(log).coalesce(1).write.mode("overwrite").parquet(f"{store}/done/pass={number}")
    return spark.read.schema("path string, reason string").parquet(f"{store}/done/pass={number}")
