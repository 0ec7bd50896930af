"""Sinks for findings, and a store of scan runs."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flawsieve.operators.numbering import IS_FINDING, PART_SIZE
from flawsieve.plans.reports import numbered_lines
from flawsieve.sources.folders import compact_files, delete_folders, folders_below, shared_folder, stage

FORMATS = ("json", "text", "parquet")


def write_findings(
    log: DataFrame, path: str, fmt: str = "json", part_size: int = PART_SIZE, staging: str | None = None
) -> None:
    """Write findings to the folder ``path``.

    ``json`` and ``parquet`` hold one finding per row.  ``text`` holds a line
    with the file's path and then its numbered findings, clean files included;
    the parts of a long file follow each other in order.  It reads the log
    twice, so keeps it in ``staging`` (see ``stage``).
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}: {fmt}")
    if fmt == "text":
        parts = numbered_lines(stage(log, staging), part_size)
        text = F.concat_ws("\n", F.when(F.col("opens"), F.col("path")), "text").alias("value")
        lines = parts.select("path", "part", text).repartitionByRange("path", "part").sortWithinPartitions("path", "part")
        lines.select("value").write.mode("overwrite").text(path)
    else:
        compact_files(log.filter(IS_FINDING).drop("n_lines")).write.format(fmt).mode("overwrite").save(path)


def write_run(log: DataFrame, store: str, run_id: int) -> None:
    """Store a scan log as run ``run_id``.

    Every attempt has a folder of its own, and a row in ``runs`` that is added
    when the log is complete.  Readers take the newest such attempt, so one that
    failed half-way never counts, and the run before it stays whole.
    """
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    stored = stage(log, f"{store}/log/run_id={run_id}/attempt={attempt}")
    counts = stored.agg(
        F.lit(attempt).alias("attempt"),
        F.expr(f"count_if(NOT {IS_FINDING}) AS n_files"),
        F.expr(f"count_if({IS_FINDING}) AS n_issues"),
    )
    counts.coalesce(1).write.mode("append").parquet(f"{store}/runs/run_id={run_id}")


def _attempts(spark: SparkSession, store: str) -> DataFrame:
    schema = "attempt string, n_files bigint, n_issues bigint, run_id bigint"
    runs = spark.read.schema(schema).parquet(f"{store}/runs")
    return runs.groupBy("run_id").agg(F.max(F.struct("attempt", "n_files", "n_issues")).alias("_newest")).select("run_id", "_newest.*")


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    """``run_id, n_files, n_issues`` of every run, by its newest attempt."""
    return _attempts(spark, store).drop("attempt")


def last_run(spark: SparkSession, store: str) -> DataFrame | None:
    """The log of the run with the greatest id, or None if it found nothing."""
    newest = _attempts(spark, store).agg(F.max(F.struct("run_id", "attempt", "n_issues")).alias("_last")).first()[0]
    if newest is None or not newest.n_issues:
        return None
    # That attempt's folder alone; no other run's files are listed.
    return spark.read.parquet(f"{store}/log/run_id={newest.run_id}/attempt={newest.attempt}")


def last_run_of(log: DataFrame) -> DataFrame:
    """The rows of the greatest ``run_id`` in a table that holds several runs.

    The other side of the join is a single row, so it is broadcast.
    """
    newest = log.agg(F.max("run_id").alias("run_id"))
    return log.join(F.broadcast(newest), "run_id")


def expire_attempts(spark: SparkSession, store: str, keep_runs: int | None = None) -> int:
    """Delete the attempts that no reader of the store can reach; how many there were.

    Those are attempts that were not finished or were written again, and with
    ``keep_runs`` also those of all but the newest runs. Not while a run is being written.
    """
    runs = _attempts(spark, store).orderBy(F.desc("run_id"))
    named = {(r.run_id, r.attempt) for r in (runs.limit(keep_runs) if keep_runs is not None else runs).collect()}
    gone = []
    for folder in folders_below(spark, f"{store}/log", 2):
        run, attempt = (part.rpartition("=")[2] for part in folder.split("/")[-2:])
        if (int(run), attempt) not in named:
            gone.append(folder)
    delete_folders(spark, gone)
    if keep_runs is not None:
        kept = {run for run, _ in named}
        runs_gone = [f for f in folders_below(spark, f"{store}/runs", 1) if int(f.rpartition("=")[2]) not in kept]
        delete_folders(spark, runs_gone)
    return len(gone)
