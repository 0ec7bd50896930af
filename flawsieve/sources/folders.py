"""Folders that all executors share: tables written once and read again, and what a store needs of a file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local session gets a new one; on a cluster this raises,
    as executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share, or set spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def folders_below(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The folders ``depth`` levels below ``path``; of a store, whose folders are few."""
    level = [path]
    for _ in range(depth):
        found = []
        for folder in level:
            system, at = _file_system(spark, folder)
            if system.exists(at):
                found += [f"{folder}/{s.getPath().getName()}" for s in system.listStatus(at) if s.isDirectory()]
        level = [f for f in found if not f.rpartition("/")[2].startswith("_temporary")]
    return level


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        system, at = _file_system(spark, folder)
        system.delete(at, True)


def is_stored(df: DataFrame) -> bool:
    """True where ``df`` is read from files or a local table and at most filtered and projected since."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.splitlines()}
    return nodes <= {"Project", "Filter", "Relation", "LocalRelation", "Union", ""}


def once(log: DataFrame) -> DataFrame:
    """``log`` for a report that reads it more than once: staged, unless it is stored as it is."""
    return log if is_stored(log) else stage(log)


def compact_files(df: DataFrame) -> DataFrame:
    """Findings are few beside the text they were found in: gather them from the
    many tasks of a scan into files of the advised size, splitting large paths."""
    return df.hint("rebalance", "path")


def stage(log: DataFrame, folder: str | None = None) -> DataFrame:
    """``log``, computed now, written to ``folder`` and read from there.

    For reports that read their input twice: a log is small beside the text it
    comes from, so keeping it is cheaper than scanning again, and it outlives
    lost executors.  Without ``folder`` a new one in the shared folder is taken.
    """
    spark = log.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    compact_files(log).write.mode("overwrite").parquet(folder)
    return spark.read.schema(log.schema).parquet(folder)
