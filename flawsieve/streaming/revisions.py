"""Scanning a stream of file revisions.

A revision is ``path, content, event_time, revision``: a file as it was saved
or opened.  A directory watch would not do as a source, since the file source
goes by name and never reads a rewritten file again; take revisions from a log
of them (a message queue, or a table folder that gains files).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from flawsieve.functions.paths import is_supported
from flawsieve.operators.match import FILE_MARKER
from flawsieve.plans.scan import scan_log
from flawsieve.rules import Rule

VERSION = ("event_time", "revision")


def scan_revisions(
    revisions: DataFrame, rules: DataFrame | Iterable[Rule] | None = None
) -> DataFrame:
    """The scan log of each revision of a supported file, batch or stream alike."""
    return scan_log(revisions.filter(is_supported("path")), rules=rules, keep=VERSION)


def write_revision_log(
    revisions: DataFrame,
    store: str,
    checkpoint: str,
    rules: DataFrame | Iterable[Rule] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scan a stream of revisions into the folder ``store``.

    The scan keeps no state, so no watermark is needed and late revisions
    count.  Markers and findings of a micro-batch are one commit of the file
    sink: a reader sees both or neither, and a restart writes neither twice.
    """
    return (
        scan_revisions(revisions, rules)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def compact(log: DataFrame) -> DataFrame:
    """The markers and findings of each path's latest revision.

    A revision delivered twice counts once.  Rows are matched on path and
    version together, so a file saved very often does not gather its history in
    one task.  Written to a new folder now and then, this keeps a store from
    growing with its history; ``current_findings`` of it and of the store agree.
    """
    latest = (
        log.filter(F.col("rule_ord") == FILE_MARKER)
        .groupBy("path")
        .agg(F.max(F.struct(*VERSION)).alias("_latest"))
        .select("path", "_latest.*")
    )
    same = [log[c].eqNullSafe(latest[c]) for c in ("path", *VERSION)]  # a version may be null
    return log.join(latest, same, "left_semi").distinct()


def current_findings(log: DataFrame) -> DataFrame:
    """The findings of each path's latest revision.

    The marker of a revision without findings is what makes the findings of
    earlier ones vanish.
    """
    return compact(log).filter(F.col("rule_ord") != FILE_MARKER).drop("n_lines")
