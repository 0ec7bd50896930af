"""A workspace's scan from its files to its reports, in the order a user sees them."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from flawsieve.functions.paths import in_scope
from flawsieve.operators.numbering import IS_FINDING, PART_SIZE
from flawsieve.plans import reports
from flawsieve.plans.scan import scan_log
from flawsieve.rules import Rule
from flawsieve.sources.files import DEFAULT_EXCLUDES
from flawsieve.sources.folders import once


class WorkspaceReport(NamedTuple):
    """What ``workspace_report`` gives."""

    summary: DataFrame
    by_file: DataFrame
    documents: DataFrame
    status: DataFrame
    label: DataFrame
    title: DataFrame


def workspace_log(
    files: DataFrame,
    exclude: Iterable[str] = DEFAULT_EXCLUDES,
    rules: DataFrame | Iterable[Rule] | None = None,
) -> DataFrame:
    """The scan log of the files in scope of a table of ``path, content``."""
    return scan_log(files.filter(in_scope("path", exclude)), rules=rules)


def workspace_report(
    log: DataFrame, minimum: str = reports.DEFAULT_MIN_SEVERITY, root: str = "/", part_size: int = PART_SIZE
) -> WorkspaceReport:
    """All roll-ups of a workspace's log, of findings of at least ``minimum``.

    Each of them reads the log, so it is staged here unless it is stored already.
    """
    found = reports.min_severity(once(log), minimum)
    return WorkspaceReport(
        reports.severity_summary(found),
        reports.report_by_file(found, root, part_size),
        reports.report_json(found, part_size),
        reports.scan_status(found),
        reports.status_label(found),
        reports.report_title(found),
    )


def scope_counts(listing: DataFrame, log: DataFrame, exclude: Iterable[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """One row ``n_scanned, n_unreadable, n_skipped`` for the distinct paths of a listing.

    A file counts as scanned if it left a marker in the log, as unreadable if it
    is in scope and left none, and as skipped if it is out of scope or its path
    is null.
    """
    scanned = log.filter(f"NOT {IS_FINDING}").select("path", F.lit(True).alias("_scanned")).distinct()
    known = listing.select("path").distinct().join(scanned, "path", "left")
    return known.selectExpr(
        "_scanned IS NOT NULL AS _done", f"coalesce({in_scope('path', exclude)}, false) AS _wanted"
    ).agg(
        F.expr("count_if(_done) AS n_scanned"),
        F.expr("count_if(_wanted AND NOT _done) AS n_unreadable"),
        F.expr("count_if(NOT _wanted AND NOT _done) AS n_skipped"),
    )
