"""Running numbers and totals per file, without a file ever being one task.

A file's findings are cut into chunks of ``part_size`` lines, and chunks into
parts of at most ``part_size`` findings.  Sorting happens per chunk and
collecting per part, so what is collected is bounded whatever the file and the
rule table; what a part must know of the others (how many findings come before
it, the totals of the file) comes from a small table of counts, one row per
chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flawsieve.operators.match import FILE_MARKER
from flawsieve.rules import SEVERITIES

PART_SIZE = 20_000

IS_FINDING = f"rule_ord <> {FILE_MARKER}"
TOTALS = ("n_issues", *(s.lower() for s in SEVERITIES))
PART = ("chunk", "part", "opens", "closes")


def severity_counts() -> list[Column]:
    """Aggregates for ``TOTALS``, all in one pass and combined map-side."""
    return [
        F.expr(f"count_if({IS_FINDING}) AS n_issues"),
        *(F.expr(f"count_if(severity = '{s}') AS {s.lower()}") for s in SEVERITIES),
    ]


def number_findings(log: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Add ``PART``, the running number ``n`` in the file, and ``TOTALS``.

    Findings count in order of line and rule; markers take no number and lie in
    part 0.  ``opens`` and ``closes`` mark a file's first and last part.  ``log``
    is read twice, so rather than a scan pass a stored log (``once``, ``write_run``).
    """
    chunked = log.selectExpr("*", f"greatest(line - 1, 0) div {part_size} AS chunk")
    before = "OVER (PARTITION BY path ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    file = "OVER (PARTITION BY path)"
    totals = (
        chunked.groupBy("path", "chunk")
        .agg(*severity_counts())
        .selectExpr("*", f"(n_issues + {part_size - 1}) div {part_size} AS _n_parts")
        .selectExpr(
            "path",
            "chunk",
            f"coalesce(sum(n_issues) {before}, 0) AS _before",
            f"coalesce(sum(_n_parts) {before}, 0) AS _parts_before",
            f"sum(_n_parts) {file} AS _parts",
            *(f"sum({name}) {file} AS {name}" for name in TOTALS),
        )
    )
    place = f"""count_if({IS_FINDING}) OVER (PARTITION BY path, chunk ORDER BY line, rule_ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    return (
        chunked.join(totals, ["path", "chunk"])
        .selectExpr("*", f"{place} AS _place")
        .selectExpr(
            "* EXCEPT (_before, _parts_before, _place)",
            f"if({IS_FINDING}, _before + _place, NULL) AS n",
            f"if({IS_FINDING}, _parts_before + (_place - 1) div {part_size}, 0) AS part",
        )
        .selectExpr("* EXCEPT (_parts)", "part = 0 AS opens", "part >= _parts - 1 AS closes")
    )
