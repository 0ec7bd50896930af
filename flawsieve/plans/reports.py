"""Reports over a scan log or a findings table.

Every function takes the output of ``scan_log`` or ``scan_table``.  Given a log,
reports that speak of clean files include them; findings alone cannot.  Paths
are expected to be unique per scan; of logs in which they are not, take
``first_findings``.

Reports that number findings read their input more than once, so they stage it,
which runs the scan; a log that is stored already is taken as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from flawsieve.functions.paths import relative_to
from flawsieve.functions.severity import diagnostic_level, plural, severity_rank, status_label as label_of
from flawsieve.functions.text import quoted
from flawsieve.operators.numbering import (
    IS_FINDING,
    PART,
    PART_SIZE,
    TOTALS,
    number_findings,
    severity_counts,
)
from flawsieve.rules import SEVERITIES
from flawsieve.sources.folders import once

DEFAULT_MIN_SEVERITY = "Medium"
DIAGNOSTIC_SOURCE = "flawsieve"

# --- Fixed values: report texts ----------------------------------------------
NOTHING_FOUND = "No security vulnerabilities found."
NOTHING_DETECTED = "AI Analysis: No security vulnerabilities detected. Code appears secure."
REPORT_TITLE = "AI Security Analysis Report\n============================\n"
# --- End of fixed values -------------------------------------------------------


def min_severity(log: DataFrame, minimum: str = DEFAULT_MIN_SEVERITY) -> DataFrame:
    """Findings of at least this severity; an unknown minimum means Medium."""
    least = {"High": 3, "Medium": 2, "Low": 1}.get(minimum, 2)
    return log.filter(f"{severity_rank('severity')} >= {least} OR NOT {IS_FINDING}")


def diagnostics(findings: DataFrame) -> DataFrame:
    """One editor-style diagnostic per finding, lines counted from 0."""
    return findings.filter(IS_FINDING).selectExpr(
        "path",
        "greatest(line - 1, 0) AS line0",
        f"{diagnostic_level('severity')} AS level",
        "issue AS message",
        "lower(severity) AS code",
        f"{quoted(DIAGNOSTIC_SOURCE)} AS source",
    )


def severity_by_file(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(*severity_counts())


def scan_status(log: DataFrame) -> DataFrame:
    """Every scanned file with its number of lines and of findings."""
    return log.groupBy("path", "language").agg(
        F.max("n_lines").alias("n_lines"), F.expr(f"count_if({IS_FINDING}) AS n_issues")
    )


def first_findings(log: DataFrame) -> DataFrame:
    """Each text once for a line of a path, with its first rule, for logs in which a path comes repeatedly.

    A scan reports a text once a line as it is, but of every delivery of a file again.
    """
    first = F.min(F.struct("rule_ord", "language", "severity", "confidence")).alias("_first")
    return (
        log.filter(IS_FINDING)
        .groupBy("path", "line", "issue")
        .agg(first)
        .select("path", "_first.language", "line", "_first.rule_ord", "issue", "_first.severity", "_first.confidence")
    )


def scan_progress(log: DataFrame, listing: DataFrame) -> DataFrame:
    """One row ``n_files, n_total, n_issues, progress``: how far a scan came of the files of a listing.

    The counts are observed while the log is staged, not taken in a second reading.
    """
    counts = Observation()
    once(with_progress(log, counts))
    done, issues = counts.get["n_files"], counts.get["n_issues"]
    return listing.agg(F.count_distinct("path").alias("n_total")).selectExpr(
        f"{done}L AS n_files", "n_total", f"{issues}L AS n_issues", f"concat({done}, ' of ', n_total) AS progress"
    )


def with_progress(log: DataFrame, observation: Observation | str) -> DataFrame:
    """``log`` that reports ``n_files`` and ``n_issues`` while it is being used.

    Given an ``Observation``, the counts are there when the action ends; given a
    name, every progress report of a streaming query carries them.
    """
    return log.observe(
        observation,
        F.expr(f"count_if(NOT {IS_FINDING}) AS n_files"),
        F.expr(f"count_if({IS_FINDING}) AS n_issues"),
    )


def severity_summary(log: DataFrame) -> DataFrame:
    """Totals over all files; ``n_files`` counts those with findings."""
    return severity_by_file(log).agg(
        F.expr("count_if(n_issues > 0) AS n_files"),
        *(F.expr(f"coalesce(sum({name}), 0) AS {name}") for name in TOTALS),
    )


def status_label(log: DataFrame) -> DataFrame:
    return log.agg(F.expr(f"count_if({IS_FINDING}) AS n_issues")).selectExpr(
        "n_issues", f"{label_of('n_issues')} AS label"
    )


def ordered_findings(findings: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Findings by path, line and rule, numbered within their file.

    The order is total over the whole key, so one file's rows can spread over
    several sorted partitions.
    """
    return (
        number_findings(once(findings.filter(IS_FINDING)), part_size)
        .drop(*PART, *TOTALS)
        .orderBy("path", "line", "rule_ord")
    )


def report_by_file(findings: DataFrame, root: str = "/", part_size: int = PART_SIZE) -> DataFrame:
    """``fileName, part, n_issues, header, issues`` for files with findings.

    ``issues`` is the ordered array of ``(line, issue, severity)``.  A file of
    more than ``part_size`` lines or findings has several rows, one for each
    part; ``header`` stands in its first one only.
    """
    return (
        number_findings(once(findings.filter(IS_FINDING)), part_size)
        .groupBy("path", *PART, "n_issues")
        .agg(F.expr("array_sort(collect_list(struct(n, line, issue, severity))) AS _issues"))
        .selectExpr("*", f"{relative_to('path', root)} AS fileName")
        .selectExpr(
            "fileName",
            "part",
            "n_issues",
            f"if(opens, concat(fileName, ' (', {plural('n_issues', 'issue')}, ')'), NULL) AS header",
            "transform(_issues, i -> struct(i.line, i.issue, i.severity)) AS issues",
        )
    )


def report_title(log: DataFrame) -> DataFrame:
    """The report's one-line heading, with the number of files that have findings."""
    return severity_summary(log).selectExpr(
        f"concat('Analysis completed for ', {plural('n_files', 'file')}) AS title"
    )


def _documents(log: DataFrame, item: str, separator: str, part_size: int) -> DataFrame:
    """``path``, ``PART``, ``TOTALS`` and ``body``: a part's items in order.

    ``body`` is null for a clean file, and only then: the marker alone makes no
    part of a file that has findings elsewhere.
    """
    item = f"if({IS_FINDING}, {item}, NULL)"
    return (
        number_findings(once(log), part_size)
        .groupBy("path", *PART, *TOTALS)
        .agg(F.expr(f"listagg({item}, {quoted(separator)}) WITHIN GROUP (ORDER BY n) AS body"))
        .filter("n_issues = 0 OR body IS NOT NULL")
    )


def report_json(log: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """``path, part, json``: the findings of a file as an indented JSON array.

    A clean file gives ``[]``.  The parts of a long file are pieces of its one
    array: put together in order they are its text.
    """
    # The text as JSON makes it, without the object around it.
    issue = "regexp_extract(to_json(struct(issue)), '(?s)^.*?:(.*).$', 1)"
    item = f"""concat('  {{\\n    "line": ', line, ',\\n    "issue": ', {issue},
                      ',\\n    "severity": "', severity, '"\\n  }}')"""
    piece = "concat(if(opens, '[\\n', ''), body, if(closes, '\\n]', ',\\n'))"
    return _documents(log, item, ",\n", part_size).selectExpr(
        "path", "part", f"if(body IS NULL, '[]', {piece}) AS json"
    )


def numbered_lines(log: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """``path, part, opens, closes, text``: numbered findings, one to a line.

    No line feed ends the text of a part.
    """
    item = "concat(n, '. [Line ', line, '] (', severity, ') ', issue)"
    return _documents(log, item, "\n", part_size).selectExpr(
        "path", "part", "opens", "closes", f"coalesce(body, {quoted(NOTHING_FOUND)}) AS text"
    )


def findings_text(log: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """``path, part, text``: numbered findings; put together, parts are the file's text."""
    return numbered_lines(log, part_size).selectExpr(
        "path", "part", "concat(text, if(closes, '', '\\n')) AS text"
    )


def report_text(log: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """``path, part, text``: title, counts by severity, then numbered findings.

    The title and counts open a file's first part.
    """
    item = "concat(n, '. Line ', line, ' [', severity, ']: ', issue, '\\n')"
    counts = ", ".join(
        f"if({s.lower()} > 0, concat('{s} Severity: ', {s.lower()}, ' issues\\n'), '')" for s in SEVERITIES
    )
    heading = f"""concat({quoted(REPORT_TITLE)}, 'Total Issues Found: ', n_issues, '\\n\\n',
                         {counts}, '\\nDetailed Findings:\\n')"""
    return _documents(log, item, "", part_size).selectExpr(
        "path",
        "part",
        f"""CASE WHEN n_issues = 0 THEN {quoted(NOTHING_DETECTED)}
                 WHEN opens THEN concat({heading}, body) ELSE body END AS text""",
    )
