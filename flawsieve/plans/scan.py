"""Whole scans: from a table of files to findings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from flawsieve.operators.lines import split_lines
from flawsieve.operators.match import FILE_MARKER, HEURISTICS, match_rules
from flawsieve.rules import Rule, load_rules


def as_files(df: DataFrame, path_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``path, content`` and ``keep``; rows without a text have nothing to scan."""
    return df.select(
        F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("content"), *keep
    ).filter("path IS NOT NULL AND content IS NOT NULL")


def scan_table(
    df: DataFrame,
    path_col: str = "path",
    text_col: str = "content",
    rules: DataFrame | Iterable[Rule] | None = None,
    keep: Sequence[str] = (),
    heuristics: Sequence[str] = tuple(HEURISTICS),
) -> DataFrame:
    """Findings of a table with one source file per row, whatever its extension.

    Works on batch and streaming tables alike.  Nothing is shuffled: each file
    is split, tested and joined with the broadcast rules where it was read.
    Of the heuristics only those named are looked for.
    """
    lines = split_lines(as_files(df, path_col, text_col, keep), keep)
    return match_rules(lines, load_rules(rules), ("path", *keep), heuristics=heuristics)


def scan_log(
    df: DataFrame,
    path_col: str = "path",
    text_col: str = "content",
    rules: DataFrame | Iterable[Rule] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``scan_table`` plus one marker row per file, clean or not.

    A marker has ``line`` and ``rule_ord`` 0, no issue, and ``n_lines``.  The
    log records in one reading of the source what was scanned and what was
    found, so a store of it answers for clean files too.
    """
    lines = split_lines(as_files(df, path_col, text_col, keep), keep)
    return match_rules(lines, load_rules(rules), ("path", *keep), markers=True)


def findings(log: DataFrame) -> DataFrame:
    """The findings of a log, without its markers."""
    return log.filter(F.col("rule_ord") != FILE_MARKER).drop("n_lines")


def scanned_files(log: DataFrame) -> DataFrame:
    """The markers of a log: one row per scanned file."""
    return log.filter(F.col("rule_ord") == FILE_MARKER).drop(
        "line", "rule_ord", "issue", "severity", "confidence"
    )


def read_against(listing: DataFrame, files: DataFrame) -> DataFrame:
    """``path, content, reason`` of every file of ``listing (path, length)``, as ``files (path, content)`` has it.

    A file is as good as read where it is as long as listed; another has no
    content and a reason. Paths are expected to be unique on either side.
    """
    reason = """CASE WHEN content IS NULL THEN 'vanished'
                     WHEN octet_length(content) < length THEN 'short read'
                     WHEN octet_length(content) > length THEN 'grown' END"""
    return (
        listing.select("path", "length")
        .join(files.select("path", "content"), "path", "left")
        .selectExpr("path", "content", f"{reason} AS reason")
        .selectExpr("path", "if(reason IS NULL, content, NULL) AS content", "reason")
    )


def scan_read(read: DataFrame, rules: DataFrame | Iterable[Rule] | None = None) -> DataFrame:
    """The scan log of ``read (path, content, reason)``, with the files that could not be read in it.

    Such a file has a marker with its reason and without ``n_lines``, so one
    reading of the source tells of both kinds.
    """
    files = read.selectExpr("path", "if(reason IS NULL, CAST(content AS STRING), '') AS content", "reason")
    log = scan_log(files, rules=rules, keep=["reason"])
    return log.withColumn("n_lines", F.expr("if(reason IS NULL, n_lines, NULL)"))


def quarantine(log: DataFrame) -> DataFrame:
    """``path, reason`` of the files of a log of ``scan_read`` that could not be read."""
    return log.filter(f"rule_ord = {FILE_MARKER} AND reason IS NOT NULL").select("path", "reason")
