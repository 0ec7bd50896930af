"""Finds likely security flaws in source code held in Spark tables."""

from flawsieve.plans.scan import findings, scan_log, scan_table, scanned_files
from flawsieve.rules import BUILTIN_RULES, Rule
from flawsieve.sources.files import scan_path
from flawsieve.sources.store import write_findings

__all__ = [
    "BUILTIN_RULES",
    "Rule",
    "findings",
    "scan_log",
    "scan_path",
    "scan_table",
    "scanned_files",
    "write_findings",
]
