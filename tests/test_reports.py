"""Reports, with files cut into parts so small that they must be put together."""

import json
from collections import Counter

import pytest
from pyspark.sql import Observation

from flawsieve import findings, scan_log
from flawsieve.functions.severity import plural, status_label
from flawsieve.plans import reports


@pytest.fixture(scope="module")
def log(spark):
    """One file with a gap of clean lines, one ordinary, one clean, one empty."""
    long = "\n".join(["x"] * 12 + ["eval(a) exec(b)", "# eval(", "key = abcdefghij"] * 9 + ["y"] * 9 + ["eval("])
    files = [("/r/long.py", long), ("/r/a.js", "eval(x)\nlocalStorage.setItem"), ("/r/clean.py", "x\n"), ("/r/none.py", "")]
    df = scan_log(spark.createDataFrame(files, "path string, content string"))
    return df.persist()


@pytest.fixture(scope="module")
def expected(log):
    """Findings of each file in order, put together on the driver."""
    files = {row.path: [] for row in log.collect()}
    for row in sorted(log.filter("rule_ord > 0").collect(), key=lambda r: (r.path, r.line, r.rule_ord)):
        files[row.path].append(row)
    return files


def joined(df, value):
    """``{path: text}`` with the parts of a file put together."""
    parts = {}
    for row in sorted(df.collect(), key=lambda r: (r.path, r.part)):
        parts.setdefault(row.path, []).append(row[value])
    return parts


@pytest.mark.parametrize("part_size", [1, 4, 7, 20_000])
def test_numbers_run_through_all_parts(log, expected, part_size):
    rows = reports.ordered_findings(log, part_size).collect()
    assert [(r.path, r.line, r.rule_ord) for r in rows] == sorted((r.path, r.line, r.rule_ord) for r in rows)
    got = [(r.path, r.n, r.line, r.rule_ord) for r in rows]
    assert got == [(p, n, r.line, r.rule_ord) for p in sorted(expected) for n, r in enumerate(expected[p], 1)]


@pytest.mark.parametrize("part_size", [1, 4, 7, 20_000])
def test_text_reports(log, expected, part_size):
    got = {p: "".join(parts) for p, parts in joined(reports.report_text(log, part_size), "text").items()}
    short = {p: "".join(parts) for p, parts in joined(reports.findings_text(log, part_size), "text").items()}
    assert got.keys() == short.keys() == expected.keys()
    for path, found in expected.items():
        if not found:
            assert got[path] == "AI Analysis: No security vulnerabilities detected. Code appears secure."
            assert short[path] == "No security vulnerabilities found."
            continue
        count = Counter(r.severity for r in found)
        lines = ["AI Security Analysis Report", "=" * 28, f"Total Issues Found: {len(found)}", ""]
        lines += [f"{s} Severity: {count[s]} issues" for s in ("High", "Medium", "Low") if count[s]]
        lines += ["", "Detailed Findings:"]
        lines += [f"{n}. Line {r.line} [{r.severity}]: {r.issue}" for n, r in enumerate(found, 1)]
        assert got[path] == "\n".join(lines) + "\n"
        assert short[path] == "\n".join(
            f"{n}. [Line {r.line}] ({r.severity}) {r.issue}" for n, r in enumerate(found, 1)
        )


@pytest.mark.parametrize("part_size", [1, 3, 20_000])
def test_json_report(log, expected, part_size):
    for path, texts in joined(reports.report_json(log, part_size), "json").items():
        items = [{"line": r.line, "issue": r.issue, "severity": r.severity} for r in expected[path]]
        assert "".join(texts) == json.dumps(items, indent=2)
        assert part_size > 3 or path != "/r/long.py" or len(texts) > 3


def test_json_escapes(spark):
    from flawsieve import Rule

    odd = 'a "quoted" \\ text\twith é'
    df = spark.createDataFrame([("a.py", "x")], "path string, content string")
    log = scan_log(df, rules=[Rule("python", 1, "x", "Low", odd, 0.1)])
    assert json.loads(reports.report_json(log).first().json)[0]["issue"] == odd + " (Low confidence)"


@pytest.mark.parametrize("part_size", [1, 5, 20_000])
def test_report_by_file(log, expected, part_size):
    got = {}
    for row in sorted(reports.report_by_file(log, "/r", part_size).collect(), key=lambda r: (r.fileName, r.part)):
        assert len(row.issues) <= part_size
        first = (row.fileName, row.n_issues) not in got
        assert row.header == (f"{row.fileName} ({row.n_issues} issue{'s' if row.n_issues != 1 else ''})" if first else None)
        got.setdefault((row.fileName, row.n_issues), []).extend(tuple(i) for i in row.issues)
    assert got == {
        (p[3:], len(found)): [
            (r.line, r.issue, r.severity) for r in found
        ]
        for p, found in expected.items()
        if found
    }


def test_totals(log, expected):
    status = {r.path: (r.language, r.n_lines, r.n_issues) for r in reports.scan_status(log).collect()}
    assert status == {
        "/r/long.py": ("python", 49, 28),
        "/r/a.js": ("javascript", 2, 2),
        "/r/clean.py": ("python", 2, 0),
        "/r/none.py": ("python", 1, 0),
    }
    by_file = {r.path: tuple(r)[1:] for r in reports.severity_by_file(log).collect()}
    assert by_file["/r/a.js"] == (2, 1, 0, 1) and by_file["/r/clean.py"] == (0, 0, 0, 0)
    assert reports.severity_by_file(findings(log)).count() == 2
    assert tuple(reports.severity_summary(log).first()) == (2, 30, 29, 0, 1)
    assert tuple(reports.status_label(log).first()) == (30, "Security: 30 issues")
    assert reports.report_title(log).first()[0] == "Analysis completed for 2 files"


def test_progress_is_counted_on_the_way(log):
    seen = Observation("progress")
    assert reports.with_progress(log, seen).count() == 34
    assert seen.get == {"n_files": 4, "n_issues": 30}


def test_nothing_found(log):
    none = log.filter("path = '/r/clean.py'")
    assert tuple(reports.severity_summary(none).first()) == (0, 0, 0, 0, 0)
    assert tuple(reports.severity_summary(none.filter("false")).first()) == (0, 0, 0, 0, 0)
    assert tuple(reports.status_label(none).first()) == (0, "Security: Clean")
    assert reports.report_title(none).first()[0] == "Analysis completed for 0 files"
    assert reports.report_by_file(none).isEmpty()


def test_plurals(spark):
    row = spark.range(1).selectExpr(plural("1L", "issue"), plural("2L", "issue"), status_label("1L")).first()
    assert tuple(row) == ("1 issue", "2 issues", "Security: 1 issue")


def test_min_severity_is_monotone(spark):
    rows = [("p", 1, 1, s) for s in ("High", "Medium", "Low", "Odd")] + [("p", 0, 0, None)]
    df = spark.createDataFrame(rows, "path string, line int, rule_ord int, severity string")

    def kept(*minimum):
        return [r.severity for r in reports.min_severity(df, *minimum).collect()]

    assert kept("High") == ["High", None]
    assert kept() == kept("Medium") == kept("Odd") == ["High", "Medium", None]
    assert kept("Low") == ["High", "Medium", "Low", None]


def test_diagnostics(spark):
    rows = [("p", n, 1, s, "text") for n, s in enumerate(("High", "Medium", "Low", "Odd"))]
    df = spark.createDataFrame(rows, "path string, line int, rule_ord int, severity string, issue string")
    got = [tuple(r) for r in reports.diagnostics(df).orderBy("level", "code").collect()]
    assert got == [
        ("p", 0, "Error", "text", "high", "flawsieve"),
        ("p", 1, "Information", "text", "low", "flawsieve"),
        ("p", 0, "Warning", "text", "medium", "flawsieve"),
        ("p", 2, "Warning", "text", "odd", "flawsieve"),
    ]
