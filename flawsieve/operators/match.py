"""Lines to findings: one broadcast join with the rule table."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flawsieve.functions.predicates import (
    is_comment,
    is_path_traversal,
    is_secret,
    is_secret_format,
    is_sql_injection,
    is_xss,
    may_assign_secret,
)
from flawsieve.functions.severity import confidence_band, issue_text
from flawsieve.functions.text import WHITE_SPACE, any_of, contains_any, quoted, trim_space, trim_start
from flawsieve.operators.grams import POSTED_ALWAYS, gram_postings, line_grams
from flawsieve.operators.lines import line_text
from flawsieve.rules import (
    HEURISTIC_PATH,
    HEURISTIC_SECRET,
    HEURISTIC_SQL,
    HEURISTIC_XSS,
    RULE_SETS,
    Rule,
)

HEURISTICS = {
    "h_sql": (HEURISTIC_SQL, is_sql_injection),
    "h_xss": (HEURISTIC_XSS, is_xss),
    "h_path": (HEURISTIC_PATH, is_path_traversal),
    "h_secret": (HEURISTIC_SECRET, is_secret),
}

# Up to this many patterns the filter before the join tests each by itself. The
# generated test would outgrow what the JVM compiles (8000 bytes) beyond it, and
# lines would meet ever more patterns, so an index of the patterns takes over.
PREFILTER_PATTERNS = 48

# rule_ord of the row that stands for a scanned file rather than a finding.
FILE_MARKER = 0

_DETECTOR_SCHEMA = pa.schema(
    [
        ("rule_set", pa.string()),
        ("rule_ord", pa.int32()),
        ("flag", pa.string()),
        ("pattern", pa.string()),
        ("earlier", pa.list_(pa.string())),
        ("severity", pa.string()),
        ("description", pa.string()),
        ("score", pa.float64()),
    ]
)


def _earlier_twins(rules: Sequence[Rule]) -> dict[Rule, list[str]]:
    """For each rule, the patterns of earlier rules that report the same text.

    The text is the description and the confidence band, so both must agree.
    """
    twins: dict[tuple, list[str]] = defaultdict(list)
    earlier = {}
    for rule in rules:
        patterns = twins[rule.rule_set, rule.description, rule.score > 0.8, rule.score > 0.6]
        earlier[rule] = list(patterns)
        patterns.append(rule.pattern)
    return earlier


def detectors(
    spark: SparkSession, rules: Sequence[Rule], markers: bool = False, heuristics: Sequence[str] = tuple(HEURISTICS)
) -> DataFrame:
    """The build side of the join: rules, heuristics and file markers alike.

    Every rule set holds its rules (``flag`` null), the four heuristics and, on
    request, a marker row, so that all of them come out of one join over one
    reading of the source.  At most ``MAX_RULES`` rows and five per rule set.
    """
    earlier = _earlier_twins(rules)
    rows = [
        (r.rule_set, r.rule_ord, None, r.pattern, earlier[r] or None, r.severity, r.description, float(r.score))
        for r in rules
    ]
    for name in RULE_SETS:
        for flag in heuristics:
            rule_ord, issue, severity = HEURISTICS[flag][0]
            rows.append((name, rule_ord, flag, None, None, severity, issue, None))
        if markers:
            rows.append((name, FILE_MARKER, "marker", None, None, None, None, None))
    columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), _DETECTOR_SCHEMA)]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, schema=_DETECTOR_SCHEMA))
    return table.selectExpr(
        "rule_set",
        "rule_ord",
        "flag",
        "pattern",
        "earlier",
        "severity",
        f"if(score IS NULL, description, {issue_text('description', 'score')}) AS issue",
        f"if(score IS NULL, NULL, {confidence_band('score')}) AS confidence",
    )


def _literals(raw: str, rules: Sequence[Rule]) -> str:
    """True where a pattern of the line's own rule set is in the line."""
    cases = " ".join(
        f"WHEN {quoted(name)} THEN {contains_any(raw, (r.pattern for r in rules if r.rule_set == name))}"
        for name in RULE_SETS
    )
    return f"CASE rule_set {cases} ELSE false END"


def _may_match(raw: str, rules: Sequence[Rule], heuristics: Sequence[str]) -> str:
    """True where a rule of the line's own rule set, or one of the heuristics, could fire.

    Literals are looked for in the untrimmed line: a pattern may rest on space
    that trimming removes, so a match here is necessary, not sufficient.  Most
    patterns are calls, so one search for a parenthesis often spares the rest.
    """
    tests = {
        "h_sql": [is_sql_injection(raw)],
        "h_path": [is_path_traversal(raw)],
        "h_xss": [is_xss(raw)],
        "h_secret": [is_secret_format(raw), may_assign_secret(raw)],
    }
    on_calls = [t for flag in ("h_sql", "h_path") if flag in heuristics for t in tests[flag]]
    on_others = [t for flag in ("h_xss", "h_secret") if flag in heuristics for t in tests[flag]]
    calls = [r for r in rules if "(" in r.pattern]
    others = [r for r in rules if "(" not in r.pattern]
    if calls:
        on_calls = [_literals(raw, calls), *on_calls]
    if others:
        on_others = [_literals(raw, others), *on_others]
    return any_of([f"contains({raw}, '(') AND {any_of(on_calls)}"] * bool(on_calls) + on_others)


def match_rules(
    lines: DataFrame,
    rules: Sequence[Rule],
    keep: Sequence[str] = ("path",),
    markers: bool = False,
    flag_comments: bool = False,
    spread_by: Sequence[str] = (),
    heuristics: Sequence[str] = tuple(HEURISTICS),
) -> DataFrame:
    """Join the lines of ``split_lines`` with the detectors that fire on them.

    Most lines of most code match nothing.  A filter of plain substring tests
    drops them first; the few that pass are trimmed, get the heuristics' exact
    answers as columns, and meet the rule table.  Of a table of more than
    ``PREFILTER_PATTERNS`` rules a line meets only those whose posted gram it
    holds (see ``operators.grams``).

    Rules, unlike heuristics, pass over comment lines.  With ``flag_comments``
    what they would have found is kept and marked ``in_comment``, for a caller
    who cannot yet tell whether the line really starts where it seems to.

    ``heuristics`` names those of ``HEURISTICS`` to look for; the filter and the
    build side hold nothing of the others.

    ``spread_by`` shuffles the lines that pass the filter by these columns, for
    a caller who joins the findings on them next.
    """
    indexed = len(rules) > PREFILTER_PATTERNS
    tests = [_may_match("raw", () if indexed else rules, heuristics), *(["line = 1"] if markers else [])]
    if indexed:
        # What the heuristics or a marker may want of a line is one posting more.
        grams = line_grams("raw", "latin1", "rule_set", rules, any_of([*tests, "latin1"]))
        # Exploded as it is made: of a column Spark would filter by its size, and make it twice.
        candidates = lines.selectExpr("*", f"explode({grams}) AS _line_gram")
    else:
        candidates = lines.filter(any_of([*tests, "latin1"]))
    # The end of a line matters only to a pattern that ends in space itself.
    trim = trim_space if any(r.pattern[-1:] in WHITE_SPACE for r in rules) else trim_start
    if spread_by:
        candidates = candidates.repartition(*spread_by)
    asked = f"_line_gram = {quoted(POSTED_ALWAYS)} AND " if indexed else ""
    candidates = (
        candidates.selectExpr("*", f"{line_text('raw', 'latin1')} AS _untrimmed")
        .selectExpr("*", f"{trim('_untrimmed')} AS _text")
        # A line of an index comes once for each gram; only its row for what no gram tells is asked by heuristics.
        .selectExpr("*", *(f"{asked}({HEURISTICS[flag][1]('_text')}) AS {flag}" for flag in heuristics))
    )

    fires = "contains(_text, pattern)"
    if not flag_comments:
        fires += f" AND NOT {is_comment('_text')}"
    if any(_earlier_twins(rules).values()):
        # Of rules that report the same text on a line, the first one counts.
        fires += " AND NOT exists(coalesce(earlier, array()), p -> contains(_text, p))"
    flags = " ".join(f"WHEN {quoted(flag)} THEN {flag}" for flag in heuristics)
    hit = f"CASE WHEN flag IS NULL THEN {fires} ELSE CASE flag {flags} WHEN 'marker' THEN line = 1 END END"

    rule_side = detectors(lines.sparkSession, rules, markers, heuristics).withColumnRenamed("rule_set", "_rule_set")
    meets = "rule_set = _rule_set"
    if indexed:
        postings = gram_postings(lines.sparkSession, rules)
        rule_side = rule_side.join(F.broadcast(postings), ["_rule_set", "rule_ord"], "left").selectExpr(
            "* EXCEPT (_gram)", f"coalesce(_gram, {quoted(POSTED_ALWAYS)}) AS _gram"
        )
        meets += " AND _line_gram = _gram"
    joined = candidates.join(F.broadcast(rule_side), F.expr(f"{meets} AND {hit}"))
    columns = [
        *keep,
        "language",
        f"if(rule_ord = {FILE_MARKER}, 0, line) AS line",
        "rule_ord",
        "issue",
        "severity",
        "confidence",
    ]
    if markers:
        columns.append(f"if(rule_ord = {FILE_MARKER}, n_lines, NULL) AS n_lines")
    if flag_comments:
        columns.append(f"flag IS NULL AND {is_comment('_text')} AS in_comment")
    return joined.selectExpr(*columns)
