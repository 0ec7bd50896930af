"""SQL text on severities, confidence scores and counts."""

from __future__ import annotations

from flawsieve.functions.text import quoted


def severity_rank(severity: str) -> str:
    return f"CASE {severity} WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


def confidence_band(score: str) -> str:
    """High above 0.8, Medium above 0.6, else Low; a bound belongs below."""
    return f"CASE WHEN {score} > 0.8D THEN 'High' WHEN {score} > 0.6D THEN 'Medium' ELSE 'Low' END"


def issue_text(description: str, score: str) -> str:
    return f"concat({description}, ' (', {confidence_band(score)}, ' confidence)')"


def diagnostic_level(severity: str) -> str:
    return f"CASE {severity} WHEN 'High' THEN 'Error' WHEN 'Low' THEN 'Information' ELSE 'Warning' END"


def plural(n: str, noun: str) -> str:
    """``1 noun`` or ``n nouns``."""
    return f"concat({n}, {quoted(' ' + noun)}, if({n} = 1, '', 's'))"


def status_label(n_issues: str) -> str:
    return f"if({n_issues} = 0, 'Security: Clean', concat('Security: ', {plural(n_issues, 'issue')}))"
