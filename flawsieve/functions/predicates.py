"""SQL text for the heuristics, each a test on one line."""

from __future__ import annotations

from flawsieve.functions.text import any_of, contains_any, quoted, trim_space
from flawsieve.rules import (
    SECRET_FORMATS,
    SECRET_KEYWORDS,
    SECRET_OPERATORS,
    SECRET_VALUE_EXCLUSIONS,
    SECRET_VALUE_MIN_BYTES,
)

# The other characters whose lower case is an ASCII letter: Kelvin sign, dotted I.
_OTHER_CASES = {"k": "\u212a", "i": "\u0130"}


def _any_case(letter: str) -> str:
    return "[" + letter + letter.upper() + _OTHER_CASES.get(letter, "") + "]"


SECRET_KEYWORD_REGEX = (
    "(?=[" + "".join(sorted({_any_case(word[0])[1:-1] for word in SECRET_KEYWORDS})) + "])"
    "(?:" + "|".join("".join(map(_any_case, word)) for word in SECRET_KEYWORDS) + ")"
)


def is_comment(trimmed: str) -> str:
    """Only ``#`` opens a comment, whatever the language."""
    return f"startswith({trimmed}, '#')"


def is_sql_injection(line: str) -> str:
    run = contains_any(line, ("execute(", "query("))
    return f"({run} AND {contains_any(line, ('+', '%', 'format('))})"


def is_xss(line: str) -> str:
    return (
        f"(contains({line}, 'request.') AND {contains_any(line, ('render_template', 'HttpResponse'))}"
        f" AND NOT contains({line}, 'escape('))"
    )


def is_path_traversal(line: str) -> str:
    return (
        f"(contains({line}, 'request.') AND contains({line}, 'open(')"
        f" AND NOT {contains_any(line, ('safe_join', 'secure_filename'))})"
    )


def may_assign_secret(line: str) -> str:
    """The cheap part of ``is_secret_assignment``: an operator and a keyword.

    One search with a quick first-letter test, where lower-casing the line
    would be repeated for every keyword.
    """
    return f"({contains_any(line, SECRET_OPERATORS)} AND {line} RLIKE {quoted(SECRET_KEYWORD_REGEX)})"


def _assigns_value(line: str, operator: str) -> str:
    """True where the text between the first two operators looks hardcoded."""
    value = trim_space(f"split_part({line}, {quoted(operator)}, 2)")
    return (
        f"(octet_length({value}) > {SECRET_VALUE_MIN_BYTES}"
        f" AND NOT {contains_any(value, SECRET_VALUE_EXCLUSIONS)})"
    )


def is_secret_assignment(line: str) -> str:
    """A keyword anywhere in the line and a hardcoded value after an operator."""
    values = any_of(_assigns_value(line, operator) for operator in SECRET_OPERATORS)
    return f"({may_assign_secret(line)} AND {values})"


def is_secret_format(line: str) -> str:
    return contains_any(line, SECRET_FORMATS)


def is_secret(line: str) -> str:
    return f"({is_secret_format(line)} OR {is_secret_assignment(line)})"
