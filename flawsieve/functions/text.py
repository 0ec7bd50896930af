"""SQL text for tests on strings, all of them on bytes as stored.

The functions of this package take the SQL text of an expression, most often
the name of a column, and give SQL text.  A scan's condition has well over a
hundred parts; as text it reaches Spark in one call instead of one per part.
"""

from __future__ import annotations

from collections.abc import Iterable

# Fixed value: the Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ASCII_WHITE_SPACE = "\t\n\v\f\r "


def quoted(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _trim(side: str, text: str) -> str:
    spaces = f"if(is_valid_utf8({text}), {quoted(WHITE_SPACE)}, {quoted(ASCII_WHITE_SPACE)})"
    return f"trim({side} {spaces} FROM {text})"


def trim_space(text: str) -> str:
    """Strip Unicode white space from both ends.

    ``trim`` compares bytes, so in text that is not UTF-8 a stray byte could
    pass for part of a longer space character; there only ASCII is stripped.
    """
    return _trim("BOTH", text)


def trim_start(text: str) -> str:
    """``trim_space`` at the start only, which need not walk the whole text."""
    return _trim("LEADING", text)


def any_of(tests: Iterable[str]) -> str:
    """True where one of the tests is; false if there are none."""
    return "(" + (" OR ".join(tests) or "false") + ")"


def contains_any(text: str, needles: Iterable[str]) -> str:
    """True where ``text`` holds at least one of the literal ``needles``."""
    return any_of(f"contains({text}, {quoted(needle)})" for needle in needles)
