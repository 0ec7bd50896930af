"""Files to numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flawsieve.functions.paths import language, rule_set
from flawsieve.functions.text import trim_space


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``language`` and ``rule_set``, both read off the path."""
    return files.selectExpr("*", f"{language(path)} AS language").selectExpr(
        "*", f"{rule_set('language')} AS rule_set"
    )


def line_count(text: str) -> str:
    """Line feeds plus one: text ending in a line feed ends in an empty line."""
    return f"octet_length({text}) - octet_length(replace({text}, '\\n', '')) + 1L"


def split_lines(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line of each ``(path, content)`` row, and the columns ``keep``.

    Gives ``path, language, rule_set, n_lines, line, raw, latin1``.  ``split``
    decodes its input, so content that is not UTF-8 is split as Latin-1, one
    character per byte, and marked ``latin1``; ``line_text`` gives back the
    bytes.  ``posexplode`` takes ``split`` itself rather than a column holding
    its result, or Spark would add a filter on the array's size and split twice.
    """
    splittable = "if(latin1, decode(CAST(content AS BINARY), 'ISO-8859-1'), content)"
    return (
        with_language(files)
        .selectExpr(
            "path",
            "language",
            "rule_set",
            *keep,
            "content",
            f"{line_count('content')} AS n_lines",
            "NOT is_valid_utf8(content) AS latin1",
        )
        .selectExpr(
            "path",
            "language",
            "rule_set",
            *keep,
            "n_lines",
            "latin1",
            f"posexplode(split({splittable}, '\\n', -1)) AS (_pos, raw)",
        )
        .selectExpr("* EXCEPT (_pos)", "_pos + 1 AS line")
    )


def line_text(raw: str, latin1: str) -> str:
    """The line as the bytes it has in the file."""
    return f"if({latin1}, CAST(encode({raw}, 'ISO-8859-1') AS STRING), {raw})"


def explode_lines(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``path, language, rule_set, line, text`` with ``text`` trimmed."""
    return (
        split_lines(files, keep)
        .selectExpr("*", f"{line_text('raw', 'latin1')} AS text")
        .selectExpr("path", "language", "rule_set", *keep, "line", f"{trim_space('text')} AS text")
    )
