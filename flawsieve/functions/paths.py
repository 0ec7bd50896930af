"""SQL text for tests on file paths: extension, language, rule set, exclusion."""

from __future__ import annotations

import re
from collections.abc import Iterable

from flawsieve.functions.text import quoted
from flawsieve.rules import (
    EXTENSION_LANGUAGE,
    FALLBACK_RULE_SET,
    LANGUAGE_RULE_SET,
    UNKNOWN_LANGUAGE,
)


def _choice(key: str, mapping: dict[str, str], default: str) -> str:
    """``mapping[key]``: the map is a constant, so ``key`` appears only once."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in mapping.items())
    return f"coalesce(element_at(map({pairs}), {key}), {quoted(default)})"


def extension(path: str) -> str:
    """Lower-cased text from the last dot of the last path segment, or ''."""
    dotted = quoted(r"(\.[^./]*)\z")
    return f"lower(regexp_extract({path}, {dotted}, 1))"


def language(path: str) -> str:
    return _choice(extension(path), EXTENSION_LANGUAGE, UNKNOWN_LANGUAGE)


def rule_set(lang: str) -> str:
    """The rule set for a language; languages without one use the fallback."""
    return _choice(lang, LANGUAGE_RULE_SET, FALLBACK_RULE_SET)


def is_supported(path: str) -> str:
    return f"{extension(path)} IN ({', '.join(map(quoted, EXTENSION_LANGUAGE))})"


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression for a whole path.

    ``**`` spans any number of segments, ``*`` and ``?`` stay within one,
    ``[...]`` is a character class, ``{a,b}`` a choice.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append("[^" + body[1:] + "]" if body[0] in "!^" else "[" + body + "]")
            i = close
        elif ch == "{" and "}" in glob[i:]:
            out.append("(?:")
            depth += 1
        elif ch == "}" and depth:
            out.append(")")
            depth -= 1
        elif ch == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out) + r"\z"


def in_scope(path: str, exclude: Iterable[str] = (), root: str = "") -> str:
    """A supported extension, outside node_modules and the excluded globs.

    Globs and node_modules concern the path below ``root``, where it lies below.
    One expression for all, because ``path`` may be a costly one itself.
    """
    below = f"(?:{re.escape(root.rstrip('/') + '/')})?+" if root else ""
    excluded = "|".join(["(?:.*/)?node_modules/", *map(glob_regex, exclude)])
    supported = "|".join(re.escape(e) for e in EXTENSION_LANGUAGE)
    regex = rf"(?s)\A{below}/*+(?!{excluded}).*(?i:{supported})\z"
    return f"{path} RLIKE {quoted(regex)}"


def relative_to(path: str, root: str) -> str:
    """``path`` without the ``root`` prefix; paths outside it stay whole."""
    prefix = root.rstrip("/") + "/"
    return f"if(startswith({path}, {quoted(prefix)}), substr({path}, {len(prefix) + 1}), {path})"


def plain_path(uri: str) -> str:
    """A file URI as a path: percent escapes resolved, scheme and host dropped."""
    scheme = quoted(r"\A[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?")
    return f"regexp_replace(url_decode(replace({uri}, '+', '%2B')), {scheme}, '')"
