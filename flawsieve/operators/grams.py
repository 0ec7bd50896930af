"""An inverted index of rule patterns, for tables too large to try each on every line.

Every pattern posts one of its grams, sequences of as many characters as the longest
of ``GRAMS`` that it has: the one that the fewest patterns of its rule set post or
hold, so that a line meets few of them in vain. A line gives the grams of the
index that it holds, in one search for each length; the two meet in an equi-join, and
the pattern is then looked for itself. Lines may be long, so grams are, too: three letters
of prose would have every line meet most patterns.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flawsieve.functions.text import quoted
from flawsieve.rules import RULE_SETS, Rule

GRAMS = (6, 3, 2, 1)
# The posting of what no gram tells: heuristics and markers.
POSTED_ALWAYS = ""
# Put before the grams of lines that are not UTF-8, whose bytes were taken for characters.
LATIN1_MARK = "\x01"

_SCHEMA = pa.schema([("_rule_set", pa.string()), ("rule_ord", pa.int32()), ("_gram", pa.string())])


def _grams(pattern: str) -> list[str]:
    length = next((n for n in GRAMS if n <= len(pattern)), 0)  # an empty pattern posts nothing but itself
    return [pattern[i : i + length] for i in range(len(pattern) - length + 1)] if length else [pattern]


def posted_grams(rules: Sequence[Rule]) -> dict[Rule, tuple[str, str]]:
    """What each rule posts: a gram of its pattern, and the same as it looks in lines that are not UTF-8."""
    held = {name: Counter(g for r in rules if r.rule_set == name for g in set(_grams(r.pattern))) for name in RULE_SETS}
    posted: dict[str, Counter] = defaultdict(Counter)
    found = {}
    for rule in rules:
        taken, holds = posted[rule.rule_set], held[rule.rule_set]
        gram = min(_grams(rule.pattern), key=lambda g: (taken[g], holds[g], g))
        taken[gram] += 1
        found[rule] = gram, gram.encode().decode("latin-1")
    return found


def gram_postings(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """``(_rule_set, rule_ord, _gram)``: two rows a rule."""
    posted = posted_grams(rules).items()
    rows = [(r.rule_set, r.rule_ord, gram) for r, (plain, latin1) in posted for gram in (plain, LATIN1_MARK + latin1)]
    columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), _SCHEMA)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=_SCHEMA))


def _one(ch: str) -> str:
    return f"\\x{{{ord(ch):x}}}"


def _begin_like(texts: Iterable[str]) -> str:
    """A regular expression for any text that has at each place a character that one of ``texts`` has there.

    One table look-up a character, so it turns down most places of a line at once.
    """
    return "".join(f"[{''.join(map(_one, sorted(set(place))))}]" for place in zip(*texts))


def _any_of(texts: Iterable[str]) -> str:
    """A regular expression for any of the texts, the longest that fits, as a tree of common prefixes."""
    tree: dict = {}
    for text in texts:
        node = tree
        for ch in text:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        ends = "" in node
        # Characters after which texts end share a class; a class is one test, however many it has.
        last = "".join(_one(ch) for ch, below in node.items() if ch and below.keys() == {""})
        choices = [f"{_one(ch)}{written(below)}" for ch, below in node.items() if ch and below.keys() != {""}]
        choices += [f"[{last}]"] if last else []
        if not choices:
            return ""
        return f"(?:{'|'.join(choices)})" + ("?" if ends else "")

    return written(tree)


def line_grams(raw: str, latin1: str, rule_set: str, rules: Sequence[Rule], always: str) -> str:
    """The distinct grams of its rule set's index that a line holds, and ``POSTED_ALWAYS`` where ``always`` holds.

    Every place of the line is looked at, as grams overlap. Of grams of several
    lengths at one place there is one search for each length.
    """
    posted = posted_grams(rules)
    cases = []
    for name in RULE_SETS:
        by_kind: dict[tuple[bool, int], set[str]] = defaultdict(set)
        for rule, grams in posted.items():
            if rule.rule_set == name:
                by_kind[False, len(grams[0])].add(grams[0])
                by_kind[True, len(grams[1])].add(grams[1])
        for is_latin1 in (False, True):
            searches = []
            for (kind, _), texts in sorted(by_kind.items()):
                if kind == is_latin1:
                    regex = f"(?s)(?={_begin_like(texts)})(?=({_any_of(sorted(texts))}))"
                    searches.append(f"regexp_extract_all({raw}, {quoted(regex)}, 1)")
            if searches:
                found = searches[0] if len(searches) == 1 else f"concat({', '.join(searches)})"
                if is_latin1:
                    found = f"transform({found}, g -> concat({quoted(LATIN1_MARK)}, g))"
                cases.append(f"WHEN {rule_set} = {quoted(name)} AND {'' if is_latin1 else 'NOT '}{latin1} THEN {found}")
    grams = f"CASE {' '.join(cases)} ELSE array() END" if cases else "CAST(array() AS array<string>)"
    return f"array_distinct(concat({grams}, if({always}, array({quoted(POSTED_ALWAYS)}), array())))"
