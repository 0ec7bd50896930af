"""The rule table, each of its rules, and the heuristics' traps."""

import re

import pytest
from pyspark.sql import functions as F

from flawsieve import BUILTIN_RULES, Rule, scan_log, scan_table
from flawsieve.rules import MAX_RULES, load_rules

EXTENSION = {"python": "py", "javascript": "js", "java": "java", "c": "c"}
SQL, XSS, PATH, SECRET = 1001, 1002, 1003, 1004


def test_builtin_table():
    sets = [r.rule_set for r in BUILTIN_RULES]
    assert {s: sets.count(s) for s in sets} == {"python": 10, "javascript": 10, "java": 8, "c": 11}
    assert load_rules() == BUILTIN_RULES
    assert sorted(load_rules(BUILTIN_RULES)) == sorted(BUILTIN_RULES)


def test_every_rule_fires_with_its_text(spark):
    files = [(f"{i}.{EXTENSION[r.rule_set]}", f"\n   {r.pattern}\n") for i, r in enumerate(BUILTIN_RULES)]
    df = spark.createDataFrame(files, "path string, content string")
    found = {
        (row.path, row.rule_ord): (row.line, row.issue, row.severity, row.confidence)
        for row in scan_table(df).collect()
    }
    for i, r in enumerate(BUILTIN_RULES):
        band = "High" if r.score > 0.8 else "Medium" if r.score > 0.6 else "Low"
        expected = (2, f"{r.description} ({band} confidence)", r.severity, band)
        assert found[f"{i}.{EXTENSION[r.rule_set]}", r.rule_ord] == expected


# --- Fixed values: lines of a file and the rules that must fire there. --------
TRAPS = [
    ("a.py", 'password = "hunter2hunter2"', [SECRET]),
    ("a.py", "# password: longlonglong1", [SECRET]),
    ("a.py", "pw_key -> abcdefghij", [SECRET]),
    ("a.py", 'token = "abc" = "abcdefghijkl"', []),
    ("a.py", 'key == "abcdefghijkl"', []),
    ("a.py", 'KEY = input("xxxxxxxxx")', []),
    ("a.py", 'api_key = os.environ["API_KEY_VALUE"]', []),
    ("a.py", 'key = "ééé"', []),
    ("a.py", 'key = "éééé"', [SECRET]),
    ("a.py", "risk-based", [SECRET]),
    ("a.py", "monkey: aaaaaaaaaa", [SECRET]),
    ("a.py", "to\u212aen = abcdefghijkl", [SECRET]),
    ("a.py", "CREDENT\u0130AL = abcdefghijkl", [SECRET]),
    ("a.py", "key = 12345678\u3000\u00a0\u0085", []),
    ("a.py", "key =\u2003123456789", [SECRET]),
    ("a.go", "# eval(x)", []),
    ("a.py", " # eval(", []),
    ("a.py", "\u2003# eval(", []),
    ("a.js", "// eval(x)", [1]),
    ("a.c", "#define X system(a)", []),
    ("a.py", 'cur.execute("select %s", (a,))', [SQL]),
    ("a.java", 'st.executeQuery("a"+b)', [8]),
    ("a.py", 'return render_template("x", a=request.args.get("q"))', [9, XSS]),
    ("a.py", "return HttpResponse(escape(request.body))", []),
    ("a.py", 'open(request.files["a"])', [PATH]),
    ("a.py", "open(safe_join(root, request.path))", []),
    ("a.py", "open(secure_filename(request.path))", []),
    ("a.c", "sprintf(b, f);", [3, 6]),
    ("a.c", "fgets(b); sscanf(b); srand(1);", [4, 5, 11]),
    ("a.js", "dangerouslySetInnerHTML", [4]),
    ("a.py", "ast.literal_eval(x)", [1]),
    ("a.unheard_of", "eval(x)", [1]),
    ("README", "eval(x)", [1]),
    (".py", "eval(x)", [1]),
    ("dir.js/README", "innerHTML eval(", [1]),
    ("A.JS", "innerHTML", [3]),
    ("a.py", "\ufeff# eval(", [1]),
    ("a.py", "", []),
]
# --- End of fixed values --------------------------------------------------------


def test_traps(spark):
    df = spark.createDataFrame(
        [(i, path, text) for i, (path, text, _) in enumerate(TRAPS)], "id int, path string, content string"
    )
    found = {i: [] for i in range(len(TRAPS))}
    for row in scan_table(df, keep=["id"]).orderBy("id", "rule_ord").collect():
        assert row.line == 1
        found[row.id].append(row.rule_ord)
    assert {i: found[i] for i in found if found[i] != TRAPS[i][2]} == {}


def test_lines_end_at_line_feeds_only(scan):
    assert scan({"a.py": "a\r\neval(x)\r\nb\n", "b.py": "a\reval(x)\u2028eval(x)"}) == [
        ("a.py", 2, 1),
        ("b.py", 1, 1),
    ]


# path, line, rule_ord of the four sample files
GOLDEN = [
    *[("Sample.java", line, n) for line, n in [(11, 1), (15, 5), (18, 3), (23, 4)]],
    *[
        ("sample.c", line, n)
        for line, n in [
            (11, 1), (12, 2), (13, 3), (13, 6), (16, 6), (17, 4), (18, 5), (21, 6),
            (24, 7), (27, 8), (28, 9), (31, 10), (34, 11),
        ]
    ],
    *[("sample.js", line, n) for line, n in [(4, 3), (7, 1), (10, 9), (16, 6)]],
    *[("sample.py", line, n) for line, n in [(8, 1), (9, 2), (12, 10), (13, 3), (16, 4), (20, 6)]],
]


def test_golden_files(spark):
    import os

    from flawsieve import findings, scan_path
    from flawsieve.plans.reports import min_severity, severity_summary

    root = os.path.join(os.path.dirname(__file__), "fixtures")
    log = scan_path(spark, root, exclude=())
    rows = findings(log).select(F.element_at(F.split("path", "/"), -1), "line", "rule_ord").collect()
    assert sorted(tuple(row) for row in rows) == GOLDEN
    assert tuple(severity_summary(log).first()) == (4, 27, 16, 11, 0)
    assert min_severity(findings(log)).count() == 27


def test_scan_is_the_same_however_files_are_spread(spark, sf_small):
    from querysuite.corpus import code_corpus

    corpus = code_corpus(spark, sf_small)
    once = scan_table(corpus.coalesce(1))
    many = scan_table(corpus.repartition(13, "content"))
    assert once.count() == 361
    assert once.exceptAll(many).isEmpty() and many.exceptAll(once).isEmpty()


def test_rules_that_report_the_same_text_count_once(scan):
    rules = [
        Rule("python", 3, "val(", "Medium", "dynamic", 0.9),
        Rule("python", 1, "eval(", "High", "dynamic", 0.95),
        Rule("python", 2, "val(", "Low", "dynamic", 0.5),
        Rule("c", 1, "val(", "Low", "dynamic", 0.95),
    ]
    files = {"a.py": "eval(a); eval(b)\nxval(c)\n# val(", "b.c": "eval("}
    assert scan(files, rules=rules) == [("a.py", 1, 1), ("a.py", 1, 2), ("a.py", 2, 2), ("a.py", 2, 3), ("b.c", 1, 1)]


def test_user_rules_meet_the_trimmed_line(scan):
    rules = [Rule("python", 1, " x", "Low", "space", 0.1)]
    assert scan({"a.py": " x\n a x "}, rules=rules) == [("a.py", 2, 1)]
    rules.append(Rule("python", 2, "x ", "Low", "space", 0.1))
    assert scan({"a.py": " x \n x a\n"}, rules=rules) == [("a.py", 2, 2)]


def test_user_rules_as_a_table_and_beyond_the_prefilter(spark, scan):
    rules = [Rule("python", i, f"call{i}(", "Low", f"call {i}", 0.1) for i in range(1, 201)]
    table = spark.createDataFrame(rules, "rule_set string, rule_ord int, pattern string, severity string, description string, score double")
    text = "\n".join(f"call{i}(" for i in range(1, 201))
    expected = sorted(("a.py", i, i) for i in range(1, 201))
    assert scan({"a.py": text}, rules=table) == expected
    assert scan({"a.py": text}, rules=rules[:20]) == expected[:20]
    assert scan({"a.py": "eval(x)"}, rules=[]) == []


@pytest.mark.parametrize(
    "rule",
    [
        Rule("perl", 1, "x", "Low", "d", 0.1),
        Rule("python", 0, "x", "Low", "d", 0.1),
        Rule("python", 1001, "x", "Low", "d", 0.1),
        Rule("python", 1, "x", "Severe", "d", 0.1),
        Rule("python", 1, None, "Low", "d", 0.1),
    ],
)
def test_faulty_rules_are_refused(rule):
    with pytest.raises(ValueError):
        load_rules([rule])


def test_rule_places_are_unique_and_bounded(spark):
    with pytest.raises(ValueError, match="unique"):
        load_rules([Rule("c", 1, "x", "Low", "d", 0.1), Rule("c", 1, "y", "Low", "d", 0.1)])
    many = spark.range(MAX_RULES + 1).selectExpr(
        "'c' AS rule_set", "int(id) AS rule_ord", "'x' AS pattern", "'Low' AS severity", "'d' AS description", "0.1D AS score"
    )
    with pytest.raises(ValueError, match="at most"):
        load_rules(many)


def test_large_tables_filter_lines_before_the_join(scan):
    from flawsieve.rules import Rule

    rules = [Rule("python", n, f"call_{n}(", "High", f"Call {n}", 0.9) for n in range(1, 300)]
    rules.append(Rule("python", 300, "call", "Low", "Any call", 0.5))
    text = "x = call_17(1)\ny = 2\ncall_299 (1)\nz.a|b\\"
    assert scan({"a.py": text}, rules=rules) == [("a.py", 1, 17), ("a.py", 1, 300), ("a.py", 3, 300)]


def test_index_finds_what_each_pattern_alone_finds(spark):
    """Patterns of one character and more, of any script, on lines of any bytes, with heuristics and markers."""
    import random

    from flawsieve.operators import match
    from flawsieve.rules import RULE_SETS, Rule

    rng = random.Random(8)
    letters = ["a", "b", "(", "\\", "]", "^", "-", "é", "日", " ", "'", "#", "."]
    patterns = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(260)})
    rules = [Rule(s, i + 1, p, "Low", f"d{i % 90}", 0.5) for s in RULE_SETS for i, p in enumerate(patterns) if p.strip()]
    files = []
    for i in range(60):
        lines = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).encode() for _ in range(12)]
        lines.append(b"password = 'hunter2hunter2'")
        if i % 3 == 0:
            lines[rng.randrange(12)] += b"\xff" + rng.choice(patterns).encode()
        files.append((f"f{i}.{rng.choice(('py', 'js', 'java', 'c'))}", b"\n".join(lines)))
    df = spark.createDataFrame(files, "path string, content binary")

    def found():
        return sorted(tuple(r) for r in scan_log(df, rules=rules).select("path", "line", "rule_ord", "issue").fillna("").collect())

    indexed = found()
    limit, match.PREFILTER_PATTERNS = match.PREFILTER_PATTERNS, 1 << 20
    try:
        assert found() == indexed
    finally:
        match.PREFILTER_PATTERNS = limit
    assert len(indexed) > 5000 and len(set(indexed)) == len(indexed)


def test_postings_are_bounded_and_spread(spark):
    from flawsieve.operators.grams import gram_postings, posted_grams
    from querysuite.catalog import MOST_RULES

    posted = posted_grams(MOST_RULES)
    assert all(plain in r.pattern and plain.encode().decode("latin-1") == latin1 for r, (plain, latin1) in posted.items())
    postings = gram_postings(spark, MOST_RULES)
    assert postings.count() == 2 * len(MOST_RULES)
    assert postings.groupBy("_rule_set", "_gram").count().agg({"count": "max"}).first()[0] == 1
    longer = [Rule("python", i + 1, f"prefix_{i:03}_suffix", "Low", f"d{i}", 0.5) for i in range(300)]
    assert all("prefix" != plain != "suffix" for plain, _ in posted_grams(longer).values())


def test_heuristics_are_asked_once_of_an_indexed_line(spark, capsys):
    """A line comes once for each gram that it holds; one of these rows is asked."""
    rules = [Rule("python", i + 1, f"call_{i}(", "High", f"Call {i}", 0.9) for i in range(60)]
    text = "".join(f"call_{i}(" for i in range(60)) + "\npassword = \"hunter2hunter2\"; call_1("
    found = scan_table(spark.createDataFrame([("a.py", text)], "path string, content string"), rules=rules)
    found.explain()
    plan = capsys.readouterr().out
    assert len(re.findall(r"\(_line_gram#\d+ = \) AND", plan)) >= 4  # one for each heuristic
    assert sorted(r.line for r in found.collect()) == [1] * 60 + [2, 2]
