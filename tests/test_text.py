"""Column functions on text and paths, line splitting, random files on both engines."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flawsieve import scan_log, scan_table
from flawsieve.functions.paths import extension, glob_regex, in_scope, language, relative_to
from flawsieve.functions.text import WHITE_SPACE, quoted, trim_space
from flawsieve.operators.lines import explode_lines
from querysuite import oracles


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row[0] for row in df.orderBy("i").selectExpr(expr("v")).collect()]


def test_white_space_is_pythons_without_separators():
    # str.isspace also counts the four ASCII separators, which are no White_Space.
    spaces = {chr(c) for c in range(0x110000) if chr(c).isspace()} - set("\x1c\x1d\x1e\x1f")
    assert set(WHITE_SPACE) == spaces


def test_trim_space(spark):
    values = [f"{WHITE_SPACE}a{WHITE_SPACE}b{WHITE_SPACE}", "", WHITE_SPACE, "\u200bx\u200b", "é"]
    assert column(spark, values, trim_space) == [f"a{WHITE_SPACE}b", "", "", "\u200bx\u200b", "é"]


def test_extension_and_language(spark):
    paths = ["a.py", "A.PY", ".py", "x/.Py", "a.b/c", "a.tar.gz", "a.", "", "d.js/e.TSX", "a.py/"]
    assert column(spark, paths, extension) == [".py", ".py", ".py", ".py", "", ".gz", ".", "", ".tsx", ""]
    assert column(spark, paths, language) == [
        *["python"] * 4, *["unknown"] * 4, "typescript", "unknown",
    ]


@pytest.mark.parametrize(
    ("glob", "inside", "outside"),
    [
        ("**/test/**", ["test/a.py", "x/test/a", "/x/y/test/z/a"], ["tests/a", "x/atest/a", "test"]),
        ("*.py", ["a.py", ".py"], ["x/a.py", "a.pyc", "apy"]),
        ("**/*.{js,ts}", ["a.js", "x/y/b.ts"], ["a.jsx", "js"]),
        ("src/?[!0-9]/[a-c].c", ["src/xy/b.c"], ["src/x1/b.c", "src/xy/d.c", "src/xyz/b.c"]),
        ("a+b(c).py", ["a+b(c).py"], ["aab(c).py"]),
    ],
)
def test_globs(spark, glob, inside, outside):
    got = column(spark, inside + outside, lambda v: f"{v} RLIKE {quoted('(?s)^/*+' + glob_regex(glob))}")
    assert got == [True] * len(inside) + [False] * len(outside)


def test_scope(spark):
    scope = {
        "a.py": True,
        "/r (1)/node_modules.py": True,
        "/r (1)/x/test.JSX": True,
        ".h": True,
        "/r (1)/x.y/.Cc": True,
        "/r (1)/a.pyc": False,
        "/r (1)/py": False,
        "/r (1)/node_modules/a.py": False,
        "node_modules/a.py": False,
        "/r (1)/x/node_modules/y/a.py": False,
        "/r (1)/test/a.py": False,
        "/r (1)/x/y/test/a.py": False,
        "/r (1)/b.go": False,
        "/r (1)/c/b.go": True,
        "/r (1)/line\nfeed.rs": True,
    }
    got = column(spark, scope, lambda v: in_scope(v, ["**/test/**", "b.*"], "/r (1)/"))
    assert dict(zip(scope, got)) == scope
    below_test = column(spark, ["/test/a.py", "/test/test/a.py"], lambda v: in_scope(v, ["**/test/**"], "/test"))
    assert below_test == [True, False]
    assert column(spark, ["/test/a.py"], lambda v: in_scope(v, ["**/test/**"])) == [False]


def test_relative_to(spark):
    paths = ["/r/a.py", "/r2/a.py", "/r", "/r/x/b"]
    assert column(spark, paths, lambda v: relative_to(v, "/r/")) == ["a.py", "/r2/a.py", "/r", "x/b"]


def test_lines_keep_the_last_empty_one(spark):
    df = spark.createDataFrame([("a.py", "x\n y \r\n"), ("b.py", "")], "path string, content string")
    rows = explode_lines(df).orderBy("path", "line").select("path", "line", "text").collect()
    assert [tuple(row) for row in rows] == [("a.py", 1, "x"), ("a.py", 2, "y"), ("a.py", 3, ""), ("b.py", 1, "")]


def test_bytes_that_are_not_utf8(spark):
    files = [
        ("short.py", b"caf\xe9\nkey = '\xff\xff'\neval(x)"),  # four bytes of value
        ("long.py", b"key = '\xff\xff\xff\xff\xff\xff\xff'"),  # nine
        ("nbsp.py", b"\xa0# eval(x)\n\xc3\x28"),  # no space in UTF-8
        ("mixed.py", "to\u212aen = é".encode() + b"\xff234567"),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    rows = scan_table(df).select("path", "line", "rule_ord").collect()
    assert sorted(tuple(row) for row in rows) == [
        ("long.py", 1, 1004),
        ("mixed.py", 1, 1004),
        ("nbsp.py", 1, 1),
        ("short.py", 3, 1),
    ]
    text = explode_lines(df.withColumn("content", F.col("content").cast("string")))
    assert {bytes(r[0]) for r in text.filter("path = 'short.py'").select(F.col("text").cast("binary")).collect()} == {
        b"caf\xe9", b"key = '\xff\xff'", b"eval(x)",
    }


def test_log_marks_every_file(spark):
    df = spark.createDataFrame(
        [("a.py", "x\n\n"), ("b.py", ""), ("c.js", "eval(a)\nexec(b)"), ("d.py", None)], "path string, content string"
    )
    rows = scan_log(df).select("path", "line", "rule_ord", "n_lines").collect()
    assert sorted(tuple(row) for row in rows if row.rule_ord == 0) == [
        ("a.py", 0, 0, 3), ("b.py", 0, 0, 1), ("c.js", 0, 0, 2),
    ]
    assert sorted(tuple(row)[:3] for row in rows if row.rule_ord) == [("c.js", 1, 1), ("c.js", 2, 10)]


TOKENS = (
    "eval( exec( shell=True pickle.load .md5( random.random() request.args.get request. open( execute( query( "
    "format( + % render_template HttpResponse escape( safe_join secure_filename password PASSWD pwd Secret kEy "
    "token auth credential = : -> input( os.environ sk- AKIA gho_ innerHTML Function( Runtime.getRuntime().exec( "
    "printf( sprintf( gets( system( # // ' \" é \u212a \u0130 \u3000 abcdefghi x 1 \t \r \n \n"
).split(" ")


def test_random_files_on_both_engines(spark):
    draw = random.Random(11)
    extensions = ["py", "js", "java", "c", "go", "h", "none"]
    files = []
    for i in range(4000):
        tokens = draw.choices(TOKENS, k=draw.randint(0, 40))
        files.append((f"f{i}.{draw.choice(extensions)}", draw.choice(["", " "]).join(tokens)))
    ours = scan_table(spark.createDataFrame(files, "path string, content string"))
    got = sorted(tuple(row) for row in ours.select("path", "line", "rule_ord", "issue", "severity").collect())

    con = duckdb.connect()
    con.execute("CREATE TABLE files (path VARCHAR, content VARCHAR)")
    con.execute(
        "INSERT INTO files SELECT unnest($1), unnest($2)", [[f[0] for f in files], [f[1] for f in files]]
    )
    sql = oracles._with(oracles._typed("files"), oracles._LINES, oracles._RULES, oracles._FOUND)
    expected = con.execute(sql + "SELECT path, line, rule_ord, issue, severity FROM found").fetchall()
    assert got == sorted(expected)
    assert len(got) > 5000
