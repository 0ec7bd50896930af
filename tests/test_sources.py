"""File trees, sinks and the store of runs."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from flawsieve import findings, scan_log, scan_path, write_findings
from flawsieve.plans.reports import scan_status
from flawsieve.sources import files as sources, tree as tree_module
from flawsieve.sources.folders import folders_below, shared_folder
from flawsieve.sources.store import expire_attempts, last_run, last_run_of, read_runs, write_run

FILES = {
    "src/a b+c%.py": b"\xef\xbb\xbf# eval(x)\n" + b"x = 1\n" * 30 + b"eval(y)\n" + b"\xff key = '123456'\n# eval(\nexec(z)\n" * 20,
    "src/B.PY": b"# eval(x)\nx=1\n" * 30 + b"eval(y)",
    "src/crlf.js": b"eval(x)\r\n\r\n" * 30,
    "src/mark.c": b"\xef\xbb\xbf#define X system(a)\n" + b"free(x)\n" * 20 + b"gets(",
    "small.py": b"eval(x)",
    "clean.rs": b"fn main() {}\n",
    "node_modules/m/i.js": b"eval(x)",
    "src/tests/t.js": b"eval(x)",
    "src/__pycache__/c.py": b"eval(x)",
    "__init__.py": b"x = 1\neval(x)",
    ".hidden/deep/_a.js": b"eval(x)",
    "_a=b.py": b"eval(x)",
    "_metadata.py": b"eval(x)",
    "_metadata_of/a.py": b"eval(x)",
    "_metadata_of/_other/a.py": b"eval(x)",
    "a._COPYING_/b.go": b"eval(x)",
    ".hidden/_long%41+.py": b"\xef\xbb\xbf# eval(x)\n" + b"x = 1\n\xff eval(y)\n" * 40 + b"exec(z)",
    "empty.c": b"",
    "notes.txt": b"eval(x)",
    "py": b"eval(x)",
}
EXCLUDED_BY_DEFAULT = {"src/tests/t.js", "src/__pycache__/c.py"}
OUT_OF_SCOPE = {"node_modules/m/i.js", "notes.txt", "py"}


@pytest.fixture()
def tree(folder):
    root = os.path.join(folder, "node_modules", "test", "a tree")
    for name, content in FILES.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
    return root


@pytest.fixture()
def tiny_splits(spark):
    """Splits of a few lines, so that files span many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "0")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_listing(spark, tree):
    got = {os.path.relpath(r.path, tree): r.length for r in sources.list_files(spark, tree).collect()}
    assert got == {n: len(c) for n, c in FILES.items() if n not in OUT_OF_SCOPE | EXCLUDED_BY_DEFAULT}
    everything = sources.list_files(spark, tree, exclude=()).collect()
    assert {os.path.relpath(r.path, tree) for r in everything} == FILES.keys() - OUT_OF_SCOPE
    left = sources.list_files(spark, tree, ["**/src/**", "**/*.rs", "**/[._]*", "**/.hidden/**", "**/a.*/*", "_metadata_of/**"])
    assert sorted(os.path.relpath(r.path, tree) for r in left.collect()) == ["empty.c", "small.py"]


def test_every_file_is_read_once(spark, tree):
    read = sources.read_files(spark, tree, exclude=()).collect()
    assert {os.path.relpath(r.path, tree): bytes(r.content) for r in read} == {
        n: c for n, c in FILES.items() if n not in OUT_OF_SCOPE
    }
    assert len(read) == len(FILES) - len(OUT_OF_SCOPE)


def test_listing_goes_on_from_round_to_round(spark, tree, monkeypatch):
    for limit in (1, 3, 1000):
        monkeypatch.setitem(sources.list_tree.__globals__, "FOLDERS_PER_TASK", limit)
        listed = sources.list_tree(spark, f"file://{tree}/").collect()
        assert sorted(r.relative for r in listed) == sorted(FILES)


def test_a_hot_folder_is_dealt_out(spark, folder, monkeypatch):
    """One folder holds nearly all others; no task opens more than its share of them."""
    for i in range(120):
        os.makedirs(f"{folder}/tree/hot/d{i}/deep")
        open(f"{folder}/tree/hot/d{i}/deep/f.py", "w").close()
    monkeypatch.setitem(tree_module.walk_tree.__globals__, "FOLDERS_PER_TASK", 8)
    listed = sources.list_tree(spark, f"{folder}/tree").collect()
    assert len(listed) == 120
    written = max(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/tree-*"), key=os.path.getmtime)
    rounds = [spark.read.parquet(f"{written}/{r}").filter("kind = 'file'") for r in sorted(os.listdir(written)) if r.startswith("round=")]
    per_task = [r.n for found in rounds for r in found.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) >= 15 and max(per_task) <= 8


def test_folders_out_of_scope_stay_closed(spark, tree):
    closed = os.path.join(tree, "src/tests/deep/er")
    os.makedirs(closed)
    os.makedirs(os.path.join(tree, "node_modules/x/y"))
    walked = tree_module.walk_tree(spark, tree, sources.DEFAULT_EXCLUDES)
    assert {r.relative for r in walked.collect()} == {n for n in FILES if n not in EXCLUDED_BY_DEFAULT | {"node_modules/m/i.js"}}
    prunes = tree_module._prunes(["**/tests/**", "a/*/**", "x/**/y.py", "**/*.d/**", "c/**"])
    closed = ["tests", "p/tests", "a/b", "q.d", "c", "p/node_modules"]
    assert [f for f in closed if prunes(f)] == closed
    assert not any(map(prunes, ["a", "test", "p/testsx", "x", "x/z", "d", "p/c", "node_modules_of"]))


def test_reasons(spark, tree, folder):
    listing = tree_module.list_tree(spark, tree)
    listing.write.parquet(f"{folder}/listing")
    listing = spark.read.parquet(f"{folder}/listing")
    os.unlink(os.path.join(tree, "small.py"))
    with open(os.path.join(tree, "clean.rs"), "wb") as f:
        f.write(b"fn")
    with open(os.path.join(tree, "src/B.PY"), "ab") as f:
        f.write(b"more")
    os.unlink(os.path.join(tree, "py"))
    os.makedirs(os.path.join(tree, "py"))
    read = tree_module.read_with_reasons(listing, tree)
    reasons = {os.path.relpath(r.path, tree): r.reason for r in read.collect()}
    assert len(reasons) == len(FILES) and {k: v for k, v in reasons.items() if v} == {
        "small.py": "vanished", "clean.rs": "short read", "src/B.PY": "grown", "py": reasons["py"],
    }
    assert reasons["py"] in ("unreadable", "denied")
    assert {type(e) for e in map(tree_module.reason_of, (FileNotFoundError(), PermissionError(), OSError()))} == {str}
    assert [tree_module.reason_of(e) for e in (FileNotFoundError(), PermissionError(), OSError())] == ["vanished", "denied", "unreadable"]


def test_files_out_of_scope_are_not_read(spark, tree):
    files = [f for f in sources.read_files(spark, tree).inputFiles() if "/tree-" not in f]  # but for the listing
    assert {os.path.splitext(f)[1].lower() for f in files} == {".py", ".js", ".c", ".rs"}


def test_file_larger_than_a_row_scans_the_same(spark, tree, tiny_splits, monkeypatch):
    monkeypatch.setitem(sources.list_tree.__globals__, "SPLIT_BYTES", 50)
    whole = scan_path(spark, tree, exclude=())
    split = scan_path(spark, tree, exclude=(), whole_file_bytes=60)
    assert sources.read_files(spark, tree, (), 60).count() == 12
    assert sources._large_file_lines(spark, tree, (), 60).rdd.getNumPartitions() > 10
    assert whole.count() == split.count() > 100
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()
    first = findings(split).filter("line = 1 AND rule_ord < 1001").select("path", "rule_ord").collect()
    # Behind a byte order mark the first line is no comment.
    assert {(os.path.basename(r.path), r.rule_ord) for r in first} >= {("a b+c%.py", 1), ("mark.c", 7)}
    lines = {os.path.relpath(r.path, tree): r.n_lines for r in scan_status(split).collect()}
    assert lines == {n: c.count(b"\n") + 1 for n, c in FILES.items() if n not in OUT_OF_SCOPE}


def test_unread_files(spark, tree, folder):
    sources.list_files(spark, tree).write.parquet(f"{folder}/listing")
    listing = spark.read.parquet(f"{folder}/listing")
    reading = sources.read_files(spark, tree)
    os.unlink(os.path.join(tree, "small.py"))  # gone between listing and reading
    log = scan_log(reading)
    assert findings(log).count() > 0
    gone = sources.unread_files(listing, log).collect()
    assert [(os.path.basename(r.path), r.reason) for r in gone] == [("small.py", "unreadable")]


def test_large_files_read_in_part_are_told(spark, tree, tiny_splits, monkeypatch):
    lines = sources._large_file_lines

    def failing(*args):  # one split of one file ends early
        return lines(*args).filter("NOT (_file LIKE '%crlf.js' AND _block = 64)")

    whole = scan_path(spark, tree, exclude=(), whole_file_bytes=60)
    monkeypatch.setattr(sources, "_large_file_lines", failing)
    log = scan_path(spark, tree, exclude=(), whole_file_bytes=60)
    gone = sources.unread_files(sources.list_files(spark, tree, ()), log).collect()
    assert [os.path.basename(r.path) for r in gone] == ["crlf.js"]
    # Collected whole, as a filter on paths would change the splits.
    expected = [r for r in whole.collect() if not r.path.endswith("crlf.js")]
    assert sorted(map(str, log.collect())) == sorted(map(str, expected))


def test_supported_files_are_distinct(spark):
    df = spark.createDataFrame([("a.py",), ("a.py",), ("a.txt",), ("node_modules/a.py",)], "path string")
    assert [r.path for r in sources.supported_files(df).collect()] == ["a.py"]


def test_formats(spark, folder):
    df = spark.createDataFrame(
        [("b.js", "eval(x)\n\nMath.random()"), ("clean.py", "x")], "path string, content string"
    )
    log = scan_log(df)
    for fmt in ("json", "parquet", "text"):
        write_findings(log, f"{folder}/{fmt}", fmt)
    rows = sorted((r["path"], r["line"], r["severity"]) for r in map(json.loads, _lines(spark, f"{folder}/json")))
    assert rows == [("b.js", 1, "High"), ("b.js", 3, "Medium")]
    assert spark.read.parquet(f"{folder}/parquet").exceptAll(findings(log)).isEmpty()
    assert spark.read.parquet(f"{folder}/parquet").count() == 2
    text = _lines(spark, f"{folder}/text")
    assert text[text.index("clean.py") + 1] == "No security vulnerabilities found."
    assert text[text.index("b.js") + 2].startswith("2. [Line 3] (Medium) Weak randomness")
    with pytest.raises(ValueError):
        write_findings(log, f"{folder}/xml", "xml")


def test_text_sink_keeps_long_files_together(spark, folder):
    long = "\n".join(["eval(x)"] * 50)
    log = scan_log(spark.createDataFrame([("a.py", long), ("b.py", "x"), ("c.py", long)], "path string, content string"))
    write_findings(log, f"{folder}/text", "text", part_size=7, staging=f"{folder}/log")
    wanted = [f"{n}. [Line {n}] (High) " for n in range(1, 51)]
    names = sorted(f for f in os.listdir(f"{folder}/text") if f.startswith("part-"))
    got = [line for name in names for line in open(f"{folder}/text/{name}").read().splitlines()]
    assert len(got) == 104 and [got.index(f) for f in ("a.py", "b.py", "c.py")] == [0, 51, 53]
    assert got[52] == "No security vulnerabilities found."
    for start in (1, 54):
        assert all(line.startswith(w) for line, w in zip(got[start : start + 50], wanted, strict=True))


def _lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_runs(spark, folder):
    def log_of(*files):
        return scan_log(spark.createDataFrame(list(files), "path string, content string"))

    store = f"{folder}/store"
    write_run(log_of(("a.py", "eval(x)"), ("b.py", "x")), store, 1)
    write_run(log_of(("a.py", "eval(x)\nexec(y)")), store, 10)
    write_run(log_of(("old.py", "eval(x)")), store, 9)
    newest = last_run(spark, store)
    assert sorted((r.path, r.line, r.rule_ord) for r in newest.collect()) == [
        ("a.py", 0, 0), ("a.py", 1, 1), ("a.py", 2, 2),
    ]
    assert sorted(tuple(r) for r in read_runs(spark, store).collect()) == [(1, 2, 1), (9, 1, 1), (10, 1, 2)]
    every = spark.read.parquet(f"{store}/log")
    assert last_run_of(every).drop("run_id", "attempt").exceptAll(newest).isEmpty()

    write_run(log_of(("a.py", "exec(x)")), store, 10)  # the same run again
    assert findings(last_run(spark, store)).count() == 1
    assert read_runs(spark, store).filter("run_id = 10").first().n_issues == 1
    log_of(("a.py", "x")).write.parquet(f"{store}/log/run_id=10/attempt=9-broken")  # an attempt that was not finished
    assert findings(last_run(spark, store)).count() == 1
    write_run(log_of(("a.py", "x")), store, 11)  # a clean run is the last one, and has no report
    assert last_run(spark, store) is None
