"""Current findings kept by batches, and trees scanned again as they change."""

import os

import pytest

from flawsieve import scan_path
from flawsieve.plans.scan import findings, quarantine, read_against, scan_read
from flawsieve.sources.folders import folders_below, is_stored, once, stage
from flawsieve.streaming import current, watch
from flawsieve.streaming.revisions import current_findings, scan_revisions

REVISION = "path string, content string, event_time timestamp, revision long"


def revisions(spark, rows):
    return spark.createDataFrame(rows, REVISION)


def at(n):
    import datetime

    return datetime.datetime(2024, 1, 1, n)


ROWS = [
    ("a.py", "eval(x)", at(1), 1), ("a.py", "x", at(3), 1), ("a.py", "exec(x)", at(2), 9),
    ("b.js", "eval(x)", at(1), 1), ("b.js", "eval(y)\nMath.random()", at(1), 2), ("c.c", "gets(", None, 1),
    ("d.py", "x", at(1), 1), ("e.rs", "eval(", at(5), None), ("f.txt", "eval(", at(1), 1),
]


def same(a, b):
    return sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


@pytest.mark.parametrize("order", [range(9), range(8, -1, -1), [2, 0, 1, 4, 3, 5, 8, 7, 6]])
def test_batches_in_any_order(spark, folder, order):
    rows = [ROWS[i] for i in order]
    for n, part in enumerate((rows[:4], rows[4:], rows[2:6]), 1):
        current.update_current(scan_revisions(revisions(spark, part)), f"{folder}/store", n, 3, f"{folder}/staged{n}")
    assert same(current.read_current(spark, f"{folder}/store"), current_findings(scan_revisions(revisions(spark, ROWS))))


def test_a_batch_writes_its_own_buckets_once(spark, folder):
    store = f"{folder}/store"
    log = scan_revisions(revisions(spark, ROWS))
    current.update_current(log, store, 1, 16)
    held = {r.bucket: r.folder for r in current._manifest(spark, store).collect()}
    assert len(held) > 2
    one = scan_revisions(revisions(spark, [("a.py", "os.system(x)", at(9), 1)]))
    current.update_current(one, store, 2, 16)
    after = {r.bucket: r.folder for r in current._manifest(spark, store).collect()}
    assert after.keys() == held.keys() and sum(after[b] != held[b] for b in held) == 1
    rows = current.read_current(spark, store).collect()
    current.update_current(log, store, 2, 16)  # the same number again
    assert {r.bucket: r.folder for r in current._manifest(spark, store).collect()} == after
    # A batch that broke off before its manifest: folders that nobody names.
    one.withColumn("_bucket", one.line).write.partitionBy("_bucket").parquet(f"{store}/data/{3:020d}-broken")
    assert sorted(map(str, current.read_current(spark, store).collect())) == sorted(map(str, rows))
    assert current.expire_current(spark, store) == 3  # two of the broken batch, one written anew
    assert len(folders_below(spark, f"{store}/data", 2)) == len(after)
    assert sorted(map(str, current.read_current(spark, store).collect())) == sorted(map(str, rows))


def test_stream_keeps_the_table_current(spark, folder):
    for i in range(3):
        revisions(spark, ROWS[3 * i : 3 * i + 3]).coalesce(1).write.parquet(f"{folder}/in/{i}")
    source = spark.readStream.schema(REVISION).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    for _ in range(2):  # a restart finds nothing more to do
        current.write_current(source, f"{folder}/store", f"{folder}/checkpoint", trigger={"availableNow": True}, buckets=2).awaitTermination()
    assert same(current.read_current(spark, f"{folder}/store"), current_findings(scan_revisions(revisions(spark, ROWS))))


def test_an_empty_table(spark, folder):
    assert current.read_current(spark, f"{folder}/none").count() == 0
    current.update_current(scan_revisions(revisions(spark, [])), f"{folder}/store", 1)
    assert current.read_current(spark, f"{folder}/store").count() == 0


def write(root, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)


def test_changes_of_a_tree(spark, folder):
    root, store = f"{folder}/tree", f"{folder}/store"
    write(root, {"a.py": "eval(x)", "src/b.js": "eval(y)", "src/_c.py": "exec(z)", "tests/t.py": "eval(", "n.txt": "eval("})

    def check():
        whole = findings(scan_path(spark, root)).drop("n_lines")
        kept = current.read_current(spark, store).drop("event_time", "revision")
        assert same(kept, whole)
        return {(os.path.basename(r.path), r.line, r.rule_ord) for r in kept.collect()}

    watch.scan_changes(spark, root, store)
    assert check() == {("a.py", 1, 1), ("b.js", 1, 1), ("_c.py", 1, 2)}
    write(root, {"a.py": "x = 1\nos.system(y)", "d.go": "eval(q)"})
    os.utime(f"{root}/a.py", (1, 1))  # a file put back with an old time is a change as well
    os.unlink(f"{root}/src/b.js")
    watch.scan_changes(spark, root, store)
    assert check() == {("a.py", 2, 10), ("_c.py", 1, 2), ("d.go", 1, 1)}
    stored = folders_below(spark, f"{store}/data", 2)
    watch.scan_changes(spark, root, store)  # nothing changed, so nothing is read or written
    assert folders_below(spark, f"{store}/data", 2) == stored
    write(root, {"src/b.js": "Function(1)"})
    watch.scan_changes(spark, root, store)
    assert ("b.js", 1, 2) in check()


def test_a_pass_that_broke_off_and_files_that_cannot_be_read(spark, folder, monkeypatch):
    root, store = f"{folder}/tree", f"{folder}/store"
    write(root, {"a.py": "eval(x)", "b.py": "exec(y)"})
    done, update = [], watch.update_current
    monkeypatch.setattr(watch, "update_current", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        watch.scan_changes(spark, root, store)
    monkeypatch.setattr(watch, "update_current", lambda *a: (done.append(a[2]), update(*a)))
    write(root, {"b.py": "exec(longer)"})  # after the snapshot
    problems = watch.scan_changes(spark, root, store)
    assert [(os.path.basename(r.path), r.reason) for r in problems.collect()] == [("b.py", "grown")]
    assert [os.path.basename(r.path) for r in current.read_current(spark, store).collect()] == ["a.py"]
    assert watch.scan_changes(spark, root, store).count() == 0 and done == [1, 2]
    assert sorted(os.path.basename(r.path) for r in current.read_current(spark, store).collect()) == ["a.py", "b.py"]


def test_quarantine(spark):
    listing = spark.createDataFrame([("a.py", 7), ("b.py", 7), ("c.py", 7), ("d.py", 7)], "path string, length long")
    files = spark.createDataFrame([("a.py", "eval(x)"), ("b.py", "eval("), ("c.py", "eval(xx)"), ("z.py", "eval(")], "path string, content string")
    log = scan_read(read_against(listing, files))
    assert sorted(map(tuple, quarantine(log).collect())) == [("b.py", "short read"), ("c.py", "grown"), ("d.py", "vanished")]
    assert [(r.path, r.rule_ord) for r in log.filter("rule_ord > 0").collect()] == [("a.py", 1)]
    assert {r.path: r.n_lines for r in log.filter("rule_ord = 0").collect()} == {"a.py": 1, "b.py": None, "c.py": None, "d.py": None}


def test_stored_logs_are_taken_as_they_are(spark, folder):
    log = scan_revisions(revisions(spark, ROWS))
    assert not is_stored(log)
    kept = stage(log, f"{folder}/log")
    assert is_stored(kept) and is_stored(kept.filter("line > 0").select("path")) and not is_stored(kept.groupBy("path").count())
    assert once(kept) is kept and is_stored(once(log))
